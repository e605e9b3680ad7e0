"""Definitions and calls of brace languages, from tokens and matched brackets.

A file is cut into tokens (text and comments drop out, so braces in them don't count), brackets are matched, and the
tokens are gone through once.  A language's rules say where a token begins a definition, where that ends, and whether
the block behind it holds declarations or code.  No grammar is built; what a rule doesn't know it passes over.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple


class Token(NamedTuple):
    text: str
    at: int
    line: int


class Found(NamedTuple):
    """A definition: its tokens from ``first`` to ``last``; the block at ``body`` holds declarations or code."""

    name: str
    kind: str
    first: int
    last: int
    body: int = -1  # the token of the opening brace
    declares: bool = False
    scope: tuple[str, ...] = ()  # names between the scope and the name
    opens: bool = True  # whether what is inside belongs to it
    type_name: str = ""  # of a block of declarations


class Call(NamedTuple):
    to: str
    first: int  # the token where the callee begins
    qualifier: str | None = None
    plain: bool = False  # a name alone


@dataclass
class Source:
    text: str
    tokens: list[Token]
    pair: dict[int, int]
    inside: list[int]  # of each token the bracket around it, or -1
    includes: list[str] = field(default_factory=list)
    starts: dict[int, int] = field(default_factory=dict)  # of the names of calls: where their chains begin

    def __getitem__(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def after(self, i: int) -> int:
        """The token behind a bracket's group, or behind a token."""
        return self.pair.get(i, i) + 1 if self[i] in "([{" and self[i] else i + 1

    def angles(self, i: int) -> int:
        """The token behind the type arguments that open at ``i``; ``i`` itself if they don't close."""
        depth, k = 0, i
        while k < len(self.tokens) and k - i < 400:
            t = self[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t == "{" and self[k - 1] in ("<", ",", ":", "=>", "extends", "|", "&"):  # an object type
                k = self.after(k)
                continue
            elif t in (";", "{", "}", ")", "]"):
                return i
            elif t in ("(", "["):
                k = self.after(k)
                continue
            k += 1
        return i

    def angles_back(self, i: int) -> int:
        """The token before the type arguments that close at ``i``; ``i`` itself if they don't open."""
        depth = 0
        for k in range(i, max(-1, i - 200), -1):
            t = self[k]
            depth += (t == ">") - (t == "<")
            if not depth:
                return k - 1
            if t in (";", "{", "}"):
                return i
        return i


#: Of a longer callee, a chain of very many calls, the end is its name.
MOST_NAME = 1000
_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
_COMMON = r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)"""
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?"
_REST = r"(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>::|->|=>|\?\.|\.\.\.|.)"
_TEXTS = {
    "cpp": rf'R"(?P<mark>[^()\s\\]*)\(.*?\)(?P=mark)"|{_DOUBLE}|{_SINGLE}',
    "javascript": rf"`(?:[^`\\]|\\.)*`?|{_DOUBLE}|{_SINGLE}",
    "rust": r'b?r(?P<mark>#*)".*?"(?P=mark)|b?"(?:[^"\\]|\\.)*"?' + r"|b?'(?:[^'\\\n]|\\[^\n]+?)'|'[A-Za-z_]\w*",
    "go": rf"`[^`]*`?|{_DOUBLE}|{_SINGLE}",
    "kotlin": rf'""".*?"""|{_DOUBLE}|{_SINGLE}',
    "swift": rf'#*""".*?"""#*|#"[^\n]*?"#|{_DOUBLE}',
    "csharp": rf'"""+.*?"""+|\$?@\$?"(?:[^"]|"")*"|\$?{_DOUBLE}|{_SINGLE}',
    "java": rf'"""(?:[^\\]|\\.)*?"""|{_DOUBLE}|{_SINGLE}',
}
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_LEXERS = {lang: re.compile(rf"{_COMMON}|(?P<text>{texts})|{_REST}", re.S) for lang, texts in _TEXTS.items()}
_DIRECTIVE = re.compile(r"[ \t]*#(?:[^\n\\]|\\.)*", re.S)
_INCLUDE = re.compile(r"\s*#\s*include\s*[<\"]([^>\"]+)[>\"]")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Behind these a slash begins a pattern, not a division.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of do else void".split()) | {""}


def lex(text: str, lang: str) -> Source:
    lexer, out, includes, at, line = _LEXERS[lang], [], [], 0, 1
    start_of_line = True
    while at < len(text):
        if lang in ("cpp", "csharp") and start_of_line and (m := _DIRECTIVE.match(text, at)):
            if inc := _INCLUDE.match(m[0]):
                includes.append(inc[1])
        elif lang == "javascript" and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (out[-1].text if out else "") in _BEFORE_REGEX and (m := _REGEX.match(text, at)):
            out.append(Token("''", at, line))
        else:
            m = lexer.match(text, at)
            if m["skip"] is None:
                out.append(Token(m[0] if m["text"] is None else "''", at, line))
        lines = text.count("\n", at, m.end())
        if lines or m.end() > at:
            start_of_line = (lines > 0 and not text[text.rfind("\n", at, m.end()) + 1 : m.end()].strip()) or (start_of_line and not m[0].strip())
        line += lines
        at = m.end() if m.end() > at else at + 1
    pair: dict[int, int] = {}
    stack: list[int] = []
    inside = []
    for i, t in enumerate(out):
        inside.append(stack[-1] if stack else -1)
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            if any(out[k].text == _CLOSE[t.text] for k in stack[-50:]):
                while out[stack[-1]].text != _CLOSE[t.text]:
                    stack.pop()
                k = stack.pop()
                pair[k], pair[i] = i, k
    return Source(text, out, pair, inside, includes)


def _word(t: str) -> bool:
    return bool(_WORD.match(t))


def _back_to(s: Source, i: int, stops: frozenset[str]) -> int:
    """The first token of a declaration that reaches ``i``: behind the last of the stops."""
    k = i
    while k > 0 and s[k - 1] not in stops:
        if s[k - 1] in _CLOSE and k - 1 in s.pair:
            if s[k - 1] == "}":
                break
            k = s.pair[k - 1]
        else:
            k -= 1
    return k


# ---- C and C++ -------------------------------------------------------------------------------------------------------

#: Words of the languages that name no function.
_CPP_WORDS = frozenset("if for while switch catch return sizeof alignof decltype typeid new delete throw else do case goto defined static_assert noexcept operator alignas using typedef static_cast dynamic_cast const_cast reinterpret_cast co_await co_return co_yield __attribute__ requires".split())
_CPP_STOPS = frozenset((";", "{", "}"))


def _cpp(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t in ("class", "struct", "namespace", "union"):
        if s[i - 1] in ("enum", "friend") or (t != "namespace" and s[i - 1] in ("<", ",") and s[i + 2] in (",", ">", "=", "...")):
            return None
        k, name = i + 1, ""
        while k < len(s.tokens):
            if s[k] in ("(", "["):  # attributes and alignments
                k = s.after(k)
            elif s[k] == "<":
                if (n := s.angles(k)) == k:
                    return None
                k = n
            elif _word(s[k]) or s[k] == "::":
                if s[k] not in ("final", "alignas", "__attribute__", "inline", "::"):
                    name = f"{name}::{s[k]}" if t == "namespace" and s[k - 1] == "::" else s[k]
                k += 1
            else:
                break
        if s[k] == ":" and t != "namespace":
            while k < len(s.tokens) and s[k] not in ("{", ";"):
                k = s.after(k)
        if s[k] != "{" or k not in s.pair:
            return None
        name = name or ("<anonymous>" if t == "namespace" else "")
        if not name or t == "union":
            return None
        kind = {"namespace": "module"}.get(t, t)
        first = i - 1 if t == "namespace" and s[i - 1] == "inline" else i
        return Found(name, kind, first, s.pair[k], k, True)
    if not (declares and _word(t) and t not in _CPP_WORDS and s[i + 1] == "(" and i + 1 in s.pair):
        return None
    if s[i - 1] in (".", "->", "=", ",", "(", "return") or s[i - 1] == ":" and s[i - 2] not in ("public", "private", "protected", "signals", "slots"):
        return None
    k = s.pair[i + 1] + 1
    while k < len(s.tokens) and s[k] != "{":
        if s[k] == "->":
            k += 1
            while _word(s[k]) or s[k] in ("::", "*", "&", "<"):
                k = max(s.angles(k), k + 1) if s[k] == "<" else k + 1
        elif s[k] == ":":  # what a constructor initialises
            k += 1
            while k < len(s.tokens) and s[k] not in (";",):
                while _word(s[k]) or s[k] == "::":
                    k += 1
                if s[k] == "<":
                    k = max(s.angles(k), k + 1)
                if s[k] not in ("(", "{"):
                    break
                k = s.after(k)
                if s[k] == "...":
                    k += 1
                if s[k] != ",":
                    break
                k += 1
            break
        elif _word(s[k]) or s[k] in ("&", "[", "("):
            k = s.after(k)
        else:
            return None
    if s[k] != "{" or k not in s.pair:
        return None
    name, prefix, j = t, [], i
    if s[j - 1] == "~":
        name, j = "~" + name, j - 1
    while s[j - 1] == "::":
        j -= 1
        if s[j - 1] == ">":
            j = s.angles_back(j - 1) + 1
        if not _word(s[j - 1]):
            break
        j -= 1
        prefix.insert(0, s[j])
    first = _back_to(s, j, _CPP_STOPS)
    while first < j and s[first] in ("public", "private", "protected", "signals", "slots") or s[first] == ":" and first < j:
        first += 1
    while s[first] == "template" and s[first + 1] == "<" and first < j:
        first = max(s.angles(first + 1), first + 2)
    if s[first] in ("typedef", "using", "return", "else"):
        return None
    member = bool(prefix) or any(f.kind in ("class", "struct") for f in scope)
    return Found(name, "method" if member else "function", first, s.pair[k], k, False, tuple(prefix))


def _cpp_call(s: Source, i: int) -> Call | None:
    k = i + 1
    if s[k] == "<":
        k = s.angles(k)
    if s[k] != "(" or s[i] in _CPP_WORDS:
        return None
    start, qualifier = i, None
    while s[start - 1] in (".", "->", "::"):
        if s[start - 1] == "::" and qualifier is None and start == i and _word(s[start - 2]):
            qualifier = s[start - 2]
        if (k := _primary(s, start - 2)) is None:
            break
        start = s.starts.get(k, k)
    s.starts[i] = start
    before = s[start - 1]
    if before == "new" or before == "~" or (_word(before) and before not in _CPP_WORDS | {"and", "or", "not"}) or (before == ">" and s.angles_back(start - 1) != start - 1 and _word(s[s.angles_back(start - 1)]) and s[s.pair.get(i + 1, i) + 1] == ";" and start == i):
        return None
    return Call(s[i], start, qualifier, start == i)


def _primary(s: Source, i: int) -> int | None:
    """Where the expression that ends at ``i`` begins: a name, a group with what it belongs to, or a text."""
    while i >= 0:
        t = s[i]
        if t in (")", "]") and i in s.pair:
            i = s.pair[i] - 1
            if not (_word(s[i]) or s[i] in (")", "]", ">")):
                return i + 1
        elif t == ">" and (k := s.angles_back(i)) != i:
            i = k
        elif t == "?" or t == "!":
            i -= 1
        elif _word(t) or t == "''" or t[:1].isdigit():
            return i
        else:
            return None
    return None


# ---- JavaScript and TypeScript ---------------------------------------------------------------------------------------

_JS_WORDS = frozenset("async if for while switch catch return function typeof new delete throw else do case void in of instanceof await yield import class".split())
_JS_EXPRESSION = frozenset("= ( , : ? => [ ! + - * return new typeof void await yield && || & | ... case".split())


def _js(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t == "function" and _word(s[i + 1]):
        first = i - 1 if s[i - 1] == "async" else i
        if s[first - 1] in _JS_EXPRESSION:
            return None
        k = s.angles(i + 2) if s[i + 2] == "<" else i + 2
        body = _js_body(s, s.after(k)) if s[k] == "(" else -1
        if body < 0:
            return None
        return Found(s[i + 1], "method" if scope else "function", first, s.pair[body], body)
    if t == "class" and s[i - 1] not in (".", "abstract") and (_word(s[i + 1]) or s[i + 1] == "{"):
        k, name = i + 1, "<anonymous>"
        if _word(s[k]) and s[k] != "extends":
            name, k = s[k], k + 1
        while k < len(s.tokens) and s[k] not in ("{", ";"):
            k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
        return Found(name, "class", i, s.pair[k], k, True) if s[k] == "{" and k in s.pair else None
    if declares and _word(t) and not scope:
        k = i - 1
        while k >= 0 and s[k] not in ("const", "let", "var", ";", "{") and not (s[k] == "}" and k not in s.pair):  # also the second name of a statement
            if s[k] == "}":
                k = s.pair[k]
            if s[k] in (")", "]") and k in s.pair:
                k = s.pair[k]
            if i - k > 200:
                return None
            k -= 1
        if k < 0 or s[k] not in ("const", "let", "var") or not (k == i - 1 or s[i - 1] == ","):
            return None
        k = i + 1
        if s[k] == ":":
            while k < len(s.tokens) and s[k] not in ("=", ";"):
                k = s.after(k)
        if s[k] != "=":
            return None
        k += 1
        k += s[k] == "async"
        if s[k] == "function":
            k += 1
            if s[k] == "*":
                return None
            while k < len(s.tokens) and s[k] != "(":
                k += 1
            body = _js_body(s, s.after(k))
            return Found(t, "function", i, s.pair[body], body) if body >= 0 else None
        if s[k] == "<":
            k = max(s.angles(k), k + 1)
        if s[k] == "(":
            k = s.after(k)
            if s[k] == ":":
                while k < len(s.tokens) and s[k] not in ("=>", ";", "="):
                    k = s.after(k)
        elif _word(s[k]):
            k += 1
        if s[k] != "=>":
            return None
        k += 1
        if s[k] == "{" and k in s.pair:
            return Found(t, "function", i, s.pair[k], k)
        last = k
        while k < len(s.tokens) and s[k] not in (";", ",", "}", ")"):
            last = s.after(k) - 1
            k = last + 1
            if k < len(s.tokens) and s.tokens[k].line > s.tokens[last].line and s[k] not in (".", "?.", "?", ":", "+", "-", "*", "&", "|", "=") and s[last] not in ("=>", "=", "+", "?", ":", "(", "&", "|"):
                break
        return Found(t, "function", i, last)
    return None


def _js_body(s: Source, k: int) -> int:
    """The brace of a function's body behind its parameters and return type, or -1."""
    if s[k] == ":":
        k += 1
        while k < len(s.tokens) and s[k] != ";":
            if s[k] == "{" and not (_word(s[k - 1]) or s[k - 1] in (">", "]", "}", ")", "''")):
                k = s.after(k)  # an object type
            elif s[k] == "{":
                break
            elif s[k] == "<":
                k = max(s.angles(k), k + 1)
            else:
                k = s.after(k)
    return k if s[k] == "{" and k in s.pair else -1


def _chain_call(words: frozenset[str], links: tuple[str, ...]) -> Callable[[Source, int], Call | None]:
    """Calls whose callee is the whole expression before the bracket."""

    def call(s: Source, i: int) -> Call | None:
        k = i + 1
        if s[k] == "::" and s[k + 1] == "<":
            k = s.angles(k + 1)
        elif s[k] == "<":
            k = s.angles(k)
        if s[k] == "?." and s[k + 1] == "(":
            k += 1
        if s[k] != "(" or s[i] in words:
            return None
        start = i
        while s[start - 1] in links:
            if (k2 := _primary(s, start - 2)) is None:
                break
            start = s.starts.get(k2, k2)
        s.starts[i] = start
        if s[start - 1] in ("new", "function", "fn", "func", "@", "#"):
            return None
        if s[start - 1] == "*" and s[start - 2] == "function":
            return None
        end = s.tokens[k - 1]
        end_at = end.at + len(end.text)
        return Call(s.text[max(s.tokens[start].at, end_at - MOST_NAME) : end_at].removesuffix("?."), start, None, start == i)

    return call


def _js_member(s: Source, i: int, in_class: bool) -> bool:
    """Whether a name with a bracket is a method of a class or an object."""
    if s[i + 1] != "(" or i + 1 not in s.pair or s[i - 1] in (".", "?.", "new"):
        return False
    behind = s[s.pair[i + 1] + 1]
    return behind == "{" or in_class and behind in (":", ";", "{") and s[i - 1] in ("{", "}", ";", "async", "get", "set", "static", "public", "private", "protected", "readonly", "override", "abstract", "*", "#")


# ---- Rust ------------------------------------------------------------------------------------------------------------

_RUST_WORDS = frozenset("if for while match loop return fn in as let else move where impl unsafe".split())
_RUST_BEFORE = frozenset("pub async const unsafe extern default ''".split())


def _rust(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t not in ("fn", "struct", "trait", "mod", "impl") or (t != "impl" and not _word(s[i + 1])):
        return None
    if t == "impl" and s[i - 1] not in ("", "}", ";", "{", "]", "unsafe", "default"):
        return None  # a type, not an item
    first = i
    while s[first - 1] in _RUST_BEFORE or (s[first - 1] == ")" and s[s.pair.get(first - 1, 0) - 1] == "pub"):
        first = s.pair[first - 1] if s[first - 1] == ")" else first - 1
    k = i + 1 if t == "impl" else i + 2
    while k < len(s.tokens) and s[k] not in ("{", ";"):
        k = s.after(k)
    if k >= len(s.tokens) or (s[k] == "{" and k not in s.pair):
        return None
    last = s.pair[k] if s[k] == "{" else k
    body = k if s[k] == "{" else -1
    if t == "fn":
        return Found(s[i + 1], "method" if any(f.name.startswith("impl") for f in scope) else "function", first, last, body) if body >= 0 else None
    if t == "impl":
        if body < 0:
            return None
        a = s.angles(i + 1) if s[i + 1] == "<" else i + 1
        b, depth = a, 0
        for j in range(a, body):
            depth += (s[j] == "<") - (s[j] == ">")
            if s[j] == "for" and not depth and s[j + 1] != "<":
                a = j + 1
            elif s[j] == "where" and not depth:
                break
            b = j
        name = "impl_" + s.text[s.tokens[a].at : s.tokens[b].at + len(s[b])]
        return Found(name, "impl", first, last, body, True)
    return Found(s[i + 1], {"mod": "module"}.get(t, t), first, last, body, True, opens=t != "struct")


# ---- Go --------------------------------------------------------------------------------------------------------------

_GO_WORDS = frozenset("if for switch select return func go defer range case else type struct interface map chan".split())


def _go(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t == "func" and not scope:
        k, kind = i + 1, "function"
        if s[k] == "(":
            k, kind = s.after(k), "method"
        if not _word(s[k]):
            return None
        name = s[k]
        k += 1
        if s[k] == "[":
            k = s.after(k)
        if s[k] != "(":
            return None
        k = s.after(k)
        line = s.tokens[k - 1].line
        while k < len(s.tokens) and s[k] != "{" and s.tokens[k].line == line:  # results
            if s[k] in ("interface", "struct") and s[k + 1] == "{":
                k += 1
            k = s.after(k)
            line = s.tokens[k - 1].line
        if s[k] == "{" and k in s.pair and s.tokens[k].line == line:
            return Found(name, kind, i, s.pair[k], k)
        return Found(name, kind, i, k - 1)
    spec = _word(t) and t not in _GO_WORDS and (s[i - 1] == "type" or _in_type_group(s, i))
    if spec and s[i + 1] not in ("=", "", ")"):
        k = i + 1
        if s[k] == "[" and _word(s[k + 1]) and s[s.after(k)] not in ("]",) and s[k + 2] != "]":  # type parameters
            k = s.after(k)
        last = k
        while k < len(s.tokens) and s.tokens[k].line == s.tokens[last].line and s[k] not in (";", ")"):
            last = s.after(k) - 1
            k = last + 1
        return Found(t, "struct", i, last, opens=False)
    return None


def _in_type_group(s: Source, i: int) -> bool:
    """Whether a token begins a line right inside ``type ( ... )``."""
    first = s[i - 1] in ("(", ";") or s.tokens[i - 1].line < s.tokens[i].line
    return first and s[s.inside[i]] == "(" and s[s.inside[i] - 1] == "type"


# ---- Java ------------------------------------------------------------------------------------------------------------

_JAVA_WORDS = frozenset("if for while switch catch return new throw else do case synchronized try assert super this instanceof yield".split())


def _java(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t in ("class", "interface", "enum", "record") and s[i - 1] != "." and _word(s[i + 1]):
        if t == "record" and s[i + 2] not in ("(", "<"):
            return None
        k = i + 2
        while k < len(s.tokens) and s[k] not in ("{", ";"):
            k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
        if s[k] != "{" or k not in s.pair:
            return None
        named = t in ("class", "interface") and s[i - 1] != "@"  # the others only hold declarations
        return Found(s[i + 1] if named else "", t, _back_to(s, i, _CPP_STOPS), s.pair[k], k, True, opens=named, type_name=s[i + 1])
    if not (declares and _word(t) and t not in _JAVA_WORDS and s[i + 1] == "(" and i + 1 in s.pair):
        return None
    before = s[i - 1]
    typed = (_word(before) and before not in _JAVA_WORDS | {"public", "private", "protected"}) or before in (">", "]")
    builds = t == holder and before in ("public", "private", "protected", ";", "{", "}", ">", ")")
    if not typed and not builds or before in ("class", "interface", "enum", "record"):
        return None
    k = s.pair[i + 1] + 1
    while s[k] == "[":
        k = s.after(k)
    if s[k] in ("throws", "default"):
        while k < len(s.tokens) and s[k] not in ("{", ";"):
            k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
    first = _back_to(s, i, _CPP_STOPS)
    if s[k] == "{" and k in s.pair:
        return Found(t, "method", first, s.pair[k], k)
    return Found(t, "method", first, k) if s[k] == ";" else None


def _java_member(s: Source, i: int, in_class: bool) -> bool:
    """Whether a name with a bracket is a constant of an enum or a constructor."""
    return in_class and s[i - 1] in ("{", "}", ",", ";", "public", "private", "protected")


def _java_call(s: Source, i: int) -> Call | None:
    if s[i + 1] != "(" or s[i] in _JAVA_WORDS or s[i - 1] in ("new", "@"):
        return None
    start = i
    while s[start - 1] in (".", "::"):
        if s[start - 1] == "." and s[start - 2] == ">":  # x.<T>f(): type arguments
            break
        if (k := _primary(s, start - 2)) is None:
            break
        start = s.starts.get(k, k)
    s.starts[i] = start
    if s[start - 1] in ("new", "@"):
        if start == i or not any(s[k] == "(" for k in range(start, min(i, start + 40))):
            return None  # new a.b.C(), @a.b.C()
        start -= 1
    return Call(s[i], start)


# ---- C# --------------------------------------------------------------------------------------------------------------

_CS_WORDS = frozenset("if for foreach while switch catch return new throw else do case lock using fixed sizeof typeof default checked unchecked when where await yield stackalloc base this get set in is as out ref not and or".split())
_CS_TYPES = {"class": "class", "record": "class", "struct": "struct", "interface": "interface", "enum": "enum", "namespace": "module"}


def _csharp(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    if t in _CS_TYPES and _word(s[i + 1]) and s[i - 1] not in (":", ",", ".", "record"):  # behind a colon it is a constraint
        k = i + 2 if t == "record" and s[i + 1] in ("class", "struct") else i + 1
        name, k = s[k], k + 1
        while t == "namespace" and s[k] == ".":
            name, k = f"{name}.{s[k + 1]}", k + 2
        while k < len(s.tokens) and s[k] not in ("{", ";"):
            k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
        first = i if t == "namespace" else _back_to(s, i, _CPP_STOPS)
        if s[k] == "{" and k in s.pair:
            return Found(name, _CS_TYPES[t], first, s.pair[k], k, t != "enum", type_name=name)
        return Found(name, "class", first, k) if t == "record" and s[k] == ";" else None
    if not (declares and _word(t) and t not in _CS_WORDS):
        return None
    k = s.angles(i + 1) if s[i + 1] == "<" else i + 1
    if s[k] != "(" or k not in s.pair:
        return None
    before = s[i - 1]
    typed = (_word(before) and before not in _CS_WORDS | {"public", "private", "protected", "internal", "static", "operator"}) or before in (">", "]", "?", ")")
    builds = t == holder and before in ("public", "private", "protected", "internal", "static", ";", "{", "}", "]")
    if not typed and not builds or before in _CS_TYPES or s[s.inside[i]] == "[":
        return None
    k = s.pair[k] + 1
    while k < len(s.tokens) and s[k] not in ("{", ";", "=>", "=", "}"):  # constraints, a call of another constructor
        k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
    first = _back_to(s, i, _CPP_STOPS)
    kind = "method" if scope else "function"
    if s[k] == "{" and k in s.pair:
        return Found(t, kind, first, s.pair[k], k)
    body = k
    while s[k] == "=>" or (body != k and k < len(s.tokens) and s[k] not in (";", "}")):
        k = s.after(k)
    return Found(t, kind, first, k) if s[k] == ";" else None


def _cs_member(s: Source, i: int, in_class: bool) -> bool:
    """Whether a name with a bracket is an attribute."""
    return in_class and s[s.inside[i]] == "["


# ---- Kotlin and Swift ------------------------------------------------------------------------------------------------

_KOTLIN_WORDS = frozenset("if for while when catch return throw else do try is as in fun constructor init get set by where super this typeof".split())
_KOTLIN_BEFORE = frozenset("public private protected internal open abstract final override suspend inline noinline crossinline operator infix tailrec external data sealed inner enum annotation const lateinit expect actual value companion".split())
_SWIFT_WORDS = frozenset("if for while switch catch return throw else do guard repeat func deinit subscript get set willSet didSet case where is as in try await some any".split())
_SWIFT_BEFORE = frozenset("public private fileprivate internal open final static class override mutating nonmutating required convenience lazy weak dynamic indirect prefix postfix infix async nonisolated isolated".split())


def _modifiers(s: Source, i: int, words: frozenset[str]) -> int:
    """The first of the modifiers and annotations before a keyword."""
    while i > 0:
        if s[i - 1] in words or (_word(s[i - 1]) and s[i - 2] == "@"):
            i -= 2 if s[i - 2] == "@" else 1
        elif s[i - 1] == ")" and i - 1 in s.pair and (s[s.pair[i - 1] - 1] in words or s[s.pair[i - 1] - 2] == "@"):
            i = s.pair[i - 1]
        else:
            break
    return i


def _line_end(s: Source, k: int, stops: tuple[str, ...] = (";", "}", ")")) -> int:
    """The last token of an expression that begins at ``k``: where its line ends, unless a sign carries it on."""
    last = k
    while k < len(s.tokens) and s[k] not in stops:
        last = s.after(k) - 1
        k = last + 1
        if k < len(s.tokens) and s.tokens[k].line > s.tokens[last].line and s[k] not in (".", "?.", "?", ":", "+", "-", "*", "&", "|", "else") and s[last] not in ("=", "+", "-", "*", ":", ",", "&", "|", "->", "else"):
            break
    return last


def _type_header(s: Source, k: int) -> tuple[int, int]:
    """(body, last) of a type behind its name: parameters, what it extends, and the block if there is one."""
    last = k - 1
    while k < len(s.tokens) and s[k] != "{":
        if s.tokens[k].line > s.tokens[last].line and s[last] not in (":", ",", "where") and s[k] not in (":", "where", ","):
            return -1, last
        if not (_word(s[k]) or s[k] in ("(", "[", "<", ":", ",", ".", "?", "&", "@", "==", "=")):
            return -1, last
        n = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
        last, k = n - 1, n
    return (k, s.pair[k]) if s[k] == "{" and k in s.pair else (-1, last)


def _kotlin(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    kind = "method" if scope else "function"
    if t == "fun":
        k = i + 1
        if s[k] == "interface":
            return None
        if s[k] == "<":
            k = s.angles(k)
        while _word(s[k]):  # what it extends
            n = s.angles(k + 1) if s[k + 1] == "<" else k + 1
            n += s[n] == "?"
            if s[n] not in (".", "?."):
                break
            k = n + 1
        if not _word(s[k]) or s[k + 1] != "(" or k + 1 not in s.pair:
            return None
        name, last = s[k], s.pair[k + 1]
        k, first = last + 1, _modifiers(s, i, _KOTLIN_BEFORE)
        if s[k] == ":":
            k += 1
            while k < len(s.tokens) and s[k] not in ("{", "=", "}", ";") and (s.tokens[k].line == s.tokens[k - 1].line or s[k] == "where" or s[k - 1] in (":", "->")):
                last = (max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)) - 1
                k = last + 1
        if s[k] == "{" and k in s.pair:
            return Found(name, kind, first, s.pair[k], k)
        return Found(name, kind, first, _line_end(s, k + 1) if s[k] == "=" else last)
    if t in ("class", "interface", "object") and _word(s[i + 1]) and s[i - 1] not in (":", ".") and not (t == "object" and s[i - 1] == "companion"):
        first = _modifiers(s, i, _KOTLIN_BEFORE | {"fun"})
        body, last = _type_header(s, i + 2)
        kinds = {"interface": "interface"}
        enum = any(s[k] == "enum" for k in range(first, i))
        return Found(s[i + 1], "enum" if enum else kinds.get(t, "class"), first, last, body, True)
    return None


def _swift(s: Source, i: int, declares: bool, scope: list[Found], holder: str) -> Found | None:
    t = s[i]
    kind = "method" if scope else "function"
    if (t == "func" and _word(s[i + 1])) or (t == "init" and declares and s[i - 1] != "."):
        name, k = (s[i + 1], i + 2) if t == "func" else ("init", i + 1)
        k += s[k] in ("?", "!")
        if s[k] == "<":
            k = s.angles(k)
        if s[k] != "(" or k not in s.pair:
            return None
        k = s.pair[k] + 1
        while k < len(s.tokens) and (_word(s[k]) and s[k] not in _SWIFT_BEFORE - {"async"} | {"func", "var", "let", "init"} or s[k] in ("->", "<", "[", "(", ".", "?", "!", ":", ",", "&", "@", "=")):
            k = max(s.angles(k), k + 1) if s[k] == "<" else s.after(k)
        return Found(name, kind, _modifiers(s, i, _SWIFT_BEFORE), s.pair[k], k) if s[k] == "{" and k in s.pair else None
    if t in ("class", "struct", "enum", "extension", "protocol", "actor") and _word(s[i + 1]) and s[i + 1] not in ("func", "var", "let", "subscript") and s[i - 1] not in (".", ":", ","):
        name, k = s[i + 1], i + 2
        while s[k] == ".":
            name, k = f"{name}.{s[k + 1]}", k + 2
        body, last = _type_header(s, k)
        kinds = {"protocol": "interface", "actor": "class"}
        return Found(name, kinds.get(t, t), _modifiers(s, i, _SWIFT_BEFORE), last, body, True) if body >= 0 else None
    return None


def _swift_member(s: Source, i: int, in_class: bool) -> bool:
    """Whether a name with a bracket is a case of an enum."""
    return in_class and s[i - 1] in ("case", ",")


class Rules(NamedTuple):
    definition: Callable[[Source, int, bool, list[Found], str], Found | None]
    call: Callable[[Source, int], Call | None]


RULES = {
    "cpp": Rules(_cpp, _cpp_call),
    "javascript": Rules(_js, _chain_call(_JS_WORDS, (".", "?."))),
    "rust": Rules(_rust, _chain_call(_RUST_WORDS, (".", "::"))),
    "go": Rules(_go, _chain_call(_GO_WORDS, (".",))),
    "java": Rules(_java, _java_call),
    "kotlin": Rules(_kotlin, _chain_call(_KOTLIN_WORDS, (".", "?.", "::"))),
    "swift": Rules(_swift, _chain_call(_SWIFT_WORDS, (".", "?."))),
    "csharp": Rules(_csharp, _chain_call(_CS_WORDS, (".", "?.", "::"))),
}
AS = {"c": "cpp", "cpp": "cpp", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "svelte": "javascript", "rust": "rust", "go": "go", "java": "java", "csharp": "csharp", "kotlin": "kotlin", "swift": "swift"}


def _include_of(call: Call, includes: list[str]) -> str | None:
    """The include whose file is named like the callee's qualifier, or like a callee that stands alone."""
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for wanted in (call.qualifier, call.to if call.plain else None):
        if wanted is not None and (found := next((p for p in includes if stem(p) == wanted), None)):
            return found
    return None


def read(text: str, lang: str) -> tuple[list[tuple[Found, list[Found], int, int]], list[tuple[Call, list[Found], int, str | None]]]:
    """Definitions (with those around them, first and last line) and calls inside definitions (with line and include)."""
    lang = AS[lang]
    s, rules = lex(text, lang), RULES[lang]
    found, calls = [], []
    scope: list[Found] = []
    blocks: list[tuple[int, bool, str]] = []  # where the open ones end, whether they hold declarations, and of which type
    declaring: dict[int, tuple[bool, str]] = {}
    upto = calls_from = -1
    names: set[int] = set()
    member = {"javascript": _js_member, "java": _java_member, "csharp": _cs_member, "swift": _swift_member}.get(lang)
    i = 0
    while i < len(s.tokens):
        while scope and scope[-1].last < i:
            scope.pop()
        while blocks and blocks[-1][0] < i:
            blocks.pop()
        t = s[i]
        if t == "{" and i in s.pair:
            linkage = lang == "cpp" and s[i - 1] == "''" and s[i - 2] == "extern"
            anonymous = lang == "java" and s[i - 1] == ")" and _is_new(s, s.pair.get(i - 1, i))
            blocks.append((s.pair[i], *declaring.get(i, (linkage or anonymous, ""))))
        elif (lang == "rust" and ((t == "!" and s[i + 1] in ("(", "[", "{") and _word(s[i - 1])) or (t == "#" and s[i + 1] in ("[", "!")))) or (lang in ("java", "kotlin", "swift") and t == "@" and s[i + 1] != "interface"):
            k = i + 1 if t != "#" or s[i + 1] == "[" else i + 2  # macros and attributes hold tokens, not code
            if t == "@":  # a dotted name
                k += 1
                while s[k] == "." and _word(s[k + 1]):
                    k += 2
            i = s.after(k) if s[k] in ("(", "[", "{") else k
            continue
        elif _word(t):
            _, holds, holder = blocks[-1] if blocks else (0, True, "")
            if i > upto and (f := rules.definition(s, i, holds, scope, holder)):
                last = s.tokens[min(f.last, len(s.tokens) - 1)]
                if f.name:
                    found.append((f, list(scope), s.tokens[f.first].line, last.line))
                if f.opens:
                    scope.append(f)
                if f.body >= 0:
                    declaring[f.body] = f.declares, f.type_name or f.name
                    if lang != "javascript":  # parameters, initialisers and what a type extends call nothing
                        calls_from = f.body
                    if f.kind in ("function", "method") and lang in ("cpp", "java", "csharp"):
                        upto = f.body
                elif f.kind == "class":
                    calls_from = f.last
                names.update(range(f.first, i + 2))
            elif scope and i > calls_from and i not in names and not (member(s, i, holds and bool(blocks)) if member else False) and (c := rules.call(s, i)):
                calls.append((c, list(scope), s.tokens[c.first].line, _include_of(c, s.includes) if s.includes else None))
        i += 1
    return found, calls


def _is_new(s: Source, k: int) -> bool:
    """Whether the bracket at ``k`` belongs to ``new Type``."""
    k -= 1
    if s[k] == ">":
        k = s.angles_back(k)
    while _word(s[k]) and s[k - 1] == ".":
        k -= 2
    return _word(s[k]) and s[k - 1] == "new"
