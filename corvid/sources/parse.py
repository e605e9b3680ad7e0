"""Symbols, raw call edges and chunks of source files.

Python is read by its own parser; C, C++, C#, JavaScript, TypeScript, Rust, Go,
Java, Kotlin and Swift from tokens and matched brackets (``syntax``).  Other languages are read by
family: text and comments are blanked, definitions found by the language's
profile, and their extent by braces, by the matching ``end``, or by indentation.
That sees what a full grammar sees in ordinary code; macros and exotic syntax it
doesn't.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.paths import LANGUAGES
from corvid.sources import chunker, syntax
from corvid.sources.frameworks import framework_edges

_BY_EXTENSION = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}


@dataclass
class Symbol:
    name: str
    kind: str
    fqn: str
    parent: str | None
    first: int
    last: int


@dataclass
class Edge:
    from_name: str
    from_fqn: str
    to_name: str
    line: int
    import_path: str | None = None


def language_of(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return _BY_EXTENSION.get(ext, "other") if dot and stem else "other"


def _python_tree(source: str) -> tuple[str, ast.AST | None]:
    """The tree of what can be read: a statement at the margin that holds an error is blanked, with its block, and the rest read again."""
    lines = source.split("\n")
    for _ in range(20):
        try:
            return "\n".join(lines), ast.parse("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            margin = lambda k: bool(lines[k]) and not lines[k][0].isspace() and lines[k][0] not in ")]}#"
            first = next((k for k in range(at, -1, -1) if margin(k)), 0)
            last = next((k for k in range(max(at, first) + 1, len(lines)) if margin(k)), len(lines))
            if not any(lines[first:last]):
                return source, None
            lines[first:last] = [""] * (last - first)
        except (ValueError, RecursionError, MemoryError):
            return source, None
    return source, None


def parse_python(file: str, source: str) -> tuple[list[Symbol], list[Edge]]:
    """A definition in any scope is a method; a call's name is the whole callee; calls outside definitions are left out."""
    source, tree = _python_tree(source)
    if tree is None:
        return [], []
    symbols: list[Symbol] = []
    edges: list[Edge] = []
    todo: list[tuple[ast.AST, tuple[str, ...], str | None]] = [(tree, (), None)]
    while todo:  # a stack of its own: deep nesting can't exhaust Python's
        node, scope, parent = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            fqn = "::".join([file, *scope, node.name])
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
            symbols.append(Symbol(node.name, kind, fqn, parent, node.lineno, node.end_lineno or node.lineno))
            scope, parent = (*scope, node.name), fqn
        elif isinstance(node, ast.Call) and scope:
            callee = ast.get_source_segment(source, node.func)
            if callee:
                edges.append(Edge(scope[-1], parent or file, callee, node.lineno))
        todo += [(c, scope, parent) for c in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, edges


#: Of each language: how comments and text look, and its definitions as kind -> pattern with the name in a group.
_C_LIKE = r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_ID = r"([A-Za-z_$][\w$]*)"
_TYPES = r"[\w<>\[\],.?&*:\s]+?[\s&*]"
_METHOD = rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|partial|extern|inline|constexpr|const|unsafe|new)\s+)*(?:{_TYPES})?{_ID}\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)[^;{{}}=]*\{{"
PROFILES: dict[str, dict] = {
    "php": {"defs": [("class", rf"\bclass\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("trait", rf"\btrait\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("function", rf"\bfunction\s+&?{_ID}")], "text": _C_LIKE + r"|#[^\n]*", "leaf": True},
    "ruby": {"defs": [("class", r"^[ \t]*class\s+([A-Z][\w:]*)"), ("module", r"^[ \t]*module\s+([A-Z][\w:]*)"), ("method", r"^[ \t]*def\s+(?:self\.)?([\w?!=]+)")], "text": r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "leaf": True, "ends": "indent"},
    "objectivec": {"defs": [("interface", rf"@interface\s+{_ID}"), ("class", rf"@implementation\s+{_ID}"), ("method", rf"^[-+]\s*\([^)]*\)\s*{_ID}")], "text": _C_LIKE, "leaf": True},
    "dart": {"defs": [("class", rf"\b(?:class|mixin)\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("method", _METHOD)], "text": _C_LIKE, "leaf": True},
    "lua": {"defs": [("struct", rf"^(?:export\s+)?type\s+{_ID}\s*="), ("function", r"\bfunction\s+(?:[\w.]+[.:])?(\w+)\s*\(")], "text": r"--\[\[.*?\]\]|--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "ends": "indent"},
    "pascal": {"defs": [("class", r"^\s*(\w+)\s*=\s*class\b"), ("interface", r"^\s*(\w+)\s*=\s*interface\b"), ("function", r"^\s*(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?(\w+)")], "text": r"//[^\n]*|\{[^}]*\}|\(\*.*?\*\)|'(?:[^'\n])*'", "ends": "indent"},
    "liquid": {"defs": [("function", r"\{%-?\s*(?:render|include|section)\s+['\"]([\w/-]+)['\"]")], "text": r"\{%-?\s*comment\s*-?%\}.*?\{%-?\s*endcomment\s*-?%\}", "ends": "line", "calls": r"\|\s*(\w+)"},
}
PROFILES["luau"] = PROFILES["lua"]
#: Words before a bracket that call nothing.
_NO_CALL = frozenset("if for while switch catch return function sizeof typeof await yield new throw else do and or not in is elif def fn func fun match when guard unless until case with super using lock foreach defer go select".split())
_NO_NAME = frozenset("if for while switch catch return function else do".split())
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*\s*(?:\.|::|->|\?\.)\s*)*[A-Za-z_$~][\w$]*[?!]?)\s*(?:<[\w\s,.<>]*>)?\(")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _brace_end(code: str, at: int) -> int:
    """Where the block that opens after ``at`` closes; the end of the statement without a block."""
    depth, i = 0, at
    for m in re.compile(r"[{};]").finditer(code, at):
        c, i = m[0], m.start()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i
        elif depth == 0:
            return i
    return max(i, at)


def _indent_end(lines: list[str], first: int) -> int:
    """The last line (from 0) of a block that ends where the indentation returns; a closing word on that line belongs to it."""
    width = len(lines[first]) - len(lines[first].lstrip())
    for i in range(first + 1, len(lines)):
        body = lines[i].strip()
        if body and len(lines[i]) - len(lines[i].lstrip()) <= width:
            return i if re.match(r"end\b|\}", body) else i - 1
    return len(lines) - 1


def parse_by_profile(file: str, source: str, lang: str) -> tuple[list[Symbol], list[Edge]]:
    profile = PROFILES.get(lang)
    if not profile:
        return [], []
    code = re.compile(profile["text"], re.S).sub(_blank, source) if lang != "liquid" else source
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    line_of = lambda i: bisect_right(starts, i)
    lines = code.split("\n")
    found: dict[int, tuple[str, str, int, int]] = {}
    for kind, pattern in profile["defs"]:
        for m in re.compile(pattern, re.M).finditer(code):
            name = m[1]
            if m.start(1) in found or name in _NO_NAME:
                continue
            first = line_of(m.start(1))
            ends = profile.get("ends", "brace")
            if ends == "brace":
                last = line_of(_brace_end(code, m.end() - 1 if code[m.end() - 1] == "{" else m.end()))
            else:
                last = _indent_end(lines, first - 1) + 1 if ends == "indent" else first
            found[m.start(1)] = (name, kind, first, last)
    symbols: list[Symbol] = []
    stack: list[Symbol] = []
    for _, (name, kind, first, last) in sorted(found.items()):
        while stack and stack[-1].last < first:
            stack.pop()
        above = stack[-1] if stack else None
        if kind in ("function", "method", "arrow"):
            kind = "method" if above else "function"
        fqn = f"{above.fqn}::{name}" if above else f"{file}::{name}"
        s = Symbol(name, kind, fqn, above.fqn if above else None, first, last)
        symbols.append(s)
        stack.append(s)
    edges: list[Edge] = []
    call = re.compile(profile["calls"]) if "calls" in profile else _CALL
    for m in call.finditer(code):
        name = re.sub(r"\s+", "", m[1])
        leaf = re.split(r"\.|::|->", name)[-1]
        if name in _NO_CALL or m.start(1) + len(m[1]) - len(leaf) in found:
            continue
        line = line_of(m.start(1))
        inside = [s for s in symbols if s.first <= line <= s.last]
        if inside:
            by = min(reversed(inside), key=lambda s: s.last - s.first)
            edges.append(Edge(by.name, by.fqn, leaf if profile.get("leaf") else name, line))
    return symbols, edges


def _script_only(source: str) -> str:
    """A page's script in its place, blanks around it."""
    inside = [m.span(1) for m in re.finditer(r"<script[^>]*>(.*?)</script>", source, re.S)]
    out, at = [], 0
    for a, b in inside:
        out += [re.sub(r"[^\n]", " ", source[at:a]), source[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", source[at:])])


def parse_by_tokens(file: str, source: str, lang: str) -> tuple[list[Symbol], list[Edge]]:
    """Symbols and calls of a brace language.  A call belongs to the innermost definition; its name is the whole callee, in C, C++ and Java the last part."""
    found, calls = syntax.read(_script_only(source) if lang == "svelte" else source, lang)
    fqn = lambda f, around: "::".join([file, *(n for o in around if o.name for n in (*o.scope, o.name)), *f.scope, f.name])
    symbols = []
    for f, around, first, last in found:
        above = next((k for k in range(len(around) - 1, -1, -1) if around[k].name), None)
        parent = fqn(around[above], around[:above]) if above is not None else None
        symbols.append(Symbol(f.name, f.kind, fqn(f, around), parent, first, last))
    edges = []
    for c, around, line, include in calls:
        named = [o for o in around if o.name]
        if named:
            edges.append(Edge(named[-1].name, fqn(named[-1], named[:-1]), c.to, line, include))
    return symbols, edges


def parse(file: str, source: str) -> tuple[list[Symbol], list[Edge]]:
    lang = language_of(file)
    if lang == "python":
        return parse_python(file, source)
    return parse_by_tokens(file, source, lang) if lang in syntax.AS else parse_by_profile(file, source, lang)


def enclosing(symbols: list[Symbol], first: int, last: int) -> Symbol | None:
    around = [s for s in symbols if s.first <= first and s.last >= last]
    return min(around, key=lambda s: (s.last - s.first, -s.first)) if around else None


OUTCOME = "path string, status string, kind string, fqn string, name string, symbol_kind string, parent_fqn string, line_start int, line_end int, content string, to_name string, import_path string"


def parsed(files: DataFrame, frameworks: list[str] | tuple[str, ...] = (), path: str = "path", content: str = "content") -> DataFrame:
    """Files (path, content: binary) as rows of kind symbol, edge, chunk or file; split them by kind.

    status of the file rows: ok, binary (a NUL or no UTF-8: for good), unreadable (null: to be tried again).  One file
    is read at a time; a file's rows come out together.
    """
    names = [x.split(" ")[0] for x in OUTCOME.split(", ")]
    kinds = [pa.int32() if n.startswith("line_") else pa.string() for n in names]

    def rows(file: str, raw: bytes | None) -> Iterator[dict]:
        if raw is None:
            yield {"path": file, "kind": "file", "status": "unreadable"}
            return
        try:
            source = raw.decode()
        except UnicodeDecodeError:
            source = "\0"
        if "\0" in source:
            yield {"path": file, "kind": "file", "status": "binary"}
            return
        symbols, edges = parse(file, source)
        edges = edges + [Edge(n, f, t, line, i) for n, f, t, line, i in framework_edges(file, source, symbols, frameworks)]
        lines = source.split("\n")
        units = [(s.first, s.last) for s in symbols]
        for s in symbols:
            yield {"path": file, "kind": "symbol", "fqn": s.fqn, "name": s.name, "symbol_kind": s.kind, "parent_fqn": s.parent, "line_start": s.first, "line_end": s.last}
        for e in edges:
            yield {"path": file, "kind": "edge", "fqn": e.from_fqn, "name": e.from_name, "to_name": e.to_name, "import_path": e.import_path, "line_start": e.line, "line_end": e.line}
        for a, b in chunker.around(source, units) if units else chunker.windows(source):
            text = "\n".join(lines[a - 1 : b])
            if text.strip():
                s = enclosing(symbols, a, b)
                yield {"path": file, "kind": "chunk", "content": text, "fqn": s.fqn if s else None, "line_start": a, "line_end": b}
        yield {"path": file, "kind": "file", "status": "ok"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                made = [r for f, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(f, raw)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in made], k) for n, k in zip(names, kinds)], names)

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, OUTCOME)
