"""Path classifiers as Column expressions.  All accept either separator; null gives null unless said otherwise."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are indexed, and names without an extension that count as one.
INDEXED_EXTENSIONS = (
    "py js ts tsx jsx rs go java cs cpp c h hpp cc cxx hxx hh rb php swift kt kts scala ex exs clj hs ml lua luau r sh bash zsh fish ps1 "
    "yaml yml toml json xml html css scss sass less sql proto graphql md txt dockerfile tf hcl vue svelte astro mdx prisma dart zig nim sol "
    "elm jl erl hrl nix m mm groovy gradle pl pm rst wgsl glsl hlsl pas pp dpr lpr dpk liquid"
).split()
BARE_NAMES = ["dockerfile", "makefile", "justfile"]
#: Directories that are never walked.
SKIPPED_DIRS = ["node_modules", "target", "build", "dist", "__pycache__", "vendor"]
#: Extensions that count as documentation.
DOCS_EXTENSIONS = ["md", "mdx", "txt", "rst"]
#: Language by extension (case-sensitive).
LANGUAGES = {
    "python": "py",
    "javascript": "js jsx mjs cjs",
    "typescript": "ts",
    "tsx": "tsx",
    "rust": "rs",
    "go": "go",
    "java": "java",
    "c": "c",
    "cpp": "cpp cc cxx h hpp hxx hh",
    "csharp": "cs",
    "php": "php",
    "ruby": "rb",
    "objectivec": "m mm",
    "swift": "swift",
    "kotlin": "kt kts",
    "dart": "dart",
    "lua": "lua",
    "luau": "luau",
    "svelte": "svelte",
    "pascal": "pas pp dpr lpr dpk",
    "liquid": "liquid",
}
#: Other names of languages in filters.
LANGUAGE_ALIASES = {
    "ts": ["typescript", "tsx"],
    "typescript": ["typescript", "tsx"],
    "js": ["javascript"],
    "py": ["python"],
    "rs": ["rust"],
    "golang": ["go"],
    "c++": ["cpp"],
    "cxx": ["cpp"],
    "cs": ["csharp"],
    "c#": ["csharp"],
    "rb": ["ruby"],
    "kt": ["kotlin"],
}
#: Paths of files that tools write.  Open on the left, so "ent/x.go" is also found in "client/x.go".
GENERATED = [
    r"\.pb\.go$",
    r"_grpc\.pb\.go$",
    r"_mock\.go$",
    r"mock_[^/\\]+\.go$",
    r"_string\.go$",
    r"_gen\.go$",
    r"wire_gen\.go$",
    r"ent/[^/\\]+\.go$",
    r"zzgenerated[^/\\]*\.go$",
    r"zz_generated[^/\\]*\.go$",
    r"\.generated\.(ts|js|tsx|jsx)$",
    r"\.g\.(ts|js)$",
    r"__generated__/",
    r"generated/[^/\\]+\.(ts|js|tsx|jsx)$",
    r"dist/[^/\\]+\.(js|mjs|cjs)$",
    r"\.next/",
    r"\.nuxt/",
    r"_pb2\.py$",
    r"_pb2_grpc\.py$",
    r"_generated\.py$",
    r"\.pb\.(h|cc|cpp)$",
    r"\.grpc\.pb\.(h|cc|cpp)$",
    r"moc_[^/\\]+\.cpp$",
    r"ui_[^/\\]+\.h$",
    r"\.tab\.(c|h)$",
    r"lex\.yy\.c$",
    r"\.Designer\.cs$",
    r"\.g\.cs$",
    r"\.generated\.cs$",
    r"Migrations/[^/\\]+\.cs$",
    r"generated-sources/",
    r"target/generated/",
    r"build/generated/",
    r"\.generated\.swift$",
    r"Generated/[^/\\]+\.swift$",
    r"\.g\.dart$",
    r"\.freezed\.dart$",
    r"target/[^/\\]+/build/",
    r"vendor/",
    r"node_modules/",
    r"__pycache__/",
]
#: Directories that hold tests, and how test files are named, by extension (on the lower-cased stem).
TEST_DIRS = ["test", "tests", "__tests__", "__mocks__", "spec"]
TEST_STEMS = {
    "go": "_test$",
    "py": "^test_|^conftest$|_test$",
    "rs": "^tests$|_tests$|_test$",
    "js jsx mjs cjs ts tsx mts cts svelte": r"\.test$|\.spec$",
    "rb": "_spec$|_test$",
    "dart": "_test$",
    "lua luau": r"_spec$|_test$|\.spec$|\.test$",
    "c cc cpp cxx": "^test_|_test$|_unittest$|_unittests$|_browsertest$",
}
CAMEL_TESTS = ["java", "kt", "kts", "scala", "cs", "php", "swift", "m", "mm"]


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def parent_dir(path: Column) -> Column:
    """What stands before the last separator; empty without one."""
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The extension as it is; empty for names without one, dot files and names that end in a dot."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def ext_key(path: Column) -> Column:
    """Lower-case extension, or the whole lower-case name where there is none."""
    own = extension(path)
    return F.lower(F.when(own == "", basename(path)).otherwise(own))


def indexable(path: Column, more: Iterable[str] = ()) -> Column:
    named = F.lower(basename(path)).isin(BARE_NAMES)
    return F.lower(extension(path)).isin([*INDEXED_EXTENSIONS, *(e.strip().lstrip(".").lower() for e in more)]) | named


def _dirs(rel: Column) -> Column:
    parts = F.split(slashed(rel), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def under_skipped_dir(rel: Column) -> Column:
    return F.exists(_dirs(rel), lambda d: d.isin(SKIPPED_DIRS))


def under_hidden_dir(rel: Column) -> Column:
    return F.exists(_dirs(rel), lambda d: d.startswith(".") & ~d.isin(".", ".."))


def language(path: Column) -> Column:
    """The language of a path, "other" if none is known."""
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("other"))


def is_generated(path: Column) -> Column:
    return slashed(path).rlike("|".join(f"(?:{p})" for p in GENERATED))


def is_test_path(rel: Column) -> Column:
    """Whether a repository-relative path is a test by its directories or its name."""
    dirs = F.exists(_dirs(rel), lambda d: F.lower(d).isin(TEST_DIRS) | F.lower(d).endswith(".tests"))
    name = F.regexp_extract(slashed(rel), r"([^/]+)/*$", 1)
    stem, ext = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    named = F.lit(False)
    for exts, pattern in TEST_STEMS.items():
        named = named | (ext.isin(exts.split()) & F.lower(stem).rlike(pattern))
    camel = stem.rlike("Tests?$") | (~stem.rlike("[A-Z]") & stem.rlike("tests?$"))
    return dirs | named | (ext.isin(CAMEL_TESTS) & camel)


def in_repo(file: Column, root: Column | str) -> Column:
    """Whether a file lies under a root; /foo isn't a root of /foobar."""
    r = F.rtrim(slashed(F.lit(root) if isinstance(root, str) else root), F.lit("/"))
    f = slashed(file)
    return (f == r) | f.startswith(F.concat(r, F.lit("/")))


def repo_relative(file: Column, roots: Iterable[str]) -> Column:
    """The path under the longest root that holds it, compared without ASCII case; without one, the file's name."""
    f, out = slashed(file), None
    for root in sorted({r.replace("\\", "/").rstrip("/") for r in roots}, key=lambda r: (-len(r), r)):
        hit = F.lower(f).startswith(root.lower() + "/")
        rest = f.substr(F.lit(len(root) + 2), F.length(f))
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return basename(file) if out is None else out.otherwise(basename(file))


def ancestors(path: Column) -> Column:
    """All directories above a path, longest first."""
    parts = F.split(slashed(path), "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def glob_prefix(glob: str) -> str | None:
    """The directory above which a glob can match nothing: its parts before the first with a wildcard."""
    parts = glob.split("/")
    fixed = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    return "/".join(parts[:fixed]) or None


def repo_id(repo: str) -> str:
    """A repository's path as an id for addresses: URL-safe base 64 without padding."""
    return base64.urlsafe_b64encode(repo.encode()).decode().rstrip("=")


def repo_of(id_: str) -> str:
    """The path that an id stands for, with slashes and without one at its end; ValueError if it is none."""
    try:
        raw = base64.b64decode(id_ + "=" * (-len(id_) % 4), altchars=b"-_", validate=True)
        path = raw.decode()
    except (binascii.Error, UnicodeDecodeError) as e:
        raise ValueError(f"not an id of a repository: {id_!r}") from e
    return path.replace(chr(92), "/").rstrip("/")


def file_key(root: str, rel: str) -> str:
    """The key under which a file of a repository is stored."""
    return f"{root.replace(chr(92), '/').rstrip('/')}/{rel.replace(chr(92), '/').lstrip('/')}"
