"""Column builders over repo-relative POSIX paths: filters, buckets, languages.

Everything here is a built-in expression, so a filter on a path column stays inside whole-stage
codegen and plain prefix/equality tests reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.config import ConfigError
from seekspark.functions.globs import glob_to_regex

# ---- fixed values -------------------------------------------------------------------------------
TEXT_EXTENSIONS = (
    "adoc", "bash", "c", "cc", "cfg", "cjs", "conf", "cpp", "css", "csv", "cxx", "dockerfile", "feature",
    "gemspec", "go", "gql", "graphql", "h", "hpp", "htm", "html", "ini", "java", "js", "json", "jsx", "kt",
    "md", "mdx", "mjs", "plist", "prisma", "proto", "py", "rake", "rb", "rs", "rst", "scss", "sh", "sql",
    "svelte", "swift", "toml", "ts", "tsv", "tsx", "txt", "vue", "xml", "yaml", "yml", "zsh",
)
BINARY_EXTENSIONS = (
    "7z", "avi", "bin", "class", "dll", "dylib", "eot", "exe", "gif", "gz", "ico", "jar", "jpeg", "jpg",
    "lock", "mov", "mp3", "mp4", "otf", "pdf", "png", "pyc", "rar", "so", "tar", "ttf", "wasm", "webm",
    "webp", "woff", "woff2", "zip",
)
ALWAYS_INDEXED_NAMES = ("dockerfile", "gemfile", "makefile", "rakefile")
EXTENSIONLESS_NAMES = (
    "codeowners", "contributors", "dockerfile", "gemfile", "license", "makefile", "notice", "rakefile",
)
SAFETY_DIRECTORIES = (".git", "node_modules")
SAFETY_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".env", ".env.local", ".env.production")
WATCH_SKIPPED_DIRECTORIES = (
    ".cache", ".git", ".gradle", ".hg", ".next", ".nuxt", ".parcel-cache", ".svn", ".turbo", ".venv",
    "DerivedData", "Pods", "__pycache__", "bower_components", "build", "coverage", "dist", "node_modules",
    "out", "target", "vendor", "venv",
)
DOC_EXTENSIONS = ("adoc", "markdown", "md", "mdx", "rst")
CONFIG_EXTENSIONS = (
    "cfg", "conf", "hcl", "ini", "json", "jsonc", "properties", "tf", "tfvars", "toml", "yaml", "yml",
)
DOC_TEXT_NAMES = ("changelog", "contributing", "readme")
# Several names may stand for one language; suffixes carry no dot.
LANGUAGE_SUFFIXES = {
    "ruby": ("rb", "rake", "gemspec"),
    "rb": ("rb", "rake", "gemspec"),
    "javascript": ("js", "cjs", "mjs", "jsx", "vue"),
    "js": ("js", "cjs", "mjs", "jsx", "vue"),
    "typescript": ("ts", "mts", "cts", "tsx", "vue"),
    "ts": ("ts", "mts", "cts", "tsx", "vue"),
    "python": ("py", "pyi", "pyw"),
    "py": ("py", "pyi", "pyw"),
    "go": ("go",),
    "rust": ("rs",),
    "rs": ("rs",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "kt": ("kt", "kts"),
    "scala": ("scala", "sc", "sbt"),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "h", "hpp", "hxx", "hh"),
    "csharp": ("cs",),
    "cs": ("cs",),
    "fsharp": ("fs", "fsi", "fsx"),
    "fs": ("fs", "fsi", "fsx"),
    "elixir": ("ex", "exs"),
    "ex": ("ex", "exs"),
    "erl": ("erl", "hrl"),
    "hcl": ("hcl", "tf", "tfvars"),
    "json": ("json", "jsonc"),
    "yaml": ("yaml", "yml"),
    "yml": ("yaml", "yml"),
    "toml": ("toml",),
    "html": ("html", "htm"),
    "css": ("css", "scss", "sass", "less"),
    "markdown": ("md", "mdx", "markdown"),
    "md": ("md", "mdx"),
    "shell": ("sh", "bash", "zsh", "fish"),
    "sh": ("sh", "bash", "zsh", "fish"),
    "sql": ("sql",),
    "swift": ("swift",),
}
PATH_FAMILIES = {
    "ruby": ("rb", "rake", "rbi"),
    "tsish": ("cjs", "js", "jsx", "mjs", "svelte", "ts", "tsx", "vue"),
    "webstyle": ("css", "less", "sass", "scss"),
}
CHUNK_LANGUAGES = {
    "javascript": ("cjs", "js", "jsx", "mjs", "ts", "tsx"),
    "python": ("py",),
    "go": ("go",),
    "java": ("java",),
    "rust": ("rs",),
    "ruby": ("gemspec", "rake", "rb", "rbi"),
    "yaml": ("yml",),
}
GRAMMARS = {
    "ts": ("ts",),
    "tsx": ("tsx",),
    "js": ("cjs", "js", "jsx", "mjs"),
    "py": ("py",),
    "rb": ("rake", "rb", "rbi"),
    "go": ("go",),
    "java": ("java",),
    "rs": ("rs",),
}
# -------------------------------------------------------------------------------------------------


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; '' when that dot leads the name."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)\z", 1))


def stem(path: Column) -> Column:
    """File name without its extension; a leading dot belongs to the name."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]*\z", "$1")


def _last_dot_suffix(path: Column) -> Column:
    """Lower-cased text after the last dot anywhere in the path ('' without a dot)."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def _lookup(key: Column, table: dict[str, Sequence[str]], otherwise: Column) -> Column:
    out = None
    for value, keys in table.items():
        out = (F if out is None else out).when(key.isin(list(keys)), F.lit(value))
    return out.otherwise(otherwise)


def is_indexable(path: Column) -> Column:
    """Extension allow-list: well-known names always, binary never, text types, few bare names."""
    name, ext = F.lower(basename(path)), extension(path)
    return (
        F.when(name.isin(*ALWAYS_INDEXED_NAMES), True)
        .when(ext.isin(*BINARY_EXTENSIONS), False)
        .when(ext.isin(*TEXT_EXTENSIONS), True)
        .when(ext == "", name.isin(*EXTENSIONLESS_NAMES))
        .otherwise(False)
    )


def is_safety_ignored(path: Column, check_parents: bool = False) -> Column:
    """Secrets and vendored trees never get indexed. ``check_parents`` also tests every directory."""
    inside = _any(F.array_contains(F.split(path, "/"), d) for d in SAFETY_DIRECTORIES)
    low = F.lower(path)
    if check_parents:
        suffix = low.rlike("(" + "|".join(re.escape(s) for s in SAFETY_SUFFIXES) + ")(/|$)")
    else:
        suffix = _any(low.endswith(s) for s in SAFETY_SUFFIXES)
    return inside | suffix


def is_covered_by(path: Column, includes: Sequence[str]) -> Column:
    """True for a path inside one of the listed trees, and for a directory leading to one."""
    plain, slash = posix(path), F.lit("/")
    # Without patterns: searches test the path of every posting.
    rel = F.rtrim(F.when(plain.startswith("./"), F.ltrim(F.substr(plain, F.lit(2)), slash)).otherwise(plain), slash)
    tests = []
    for raw in includes:
        root = re.sub(r"/+$", "", re.sub(r"^\./+", "", raw)) or raw
        root = re.sub(r"/+$", "", root)
        if root:
            tests.append((rel == root) | rel.startswith(root + "/") | F.startswith(F.lit(root), F.concat(rel, F.lit("/"))))
    return _any(tests)


def is_under(path: Column, directory: str) -> Column:
    root = directory.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def normalize_prefix(raw: str | None) -> str | None:
    text = (raw or "").strip()
    return text.replace("\\", "/").rstrip("/") if text else None


def prefix_predicate(path: Column, raw: str | None) -> Column | None:
    """Path equal to or below the prefix. Both tests push down to Parquet."""
    prefix = normalize_prefix(raw)
    return is_under(path, prefix) if prefix else None


def parse_suffixes(ext: str | Sequence[str] | None) -> list[str]:
    parts = re.split(r"[,\n\r]+", ext) if isinstance(ext, str) else list(ext or [])
    cleaned = (str(p).strip().lower() for p in parts)
    return [p if p.startswith(".") else "." + p for p in cleaned if p]


def language_suffixes(lang: str) -> list[str]:
    key = lang.strip().lower()
    if key not in LANGUAGE_SUFFIXES:
        raise ConfigError(f"unknown lang {lang.strip()!r}; use a known language name or ext")
    return ["." + s for s in LANGUAGE_SUFFIXES[key]]


def suffix_predicate(path: Column, suffixes: Sequence[str]) -> Column:
    low = F.lower(posix(path))
    return _any(low.endswith(s) for s in dict.fromkeys(suffixes))


def glob_predicate(path: Column, pattern: str) -> Column:
    """A glob without '/' tests the file name, any other the whole path."""
    target = posix(path) if "/" in pattern else basename(posix(path))
    return target.rlike(glob_to_regex(pattern))


def query_path_predicate(
    path: Column,
    ext: str | Sequence[str] | None = None,
    lang: str | None = None,
    glob: str | None = None,
) -> Column | None:
    """(ext or lang) and glob; None when none of them is set."""
    suffixes = parse_suffixes(ext)
    if lang and lang.strip():
        suffixes += language_suffixes(lang)
    pattern = (glob or "").strip()
    tests = ([suffix_predicate(path, suffixes)] if suffixes else []) + ([glob_predicate(path, pattern)] if pattern else [])
    return reduce(lambda a, b: a & b, tests) if tests else None


def omits_working_docs(
    working_docs: Sequence[str], enabled: bool, include_docs: bool, path_prefix: str | None
) -> bool:
    """Unscoped searches leave working documents out unless asked for."""
    return bool(enabled and working_docs and not include_docs and normalize_prefix(path_prefix) is None)


def is_watch_skipped(path: Column, force_includes: Sequence[str], excluded: Column | None = None) -> Column:
    """Paths whose change events are dropped: excluded ones, then build and vendor directories."""
    in_skipped = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in WATCH_SKIPPED_DIRECTORIES]))
    skipped = in_skipped & ~is_covered_by(path, force_includes)
    return skipped if excluded is None else excluded | skipped


def content_bucket(path: Column, working_docs: Sequence[str] = ()) -> Column:
    """code, config or docs."""
    p = posix(path)
    ext, name = extension(p), F.lower(stem(p))
    env_like = name.startswith(".env") | (name == "env") | name.endswith(".env")
    return (
        F.when(is_covered_by(path, working_docs), "docs")
        .when(ext.isin(*CONFIG_EXTENSIONS) | env_like, "config")
        .when(ext.isin(*DOC_EXTENSIONS), "docs")
        .when((ext == "txt") & name.isin(*DOC_TEXT_NAMES), "docs")
        .otherwise("code")
    )


def has_config_extension(path: Column) -> Column:
    return extension(posix(path)).isin(*CONFIG_EXTENSIONS)


def chunk_language(path: Column) -> Column:
    """Language label of a file; unknown extensions label themselves, bare names are text."""
    p = posix(path)
    ext = extension(p)
    bare = F.when(F.lower(basename(p)).isin("rakefile", "gemfile"), "ruby").otherwise("text")
    return F.when(ext == "", bare).otherwise(_lookup(ext, CHUNK_LANGUAGES, ext))


def grammar(path: Column) -> Column:
    """Which declaration scanner reads the file; null when none does."""
    return _lookup(_last_dot_suffix(path), GRAMMARS, F.lit(None).cast("string"))


def path_family(path: Column) -> Column:
    return _lookup(_last_dot_suffix(path), PATH_FAMILIES, F.lit("other"))


def env_section(key: Column) -> Column:
    low = F.lower(F.trim(key))
    return F.when(low.isin("development", "test", "production"), low)
