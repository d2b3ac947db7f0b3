"""Line-by-line symbol detection with regular expressions, and YAML/JSON top-level keys."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.functions.columns import let
from seekspark.functions.text import trim
from seekspark.schemas import KEYS

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

# ---- fixed values: (kind, pattern over the trimmed line), first match wins; group 1 is the name ----
_JS = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_END = r"(?![A-Za-z0-9_])"
_ID = r"([A-Za-z_][A-Za-z0-9_]*)"
_CONST = r"([A-Z][A-Za-z0-9_]*)"
LINE_PATTERNS = {
    "javascript": [
        ("function", rf"^(?:export\s+)?(?:async\s+)?function\s+{_JS}\s*\("),
        ("class", rf"^(?:export\s+)?class\s+{_JS}(?<=[A-Za-z0-9_])"),
        ("interface", rf"^(?:export\s+)?interface\s+{_JS}(?<=[A-Za-z0-9_])"),
        ("type", rf"^(?:export\s+)?type\s+{_JS}(?:<[^>]+>)?(?:\s*=\s*|\s+extends{_END})"),
        ("type", rf"^(?:export\s+)?enum\s+{_JS}(?<=[A-Za-z0-9_])"),
        ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{_JS}\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
        ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{_JS}\s*=\s*(?:async\s*)?function{_END}"),
    ],
    "python": [("function", rf"^def\s+{_ID}\s*\("), ("class", rf"^class\s+{_ID}")],
    "ruby": [
        ("function", rf"^def\s+self\.{_ID}"),
        ("function", r"^def\s+([A-Za-z_][A-Za-z0-9_]*[!?]?(?:=(?=\s*\())?)(?=[\s(#&;!]|$)"),
        ("class", rf"^{_CONST}\s*=\s*(?:::)?(?:Struct\.new|Data\.define|Class\.new|Module\.new)"),
        ("type", rf"^enum\s+:{_ID}"),
        ("type", rf"^enum\s+{_ID}\s*:"),
        ("class", r"^class\s+([A-Z][A-Za-z0-9_:]*)(?<![:])"),
        ("class", r"^module\s+([A-Z][A-Za-z0-9_:]*)(?<![:])"),
    ],
    "generic": [
        ("function", rf"^(?:export\s+)?(?:func|fn)\s+{_ID}\s*\("),
        ("type", rf"^(?:export\s+)?(?:class|struct|interface|trait|type)\s+{_ID}"),
    ],
}
YAML_KEY = r"^[\"']?([A-Za-z0-9_.-]+)[\"']?\s*:"
JSON_KEY = r'\s*,?\s*"([^"]+)"\s*:'
# ----------------------------------------------------------------------------------------------------


def _first_match(line: Column, patterns: list[tuple[str, str]]) -> Column:
    """struct(name, kind) of the first pattern the line matches, else null."""
    out = None
    for kind, pattern in patterns:
        found = F.struct(F.regexp_extract(line, pattern, 1).alias("name"), F.lit(kind).alias("kind"))
        out = (F if out is None else out).when(line.rlike(pattern), found)
    return out


def line_symbol(line: Column, language: Column) -> Column:
    """The symbol a trimmed line declares. Ruby falls through to the generic patterns."""
    generic = LINE_PATTERNS["generic"]
    found = (
        F.when(language == "javascript", _first_match(line, LINE_PATTERNS["javascript"]))
        .when(language == "python", _first_match(line, LINE_PATTERNS["python"]))
        .when(language == "ruby", _first_match(line, LINE_PATTERNS["ruby"] + generic))
        .otherwise(_first_match(line, generic))
    )
    skipped = (line == "") | line.startswith("//") | line.startswith("#")
    return F.when(~skipped, found)


def regex_spans(lines: Column, language: Column) -> Column:
    """All line symbols of a file, in line order (at most one per line)."""
    found = F.transform(
        lines,
        lambda raw, i: F.transform(
            F.array(trim(raw)), lambda line: F.struct(line_symbol(line, language).alias("s"), (i + 1).cast("int").alias("n"))
        )[0],
    )
    kept = F.filter(found, lambda x: x["s"].isNotNull())
    return F.transform(
        kept,
        lambda x: F.struct(
            x["s"]["name"].alias("name"), x["s"]["kind"].alias("kind"), x["n"].alias("start_line"),
            F.lit(None).cast("string").alias("scope_path"),
        ),
    )


def merge_spans(parsed: Column, matched: Column) -> Column:
    """Parsed spans win their line; regex spans fill the other lines; exact repeats collapse."""
    rest = let(
        F.transform(parsed, lambda s: s["start_line"]),
        lambda taken: F.filter(matched, lambda s: ~F.array_contains(taken, s["start_line"])),
    )
    return F.array_distinct(F.concat(parsed, rest))


def rank_spans(spans: Column) -> Column:
    """Sorted by line, name (case folded first) and kind."""
    return F.array_sort(F.transform(
        spans,
        lambda s: F.struct(
            s["start_line"].alias("start_line"), F.lower(s["name"]).alias("folded"),
            F.translate(s["name"], _UPPER + _LOWER, _LOWER + _UPPER).alias("swapped"),
            s["kind"].alias("kind"), s["scope_path"].alias("scope_path"), s["name"].alias("name"),
        ),
    ))


def last_per_line(ranked: Column) -> Column:
    """At most one span per line: the last of the ranked ones."""
    marked = F.transform(
        ranked,
        lambda s, i: F.when(
            ~F.coalesce(F.get(ranked, i + 1)["start_line"] == s["start_line"], F.lit(False)),
            F.struct(
                s["name"].alias("name"), s["kind"].alias("kind"), s["start_line"].alias("start_line"),
                s["scope_path"].alias("scope_path"),
            ),
        ),
    )
    return F.array_compact(marked)


def yaml_keys(lines: Column) -> Column:
    """Top-level keys: unindented lines `key:`; comments never match the pattern."""
    found = F.transform(
        lines,
        lambda line, i: F.struct(F.regexp_extract(line, YAML_KEY, 1).alias("key"), (i + 1).cast("int").alias("line")),
    )
    return F.filter(found, lambda x: x["key"] != "")


_JSON_MARK = re.compile(r'[{}"\n]')
_JSON_STRING_END = re.compile(r'["\\]')
_JSON_KEY = re.compile(JSON_KEY)


def scan_json_keys(text: str) -> list[dict]:
    """Keys that start their line at brace depth one. Brackets do not count, strings are skipped."""
    keys, depth, line, at = [], 0, 1, 0

    def key_here(position: int) -> None:
        end = text.find("\n", position)
        match = _JSON_KEY.match(text, position, len(text) if end < 0 else end)
        if depth == 1 and match:
            keys.append({"key": match.group(1), "line": line})

    while mark := _JSON_MARK.search(text, at):
        at = mark.end()
        if mark.group() == "{":
            depth += 1
        elif mark.group() == "}":
            depth = max(0, depth - 1)
        elif mark.group() == "\n":
            line += 1
            key_here(at)
        else:
            while end := _JSON_STRING_END.search(text, at):
                line += text.count("\n", at, end.start())
                at = end.end()
                if end.group() == '"':
                    break
                # An escape takes the next character of the same or, at a line end, of the next line.
                while text[at : at + 1] == "\n":
                    line, at = line + 1, at + 1
                at += 1
            else:
                break
    return keys


@F.pandas_udf(KEYS)
def json_keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: scan_json_keys(re.sub(r"\r\n", "\n", t or "")))
