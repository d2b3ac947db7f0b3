"""Glob and ignore patterns, translated once on the driver into Java regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.config import ConfigError

# Always ignored, before the patterns of the repository.
SAFETY_PATTERNS = (".git/", "**/.git/**", "node_modules/", "**/node_modules/**", "*.pem", ".env", ".env.*")

_EXTENDED = {"?": "?", "*": "*", "+": "+", "@": ""}


def glob_to_regex(pattern: str) -> str:
    """`*`, `?`, `**`, `[...]`, `{a,b}`, `{1..3}` and the extended groups `@() ?() *() +() !()`."""
    body, rest = _translate(pattern, 0, "")
    if rest != len(pattern):
        raise ConfigError(f"invalid glob: {pattern}")
    regex = f"(?s)^(?:{body})\\z"
    try:
        re.compile(regex.replace("\\z", "\\Z"))
    except re.error as error:
        raise ConfigError(f"invalid glob: {error}") from error
    return regex


def _translate(text: str, at: int, stop: str) -> tuple[str, int]:
    out: list[str] = []
    while at < len(text) and text[at] not in stop:
        char, following = text[at], text[at + 1 : at + 2]
        if char in "?*+@!" and following == "(":
            parts, at = _alternatives(text, at + 2, "|", ")")
            group = "(?:" + "|".join(parts) + ")"
            out.append(f"(?:(?!{group}(?:/|\\z))[^/]*?)" if char == "!" else group + _EXTENDED[char])
        elif text.startswith("**", at) and (at == 0 or text[at - 1] == "/") and text[at + 2 : at + 3] in ("", "/"):
            out.append("(?:.*/)?" if text[at + 2 : at + 3] == "/" else ".*")
            at += 3 if text[at + 2 : at + 3] == "/" else 2
        elif char == "*":
            while text[at : at + 1] == "*":
                at += 1
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
            at += 1
        elif char == "[" and (close := text.find("]", at + 2)) > 0:
            inner = text[at + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = close + 1
        elif char == "{" and "}" in text[at:]:
            numbers = re.match(r"\{(-?\d+)\.\.(-?\d+)\}", text[at:])
            if numbers:
                low, high = sorted(int(n) for n in numbers.groups())
                parts, at = [str(n) for n in range(low, high + 1)], at + numbers.end()
            else:
                parts, at = _alternatives(text, at + 1, ",", "}")
            out.append("(?:" + "|".join(parts) + ")")
        elif char == "\\" and following:
            out.append(re.escape(following))
            at += 2
        else:
            out.append(re.escape(char))
            at += 1
    return "".join(out), at


def _alternatives(text: str, at: int, separator: str, close: str) -> tuple[list[str], int]:
    parts = []
    while True:
        part, at = _translate(text, at, separator + close)
        parts.append(part)
        if at >= len(text):
            raise ConfigError(f"invalid glob: {text}")
        at += 1
        if text[at - 1] == close:
            return parts, at


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """One ignore line -> (regex over the path, re-includes?). Directories end in '/'."""
    text = re.sub(r"(?<!\\)\s+$", "", line)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text.removeprefix("\\") if text[:2] in ("\\#", "\\!") else text
    directory_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    body = glob_to_regex(text)[len("(?s)^(?:") : -len(")\\z")]
    lead = "" if anchored else "(?:.*/)?"
    tail = "/" if directory_only else "/?"
    return f"(?s)^{lead}(?:{body}){tail}\\z", negated


def ignored(path: Column, patterns: Iterable[str], is_dir: Column | bool = False) -> Column:
    """Ignore-file matching: the last matching rule decides; nothing below an ignored directory returns."""
    rules = [r for r in (ignore_rule(p) for p in patterns) if r]
    if not rules:
        return F.lit(False)

    def decided(target: Column) -> Column:
        verdict = None
        for regex, negated in reversed(rules):
            verdict = (F if verdict is None else verdict).when(target.rlike(regex), F.lit(not negated))
        return verdict.otherwise(F.lit(False))

    parts = F.split(F.regexp_replace(path, r"/+\z", ""), "/")
    own_slash = F.when(F.lit(is_dir) if isinstance(is_dir, bool) else is_dir, "/").otherwise("")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(
            F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), F.lit("/")).otherwise(own_slash)
        ),
    )
    return (path != "") & (path != "/") & F.exists(prefixes, decided)


def root_ignore_patterns(ignore_file_text: str | None) -> list[str]:
    """Safety patterns followed by the lines of the root ignore file (nested files are not read)."""
    return [*SAFETY_PATTERNS, *(ignore_file_text or "").splitlines()]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
