"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, scheme marks, digits, plus signs before a digit, identifier cues. From
each anchor a local parser reads outwards to the boundaries and checks what it has read. Parsers of one kind never read
the same character twice, so the four base kinds give what a leftmost, non-overlapping search would.

Added kinds: `url` (an address with user and password before its host), `iban` (checksum holds), `account` and `ssn`
(digits right behind their cue). Defined cases: null text is empty; repeated rows are read each on its own; extra columns
are not read; texts are read whole.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from seekspark.llm.spans import Found, with_spans

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
# The right-hand sides of the base patterns, read from an anchor.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR_PARTS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AUTHORITY = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no|num|nr)\b)?[.:#=\x20]{0,4}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z])", re.I)
SSN = re.compile(r"[\s:#.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
CUES = {"iban": ("iban", IBAN), "account": ("account", ACCOUNT), "acct": ("account", ACCOUNT), "ssn": ("ssn", SSN)}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    made.add_word("@", ("at", None))
    made.add_word("://", ("scheme", None))
    for d in DIGITS:
        made.add_word(d, ("digit", None))
        made.add_word("+" + d, ("plus", None))
    for word in CUES:
        for form in {word, word.upper(), word.title()}:
            made.add_word(form, ("cue", word))
    made.make_automaton()
    return made


ANCHORS = _automaton()


def passes_luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def is_iban(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_personal(text: str) -> Found:
    """All spans by kind, then start."""
    found: set[tuple[str, int, int]] = set()
    done = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, right: bool) -> None:
        done[kind] = end
        if right:
            found.add((kind, start, end))

    for last, (anchor, cue) in ANCHORS.iter(text):
        if anchor == "digit":
            if last >= done["ip"] and (last == 0 or text[last - 1] not in DIGITS) and (m := FOUR_PARTS.match(text, last)):
                take("ip", last, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()))
            if last >= done["card"] and (m := NUMBER.match(text, last)):
                digits = [c for c in m.group() if c in DIGITS] if m.end() - last <= 2 * 19 else []
                take("card", last, m.end(), 13 <= len(digits) <= 19 and passes_luhn("".join(digits)))
        elif anchor == "at":
            start = last
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                take("email", start, m.end(), True)
        elif anchor == "plus":
            if last - 1 >= done["phone"] and (m := DIALLED.match(text, last - 1)):
                take("phone", last - 1, m.end(), 9 <= sum(c in DIGITS for c in m.group()) <= 15)
        elif anchor == "scheme":
            start = last - 2
            while start > done["url"] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            if start < last - 2 and (m := AUTHORITY.match(text, last + 1)):
                take("url", start, m.end(), True)
        else:
            kind, parser = CUES[cue]
            before = last - len(cue)
            if (before < 0 or not text[before].isalnum()) and (m := parser.match(text, last + 1)) and m.start(1) >= done[kind]:
                take(kind, m.start(1), m.end(1), kind != "iban" or is_iban(m[1].replace(" ", "")))
    return [(k, s, e, k in BASE_KINDS) for k, s, e in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and their spans."""
    return with_spans(docs, find_personal, keep, text)
