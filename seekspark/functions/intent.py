"""Does a query ask for the definition of a symbol, and which one?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, SPACE, trim

_GAP, _NAME = f"{SPACE}+", r"`?([A-Za-z_][A-Za-z0-9_$]*)`?"
_THE = f"(?:the{_GAP})?"
_FIND = f"(?:find|locate|show|open|get|lookup){_GAP}"
_WRAP = r"[`\"'\[\]()]*"
_STOP = r"[?.!,;:]*"
# The phrases, first match wins. Group 1 is the symbol.
DEFINITION_PHRASES = (
    rf"where{_GAP}(?:is|are){_GAP}{_THE}{_NAME}{_GAP}"
    rf"(?:class|interface|type|enum|struct|trait|record|method|module){_GAP}defined{NOT_WORD_AFTER}",
    rf"{NOT_WORD_BEFORE}definitions?{_GAP}of{_GAP}{_THE}{_NAME}{_GAP}"
    rf"(?:class|interface|type|enum|method|module){NOT_WORD_AFTER}",
    rf"where{_GAP}(?:is|are){_GAP}{_THE}{_NAME}{_GAP}defined{NOT_WORD_AFTER}",
    rf"{NOT_WORD_BEFORE}definitions?{_GAP}of{_GAP}{_THE}`?([A-Za-z_][A-Za-z0-9_$]*)"
    rf"(?:`(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))",
    rf"{NOT_WORD_BEFORE}find{_GAP}{_THE}{_NAME}{_GAP}definition{NOT_WORD_AFTER}",
    rf"(?:{NOT_WORD_BEFORE}|(?<=[A-Za-z0-9_])`)([A-Za-z_][A-Za-z0-9_$]*)`?{_GAP}definition{SPACE}*\z",
    rf"^define{_GAP}{_NAME}\z",
)
VERB_STUDLY = (
    rf"^(?:{_FIND}|navigate{_GAP}to{_GAP}|search{_GAP}for{_GAP}|go{_GAP}to{_GAP}){_THE}"
    rf"([A-Za-z][A-Za-z0-9_]{{3,63}}){SPACE}*{_STOP}\z"
)
BASE_CLASS = rf"^{_FIND}{_THE}([^\n\r\x{{2028}}\x{{2029}}]+?){_GAP}base{_GAP}class{NOT_WORD_AFTER}{_STOP}\z"
VERB_SNAKE = rf"^{_FIND}{_THE}([a-z][a-z0-9_]{{3,63}}){SPACE}*{_STOP}\z"
BARE_STUDLY = rf"^{_WRAP}([A-Z][A-Za-z0-9_]{{3,63}}){_WRAP}{_STOP}\z"
BARE_SNAKE = rf"^{_WRAP}([a-z][a-z0-9_]{{3,63}}){_WRAP}{_STOP}\z"


def _group(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Group 1, or null when the pattern does not match."""
    found = F.regexp_extract(text, ("(?i)" if ignore_case else "") + pattern, 1)
    return F.nullif(found, F.lit(""))


def definition_intent(query: Column) -> Column:
    """The symbol of an explicit question such as "where is X defined"; else null."""
    q = trim(query)
    return F.when(F.length(q) >= 4, F.coalesce(*[_group(q, p) for p in DEFINITION_PHRASES]))


def studly_symbol(phrase: Column) -> Column:
    """"user service" -> "UserService"; null unless it is one to six plain words."""
    text = trim(phrase)
    words = F.split(text, _GAP)
    joined = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), ""
    )
    plain = F.forall(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9_]*\z"))
    fits = (F.length(text).between(1, 80)) & (F.size(words) <= 6) & F.length(joined).between(4, 64)
    return F.when(fits & plain, joined)


def inferred_target(query: Column) -> Column:
    """A symbol named without the word "definition": bare names, or a verb and a name."""
    q = trim(query)
    studly_after_verb = _group(q, VERB_STUDLY)
    snake_after_verb = _group(q, VERB_SNAKE)
    bare_snake = _group(q, BARE_SNAKE, ignore_case=False)
    bare = F.coalesce(
        _group(q, BARE_STUDLY, ignore_case=False), F.when(bare_snake.contains("_"), bare_snake)
    )
    target = F.coalesce(
        F.when(studly_after_verb.rlike("^[A-Z]"), studly_after_verb),
        studly_symbol(_group(q, BASE_CLASS)),
        F.when(snake_after_verb.contains("_"), snake_after_verb),
        F.when(~q.rlike(SPACE), bare),
    )
    return F.when(F.length(q).between(4, 128), target)


def definition_target(query: Column) -> Column:
    return F.coalesce(definition_intent(query), inferred_target(query))
