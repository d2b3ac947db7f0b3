"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a Spark aggregation over a bounded sample per language; the log-probability matrix (languages x buckets) is
broadcast, and every document is scored in Arrow slices by gathering the matrix rows of its n-grams and summing them.

Defined cases: a null, empty or letterless text is `und` with score 0; so is every text when nothing could be learned.
Ties go to the language that comes first by code point. Repeated rows are predicted each on its own, extra columns are
not read, an empty table gives an empty result, and a text of any length is scored whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, narrow, slices, small_batches

UNDETERMINED = "und"
MAX_LANGUAGES = 512
_PIECE = 1 << 18
#: Scores held at once, of characters by languages.
_CELLS = 1 << 22
#: Bytes of text scored at once; the arrays made of them take some hundred times as much.
SLICE = 1 << 18


@dataclass(frozen=True)
class LanguageConfig:
    """rows_per_lang bounds the sample that the model is fitted on; orders and bits shape the feature space."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    smoothing: float = 0.5
    rows_per_lang: int = 4000


@dataclass
class LanguageModel:
    """langs in code-point order; weights: (buckets + 1) x langs log-probabilities, the last row zero."""

    langs: list[str]
    weights: np.ndarray
    config: LanguageConfig


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces; ASCII that is no letter becomes a space."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_other = (codes < 128) & ((codes < 97) | (codes > 122))
    return np.where(ascii_other, np.uint32(32), codes)


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """One bucket for every n-gram of the order."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        mixed = (mixed ^ codes[k:k + n]) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
    return ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int64)


def _pieces(text: str, overlap: int, size: int = _PIECE) -> Iterator[np.ndarray]:
    """The text's codes in bounded pieces; each n-gram of the longest order lies in exactly one, shorter ones may in two."""
    for start in range(0, max(1, len(text)), size):
        yield _codes(text[max(0, start - overlap):start + size])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _count(config: LanguageConfig):
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", SLICE):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                sums = held.setdefault(lang, np.zeros(1 << config.bits, np.int64))
                for codes in _pieces(text, max(config.orders) - 1):
                    for order in config.orders:
                        sums += np.bincount(_buckets(codes, order, config.bits), minlength=1 << config.bits)
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield batch_of(out, [[lang] * len(at), at.astype(np.int32), sums[at]])

    return run


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Learns from at most about rows_per_lang rows of each language, chosen by a hash of the key.

    What reaches the driver is one number per language and one per (language, bucket).
    """
    rows = small_batches(narrow(labelled, text=text, lang=lang, key=key)).filter("text IS NOT NULL AND lang IS NOT NULL")
    known = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the broadcast matrix would have no fixed bound")
    langs = sorted(r["lang"] for r in known)
    if not langs:
        return LanguageModel([], np.zeros(((1 << config.bits) + 1, 0)), config)
    share = F.create_map(*[x for r in known for x in (F.lit(r["lang"]), F.lit(min(1.0, config.rows_per_lang / r["count"])))])
    chance = F.pmod(F.xxhash64(F.lit("lang-sample"), "key"), F.lit(1 << 20)) / float(1 << 20)
    counted = (
        rows.filter(chance < F.element_at(share, F.col("lang"))).select("lang", "text")
        .mapInArrow(_count(config), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    sums = np.zeros((1 << config.bits, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    sums[counted["bucket"].to_numpy(np.int64), counted["lang"].map(place).to_numpy(np.int64)] = counted["n"].to_numpy()
    sums += config.smoothing
    weights = np.vstack([np.log(sums / sums.sum(axis=0)), np.zeros((1, len(langs)))])
    return LanguageModel(langs, weights, config)


def _add_up(parts: list[np.ndarray], owners: list[int], totals: np.ndarray, model: LanguageModel) -> None:
    """Adds the log-probabilities of the n-grams of the parts to the totals of their texts."""
    lengths = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    ends = np.cumsum(lengths)
    for order in model.config.orders:
        buckets = _buckets(codes, order, model.config.bits)
        for k in range(1, order):  # n-grams that reach into the next part count nothing
            at = ends - k
            buckets[at[(at >= 0) & (at < len(buckets))]] = 1 << model.config.bits
        gathered = np.zeros((len(codes), len(model.langs)))
        np.take(model.weights, buckets, axis=0, out=gathered[:len(buckets)])
        np.add.at(totals, owners, np.add.reduceat(gathered, ends - lengths, axis=0))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior under equal priors, for a slice of texts.

    Pieces are added up as they come: what is held at once has a bound, however long a text is and however many languages.
    """
    width, size = max(model.config.orders) - 1, len(texts)
    piece = max(1024, min(_PIECE, _CELLS // max(1, len(model.langs))))
    totals, seen = np.zeros((size, len(model.langs))), []
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        if not model.langs or not has_letter(text):
            continue
        seen.append(i)
        for codes in _pieces(text, width, piece):
            parts.append(codes)
            owners.append(i)
            held += len(codes)
            if held >= 2 * piece:
                _add_up(parts, owners, totals, model)
                parts, owners, held = [], [], 0
    if parts:
        _add_up(parts, owners, totals, model)
    langs, scores = [UNDETERMINED] * size, np.zeros(size)
    if seen:
        best = totals[seen].argmax(axis=1)
        likely = np.exp(totals[seen] - totals[seen].max(axis=1, keepdims=True))
        scores[seen] = 1.0 / likely.sum(axis=1)
        for i, b in zip(seen, best, strict=True):
            langs[i] = model.langs[b]
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score."""
    spark = docs.sparkSession
    handle = spark.sparkContext.broadcast(model)
    read = text if text in keep else "_text"
    rows = docs.select(*[f"`{c}`" for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias("_text")]))
    schema = rows.select(*[f"`{c}`" for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for part in slices(batches, read, SLICE):
            langs, scores = score_texts(part.column(read).to_pylist(), handle.value)
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return small_batches(rows).mapInArrow(run, schema)


def is_held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from the rows that are not held out."""
    learned = docs.filter(~is_held_out() & F.col("doc_id").isNotNull())
    model = fit(learned, config=config)
    flagged = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return predict(flagged, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, columns: list[str], config: LanguageConfig = LanguageConfig(), least: float = 0.5) -> DataFrame:
    """The documents whose language is determined with a posterior of `least` or more; the others go.

    Where no label says what a language is, none can be rejected: every text with a letter stays.
    """
    model = fit(docs.filter(~is_held_out() & F.col("doc_id").isNotNull()), config=config)
    if not model.langs:
        return docs.select(*columns).filter(F.col("text").rlike(r"\p{L}"))
    # The predicted columns get names that no document column has.
    judged = predict(docs.select(*columns), model, columns)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*columns)
