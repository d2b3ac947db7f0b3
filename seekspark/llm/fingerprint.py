"""Document fingerprints by consistent weighted sampling.

A document is a bag of terms, weighted by how often they occur. For each sample k a term with weight S draws r and c from
Gamma(2, 1) and b from [0, 1), all three from a hash of (term, k), and gets

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r.

The term with the least a is the sample, (term, t) its identity; two documents draw the same one with a chance that equals
their generalised Jaccard similarity sum(min) / sum(max). As a is a function of (term, t, k), its bits stand for the
identity; BITS of them are kept, and the estimate allows for their accidental agreement. The draws come from tables of
quantiles made once, so that only additions, products and comparisons follow and every machine gets the same bits.

Terms are lower-cased words between white space; words of more than LONG characters (unsegmented scripts, encoded data)
are three-character pieces instead. Defined cases: null text is empty; a text without words has the fingerprint of one
reserved term; repeated rows have equal fingerprints; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, shuffle_width, slices, small_batches, whole_text
from seekspark.session import written

LONG = 24
BITS = 8
#: Terms drawn for at once (a table of GROUP x samples floats), and rows worked on at once.
GROUP = 40_000
BLOCK = 1024


@dataclass(frozen=True)
class FingerprintConfig:
    samples: int = 128
    seed: int = 5


@lru_cache
def _gamma_quantiles(points: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), at the middles of equal steps."""
    share = (np.arange(points) + 0.5) / points
    low, high = np.zeros(points), np.full(points, 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = -np.expm1(-middle) - middle * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _gamma_quantiles(1 << 12).astype(np.float32), np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def terms_of(text: str) -> Counter:
    """Terms and weights. An empty bag becomes one reserved term."""
    counts = Counter(text.lower().split())
    for word in [w for w in counts if len(w) > LONG]:
        times = counts.pop(word)
        for i in range(len(word) - 2):
            counts[word[i:i + 3]] += times
    return counts or Counter({"": 1})


def _draws(hashes: np.ndarray, config: FingerprintConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for every term (rows) and sample (columns)."""
    ratio, logs = _tables()
    with np.errstate(over="ignore"):
        salts = (np.arange(config.samples, dtype=np.uint64) + np.uint64(config.seed * 1000 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = hashes[:, None] + salts[None, :]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    r = ratio[(x & np.uint64(0xFFF)).astype(np.intp)]
    log_c = logs[((x >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.intp)]
    b = ((x >> np.uint64(40)).astype(np.float32)) * np.float32(2.0 ** -24)
    return r, log_c, b


def signatures(bags: list[Counter], config: FingerprintConfig = FingerprintConfig()) -> np.ndarray:
    """One row of `samples` bytes per bag. Bags are taken in groups that keep the tables of draws small."""
    out = np.zeros((len(bags), config.samples), np.uint8)
    start = 0
    while start < len(bags):
        stop, held = start, 0
        while stop < len(bags) and (stop == start or held + len(bags[stop]) <= GROUP):
            held += len(bags[stop])
            stop += 1
        out[start:stop] = _signatures(bags[start:stop], config)
        start = stop
    return out


def _signatures(bags: list[Counter], config: FingerprintConfig) -> np.ndarray:
    place: dict[str, int] = {}
    lengths = np.array([len(bag) for bag in bags])
    total = int(lengths.sum())
    for bag in bags:
        for w in bag:
            if w not in place:
                place[w] = len(place)
    rows = np.fromiter((i for bag in bags for i in map(place.__getitem__, bag)), np.int64, total)
    weights = np.fromiter((n for bag in bags for n in bag.values()), np.int64, total)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), config.seed) for w in place), np.uint64, len(place))
    least = np.full((len(bags), config.samples), np.inf, np.float32)
    owners = np.repeat(np.arange(len(bags)), lengths)
    # Terms are drawn for in the order of their first bag, in spans that bound the tables; a span is all of a usual group.
    for at in range(0, len(place), GROUP):
        here = hashes[at:at + GROUP]
        inside = slice(None) if len(place) <= GROUP else np.flatnonzero((rows >= at) & (rows < at + GROUP))
        _lower(least, owners[inside], rows[inside] - at, weights[inside], here, config)
    bits = least.view(np.uint32) * np.uint32(0x9E3779B1)
    return (bits >> np.uint32(32 - BITS)).astype(np.uint8)


@lru_cache(maxsize=2)
def _tables_of_draws(samples: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Room for the draws of one group, kept by the worker: fresh tables of changing sizes would scatter its heap."""
    return np.empty((GROUP, samples), np.float32), [np.empty((GROUP // 4, samples), np.float32) for _ in range(3)]


def _lower(least: np.ndarray, owners: np.ndarray, rows: np.ndarray, weights: np.ndarray, hashes: np.ndarray, config: FingerprintConfig) -> None:
    """Takes (bag, term, weight) triples, sorted by bag, into the least values of the bags."""
    heavy = np.unique(rows[weights > 1])
    heavy_place = np.zeros(len(hashes), np.int64)
    heavy_place[heavy] = np.arange(len(heavy))
    once, full = _tables_of_draws(config.samples)
    if len(heavy) > len(full[0]):
        full = [np.empty((len(heavy), config.samples), np.float32) for _ in range(3)]
    for at in range(0, len(hashes), BLOCK):
        r, log_c, b = _draws(hashes[at:at + BLOCK], config)
        once[at:at + len(r)] = log_c - r * (0 - b) - r  # weight 1: t is 0
        low, high = np.searchsorted(heavy, [at, at + BLOCK])
        for held, drawn in zip(full, (r, log_c, b), strict=True):
            held[low:high] = drawn[heavy[low:high] - at]
    kinds, inverse = np.unique(weights, return_inverse=True)
    logs = np.array([math.log(n) for n in kinds], np.float32)[inverse]
    for at in range(0, len(rows), BLOCK):
        part = slice(at, at + BLOCK)
        values = once[rows[part]]
        more = np.flatnonzero(weights[part] > 1)
        if len(more):
            which = heavy_place[rows[part][more]]
            r, log_c, b = (held[which] for held in full)
            t = np.floor(logs[part][more][:, None] / r + b)
            values[more] = log_c - r * (t - b) - r
        heads = np.flatnonzero(np.r_[True, np.diff(owners[part]) != 0])
        met = owners[part][heads]
        least[met] = np.minimum(least[met], np.minimum.reduceat(values, heads, axis=0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures, row by row, 0 to 1; 1 for equal ones."""
    share = (a == b).mean(axis=1)
    chance = 2.0 ** -BITS
    return np.clip((share - chance) / (1 - chance), 0.0, 1.0)


def likeness_column(a: Column, b: Column, config: FingerprintConfig = FingerprintConfig()) -> Column:
    """The same for two fingerprint columns (hex)."""
    width = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(config.samples - 1)), F.lit(0),
        lambda n, k: n + F.when(F.substr(a, k * width + 1, F.lit(width)) == F.substr(b, k * width + 1, F.lit(width)), 1).otherwise(0))
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (same / config.samples - chance) / (1 - chance))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """The kept columns and `fingerprint` (hex), without a shuffle."""
    rows = docs.select(*[f"`{c}`" for c in keep], whole_text(F.col(f"`{text}`")).alias("_text"))
    schema = rows.select(*[f"`{c}`" for c in keep], F.lit("").alias("fingerprint")).schema

    def run(batches):
        for part in slices(batches, "_text"):
            made = signatures([terms_of(t) for t in part.column("_text").to_pylist()], config)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(len(keep))], pa.array([m.tobytes().hex() for m in made], pa.string())], names=[*keep, "fingerprint"])

    return small_batches(rows).mapInArrow(run, schema)


# ---- a document, its edited text and its neighbour -------------------------------------------------------
def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first code points of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


_DONE = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
         ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compared(keys: list, texts: list[str], following: list[str], config: FingerprintConfig, consecutive: bool) -> list:
    """Result columns for texts and the texts that follow them; consecutive: each follows the one before it."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    others = following[-1:] if consecutive else following
    # A text and its edited form stand side by side, as they share most terms and so most draws.
    mixed = [terms_of(t) for pair in zip(texts, changed, strict=True) for t in pair]
    made = signatures([*mixed, *(terms_of(t) for t in others)], config)
    n = len(texts)
    own, new, last = made[:2 * n:2], made[1:2 * n:2], made[2 * n:]
    behind = np.vstack([own[1:], last]) if consecutive else last
    return [keys, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [m.tobytes().hex() for m in own], [m.tobytes().hex() for m in new], likeness(own, new), likeness(own, behind)]


def with_neighbours(docs: DataFrame, config: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, by descending id.

    One range shuffle puts neighbours together; a task reads its sorted rows as a stream and holds one slice. The last
    document of a task lacks its follower: it leaves as `open`, the first one of each task as `head` as well, and the few
    of them (two per task) are joined by task number afterwards. Null ids come last; rows with equal ids follow in the
    order of a hash of their texts; a single document follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]
    tasks = max(shuffle_width(spark), 1)
    in_order = small_batches(rows).repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)
    key_type = rows.schema["doc_id"]
    schema = rows.select("doc_id").schema.add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add(
        "edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double").add("role", "string").add("task", "integer").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]):
        task, held, out = TaskContext.get().partitionId(), None, None
        for part in slices(batches, "text"):
            if out is None:
                out = pa.schema([("doc_id", part.schema.field("doc_id").type), *_DONE, ("role", pa.string()), ("task", pa.int32()), ("text", pa.string())])
            keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            if held is None:
                yield _edge(out, keys[0], "head", task, texts[0])
            else:
                keys, texts = [held[0], *keys], [held[1], *texts]
            held = keys[-1], texts[-1]
            if len(texts) > 1:
                columns = _compared(keys[:-1], texts[:-1], texts[1:], config, True)
                n = len(texts) - 1
                yield batch_of(out, [*columns, ["done"] * n, [task] * n, [None] * n])
        if held is not None:
            yield _edge(out, held[0], "open", task, held[1])

    table = written(in_order.mapInArrow(run, schema), "fingerprints")
    edges = table.select("role", "task", "doc_id", "text")
    heads = edges.filter("role = 'head'").select("task", F.col("text").alias("following"))
    # One number per task; the text stays out of the window.
    ring = heads.select("task", F.lead("task").over(Window.partitionBy(F.lit(0)).orderBy("task")).alias("next"),
                        F.min("task").over(Window.partitionBy(F.lit(0))).alias("first"))
    ring = ring.select("task", F.coalesce("next", "first").alias("next"))
    last = (edges.filter("role = 'open'").join(ring, "task").drop("task")
            .join(heads.withColumnRenamed("task", "next"), "next").select("doc_id", "text", "following"))

    def finish(batches):
        for part in slices(batches, "text"):
            out = pa.schema([("doc_id", part.schema.field("doc_id").type), *_DONE])
            yield batch_of(out, _compared(*(part.column(c).to_pylist() for c in ("doc_id", "text", "following")), config, False))

    columns = [key_type.name, *[n for n, _ in _DONE]]
    done = table.filter("role = 'done'").select(*columns)
    return done.unionByName(last.mapInArrow(finish, done.schema))


def _edge(out: pa.Schema, key, role: str, task: int, text: str) -> pa.RecordBatch:
    return batch_of(out, [[key], *[[None]] * len(_DONE), [role], [task], [text]])
