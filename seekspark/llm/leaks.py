"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned against every window of words of every text.

Every run of WINDOW words of a benchmark item is a window; an item of fewer words, but not none, is one window. The hashes
of all windows make the hash set, an array of slots that each task holds. A text's windows of every length that occurs are
looked up there; the few that are set are carried on with their words, and an exact join with the table of windows
verifies them. Words inside a verified window are hit. DataFrame functions only.

Texts are scanned once, without a shuffle; only documents with a looked-up window go through an exchange, keyed by row. The
set has GRAIN slots a window, at most MAX_SLOTS of them: beyond that more windows are verified, none is lost. The table of
windows is broadcast up to MAX_BROADCAST_WINDOWS rows; a larger one is joined by shuffle, its keys salted, as one passage
may stand in a third of all documents.

Words are runs of digits, letters A-Z in lower case, and everything beyond ASCII. Defined cases: null and empty texts have
no words; a repeated document is scanned as often as it occurs; items sharing an id are one item; a null item id is written
`null`; items without words and an empty benchmark hit nothing; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import narrow, once, whole_text
from seekspark.session import written

WINDOW = 10
GRAIN = 256
MIN_SLOTS, MAX_SLOTS, BLOCK = 1 << 16, 1 << 23, 1 << 16
MAX_BROADCAST_WINDOWS = 500_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word of a lower-cased text, and of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CANDIDATES = "array<struct<pos:int,len:int,hash:bigint,words:array<string>>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(length)])


@dataclass(frozen=True)
class TestSet:
    """windows: window_id, len, hash, words; items: window_id, item (text); the lengths that occur, and the sizes."""

    windows: DataFrame
    items: DataFrame
    lengths: list[int]
    count: int
    pairs: int
    slots: int

    def hash_set(self) -> Column:
        """A byte for each slot, 1 where a window's hash falls; it travels with the plan, at most MAX_SLOTS bytes."""
        made = bytearray(self.slots)
        at = F.pmod("hash", F.lit(self.slots))
        blocks = self.windows.groupBy((at / BLOCK).cast("int").alias("block")).agg(F.collect_set((at % BLOCK).cast("int")).alias("set"))
        for block, positions in blocks.toLocalIterator():  # at most as many positions as slots
            for i in positions:
                made[block * BLOCK + i] = 1
        return F.lit(bytes(made))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows of (_row, hash, words) that are windows, with their window_id."""
        return _joined(rows, self.windows.select("hash", "words", "window_id"), ["hash", "words"], self.count)

    def of_windows(self, rows: DataFrame) -> DataFrame:
        """Rows of (_row, window_id) with the items of the window."""
        return _joined(rows, self.items, ["window_id"], self.pairs)


def _joined(rows: DataFrame, wanted: DataFrame, keys: list[str], size: int) -> DataFrame:
    if size <= MAX_BROADCAST_WINDOWS:
        return rows.join(F.broadcast(wanted), keys)
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def test_set(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> TestSet:
    rows = narrow(benchmark, item=item_id, text=text).select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), whole_text().alias("text"))
    rows = once(rows, "words", words_of(F.col("text"))).filter(F.size("words") > 0)
    n, w = F.size("words"), F.col("words")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    cut = rows.select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice(w, i + 1, F.least(n, F.lit(window)))))).alias("words")).distinct()
    name = F.sha2(F.array_join("words", " "), 256)
    cut = written(cut.select(name.alias("window_id"), "words", "item"), "windows")
    n = F.size("words")
    hashed = F.coalesce(*[F.when(n == k, _hash(w, F.lit(0), k)) for k in range(1, window + 1)])
    windows = written(cut.dropDuplicates(["window_id"]).select("window_id", n.alias("len"), hashed.alias("hash"), "words"), "window-set")
    seen = windows.groupBy("len").count().collect()  # at most `window` rows
    count = sum(r["count"] for r in seen)
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (GRAIN * count - 1).bit_length())) if count else MIN_SLOTS
    return TestSet(windows, cut.select("window_id", "item"), sorted(r["len"] for r in seen), count, cut.count(), slots)


def _scanned(docs: DataFrame, tests: TestSet, keep: list[str], text: str) -> DataFrame:
    """The kept columns, `_row`, `n_words` and `_found`: the looked-up windows of each document, as a table."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("_kept"), whole_text(F.col(f"`{text}`")).alias("_text"))
    rows = once(rows, "_words", words_of(F.col("_text"))).drop("_text")
    w, n = F.col("_words"), F.size("_words")
    known = tests.hash_set() if tests.lengths else None

    def found(length: int) -> Column:
        def looked_up(i: Column) -> Column:
            slot = F.pmod(_hash(w, i, length), F.lit(tests.slots)).cast("int")
            return F.substring(known, slot + 1, F.lit(1)) == F.lit(b"\x01")

        starts = F.when(n >= length, F.filter(F.sequence(F.lit(0), n - length), looked_up)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            i.alias("pos"), F.lit(length).alias("len"), _hash(w, i, length).alias("hash"), F.slice(w, i + 1, F.lit(length)).alias("words")))

    every = [found(length) for length in tests.lengths]
    looked = F.concat(*every) if every else F.array()
    scanned = rows.select("_kept", n.cast("long").alias("n_words"), looked.cast(CANDIDATES).alias("_found"))
    return written(scanned.withColumn("_row", F.monotonically_increasing_id()), "scanned")


def _verified(scanned: DataFrame, tests: TestSet) -> DataFrame:
    """_kept, n_words, _hits (positions of the words hit, ascending), _items (distinct, sorted as text)."""
    no_hits, no_items = F.array().cast("array<int>"), F.array().cast("array<string>")
    clean = scanned.filter(F.size("_found") == 0).select("_kept", "n_words", no_hits.alias("_hits"), no_items.alias("_items"))
    if not tests.lengths:
        return clean
    loose = scanned.filter(F.size("_found") > 0)
    # What is kept of a document is joined to it again by its row, not carried by each of its windows.
    windows = tests.named(loose.select("_row", F.explode("_found").alias("_f")).select("_row", "_f.*"))
    found = windows.groupBy("_row").agg(F.collect_list(F.struct("pos", "len")).alias("_at"), F.collect_set("window_id").alias("_ids"))
    within = F.flatten(F.transform("_at", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    found = written(found.select("_row", F.array_sort(F.array_distinct(within)).alias("_hits"), "_ids"), "hits")
    items = tests.of_windows(found.select("_row", F.explode("_ids").alias("window_id")))
    items = items.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    both = found.select("_row", "_hits").join(items, "_row")
    dirty = loose.select("_kept", "n_words", "_row").join(both, "_row", "left")
    return clean.unionByName(dirty.select("_kept", "n_words", F.coalesce("_hits", no_hits).alias("_hits"), F.coalesce("_items", no_items).alias("_items")))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """The kept columns of every document, n_words, hits (positions of words, ascending) and items (ids as text, sorted).

    Kept columns must not be called n_words, hits or items.
    """
    tests = test_set(benchmark, window=window)
    rows = _verified(_scanned(docs, tests, keep, text), tests)
    return rows.select("_kept.*", "n_words", F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = scan(docs, benchmark, ["doc_id"])
    n_hit = F.size("hits").cast("long")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", spans: bool = True, window: int = WINDOW) -> DataFrame:
    """The kept columns of clean documents; of the others what stands outside their hit spans, or nothing.

    A span runs from the first to the last of a run of hit words; what stands before and after it stays. The text must be
    among the kept columns. A null text stays null.
    """
    tests = test_set(benchmark, window=window)
    rows = _verified(_scanned(docs, tests, keep, text), tests)
    if not spans:
        return rows.filter(F.size("_hits") == 0).select("_kept.*")
    clean = rows.filter(F.size("_hits") == 0).select("_kept.*")
    hit = rows.filter(F.size("_hits") > 0)
    h = F.col("_hits")
    hit = once(hit, "_first", F.filter(h, lambda x, i: (i == 0) | (F.get(h, i - 1) != x - 1)))
    hit = once(hit, "_last", F.filter(h, lambda x, i: F.coalesce(F.get(h, i + 1) != x + 1, F.lit(True))))
    body = F.col("_kept").getField(text)
    hit = once(hit, "_words", F.regexp_extract_all(body, F.lit(ANY_WORD), F.lit(0)))
    hit = once(hit, "_gaps", F.split(body, ANY_WORD))
    words, gaps, first, last = (F.col(c) for c in ("_words", "_gaps", "_first", "_last"))
    # Between two spans stand the gap after the first, then words, each with the gap that follows it.
    def between(start: Column, end: Column) -> Column:
        pairs = F.zip_with(F.slice(words, start + 1, end - start), F.slice(gaps, start + 2, end - start), lambda a, b: F.concat(a, b))
        return F.concat(F.get(gaps, start), F.array_join(pairs, ""))

    starts = F.concat(F.array(F.lit(0)), F.transform(last, lambda x: x + 1))
    ends = F.concat(first, F.array(F.size(words)))
    left = F.array_join(F.zip_with(starts, ends, between), "")
    return clean.unionByName(hit.select(*[(left if c == text else F.col("_kept").getField(c)).alias(c) for c in keep]))


def report_sql(window: int = WINDOW) -> str:
    """The same by joining every window of every document with every window of the items."""
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = f"regexp_extract_all({lowered}, '{WORD}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} AS w FROM benchmark),
t AS MATERIALIZED (SELECT DISTINCT item, w[k + 1 : k + {window}] AS g FROM (SELECT item, w, unnest(generate_series(0, greatest(len(w) - {window}, 0))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM t),
p AS (SELECT r, k, n, w[k + 1 : k + n] AS g FROM (SELECT r, w, n, unnest(generate_series(0, len(w) - n)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT r, k, n, item FROM p JOIN t USING (g)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
