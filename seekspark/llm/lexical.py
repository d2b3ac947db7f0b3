"""Ranked lexical search by scanning: one automaton of all query terms runs over every text; there is no document index.

The terms of all items make an Aho-Corasick automaton, each between two guards (blanks). A text is folded (A-Z to lower
case, every other delimiter a blank) and put between blanks, so the automaton's matches are whole terms and their number is
tf. A term's number leads to the items that hold it, so a text is scored for all its items at once. The texts are scanned
twice: for the corpus counts (documents, terms, documents of each term), then for the scores; each task passes on the k
best documents of each item only, and these are ranked in two steps.

Items come in blocks of about MAX_PAIRS pairs of item and term (a block is what the tasks hold; an item's own terms stay
together), and each block is a scan against all rows. Per-text memory is bounded by pieces of PIECE bytes, cut at blanks.

Defined cases: null and empty texts have no terms and are never hits; repeated documents are ranked each on its own; equal
scores sort by id, null ids last; items sharing an id are one item with the terms of all its texts, and so are items
without an id; items without terms, or with none that the documents hold, have no rows; extra columns are not read.
Document ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.common import narrow, slices, small_batches, whole_text
from seekspark.session import written

TOP = 10
SCALE, K1_MILLI, B_PERCENT = 1_000_000_000, 1000, 90
MAX_PAIRS = 200_000
PIECE = 1 << 20
CELLS = 1 << 22
HELD = 1 << 17
SHARES = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a term of a lower-cased text.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_DOCS, N_TERMS = -1, -2
#: What each byte of a UTF-8 text folds to.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """The terms between guards, as bytes; the value of a term is its number."""
    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term} ".encode().decode("latin-1"), number)
    made.make_automaton()
    return made


def _pieces(folded: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end]
        start = end


def count_terms(text: bytes, known: ahocorasick.Automaton, n_known: int) -> tuple[int, np.ndarray, np.ndarray]:
    """All terms of a text with repeats, and the numbers and counts of those that the automaton knows."""
    total, numbers = 0, []
    for piece in _pieces(text.translate(FOLD)):
        inside = np.frombuffer(piece, np.uint8) != 0x20
        total += int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        if n_known:
            found = np.fromiter(map(itemgetter(1), known.iter(f" {piece.decode('latin-1')} ")), np.int64)
            numbers.append(np.stack(np.unique(found, return_counts=True)))
    if not numbers:
        return total, *np.zeros((2, 0), np.int64)
    if len(numbers) == 1:
        return total, *numbers[0]
    every = np.concatenate(numbers, axis=1)
    unique, where = np.unique(every[0], return_inverse=True)
    return total, unique, np.bincount(where, every[1]).astype(np.int64)


class Block:
    """A block of items as the tasks hold it: terms, and for each term the numbers of its items."""

    def __init__(self, pairs: list[tuple[int, str]], n_items: int):
        self.n_items = n_items
        self.terms = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(self.terms)}
        rows = np.array(sorted((number[t], i) for i, t in pairs), np.int64).reshape(-1, 2)
        self.starts = np.searchsorted(rows[:, 0], np.arange(len(self.terms) + 1))
        self.items = rows[:, 1]

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
        known = automaton(self.terms)
        for part in (p for batch in batches for p in slices(iter([batch]), "text")):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield part, [count_terms(t, known, len(self.terms)) for t in texts]


def _statistics(docs: DataFrame, block: Block) -> dict[int, int]:
    """Documents with terms, all terms, and the documents of each term of the block: at most as many rows as terms, and two."""

    def run(batches):
        df, n_docs, n_terms = np.zeros(len(block.terms), np.int64), 0, 0
        for _, counted in block.counts(batches):
            for total, numbers, _ in counted:
                df[numbers] += 1
                n_docs += total > 0
                n_terms += total
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([N_DOCS, N_TERMS, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[held].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


class _Best:
    """The k best documents of each item seen so far; a score below an item's k-th best is not even held."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least, self.size = k, np.ones(n_items), 0
        self.held: list[np.ndarray] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """scores: documents by items."""
        at, item = np.nonzero(scores >= self.least)
        self.held.append(np.stack([item, scores[at, item].astype(np.int64), unnamed[at].astype(np.int64), ids[at]]))
        self.size += len(at)
        if self.size > HELD:
            self.cut()

    def cut(self) -> np.ndarray:
        """item, score, whether the id is null, id: sorted, the k best of each item."""
        every = np.concatenate(self.held, axis=1) if self.held else np.zeros((4, 0), np.int64)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        starts = np.searchsorted(every[0], every[0])
        place = np.arange(every.shape[1]) - starts
        full = place == self.k - 1
        self.least[every[0][full]] = every[1][full]
        every = every[:, place < self.k]
        self.held, self.size = [every], every.shape[1]
        return every


def _scored(docs: DataFrame, block: Block, known: dict[int, int], k: int) -> DataFrame:
    """_item, doc_id, score: the k best documents of each item and task."""
    n_docs, n_terms = known.get(N_DOCS, 0), known.get(N_TERMS, 0)
    # In doubles, as defined; everything else is in integers, whose sums stay exact in the doubles of bincount.
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * known[i] + 1))) if i in known else 0 for i in range(len(block.terms))], np.int64)

    def run(batches):
        best, fan = _Best(block.n_items, k), np.diff(block.starts)
        for part, counted in block.counts(batches):
            ids, unnamed = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            cost = np.array([int(fan[numbers].sum()) for _, numbers, _ in counted])
            start = 0
            while start < len(counted):
                end, cells = start + 1, int(cost[start])
                while end < len(counted) and (end + 1 - start) * block.n_items <= CELLS and cells + cost[end] <= CELLS:
                    cells += int(cost[end])
                    end += 1
                chosen = counted[start:end]
                lengths = np.array([len(numbers) for _, numbers, _ in chosen])
                if lengths.sum():
                    damping = np.array([8 * (100 - B_PERCENT + B_PERCENT * total * n_docs // n_terms) if total else 0 for total, _, _ in chosen], np.int64)
                    row = np.repeat(np.arange(len(chosen)), lengths)
                    term, tf = np.concatenate([c[1] for c in chosen]), np.concatenate([c[2] for c in chosen])
                    gain = weight[term] * (SCALE * tf // (K1_MILLI * tf + damping[row]))
                    many = fan[term]
                    first = np.repeat(block.starts[term] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                    item = block.items[np.arange(len(first)) + first]
                    sums = np.bincount(np.repeat(row, many) * block.n_items + item, np.repeat(gain, many), len(chosen) * block.n_items)
                    best.add(sums.reshape(len(chosen), block.n_items), ids[start:end], unnamed[start:end])
                start = end
        item, score, unnamed, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=unnamed.astype(bool)), pa.array(score)], names=["_item", "doc_id", "score"])

    return docs.mapInArrow(run, "_item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score (above 0): the k best documents of each item."""
    rows = small_batches(narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")))
    asked = narrow(items, item_id=item_id, text=item_text)
    pairs = written(asked.select("item_id", F.explode(terms_of(whole_text())).alias("term")).distinct(), "item-terms")
    blocks = max(1, -(-pairs.count() // MAX_PAIRS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    answers = []
    for number in range(blocks):
        found = [(r["item_id"], r["term"]) for r in pairs.filter(block_of == number).toLocalIterator()]  # one block
        names = {name: i for i, name in enumerate(dict.fromkeys(name for name, _ in found))}
        block = Block([(names[name], term) for name, term in found], len(names))
        best = _scored(rows, block, _statistics(rows, block), k)
        named = docs.sparkSession.createDataFrame([(i, name) for name, i in names.items()], f"_item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        answers.append(_ranked(best, k).join(F.broadcast(named), "_item"))
    return reduce(DataFrame.unionByName, answers).select("item_id", "rank", "doc_id", "score")



def _ranked(best: DataFrame, k: int) -> DataFrame:
    """Ranks in two steps: first within shares of an item's documents."""
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = best.withColumn("_share", share).withColumn("_at", rank("_item", "_share")).filter(F.col("_at") <= k)
    return cut.drop("_share", "_at").withColumn("rank", rank("_item")).filter(F.col("rank") <= k)


def search_sql(k: int = TOP) -> str:
    """The same over relational postings."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS all_terms FROM d),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
q AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM i JOIN f USING (term), s),
m AS (SELECT r, doc_id, 10 + (90 * len(w)::BIGINT * docs) // all_terms AS m FROM d, s WHERE len(w) > 0),
g AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0) WHERE rank <= {k}
"""
