"""Near-duplicates by Jaccard similarity of word shingles, found through long SimHash codes.

One word of 64 bits cannot tell a similarity of 0.8 from less: two such texts differ in some 15 % of the bits. Here a text's
code has `parts` x `width` bits over its different shingles. The bits are dealt to parts as in `simhash`, correlated bits of
a word to the same part. The pigeonhole is met in expectation instead of in the worst case: a part probed up to t bits away
finds a pair at the least similarity with a known probability, a gain of -log(1 - probability), and every text chooses its
own thresholds (-1: skip the part, 0 or 1), by dynamic programming over the parts, so that the gains add up to the wanted
recall at the least estimated number of candidates. Part values that very many texts share are skipped, rarer ones get the
larger radius instead. Probers and owners of a value meet in a group, which emits a spanning forest of the members whose
codes are near; groups larger than `block` are split into blocks of probers times blocks of owners. The forests' edges are
then verified on the exact sets of shingles. A forest leaves pairs of its trees out, which matters only where an edge of a
tree is refused: then every pair of near codes of that tree whose ends are not linked yet is verified too, first each
member's nearest ones, then all that are left. So no pair found by the codes is lost.

The recall of the codes holds at the least similarity and is higher above it. For `width` 16 the codes suit some 1e7 different texts;
beyond that take wider parts and more of them, the thresholds then rise by themselves.

Defined cases: null texts and texts without words have no shingle and are one item; a text of fewer words than a shingle is
one shingle. Texts with equal sets of shingles are one item from the start. Null ids take part, repeated rows get the same
component, empty tables give empty results, extra columns are not read. A text is hashed whole; its set of shingles (8 bytes
each) is held by a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import simhash
from seekspark.llm.common import batch_of, narrow, shuffle_width, slices, small_batches
from seekspark.llm.graph import components, joined
from seekspark.llm.simhash import _choose, _masks, _mix, _nonzero, _pair_counts, _words, ball_counts, grouped_bits, part_values
from seekspark.session import written

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTS = "part int, value int, n long"
# So many of its nearest codes beyond its own component a member of a split tree tries before all others.
NEAREST = 8


@dataclass(frozen=True)
class SimilarConfig:
    """similarity: least Jaccard similarity of linked texts; recall: wanted share of pairs of that similarity that become
    candidates; parts of `width` bits (16 or a multiple of it that divides 64); members of a group are compared by the first `compared`
    words of their codes; values are counted by their first `counted` bits; block bounds what a task holds of a group."""

    shingle: int = 5
    similarity: float = 0.8
    recall: float = 0.95
    parts: int = 40
    width: int = 16
    compared: int = 4
    counted: int = 12
    block: int = 8192

    @property
    def words(self) -> int:
        return self.parts * self.width // 64

    @property
    def flip(self) -> float:
        """Chance that a bit differs between two texts of the least similarity; sets of unequal size differ less."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    @property
    def radius(self) -> int:
        """Bits in which compared codes may differ: 2.5 standard deviations above what the least similarity leads to."""
        bits = 64 * self.compared
        return math.ceil(bits * self.flip + 2.5 * math.sqrt(bits * self.flip * (1 - self.flip)))

    def gain(self, threshold: int) -> float:
        found = sum(_choose(self.width, r) * self.flip**r * (1 - self.flip) ** (self.width - r) for r in range(threshold + 1))
        return -math.log1p(-found)


# ---- codes -------------------------------------------------------------------------------------------
def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in _words(text or "")]
    hashed = np.concatenate(found) if found else np.zeros(0, np.uint64)
    if not len(hashed):
        return hashed
    length = min(shingle, len(hashed))
    folded = np.zeros(len(hashed) - length + 1, np.uint64)
    for i in range(length):
        folded = folded * _FOLD + hashed[i:len(hashed) - length + 1 + i]
    return np.unique(_mix(folded))


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits per segment and place. Up to 255 rows are added as bytes, eight at a time."""
    lengths = np.diff(np.r_[starts, len(hashes)])
    pieces = -(-lengths // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(hashes), 8)
    lanes = np.ascontiguousarray(np.add.reduceat(bits, cuts, axis=0)).view(np.uint8)
    return np.add.reduceat(lanes, first, axis=0, dtype=np.int64)


def codes_of(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Codes of `words` x 64 bits; a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros((len(sets), words), np.uint64)
    held: list[tuple[int, np.ndarray]] = []
    sums = np.zeros((len(sets), words, 64), np.int64)

    def add_up() -> None:
        rows = np.array([i for i, _ in held])
        hashes = np.concatenate([h for _, h in held])
        lengths = np.array([len(h) for _, h in held])
        for w in range(words):
            with np.errstate(over="ignore"):
                made = _mix(hashes + _STEP * np.uint64(w + 1))
            np.add.at(sums[:, w], rows, _bit_sums(made, np.cumsum(lengths) - lengths))
        held.clear()

    waiting = 0
    for i, hashes in enumerate(sets):
        for at in range(0, len(hashes), 1 << 16):
            held.append((i, hashes[at:at + (1 << 16)]))
            waiting += len(held[-1][1])
            if waiting >= 1 << 16:
                add_up()
                waiting = 0
    if held:
        add_up()
    sizes = np.array([len(s) for s in sets]).reshape(-1, 1, 1)
    if len(sets):
        out = np.packbits(2 * sums > sizes, axis=2, bitorder="little").view(np.uint64).reshape(len(sets), words)
    return out


def codes(docs: DataFrame, key: str, text: str, config: SimilarConfig) -> DataFrame:
    """key, fp (a name of 128 bits of the set of shingles) and code for every row."""
    rows = small_batches(narrow(docs, key=key, text=text))
    schema = rows.select("key", F.lit(b"").alias("fp"), F.lit(b"").alias("code")).schema

    def run(batches):
        for part in slices(batches, "text", 1 << 18):
            sets = [shingle_set(t, config.shingle) for t in part.column("text").to_pylist()]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            made = [row.tobytes() for row in codes_of(sets, config.words)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(names, pa.binary()), pa.array(made, pa.binary())], names=["key", "fp", "code"])

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of unsigned words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


# ---- thresholds --------------------------------------------------------------------------------------
class Aimed:
    """Thresholds that reach a wanted recall. Parts are (word, bits of the word); their values are counted by the first
    `counted` bits, which bounds all tables, and counts are spread evenly over the values that share them."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], counts: np.ndarray, config: SimilarConfig) -> None:
        self.words, self.parts = zip(*parts, strict=True)
        self.head = np.uint32((1 << config.counted) - 1)
        rest = config.width - config.counted
        self.masks = [_masks(config.width, r) for r in (0, 1)]
        self.costs = []
        for of_part in counts:
            within = ball_counts(of_part.astype(np.float64), 1)
            near = np.stack([within[0], within[1] + rest * within[0]]) / 2.0**rest
            self.costs.append((near + np.array([[len(m)] for m in self.masks])).astype(np.float32))
        unit = config.gain(0)
        self.gains = [0, *(int(config.gain(t) / unit) for t in (0, 1))]
        self.goal = math.ceil(-math.log1p(-config.recall) / unit)
        if len(parts) * self.gains[-1] < self.goal:
            raise ValueError("too few parts for the wanted recall")

    def values(self, code: np.ndarray) -> np.ndarray:
        return np.column_stack([part_values(code[:, w], [bits])[:, 0] for w, bits in zip(self.words, self.parts, strict=True)])

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """For each row the thresholds (-1: skip) of least cost whose gains reach the goal."""
        n, m = values.shape
        best = np.full((n, self.goal + 1), np.inf, np.float32)
        best[:, 0] = 0
        picks = []
        for p in range(m):
            head = values[:, p] & self.head
            new, pick = best.copy(), np.zeros(best.shape, np.int8)
            for k in (1, 2):
                before = np.maximum(np.arange(self.goal + 1) - self.gains[k], 0)
                tried = best[:, before] + self.costs[p][k - 1][head][:, None]
                better = tried < new
                new[better], pick[better] = tried[better], k
            best = new
            picks.append(pick)
        out, left = np.zeros((n, m), np.int8), np.full(n, self.goal)
        for p in range(m - 1, -1, -1):
            k = picks[p][np.arange(n), left]
            out[:, p] = k - 1
            left = np.maximum(left - np.array(self.gains)[k], 0)
        return out

    def probes_of(self, values: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, values, rows) that are probed."""
        for p in range(len(self.parts)):
            for r, mask in enumerate(self.masks):
                rows = np.flatnonzero(chosen[:, p] == r)
                if len(rows):
                    yield p, (values[rows, p][:, None] ^ mask[None, :]).ravel(), np.repeat(rows, len(mask))


# ---- links -------------------------------------------------------------------------------------------
def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _forest(code: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of row numbers that span the components under distance <= radius; fewer than there are rows."""
    free, found = np.arange(len(code)), []
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            at = front.pop()
            near = _apart(code[free], code[at]) <= radius
            if near.any():
                reached = free[near]
                found.append(np.column_stack([np.full(len(reached), at), reached]))
                front.extend(reached)
                free = free[~near]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _near_rows(group: np.ndarray, code: np.ndarray, radius: int, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers within groups; small groups are compared together, by their distance in order.

    Also the tree of every row (-1: none) that has pairs beside the edges of its tree: a tree of a large group with three rows
    or more. Trees are named by their first row.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    few = np.flatnonzero(np.repeat(sizes <= small, sizes))
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, min(small, len(few))):
        left, right = few[:-step], few[step:]
        same = group[left] == group[right]
        left, right = left[same], right[same]
        if not len(left):
            break
        close = _apart(code[left], code[right]) <= radius
        found.append(np.column_stack([left[close], right[close]]))
    trees = np.full(len(group), -1)
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        edges = s + _forest(code[s:s + n], radius)
        found.append(edges)
        top = np.arange(s, s + n)
        for parent, child in edges:  # a parent is reached before its children
            top[child - s] = top[parent - s]
        held = np.bincount(top - s, minlength=n)[top - s] > 2
        trees[s:s + n][held] = top[held]
    return np.concatenate(found), trees


def _forests(config: SimilarConfig):
    """Edges (a, b), and members (tree, a, code) of the trees that have other pairs too."""

    def emit(group: np.ndarray, names: list[bytes], code: np.ndarray) -> Iterator[pa.RecordBatch]:
        near, trees = _near_rows(group, code, config.radius)
        pairs = {tuple(sorted((names[i], names[j]))) for i, j in near if names[i] != names[j]}
        ends = list(zip(*pairs, strict=True)) if pairs else [(), ()]
        held = np.flatnonzero(trees >= 0)
        # The name of a tree: of its group and its first member.
        tops = [xxhash.xxh3_64_intdigest(names[t] + int(group[t]).to_bytes(8, "little", signed=True)) for t in trees[held]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(e, pa.binary()) for e in ends), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.binary())], names=["a", "b", "tree", "code"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in held], pa.binary()), pa.nulls(len(held), pa.binary()), pa.array(np.array(tops, np.uint64).view(np.int64)),
             pa.array([code[i].tobytes() for i in held], pa.binary())], names=["a", "b", "tree", "code"])

    def run(batches):
        group, names, code = np.zeros(0, np.int64), [], np.zeros((0, config.compared), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.r_[group, batch.column("g").to_numpy()]
            names = names + batch.column("fp").to_pylist()
            code = np.concatenate([code, _matrix(batch.column("code"))])
            # The last group may go on in the next batch.
            whole = int(np.argmax(group == group[-1]))
            if whole >= 1 << 14:
                yield from emit(group[:whole], names, code[:whole])
                group, names, code = group[whole:], names[whole:], code[whole:]
        if len(group):
            yield from emit(group, names, code)

    return run


def _apart_pairs(radius: int, nearest: int | None):
    """Pairs of near codes of a tree whose ends have different roots: the nearest of each member, or all (None)."""

    def of_tree(names: np.ndarray, roots: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists: list[tuple[int, np.ndarray]] = []
        waiting = 0
        for i in range(len(names)):
            far = _apart(code, code[i])
            other = np.flatnonzero((far <= radius) & (roots != roots[i]) & (np.arange(len(names)) > i if nearest is None else True))
            if nearest is not None:
                other = other[np.argsort(far[other], kind="stable")[:nearest]]
            lists.append((i, other))
            waiting += len(other)
            if waiting >= 1 << 14 or (i == len(names) - 1 and waiting):
                x = np.repeat([i for i, _ in lists], [len(o) for _, o in lists])
                y = np.concatenate([o for _, o in lists])
                turned = names[x] > names[y]
                ends = np.where(turned, names[y], names[x]), np.where(turned, names[x], names[y])
                yield pa.RecordBatch.from_arrays([pa.array(e.tolist(), pa.binary()) for e in ends], names=["a", "b"])
                lists, waiting = [], 0

    def run(batches):
        held: list[pa.RecordBatch] = []

        def cut(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks()
            tree = rows.column("tree").to_numpy()
            starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            done = len(starts) if last else len(starts) - 1
            for start, stop in zip(starts[:done], np.r_[starts[1:], len(tree)], strict=False):
                part = rows.slice(start, stop - start).combine_chunks()
                names, roots = (np.array(part.column(c).to_pylist(), object) for c in ("a", "root"))
                yield from of_tree(names, roots, _matrix(part.column("code").chunk(0)))
            held[:] = [] if last else rows.slice(starts[-1]).to_batches()

        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= 1 << 14:
                yield from cut(False)
                waiting = 0
        if held:
            yield from cut(True)

    return run


def left_out(trees: DataFrame, roots: DataFrame, tried: DataFrame, config: SimilarConfig, nearest: int | None) -> DataFrame:
    """a, b: pairs of near codes within trees (tree, a, code) whose ends (node, root) are not linked and that were not tried."""
    width = shuffle_width(trees.sparkSession)
    rooted = trees.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    # Most trees were linked as a whole; they are not dealt out again.
    open_trees = rooted.groupBy("tree").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("tree")
    dealt = rooted.join(open_trees, "tree", "left_semi").select("tree", "a", "root", "code").repartition(width, "tree").sortWithinPartitions("tree", "a")
    return dealt.mapInArrow(_apart_pairs(config.radius, nearest), "a binary, b binary").distinct().join(tried, ["a", "b"], "left_anti")


def near_codes(distinct: DataFrame, config: SimilarConfig = SimilarConfig()) -> DataFrame:
    """a, b: forests of near codes; and tree, a, code: the members of trees that leave pairs out, with b null. `distinct` has one row (fp, code) per different item.

    To the driver come counts of bit pairs and at most 2^counted counts per part, whatever the number of items.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    parts: list[tuple[int, np.ndarray]] = []

    def count_pairs(batches):
        sums = np.zeros((config.words, simhash.BITS**2), np.int64)
        for batch in batches:
            code = _matrix(batch.column("code")) if batch.num_rows else np.zeros((0, config.words), np.uint64)
            for w in range(config.words):
                word = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(code[:, w]).view(np.int64))], names=["fp"])
                for made in _pair_counts([word]):
                    sums[w] += made.column("n").to_numpy()
        yield from _nonzero(sums)

    def summed(counts, kinds: int, values: int) -> np.ndarray:
        """The counts of all tasks, as kinds x values sums."""
        out = np.zeros((kinds, values), np.int64)
        found = distinct.select("code").mapInArrow(counts, _COUNTS).groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
        out[found["part"], found["value"]] = found["n"]
        return out

    counted = summed(count_pairs, config.words, simhash.BITS**2)
    for w in range(config.words):
        of_word = counted[w].reshape(simhash.BITS, simhash.BITS)
        parts += [(w, bits) for bits in grouped_bits(of_word, n, 64 // config.width)]
    heads = 1 << config.counted
    head = np.uint32(heads - 1)

    def count_values(batches):
        sums = np.zeros((len(parts), heads), np.int64)
        for batch in batches:
            if batch.num_rows:
                code = _matrix(batch.column("code"))
                for p, (w, bits) in enumerate(parts):
                    sums[p] += np.bincount(part_values(code[:, w], [bits])[:, 0] & head, minlength=heads)
        yield from _nonzero(sums)

    owned = summed(count_values, len(parts), heads)
    aimed = spark.sparkContext.broadcast(Aimed(parts, owned, config))

    def count_probes(batches):
        sums = np.zeros((len(parts), heads), np.int64)
        for batch in batches:
            if batch.num_rows:
                values = aimed.value.values(_matrix(batch.column("code")))
                for p, probed, _ in aimed.value.probes_of(values, aimed.value.thresholds(values)):
                    sums[p] += np.bincount(probed & head, minlength=heads)
        yield from _nonzero(sums)

    asked = summed(count_probes, len(parts), heads)
    splits = spark.sparkContext.broadcast((np.maximum(1, -(-asked // config.block)), np.maximum(1, -(-owned // config.block)), asked > 0))

    def members(batches):
        """g: the group a member belongs to, a hash of part, value and block numbers; equal hashes only add comparisons."""
        by_role = splits.value
        for batch in batches:
            if not batch.num_rows:
                continue
            code, names = _matrix(batch.column("code")), _matrix(batch.column("fp"))
            values = aimed.value.values(code)
            chosen = aimed.value.thresholds(values)
            roles = [(p, v, rows, 0) for p, v, rows in aimed.value.probes_of(values, chosen)]
            roles += [(p, values[:, p], np.arange(len(code)), 1) for p in range(len(parts))]
            groups, takers = [], []
            for p, v, rows, role in roles:
                at_head = v & head
                own, copies = by_role[role][p][at_head], by_role[1 - role][p][at_head]
                if role == 1:  # left out where nobody asks, or where the row is there as a prober already
                    wanted = by_role[2][p][at_head] & ~((chosen[rows, p] >= 0) & (own == 1) & (copies == 1))
                    v, rows, own, copies = v[wanted], rows[wanted], own[wanted], copies[wanted]
                block = _mix(names[rows, 0]) % own.astype(np.uint64)
                at = np.repeat(np.arange(len(v)), copies)
                other = (np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)).astype(np.uint64)
                probe, owner = (block[at], other) if role == 0 else (other, block[at])
                groups.append(_mix(_mix(v[at].astype(np.uint64) << np.uint64(8) | np.uint64(p)) ^ _mix(probe << np.uint64(32) | owner)))
                takers.append(rows[at])
            taken = np.concatenate(takers)
            made = np.concatenate(groups).view(np.int64)
            short = pa.array([row.tobytes() for row in np.ascontiguousarray(code[:, :config.compared])], pa.binary())
            for s in range(0, len(taken), 1 << 14):
                rows = pa.array(taken[s:s + (1 << 14)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[s:s + (1 << 14)]), batch.column("fp").take(rows), short.take(rows)], names=["g", "fp", "code"])

    dealt = distinct.select("fp", "code").mapInArrow(members, "g long, fp binary, code binary")
    dealt = dealt.repartition(shuffle_width(spark), "g").sortWithinPartitions("g", "fp")
    return dealt.mapInArrow(_forests(config), "a binary, b binary, tree long, code binary").distinct()


def _verified(pairs: DataFrame, config: SimilarConfig) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose sets of shingles reach the similarity, with it."""

    def run(batches):
        out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
        for whole in batches:
            for part in slices(iter([whole]), "text_b", 1 << 20):
                likeness = []
                for x, y in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                    left, right = shingle_set(x, config.shingle), shingle_set(y, config.shingle)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    likeness.append(both / max(1, len(left) + len(right) - both))
                kept = np.flatnonzero(np.array(likeness) >= config.similarity)
                if len(kept):
                    yield batch_of(out, [part.column("a").take(pa.array(kept)), part.column("b").take(pa.array(kept)), np.array(likeness)[kept]])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _rooted(docs: DataFrame, key: str, text: str, distinct: DataFrame, config: SimilarConfig) -> DataFrame:
    """node, root for every item that has a link."""
    found = written(near_codes(distinct, config), "similar-edges")
    edges, trees = found.filter("b IS NOT NULL").select("a", "b"), found.filter("b IS NULL").select("tree", "a", "code")
    ends = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    wanted = distinct.join(ends, "fp", "left_semi").select("fp", F.col("least").alias("_least"))
    named = narrow(docs, _key=key, text=text)
    texts = named.join(wanted, F.col("_key").eqNullSafe(F.col("_least"))).groupBy("fp").agg(F.min("text").alias("text"))
    texts = written(texts, "similar-texts")
    a, b = (texts.select(F.col("fp").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    verify = lambda pairs: written(_verified(pairs.join(a, "a").join(b, "b"), config), "similar-links")
    roots, tried = components(verify(edges)), edges
    # A refused edge splits a tree; what the tree left out may still link its parts.
    for nearest in (NEAREST, None):
        more = written(left_out(trees, roots, tried, config, nearest), "similar-more")
        if more.isEmpty():
            break
        roots, tried = joined(roots, verify(more)), tried.unionByName(more)
    return roots


def classes(docs: DataFrame, key: str, text: str, config: SimilarConfig = SimilarConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """key, fp of every row; fp, root of every item; root, component_id (the least key) of every component.

    `key` must tell different texts apart.
    """
    table = written(codes(docs, key, text, config), "similar")
    distinct = written(table.groupBy("fp").agg(F.min("key").alias("least"), F.min("code").alias("code")), "similar-distinct")
    roots = _rooted(docs, key, text, distinct, config).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return table.select("key", "fp"), rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("least").alias("component_id"))
