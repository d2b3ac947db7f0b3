"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints are one item from the start. The 64 bits are dealt to parts of equal width, correlated bits to the same
part. If a part i is given a threshold t_i and the t_i sum to RADIUS - parts + 1 (-1: skip the part), then two fingerprints
at most RADIUS bits apart agree on some part i up to t_i bits. Every fingerprint chooses its own thresholds: dynamic
programming over the parts finds those with the least estimated number of candidates, so part values that very many
fingerprints share are skipped or probed exactly while rare ones get the larger radius. It then probes all values within
t_i of its own; a value nobody has is not probed. Probers and owners of a value meet in one group and are verified.

A group does not emit its pairs: it emits a spanning forest of the links among its members, fewer rows than it read. Groups
larger than `block` are split into blocks of probers times blocks of owners, so that no task holds one as a whole.

Defined cases: null text and texts without words have fingerprint zero and are linked like any other. Null ids take part;
they name a component only if it has no other id. Repeated rows get the same component. Empty tables give empty results,
extra columns are not read, and texts of any length are hashed whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, narrow, shuffle_width, slices, small_batches
from seekspark.llm.graph import components
from seekspark.session import written

BITS = 64
#: Values of a part are counted by their first COUNTED bits, which bounds every table of counts.
COUNTED = 16


@dataclass(frozen=True)
class SimhashConfig:
    """shingle words per shingle; radius: bits that linked fingerprints may differ in; parts: 4 up to some 1e8 different
    fingerprints, 3 beyond (fewer candidates, more probes). block bounds what a task holds of one group."""

    shingle: int = 4
    radius: int = 4
    seed: int = 42
    parts: int = 4
    block: int = 8192


# ---- fingerprints ------------------------------------------------------------------------------------
def _words(text: str, piece: int = 1 << 18) -> Iterator[list[bytes]]:
    """Lower-cased words (A-Z only; words end at ASCII white space), in bounded lists."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= piece:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = at + piece
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included; a text with fewer words is one shingle, one without words none."""
    held: list[bytes] = []
    short = True
    for words in _words(text):
        words = held + words
        if len(words) >= shingle:
            short = False
            joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, len(words) - shingle + 1)
            held = words[len(words) - shingle + 1:]
        else:
            held = words
    if short and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprints_of(texts: list[str | None], config: SimhashConfig) -> np.ndarray:
    """Unsigned fingerprints: a bit is 1 if it is set in over half of the hashes."""
    sums, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    pieces, owners, held = [], [], 0

    def add_up() -> None:
        lengths = np.array([len(p) for p in pieces])
        bits = np.unpackbits(np.concatenate(pieces).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(sums, owners, np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64))
        np.add.at(sizes, owners, lengths)

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text or "", config.shingle, config.seed):
            pieces.append(hashes)
            owners.append(i)
            held += len(hashes)
            if held >= 1 << 16:
                add_up()
                pieces, owners, held = [], [], 0
    if pieces:
        add_up()
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """key, fp (as a signed long) for every row."""
    rows = small_batches(narrow(docs, key=key, text=text))
    schema = rows.select("key", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for part in slices(batches, "text", 1 << 18):
            made = fingerprints_of(part.column("text").to_pylist(), config).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made)], names=["key", "fp"])

    return rows.mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- parts and thresholds ----------------------------------------------------------------------------
def _pair_counts(batches):
    """Sums of bit i and bit j, for all i and j, over the batches of a task."""
    out = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
    sums = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(fps[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield batch_of(out, [i.astype(np.int32), j.astype(np.int32), sums.ravel()])


def grouped_bits(pair_counts: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """Deals the bits to parts of (nearly) equal width, each part grown around the most correlated bits that are left."""
    share = pair_counts / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        related = np.abs((share - np.outer(mean, mean)) / np.outer(spread, spread))
    related = np.nan_to_num(related, nan=1.0, posinf=1.0)  # bits that never change belong together
    np.fill_diagonal(related, 0.0)
    free, out = list(range(BITS)), []
    for part in range(parts):
        width = len(free) // (parts - part)
        inner = related[np.ix_(free, free)]
        chosen = [free[int(inner.sum(axis=1).argmax())]] if free else []
        while len(chosen) < width:
            rest = [b for b in free if b not in chosen]
            chosen.append(rest[int(related[np.ix_(rest, chosen)].sum(axis=1).argmax())])
        free = [b for b in free if b not in chosen]
        out.append(np.array(sorted(chosen)))
    return out


def part_values(fps: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """One column of values per part; the bits of a part in its order, least significant first."""
    out = np.zeros((len(fps), len(parts)), np.uint32)
    for p, bits in enumerate(parts):
        for place, bit in enumerate(bits):
            out[:, p] |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.uint32) << np.uint32(place)
    return out


def ball_counts(counts: np.ndarray, radius: int) -> np.ndarray:
    """counts[v] -> table[r, v]: how many lie within r bits of v, for r = 0..radius."""
    shells = np.zeros((radius + 1, len(counts)))
    shells[0] = counts
    for bit in range(int(np.log2(len(counts)))):
        other = np.arange(len(counts)) ^ (1 << bit)
        for r in range(radius, 0, -1):
            shells[r] += shells[r - 1][other]
    return np.cumsum(shells, axis=0)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out if 0 <= k <= n else 0


@dataclass
class Allocation:
    """Parts of the bits, counts of their values and what follows from them."""

    parts: list[np.ndarray]
    counts: np.ndarray
    radius: int

    def __post_init__(self) -> None:
        self.masks, self.costs, self.exact = [], [], []
        for p, bits in enumerate(self.parts):
            width = len(bits)
            counted = min(width, COUNTED)
            balls = ball_counts(self.counts[p][: 1 << counted].astype(np.float64), self.radius)
            shells = np.diff(balls, axis=0, prepend=0)
            beyond = [_choose(width - counted, r) / 2.0 ** (width - counted) for r in range(self.radius + 1)]
            near = np.cumsum([sum(shells[a] * beyond[r - a] for a in range(r + 1)) for r in range(self.radius + 1)], axis=0)
            probes = np.cumsum([_choose(width, r) for r in range(self.radius + 1)])
            self.costs.append(near + probes[:, None])  # a probe costs about as much as a candidate
            self.exact.append(counted == width)
            self.masks.append([_masks(width, r) for r in range(self.radius + 1)])

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """For each row of part values the thresholds (-1: skip) with the least cost; they sum to radius - parts + 1."""
        n, m = values.shape
        goal = self.radius + 1  # thresholds plus one, summed
        best = np.full((n, goal + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for p in range(m):
            head = values[:, p] & np.uint32((1 << min(len(self.parts[p]), COUNTED)) - 1)
            cost = np.vstack([np.zeros(n), self.costs[p][:, head]])  # row k: threshold k - 1
            new, pick = np.full((n, goal + 1), np.inf), np.zeros((n, goal + 1), np.int8)
            for total in range(goal + 1):
                for k in range(total + 1):
                    tried = best[:, total - k] + cost[k]
                    better = tried < new[:, total]
                    new[better, total], pick[better, total] = tried[better], k
            best = new
            picks.append(pick)
        out, left = np.zeros((n, m), np.int64), np.full(n, goal)
        for p in range(m - 1, -1, -1):
            k = picks[p][np.arange(n), left]
            out[:, p], left = k - 1, left - k
        return out

    def probes(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, values, fingerprints) that the fingerprints probe; values known to have no other owner are left out."""
        values = part_values(fps, self.parts)
        chosen = self.thresholds(values)
        for p in range(len(self.parts)):
            for r in range(self.radius + 1):
                rows = np.flatnonzero(chosen[:, p] == r)
                for mask in np.array_split(self.masks[p][r], max(1, len(rows) * len(self.masks[p][r]) >> 20)) if len(rows) else ():
                    probed = (values[rows, p][:, None] ^ mask[None, :]).ravel()
                    owner = np.repeat(fps[rows], len(mask))
                    if self.exact[p]:
                        own = np.tile(mask == 0, len(rows))
                        useful = self.counts[p][probed] > own
                        probed, owner = probed[useful], owner[useful]
                    yield p, probed, owner


def _masks(width: int, radius: int) -> np.ndarray:
    """All changes of at most radius of the width bits."""
    out, last = [np.zeros(1, np.uint32)], [(0, -1)]
    for _ in range(radius):
        last = [(m | 1 << b, b) for m, top in last for b in range(top + 1, width)]
        out.append(np.array([m for m, _ in last], np.uint32))
    return np.concatenate(out)


# ---- links -------------------------------------------------------------------------------------------
def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges (k x 2) that span the components of `fps` under distance <= radius; fewer than there are fingerprints."""
    free = np.unique(fps)
    edges = []
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            at = front.pop()
            near = np.bitwise_count(free ^ at) <= radius
            if near.any():
                reached = free[near]
                edges.append(np.column_stack([np.full(len(reached), at), reached]))
                front.extend(reached)
                free = free[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)


def _forests(config: SimhashConfig):
    """Rows sorted by group -> the groups' forests. Small groups are compared together, vectorised by their distance in order."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group: np.ndarray, fps: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        found = []
        small = np.repeat(sizes <= 12, sizes)
        g, f = group[small], fps[small]
        for step in range(1, 12):
            if len(g) <= step:
                break
            close = (g[step:] == g[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= config.radius)
            found.append(np.column_stack([f[:-step][close], f[step:][close]]))
        for s, n in zip(starts[sizes > 12], sizes[sizes > 12], strict=True):
            found.append(forest(fps[s:s + n], config.radius))
        return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)

    def emit(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        pairs = links(group, fps)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].astype(np.uint64)
        low, high = pairs.min(axis=1, initial=2**64 - 1), pairs.max(axis=1, initial=0)
        if len(pairs):
            low, high = np.unique(np.column_stack([low, high]), axis=0).T
        return batch_of(out, [np.ascontiguousarray(low).view(np.int64), np.ascontiguousarray(high).view(np.int64)])

    def run(batches):
        group, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.r_[group, batch.column("g").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            # The last group may go on in the next batch.
            whole = np.searchsorted(group == group[-1], True) if len(group) else 0
            if whole >= 1 << 14:
                yield emit(group[:whole], fps[:whole])
                group, fps = group[whole:], fps[whole:]
        if len(group):
            yield emit(group, fps)

    return run


def links(distinct: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """a, b: edges that connect exactly the fingerprints connected by links of at most radius bits.

    `distinct` is a table with one row per different fingerprint `fp`. To the driver come 64 x 64 bit counts and at most
    2^COUNTED counts per part, whatever the number of fingerprints.
    """
    if not 1 <= config.parts <= config.radius + 1:
        raise ValueError("parts must lie between 1 and radius + 1")
    spark = distinct.sparkSession
    n = distinct.count()
    pairs = distinct.mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    counted = np.zeros((BITS, BITS), np.int64)
    counted[pairs["i"], pairs["j"]] = pairs["n"]
    parts = grouped_bits(counted, n, config.parts)

    def count_values(batches):
        sums = np.zeros((len(parts), 1 << COUNTED), np.int64)
        for batch in batches:
            values = part_values(batch.column("fp").to_numpy().view(np.uint64), parts) & np.uint32((1 << COUNTED) - 1)
            for p in range(len(parts)):
                sums[p] += np.bincount(values[:, p], minlength=1 << COUNTED)
        yield from _nonzero(sums)

    owners = spark.sparkContext.broadcast(Allocation(parts, _gathered(distinct.mapInArrow(count_values, _COUNTS), len(parts)), config.radius))

    def count_probes(batches):
        sums = np.zeros((len(parts), 1 << COUNTED), np.int64)
        for batch in batches:
            for p, values, _ in owners.value.probes(batch.column("fp").to_numpy().view(np.uint64)):
                sums[p] += np.bincount(values & np.uint32((1 << COUNTED) - 1), minlength=1 << COUNTED)
        yield from _nonzero(sums)

    asked = _gathered(distinct.mapInArrow(count_probes, _COUNTS), len(parts))
    splits = spark.sparkContext.broadcast((
        np.maximum(1, -(-asked // config.block)), np.maximum(1, -(-owners.value.counts // config.block))))

    def members(batches):
        """g: the group a member belongs to, a hash of part, value and block numbers; equal hashes only add comparisons."""
        out = pa.schema([("g", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            values = part_values(fps, parts)
            roles = [(p, v, f, 0) for p, v, f in owners.value.probes(fps)] + [(p, values[:, p], fps, 1) for p in range(len(parts))]
            for p, v, f, role in roles:
                head = v & np.uint32((1 << COUNTED) - 1)
                if role == 1:  # nobody asks for these
                    wanted = asked[p][head] > 0
                    v, f, head = v[wanted], f[wanted], head[wanted]
                own, copies = splits.value[role][p][head], splits.value[1 - role][p][head]
                block = _mix(f) % own.astype(np.uint64)
                at = np.repeat(np.arange(len(v)), copies)
                other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                probe, owner = (block[at], other) if role == 0 else (other, block[at])
                g = _mix(_mix(v[at].astype(np.uint64) << np.uint64(8) | np.uint64(p)) ^ _mix(
                    probe.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)))
                yield batch_of(out, [g.view(np.int64), f[at].view(np.int64)])

    dealt = distinct.mapInArrow(members, "g long, fp long").repartition(shuffle_width(spark), "g").sortWithinPartitions("g", "fp")
    return dealt.mapInArrow(_forests(config), "a long, b long").distinct()


_COUNTS = "part int, value int, n long"


def _nonzero(sums: np.ndarray):
    out = pa.schema([("part", pa.int32()), ("value", pa.int32()), ("n", pa.int64())])
    for p in range(len(sums)):
        at = np.flatnonzero(sums[p])
        yield batch_of(out, [np.full(len(at), p, np.int32), at.astype(np.int32), sums[p][at]])


def _gathered(rows: DataFrame, parts: int) -> np.ndarray:
    """At most parts x 2^COUNTED sums."""
    out = np.zeros((parts, 1 << COUNTED), np.int64)
    found = rows.groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    out[found["part"], found["value"]] = found["n"]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- classes -----------------------------------------------------------------------------------------
def _classes(docs: DataFrame, key: str, text: str, config: SimhashConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """key, fp of every row; fp, root of every fingerprint; root, component_id (the least key) of every component."""
    table = written(fingerprints(docs, key, text, config), "simhash")
    distinct = written(table.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), config)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return table, rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least id of the documents reachable over links."""
    table, rooted, named = _classes(docs, key, text, config)
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return table.join(by_fp, "fp").select(F.col("key").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _row_key(columns: list[str]) -> Column:
    """Equal for equal rows only; sorts by id, null ids last. Nulls are told apart from values, as the hash passes them over."""
    rest = [c for c in columns if c not in ("doc_id", "text")]
    marks = [f(F.col(f"`{c}`")) for c in rest for f in (lambda x: x, F.isnull)]
    return F.struct(
        F.isnull("doc_id").alias("unnamed"), F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("text"),
        F.xxhash64(F.lit(0), *marks).alias("rest"))


def one_of_each(
    docs: DataFrame, columns: list[str], config=SimhashConfig(), unnamed_apart: bool = True, classes: Callable = _classes,
) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest id, of several those the first by a hash of the
    text and of the other columns. Rows that are equal in all columns stay once. Null ids come last; with `unnamed_apart` one
    of a group's rows without an id stays beside the one with the smallest id. `classes` says what links documents; it gets
    `config`."""
    names = [f"`{c}`" for c in columns]
    keyed = docs.select(*names, _row_key(columns).alias("_row"))
    table, rooted, named = classes(keyed, "_row", "text", config)
    winners = named.select(F.col("component_id").alias("_row"))
    if unnamed_apart:
        unnamed = table.filter("key.unnamed").groupBy("fp").agg(F.min("key").alias("least")).join(rooted, "fp")
        winners = winners.union(unnamed.groupBy("root").agg(F.min("least").alias("_row")).select("_row")).distinct()
    winners = written(winners, "simhash-kept")
    kept = _among(keyed, winners)
    repeated = _among(table.groupBy(F.col("key").alias("_row")).count().filter("count > 1").select("_row"), winners)
    repeated = written(repeated, "simhash-repeated")
    if not repeated.isEmpty():
        kept = _among(kept, repeated, "left_anti").unionByName(_among(kept, repeated).dropDuplicates(["_row"]))
    return kept.select(*names)


def _among(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    named = keys.select(F.col("_row").alias("_key"))
    return rows.join(named, F.col("_row") == F.col("_key"), how)
