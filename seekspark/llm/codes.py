"""Vector code compression: one byte for each part of a vector, its codebook's nearest entry; codebooks by active-entry Lloyd.

Components become integers, floor(SCALE * x). Every vector is cut into PARTS equal consecutive parts. A part position's
codebook starts as that part of the ENTRIES vectors of smallest id. A round assigns every part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to the componentwise floored mean of its parts; an entry without
parts stays.

Active entries: a part keeps its entry and its exact distance from round to round, as a table. Where the entry has not moved,
no entry that has not moved either can have come nearer, nor taken over a tie; so only moved entries are compared with the
kept distance. Where the entry has moved, the part is scanned against all. Both give what a full scan gives.

Each round is one narrow pass that writes its table, and one aggregation of at most ENTRIES x PARTS sums a task. The driver
holds the codebooks: ENTRIES vectors, whatever the number of rows.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; nor do those of another
length than the vector of smallest id (null ids last). A length that PARTS does not divide is filled up with zeros.
Repeated rows are rows. Fewer than ENTRIES vectors make smaller codebooks; no vector, no rows. Integer components are
bounded so that sums of squares fit a long: at 64 components by 2^27, a component of 131,072. Labels of any type count as
equal as Spark groups them, nulls together; a label's error saturates at the greatest long. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import narrow, once
from seekspark.session import shared_folder, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
ROWS = 2048
SALTS = 16
EXACT = 1 << 52
TOP_LONG = (1 << 63) - 1


def component_bound(dims: int) -> int:
    """A power of two such that `dims` squared differences of components below it sum up to less than 2^62."""
    return 1 << ((60 - max(0, dims - 1).bit_length()) // 2)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    width = max(1, x.shape[1])
    if 4 * width * max(1, int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)  # every term and sum is an integer below 2^53
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(axis=1)
    return out


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None, code: np.ndarray | None, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and distances. With the last round's, only what can have changed is compared.

    moved: which entries have moved since the distances were taken; None at first.
    """
    if moved is None:
        near = distances(x, entries)
        code = near.argmin(axis=1)
        return code, np.take_along_axis(near, code[:, None], 1)[:, 0]
    code, kept = code.copy(), kept.copy()
    lost = np.flatnonzero(moved[code])
    still = np.flatnonzero(~moved[code])
    active = np.flatnonzero(moved)
    if len(lost):
        code[lost], kept[lost] = assign(x[lost], entries, None, None, None)
    if len(still) and len(active):
        near = distances(x[still], entries[active])
        best = near.argmin(axis=1)
        least, index = np.take_along_axis(near, best[:, None], 1)[:, 0], active[best]
        wins = (least < kept[still]) | ((least == kept[still]) & (index < code[still]))
        code[still[wins]], kept[still[wins]] = index[wins], least[wins]
    return code, kept


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


STATE = "_vector array<int>, _codes array<int>, _near array<bigint>"


def _parts(vectors: np.ndarray) -> np.ndarray:
    """rows x PARTS x width."""
    return vectors.reshape(len(vectors), PARTS, -1).astype(np.int64)


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, name: str) -> DataFrame:
    """The state with parts assigned to `books` (PARTS x entries x width), as a table."""
    keys = [c for c in state.columns if not c.startswith("_")]
    dims = books.shape[0] * books.shape[2]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _parts(_lists(part.column("_vector"), dims))
                code, near = np.zeros((2, len(x), PARTS), np.int64)
                if moved is not None:
                    code, near = _lists(part.column("_codes"), PARTS).astype(np.int64), _lists(part.column("_near"), PARTS)
                fresh = [assign(x[:, p], books[p], None if moved is None else moved[p], code[:, p], near[:, p]) for p in range(PARTS)]
                code, near = (np.stack([f[i] for f in fresh], axis=1) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), part.column("_vector"), _listed(code.astype(np.int32)), _listed(near)], names=[*keys, "_vector", "_codes", "_near"])

    schema = state.select(*keys, *[F.lit(None).cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in STATE.split(", ")]).schema
    return written(state.mapInArrow(run, schema), name)


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floored means of the parts of each entry; entries without parts as they are."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, code = _parts(_lists(part.column("_vector"), parts * width)), _lists(part.column("_codes"), parts)
                number = (code + np.arange(parts) * entries).ravel()
                np.add.at(total, number, x.reshape(-1, width))
                count += np.bincount(number, minlength=parts * entries)
                rows += len(x)
        held = np.flatnonzero(count)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), _listed(total[held])], names=["at", "n", "total"])

    partial = state.select("_vector", "_codes").mapInArrow(sums, "at bigint, n bigint, total array<bigint>")
    whole = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("total"))
    fresh = books.copy()
    for row in whole.collect():  # at most one for each entry
        fresh[row["at"] // entries, row["at"] % entries] = [int(t) // row["n"] for t in row["total"]]
    return fresh


def _components(vectors: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Kept vectors as integers (`_vector`), and their length."""
    rows = once(vectors, "_double", F.transform("_embedding", lambda x: x.cast("double"))).drop("_embedding")
    usable = F.col("_double").isNotNull() & (F.size("_double") > 0) & F.forall("_double", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(usable)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_double").select(F.size("_double").alias("n")).first()
    dims = first["n"] if first else 0
    padded = -(-dims // PARTS) * PARTS
    bound = float(component_bound(padded))
    # A power of two scales without rounding; what it scales beyond the doubles is bounded like all that is large.
    whole = F.transform("_double", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), x * SCALE))))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), padded - dims))
    return rows.filter(F.size("_double") == dims).select(*keys, filled.alias("_vector")), padded


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    kept, dims = _components(narrow(vectors, vec_id=vec_id, label=label, _embedding=embedding), ["vec_id", "label"])
    none = "code string, error bigint, label_error bigint, codebooks_sha256 string"
    if not dims:
        return kept.select("vec_id", *[F.lit(None).cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in none.split(", ")]).limit(0)
    state = written(kept, "vectors")
    seed = [r["_vector"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "_vector").limit(ENTRIES).collect()]
    books = np.ascontiguousarray(_parts(np.array(seed, np.int64)).transpose(1, 0, 2))
    moved = None
    for number in range(rounds + 1):
        state = _round(state, books, moved, f"codes-{number}")
        if number < rounds:
            fresh = _moved_books(state, books)
            moved, books = (fresh != books).any(axis=2), fresh
    return _report(state, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def _report(state: DataFrame, digest: str) -> DataFrame:
    error = F.aggregate("_near", F.lit(0).cast("bigint"), lambda a, x: a + x)
    code = F.array_join(F.transform("_codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = state.select("vec_id", "label", code.alias("code"), error.alias("error"), F.pmod(F.xxhash64("vec_id", "_vector"), F.lit(SALTS)).cast("int").alias("_salt"))
    # A label may hold a third of all rows: its sum, one row, is repeated for each salt.
    sums = state.groupBy("label").agg(F.least(F.sum(error.cast("decimal(38,0)")), F.lit(TOP_LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(rounds: int = ROUNDS) -> str:
    """The same with every part compared with every entry in every round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, p, x, (best % {ENTRIES})::INT AS e, best // {ENTRIES} AS d FROM (
  SELECT r, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * {ENTRIES} + e) AS best
  FROM parts JOIN c{n} USING (p) GROUP BY r, p))""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
  SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e),
c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
k AS (SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM f JOIN kept USING (r))
SELECT *, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{rounds})) AS codebooks_sha256 FROM k
"""
