"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Targets: sources weigh by their place in code-point order (null last) and share `budget` times all words; a target stops
   at `most` times its source's words and the rest is shared anew. That fixpoint is one water level: target = min(cap,
   level * weight), found with running sums over the sources in the order in which they fill up.
2. Wishes: within a source a document wants level * w copies, w being the bit length of its word count, so that longer
   documents are a little likelier; again stopped at `most`. The whole part of the wish is certain.
3. The fraction p is the chance of one copy more. A random number u (a hash of the id) gives the rank
   odds(u) / odds(p); documents are taken in that order until their words meet the source's target, a fixed size.

The order is never made for a whole source: ranks fall into RANK_BINS bins, the bins' words are summed per source (with
partial sums, so a hot source is no hot task), and only the documents of the one bin in which the target falls are sorted.

Defined cases: null text has size 0 and takes 0 words; a null source is a source of its own; a null id is a document like
any other. Rows that agree in id, source and size are alike: how many of them get a copy is fixed, which of them is not.
An empty table gives an empty result; extra columns are not read. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.common import whole_text
from seekspark.session import written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
RANK_BINS = 4096
#: Tables with one row per source are broadcast up to so many rows (some megabytes); larger ones are joined by shuffle.
FEW_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def filled(items: DataFrame, by: list[str], cap: str, rate: str, total: str) -> DataFrame:
    """`by` and `level`: the water level at which sum(min(cap, level * rate)) is the total. Rates are positive."""
    order = Window.partitionBy(*[F.col(c) for c in by]).orderBy(F.col(cap) / F.col(rate))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*[F.col(c) for c in by])
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum(rate).over(everything) - F.coalesce(F.sum(rate).over(before), F.lit(0)))
    rows = items.select(*by, (F.col(cap) / F.col(rate)).alias("_full"), level.alias("_level"), F.row_number().over(order).alias("_place"))
    # The level of the first item that does not fill up; all fill up only if the total is the sum of the caps.
    held = F.expr("min_by(_level, _place) FILTER (WHERE _level <= _full)")
    return rows.groupBy(*by).agg(F.coalesce(held, F.max("_full")).alias("level"))


def source_targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source. The only unpartitioned window runs over these few rows."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    items = sizes.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"),
        (F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(budget)).alias("total"), F.lit(0).alias("all"),
    )
    level = filled(items, ["all"], "cap", "weight", "total")
    return items.join(F.broadcast(level), "all").select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _per_source(rows: DataFrame, name: str) -> DataFrame:
    """A written table, broadcast only once its size is known: documents then need no shuffle, and no source is hot."""
    table = written(rows, name)
    return F.broadcast(table) if table.count() <= FEW_SOURCES else table


def _wish(most: int) -> Column:
    return F.least(F.lit(float(most)), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"))


def sampled(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Adds source_size, target and `copies` to rows that have source, size, w (wish weight, a positive whole number), u.

    `measured` is read several times; it should be a table.
    """
    targets = source_targets(measured, weights, budget, most)
    classes = measured.filter("size > 0").groupBy("source", "w").agg(F.sum("size").alias("n"))
    items = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        "c.source", (F.col("n") * most).alias("cap"), (F.col("n") * F.col("w")).alias("rate"), "target")
    levels = filled(items, ["source"], "cap", "rate", "target").withColumnRenamed("source", "_s")
    known = _per_source(targets.join(levels, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "level"), "mix-levels")

    whole = F.floor(_wish(most))
    p, u = F.col("_p"), F.col("u")
    # odds(u) / odds(p) as a share of the unit interval: the same order, and bins of it are easy to name.
    rank = F.when(F.col("_whole") >= most, F.lit(1.0)).otherwise(u * (1 - p) / (u * (1 - p) + p * (1 - u)))
    ranked = (
        measured.join(known, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_whole", whole).withColumn("_p", _wish(most) - F.col("_whole")).withColumn("_rank", rank)
        .withColumn("_bin", F.least(F.floor(F.col("_rank") * RANK_BINS), F.lit(RANK_BINS - 1)))
    )
    # What is wanted beyond the certain copies, and the bin in which it is reached.
    free = F.col("_whole") < most
    certain = ranked.groupBy("source", "_bin").agg(
        F.sum(F.col("_whole") * F.col("size")).alias("certain"), F.sum(F.when(free, F.col("size")).otherwise(0)).alias("n"),
        F.first("target").alias("target"))
    own = Window.partitionBy("source")
    running = certain.select(
        "source", "_bin", "n", (F.first("target").over(own) - F.sum("certain").over(own)).alias("wanted"),
        F.coalesce(F.sum("n").over(own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # Bins before `cut` are taken whole, bins after it not at all.
    cuts = _per_source(running.groupBy("source").agg(
        F.first("wanted").alias("_wanted"),
        F.min_by(F.when(F.col("before") + F.col("n") > F.col("wanted"), F.struct(F.col("_bin").alias("bin"), "before")),
                 F.when(F.col("before") + F.col("n") > F.col("wanted"), F.col("_bin"))).alias("_cut"),
    ).withColumnRenamed("source", "_c"), "mix-cuts")
    judged = ranked.join(cuts, F.col("source").eqNullSafe(F.col("_c")))
    cut = F.coalesce(F.col("_cut.bin"), F.lit(RANK_BINS))
    clear = judged.filter(F.col("_bin") != cut).withColumn("copies", F.col("_whole") + F.when(free & (F.col("_bin") < cut), 1).otherwise(0))
    within = Window.partitionBy("source").orderBy("_rank", "u", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_cut.before") + F.sum(F.when(free, F.col("size")).otherwise(0)).over(within) - F.col("size") / 2
    close = judged.filter(F.col("_bin") == cut).withColumn("copies", F.col("_whole") + F.when(free & (reached <= F.col("_wanted")), 1).otherwise(0))
    columns = [*measured.columns, "source_size", "target", "copies"]
    return clear.select(*columns).unionByName(close.select(*columns))


def measured(docs: DataFrame, keep: list[str], seed: str) -> DataFrame:
    size = word_count(F.col("text"))
    return docs.select(*keep, size.alias("size"), uniform(F.col("doc_id"), seed).alias("u")).withColumn(
        "w", F.length(F.bin("size")).cast("long"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    table = written(measured(docs, ["doc_id", "source"], seed), "mix-sizes")
    return sampled(table).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], seed: str = "mix") -> DataFrame:
    """The documents, each as often as the mix takes it. Wordless documents stay once."""
    own = {"size": "_size", "u": "_u", "w": "_w", "source_size": "_ss", "target": "_t", "copies": "_n"}
    clash = {c: f"_kept_{c}" for c in columns if c in own}
    renamed = docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in columns])
    # Written with their sizes: the passes below read narrow columns, and words are counted once.
    rows = sampled(written(measured(renamed, renamed.columns, seed), "mix-documents"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    repeated = rows.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in columns])


MIX_SQL = r"""
WITH m AS (
  SELECT doc_id, source, size, length(bin(size)) AS w, u FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
s1 AS (
  SELECT source, source_size, source_size * 2 AS cap,
    [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total
  FROM s),
s2 AS (
  SELECT *, cap::DOUBLE / weight AS fullness, row_number() OVER b2 AS place,
    (total - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
  FROM s1 WINDOW b AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    b2 AS (ORDER BY cap::DOUBLE / weight, source)),
s3 AS (SELECT coalesce(arg_min(lev, place) FILTER (WHERE lev <= fullness), max(fullness)) AS level FROM s2),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM s1, s3),
c AS (
  SELECT m.source, w, sum(size)::BIGINT AS n, any_value(target) AS target
  FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY m.source, w),
c1 AS (
  SELECT source, (n * 2)::DOUBLE / (n * w) AS fullness, w,
    (target - coalesce(sum(n * 2) OVER b, 0)::DOUBLE) / (sum(n * w) OVER (PARTITION BY source) - coalesce(sum(n * w) OVER b, 0))::DOUBLE AS lev
  FROM c WINDOW b AS (PARTITION BY source ORDER BY (n * 2)::DOUBLE / (n * w) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT source, coalesce(arg_max(lev, w) FILTER (WHERE lev <= fullness), max(fullness)) AS level FROM c1 GROUP BY source),
d AS (
  SELECT m.*, source_size, target, least(2.0::DOUBLE, coalesce(level, 0) * w) AS wish
  FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON m.source IS NOT DISTINCT FROM l.source),
r AS (
  SELECT *, floor(wish)::BIGINT AS whole, wish - floor(wish) AS p FROM d),
q AS (
  SELECT *, CASE WHEN whole >= 2 THEN 1.0 ELSE u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS rnk,
    CASE WHEN whole < 2 THEN size ELSE 0 END AS free, target - (sum(whole * size) OVER (PARTITION BY source))::DOUBLE AS wanted
  FROM r)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN whole < 2 AND (sum(free) OVER (PARTITION BY source ORDER BY rnk, u, size ROWS UNBOUNDED PRECEDING))::DOUBLE - size / 2.0::DOUBLE <= wanted
    THEN 1 ELSE 0 END) AS taken
FROM q
"""
