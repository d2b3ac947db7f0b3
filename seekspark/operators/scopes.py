"""Path filters as data: each query of a batch brings its own.

A request row may carry path_prefix, ext, lang, glob and include_docs. Requests with the same filters share a scope; the
distinct scopes of a batch are a small table, compiled once. What a scope tests of a path falls into parts (a prefix, a set
of suffixes, a glob, the working documents) that scopes share, so each different part is tested once per path, and a path
gets the array of the scopes that accept it. Retrieval then asks only whether a query's scope is in that array.

A request whose filters are not valid gets no hits; `error` says why. Scopes come in blocks of SCOPE_BLOCK.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.config import ConfigError, EngineConfig
from seekspark.functions import paths
from seekspark.functions.globs import all_of

SCOPE_BLOCK = 256
ARGUMENTS = {"path_prefix": "string", "ext": "string", "lang": "string", "glob": "string", "include_docs": "boolean"}
IDS = "array<int>"


@dataclass(frozen=True)
class Scope:
    """The path predicates of one setting."""

    path_prefix: str | None = None
    ext: str | None = None
    lang: str | None = None
    glob: str | None = None
    include_docs: bool = False

    def suffixes(self) -> tuple[str, ...]:
        named = paths.language_suffixes(self.lang) if self.lang and self.lang.strip() else []
        return tuple(dict.fromkeys(paths.parse_suffixes(self.ext) + named))

    def omits(self, cfg: EngineConfig) -> bool:
        return paths.omits_working_docs(cfg.working_docs, cfg.search_omit_working_docs, self.include_docs, self.path_prefix)

    def parts(self, cfg: EngineConfig) -> list[tuple]:
        """What the scope tests, as values that other scopes may share."""
        glob, prefix = (self.glob or "").strip(), paths.normalize_prefix(self.path_prefix)
        found = [("prefix", prefix)] if prefix else []
        found += [("suffixes", self.suffixes())] if self.suffixes() else []
        found += [("glob", glob)] if glob else []
        return found + ([("outside", None)] if self.omits(cfg) else [])

    def narrowing(self, cfg: EngineConfig) -> bool:
        """Whether more is tested than the prefix; retrieval then looks deeper."""
        return any(kind != "prefix" for kind, _ in self.parts(cfg))

    def error(self, cfg: EngineConfig) -> str | None:
        try:
            for part in self.parts(cfg):
                _test(part, F.lit(""), cfg)
        except ConfigError as failure:
            return str(failure)
        return None


def _test(part: tuple, path: Column, cfg: EngineConfig) -> Column:
    kind, value = part
    made: dict[str, Callable[[], Column]] = {
        "prefix": lambda: paths.is_under(path, value),
        "suffixes": lambda: paths.suffix_predicate(path, value),
        "glob": lambda: paths.glob_predicate(path, value),
        "outside": lambda: ~paths.is_covered_by(path, cfg.working_docs),
    }
    return made[kind]()


def with_arguments(requests: DataFrame) -> DataFrame:
    """Arguments that a batch lacks are null: nothing is filtered. Documents not asked for are not included."""
    missing = {name: F.lit(None).cast(kind) for name, kind in ARGUMENTS.items() if name not in requests.columns}
    named = requests.withColumns({**missing, **{n: F.col(n).cast(k) for n, k in ARGUMENTS.items() if n not in missing}})
    return named.withColumn("include_docs", F.coalesce("include_docs", F.lit(False)))


def compile_scopes(requests: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, list[list[tuple[int, Scope]]]]:
    """(requests with scope_id, narrowing and error, blocks of (scope_id, scope)).

    The distinct settings of a batch are brought to the driver, never its requests.
    """
    requests = with_arguments(requests)
    keys = list(ARGUMENTS)
    rows = requests.select(*keys).distinct().orderBy(*keys).collect()
    scopes = [Scope(*[r[k] for k in keys[:-1]], bool(r["include_docs"])) for r in rows]
    errors = [s.error(cfg) for s in scopes]
    schema = T.StructType([requests.schema[k] for k in keys] + [
        T.StructField("scope_id", T.IntegerType()), T.StructField("narrowing", T.BooleanType()), T.StructField("error", T.StringType())])
    table = requests.sparkSession.createDataFrame(
        [(*[r[k] for k in keys], i, None if e else s.narrowing(cfg), e) for i, (r, s, e) in enumerate(zip(rows, scopes, errors, strict=True))], schema)
    held = table.select(*[F.col(k).alias(f"_{k}") for k in keys], "scope_id", "narrowing", "error")
    same = all_of([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    named = requests.join(F.broadcast(held), same).select(*requests.columns, "scope_id", "narrowing", "error")
    good = [(i, s) for i, (s, e) in enumerate(zip(scopes, errors, strict=True)) if e is None]
    return named, [good[at:at + SCOPE_BLOCK] for at in range(0, len(good), SCOPE_BLOCK)]


def accepting(rows: DataFrame, scopes: list[tuple[int, Scope]], cfg: EngineConfig, path: str = "path", into: str = "scopes") -> DataFrame:
    """Rows with the ids of the scopes that accept their path; rows that no scope accepts are left out.

    Every different part is tested once per row: it is a column of its own before the scopes are put together from them.
    """
    parts = {part: f"_part{n}" for n, part in enumerate(dict.fromkeys(p for _, s in scopes for p in s.parts(cfg)))}
    tested = rows.withColumns({name: _test(part, F.col(path), cfg) for part, name in parts.items()}) if parts else rows
    ids = [F.when(all_of([F.col(parts[p]) for p in s.parts(cfg)]), F.lit(i)) for i, s in scopes]
    found = F.array_compact(F.array(*ids)).cast(IDS) if ids else F.array().cast(IDS)
    # Held by a generator: the tests are neither repeated in the filter nor copied into each scope.
    return tested.select(*rows.columns, F.explode(F.array(found)).alias(into)).filter(F.size(into) > 0)
