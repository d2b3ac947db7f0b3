"""The chunker: picks config sections, symbol chunks or plain windows per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.functions import paths
from seekspark.operators.lines import line_slice, piece_starts, split_lines, windows
from seekspark.operators.symbols import json_keys, last_per_line, rank_spans, regex_spans, yaml_keys
from seekspark.schemas import CHUNK_FIELDS

FIELDS = [f.split(":")[0] for f in CHUNK_FIELDS.split()]
# Fixed value: stands between the header and the body in the searchable text.
HEADER_SEPARATOR = "\n␞\n"


def chunk_struct(start: Column, end: Column, body: Column, language: Column, mode: str | Column, **fields: Column) -> Column:
    """One chunk with the full set of fields, absent ones null."""
    optional = ("symbol_name", "symbol_kind", "scope_path", "definition_of")
    trailing = ("config_file", "config_env")
    pick = lambda n: fields.get(n, F.lit(None)).cast("string").alias(n)
    return F.struct(
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), body.alias("body"),
        language.alias("language"), *[pick(n) for n in optional],
        (F.lit(mode) if isinstance(mode, str) else mode).alias("chunk_mode"), *[pick(n) for n in trailing],
    )


def window_chunks(lines: Column, first: Column, last: Column, size: int, overlap: int, language: Column, mode: str | None) -> Column:
    cut = windows(lines, first, last, size, overlap)
    mode_column = F.lit(mode).cast("string")
    return F.transform(cut, lambda w: chunk_struct(w["start_line"], w["end_line"], w["body"], language, mode_column))


def section_chunks(keys: Column, lines: Column, language: Column, path: Column) -> Column:
    """One chunk per top-level key of a config file."""

    def section(key: Column, i: Column) -> Column:
        end = F.coalesce(F.get(keys, i + 1)["line"] - 1, F.size(lines))
        return chunk_struct(
            key["line"], end, line_slice(lines, key["line"], end), language, "symbol",
            symbol_name=key["key"], symbol_kind=F.lit("config_key"), definition_of=key["key"],
            config_file=paths.stem(paths.posix(path)), config_env=paths.env_section(key["key"]),
        )

    return F.transform(keys, section)


def symbol_chunks(symbols: Column, lines: Column, language: Column, cfg: EngineConfig) -> Column:
    """From each symbol to the line before the next one; what precedes the first is the preamble."""
    size = cfg.chunk_lines
    window, overlap = cfg.fallback_window
    first = F.get(symbols, F.lit(0))["start_line"]
    before = F.when(
        first - 1 > window, window_chunks(lines, F.lit(1), first - 1, window, overlap, language, "preamble")
    ).when(
        first > 1,
        F.array(chunk_struct(F.lit(1), first - 1, line_slice(lines, F.lit(1), first - 1), language, "preamble")),
    ).otherwise(F.array().cast(f"array<struct<{_ddl()}>>"))

    def pieces(s: Column, i: Column) -> Column:
        start = s["start_line"]
        end = F.coalesce(F.get(symbols, i + 1)["start_line"] - 1, F.size(lines))
        split = end - start + 1 > size

        def piece(at: Column, k: Column) -> Column:
            stop = F.least(at + F.lit(size - 1), end)
            return chunk_struct(
                at, stop, line_slice(lines, at, stop), language, F.when(split, "symbol_split").otherwise("symbol"),
                symbol_name=s["name"], symbol_kind=s["kind"], scope_path=s["scope_path"],
                definition_of=F.when(k == 0, s["name"]),
            )

        return F.transform(piece_starts(start, end, size), piece)

    return F.concat(before, F.flatten(F.transform(symbols, pieces)))


def _ddl() -> str:
    return ",".join(CHUNK_FIELDS.split())


def chunk_files(files: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(path, text, ...) -> one row per chunk: path, ordinal and the chunk fields.

    Narrow throughout: files are never shuffled. Only JSON files cross into Python, and only when config sections are on.
    """
    path, text = F.col("path"), F.col("text")
    keep = [c for c in files.columns if c != "text"]
    base = files.select(
        *keep, "text", split_lines(text).alias("lines"), paths.chunk_language(path).alias("language"),
    )
    lines, language = F.col("lines"), F.col("language")
    window, overlap = cfg.fallback_window
    if not cfg.code_aware_chunking:
        none = F.lit(None).cast("string")
        chunks = window_chunks(lines, F.lit(1), F.size(lines), cfg.chunk_lines, cfg.chunk_overlap, none, None)
        return _explode(base, keep, chunks)

    if cfg.config_aware_chunking:
        base = base.withColumn("json_keys", json_keys(F.when(language == "json", text)))
    choice, pending = None, F.lit(True)

    def use(condition: Column, value: Column) -> None:
        nonlocal choice
        choice = (F if choice is None else choice).when(condition, value)

    if cfg.config_aware_chunking:
        no_keys = F.array().cast("array<struct<key:string,line:int>>")
        base = base.withColumn("yaml_keys", F.when(language == "yaml", yaml_keys(lines)).otherwise(no_keys))
        for name in ("json_keys", "yaml_keys"):
            use(F.size(name) > 0, section_chunks(F.col(name), lines, language, path))
            pending = pending & (F.size(name) == 0)
    # Files with sections need no symbols; the condition keeps the line regexes off them.
    base = base.withColumn("matched", F.when(pending, regex_spans(lines, language)))
    base = base.withColumn("ranked", rank_spans(F.col("matched")))
    base = base.withColumn("symbols", last_per_line(F.col("ranked")))
    use(F.size("symbols") > 0, symbol_chunks(F.col("symbols"), lines, language, cfg))
    chunks = choice.otherwise(
        window_chunks(lines, F.lit(1), F.size(lines), window, overlap, language, "fallback_lexical")
    )
    return _explode(base, keep, chunks)


def _explode(base: DataFrame, keep: list[str], chunks: Column) -> DataFrame:
    # The outer form, because the inner one makes the optimizer copy the whole chunk expression into
    # a filter below it. No file is without chunks, so both give the same rows.
    rows = base.select(*keep, chunks.alias("_chunks")).select(*keep, F.posexplode_outer("_chunks").alias("ordinal", "_c"))
    return rows.select(*keep, "ordinal", *[F.col(f"_c.{f}").alias(f) for f in FIELDS])


def chunk_id(path: Column, ordinal: Column) -> Column:
    return F.concat_ws("#", path, ordinal.cast("string"))


def storage_header(path: Column) -> Column:
    """Path words for the text index: path, file name, file name without dashes, path without slashes."""
    name = paths.basename(path)
    return F.concat_ws(" ", path, name, F.translate(name, "-", " "), F.translate(path, "/", " "))


def storage_text(path: Column, body: Column) -> Column:
    return F.concat(storage_header(path), F.lit(HEADER_SEPARATOR), body)


def body_of_storage_text(stored: Column) -> Column:
    """The part after the first separator; all of it without one."""
    at = F.locate(HEADER_SEPARATOR, stored)
    return F.when(at == 0, stored).otherwise(F.substr(stored, at + F.lit(len(HEADER_SEPARATOR))))


def embedding_text(with_definition: bool = True) -> Column:
    """What the embedder reads: bracketed tags, a line break, the whole body."""
    tag = lambda name, value: F.concat(F.lit(name + "="), F.nullif(value, F.lit("")))
    symbol = F.nullif(F.col("symbol_name"), F.lit(""))
    is_key = F.col("language").isin("json", "yaml") & (F.col("symbol_kind") == "config_key") & symbol.isNotNull()
    tags = F.array_compact(F.array(
        F.concat(F.lit("path="), F.col("path")),
        tag("lang", F.col("language")), tag("symbol", symbol), tag("kind", F.col("symbol_kind")),
        F.when(is_key, F.lit("file_kind=config")),
        F.when(is_key, tag("config_file", F.col("config_file"))),
        F.when(is_key, tag("env_section", F.col("config_env"))),
        F.when(is_key, tag("config_key", symbol)),
        F.when(symbol.isNotNull(), tag("scope", F.col("scope_path"))),
        *([tag("def", F.col("definition_of"))] if with_definition else []),
    ))
    return F.concat(F.lit("["), F.array_join(tags, "]["), F.lit("]\n"), F.col("body"))
