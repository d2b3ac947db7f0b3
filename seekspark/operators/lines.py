"""Line windows: the chunker of plain text. Pure array expressions, no shuffle.

Chunk bodies are cut out inside the array, before the explode, so the exploded rows carry one
window each and never a copy of the whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = r"\r?\n"


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a trailing break leaves an empty last line, '' is one empty line."""
    return F.split(text, LINE_BREAK)


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Text of the 1-based inclusive line range; '' for an empty range."""
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


def window_starts(first: Column, last: Column, size: int, overlap: int) -> Column:
    """First lines of the windows covering [first, last]; the last window reaches ``last``."""
    step = max(1, size - overlap)
    more = F.greatest(F.lit(0), F.ceil((last - first + 1 - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), more), lambda i: first + i * step)


def piece_starts(first: Column, last: Column, size: int) -> Column:
    """First lines of consecutive pieces of at most ``size`` lines."""
    return F.sequence(first, F.greatest(first, last), F.lit(size))


def windows(lines: Column, first: Column, last: Column, size: int, overlap: int) -> Column:
    """array<struct<start_line, end_line, body>> over the line range."""

    def window(start: Column) -> Column:
        end = F.least(start + F.lit(size - 1), last)
        return F.struct(start.alias("start_line"), end.alias("end_line"), line_slice(lines, start, end).alias("body"))

    return F.transform(window_starts(first, last, size, overlap), window)


def line_windows(files: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Every input row becomes its windows: adds ordinal, start_line, end_line, body; drops the text."""
    keep = [c for c in files.columns if c != text]
    lined = files.select(*keep, split_lines(F.col(text)).alias("_lines"))
    cut = windows(F.col("_lines"), F.lit(1), F.size("_lines"), size, overlap)
    rows = lined.select(*keep, F.posexplode_outer(cut).alias("ordinal", "_w"))
    return rows.select(*keep, "ordinal", "_w.start_line", "_w.end_line", "_w.body")
