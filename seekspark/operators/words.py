"""Index terms of many texts at once: one pass over the bytes of a column, in numpy.

The same terms as `functions.text.index_terms`, without a regex and a list of strings for every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# What is divided at a time, at least one text: flags and positions take a few times as much.
BYTES = 1 << 22
LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789_"
IN_TERM = bytes(byte in LETTERS for byte in range(256))
OTHERS = bytes(byte for byte in range(256) if byte not in LETTERS)


def _ends(texts: pa.Array) -> np.ndarray:
    """Where the texts start in their bytes, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def pieces(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many bytes (by default BYTES), at least one text each."""
    if not len(texts):
        return
    ends, at = _ends(texts), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (size or BYTES), "right")) - 1)
        yield at, min(stop, len(texts))
        at = stop


def terms_of(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of [a-z0-9_] of lower-cased texts in order, and how many each text has. Null has none."""
    if lowered.null_count:
        lowered = lowered.fill_null("")
    if not len(lowered) or lowered.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(len(lowered), np.int64)
    ends = _ends(lowered)
    data = lowered.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    first, inside = _heads(data, ends - ends[0])
    starts = np.flatnonzero(first)
    # A term ends where the next byte is outside or begins another one.
    first[1:] |= ~inside[1:]
    inside[:-1] &= first[1:]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(inside) + 1 - starts, out=offsets[1:])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.translate(None, OTHERS)))
    return terms, np.diff(np.searchsorted(starts, ends - ends[0]))


def _heads(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a term, and which belong to one; ``ends``: where the texts start in the bytes, and where the last one ends."""
    inside = np.frombuffer(bytearray(data.translate(IN_TERM)), bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]  # a term does not go on in the next text
    first[heads] = inside[heads]
    return first, inside


def counts_of(lowered: pa.Array) -> np.ndarray:
    """How many terms each text has, without the terms."""
    if lowered.null_count:
        lowered = lowered.fill_null("")
    if not len(lowered) or lowered.buffers()[2] is None:
        return np.zeros(len(lowered), np.int64)
    ends = _ends(lowered)
    data = lowered.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    return np.diff(np.searchsorted(np.flatnonzero(_heads(data, ends - ends[0])[0]), ends - ends[0]))
