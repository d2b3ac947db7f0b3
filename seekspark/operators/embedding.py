"""Text to vectors: a pluggable backend behind one Arrow-batched function.

A backend is built once per Python worker and called with small batches of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.config import ConfigError, EngineConfig
from seekspark.operators import words

VECTOR = T.ArrayType(T.FloatType())
Embed = Callable[[Sequence[str]], np.ndarray]
#: So many terms are remembered by the stand-in.
PLACES = 400_000


def hashing_embedder(dim: int) -> Embed:
    """Deterministic stand-in for a model: signed term counts hashed into ``dim`` slots, unit length.

    The slot and sign of a term come from the first eight hex digits of its MD5.
    """

    class Places:
        """The slots of terms; those of negative terms follow the positive ones. Known terms are looked up without making strings of them."""

        def __init__(self) -> None:
            self.terms, self.slots = pa.array([], pa.string()), np.zeros(0, np.int64)

        def of(self, terms: pa.Array) -> np.ndarray:
            at = pc.index_in(terms, self.terms)
            if at.null_count:
                new = terms.filter(at.is_null())
                if len(self.terms) + len(new) > PLACES:
                    self.__init__()
                    new = terms
                values = np.fromiter((int.from_bytes(hashlib.md5(term.encode()).digest()[:4]) for term in new.to_pylist()), np.int64, len(new))
                self.slots = np.append(self.slots, values % dim + dim * (values // dim % 2))
                self.terms = pa.concat_arrays([self.terms, new])
                at = pc.index_in(terms, self.terms)
            return self.slots[at.to_numpy()]

    places = Places()

    def embed(texts: Sequence[str]) -> np.ndarray:
        lowered = pa.array([text.lower() for text in texts], pa.large_string())
        out = np.zeros((len(texts), dim))
        for at, stop in words.pieces(lowered):
            found, lengths = words.terms_of(lowered.slice(at, stop - at))
            terms = found.dictionary_encode()
            cell = np.repeat(np.arange(stop - at), lengths) * 2 * dim + places.of(terms.dictionary)[terms.indices.to_numpy()]
            counts = np.bincount(cell, minlength=2 * dim * (stop - at)).reshape(-1, 2, dim)
            out[at:stop] = counts[:, 0] - counts[:, 1]
        return unit_rows(out)

    return embed


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, tokens, dim) and its attention mask -> unit-length mean vectors."""
    weights = mask[..., None].astype(states.dtype)
    return unit_rows((states * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9))


def rows_of_tensor(data: np.ndarray, dim: int) -> np.ndarray:
    """Model output as (rows, dim); anything that does not divide into such rows is an error."""
    data = np.asarray(data)
    if data.size % dim:
        raise ValueError(f"embedding output of shape {data.shape} does not hold rows of {dim}")
    return data.reshape(-1, dim)


def embed_column(text: Column, cfg: EngineConfig, make_embedder: Callable[[], Embed] | None = None) -> Column:
    """The vector of a whole text, computed in batches inside the tasks.

    Without a function that makes an embedder, the stand-in is used; the configuration must then name it.
    """
    if make_embedder is None and cfg.embedding_model != "hashing":
        raise ConfigError(f"the embedding model {cfg.embedding_model!r} needs a function that makes its embedder")
    # The stand-in has no model call to size batches for.
    dim = cfg.embedding_dim
    batch = max(1024, (1 << 19) // dim) if make_embedder is None else cfg.embed_batch_size

    @F.arrow_udf(VECTOR)
    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make_embedder() if make_embedder else hashing_embedder(dim)
        for texts in series:
            values = texts.fill_null("").to_pylist()
            out = np.zeros((len(values), dim), np.float32)
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                vectors = np.asarray(embed(part))
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"embedder returned shape {vectors.shape} for {len(part)} texts")
                out[at : at + batch] = vectors
            # One buffer for all vectors; a list of arrays would be put together value by value.
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * dim, pa.int32()), pa.array(out.ravel()))

    return run(text)
