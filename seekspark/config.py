"""Engine options: one frozen record, filled from keyword arguments or the environment."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

ENV_PREFIX = "SEEKSPARK_"

QUERY_CLASSIFIERS = ("auto", "code", "config", "docs")
#: Both name the line patterns, the only engine.
DEFINITION_ENGINES = ("auto", "regex")

# Fixed values: (weak below, strong above, minimum relative gap).
CONFIDENCE_WITH_RERANK = (0.35, 0.55, 0.05)
CONFIDENCE_WITHOUT_RERANK = (0.18, 0.40, 0.06)

MAX_LIMIT = 50
MAX_SNIPPET_CHARS = 4_000


class ConfigError(ValueError):
    """An argument the API rejects."""


@dataclass(frozen=True)
class EngineConfig:
    """Every knob of the index and the search. Defaults are the ones a bare install runs with."""

    watch_root: str = "."
    index_dir: str = ""
    embedding_model: str = "hashing"
    embedding_dim: int = 768
    embed_batch_size: int = 4
    working_docs: tuple[str, ...] = (".claude/docs",)
    index_exclude: tuple[str, ...] = ()
    search_omit_working_docs: bool = True
    code_aware_chunking: bool = True
    config_aware_chunking: bool = False
    rerank_enabled: bool = True
    rerank_candidates: int = 100
    hybrid_search: bool = True
    rrf_k: int = 60
    hybrid_depth: int | None = None
    demote_substrings: tuple[str, ...] = ()
    demote_per_match: float = 0.1
    rerank_debug_scores: bool = False
    match_confidence: bool = True
    weak_below: float | None = None
    strong_above: float | None = None
    min_gap: float | None = None
    ambiguous_literal_downgrade: bool = True
    path_family_divergence: bool = True
    definition_boost_enabled: bool = True
    definition_boost: float = 0.18
    test_path_boost: bool = True
    frontend_path_boost: bool = True
    embed_definition_tag: bool = True
    definition_engine: str = "auto"
    cross_encoder_enabled: bool = True
    cross_encoder_top_k: int = 50
    cross_encoder_batch: int = 4
    chunk_lines: int = 60
    chunk_overlap: int = 12
    max_file_bytes: int = 5 * 1024 * 1024
    poll_interval_ms: int = 2_000
    # Settings of this engine itself.
    path_buckets: int = 64
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    strict_size: bool = False
    compat_overfetch: bool = False

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("watch_root", _place(self.watch_root))
        put("index_dir", _place(self.index_dir or os.path.join(self.watch_root, ".seekspark")))
        put("embed_batch_size", _clamp(self.embed_batch_size, 1, 32))
        put("rrf_k", _clamp(self.rrf_k or 60, 1, 200))
        put("rerank_candidates", self.rerank_candidates or 100)
        put("hybrid_depth", max(1, self.hybrid_depth or max(100, self.rerank_candidates)))
        put("demote_per_match", _strength(self.demote_per_match))
        put("definition_boost", _strength(self.definition_boost))
        put("cross_encoder_top_k", _clamp(self.cross_encoder_top_k, 1, 200))
        put("cross_encoder_batch", _clamp(self.cross_encoder_batch, 1, 32))
        put("chunk_lines", self.chunk_lines or 60)
        put("chunk_overlap", self.chunk_overlap or 12)
        put("max_file_bytes", self.max_file_bytes or 5 * 1024 * 1024)
        if self.definition_engine not in DEFINITION_ENGINES:
            raise ConfigError(f"unknown definition_engine {self.definition_engine!r}; one of {', '.join(DEFINITION_ENGINES)}")
        weak, strong, gap = CONFIDENCE_WITH_RERANK if self.rerank_enabled else CONFIDENCE_WITHOUT_RERANK
        put("weak_below", _threshold(self.weak_below, weak))
        put("strong_above", _threshold(self.strong_above, strong))
        put("min_gap", _threshold(self.min_gap, gap))
        if self.strong_above <= self.weak_below:
            put("strong_above", self.weak_below + 0.01)

    @property
    def fallback_window(self) -> tuple[int, int]:
        """(lines, overlap) of the windows used where no symbol anchors a chunk."""
        lines = max(20, math.floor(self.chunk_lines * 0.6))
        return lines, min(self.chunk_overlap, lines // 4)

    def with_(self, **changes) -> EngineConfig:
        """A copy with some options changed; thresholds fall back to the defaults of the new mode."""
        if "rerank_enabled" in changes and changes["rerank_enabled"] != self.rerank_enabled:
            for name in ("weak_below", "strong_above", "min_gap"):
                changes.setdefault(name, None)
        return replace(self, **changes)

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, **overrides) -> EngineConfig:
        """Read ``SEEKSPARK_<FIELD>`` variables; unparsable values fall back to the default."""
        env = os.environ if environ is None else environ
        given: dict = {}
        for field in fields(cls):
            raw = env.get(ENV_PREFIX + field.name.upper())
            if raw is None or not raw.strip():
                continue
            raw, kind = raw.strip(), str(field.type)
            if kind.startswith("tuple"):
                given[field.name] = () if raw == "-" or raw.lower() == "none" else parse_list(raw)
            elif kind == "bool":
                given[field.name] = parse_bool(raw)
            elif kind.startswith(("int", "float")):
                value = _number(raw)
                if value is not None:
                    given[field.name] = int(value) if kind.startswith("int") else value
                elif field.name in ("demote_per_match", "definition_boost"):
                    given[field.name] = 0.0
            else:
                given[field.name] = raw
        return cls(**{**given, **overrides})


def parse_bool(raw: str) -> bool:
    return raw.strip().lower() in ("1", "true", "yes")


def parse_list(raw: str | None) -> tuple[str, ...]:
    """Comma or newline separated repo-relative paths, slashes normalised, duplicates dropped."""
    parts = (re.sub(r"^\./+", "", p.strip().replace("\\", "/")) for p in re.split(r"[,\n]", raw or ""))
    return tuple(dict.fromkeys(p for p in parts if p))


def check_request(query: str, limit: int) -> None:
    """The range checks of the public search call."""
    if not isinstance(query, str) or len(query) < 1:
        raise ConfigError("query must be a non-empty string")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ConfigError(f"limit must be an integer between 1 and {MAX_LIMIT}")


def resolve_classifier(query_classifier: str | None = None, search_focus: str | None = None) -> str:
    """Two names for one argument: they may both be given only if they agree."""
    first, second = ((v or "").strip().lower() for v in (query_classifier, search_focus))
    if first and second and first != second:
        raise ConfigError("query_classifier and search_focus differ; give one of them")
    value = first or second or "auto"
    if value not in QUERY_CLASSIFIERS:
        raise ConfigError(f"unknown query_classifier {value!r}; one of {', '.join(QUERY_CLASSIFIERS)}")
    return value


def _place(path: str) -> str:
    """An absolute local path; a URI stays as it is."""
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def _clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


def _strength(value: float) -> float:
    return min(0.5, value) if math.isfinite(value) and value >= 0 else 0.0


def _threshold(value: float | None, default: float) -> float:
    return value if value is not None and math.isfinite(value) and value >= 0 else default


def _number(raw: str) -> float | None:
    try:
        value = float(raw)
    except ValueError:
        return None
    return value if math.isfinite(value) else None
