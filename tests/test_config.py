import pytest

from seekspark.config import ConfigError, EngineConfig, check_request, parse_list, resolve_classifier


def test_defaults_and_clamps():
    cfg = EngineConfig(rrf_k=999, embed_batch_size=0, cross_encoder_top_k=0, chunk_overlap=0, rerank_candidates=0)
    assert (cfg.rrf_k, cfg.embed_batch_size, cfg.cross_encoder_top_k, cfg.chunk_overlap) == (200, 1, 1, 12)
    assert (cfg.rerank_candidates, cfg.hybrid_depth) == (100, 100)
    assert cfg.fallback_window == (36, 9)


def test_thresholds_follow_the_mode_and_stay_ordered():
    assert (EngineConfig().weak_below, EngineConfig().strong_above) == (0.35, 0.55)
    assert EngineConfig().with_(rerank_enabled=False).strong_above == 0.40
    assert EngineConfig(weak_below=0.6, strong_above=0.5).strong_above == pytest.approx(0.61)


def test_environment():
    env = {
        "SEEKSPARK_HYBRID_SEARCH": "no", "SEEKSPARK_WORKING_DOCS": "none", "SEEKSPARK_RRF_K": "x",
        "SEEKSPARK_INDEX_EXCLUDE": "./a, b\\c\na", "SEEKSPARK_DEFINITION_BOOST": "-1", "SEEKSPARK_CHUNK_LINES": "30",
    }
    cfg = EngineConfig.from_env(env)
    assert (cfg.hybrid_search, cfg.working_docs, cfg.rrf_k, cfg.definition_boost, cfg.chunk_lines) == (False, (), 60, 0.0, 30)
    assert cfg.index_exclude == ("a", "b/c") == parse_list("./a, b\\c\na")


def test_request_checks():
    assert resolve_classifier(" Code ", None) == resolve_classifier(None, "code") == "code"
    for bad in (("code", "docs"), ("other", None)):
        with pytest.raises(ConfigError):
            resolve_classifier(*bad)
    for query, limit in (("", 1), ("x", 0), ("x", 51), ("x", True)):
        with pytest.raises(ConfigError):
            check_request(query, limit)


def test_places_and_engines():
    cfg = EngineConfig(watch_root="/data/repo", index_dir="s3a://bucket/index/")
    assert (cfg.watch_root, cfg.index_dir) == ("/data/repo", "s3a://bucket/index")
    assert EngineConfig(watch_root="hdfs://host/repo").index_dir == "hdfs://host/repo/.seekspark"
    with pytest.raises(ConfigError):
        EngineConfig(definition_engine="tree_sitter")
