"""Path priors and the fused rerank score, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark.functions import paths

# Fixed values.
CODE_ROOTS = ("app/models/", "app/controllers/", "app/services/", "lib/", "src/")
FRONTEND_SUFFIXES = (".tsx", ".jsx", ".vue", ".svelte")
FRONTEND_PREFIXES = ("app/javascript/", "frontend/", "client/", "web/")
FRONTEND_PARTS = (
    "/components/", "/ui/", "app/javascript", "/frontend/", "/client/", "/web/", "packages/ui", "src/packs",
)
ASSET_PARTS = ("/fixtures/", "/locales/", "/assets/")
TEST_PREFIXES = ("spec/", "test/")
TEST_PARTS = ("/spec/", "/test/", "__tests__")
MAX_DEMOTION = 0.4
# (focus, bucket) -> prior
CLASSIFIER_PRIORS = {
    ("code", "code"): 0.16, ("code", "config"): -0.10, ("code", "docs"): -0.14,
    ("config", "config"): 0.22, ("config", "code"): -0.07, ("config", "docs"): -0.11,
    ("docs", "docs"): 0.16, ("docs", "code"): -0.09, ("docs", "config"): -0.06,
}


def _placed(path: Column, prefixes: Sequence[str], parts: Sequence[str], suffixes: Sequence[str] = ()) -> Column:
    """The path begins with one of the prefixes, holds one of the parts or ends with one of the suffixes."""
    return paths._any(
        [path.startswith(s) for s in prefixes] + [path.contains(s) for s in parts] + [path.endswith(s) for s in suffixes]
    )


def is_test_path(path: Column) -> Column:
    return _placed(path, TEST_PREFIXES, TEST_PARTS)


def is_frontend_path(path: Column) -> Column:
    return _placed(F.lower(path), FRONTEND_PREFIXES, FRONTEND_PARTS, FRONTEND_SUFFIXES)


def code_path_prior(
    path: Column, symbol_query: Column, wants_tests: Column, wants_frontend: Column, classifier: Column
) -> Column:
    low = F.lower(path)
    config_focus = classifier == "config"
    root = F.when(
        paths._any(low.startswith(r) for r in CODE_ROOTS), F.when(config_focus, 0.08).otherwise(0.2)
    ).otherwise(0.0)
    place = (
        F.when(is_test_path(low), F.when(wants_tests, 0.12).otherwise(-0.12))
        .when(wants_frontend & is_frontend_path(path), 0.1)
        .otherwise(0.0)
    )
    assets = F.when(
        paths._any(low.contains(a) for a in ASSET_PARTS), F.when(symbol_query, -0.2).otherwise(-0.08)
    ).otherwise(0.0)
    config = (
        F.when(config_focus & paths.has_config_extension(path), 0.12)
        .when(
            ~config_focus & (low.endswith(".yml") | low.endswith(".yaml")),
            F.when(symbol_query, -0.15).otherwise(-0.05),
        )
        .otherwise(0.0)
    )
    return root + place + assets + config


def user_demotion(path: Column, substrings: Sequence[str], per_match: float) -> Column:
    """Each configured substring found in the path costs ``per_match``, at most 0.4 in all."""
    wanted = [s.replace("\\", "/").strip().lower() for s in substrings]
    wanted = [s for s in wanted if s]
    if not wanted or per_match <= 0:
        return F.lit(0.0)
    low = F.lower(path)
    matches = sum((F.when(low.contains(s), 1).otherwise(0) for s in wanted), F.lit(0))
    return F.when(matches > 0, -F.least(F.lit(MAX_DEMOTION), matches * F.lit(float(per_match)))).otherwise(0.0)


def classifier_prior(bucket: Column, focus: Column) -> Column:
    out = None
    for (wanted, found), prior in CLASSIFIER_PRIORS.items():
        out = (F if out is None else out).when((focus == wanted) & (bucket == found), F.lit(prior))
    return out.otherwise(0.0)


def definition_prior(definition_of: Column, target: Column, boost: float) -> Column:
    same = F.lower(definition_of) == F.lower(target)
    return F.when(same & F.lit(boost > 0) & (definition_of != ""), F.lit(float(boost))).otherwise(0.0)


def fused_score(
    symbol_query: Column, score: Column, lexical: Column, exact: Column, exact_path: Column,
    path_hint: Column, symbol: Column, prior: Column,
) -> Column:
    return F.when(
        symbol_query, score * 0.35 + lexical * 0.2 + exact * 0.2 + exact_path * 0.15 + symbol * 0.15 + prior
    ).otherwise(score * 0.5 + lexical * 0.2 + exact * 0.1 + path_hint * 0.1 + symbol * 0.05 + prior)


def sigmoid(x: Column) -> Column:
    """Written so that the exponential never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
