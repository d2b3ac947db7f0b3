"""One query per operator, over whole tables, with production parameters; ORACLE holds SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import (
    codes, counts, fingerprint, language, leaks, lexical, licenses, mixing, neighbours, packing, personal, secrets, simhash, spans,
)
from seekspark.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_language_id(spark, sf_dir):
    return language.identify(read_table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark, sf_dir):
    return spans.digest(secrets.scan(read_table(spark, sf_dir, "documents"), ["doc_id"]), list(secrets.KINDS))


@query
def op9_pii(spark, sf_dir):
    return spans.digest(personal.scan(read_table(spark, sf_dir, "documents"), ["doc_id"]), list(personal.BASE_KINDS))


@query
def op4_source_mix(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


ORACLE["op4_source_mix"] = mixing.MIX_SQL


@query
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op3_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprint.with_neighbours(read_table(spark, sf_dir, "documents"))


@query
def op1_curve_neighbours(spark, sf_dir):
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op10_license_scan(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


ORACLE["op10_license_scan"] = licenses.scan_sql()


@query
def op6_token_counts(spark, sf_dir):
    return counts.count_edits(read_table(spark, sf_dir, "documents"), counts.sample_edits())


@query
def op12_decontamination(spark, sf_dir):
    return leaks.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE["op12_decontamination"] = leaks.report_sql()


@query
def op13_lexical_search(spark, sf_dir):
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_search"] = lexical.search_sql()


@query
def op11_vector_codes(spark, sf_dir):
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


ORACLE["op11_vector_codes"] = codes.compress_sql()
