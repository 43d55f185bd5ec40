"""Queries of the corpus operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmltext, langid, minhash, ngramjoin, packing, phrases, pii, quality, runs, secrets, spiece, urlrules
from .common import table


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal(docs, pii.learn(docs))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first_quality(table(spark, sf_dir, "documents"))


def op4_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.sample_pieces(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.learn(docs))
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.learn(pages))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = urlrules.judge_urls(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_packing, op2_personal_data, op3_line_quality, op4_ivf_pq_search, op5_sampled_pieces, op6_language, op7_ngram_join, op8_main_text, op9_url_rules, op10_secret_scan, op11_periodic_runs, op12_collocations, op13_minhash_dedup)}
ORACLE_SQL = {"op3_line_quality": quality.SQL, "op7_ngram_join": ngramjoin.SQL, "op9_url_rules": urlrules.SQL, "op11_periodic_runs": runs.SQL, "op12_collocations": phrases.SQL, "op13_minhash_dedup": minhash.SQL}
