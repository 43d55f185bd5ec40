"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns a DataFrame; all but the last return the columns of ``documents``.

1. language    documents without a letter, or in no language that was learned, go
2. quality     lines that fail a rule go, and documents that fail the base rules or lose too much to the line rules
3. duplicates  of documents linked by a Jaccard similarity of 0.8 of five-word shingles one stays
4. personal    personal data in the text is masked
5. packing     what is left is cut into sequences along a Hilbert curve

``documents`` needs doc_id, text and lang; other columns, whatever their names, are carried as they
are (but ``n_chars``, which stages that change texts count again). A null, empty or blank text has no letter and goes in
stage 1, a null lang is only not learned from. Rows without an id link with nothing and stay; a repeated row
stays once, and of an id with several texts every text stays or goes with it. Among linked documents that
with the smallest id stays. Copies are looked for in what the line rules left. Texts of any length are read whole. An empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivum.llm import langid, ngramjoin, packing, pii, quality
from archivum.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.learn(docs))


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs, words=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal(docs, pii.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good_lines), ("duplicates", near_duplicates), ("personal", personal), ("packing", packed)]

#: Language, spans and ids come from trained models and a tokenizer, which SQL can't express. The tests hold
#: quality, duplicates and packing against plain versions, and masking against the base spans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
