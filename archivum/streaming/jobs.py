"""Landed files as streams: results and write plans.

One response is one whole group, so the group jobs of a micro-batch see every row they need;
nothing is kept between batches but the checkpoint, and for changesets the replies, as a later batch may
bring another attempt of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes, responses
from ..plans.jobs import Run, merge_responses
from ..sources.archive import parse_changesets

RESPONSES = "group_key string, attempt int, raw string"


def stream_results(spark: SparkSession, landed: str, items: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads landed responses (JSON lines), parses them, and hands ``sink`` a row for each file of
    each group that answered (status ok or error) with the batch's number, which makes a repeated
    batch recognisable. The manifest is a static table joined to every batch."""

    def batch(df: DataFrame, number: int) -> None:
        first = responses.first_usable(responses.parse_responses(df))
        status = F.when(F.col("status") == "failed", "error").otherwise("ok")
        sink(items.join(first.select("group_key", status.alias("status"), "json"), "group_key"), number)

    return spark.readStream.schema(RESPONSES).json(landed).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_changesets(spark: SparkSession, landed: str, items: DataFrame, run: Run, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Landed responses to result, error and changeset files (``out``/results, errors, changesets),
    a folder a batch, which a repeated batch writes anew. ``items`` has the metadata columns.

    Replies are kept in ``out``/replies, by batch and hash bucket of their group. A group that answers again, in
    whatever batch, is merged from all its replies so far, each attempt once; ``latest`` reads what counts then. A batch
    reads the buckets of its own groups only."""

    def batch(df: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("int")
        df.select("group_key", "attempt", "raw", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/replies/batch={number}")
        known = spark.read.schema(f"{RESPONSES}, batch long, bucket int").parquet(f"{out}/replies").where(F.col("batch") <= number)
        fresh = known.where(F.col("batch") == number)
        own = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        groups = fresh.select("group_key").distinct()
        replies = known.where(F.col("bucket").isin(own)).join(groups, "group_key", "left_semi").groupBy("group_key", "attempt").agg(F.min_by("raw", "batch").alias("raw"))
        got = merge_responses(items.join(groups, "group_key", "left_semi"), replies, run, keep=True)
        for name in ("results", "errors", "changesets"):
            getattr(got, name).write.mode("overwrite").json(f"{out}/{name}/batch={number}")

    return spark.readStream.schema(RESPONSES).json(landed).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of ``out``/``name`` that count: of each group those of the last batch that had a reply of it."""
    last = spark.read.schema(f"{RESPONSES}, batch long, bucket int").parquet(f"{out}/replies").groupBy("group_key").agg(F.max("batch").alias("batch"))
    return spark.read.json(f"{out}/{name}").join(last, ["group_key", "batch"], "left_semi")


def stream_tag_plan(spark: SparkSession, landed: str, out: str, allowed: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Changeset lines as they land to planned tag writes, without state."""
    plan = changes.plan_tag_writes(parse_changesets(spark.readStream.text(landed)), allowed)
    return plan.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_unique_responses(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of responses (with ``landed_at``) without repeated deliveries."""
    return stream.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["group_key", "attempt"])


def grow_vocabulary(spark: SparkSession, landed: DataFrame, vocabulary: str, checkpoint: str) -> StreamingQuery:
    """Appends keywords of a stream (keyword, section, note) that the vocabulary table lacks; a null
    or blank keyword is none. A repeated batch finds its keywords known and adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        known = spark.read.parquet(vocabulary)
        df.where("trim(keyword) <> ''").dropDuplicates(["keyword"]).join(known.select("keyword"), "keyword", "left_anti").select(known.columns).write.mode("append").parquet(vocabulary)

    return landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


OFFERS = "group_key string, words array<struct<ord: int, keyword: string>>, proposals array<struct<pos: int, keyword: string, section: string, note: string>>"


def stream_vocabulary(offers: DataFrame, known: DataFrame, out: str, sections: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Growth of a vocabulary by its rules: a stream of ``OFFERS``, a row with all words and proposals of a group, to the
    outcomes of ``admit_vocabulary`` against the static table ``known`` (keyword), a folder ``out``/batch=N a batch.

    What a batch writes depends on its own rows only, so a repeated batch replaces its folder with the same rows, and
    ``vocabulary_outcomes`` gives the same table however the rows came in batches. A group that is delivered again,
    in whatever batch, offers the same and changes no admission."""

    def batch(df: DataFrame, number: int) -> None:
        words = df.select("group_key", F.inline("words")).where("trim(keyword) <> ''")
        outcome = changes.admit_vocabulary(words, df.select("group_key", F.inline("proposals")), known, sections)
        outcome.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return offers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vocabulary_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """(keyword, section, note, reason, group_key, ord) of all batches: each admitted keyword (no reason) by its first offer
    in order of group and place, each rejection once."""
    rows = spark.read.schema("keyword string, section string, note string, reason string, group_key string, ord int").parquet(f"{out}/batch=*")
    first = rows.where("reason IS NULL").groupBy("keyword").agg(F.min_by(F.struct("section", "note", "reason", "group_key", "ord"), F.struct("group_key", "ord", "section", "note")).alias("x"))
    return rows.where("reason IS NOT NULL").distinct().unionByName(first.select("keyword", "x.*"))
