"""Canonical tags, patches, diffs, changesets, result records, vocabulary admission, write plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

# Canonical tags, aliases of vocabulary sections, and error types that need no trace.
KEYWORDS, TITLE, DESCRIPTION, COMMENT, DATE = "XMP:dc:Subject", "XMP:dc:Title", "XMP:dc:Description", "EXIF:UserComment", "EXIF:DateTimeOriginal"
LOCATION = {"country": "IPTC:Country-PrimaryLocationName", "state": "IPTC:Province-State", "city": "IPTC:City", "sublocation": "IPTC:Sub-location"}
DATE_TAGS = (DATE, "EXIF:CreateDate")
KNOWN_ERRORS = ("rate_limit", "overloaded", "invalid_input", "invalid_request", "api_status", "length")
SECTION_ALIASES = (
    ("people", "people_subjects"), ("subjects", "people_subjects"), ("clothing", "clothing_fashion"), ("fashion", "clothing_fashion"),
    ("objects", "objects_artifacts"), ("artifacts", "objects_artifacts"), ("animals", "animals_pets"), ("pets", "animals_pets"),
    ("setting", "setting_environment"), ("environment", "setting_environment"), ("locations", "setting_environment"), ("location", "setting_environment"),
    ("architecture", "architecture_built"), ("events", "events_occasions"), ("occasions", "events_occasions"), ("format", "photo_format"),
    ("written", "written_elements_identifiers"), ("identifiers", "written_elements_identifiers"), ("activities", "activities_actions"), ("actions", "activities_actions"),
    ("emblems", "emblems_symbols_context"), ("symbols", "emblems_symbols_context"), ("landscape", "landscape_nature"), ("nature", "landscape_nature"),
    ("documents", "documents_records"), ("records", "documents_records"), ("date", "date_reference"), ("dates", "date_reference"), ("date_refernce", "date_reference"),
)
THRESHOLD = 0.7


def _words(rows: DataFrame, prefix: str = "", settled: bool = False) -> Column:
    """A record's keywords, once each; ``settled`` ones are so already, as those of a merged record."""
    words = F.coalesce(F.col(f"{prefix}keywords"), F.array().cast("array<string>"))
    return words if settled else rules.ci_distinct(words)


def _scalars(rows: DataFrame, prefix: str = "") -> list[tuple[str, Column, Column | None]]:
    """(tag, value, confidence) of every tag but keywords of a merged record, whose columns have this
    prefix."""
    b, col = rules.blank_to_null, lambda n: F.col(prefix + n)
    have = lambda *names: F.coalesce(*[b(col(n)) for n in names if prefix + n in rows.columns], F.lit(None).cast("string"))
    fixed, guess = have("dateTimeOriginal", "date"), have("date_import", "date_iso")
    return [
        (TITLE, have("title"), None), (DESCRIPTION, have("description", "caption"), None), (COMMENT, have("analysis_notes", "ai_caption", "user_comment"), None),
        *[(t, have(f"loc_{k}"), col("loc_confidence")) for k, t in LOCATION.items()], (DATE, F.coalesce(fixed, guess), F.when(fixed.isNull(), col("date_confidence"))),
    ]


def _entries(rows: DataFrame) -> Column:
    """All candidate (tag, value, values, confidence) of a merged record."""
    none, words = F.lit(None).cast("double"), F.col("__words")
    entry = lambda tag, value, conf, values=F.lit(None).cast("array<string>"): F.struct(F.lit(tag).alias("tag"), value.alias("value"), values.alias("values"), (none if conf is None else conf).alias("confidence"))
    return F.array(entry(KEYWORDS, F.nullif(F.array_join(words, "|"), F.lit("")), None, words), *[entry(*x) for x in _scalars(rows)])


def canonical_patch(rows: DataFrame, threshold: float = THRESHOLD, settled: bool = False) -> DataFrame:
    """(path, tag, value, values, decision, confidence): ``set`` where nothing or enough confidence
    is given, else ``suggest``. A row a tag."""
    keep = [c for c in ("group_key", "path") if c in rows.columns]
    rows = rows.withColumn("__words", _words(rows, settled=settled))
    e = rows.select(*keep, F.explode(_entries(rows)).alias("e")).select(*keep, "e.*").where("value IS NOT NULL")
    return e.withColumn("decision", F.when(F.col("confidence").isNull() | (F.col("confidence") >= threshold), "set").otherwise("suggest"))


def canonical_from_patch(patch: DataFrame) -> DataFrame:
    return patch.where("decision = 'set'").drop("decision", "confidence")


def canonical_values(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, tag, value, values) of metadata: the patch's settled rows."""
    return canonical_from_patch(canonical_patch(rows, threshold))


def diff_canonical(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, set, keywords_add, keywords_remove). A tag that is only there before isn't removed;
    keywords are compared without regard to case.

    Both sides meet in one aggregation by path: the tags of a path become one row a side before they are shuffled, and
    nothing is joined or shuffled a tag at a time. With the path's group among the ``keys`` sides that both stand by
    group_key aren't shuffled at all."""
    words = F.col("tag") == KEYWORDS
    side = lambda df, after: df.select(*keys, "tag", F.when(~words, F.col("value")).alias("value"), F.when(words, F.col("values")).alias("values"), F.lit(after).alias("after"))
    pairs = lambda mine: F.collect_list(F.when(mine & F.col("value").isNotNull(), F.struct("tag", "value")))
    listed = lambda mine: F.coalesce(F.max(F.when(mine & words, F.col("values"))), F.array().cast("array<string>"))
    old, new = ~F.col("after"), F.col("after")
    g = side(before, False).unionByName(side(after, True)).groupBy(*keys).agg(pairs(old).alias("was"), pairs(new).alias("now"), listed(old).alias("b"), listed(new).alias("a"))
    changed = F.array_sort(F.filter("now", lambda x: ~F.array_contains("was", x)))
    return g.select(*keys, F.map_from_entries(changed).alias("set"), rules.without(F.col("a"), F.col("b")).alias("keywords_add"), rules.without(F.col("b"), F.col("a")).alias("keywords_remove"))


def diff_rows(rows: DataFrame, before: str, threshold: float = THRESHOLD, keep: Sequence[str] = (), settled: Sequence[str] = ()) -> DataFrame:
    """``diff_canonical`` where before (columns with that prefix) and after stand on one row: nothing
    is exploded or joined. (keep, path, file_metadata, set, keywords_add, keywords_remove)

    ``settled``: the prefixes of the sides whose keywords are as ``ci_distinct`` leaves them."""
    sure = lambda side: [(v if c is None else F.when(c.isNull() | (c >= threshold), v)) for _, v, c in side]
    was, now = _scalars(rows, before), _scalars(rows)
    tags = [t for t, _, _ in now]
    r = rows.select(*keep, "path", _words(rows, before, before in settled).alias("bw"), _words(rows, settled="" in settled).alias("aw"), *[v.alias(f"b{i}") for i, v in enumerate(sure(was))], *[v.alias(f"a{i}") for i, v in enumerate(sure(now))])
    pairs = lambda cases: F.map_from_entries(F.array_compact(F.array(*cases)))
    pair = lambda ok, tag, value: F.when(ok, F.struct(F.lit(tag).alias("tag"), value.alias("value")))
    old = [pair(F.size("bw") > 0, KEYWORDS, F.array_join("bw", "|"))] + [pair(F.col(f"b{i}").isNotNull(), t, F.col(f"b{i}")) for i, t in enumerate(tags)]
    new = [pair(F.col(f"a{i}").isNotNull() & ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")), t, F.col(f"a{i}")) for i, t in enumerate(tags)]
    return r.select(*keep, "path", pairs(old).alias("file_metadata"), pairs(new).alias("set"), rules.without(F.col("aw"), F.col("bw")).alias("keywords_add"), rules.without(F.col("bw"), F.col("aw")).alias("keywords_remove"))


def patch_columns(rows: DataFrame, threshold: float = THRESHOLD, settled: bool = False) -> list[Column]:
    """``canonical_patch`` on the row itself: patch (tag to value, keywords joined by ``|``) and suggestions (tag, value, confidence)."""
    every = _scalars(rows)
    sure = lambda c: F.lit(True) if c is None else c.isNull() | (c >= threshold)
    words = F.nullif(F.array_join(_words(rows, settled=settled), "|"), F.lit(""))
    pair = lambda ok, t, v: F.when(ok & v.isNotNull(), F.struct(F.lit(t).alias("tag"), v.alias("value")))
    patch = F.map_from_entries(F.array_compact(F.array(pair(F.lit(True), KEYWORDS, words), *[pair(sure(c), t, v) for t, v, c in every])))
    offers = [F.when(~sure(c) & v.isNotNull(), F.struct(F.lit(t).alias("tag"), v.alias("value"), c.alias("confidence"))) for t, v, c in every if c is not None]
    return [patch.alias("patch"), F.array_compact(F.array(*offers)).alias("suggestions")]


def changeset_records(diffs: DataFrame, before: DataFrame, groups: DataFrame, run_id: str, created_at: str, version: int = 1) -> DataFrame:
    """Auditable records: ids, the file's values before, what the model was sent (groups: path,
    group_key, sent), and the proposed changes."""
    was = before.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("file_metadata"))
    return as_changesets(diffs.join(groups, "path").join(was, "path", "left"), run_id, created_at, version)


def as_changesets(rows: DataFrame, run_id: str, created_at: str, version: int = 1) -> DataFrame:
    """Records of rows with path, group_key, sent, file_metadata, set, keywords_add, keywords_remove."""
    return rows.select(
        F.lit(version).alias("schema_version"), F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), F.col("group_key").alias("group_id"), "group_key",
        F.concat(F.lit("sha1:"), F.sha1(rules.normalize_path(F.col("path")))).alias("photo_id"), "path",
        F.struct("file_metadata", F.struct(F.col("sent").alias("metadata")).alias("sent_to_model")).alias("original_data"), F.struct("set", "keywords_add", "keywords_remove").alias("proposed_changes"),
    )


def result_records(files: DataFrame, usage: DataFrame, batch_id: str | None = None, dry_run: bool = False) -> DataFrame:
    """ok rows with usage, one a path (the last by order); dry_run only where set."""
    one = files.groupBy("path").agg(F.max_by(F.struct("group_key", "ord"), "ord").alias("x")).select("path", "x.*")
    r = one.join(usage, "group_key")
    return r.select("path", "group_key", F.lit("ok").alias("status"), "prompt_tokens", "completion_tokens", "total_tokens", "model", F.lit(batch_id).cast("string").alias("batch_id"), F.lit(True if dry_run else None).cast("boolean").alias("dry_run"))


def error_records(items: DataFrame, failures: DataFrame) -> DataFrame:
    """An error row for every file of a failed group (failures: group_key, type, message,
    traceback); the trace stays for unknown types only."""
    trace = F.when(~F.col("type").isin(*KNOWN_ERRORS), F.col("traceback"))
    return items.join(failures, "group_key").select("path", "group_key", F.lit("error").alias("status"), "type", "message", trace.alias("traceback"))


def known_keywords(vocabulary: DataFrame, log: DataFrame) -> DataFrame:
    return vocabulary.select("keyword").unionByName(log.select("keyword")).where("keyword IS NOT NULL").distinct()


def admit_vocabulary(words: DataFrame, proposals: DataFrame, known: DataFrame, sections: Sequence[str]) -> DataFrame:
    """(keyword, section, note, reason, group_key, ord): what becomes of every keyword that isn't
    known. ``reason`` is null for what is admitted: the first offer of each keyword that has a
    proposal of its own record, with a known section and a real note, and isn't a code.

    words: group_key, ord, keyword; proposals: group_key, pos, keyword, section, note (the last of a
    record's proposals for a keyword counts)."""
    spark = words.sparkSession
    alias = spark.createDataFrame(list(SECTION_ALIASES), "alias string, target string")
    new = words.join(known, "keyword", "left_anti")
    last = proposals.groupBy("group_key", "keyword").agg(F.max_by(F.struct("section", "note"), F.struct("pos", "section")).alias("p"))
    r = new.join(last, ["group_key", "keyword"], "left").withColumn("key", F.lower(rules.strip(F.col("p.section"))))
    r = r.join(F.broadcast(alias), F.col("key") == F.col("alias"), "left").withColumn("section", F.coalesce("target", "key"))
    reason = (
        F.when(F.upper("keyword").startswith("PC-"), "code").when(F.col("p").isNull(), "no proposal").when(F.coalesce(F.col("key"), F.lit("")) == "", "no section")
        .when(rules.placeholder_note(F.col("p.note")), "placeholder note").when(~F.col("section").isin(*sections), "unknown section")
    )
    r = r.select("keyword", "section", rules.strip(F.col("p.note")).alias("note"), reason.alias("reason"), "group_key", "ord")
    first = r.where("reason IS NULL").groupBy("keyword").agg(F.min_by(F.struct("section", "note", "group_key", "ord"), F.struct("group_key", "ord")).alias("x"))
    return r.where("reason IS NOT NULL").unionByName(first.select("keyword", "x.section", "x.note", F.lit(None).cast("string").alias("reason"), "x.group_key", "x.ord"))


def plan_tag_writes(changesets: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(path, tag, value, warning) of parsed changesets: allowed tags that are set; dates as the
    files hold them, a null value and a warning where a date can't be read or the value is a list or
    a map."""
    nested = F.coalesce("nested", F.array().cast("array<string>"))
    s = changesets.where(~F.col("bad") & (F.coalesce("path", F.lit("")) != "")).select("path", nested.alias("nested"), F.explode("set").alias("tag", "raw")).where(F.col("tag").isin(*allowed) & F.col("raw").isNotNull())
    s = s.withColumn("list", F.array_contains("nested", F.col("tag")))
    date = F.col("tag").isin(*DATE_TAGS)
    value = F.when(F.col("list"), F.lit(None).cast("string")).when(date, rules.exif_date(F.col("raw"))).otherwise(F.col("raw"))
    return s.select("path", "tag", value.alias("value"), F.when(F.col("list"), "list or map value").when(date & value.isNull(), F.when(rules.strip(F.col("raw")) == "", "empty date").otherwise("unknown date form")).alias("warning"))


def apply_summary(changesets: DataFrame, allowed: Sequence[str], enabled: bool = True) -> DataFrame:
    """files_seen, files_written, tags_written, errors and warnings of a dry run; with writing
    disabled nothing but one warning."""
    spark: SparkSession = changesets.sparkSession
    if not enabled:
        return spark.createDataFrame([(0, 0, 0, 0, 1)], "files_seen long, files_written long, tags_written long, errors long, warnings long")
    plan = plan_tag_writes(changesets, allowed)
    missing = ~F.col("bad") & (F.coalesce("path", F.lit("")) == "")
    seen = changesets.agg(F.count_if(~F.col("bad")).alias("files_seen"), F.count_if("bad").alias("errors"), F.count_if(missing).alias("w1"))
    done = plan.agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("path"))).alias("files_written"), F.count("value").alias("tags_written"), F.count("warning").alias("w2"))
    return seen.join(F.broadcast(done)).select("files_seen", "files_written", "tags_written", "errors", (F.col("w1") + F.col("w2")).alias("warnings"))
