"""Sources of the archive engine: media listings, manifests, tag exports, changesets and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules

FACES = "struct<faces: array<struct<name: string, center: struct<x: string, y: string>, centerX: string, centerY: string, w: string, width: string, h: string, height: string>>>"
PLACE = "struct<country: string, state: string, city: string, sublocation: string>"
METADATA = (
    "keywords: string, tags: string, title: string, caption: string, description: string, dateTimeOriginal: string, date: string, location: string, city: string, state: string, stateProvince: string, province: string, "
    f"country: string, userComment: string, user_comment: string, gps: struct<lat: double, lon: double>, faceTags: {FACES}, locationShown: {PLACE}"
)
MANIFEST = f"items array<struct<path: string, preferred: boolean, is_back: boolean, version: string, metadata: struct<{METADATA}>, metadata_path: string>>, photo_context string"
# Fixed value: the misspelt header that older vocabularies have.
LEGACY_SECTIONS = {"date_refernce": "date_reference"}
CHANGESET = "path string, proposed_changes struct<set: map<string, string>>"


def is_image(path: Column) -> Column:
    return F.contains(path, F.lit(".")) & F.lower(F.substring_index(path, ".", -1)).isin(*rules.IMAGE_EXTENSIONS)


def scan_media(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path, length and modificationTime of the images below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", "length", "modificationTime").where(is_image(F.col("path")))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The items of manifests (one a file, or with ``lines`` one a line) with their order; a manifest
    without an ``items`` array is an error."""
    raw = spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)
    checked = raw.withColumn("items", F.when(F.col("items").isNull(), F.raise_error(F.lit("manifest has no items array"))).otherwise(F.col("items")))
    items = checked.select(F.input_file_name().alias("batch_id"), "photo_context", F.posexplode("items").alias("ord", "i"))
    return items.select("batch_id", "photo_context", "ord", "i.*").where(rules.blank_to_null(F.col("path")).isNotNull())


def item_metadata(items: DataFrame) -> DataFrame:
    """The items with their metadata as columns under the names that the jobs read: one keyword list
    (a single text counts as a list of one), and for each other field the first of its names."""
    m = lambda *names: F.coalesce(*[rules.blank_to_null(F.col(f"metadata.{n}")) for n in names])
    fields = {
        "keywords": F.coalesce(rules.one_or_many(F.col("metadata.keywords")), rules.one_or_many(F.col("metadata.tags")), F.array().cast("array<string>")),
        "title": m("title"), "caption": m("caption", "description"), "date_original": m("dateTimeOriginal", "date"), "location": m("location"), "city": m("city"),
        "state_province": m("stateProvince", "state", "province"), "country": m("country"), "user_comment": m("userComment", "user_comment"),
        "gps": F.col("metadata.gps"), "face_tags": F.col("metadata.faceTags"), "location_shown": F.col("metadata.locationShown"),
    }
    return items.select("*", *[c.alias(n) for n, c in fields.items()]).drop("metadata")


def read_vocabulary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(section, keyword, note, source) of landed vocabularies: objects with a section a key, each
    ``{"keywords": [...]}`` of texts or ``{"keyword", "note"}``, and a ``new_keywords`` log. Older
    headers are accepted; a malformed section has no rows."""
    raw = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string,string>")).alias("section", "body"))
    log = F.col("section") == "new_keywords"
    held = F.from_json(F.when(log, F.col("body")).otherwise(F.get_json_object("body", "$.keywords")), "array<string>")
    one = raw.select("section", log.alias("log"), F.explode(held).alias("k"))
    entry = F.from_json(F.when(F.col("k").startswith("{"), F.col("k")), "keyword string, note string, section string")
    legacy = F.create_map(*[F.lit(x) for kv in LEGACY_SECTIONS.items() for x in kv])
    section = F.when(F.col("log"), entry["section"]).otherwise(F.col("section"))
    rows = one.select(F.coalesce(legacy[section], section).alias("section"), rules.blank_to_null(F.when(F.col("k").startswith("{"), entry["keyword"]).otherwise(F.col("k"))).alias("keyword"), entry["note"].alias("note"), F.when(F.col("log"), "log").otherwise("section").alias("source"))
    return rows.where("keyword IS NOT NULL")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(group_key, attempt, raw) of landed replies; the first attempt where none is named."""
    return spark.read.schema("group_key string, attempt int, raw string").json(path).withColumn("attempt", F.coalesce("attempt", F.lit(1)))


def read_sidecars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file_path, metadata) of landed sidecars: a JSON object a file, or with ``lines`` many packed into few files, a line
    ``{"file_path": ..., "body": ...}`` each. Metadata is null where the text isn't a JSON object."""
    if lines:
        raw = spark.read.schema("file_path string, body string").json(path)
    else:
        raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file_path"), F.col("value").alias("body"))
    is_object = F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT")
    return raw.select("file_path", F.when(is_object, F.from_json("body", f"struct<{METADATA}>")).alias("metadata"))


def resolve_item_metadata(items: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Inline metadata, else that of the sidecar at ``metadata_path`` (sidecars: file_path, metadata).

    The normal path is a column before the join: as an expression in the join it would be worked out for every comparison of the join's sort."""
    side = sidecars.select(rules.normalize_path(F.col("file_path")).alias("side_path"), F.col("metadata").alias("side"))
    keyed = items.withColumn("__side_path", rules.normalize_path(F.col("metadata_path")))
    return keyed.join(side, F.col("__side_path") == F.col("side_path"), "left").withColumn("metadata", F.coalesce("metadata", "side")).drop("side", "side_path", "__side_path")


def read_exif_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source_file, tag_ord, tag, value of landed tag exports (JSON arrays of flat records, one a
    file, or with ``lines`` one a line)."""
    raw = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    return raw.select(F.col("r")["SourceFile"].alias("source_file"), F.posexplode("r").alias("tag_ord", "tag", "value")).where("tag <> 'SourceFile'")


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two frames: (value, file, block, id) of the lines below ``path``, and (file, block, shift) of their splits, so that
    the line's number in its file is ``id + shift`` (see ``with_numbers``).

    A split is read in order by one task, so ids within it have no gaps. What is counted is lines a split; only these
    counts, one row a split, are ordered: no window ever holds the lines."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = text.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return text, splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))


def with_numbers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines, or what was made of some of them, with their ``line`` instead of block and id; it counts from 1."""
    return lines.join(splits, ["file", "block"]).withColumn("line", F.col("id") + F.col("shift")).drop("block", "id", "shift")


def changeset_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, severity, reason, text): the quarantine of the changeset files below ``path``. Lines that aren't JSON are errors; records
    without a path, and proposals that are no object, are warnings. Blank lines count as lines and have no row. Only lines at fault are joined with the counts of their split."""
    text, splits = numbered_lines(spark, path)
    v = text.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    kind = lambda at: F.coalesce(F.schema_of_variant(F.try_variant_get("v", at, "variant")), F.lit("VOID"))
    pathless = (kind("$.path") != "STRING") | (F.coalesce(F.try_variant_get("v", "$.path", "string"), F.lit("")) == "")
    empty = F.coalesce(F.to_json(F.try_variant_get("v", "$.proposed_changes", "variant")), F.lit("null")).isin("null", "[]", '""', "0", "false")
    shapeless = ~empty & ~kind("$.proposed_changes").startswith("OBJECT")
    reason = F.when(F.col("v").isNull(), "not JSON").when(pathless, "no path").when(shapeless, "proposals are no object")
    bad = v.select("file", "block", "id", reason.alias("reason"), F.col("value").alias("text")).where("reason IS NOT NULL")
    severity = F.when(F.col("reason") == "not JSON", "error").otherwise("warning")
    return with_numbers(bad, splits).select("file", "line", severity.alias("severity"), "reason", "text")


def inventory_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed (another length or time) between two inventories (path, length,
    modificationTime; one row a path). A plan over a growing archive reads what was added or changed only."""
    same = F.col("o.length").eqNullSafe(F.col("n.length")) & F.col("o.modificationTime").eqNullSafe(F.col("n.modificationTime"))
    both = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full")
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(~same, "changed")
    return both.select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change")).where("change IS NOT NULL")


def parse_changesets(lines: DataFrame) -> DataFrame:
    """Lines (``value``) as changesets, with the tags whose values are lists or maps (``nested``); a
    line that isn't JSON has ``bad`` and nothing else."""
    kept = lines.where(F.trim("value") != "").withColumn("v", F.expr("try_parse_json(value)")).withColumn("bad", F.col("v").isNull())
    kept = kept.withColumn("c", F.when(~F.col("bad"), F.from_json("value", CHANGESET)))
    kinds = F.expr("try_variant_get(v, '$.proposed_changes.set', 'map<string,variant>')")
    nested = F.map_keys(F.map_filter(kinds, lambda k, x: F.schema_of_variant(x).rlike("^(ARRAY|OBJECT)")))
    return kept.select("value", "bad", "c.path", F.col("c.proposed_changes.set").alias("set"), nested.alias("nested"))


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    return parse_changesets(spark.read.text(path))


def effective_context(batches: DataFrame, limit: int = rules.MAX_CONTEXT_BYTES) -> DataFrame:
    """The context of a batch: inline argument, argument file, manifest text, manifest file, the
    first that isn't blank, capped in bytes."""
    pick = F.coalesce(*[F.when(rules.blank_to_null(F.col(c)).isNotNull(), F.col(c)) for c in ("arg_text", "arg_file", "manifest_text", "manifest_file")])
    return batches.withColumn("photo_context", rules.capped_utf8(pick, limit))
