"""Metadata of files and groups: hydration, tag mapping, combination, forwarding, faces, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .grouping import first_by

# Tags that fill a manifest key, and the fields that requests carry.
TAG_KEYS = (
    ("EXIF:DateTimeOriginal", "dateTimeOriginal"), ("XMP:DateTimeOriginal", "dateTimeOriginal"), ("XMP-exif:DateTimeOriginal", "dateTimeOriginal"),
    ("EXIF:UserComment", "userComment"), ("Photoshop:Instructions", "userComment"), ("XMP:Instructions", "userComment"), ("XMP-photoshop:Instructions", "userComment"),
    ("IPTC:SpecialInstructions", "userComment"), ("XMP-iptcCore:Instructions", "userComment"),
    ("XMP:Description", "caption"), ("XMP-dc:Description", "caption"), ("IPTC:Caption-Abstract", "caption"),
    ("XMP:Title", "title"), ("XMP-dc:Title", "title"), ("IPTC:ObjectName", "title"),
)
DEFAULT_GUARDRAIL = "Answer with one JSON object of the shape above and nothing else."
FORWARDED = ("keywords", "title", "caption", "userComment", "dateTimeOriginal", "location", "city", "state", "stateProvince", "country", "locationShown", "gps", "faceTags")


def hydrate_comments(items: DataFrame, comments: DataFrame) -> DataFrame:
    """Fills blank user comments from (source_file, user_comment); what is there stays. Only blank
    rows take part in the join."""
    blank = rules.blank_to_null(F.col("user_comment")).isNull()
    one = comments.where(rules.blank_to_null(F.col("user_comment")).isNotNull()).groupBy(rules.normalize_path(F.col("source_file")).alias("src")).agg(F.min_by("user_comment", F.struct("tag_ord", "user_comment")).alias("new"))
    keyed = items.where(blank).withColumn("__src", rules.normalize_path(F.col("path")))  # a column, so that the join's sort doesn't work it out again
    filled = keyed.join(one, F.col("__src") == F.col("src"), "left").withColumn("user_comment", F.coalesce("new", "user_comment")).drop("src", "new", "__src")
    return filled.unionByName(items.where(~blank))


def field_list(fields: Sequence[str]) -> list[str]:
    """Names from a list whose entries may hold several, parted by commas; each once, in order."""
    return list(dict.fromkeys(p.strip() for f in fields if f for p in f.split(",") if p.strip()))


def tag_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_KEYS), "map_tag string, map_key string")


def map_exif_tags(tags: DataFrame, fields: Sequence[str] = (), raw: bool = False) -> DataFrame:
    """(source_file, dateTimeOriginal, userComment, caption, title, n_mapped): the first value in tag
    order that isn't blank, of the tags that map to each key, by full name or else by bare name; with
    ``raw`` also the map of all tags as they came.

    ``fields`` keeps tags of these names (full or bare) only. The tag map has 15 rows."""
    keys = tag_keys(tags.sparkSession)
    bare = keys.groupBy(rules.bare_tag(F.col("map_tag")).alias("map_bare")).agg(F.max("map_key").alias("bare_key"))
    t = tags.withColumn("bare", rules.bare_tag(F.col("tag")))
    fields = field_list(fields)
    if fields:
        t = t.where(F.col("tag").isin(*fields) | F.col("bare").isin(*[f.rsplit(":", 1)[-1] for f in fields]))
    t = t.join(F.broadcast(keys), F.col("tag") == F.col("map_tag"), "left").join(F.broadcast(bare), F.col("bare") == F.col("map_bare"), "left").withColumn("k", F.coalesce("map_key", "bare_key"))
    value = rules.blank_to_null(F.col("value"))
    kept = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("tag_ord", "tag", "value"))), lambda x: F.struct(x["tag"], x["value"])))
    pick = lambda k: first_by(value, "tag_ord", "tag", when=(F.col("k") == k) & value.isNotNull()).alias(k)
    return t.groupBy("source_file").agg(*[pick(k) for k in ("dateTimeOriginal", "userComment", "caption", "title")], F.count_if(F.col("k").isNotNull()).alias("n_mapped"), *([kept.alias("raw")] if raw else []))


def combine_group_metadata(items: DataFrame, *also: Column) -> DataFrame:
    """One row a group: the keywords of all its files (preferred files first, in order, without
    regard to case) and the first value of each field that isn't blank, preferred files first; so too
    gps, face_tags and location_shown, where the items have them, and what further aggregates are asked for."""
    pref = F.when(F.col("preferred"), 0).otherwise(1)
    field = lambda c: first_by(rules.strip(F.col(c)), pref.alias("p"), "ord", "path", when=rules.blank_to_null(F.col(c)).isNotNull()).alias(c)
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pref.alias("p"), "ord", "path", F.coalesce("keywords", F.array().cast("array<string>")).alias("k")))), lambda x: x["k"]))
    whole = lambda c: first_by(c, pref.alias("p"), "ord", "path", when=F.col(c).isNotNull()).alias(c)
    nested = [whole(c) for c in ("gps", "face_tags", "location_shown") if c in items.columns]
    return items.groupBy("group_key").agg(rules.ci_distinct(words).alias("keywords"), *nested, *[field(c) for c in ("title", "caption", "date_original", "location", "state_province", "city", "country", "user_comment")], *also)


def request_fields(combined: DataFrame) -> DataFrame:
    """Combined metadata under the names that requests carry."""
    names = {"user_comment": "userComment", "date_original": "dateTimeOriginal", "state_province": "stateProvince", "face_tags": "faceTags", "location_shown": "locationShown"}
    return combined.withColumnsRenamed(names)


def face_rows(combined: DataFrame, key: str = "group_key") -> DataFrame:
    """(path, pos, name, center_x, center_y, width, height) of combined face tags; ``path`` is the
    key. Centres come nested or flat, sizes under long or short names; what isn't a number is 0."""
    f = combined.where(F.col("face_tags").isNotNull()).select(F.col(key).alias("path"), F.posexplode("face_tags.faces").alias("pos", "f"))
    num = lambda *names: F.coalesce(*[F.col(f"f.{n}").try_cast("double") for n in names], F.lit(0.0))
    return f.select("path", "pos", "f.name", num("center.x", "centerX").alias("center_x"), num("center.y", "centerY").alias("center_y"), num("width", "w").alias("width"), num("height", "h").alias("height"))


def face_block(tags: Column) -> Column:
    """The block of ``face_blocks`` of one object's face tags, worked out on its own row; null where no face has a name."""
    num = lambda f, *names: F.coalesce(*[_at(f, n).try_cast("double") for n in names], F.lit(0.0))
    face = lambda f, i: F.struct(num(f, "center.x", "centerX").alias("center_x"), num(f, "center.y", "centerY").alias("center_y"), i.alias("pos"), rules.blank_to_null(f["name"]).alias("name"), num(f, "width", "w").alias("width"), num(f, "height", "h").alias("height"))
    named = F.array_sort(F.filter(F.transform(tags["faces"], face), lambda x: x["name"].isNotNull()))
    return F.nullif(F.array_join(F.transform(named, _face_line), "\n"), F.lit(""))


def _at(f: Column, path: str) -> Column:
    for name in path.split("."):
        f = f[name]
    return f


def _face_line(x: Column, i: Column) -> Column:
    return F.format_string("%d. %s (cx=%.3f, cy=%.3f, w=%.3f, h=%.3f)", i + 1, x["name"], x["center_x"], x["center_y"], x["width"], x["height"])


def forwarded_metadata(meta: DataFrame, extra: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(group_key, forwarded): the fields that a request may carry, as JSON without nulls; state is
    filled from stateProvince. Columns in ``keep`` as they are."""
    have = [c for c in (*FORWARDED, *extra) if c in meta.columns]
    if "stateProvince" in have:
        state = F.coalesce("state", "stateProvince") if "state" in have else F.col("stateProvince")
        meta = meta.withColumn("state", state)
        have = list(dict.fromkeys([*have, "state"]))
    return meta.select("group_key", F.to_json(F.struct(*have)).alias("forwarded"), *keep)


def face_blocks(faces: DataFrame) -> DataFrame:
    """(path, n_faces, block): named faces numbered from left to right, then downwards."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    named = faces.select("path", "pos", rules.blank_to_null(F.col("name")).alias("name"), *[num(c).alias(c) for c in ("center_x", "center_y", "width", "height")]).where("name IS NOT NULL")
    g = named.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("center_x", "center_y", "pos", "name", "width", "height"))).alias("f"))
    return g.select("path", F.size("f").alias("n_faces"), F.array_join(F.transform("f", _face_line), "\n").alias("block"))


def build_requests(groups: DataFrame, pieces: dict[str, str]) -> DataFrame:
    """(group_key, piece_ord, kind, text): the ordered pieces of every group's request.

    ``groups`` has forwarded, face_block and photo_context (null where there is none), and may have
    group_note, which stands last; ``pieces``
    are the constant texts header, instructions, image_rules, categories, forbidden, vocabulary
    and output_format, and may have guardrail, which follows the group's own pieces."""
    fixed = ("header", "instructions", "image_rules", "categories", "forbidden", "vocabulary", "output_format")
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    given = lambda c, head: F.when(rules.blank_to_null(F.col(c)).isNotNull(), F.concat(F.lit(head), F.col(c)))
    every = [piece(k, F.lit(pieces[k].strip())) for k in fixed] + [
        piece("metadata", given("forwarded", "Forwarded metadata: ")), piece("faces", given("face_block", "[FACE TAGS — AUTHORITATIVE]\n")),
        piece("context", given("photo_context", "[PHOTO CONTEXT — AUTHORITATIVE]\n")), piece("guardrail", F.lit(pieces.get("guardrail", DEFAULT_GUARDRAIL))),
        *([piece("group_note", F.col("group_note"))] if "group_note" in groups.columns else []),
    ]
    kept = F.filter(F.array(*every), lambda p: p["text"].isNotNull())
    return groups.select("group_key", F.posexplode(kept).alias("piece_ord", "p")).select("group_key", "piece_ord", "p.kind", "p.text")


def group_notes(counts: DataFrame) -> DataFrame:
    """(group_key, group_note): which parts a request shows, for groups with more than one image
    (counts: group_key, part_ord, label, n_images)."""
    g = counts.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("part_ord", "n_images", "label"))).alias("p"), F.sum("n_images").alias("n"))
    parts = F.array_join(F.transform("p", lambda x: F.concat(x["n_images"].cast("string"), F.lit(" x "), x["label"])), ", ")
    return g.where("n > 1").select("group_key", F.concat(F.lit("These images show one object, in this order: "), parts).alias("group_note"))


def payload_plan(images: DataFrame, max_edge: int | None = 1024) -> DataFrame:
    """Adds sent_width, sent_height, resized and mime to images with path, width and height."""
    w, h = F.col("width"), F.col("height")
    tiff = F.lower("path").rlike(r"\.tiff?$")
    sized = bool(max_edge and max_edge > 0)
    kind: Column = F.when(tiff | F.lit(sized), "image/jpeg").when(F.lower("path").endswith(".png"), "image/png").otherwise("image/jpeg")
    return images.withColumn("sent_width", rules.scaled(w, w, h, max_edge)).withColumn("sent_height", rules.scaled(h, w, h, max_edge)).withColumn("resized", (F.greatest(w, h) > max_edge) if sized else F.lit(False)).withColumn("mime", kind)
