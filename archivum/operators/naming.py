"""File names to physical objects: parsing, folder slots and the plan of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.archive import is_image


NAMED = ("base_id", "variant_id", "part_kind", "page_num", "is_crop", "group_key")


def parse_media_names(files: DataFrame, by_dir: bool = False, explicit: bool = True) -> DataFrame:
    """Adds base_id, variant_id, part_kind, page_num, is_crop and group_key to rows with a path.

    A name is ``base[variant][-front|-back|-negative|-pageN][-crop]``, read from the right without
    regard to case; the variant is ``-x`` or a letter after a digit. Steps stand in projections of
    their own, so that each is worked out once. With ``explicit``, columns ``is_back`` and
    ``version`` of a manifest win over the name where they aren't null."""
    given = [F.col(f"`{c}`") for c in files.columns if c not in NAMED]
    x = lambda c: F.col(f"__{c}")
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    out = files.select(*given, rules.stem(F.col("path")).alias("__name"))
    out = out.withColumn("is_crop", F.lower(F.right(x("name"), F.lit(5))) == "-crop")
    out = out.withColumn("__body", F.when(F.col("is_crop"), cut(x("name"), 5)).otherwise(x("name")))
    out = out.withColumn("__tag", F.lower(F.regexp_extract("__body", r"(?i)-(negative|back|front|page[0-9]+)$", 1)))
    out = out.withColumn("__rest", F.when(x("tag") != "", cut(x("body"), F.length(x("tag")) + 1)).otherwise(x("body")))
    out = out.withColumn("__last", F.right(x("rest"), F.lit(1))).withColumn("__prev", cut(F.right(x("rest"), F.lit(2)), 1))
    letter = (x("last").between("a", "z") | x("last").between("A", "Z")) & (F.length("__rest") > 1)
    dashed = letter & (x("prev") == "-") & (F.length("__rest") > 2)
    out = out.withColumn("__drop", F.when(dashed, 2).when(letter & x("prev").between("0", "9"), 1).otherwise(0))
    page = x("tag").startswith("page")
    kind, variant = F.when(page, "page").when(x("tag") == "", "none").otherwise(x("tag")), F.when(x("drop") > 0, F.lower(x("last")))
    if explicit and "is_back" in files.columns:
        kind = F.when(F.col("is_back"), "back").when(~F.col("is_back") & (kind == "back"), "none").otherwise(kind)
    if explicit and "version" in files.columns:
        variant = F.coalesce(F.lower(rules.blank_to_null(F.col("version"))), variant)
    # never null, so that joins by group need no null filter, which would be pushed below all steps
    base = F.coalesce(cut(x("rest"), x("drop")), F.lit(""))
    folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)))
    key = F.concat(F.coalesce(folder, F.lit("")), base) if by_dir else base
    names = [c.alias(n) for n, c in zip(NAMED, (base, variant, kind, F.when(page, F.substring("__tag", 5, 9)).try_cast("int"), F.col("is_crop"), key), strict=True)]
    return out.select(*given, *names)


def media_files(files: DataFrame, by_dir: bool = False, exclude_crops: bool = False) -> DataFrame:
    """Images with their parsed names and ids; a narrow step. Crops join their group as other files
    do, unless they are excluded."""
    named = parse_media_names(files.where(is_image(F.col("path"))), by_dir)
    return (named.where(~F.col("is_crop")) if exclude_crops else named).withColumn("photo_id", F.concat(F.lit("sha1:"), F.sha1(rules.normalize_path(F.col("path")))))


def folder_slots(media: DataFrame) -> DataFrame:
    """(group_key, slot, version, page_num, path): one path a slot, the lexicographically last."""
    crop = F.when(F.col("is_crop"), "_crop").otherwise("")
    slot = F.when(F.col("part_kind") == "negative", "negative").when(F.col("part_kind") == "page", "page").when(F.col("part_kind") == "back", "back").otherwise("front")
    plain = F.col("part_kind").isin("negative", "page")
    return media.groupBy("group_key", F.concat(slot, crop).alias("slot"), F.when(~plain, F.col("variant_id")).alias("version"), F.when(F.col("part_kind") == "page", F.coalesce("page_num", F.lit(1))).alias("page_num")).agg(F.max("path").alias("path"))


def group_folder(media: DataFrame) -> DataFrame:
    """One row a group: the primary's slots, negatives, and the aligned all_fronts / all_backs."""
    s = folder_slots(media)
    first = lambda slot: F.max(F.when((F.col("slot") == slot) & F.col("version").isNull(), F.col("path")))
    g = s.groupBy("group_key").agg(
        *[first(k).alias(k) for k in ("front", "back", "front_crop", "back_crop", "negative", "negative_crop")],
        F.array_sort(F.collect_list(F.when(F.col("slot") == "page", F.struct("page_num", "path")))).alias("pages"),
        F.collect_list(F.when(F.col("version").isNotNull(), F.struct("version", "slot", "path"))).alias("__v"),  # 26 letters by 4 slots
    )
    path = lambda v, slot: F.array_max(F.transform(F.filter("__v", lambda x: (x["version"] == v) & (x["slot"] == slot)), lambda x: x["path"]))
    letters = F.array_sort(F.array_distinct(F.transform("__v", lambda x: x["version"])))
    g = g.withColumn("variants", F.transform(letters, lambda v: F.struct(v.alias("version"), path(v, "front").alias("front"), path(v, "back").alias("back")))).drop("__v")
    paged = F.size("pages") > 0
    side = lambda k: F.concat(F.array(F.col(k)), F.transform("variants", lambda x: x[k]))
    none = F.transform("pages", lambda p: F.lit(None).cast("string"))
    return g.withColumn("all_fronts", F.when(paged, F.transform("pages", lambda p: p["path"])).otherwise(side("front"))).withColumn("all_backs", F.when(paged, none).otherwise(side("back")))


def folder_analysis_plan(groups: DataFrame) -> DataFrame:
    """Groups with a primary front: what is analysed, and every variant's file. Groups without one
    (such as albums of pages only) have ``skipped``."""
    every = F.array_compact(F.concat(F.array("front", "back"), F.transform("variants", lambda x: x["front"]), F.transform("variants", lambda x: x["back"])))
    return groups.select("group_key", F.col("front").isNull().alias("skipped"), "front", "back", F.when(F.col("front").isNotNull(), every).alias("files"))
