"""Manifest groups: the primary, parts in order, variant pairs and file lists.

Everything is keyed by group_key and ordered by ``ord``, the place in the manifest; aggregates
with an explicit order take the place of sorted windows where one row a key is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT, MERGE = "master_exact", "merge_per_variant"


def is_back() -> Column:
    return F.col("part_kind") == "back"


def first_by(value: str | Column, *order: Column | str, when: Column | None = None) -> Column:
    """The value of the first row by an order, among the rows that a condition admits."""
    rank = F.struct(*order)
    return F.min_by(value, rank if when is None else F.when(when, rank))


def group_manifest(items: DataFrame) -> DataFrame:
    """One row a group with its size and first path, groups in order of their lower-cased key."""
    g = items.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_items"), first_by("path", "ord", "path").alias("first_path"), F.count_if(is_back()).alias("n_backs"))
    return g.orderBy(F.lower("group_key"), "group_key")


def primary_order(policy: str = EXACT) -> Column:
    """What orders a group's files by: the first is its primary (r, s, ord, path, version, back)."""
    v, front = F.col("variant_id"), ~is_back()
    rank = F.when(F.col("preferred"), 0).when(F.lit(policy == EXACT) & front, 1).when(front & v.isNull(), 2).otherwise(3)
    by_version = F.when(rank == 1, F.coalesce(v, F.lit("")))
    return F.struct(rank.alias("r"), F.coalesce(by_version, F.lit("")).alias("s"), F.col("ord"), F.col("path"), v.alias("version"), is_back().alias("back"))


def group_summary(items: DataFrame, policy: str = EXACT) -> DataFrame:
    """group_key, primary_path, primary_version, back_path, primary_front, and the numbers of
    variants, pages and files of every group.

    Primary: the first preferred item; with ``master_exact`` else the non-back of lowest version
    (none before any letter); else the first unversioned non-back; else the first item. Back: of
    the primary's version, else unversioned, else any; the first of its rank.

    The table is read once. Rows are first reduced to one a version and page, so a giant group is
    small when its rows meet; a group's backs are then one a version."""
    v, front = F.col("variant_id"), ~is_back()
    best = F.min(primary_order(policy))
    earliest = lambda c: F.min(F.when(c, F.struct("ord", "path")))
    one = items.groupBy("group_key", "variant_id", "page_num").agg(best.alias("p"), earliest(front).alias("f"), earliest(is_back()).alias("b"), F.count(F.lit(1)).alias("n"))
    backs = F.collect_list(F.when(F.col("b").isNotNull(), F.struct(v.alias("version"), "b")))
    g = one.groupBy("group_key").agg(
        F.min("p").alias("p"), F.min("f").alias("f"), backs.alias("backs"), F.sum("n").alias("n_files"),
        F.size(F.collect_set("variant_id")).alias("letters"), F.count_distinct("page_num").alias("n_pages"),
    )
    close = lambda x: F.when(x["version"].eqNullSafe(F.col("p.version")), 0).when(x["version"].isNull(), 1).otherwise(2)
    back = F.array_min(F.transform("backs", lambda x: F.struct(close(x).alias("c"), x["b"].alias("b"))))
    return g.select(
        "group_key", F.col("p.path").alias("primary_path"), F.col("p.version").alias("primary_version"), back["b"]["path"].alias("back_path"),
        F.when(F.col("p.back"), F.coalesce("f.path", "p.path")).otherwise(F.col("p.path")).alias("primary_front"),
        F.col("letters").cast("long").alias("n_variants"), "n_pages", "n_files",
    )


def select_primary(items: DataFrame, policy: str = EXACT) -> DataFrame:
    """group_key, primary_path, primary_version, back_path, primary_front (see ``group_summary``)."""
    return group_summary(items, policy).select("group_key", "primary_path", "primary_version", "back_path", "primary_front")


def variant_parts(items: DataFrame) -> DataFrame:
    """(group_key, version, part, path, multipage): the first path of every part of a version. In a
    group with pages an untagged file is page 1 of a version that has none. Negatives share the
    untagged part."""
    part = F.when(F.col("part_kind").isin("front", "back"), F.col("part_kind")).when(F.col("part_kind") == "page", F.concat(F.lit("page:"), F.col("page_num").cast("string"))).otherwise("none")
    one = items.groupBy("group_key", F.col("variant_id").alias("version"), part.alias("part")).agg(first_by("path", "ord", "path").alias("path"), F.min("ord").alias("first_ord"))
    w, wv = Window.partitionBy("group_key"), Window.partitionBy("group_key", "version")
    # the finer window first, on rows that stand by group: its order serves the other too, so rows are sorted once for both
    one = one.repartition("group_key").withColumn("has_1", F.max(F.col("part") == "page:1").over(wv)).withColumn("multipage", F.max(F.col("part").startswith("page:")).over(w))
    moved = F.col("multipage") & ~F.col("has_1") & (F.col("part") == "none")
    return one.withColumn("part", F.when(moved, "page:1").otherwise(F.col("part"))).drop("has_1")


def primary_parts(items: DataFrame, policy: str = EXACT) -> DataFrame:
    """``assemble_parts`` of the primary pair alone: the primary's front, then its back if it is
    another file."""
    g = select_primary(items, policy)
    pair = F.array(F.struct(F.lit("Front").alias("label"), F.col("primary_front").alias("path")), F.when(F.col("back_path") != F.col("primary_front"), F.struct(F.lit("Back").alias("label"), F.col("back_path").alias("path"))))
    return g.select("group_key", F.posexplode(F.array_compact(pair)).alias("i", "x")).select("group_key", (F.col("i") + 1).alias("part_ord"), "x.label", F.lit(1).alias("img_ord"), "x.path")


def assemble_parts(items: DataFrame, all_variants: bool = True, policy: str = EXACT) -> DataFrame:
    """(group_key, part_ord, label, img_ord, path): pages in order, then fronts, then backs; within
    a part versions by letter, the unversioned last; a path once a part. Without ``all_variants``
    the primary pair alone."""
    if not all_variants:
        return primary_parts(items, policy)
    p = variant_parts(items)
    num = F.regexp_extract("part", r"^page:([0-9]+)$", 1).try_cast("int")
    front = (F.col("part") == "front") | ((F.col("part") == "none") & ~F.col("multipage"))
    label = F.when(num.isNotNull(), F.concat(F.lit("Page "), num.cast("string"))).when(front, "Front").when(F.col("part") == "back", "Back")
    place = F.when(num.isNotNull(), num.cast("long")).when(front, F.lit(1 << 40)).otherwise(F.lit(1 << 41))
    rows = p.select("group_key", label.alias("label"), place.alias("place"), "version", "path", F.when(F.col("part") == "front", 0).otherwise(1).alias("tagged"), "first_ord").where("label IS NOT NULL")
    # place second, so that the aggregation's order serves the rank of places
    rows = rows.groupBy("group_key", "place", "path", "label").agg(F.min(F.struct(F.col("version").isNull().alias("n"), "version", "tagged", "first_ord")).alias("o"))
    w = Window.partitionBy("group_key")
    return rows.select("group_key", F.dense_rank().over(w.orderBy("place")).alias("part_ord"), "label", F.row_number().over(Window.partitionBy("group_key", "place").orderBy("o", "path")).alias("img_ord"), "path")


def part_counts(parts: DataFrame) -> DataFrame:
    """(group_key, part_ord, label, n_images) of assembled parts."""
    return parts.groupBy("group_key", "part_ord", "label").agg(F.count(F.lit(1)).alias("n_images"))


def variant_pairs(items: DataFrame) -> DataFrame:
    """(group_key, version, front, back): untagged files, or page 1 in groups with pages, are
    fronts, and come before a file tagged front."""
    p = variant_parts(items)
    lead = F.when(F.col("multipage"), F.lit("page:1")).otherwise(F.lit("none"))
    one = lambda c: F.max(F.when(c, F.col("path")))
    g = p.groupBy("group_key", "version").agg(one(F.col("part") == lead).alias("a"), one(F.col("part") == "front").alias("b"), one(F.col("part") == "back").alias("back"))
    return g.select("group_key", "version", F.coalesce("a", "b").alias("front"), "back").where("front IS NOT NULL OR back IS NOT NULL")


def variant_files(items: DataFrame) -> DataFrame:
    """One row a group: paths of fronts (all that aren't backs), backs, and all, in manifest order,
    and the variants as structs."""
    s = F.struct("ord", "path", F.col("variant_id").alias("version"), is_back().alias("is_back"), F.coalesce("preferred", F.lit(False)).alias("preferred"))
    g = items.groupBy("group_key").agg(F.array_sort(F.collect_list(s)).alias("variants"))
    paths = lambda keep: F.transform(F.filter("variants", keep), lambda x: x["path"])
    return g.select("group_key", paths(lambda x: ~x["is_back"]).alias("front"), paths(lambda x: x["is_back"]).alias("back"), F.transform("variants", lambda x: x["path"]).alias("all"), "variants")


def page_map(items: DataFrame) -> DataFrame:
    """(group_key, pages): page number to its paths in version order."""
    p = assemble_parts(items).where(F.col("label").startswith("Page "))
    g = p.groupBy("group_key", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("img_ord", "path"))), lambda x: x["path"]).alias("paths"))
    return g.groupBy("group_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.regexp_extract("label", "[0-9]+", 0), "paths")))).alias("pages"))


def fan_out(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Every group's result to each of its files."""
    return items.join(groups, "group_key")
