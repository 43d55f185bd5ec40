"""Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

A document's set: its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` after
lower-casing A-Z, as 64-bit hashes; with fewer words the whole sequence is the one shingle;
without words or text the set is empty and links with nothing. Two documents link when
``100 * intersection >= percent * union``.

1. One pass counts all shingles in a fixed table of 2^22 buckets; those above 1 / 2^18 of all
   shingles (so at most 2^18) are the frequent ones. Every set is ordered by that count, then hash.
2. Documents with equal sets become one class; copies never meet again. The prefixes' own shingles
   are then counted exactly: those in more than ``HOT_LIST`` prefixes go to the end of the order,
   by their count (the ``2^HOT_BITS`` most frequent in each of ``REORDERS`` rounds), and sets that had
   one in their prefix get another prefix. Shingles only ever move back, so all other prefixes stay.
3. A pair with overlap o shares at least l shingles of the prefixes of lengths n - o + l. Each
   class takes the l with the least estimated cost (list lengths, and verifications of at most
   lists / l candidates) for the least overlap of any partner; a pair must then share what its own
   overlap asks for: o less the shingles behind the prefix, on the side that asks for less.
4. In each prefix bucket one class is the centre: first that with the fewest rare shingles, in
   later rounds another. Classes are verified against the centres of their buckets in other
   components; what links is joined. Large groups of near copies become one component without
   all pairs of their members being listed.
5. Only pairs of different components are then listed from the buckets, under length,
   position and shared-prefix bounds. Pairs that parity sketches of the
   sets (1024 bits) can't rule out are verified on the full sets.
   Links inside a component can't change it, so no component is lost.

Keys may be any integers. A null key has a null component; a repeated row gets the same answer
again; a key with two texts counts as two documents that share a name. Empty tables give empty
results. Only key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, hashed_words, mix64, removed, slices, written
from .components import connected_components

BUCKET_BITS, FREQUENT_BITS = 22, 18
LEVELS, VERIFY_COST = 4, 50.0
SKETCH_BITS, STAR_ROUNDS = 1024, 2
HOT_LIST, HOT_BITS, REORDERS = 500, 20, 2
#: Pairs of one document that are verified together.
SHARE = 256
_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0676A9A99)]


def shingle_sets(texts: list, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in blocks_of(["" if t is None else t for t in texts]):
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]]
        begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        h, start, _ = hashed_words(b"\n".join(raw))
        at = np.searchsorted(start, begin)
        n = max(len(h) - words + 1, 0)
        full = np.zeros(n, np.uint64)
        for j in range(words):
            full += h[j : j + n] * _K[j % len(_K)]
        full = mix64(full)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                one = np.uint64(b - a)
                for j in range(a, b):
                    one = one + h[j] * _K[(j - a + 1) % len(_K)]
                yield mix64(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def frequent_buckets(src: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the frequent buckets, at most 2^FREQUENT_BITS of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(1 << BUCKET_BITS, np.uint32), 0
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                for s in shingle_sets(batch.column("text").to_pylist(), words):
                    np.add.at(sums, _bucket(s), np.uint32(1))
                    total += len(s)
        mean = total / len(sums)
        full = np.flatnonzero(sums >= 3 + mean + 4 * mean**0.5)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(sums[full].astype(np.int64), total))], names=["bucket", "c"])

    sums = written(src.select("text").mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")))
    total = sums.where("bucket = -1").agg(F.sum("c")).first()[0] or 0
    least = max(32, (total >> FREQUENT_BITS) + 1)
    rows = sums.where((F.col("bucket") >= 0) & (F.col("c") >= least)).toArrow()  # bounded by the threshold
    return rows["bucket"].to_numpy(), rows["c"].to_numpy()


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def ordered_prefixes(src: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc, n, digest of the set, level l, and the ordered prefix of the set for that level; ``hot``
    has shingles (sorted) whose counts are known exactly."""
    shared = src.sparkSession.sparkContext.broadcast((*frequent, *(hot or ())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << BUCKET_BITS, np.uint32)
        often[shared.value[0]] = np.minimum(shared.value[1], (1 << 32) - 1)
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                ns, digests, levels, prefixes, sketches = [], [], [], [], []
                for s in shingle_sets(batch.column("text").to_pylist(), words):
                    n = len(s)
                    ns.append(n)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    c = often[_bucket(s)]
                    if hot is not None and n:
                        at = np.minimum(np.searchsorted(shared.value[2], s), len(shared.value[2]) - 1)
                        c = np.where(shared.value[2][at] == s, np.maximum(c, shared.value[3][at]), c)
                    if c.any():
                        order = np.lexsort((s, c))
                        s, c = s[order], c[order]
                    keep = n - _ceil(percent * n, 100)
                    lists = [float(c[: keep + k].sum()) for k in range(1, LEVELS + 1)]
                    level = 1 + int(np.argmin([x + VERIFY_COST * x / (k + 1) for k, x in enumerate(lists)])) if n and lists[0] else 1
                    levels.append(level)
                    prefixes.append(s[: min(n, keep + level)].view(np.int64))
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(levels, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc", "n", "digest", "lvl", "prefix", "sketch"],
                )

    return src.mapInArrow(run, "doc long, n long, digest binary, lvl int, prefix array<long>, sketch array<long>")


def reordered(src: DataFrame, own: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The classes' rows with shingles of long posting lists at the end of the order, the shingles
    (token, k) that k > 1 of their prefixes share, and tables that are read no more."""
    spent: list[DataFrame] = []
    hot, hot_n = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for step in range(REORDERS + 1):
        token = own.select("v", F.explode("prefix").alias("token"))
        shared = written(token.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        if step == REORDERS:
            break
        top = shared.where(F.col("k") > HOT_LIST).orderBy(F.desc("k"), "token").limit(len(hot) + (1 << HOT_BITS)).toArrow()  # bounded
        new, k = top["token"].to_numpy().view(np.uint64), np.minimum(top["k"].to_numpy(), (1 << 32) - 1).astype(np.uint32)
        fresh = ~np.isin(new, hot)
        if not fresh.any():
            break
        new = new[fresh]
        hot, hot_n = np.concatenate((hot, new)), np.concatenate((hot_n, k[fresh]))
        order = np.argsort(hot)
        hot, hot_n = hot[order], hot_n[order]
        moved = F.broadcast(src.sparkSession.createDataFrame(pa.table({"token": pa.array(new.view(np.int64))})))
        held = written(token.join(moved, "token", "left_semi").select("v").distinct())
        keys = own.join(held, "v", "left_semi").select(F.col("v").alias("doc"), "digest")
        again = ordered_prefixes(src.join(held.withColumnRenamed("v", "doc"), "doc", "left_semi"), words, percent, frequent, (hot, hot_n))
        again = again.dropDuplicates(["doc", "digest"]).join(keys, ["doc", "digest"], "left_semi").withColumnRenamed("doc", "v")
        spent += [own, shared, held]
        own = written(own.join(held, "v", "left_anti").unionByName(again.select(own.columns)))
    return own, shared, spent


def _need(nx: Column, ny: Column, percent: int) -> Column:
    """The least overlap of a link between sets of these sizes."""
    return F.ceil((nx + ny) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def plausible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parity sketches don't rule out: every bit in which two sketches
    differ stands for at least one shingle that only one of the sets has."""
    side = lambda k: own.select(F.col("v").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where(apart <= F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, in either order. Texts travel, as they are
    smaller than their sets: for each pair that of the end with fewer pairs, and with every ``SHARE`` of
    them once that of the other end."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    side = lambda k: ends.select(F.col("v").alias(k), F.struct("k", "v").alias(f"k{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select(F.greatest("ka", "kb").alias("hub"), F.least("ka", "kb")["v"].alias("b"))
    both = written(both.select(F.col("hub.v").alias("a"), "b", F.ceil(F.col("hub.k") / SHARE).cast("int").alias("parts")))
    own = both.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b").join(texts.withColumnRenamed("v", "b"), "b")
    hubs = both.select("a", "parts").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rows = own.select("a", "part", "b", "text").unionByName(hubs.join(texts.withColumnRenamed("v", "a"), "a").select("a", "part", "b", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, []  # the hub's sets: a document id can stand on several texts
        for batch in slices(batches, 128):
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            ok = []
            with np.errstate(over="ignore"):
                for x, p, y, mine in zip(a, part, b, shingle_sets(batch.column("text").to_pylist(), words), strict=True):
                    if at != (x, p):
                        at, hub = (x, p), []
                    if y is None:
                        hub.append(mine)
                    ok.append(y is not None and any(100 * (o := len(np.intersect1d(h, mine, assume_unique=True))) >= percent * (len(h) + len(mine) - o) for h in hub))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def full_texts(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text) of the documents in ``wanted`` (v)."""
    return written(src.join(wanted.withColumnRenamed("v", "doc"), "doc", "left_semi").select(F.col("doc").alias("v"), "text"))


def star_pairs(mine: DataFrame, percent: int, step: int) -> DataFrame:
    """(a, b): classes and the centres of their buckets in other components. The first centre is
    the one with the fewest shared shingles before the bucket's; later ones go by another hash."""
    first = [F.col("u"), F.col("pos")] if step == 0 else [F.xxhash64("v", F.lit(step))]
    best = mine.groupBy("token").agg(F.min(F.struct(*first, "v", "n", "c", F.col("u").alias("bu"), F.col("pos").alias("bpos"))).alias("m"))
    best = written(best.select("token", F.col("m.v").alias("cv"), F.col("m.n").alias("cn"), F.col("m.c").alias("cc"), F.col("m.bu").alias("cu"), F.col("m.bpos").alias("cpos")))
    bound = F.least("u", "cu") + F.least(F.col("n") - F.col("pos"), F.col("cn") - F.col("cpos"))
    met = mine.join(best, "token").where("c <> cc").where((F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent) & (bound >= _need(F.col("n"), F.col("cn"), percent)))
    return met.select(F.least("v", "cv").alias("a"), F.greatest("v", "cv").alias("b")).distinct()


def mixed_pairs(mine: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components that share enough prefix shingles."""
    mixed = written(mine.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token"))
    rest = written(mine.join(mixed, "token"))
    names = ("v", "n", "lvl", "pos", "u", "c")
    x, y = (rest.select("token", *[F.col(k).alias(f"{side}_{k}") for k in names]) for side in "xy")
    p = {k: F.col(k) for k in [*x.columns, *y.columns]}
    need = _need(p["x_n"], p["y_n"], percent)
    bound = F.least(p["x_u"], p["y_u"]) + F.least(p["x_n"] - p["x_pos"], p["y_n"] - p["y_pos"])
    ordered = (p["x_n"] < p["y_n"]) | ((p["x_n"] == p["y_n"]) & (p["x_v"] < p["y_v"]))
    pairs = x.join(y, "token").where(ordered & (p["x_c"] != p["y_c"]) & (p["x_n"] * 100 >= p["y_n"] * percent) & (bound >= need))
    sides = [p[k] for k in ("x_v", "y_v", "x_n", "y_n", "x_lvl", "y_lvl")]
    behind = lambda s: F.greatest(F.lit(0), F.ceil(p[f"{s}_n"] * percent / F.lit(100) - F.lit(1e-9)) - p[f"{s}_lvl"])  # noqa: E731  shingles behind the prefix
    counted = pairs.groupBy(*sides).agg(F.count(F.lit(1)).alias("k"))
    return counted.where(F.col("k") >= need - F.greatest(behind("x"), behind("y"))).select(p["x_v"].alias("a"), p["y_v"].alias("b"))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, c) after further links (a, b)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(comp, "v", "left_anti").select("v", F.col("v").alias("c"))
    comp = written(comp.unionByName(ends))
    side = lambda k: comp.select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    step = connected_components(edges).select(F.col("v").alias("c"), F.col("c").alias("to"))
    return written(comp.join(step, "c", "left").select("v", F.coalesce("to", "c").alias("c")))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach) of every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent = frequent_buckets(src, words)
    sets = written(ordered_prefixes(src, words, percent, frequent))
    reps = written(sets.where("n > 0 AND doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("rep")))

    # postings of one document a class; only prefix shingles that two classes share stay
    own = sets.where("n > 0").join(reps.withColumnRenamed("rep", "doc"), ["digest", "doc"], "left_semi")
    own = written(own.select(F.col("doc").alias("v"), "digest", "n", "lvl", "prefix", "sketch"))
    own, shared, spent = reordered(src, own, words, percent, frequent)
    posts = own.select("v", "n", "lvl", F.posexplode("prefix").alias("pos", "token"))
    met = posts.join(shared.select("token"), "token").select("token", "v", "n", "lvl", "pos")
    met = written(met.selectExpr("*", "row_number() OVER (PARTITION BY v ORDER BY pos) - 1 AS u"))

    # 4. every class against the centres of its buckets; then what is left between components
    known = spark.createDataFrame([], "v long, text string")
    comp = spark.createDataFrame([], "v long, c long")
    for step in range(STAR_ROUNDS + 1):
        mine = written(met.join(comp, "v", "left").withColumn("c", F.coalesce("c", "v")))
        pairs = star_pairs(mine, percent, step) if step < STAR_ROUNDS else mixed_pairs(mine, percent)
        pairs = written(plausible(pairs, own, percent))
        spent += [mine, pairs]
        fresh = written(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(known.select("v"), "v", "left_anti"))
        texts = full_texts(src, fresh)
        spent += [fresh, texts]
        known = known.unionByName(texts)
        comp = merged(comp, written(verified(pairs, known, words, percent)))

    # every class's component, then every document's
    named_c = written(reps.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("digest", "rep", F.coalesce("c", "rep").alias("c")))
    least = written(named_c.groupBy("c").agg(F.min("rep").alias("component")))
    answer = written(named_c.join(least, "c").select("digest", "component"))
    removed(*spent, own, met)
    return sets.select("doc", "n", "digest").join(answer, "digest", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (one of its
    copies, where its row is repeated). Rows without an id link with nothing and stay."""
    label = jaccard_components(docs, words, percent)
    first = written(label.where("doc_id = component_id").select("doc_id").distinct())
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"])
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


#: DuckDB: exact all-pairs overlaps through an inverted index, then reachability.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(d, c) AS (SELECT a, b FROM o UNION SELECT r.d, o.b FROM r JOIN o ON r.c = o.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(c) FROM r WHERE r.d = s.doc_id), doc_id)) AS component_id FROM s
"""
