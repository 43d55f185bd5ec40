"""Near-duplicates by fast similarity sketches, bands and exact verification.

A document's set: its distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` after lower-casing
A-Z, as 64-bit hashes; with fewer words the whole sequence is the one shingle; without words or text the
set is empty and links with nothing. Two documents link when ``100 * intersection >= percent * union``.

1. Sketch. A set fills ``BINS`` coordinates in rounds: in round i every element goes to one bin, both bin and
   value drawn from its hash for that round, and a bin keeps the least (round, value). Rounds go on
   until no bin is empty; from round ``BINS`` on all elements go to bin i - ``BINS``, so every coordinate
   fills. Small sets take many rounds and large ones a few, about BINS ln BINS + n hashes in all.
   Two sketches agree in a coordinate with the sets' similarity, and the share that agrees is as
   concentrated as with as many independent hashes (Dahlgaard, Knudsen and Thorup 2017), which sets with one
   round's empty bins filled up from others don't give.
2. Bands. ``BANDS`` bands of ``DEPTH`` coordinates: two sets with similarity 0.8 share none with a chance
   of (1 - 0.8^6)^80 = 3e-11. Equal sets are one class beforehand, so copies never meet.
3. In each band bucket one class is the centre. Every class is compared with two of its buckets' centres in
   other components (that with which it shares most bands, and the first), and what links is joined. After
   ``STARS`` such rounds, each with another order of centres, the pairs that are still in different components are listed, all of them. Large groups of near copies so become
   one component from a few pairs for each. Links inside a component can't change it.
4. A pair is dropped without looking at its texts where its sizes rule a link out; where more bits differ
   in the sets' parities (``PARITY`` bits, each odd or even by the elements that hash to it) than elements may; or
   where more than ``APART`` of the sketches' parity bits differ: of 480 bits 48 do at 0.8, and 102 or more with
   a chance of 4e-12. All others are verified on the full sets.

Keys may be any integers. A null key has a null component and is kept; a repeated row gets the same
answer again; a key with two texts counts as two documents that share a name. Null, empty and blank texts
have no shingles and stay; texts of any length are read whole; an empty table gives an empty one. Only key
and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, removed, slices, written
from .ngramjoin import _need, full_texts, merged, shingle_sets, verified

BANDS, DEPTH = 80, 6
BINS = BANDS * DEPTH
APART, PARITY = 101, 1024
STARS = 1
#: Hashes for each bin in the first rounds of a small set: nearly all then have no empty bin.
THROWS = 9
#: Sets that are sketched together: what they throw fits a cache.
BLOCK = 32
_SALT, _BAND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_VALUE = np.uint64((1 << 48) - 1)
_EMPTY = np.uint64((1 << 64) - 1)


def thrown(elements: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """An element's hash for a round."""
    return mix64(elements + (rounds.astype(np.uint64) + np.uint64(1)) * _SALT)


def sketched(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` coordinates for every set, the round in the upper 16 bits; those of an empty set stay unfilled."""
    blocks = [_sketched(sets[lo : lo + BLOCK], bins) for lo in range(0, len(sets), BLOCK)]
    return np.concatenate(blocks) if blocks else np.zeros((0, bins), np.uint64)


def _sketched(sets: list[np.ndarray], bins: int) -> np.ndarray:
    out = np.full((len(sets), bins), _EMPTY)
    flat = out.reshape(-1)
    size = np.array([len(s) for s in sets], np.int64)
    done = np.zeros(len(sets), np.int64)  # rounds that a set has had
    live = np.flatnonzero(size)
    while len(live):
        rounds = np.minimum(-(-THROWS * bins // size[live]), bins - done[live])
        # every element of a set, once for each of its rounds
        times = np.repeat(rounds, size[live])
        x = np.repeat(np.concatenate([sets[i] for i in live]), times)
        first = np.cumsum(times) - times
        at = np.arange(len(x)) - np.repeat(first, times) + np.repeat(np.repeat(done[live], size[live]), times)
        h = thrown(x, at)
        bin_ = (h >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)
        np.minimum.at(flat, np.repeat(np.repeat(live, size[live]), times) * bins + bin_.astype(np.int64), at.astype(np.uint64) << np.uint64(48) | h & _VALUE)
        done[live] += rounds
        live = live[(out[live] == _EMPTY).any(1)]
        for i in live[done[live] >= bins].tolist():
            b = np.flatnonzero(out[i] == _EMPTY)
            value = (thrown(sets[i][:, None], b + bins) & _VALUE).min(0)
            out[i, b] = (b + bins).astype(np.uint64) << np.uint64(48) | value
        live = live[done[live] < bins]
    return out


def banded(sketch: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One hash for each band of each sketch."""
    parts = sketch.reshape(len(sketch), -1, depth)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(depth):
        h = mix64(h * _BAND + parts[:, :, k])
    return h.view(np.int64)


def signed(sketch: np.ndarray) -> np.ndarray:
    """A parity bit for each coordinate, in words of 64."""
    return packed((sketch & np.uint64(1)).astype(np.uint8))


def odd(sets: list[np.ndarray]) -> np.ndarray:
    """For each of ``PARITY`` places whether an odd number of a set's elements hash to it."""
    rows = [np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1 for s in sets]
    return packed(np.array(rows, np.uint8).reshape(len(sets), PARITY))


def packed(bits: np.ndarray) -> np.ndarray:
    got = np.packbits(bits, axis=1)
    wide = np.zeros((len(got), -(-got.shape[1] // 8) * 8), np.uint8)
    wide[:, : got.shape[1]] = got
    return wide.view(np.int64)


def sketch_table(src: DataFrame, words: int) -> DataFrame:
    """doc, n, digest of the set, its bands and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        for batch in slices(batches, 256):
            with np.errstate(over="ignore"):
                sets = list(shingle_sets(batch.column("text").to_pylist(), words))
                sketch = sketched(sets)
                bands, bits = banded(sketch), np.concatenate((signed(sketch), odd(sets)), axis=1)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), n, pa.array(digest, pa.binary()), lists(bands), lists(bits)], names=["doc", "n", "digest", "bands", "bits"])

    return src.mapInArrow(run, "doc long, n long, digest binary, bands array<long>, bits array<long>")


def near(na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    """Whether sizes, the sets' parities and the sketches' leave a link possible."""
    cut = -(-BINS // 64)
    apart = lambda lo, hi: reduce(add, [F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(lo, hi)])
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (apart(cut, cut + PARITY // 64) <= na + nb - 2 * _need(na, nb, percent)) & (apart(0, cut) <= APART)


def met_pairs(mine: DataFrame, own: DataFrame, percent: int, step: int | None) -> DataFrame:
    """(a, b): of the classes (token, v, c) in buckets with several components, each with two centres of its buckets in
    other components, that which it meets most often and the first by the order of that ``step``; without a step all pairs
    of different components."""
    rank = F.col("v") if step == 0 else F.xxhash64("v", F.lit(step or 0))
    mixed = mine.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(rank.alias("r"), "v", "c")).alias("m")).where("lo < hi")
    side = lambda k: own.select(F.col("v").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"s{k}"))
    close = near(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)
    if step is not None:
        met = mine.join(mixed.select("token", "m"), "token").where(F.col("c") != F.col("m.c"))
        often = met.groupBy(F.col("v").alias("b"), "m").agg(F.count(F.lit(1)).alias("k"))
        two = often.groupBy("b").agg(F.min("m").alias("x"), F.max(F.struct("k", "m")).alias("y"))
        pairs = two.select(F.explode(F.array_distinct(F.array("x.v", "y.m.v"))).alias("a"), "b")
        return pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b")
    rest = written(mine.join(mixed.select("token"), "token").join(own.select("v", "n", "bits"), "v"))
    x, y = (rest.select("token", F.col("v").alias(k), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"s{k}")) for k in "ab")
    return x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach) and kept (whether the row has that key, or none) of every row."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 and more")
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = written(sketch_table(src, words))
    reps = written(sets.where("n > 0 AND doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("rep")))
    own = written(sets.where("n > 0").join(reps.withColumnRenamed("rep", "doc"), ["digest", "doc"], "left_semi").select(F.col("doc").alias("v"), "n", "bands", "bits").dropDuplicates(["v", "n", "bits"]))
    posts = own.select("v", F.explode("bands").alias("token"))
    shared = written(posts.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"))
    met = written(posts.join(shared, "token").select("token", "v"))

    known = spark.createDataFrame([], "v long, text string")
    comp = spark.createDataFrame([], "v long, c long")
    spent = []
    for step in [*range(STARS), None]:
        mine = written(met.join(comp, "v", "left").select("token", "v", F.coalesce("c", "v").alias("c")))
        pairs = written(met_pairs(mine, own, percent, step))
        fresh = written(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(known.select("v"), "v", "left_anti"))
        texts = full_texts(src, fresh)
        known = known.unionByName(texts)
        comp = merged(comp, written(verified(pairs, known, words, percent)))
        spent += [texts]
        removed(mine, pairs, fresh)

    named = written(reps.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("digest", "rep", F.coalesce("c", "rep").alias("c")))
    least = written(named.groupBy("c").agg(F.min("rep").alias("component")))
    answer = written(named.join(least, "c").select("digest", "component"))
    removed(*spent, own, shared, met, named, least)
    got = sets.select("doc", "n", "digest").join(answer, "digest", "left").withColumn("component_id", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")))
    return got.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


#: DuckDB: exact all-pairs overlaps through an inverted index, then reachability.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(d, c) AS (SELECT a, b FROM o UNION SELECT r.d, o.b FROM r JOIN o ON r.c = o.a),
k AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(c) FROM r WHERE r.d = s.doc_id), doc_id)) AS component_id FROM s)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM k
"""
