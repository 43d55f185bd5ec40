"""Collocated phrases of two and three words, grown best first.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words
``[^\\x20\\x09]+``. All is counted by language (null: ``und``): n words, and f(phrase), the contiguous
occurrences within pieces, overlaps included. A candidate has a = f >= ``least``. Cut after its first
words it has l = f(first part), r = f(rest) and score floor(1000000 a a / (l r)); its lowest-scoring cut
counts, of equal ones the shortest first part. A candidate whose words stand inside a longer one
that is at least ``cover`` percent as frequent is dropped. The first ``top`` of a language are returned.

Phrases grow from their prefixes, and counts of parts bound what can grow from them. A word below
``least`` grows nothing. A pair (v, w) has at most f(v w) extensions of any kind, so a triple that
begins with it scores at most 1000000 f(v w) / f(v) (cut after v, where the rest is as frequent as the triple at
least), and one that ends with it at most 1000000 f(v w) / f(w). The frontier is opened down to a
score T for each language, highest bounds first: triples are counted where both of their pairs reach T, and
around the pairs that score T themselves, as those may be dropped. Then all candidates with a score of T or
more are known, and which of them survive. Once there are ``top`` of these, ties included, or T is 0,
the language is settled; the others go on with a lower T.

Words of a piece of input are counted by number within a task and leave it as phrases with their counts, so a
frequent phrase is one row a task and chunk of text. What a task must know of the frontier are
tables of 2^``PLACES`` hashed places; phrases that share a place only cost a count more,
as sums are by the phrase itself, and scores are computed on decimals of 38 digits.

Null, empty and blank texts have no words; repeated rows count again; empty tables give no rows. Texts of any
length are read whole, in windows that keep the words before them. Languages may be any strings, ties go by
count and phrase (in byte order). Other columns than text and language aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, removed, slices, written

LEAST, TOP, COVER = 10, 2000, 50
PLACES = 23
#: Words that a task counts at a time, bytes of a text that are cut at a time, rows of a batch that leaves.
CHUNK, WINDOW, ROWS = 1_500_000, 1 << 21, 100_000
STARTS, ENDS, MEETS = 1, 2, 4
SALTS = 64
UNKNOWN = "und"
_BLANK, _BREAK = -1, -2
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class _Ids(dict):
    """Numbers of a language's words; a new one gets the next."""

    def __init__(self, lang: str, every: list) -> None:
        super().__init__({b"": _BLANK, b"\n": _BREAK})
        self.lang, self.every = lang, every

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.every)
        self.every.append((self.lang, word))
        return i


def windows(data: bytes) -> Iterator[list[bytes]]:
    """The words, blanks and breaks of a folded text, a bounded number of bytes at a time."""
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + WINDOW)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split(b" ")
        at = stop + 1


def words_hashed(every: list) -> np.ndarray:
    """64-bit hashes of (language, word)."""
    seed = {lang: zlib.crc32(lang.encode("utf-8", "surrogatepass")) for lang in {x[0] for x in every}}
    return np.array([xxhash.xxh64_intdigest(w, seed[lang]) for lang, w in every], np.uint64)


def places(h: np.ndarray, bits: int = PLACES) -> np.ndarray:
    return (mix64(h) >> np.uint64(64 - bits)).astype(np.int64)


def pair_places(x: np.ndarray, y: np.ndarray, bits: int = PLACES) -> np.ndarray:
    with np.errstate(over="ignore"):
        return places(x * _A + y * _B, bits)


def one_word(every: list, ids: np.ndarray, table: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    count = np.bincount(ids[ids >= 0], minlength=len(every))
    return [np.flatnonzero(count)], count[count > 0]


def two_words(every: list, ids: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs of words that may be frequent."""
    good = np.append(table[places(words_hashed(every))] > 0, [False, False])  # the last two: blanks and breaks
    at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
    key, count = np.unique(ids[at] * len(every) + ids[at + 1], return_counts=True)
    return [key // len(every), key % len(every)], count


def three_words(every: list, ids: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Triples in the frontier."""
    h = np.append(words_hashed(every), np.zeros(2, np.uint64))
    marks = np.zeros(max(len(ids) - 1, 0), np.uint8)
    for lo in range(0, len(marks), 1 << 18):
        x, y = ids[lo : lo + (1 << 18)], ids[lo + 1 : lo + 1 + (1 << 18)]
        x = x[: len(y)]
        marks[lo : lo + len(x)] = np.where((x >= 0) & (y >= 0), table[pair_places(h[x], h[y])] | 8, 0)
    left, right = marks[:-1], marks[1:]
    at = np.flatnonzero((left > 0) & (right > 0) & (((left & STARTS > 0) & (right & ENDS > 0)) | ((left | right) & MEETS > 0)))
    pair, of = np.unique(ids[at] * len(every) + ids[at + 1], return_inverse=True)
    key, count = np.unique(of.astype(np.int64) * len(every) + ids[at + 2], return_counts=True)
    pair = pair[key // len(every)] if len(key) else key
    return [pair // len(every), pair % len(every), key % len(every)], count


def counted(src: DataFrame, size: int, find: Callable, table: np.ndarray | None = None) -> DataFrame:
    """lang, w1 .. w<size> and their count a in all texts of ``src`` (lang, text), of the phrases that ``find`` takes up."""
    shared = None if table is None else src.sparkSession.sparkContext.broadcast(table)
    names = [f"w{i + 1}" for i in range(size)]

    def rows(every: list, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        which, count = find(every, ids, None if shared is None else shared.value)
        words, langs = pa.array([w for _, w in every], pa.binary()).cast(pa.string()), pa.array([lang for lang, _ in every], pa.string())
        made = [langs.take(pa.array(which[0])), *[words.take(pa.array(w)) for w in which], pa.array(count, pa.int64())]
        yield from slices([pa.RecordBatch.from_arrays(made, names=["lang", *names, "c"])], ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list = []
        of: dict[str, _Ids] = {}
        held: list[np.ndarray] = []
        total = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_FOLD).replace(b"\n", b" \n ")
                for tokens in windows(data):
                    own = of.get(lang) or of.setdefault(lang, _Ids(lang, every))
                    ids = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
                    held.append(ids[ids != _BLANK])
                    total += len(tokens)
                    if total >= CHUNK:
                        ids = np.concatenate(held)
                        yield from rows(every, ids)
                        tail = [every[i][1] if i >= 0 else b"\n" for i in ids[len(ids) - size + 1 :].tolist()]  # phrases may go on
                        every, of, total = [], {}, 0
                        own = of.setdefault(lang, _Ids(lang, every))
                        held = [np.array([own[w] for w in tail], np.int64)]
                held.append(np.array([_BREAK], np.int64))
        if every:
            yield from rows(every, np.concatenate(held))

    kinds = ", ".join(f"{w} string" for w in names)
    return src.mapInArrow(run, f"lang string, {kinds}, c long").groupBy("lang", *names).agg(F.sum("c").alias("a"))


def place_table(rows: DataFrame, mark: Column | None = None) -> np.ndarray:
    """By place, the marks of all words (lang, w1) or pairs (lang, w1, w2) that fall on it. At most 2^PLACES rows come to the driver."""
    words = [c for c in ("w1", "w2") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            h = [words_hashed([(a, w.encode("utf-8", "surrogatepass")) for a, w in zip(lang, batch.column(c).to_pylist(), strict=True)]) for c in words]
            at = places(h[0]) if len(h) == 1 else pair_places(*h)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("mark")], names=["place", "mark"])

    src = rows.select("lang", *words, (F.lit(1) if mark is None else mark).cast("int").alias("mark")).where("mark > 0")
    got = src.mapInArrow(run, "place long, mark int").groupBy("place").agg(F.bit_or("mark").alias("mark")).select(F.col("place").cast("int"), F.col("mark").cast("byte")).toArrow()
    out = np.zeros(1 << PLACES, np.uint8)
    out[got["place"].to_numpy()] = got["mark"].to_numpy()
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    big = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000), big(left) * big(right))


def nth_scores(rows: DataFrame, nth: DataFrame) -> DataFrame:
    """(lang, t): for each language of ``nth`` (lang, nth) its nth best score, 0 if it has fewer rows. Scores,
    of which a language has at most a million and one, are counted first."""
    per = rows.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("k"))
    run = per.withColumn("upto", F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return nth.join(run, "lang", "left").groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("nth"), F.col("score"))), F.lit(0)).alias("t"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, by score, count and phrase."""
    last = nth_scores(rows, rows.select("lang").distinct().withColumn("nth", F.lit(top)))
    rows = rows.join(last, "lang").where("score >= t").drop("t")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):  # ties are cut within salts first
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.drop("salt")


def grown_pairs(src: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n), and all pairs with a count of ``least`` or more: lang, w1, w2, a, l, r, score."""
    words = written(counted(src, 1, one_word))
    n = written(words.groupBy("lang").agg(F.sum("a").alias("n")))
    often = words.where(F.col("a") >= least)
    pairs = written(counted(src, 2, two_words, place_table(often)).where(F.col("a") >= least))
    one = lambda w, f: often.select("lang", F.col("w1").alias(w), F.col("a").alias(f))
    got = written(pairs.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"]).select("lang", "w1", "w2", "a", "l", "r").withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))))
    removed(words, pairs)
    return n, got


def grown_triples(src: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Of ``src`` (lang, text) the frontier's triples with a count of ``least`` or more, down to the score t that ``pairs``
    have for their language: lang, w1, w2, w3, a, l, r, score, t."""
    bound = lambda f: F.lit(1_000_000) * F.col("a") >= F.col("t") * F.col(f)
    mark = F.when(bound("l"), STARTS).otherwise(0) + F.when(bound("r"), ENDS).otherwise(0) + F.when(F.col("score") >= F.col("t"), MEETS).otherwise(0)
    found = written(counted(src, 3, three_words, place_table(pairs, mark)).where(F.col("a") >= least))
    head = pairs.select("lang", "t", "w1", "w2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = found.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    first, second = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    both = both.withColumn("s1", first).withColumn("s2", second).withColumn("short", F.col("s1") <= F.col("s2"))
    pick = lambda x, y: F.when(F.col("short"), F.col(x)).otherwise(F.col(y))
    got = written(both.select("lang", "w1", "w2", "w3", "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"), "t"))
    removed(found)
    return got


def surviving(pairs: DataFrame, triples: DataFrame, cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that score t or more and stay."""
    inside = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    most = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.where("score >= t").join(most, ["lang", "w1", "w2"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))
    keep = ["a", "l", "r", "score"]
    three = triples.where("score >= t")
    return two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), *keep).unionByName(three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), *keep))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n, every = grown_pairs(src, least)
    settled = None
    waiting = written(n.select("lang", F.lit(2 * top).cast("long").alias("nth")))
    while settled is None or waiting.limit(1).count():
        least_score = written(nth_scores(every, waiting))
        pairs = written(every.join(least_score, "lang"))
        triples = grown_triples(src if settled is None else src.join(waiting, "lang", "left_semi"), pairs, least)
        stay = written(surviving(pairs, triples, cover))
        have = waiting.join(least_score, "lang").join(stay.groupBy("lang").agg(F.count(F.lit(1)).alias("k")), "lang", "left")
        have = written(have.withColumn("done", (F.coalesce("k", F.lit(0)) >= top) | (F.col("t") == 0)))
        first = written(ranked(stay.join(have.where("done").select("lang"), "lang", "left_semi"), top))
        settled = first if settled is None else settled.unionByName(first)
        waiting = written(have.where("NOT done").select("lang", (F.col("nth") * 2).alias("nth")))
        removed(pairs, triples, stay)
    return settled.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB: all pairs and triples counted, then scored and compared.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS pid FROM d),
w AS (SELECT rid, pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
u AS (SELECT rid, pid, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS MATERIALIZED (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY rid, pid ORDER BY i)),
c1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
c2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT c2.lang, c2.x || ' ' || c2.y AS phrase, c2.f AS a, l.f AS l, r.f AS r, CAST(c2.f AS HUGEINT) * c2.f * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c2 JOIN c1 l ON l.lang = c2.lang AND l.x = c2.x JOIN c1 r ON r.lang = c2.lang AND r.x = c2.y
  WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND c3.x = c2.x AND c3.y = c2.y AND 100 * c3.f >= 50 * c2.f)
    AND NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = c2.lang AND c3.y = c2.x AND c3.z = c2.y AND 100 * c3.f >= 50 * c2.f)),
k3 AS (SELECT c3.lang, c3.x || ' ' || c3.y || ' ' || c3.z AS phrase, c3.f AS a, f1.f AS f1, f23.f AS f23, f12.f AS f12, f3.f AS f3,
  CAST(c3.f AS HUGEINT) * c3.f * 1000000 // (CAST(f1.f AS HUGEINT) * f23.f) AS s1, CAST(c3.f AS HUGEINT) * c3.f * 1000000 // (CAST(f12.f AS HUGEINT) * f3.f) AS s2
  FROM c3 JOIN c1 f1 ON f1.lang = c3.lang AND f1.x = c3.x JOIN c1 f3 ON f3.lang = c3.lang AND f3.x = c3.z
  JOIN c2 f12 ON f12.lang = c3.lang AND f12.x = c3.x AND f12.y = c3.y JOIN c2 f23 ON f23.lang = c3.lang AND f23.x = c3.y AND f23.y = c3.z),
a AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM k3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM a),
n AS (SELECT lang, sum(f) AS n FROM c1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""
