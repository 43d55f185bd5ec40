"""Periodic runs of words, caught online over a dyadic grid.

A run is a stretch of consecutive words with smallest period q, at least ``min_length`` words and
``repeats`` periods long, that no neighbouring word extends keeping period q. Words are
``[^\\x20\\x09-\\x0D]+``, numbered from 0.

Words arrive in order. At level k a catcher stands over every completed block of 2^k words and waits
for it to come again 2^k to 2^(k+1) - 1 words later. A word that arrives ends one suffix of 2^k words at
every level, and one catcher of that level is due for it, so it advances one comparison a level, of
fingerprints made from those of a suffix's two halves. Two catchers in a row that catch at the same
distance have seen a square of that period; squares of a period that follow each other merge into one
run, and shorter and shorter suffixes find its ends. A stretch found under several periods
keeps the smallest, of which the others are multiples.

Equal words have equal fingerprints, so no run is missed; every run is confirmed on the words
themselves, and a text in which one fails is done again with other fingerprints. Time grows with n log n
of a text's n words, memory too (8 bytes a word and level).

Null, empty and blank texts have no words and no runs. Every row is judged by itself: repeated rows give
equal rows, null keys too; an empty table gives an empty one. Other columns, whatever their names, aren't
read. Texts are read whole.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, hashed_words, long, map_text, mix64, string

MIN_LENGTH, REPEATS = 6, 4
BATCH = 2048
_LEFT = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Catchers:
    """The state of one line of words, given as 64-bit fingerprints in pieces of any size."""

    def __init__(self, min_length: int = MIN_LENGTH, repeats: int = REPEATS, levels: int = 64) -> None:
        if repeats < 4:
            raise ValueError("two catchers in a row are sure to lie in a run of four periods or more")
        self.min_length, self.repeats, self.levels = min_length, repeats, levels
        self.size, self.room = 0, 0
        self.suffix: list[np.ndarray] = []  # by level: fingerprint of the suffix that ends at each word
        self.caught: list[np.ndarray] = []  # by level: whether its catcher caught it
        self.squares: list[list[np.ndarray]] = []  # by level: words at which squares were reported

    def _grow(self, size: int) -> None:
        if size > self.room:
            self.room = max(size, 2 * self.room)
            for store in (self.suffix, self.caught):
                store[:] = [np.concatenate((x[: self.size], np.zeros(self.room - self.size, x.dtype))) for x in store]
        while len(self.suffix) < self.levels and (not self.suffix or self.repeats << len(self.suffix) <= size):
            self.suffix.append(np.zeros(self.room, np.uint64))
            self.caught.append(np.zeros(self.room, bool))
            self.squares.append([])

    def append(self, words: np.ndarray) -> None:
        """Advances the comparisons of all levels by these words."""
        old, new = self.size, self.size + len(words)
        known = len(self.suffix)
        self._grow(new)
        self.suffix[0][old:new] = words
        self.size = new
        for k, (own, hit) in enumerate(zip(self.suffix, self.caught, strict=True)):
            step, lo = 1 << k, old if k < known else 0  # a new level catches up on the words before
            if k:
                half, below, at = step >> 1, self.suffix[k - 1], max(lo, step - 1)
                if at < new:
                    own[at:new] = mix64(below[at - half : new - half] * _LEFT + below[at:new])
            at = max(lo, 2 * step - 1)
            if at >= new:
                continue
            first, last = (at + 1 >> k) - 2, (new >> k) - 2  # blocks whose catchers are due
            due = np.repeat(own[(first + 1) * step - 1 : (last + 1) * step : step], step)
            skip = at + 1 - (first + 2) * step
            hit[at:new] = own[at:new] == due[skip : skip + new - at]
            at = max(at, 3 * step - 1)
            seen = np.flatnonzero(hit[at:new] & hit[at - step : new - step]) + at
            if len(seen):
                self.squares[k].append(seen)

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of the runs among the words so far, by start and period."""
        found = [self._merged(k, np.concatenate(e)) for k, e in enumerate(self.squares) if e]
        every = np.concatenate(found or [np.zeros((0, 3), np.int64)])
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        again = np.zeros(len(every), bool)
        again[1:] = (every[1:, :2] == every[:-1, :2]).all(1)
        every = every[~again]
        return every[np.lexsort((every[:, 2], every[:, 0]))]

    def _merged(self, k: int, at: np.ndarray) -> np.ndarray:
        """The stretches that the squares of a level, reported at words ``at``, merge into."""
        step, n = 1 << k, self.size
        hit = self.caught[k]
        before = (at >= 4 * step - 1) & hit[at - 2 * step]  # with the catch a block back: a square there
        after = np.minimum(at + step, n - 1)
        behind = (at + step < n) & hit[after]
        period = (at + 1) % step + step
        order = np.lexsort((at, period))
        at, period, before, behind = at[order], period[order], before[order], behind[order]
        left, right, q = at[~before] - 2 * step + 1, at[~behind], period[~before]  # words equal to those q earlier
        need = np.maximum(self.min_length, self.repeats * q) - q
        may = right - left + 1 + 2 * (step - 1) >= need
        left, right, q, need = left[may], right[may], q[may], need[may]
        for b in range(k - 1, -1, -1):
            own, part = self.suffix[b], 1 << b
            ok = left - q - part >= 0
            x = np.where(ok, left - 1, q)
            left = left - part * (ok & (own[x] == own[x - q]))
            ok = right + part < n
            x = np.where(ok, right + part, q)
            right = right + part * (ok & (own[x] == own[x - q]))
        whole = right - left + 1 >= need
        return np.stack((left - q, right - left + 1 + q, q), 1)[whole]


def confirmed(runs: np.ndarray, ids: np.ndarray) -> bool:
    """Whether the words themselves have these runs, from end to end and no further."""
    n = len(ids)
    for s, length, q in runs.tolist():
        e = s + length
        if not np.array_equal(ids[s : e - q], ids[s + q : e]) or (s and ids[s - 1] == ids[s - 1 + q]) or (e < n and ids[e] == ids[e - q]):
            return False
    return True


def runs_of_words(words: list, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period) of the runs of one text's words."""
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    for salt in count():
        c = Catchers(min_length, repeats)
        with np.errstate(over="ignore"):
            c.append(mix64(ids.astype(np.uint64) + np.uint64(salt) * _SALT + np.uint64(1)))
            got = c.runs()
        if confirmed(got, ids):
            return got


def runs_of_texts(raw: list[bytes], min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[np.ndarray]:
    """The runs of each text. Texts of about one length stand in one line of words, with a fingerprint
    of its own between two of them."""
    out = [np.zeros((0, 3), np.int64)] * len(raw)
    with np.errstate(over="ignore"):
        h, start, _ = hashed_words(b"\n".join(raw))
        edge = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
        size = np.diff(edge)
        kind = np.where(size >= max(min_length, repeats), np.frexp(size / repeats)[1], 0)
        for k in np.unique(kind[kind > 0]).tolist():
            own = np.flatnonzero(kind == k)
            apart = mix64(~own.astype(np.uint64))
            c = Catchers(min_length, repeats, k)
            c.append(np.concatenate([x for i, a in zip(own, apart, strict=True) for x in (h[edge[i] : edge[i + 1]], [a])]))
            got = c.runs()
            if not len(got):
                continue
            first = np.concatenate(([0], np.cumsum(size[own] + 1)))
            which = np.searchsorted(first, got[:, 0], "right") - 1
            for j in np.unique(which).tolist():
                mine = got[which == j] - [first[j], 0, 0]
                words = raw[own[j]].split()
                index: dict = {}
                ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                out[own[j]] = mine if confirmed(mine, ids) else runs_of_words(words, min_length, repeats)
    return out


def find_runs(docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """key with n_words, runs (start, length and period of each, by start and period) and collapsed: the
    words that no run holds behind its first period, joined by one space."""

    def per_batch(texts: list) -> dict:
        made: dict = {"n_words": [], "runs": [], "collapsed": []}
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for lo, hi in blocks_of(raw, 1 << 21):
            for data, runs in zip(raw[lo:hi], runs_of_texts(raw[lo:hi], min_length, repeats), strict=True):
                words = data.split()
                made["n_words"].append(len(words))
                made["runs"].append(runs.tolist())
                if len(runs):
                    keep = np.ones(len(words), bool)
                    for s, length, q in runs.tolist():
                        keep[s + q : s + length] = False
                    words = list(compress(words, keep.tolist()))
                made["collapsed"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return made

    fields = [long("n_words"), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), string("collapsed")]
    return map_text(docs, text_col, [key], fields, per_batch, BATCH)


# --- the given documents, every tenth of which is made periodic first -----------------------------
def tail_repeated(key: Column, text: Column) -> Column:
    """With h the CRC-32 of the decimal key: where h is a multiple of ten, the words from one on repeat
    in a period, both taken from h."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(key.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    rest = (n - a).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), rest))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods, and digests of all runs and of what is left."""
    got = find_runs(docs.select("doc_id", tail_repeated(F.col("doc_id"), F.col("text")).alias("text")))
    # the greatest length / period first, compared as whole numbers; then by start and period
    more = lambda x, y: y[1] * x[2] - x[1] * y[2]
    first = lambda x, y: F.when(more(x, y) != 0, F.signum(more(x, y))).when(x[0] != y[0], F.signum(x[0] - y[0])).otherwise(F.signum(x[2] - y[2])).cast("int")
    got = got.withColumn("best", F.get(F.array_sort("runs", first), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(r.cast("array<string>"), ","), F.lit("\n"))), "")
    b = F.col("best")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b[0].alias("start"), b[1].alias("length"), b[2].alias("period"), F.expr("best[1] * 1000 div best[2]").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: DuckDB: CRC-32 by its table, equal words at each distance as islands, and the smallest period of each.
SQL = r"""
WITH RECURSIVE byte(b, k, v) AS (SELECT range, 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM byte WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM byte WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT)) AS bytes FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda s, c: xor(s >> 8, tab[CAST(xor(s, c) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)), 1) AS h FROM d, crc),
a AS (SELECT *, CAST(h // 10 AS BIGINT) % greatest(n, 1) AS a, CAST(h // 10 AS BIGINT) % 8 AS e FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM a),
x AS (SELECT rid, unnest(range(0, n)) AS i, unnest(w) AS o FROM p),
t AS MATERIALIZED (SELECT p.rid, j.i, x.o AS w, p.n FROM p JOIN x AS j ON j.rid = p.rid
  JOIN x ON x.rid = p.rid AND x.i = CASE WHEN h % 10 = 0 AND j.i >= a THEN a + (j.i - a) % p ELSE j.i END),
m AS (SELECT u.rid, u.i, v.i - u.i AS q FROM t u JOIN t v ON u.rid = v.rid AND u.w = v.w AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
g AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY rid),
b AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE o.rid = r.rid AND (o.length * r.period > r.length * o.period
  OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period)))))),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""
