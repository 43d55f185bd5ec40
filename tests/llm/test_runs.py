"""Periodic runs against a plain search, word by word and all at once, and on awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivum.llm import queries, runs
from archivum.llm.common import mix64

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=6, repeats=4):
    """Every maximal stretch of every period; a stretch's smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, repeats * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    n, letters = int(rng.integers(0, 130)), int(rng.integers(1, 4))
    w = rng.integers(0, letters, n).tolist()
    for _ in range(int(rng.integers(0, 3)) if n > 8 else 0):
        s = int(rng.integers(0, n))
        p, e = int(rng.integers(1, max(2, (n - s) // 4 + 1))), int(rng.integers(s, n + 1))
        for i in range(s + p, e):
            w[i] = w[i - p]
    return w


def test_runs_against_plain_search():
    rng = np.random.default_rng(3)
    for it in range(400):
        w = periodic(rng)
        want = plain_runs(w)
        assert list(map(tuple, runs.runs_of_words(w).tolist())) == want
        h = mix64(np.array(w, np.uint64) + np.uint64(1))
        c, at = runs.Catchers(), 0
        with np.errstate(over="ignore"):
            while at < len(h):  # words one by one, or in pieces
                k = 1 if it % 2 else int(rng.integers(1, 9))
                c.append(h[at : at + k])
                at += k
                if it % 50 == 1:
                    assert list(map(tuple, c.runs().tolist())) == plain_runs(w[:at])
            assert list(map(tuple, c.runs().tolist())) == want
    many = [periodic(rng) for _ in range(200)]
    got = runs.runs_of_texts([" ".join(map(str, w)).encode() for w in many])
    assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(w) for w in many]


def test_other_lengths_and_repeats():
    w = "a b a b a b a b a b x x x x x x x x x y".split()
    assert runs.runs_of_words(w, 12, 4).tolist() == []
    assert runs.runs_of_words(w, 6, 5).tolist() == [[0, 10, 2], [10, 9, 1]]
    with pytest.raises(ValueError, match="four"):
        runs.Catchers(repeats=3)


def test_shared_fingerprints_are_found_out(monkeypatch):
    """A text whose fingerprints say more than its words do is done again."""
    true = runs.hashed_words
    monkeypatch.setattr(runs, "hashed_words", lambda data: (np.ones(len(true(data)[0]), np.uint64), *true(data)[1:]))
    w = ("p q r s t u v w " * 3 + "a b " * 6).split()
    assert list(map(tuple, runs.runs_of_texts([" ".join(w).encode()])[0].tolist())) == plain_runs(w)


def test_long_texts_take_time_that_grows_with_their_length():
    import time

    rng = np.random.default_rng(5)
    fib = ["a", "a b"]
    while len(fib[-1]) < 600_000:
        fib.append(fib[-1] + " " + fib[-2])
    for text in ("a " * 300_000, fib[-1], " ".join(map(str, rng.integers(0, 2, 300_000))), "a b c d e f g " * 50_000):
        at = time.process_time()
        runs.runs_of_texts([text.encode()])
        assert time.process_time() - at < 10


def made_periodic(key, text):
    w = (text or "").split()
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def report(key, text):
    w = made_periodic(key, text)
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 40), (5, "a b " * 9 + "é\x0bz"), (5, "a b " * 9), (5, "a b " * 9), (6, "漢 字 " * 5 + "end"), (None, "q " * 12), (-7, "one two three")]
    rows += [(k, " ".join(f"w{i % 97}" for i in range(20 + k))) for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "best", "start")})
    got = runs.run_report(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((report(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20
    assert runs.run_report(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    import duckdb

    got = queries.op11_periodic_runs(spark, DATA)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
        want = con.sql(runs.SQL)
        assert want.columns == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
