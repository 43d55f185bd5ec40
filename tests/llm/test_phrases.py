"""Collocations against plain counts, with a frontier of several rounds, and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from archivum.llm import phrases, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, least=10, top=2000, cover=50):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for size in (1, 2, 3):
                count[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in count.items():
        found = [p for p, a in f.items() if a >= least and len(p) > 1]
        longer = defaultdict(int)
        for p in found:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], f[p])
        rank = []
        for p in found:
            if len(p) == 2 and 100 * longer[p] >= cover * f[p]:
                continue
            a = f[p]
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def found(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def corpus(seed, n):
    """Words of very different frequency with set phrases among them, in three languages and none."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ids = np.minimum(rng.zipf(1.4, int(rng.integers(0, 60))), 60)
        w = [f"w{k}" for k in ids]
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(0, 12))
            w[int(rng.integers(0, len(w) + 1)) : 0] = [f"P{k}", f"q{k % 5}", f"r{k}", "."][: int(rng.integers(2, 5))]
        rows.append(([None, "en", "fr", "und", "x y"][i % 5], "  ".join(w).replace(" . ", rng.choice([".", "\n", " ! ", "\t"]))))
    return rows


@pytest.mark.parametrize(("top", "least", "cover"), [(2000, 10, 50), (3, 4, 50), (12, 2, 80), (1, 10, 100)])
def test_collocations(spark, top, least, cover):
    rows = corpus(top, 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(df, top=top, least=least, cover=cover) == plain(rows, least, top, cover)


def test_frontier_takes_several_rounds(spark, monkeypatch):
    """The best pairs stand inside longer phrases that score less, so the first frontier leaves too few."""
    rows = [("en", ". ".join(f"the a{k} b{k}" for k in range(40)))] * 12 + [("en", ". ".join(f"d{k % 4} e{k}" for k in range(30)))] * 12 + corpus(9, 50)
    tried = []
    true = phrases.grown_triples
    monkeypatch.setattr(phrases, "grown_triples", lambda src, *a: tried.append(src.count()) or true(src, *a))
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, top=35) == plain(rows, top=35)
    assert len(tried) > 1 and tried[-1] < tried[0]  # settled languages are not read again


def test_windows_and_chunks(spark, monkeypatch):
    """Phrases go on over the ends of windows and chunks, and count once."""
    rows = corpus(4, 60) + [("en", "one two three two one " * 400), ("en", "x" * 5000 + " y")]
    src = spark.createDataFrame(rows, "lang string, text string").coalesce(1).select("lang", "text")
    size = {1: phrases.one_word, 2: phrases.two_words, 3: phrases.three_words}
    every = np.full(1 << phrases.PLACES, 7, np.uint8)
    src = src.where("lang IS NOT NULL")
    whole = {k: set(map(tuple, phrases.counted(src, k, f, every).collect())) for k, f in size.items()}
    monkeypatch.setattr(phrases, "CHUNK", 7)
    monkeypatch.setattr(phrases, "WINDOW", 5)
    cloudpickle.register_pickle_by_value(phrases)  # the tasks get these numbers
    try:
        assert {k: set(map(tuple, phrases.counted(src, k, f, every).collect())) for k, f in size.items()} == whole
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def test_scores_past_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_001, 5_000_000_009
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = df.select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 1_000_000 * a * a // (left * right)


def test_awkward_rows(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \n.,"), (None, "a b " * 30), ("en", "A\tB " * 30), ("en", "A\tB " * 30), ("fr", "漢 字;漢 字! " * 12), ("", "a b. " * 11), ("de", "only one")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("a", "l", "n", "w1", "score", "phrase", "t", "rank")})
    assert found(df) == plain(rows)
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df.where("text IS NULL")).count() == 0


def test_query_against_sql(spark):
    import duckdb

    got = queries.op12_collocations(spark, DATA)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
        want = con.sql(phrases.SQL)
        assert want.columns == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
