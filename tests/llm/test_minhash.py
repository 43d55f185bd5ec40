"""Sketches and their concentration, and near-duplicates against the comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import TEXTS, brute_components, prose

from archivum.llm import minhash, queries

DATA = "/root/testdata/sf0.001"


def pair(rng, n, shared):
    u = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
    return np.unique(u[:n]), np.unique(np.concatenate((u[:shared], u[n : 2 * n - shared])))


@pytest.mark.parametrize("n", [1, 2, 9, 60, 700, 6000])
def test_every_coordinate_fills_and_agrees_with_the_similarity(n):
    rng = np.random.default_rng(n)
    with np.errstate(over="ignore"):
        for share in (0.3, 8 / 9):
            shared = round(n * share)
            a, b = zip(*(pair(rng, n, shared) for _ in range(60)), strict=True)
            x, y = minhash.sketched(list(a)), minhash.sketched(list(b))
            assert (x != minhash._EMPTY).all()
            want = shared / (2 * n - shared)
            agree = (x == y).mean(1)
            sd = (want * (1 - want) / minhash.BINS) ** 0.5
            assert abs(agree.mean() - want) < 4 * sd / 60**0.5 + 1e-9 and agree.std() < 1.5 * sd + 1e-9
            apart = np.bitwise_count((minhash.signed(x) ^ minhash.signed(y)).view(np.uint64)).sum(1)
            assert abs(apart.mean() - (1 - want) * minhash.BINS / 2) < 6
            if want >= 0.8:
                assert apart.max() <= minhash.APART and (minhash.banded(x) == minhash.banded(y)).any(1).all()


def plain_sketch(elements, bins):
    """Round after round until every bin is full."""
    out = [None] * bins
    for i in range(2 * bins):
        for e in elements:
            h = int(minhash.thrown(np.array([e], np.uint64), np.array([i]))[0])
            b = (h >> 48) * bins >> 16 if i < bins else i - bins
            value = i << 48 | h & ((1 << 48) - 1)
            out[b] = value if out[b] is None else min(out[b], value)
        if None not in out:
            return out


def test_sketch_against_plain_rounds():
    rng = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3, 10, 40):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            assert minhash.sketched([s, s[:0]], 24).tolist() == [plain_sketch(s, 24), [2**64 - 1] * 24]


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80), (2, 90)])
def test_near_duplicates(spark, words, percent):
    rng = np.random.default_rng(words)
    texts = []
    for k in range(12):
        base = prose(k, 120).split()
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, 7))):
                w[int(rng.integers(0, len(w)))] = f"new{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    texts += ["same words here", "Same words  here", "one", "One", "two", "", " ", *(f"one licence passage of many words for all {i} {prose(90 + i, 4)}" for i in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df, words, percent).collect()}
    want = {k: c for k, _, c in brute_components(list(enumerate(texts)), words, percent)}
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert 15 < len(set(want.values())) < len(texts) - 50


def test_large_group_without_all_pairs(spark, monkeypatch):
    """Near copies of one text become one component from a few pairs each."""
    rng = np.random.default_rng(8)
    base = prose(3, 200).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[int(rng.integers(0, len(w)))] = f"n{i}"
        rows.append((i, " ".join(w)))
    listed = []
    true = minhash.met_pairs

    def counted(*a):
        out = true(*a)
        listed.append(out.count())
        return out

    monkeypatch.setattr(minhash, "met_pairs", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert {r.component_id for r in got.collect()} == {0} and sum(listed) < 4 * len(rows)


def test_awkward_rows(spark):
    df = spark.createDataFrame(TEXTS + [(20, prose(1, 60).upper()), (21, prose(2, 6000) + " more"), (-3, "x y")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("kept", "n", "digest", "component_id", "token", "v", "c", "bits", "bands")})
    got = sorted(map(tuple, minhash.near_duplicates(df, 2, 80).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert all(by[k] == [(0, k, True)] for k in (2, 3, 4))
    assert by[5] == [by[5][0]] * 2 and by[20][0][1:] == (5, False) and by[21][0][1:] == (6, False) and by[-3] == [(1, -3, True)]
    assert by[None][0][1:] == (None, True)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="0.8"):
        minhash.near_duplicates(df, 2, 70)


def test_query_against_sql(spark):
    import duckdb

    got = queries.op13_minhash_dedup(spark, DATA)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
        want = con.sql(minhash.SQL)
        assert want.columns == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
