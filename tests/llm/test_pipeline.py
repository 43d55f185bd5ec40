"""The pipeline's stages on the tiny tables and on awkward rows, each against a plain version."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from archivum.llm import langid, packing, pii, quality
from archivum.llm.common import written

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain_survivors(docs, words=5, percent=80):
    """The smallest id of each group of linked texts, by comparing all pairs: once for each text it has."""
    sets = []
    for key, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets.append((key, {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, bool(w)))}))
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (k, a) in enumerate(sets):
        for j, (m, b) in enumerate(sets[:i]):
            if k == m or (a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least: dict = {}
    for i, (k, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted((k for k in least.values() for _ in {t for m, t in docs if m == k}), key=str)


def plain_kept(docs):
    """The keys that the rules' SQL keeps, as often as they come."""
    with duckdb.connect() as con:
        con.register("documents", docs.select("doc_id", "text").toArrow())
        return Counter(k for (k,) in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall())


def lost_words(docs):
    """The words in failing lines by the rules' SQL, of each key's texts."""
    with duckdb.connect() as con:
        con.register("documents", docs.select("doc_id", "text").toArrow())
        out: dict = {}
        for k, n in con.execute(f"SELECT doc_id, n_lost_words FROM ({quality.SQL})").fetchall():
            out.setdefault(k, set()).add(n)
        return out


def texts_of(docs):
    out: dict = {}
    for r in docs.collect():
        out.setdefault(r.doc_id, []).append((r.text, sum(1 for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w)))
    return out


def in_order(some, lines):
    it = iter(lines)
    return all(x in it for x in some)


def run_all(spark, docs):
    """name -> (input, output) of every stage."""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA))
        seen[name], docs = (docs, out), out
    return seen


def keys(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def check(seen):
    for name, (before, after) in seen.items():
        if name != "packing":
            assert after.columns == before.columns, name
        if name not in ("packing", "personal", "quality"):  # rows go or stay as they are, and never come twice
            assert not Counter(map(tuple, after.collect())) - Counter(map(tuple, before.collect())), name
    before, after = seen["language"]
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in after.collect())
    before, after = seen["quality"]
    assert Counter(keys(after)) == plain_kept(before)
    lost, old, new = lost_words(before), texts_of(before), texts_of(after)
    for key in new:  # what is left are lines of the text, in order, and what is gone are the words that the SQL counts
        assert len(old[key]) >= len(new[key])
        for text, words in new[key]:
            assert any(n - words in lost[key] and in_order(text.split("\n"), whole.split("\n")) for whole, n in old[key])
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["duplicates"]
    named = [(r.doc_id, r.text) for r in before.where("doc_id IS NOT NULL").collect()]
    assert keys(after.where("doc_id IS NOT NULL")) == plain_survivors(named)
    assert after.where("doc_id IS NULL").count() == before.where("doc_id IS NULL").count()
    if "personal" in seen:
        before, after = seen["personal"]
        hidden = {r.doc_id: r for r in after.collect()}
        assert keys(after) == keys(before)
        for r in before.collect():
            assert all(r.text[s:e] not in hidden[r.doc_id].text for s, _, e in pii.base_spans(r.text) if e - s > 11)
            assert hidden[r.doc_id].n_chars == len(hidden[r.doc_id].text)
    before, after = seen["packing"]
    enc = packing.encoder(packing.vocabulary_path())
    whole, got = Counter(), Counter()
    for r in before.collect():
        whole[r.doc_id] += len(enc.encode([r.text])[0][0]) // 2 + 1
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == whole


def test_stages(spark):
    check(run_all(spark, spark.read.parquet(f"{DATA}/documents.parquet")))


def lines(seed, n):
    """Sentences of words that hardly repeat."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeioumnrstl"), rng.integers(3, 9)))
    return "\n".join(" ".join(word() for _ in range(10)) + "." for _ in range(n))


CLASHES = ("kept", "score", "lang_pred", "base_failed", "digest", "component_id", "masked_text", "hkey", "start", "v", "c", "n", "k", "t")


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, a key with two texts."""
    long_one, menu = lines(1, 3000), "\n".join(["Home", "About us", "Contact", "Log in"] * 20)
    near = lines(2, 20)
    rows = [(1, long_one, "en"), (2, None, "en"), (3, "", "en"), (4, " \n\t ", None), (5, near, "en"), (5, near, "en"), (6, near, None), (7, near + "\nSeveral words more stand here.", "en"), (8, menu, "en"),
            (9, lines(3, 20), "en"), (9, lines(4, 20), "en"), (10, lines(5, 20) + "\nWrite to who.ever@mail.example.org or call +1 (017) 555-7713 today.", "en"), (11, "1234 5678", "en"), (None, lines(6, 20), "en"), (None, lines(6, 20), None),
            (12, lines(8, 10) + "\nHome\nAbout us\nContact\nAll rights reserved.\n" + lines(9, 10), "en")]
    df = spark.createDataFrame([(k, t, lang, None if t is None else len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def test_awkward_rows(spark):
    seen = run_all(spark, awkward(spark))
    check({k: v for k, v in seen.items() if k != "personal"})
    assert {2, 3, 4, 11}.isdisjoint(keys(seen["language"][1])) and 8 not in keys(seen["quality"][1])
    assert [r.text for r in seen["quality"][1].where("doc_id = 12").collect()] == [lines(8, 10) + "\n" + lines(9, 10)]
    left = keys(seen["duplicates"][1])
    assert left.count(5) == 1 and {6, 7}.isdisjoint(left) and left.count(None) == 2
    texts = {r.doc_id: r for r in seen["personal"][1].collect()}
    assert "who.ever@mail.example.org" not in texts[10].text and "555-7713" not in texts[10].text and texts[10].n_chars == len(texts[10].text)
    assert all(r[c] == "mine" for r in texts.values() for c in CLASHES)


def test_empty_table(spark):
    for before, after in run_all(spark, awkward(spark).limit(0)).values():
        assert before.count() == 0 and after.count() == 0


@pytest.mark.parametrize("name", ["language", "quality", "personal"])
def test_stages_read_whole_texts(spark, name):
    """What stands at the end of a long text counts: the mail address goes, the rest stays."""
    text = lines(7, 4000) + "\nWrite to last.one@mail.example.org today."
    docs = spark.createDataFrame([(4 * i, t, "en", len(t)) for i, t in enumerate((text, lines(8, 30)))], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r.text for r in STAGES[name](spark, docs, DATA).collect()}
    if name == "language":  # only documents that aren't held out are learned from
        assert set(got) <= {0, 4} and langid.learn(docs) is not None
    else:
        assert set(got) == {0, 4} and got[0].endswith("today.") and ("last.one@" in got[0]) == (name != "personal")
