"""Language identification with bit-sliced Bloom filters over character trigrams.

Training takes a bounded sample of labelled rows (``rows``, and at least ``each`` of every language,
or all that it has, so that no labelled language stays unknown), counts in how many of a language's
texts each trigram stands, and puts its ``top`` commonest trigrams into that language's Bloom
filter. The filters are bit-sliced: slot s holds one bit a language, so the AND of a trigram's
slots is the set of all languages that contain it. A text's languages are then counted (the
popcount of each bit over all its trigrams) and corrected for the false positives that the fill
of each filter predicts (a slot has as many 64-bit words as the languages need); the largest corrected count decides, ties go to the language with more
training rows, then to the smaller name. ``score`` is the share of the text's trigrams that the
chosen language explains, from 0 to 1.

Letters are lower-cased; everything else is a word edge; whole texts are read. Null texts and
texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
Rows are judged one by one, so repeated rows repeat their answer; an empty table stays empty.
Only key and text are read for a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_CHARS, blocks_of, double, judged, map_text, mix64, string, trained

ROWS, TOP, SLOT_BITS, HASHES = 800, 1000, 16, 3
EACH = 200
MIN_SCORE = 0.3
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the trigrams with a letter in the middle, where each text's begin (one entry
    more than texts), and each text's number of letters."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    begin = np.cumsum([1, *(len(p) // 4 + 1 for p in parts)])
    code = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(parts) + b"\0\0\0\0", "<u4")
    ok = letter_table()[code]
    h = np.where(ok, code, 0).astype(np.uint64)
    at = np.flatnonzero(ok)
    grams = mix64(h[at - 1] * _K[0] + h[at] * _K[1] + h[at + 1] * _K[2]) if len(at) else np.zeros(0, np.uint64)
    edges = np.searchsorted(at, begin)
    return grams, edges, np.diff(edges)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((grams >> np.uint64(SLOT_BITS * k)) & low).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The bit-sliced filters; languages beyond 64 stand in further words of each slot."""

    def __init__(self, rows: list[tuple[str, str]], top: int = TOP) -> None:
        share = Counter(lang for lang, _ in rows)
        self.langs = sorted(share, key=lambda x: (-share[x], x))
        kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(self.langs) <= n), np.uint64)
        self.slots = np.zeros((max(1, -(-len(self.langs) // 64)), 1 << SLOT_BITS), kind)
        with np.errstate(over="ignore"):
            for i, lang in enumerate(self.langs):
                word, bit = divmod(i, 64)
                texts = [t for x, t in rows if x == lang]
                grams, edges, _ = trigrams(texts)
                own = [np.unique(grams[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                value, count = np.unique(np.concatenate(own), return_counts=True)
                best = value[np.lexsort((value, -count))[:top]]
                for s in _slots(best):
                    np.bitwise_or.at(self.slots[word], s, kind(1 << bit))
        fill = [np.count_nonzero(self.slots[i // 64] & kind(1 << i % 64)) / (1 << SLOT_BITS) for i in range(len(self.langs))]
        self.false_rate = np.array([f**HASHES for f in fill])

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        with np.errstate(over="ignore"):
            for lo, hi in blocks_of(["" if t is None else t for t in texts]):
                grams, edges, letters = trigrams(texts[lo:hi])
                a, b, c = _slots(grams)
                n = np.maximum(letters, 1)[:, None]
                pops = np.zeros((hi - lo, max(1, len(self.langs))))
                for i in range(len(self.langs)):
                    word, bit = divmod(i, 64)
                    if bit == 0:
                        mask = self.slots[word][a] & self.slots[word][b] & self.slots[word][c]
                    total = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), dtype=np.int64)))
                    pops[:, i] = total[edges[1:]] - total[edges[:-1]]
                if self.langs:
                    pops = (pops - n * self.false_rate) / (1 - self.false_rate)
                best = pops.argmax(1)
                for i, k in enumerate(best):
                    known = bool(self.langs) and letters[i] > 0
                    names.append(self.langs[k] if known else "und")
                    scores.append(float(min(1.0, max(0.0, pops[i, k] / n[i, 0]))) if known else 0.0)
        return names, scores


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, each: int = EACH) -> Filters:
    """Filters from labelled rows that aren't held out: at most ``rows``, and besides what brings
    every language to ``each``; of a text its first ``SAMPLE_CHARS`` characters."""
    src = docs.select(F.col(f"`{key}`").alias("k"), F.substring(F.col(f"`{text_col}`").cast("string"), 1, SAMPLE_CHARS).alias("t"), F.col(f"`{lang_col}`").alias("l"))
    src = src.where(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("k")))
    return trained(src, "k", rows, ["k", "t", "l"], lambda got: Filters([(r["l"], r["t"]) for r in got]), group="l", each=each)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def per_batch(texts: list) -> dict:
        names, scores = shared.value.predict(texts)
        return {"lang_pred": names, "score": scores}

    return map_text(docs, text_col, keep, [string("lang_pred"), double("score")], per_batch)


def keep_known(docs: DataFrame, filters: Filters, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a language that the filters know, with their columns unchanged:
    ``und`` goes, and what explains less than ``min_score`` of its trigrams."""
    got, back = judged(docs, lambda src, text, keep: identify(src, filters, text, keep))
    return back(got.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)))
