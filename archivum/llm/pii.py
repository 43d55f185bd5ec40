"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

Base kinds, leftmost and non-overlapping per kind (a failing match is dropped, not retried):
  email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (``+`` and 9 to 15 digits)

The network labels characters (outside, or begin / inside of a kind). It is trained in numpy on
windows of a bounded sample of texts: their base spans are the labels, and written-out variants
(national phone numbers, cards in groups, spelt-out addresses with digits) and look-alikes without
personal data (years, versions, hashes, prices) are set into them. A span of any kind holds a
digit or ``@``; so only overlapping windows that reach ``REACH`` characters around one are run. Windows are decoded one by one (Viterbi);
spans of one kind that touch are joined across windows, and over the whole text the set of
spans that don't overlap with the largest total score is taken. Those that touch no base span,
reach ``MIN_SCORE`` and hold ``@`` or seven digits are added to the base spans.

Positions are code points, the end exclusive. Null and empty texts have no spans. Texts are read
whole and row by row: repeated rows repeat their spans, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_CHARS, free_of, judged, long, map_text, string, trained
from .neural import Adam, BiLstm

KINDS = ("email", "ip", "card", "phone")
#: The email pattern in two halves around its ``@``, so that a long run without one is read once.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match always begins where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]")

ROWS, WINDOWS, ROUNDS, HIDDEN, CHAR_DIM, CHARS = 400, 2400, 12, 24, 12, 160
WINDOW, STRIDE, REACH = 96, 48, 40
MIN_SCORE = 2.0
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each ``@`` with all that may stand before it, back to the last
    match, if a domain follows."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), by start and kind."""
    if not ANCHOR.search(text):
        return []
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def char_classes(text: str) -> np.ndarray:
    """ASCII characters as they are; other letters, spaces and the rest as three classes more."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    far = np.flatnonzero(code >= 128)
    if len(far):
        code[far] = [128 if text[i].isalpha() else 129 if text[i].isspace() else 130 for i in far]
    return code


# --- training data ----------------------------------------------------------------------------
def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def invented(rng: np.random.Generator) -> tuple[str, int | None]:
    """Text to set into a window, and the number of its kind (None for a look-alike)."""
    d = lambda n: _digits(rng, n)
    word = "".join(rng.choice(list("aeiounrstlmdk"), int(rng.integers(3, 9))))
    pick = int(rng.integers(0, 20))
    if pick < 3:
        return f"{word}{rng.choice(['.', '_', '', '-'])}{d(int(rng.integers(0, 4)))}@{word[::-1]}{rng.choice(['', d(1)])}.{rng.choice(['example.com', 'com', 'org', 'co.uk'])}", 0
    if pick < 6:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), 1
    if pick < 9:
        body = d(15)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        gap = str(rng.choice(["", "", " ", "-"]))
        return gap.join(full[i : i + 4] for i in range(0, 16, 4)), 2
    if pick < 11:
        return f"+{int(rng.integers(1, 99))} ({d(3)}) {d(3)}-{d(4)}", 3
    if pick < 13:
        return str(rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{int(rng.integers(1, 99))}.{d(3)}.{d(7)}", f"+{int(rng.integers(1, 99))} {d(2)} {d(4)} {d(4)}"])), 3
    look = (str(int(rng.integers(1000, 2100))), f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", "".join(rng.choice(list("0123456789abcdef"), 40)), f"{d(2)}:{d(2)}", f"{int(rng.integers(1, 999))},{d(3)}.{d(2)}", d(int(rng.integers(1, 9))), f"{word}@", f"@{word}", f"v{d(1)}.{d(1)}", d(24))
    return str(look[int(rng.integers(len(look)))]), None


def training_windows(texts: list[str], rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` windows of character classes and tags; -1 pads."""
    x = np.full((count, WINDOW), -1, np.int64)
    y = np.zeros((count, WINDOW), np.int64)
    texts = [t for t in texts if t] or ["text"]
    held = [t for t in texts if base_spans(t)] or texts
    for i in range(count):
        text = (held if i % 3 == 0 else texts)[int(rng.integers(len(held if i % 3 == 0 else texts)))]
        spans: list[tuple[int, int, int]] = base_spans(text)
        if i % 3 == 0 and spans:
            at = max(0, spans[int(rng.integers(len(spans)))][0] - int(rng.integers(0, WINDOW // 2)))
        else:
            at = int(rng.integers(max(1, len(text) - WINDOW // 2)))
            at = text.find(" ", at) + 1
            new, kind = invented(rng)
            spans = [(s, k, e) for s, k, e in spans if e <= at]
            text = text[:at] + new + text[at : at + 2 * WINDOW]
            spans += [(at, kind, at + len(new))] if kind is not None else []
            at = max(0, at - int(rng.integers(0, WINDOW - 45)))
        part = text[at : at + WINDOW]
        x[i, : len(part)] = char_classes(part)
        for s, k, e in spans:
            if s >= at and s < at + WINDOW:
                y[i, s - at] = 1 + 2 * k
                y[i, s - at + 1 : min(e, at + WINDOW) - at] = 2 + 2 * k
    return x, y


# --- network ------------------------------------------------------------------------------------
class Tagger:
    """Embeds characters, reads windows both ways, scores tags; transitions are a CRF's."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.net = BiLstm(CHAR_DIM, HIDDEN, rng)
        self.p = {"char": rng.normal(0, 0.3, (CHARS, CHAR_DIM)).astype(np.float32), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)).astype(np.float32), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        self.never = np.zeros((TAGS, TAGS), np.float32)  # an inside tag only follows its own kind
        for k in range(len(KINDS)):
            own = 2 + 2 * k
            self.never[[t for t in range(TAGS) if t not in (own - 1, own)], own] = -1e4

    def _emit(self, x: np.ndarray, keep: bool = False) -> tuple:
        """x: windows x time. Emissions are time x windows x tags."""
        mask = (x.T >= 0).astype(np.float32)
        e = self.p["char"][np.maximum(x.T, 0)]
        h, kept = self.net.forward(e, mask, keep)
        return h @ self.p["out"] + self.p["bias"], mask, h, kept

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        adam = Adam(self.p | self.net.params(), 0.01)
        for r in range(rounds):
            adam.rate = 0.012 * (1 - r / rounds) + 0.001
            order = rng.permutation(len(x))
            for lo in range(0, len(order), 80):
                self._step(adam, x[order[lo : lo + 80]], y[order[lo : lo + 80]])

    def _step(self, adam: Adam, x: np.ndarray, y: np.ndarray) -> None:
        emit, mask, h, kept = self._emit(x, True)
        d_emit, d_move = self._crf(emit, mask, y.T)
        n = x.shape[0]
        d_emit, d_move = d_emit / n, d_move / n
        dx, grads = self.net.backward(d_emit @ self.p["out"].T, kept)
        grads |= {"out": h.reshape(-1, h.shape[2]).T @ d_emit.reshape(-1, TAGS), "bias": d_emit.sum((0, 1)), "move": d_move, "char": np.zeros_like(self.p["char"])}
        np.add.at(grads["char"], np.maximum(x.T, 0), dx * mask[:, :, None])
        adam.step(grads)

    def _crf(self, emit: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the negative log-likelihood: expected less observed counts."""
        n, b, _ = emit.shape
        move = self.p["move"] + self.never
        lse = lambda v, ax: (m := v.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(ax))
        a, z = np.empty_like(emit), np.empty_like(emit)
        a[0] = emit[0]  # a window may begin inside a span
        for t in range(1, n):
            new = emit[t] + lse(a[t - 1][:, :, None] + move[None], 1)
            a[t] = np.where(mask[t][:, None] > 0, new, a[t - 1])
        z[-1] = 0
        for t in range(n - 2, -1, -1):
            new = lse(move[None] + (emit[t + 1] + z[t + 1])[:, None, :], 2)
            z[t] = np.where(mask[t + 1][:, None] > 0, new, z[t + 1])
        total = lse(a[-1], 1)
        p = np.exp(a + z - total[None, :, None]) * mask[:, :, None]
        d_emit = p.copy()
        t_at, b_at = np.nonzero(mask)
        d_emit[t_at, b_at, y[t_at, b_at]] -= 1
        d_move = np.zeros((TAGS, TAGS))
        for t in range(1, n):
            pair = np.exp(a[t - 1][:, :, None] + move[None] + (emit[t] + z[t] - total[:, None])[:, None, :]) * mask[t][:, None, None]
            d_move += pair.sum(0)
            own = mask[t] > 0
            np.add.at(d_move, (y[t - 1][own], y[t][own]), -1)
        return d_emit.astype(np.float32), d_move.astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (windows x time) and each position's emission over that of outside."""
        emit, mask, _, _ = self._emit(x)
        n, b, _ = emit.shape
        move = self.p["move"] + self.never
        v = emit[0].copy()
        back = np.zeros((n, b, TAGS), np.int8)
        for t in range(1, n):
            s = v[:, :, None] + move[None]
            best = s.argmax(1)
            new = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + emit[t]
            live = mask[t][:, None] > 0
            back[t] = np.where(live, best, np.arange(TAGS))
            v = np.where(live, new, v)
        tags = np.zeros((n, b), np.int64)
        tags[-1] = v.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(b), tags[t]]
        gain = np.take_along_axis(emit, tags[:, :, None], 2)[:, :, 0] - emit[:, :, 0]
        return np.where(mask > 0, tags, 0).T, (gain * mask).T


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every place near a digit or ``@``."""
    starts: list[int] = []
    lo = hi = -1
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), m.start() + REACH + 1
        if lo >= 0 and a <= hi:
            hi = b
            continue
        if lo >= 0:
            starts += range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)
        lo, hi = a, b
    if lo >= 0:
        starts += range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)
    return starts


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Windows' spans (start, kind, end, score) to the set without overlaps of most total score:
    spans of one kind that overlap are joined, then intervals are scheduled by weight."""
    joined: list[list] = []
    for k in {f[1] for f in found}:
        own: list[list] = []
        for s, _, e, w in sorted(f for f in found if f[1] == k):
            if own and s < own[-1][2]:
                own[-1][2], own[-1][3] = max(own[-1][2], e), max(own[-1][3], w)
            else:
                own.append([s, k, e, w])
        joined += own
    joined.sort(key=lambda f: (f[2], f[0], f[1]))
    ends = [f[2] for f in joined]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # total, last span, prefix before it
    for i, (s, _, _, w) in enumerate(joined):
        before = int(np.searchsorted(ends, s, "right"))
        best.append(max((best[i][0], -1, i), (best[before][0] + w, i, before), key=lambda x: x[0]))
    out, i = [], len(joined)
    while i:
        _, span, i = best[i]
        if span >= 0:
            out.append(tuple(joined[span]))
    return out[::-1]


def network_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The spans that the network finds in each text."""
    work = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    raw: list[list] = [[] for _ in texts]
    for lo in range(0, len(work), 512):
        own = work[lo : lo + 512]
        x = np.full((len(own), WINDOW), -1, np.int64)
        for r, (i, s) in enumerate(own):
            part = texts[i][s : s + WINDOW]
            x[r, : len(part)] = char_classes(part)
        tags, gain = model.decode(x)
        rows, cols = np.nonzero((tags % 2 == 1) | ((tags > 0) & (np.arange(WINDOW) == 0)))
        for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
            k = (int(tags[r, c]) - 1) // 2
            e = c + 1
            while e < WINDOW and tags[r, e] == 2 + 2 * k:
                e += 1
            i, s = own[r]
            raw[i].append((s + c, k, s + e, float(gain[r, c:e].sum())))
    out: list[list[tuple[int, int, int]]] = []
    for t, found in zip(texts, raw, strict=True):
        good = []
        for s, k, e, w in reconciled(found) if found else ():
            part = t[s:e]
            if w >= MIN_SCORE and ("@" in part[1:-1] and k == 0 or k > 0 and len(DIGIT.findall(part)) >= 7):
                good.append((s, k, e))
        out.append(good)
    return out


def fitted(rows: list[dict]) -> Tagger:
    model = Tagger()
    model.train(*training_windows([r["t"] for r in rows], np.random.default_rng(9), WINDOWS))
    return model


def learn(docs: DataFrame, key: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> Tagger:
    """A tagger trained on windows of at most ``rows`` texts with a digit or ``@``, of each the
    ``SAMPLE_CHARS`` characters from a little before its first one on."""
    src = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t")).where(F.col("t").rlike("[0-9@]"))
    src = src.withColumn("t", F.substring("t", F.greatest(F.lit(1), F.regexp_instr("t", F.lit("[0-9@]")) - SAMPLE_CHARS // 2), F.lit(SAMPLE_CHARS)))
    return trained(src, "k", rows, ["k", "t"], fitted)


def all_spans(texts: list, model: Tagger) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text, by start and kind."""
    texts = [t or "" for t in texts]
    near = [i for i, t in enumerate(texts) if ANCHOR.search(t)]
    base: list[list] = [[] for _ in texts]
    every: list[list] = [[] for _ in texts]
    for i in near:
        base[i] = base_spans(texts[i])
    for i, more in zip(near, network_spans([texts[i] for i in near], model), strict=True):
        every[i] = sorted(base[i] + free_of(more, base[i]))
    return list(zip(base, every, strict=True))


def written_spans(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind's name in angle brackets."""
    parts, at = [], 0
    for s, k, e in spans:
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*parts, text[at:]])


def find_personal(docs: DataFrame, model: Tagger, text_col: str = "text", keep: Sequence[str] = ("doc_id",), mask: bool = False) -> DataFrame:
    """``keep`` with n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256 and spans;
    with ``mask`` also masked_text (null stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(texts: list) -> dict:
        made: dict = {k: [] for k in (*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans", "masked_text")}
        for t, (base, every) in zip(texts, all_spans(texts, shared.value), strict=True):
            counts = Counter(k for _, k, _ in base)
            for i, k in enumerate(KINDS):
                made[f"n_{k}"].append(counts[i])
            made["n_added"].append(len(every) - len(base))
            made["base_sha256"].append(hashlib.sha256(written_spans(base).encode()).hexdigest())
            made["spans"].append(written_spans(every))
            if mask:
                made["masked_text"].append(None if t is None else masked(t, every))
        return made

    names = [*(f"n_{k}" for k in KINDS), "n_added"]
    return map_text(docs, text_col, keep, [*map(long, names), string("base_sha256"), string("spans"), *([string("masked_text")] if mask else [])], per_batch)


def mask_personal(docs: DataFrame, model: Tagger) -> DataFrame:
    """``docs`` with every span in ``text`` masked, and ``n_chars`` (where there is one) after it."""
    got, back = judged(docs, lambda src, text, keep: find_personal(src, model, text, keep, mask=True))
    names = [c.lower() for c in docs.columns]
    text = f"__in_{names.index('text')}"
    got = got.withColumn(text, F.col("masked_text"))
    if "n_chars" in names:
        chars = f"__in_{names.index('n_chars')}"
        got = got.withColumn(chars, F.length(text).cast(docs.schema[names.index("n_chars")].dataType))
    return back(got)
