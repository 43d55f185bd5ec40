"""Quality rules, line first: judge every line, drop the failing ones, then reject documents
that lose too much text.

Line rules (a line is what stands between two ``\\n``; words are ``[^\\x20\\x09-\\x0D]+``):
  symbols      a symbol of ``#*$%&|<>`` for every three words (markup remains, menus of ``a | b``)
  shouting     three words or more, and an exclamation mark for every two words
  repetition   ten words or more, fewer than three in ten of them distinct
  boilerplate  one of ``BOILERPLATE`` in the lower-cased (A-Z) line, at word borders
  navigation   a line that is one of ``NAVIGATION``, has a separator for every three words, or
               stands in a run of ``MENU`` lines or more of at most four words each, none of which
               ends a sentence (lines without a word don't break a run)
  unfinished   five words or more and no closing punctuation (of any script) at the end
  repeated     equal to an earlier line of the document, or a third line that differs from earlier
               ones in its digits only
Boilerplate and unfinished lines have at most ``LONG_LINE`` words: longer ones are paragraphs, which
one phrase or a missing mark doesn't make a loss.

Lines without a word are neither kept text nor a loss. A document is rejected when more than
``max_loss`` percent of its words stood in failing lines, or by the base rules (``min_words``
and ``max_repeat``). Null and empty texts have no words and are rejected by the base rules.
Every row is judged by itself: repeated rows give equal rows, an empty table an empty table;
columns other than the key and the text are only carried when named in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boolean, judged, long, map_text, string

SYMBOLS = "#*$%&|<>"
#: Phrases of notices and site furniture.
BOILERPLATE = (
    "all rights reserved", "licensed under", "under the mit license", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "click here", "read more", "sign in", "log in",
    "subscribe to", "enable javascript", "lorem ipsum", "skip to content",
)
#: Whole lines of menus, separators of trails and menus, and marks that close a line or
#: a sentence (Latin, CJK, Arabic, Devanagari, Armenian, Ethiopic, Khmer, Tibetan).
NAVIGATION = (
    "home", "about", "about us", "contact", "contact us", "menu", "search", "sitemap", "site map", "next", "next page", "previous", "previous page",
    "back to top", "back", "more", "login", "register", "share", "print", "help", "faq", "archive", "categories", "tags", "comments", "related posts",
)
SEPARATORS = ("/", "\\", "-", "–", "—", "·", "•", "›", "»", "→", "::")
SENTENCE = ".!?…。！？｡؟۔।॥։።፧។།"
CLOSING = ".!?:;\"')]}»”’…。！？；：」』）】》〉｡؟۔؛।॥։።፧។།"
MENU, LONG_LINE = 3, 60
MIN_WORDS, MAX_REPEAT, MAX_LOSS = 50, 50, 50
SPACES = " \t\n\x0b\x0c\r"
_phrases = tuple(p.encode() for p in BOILERPLATE)
_symbols = tuple(s.encode() for s in SYMBOLS)
_closing = tuple(s.encode() for s in CLOSING)
_sentence = tuple(s.encode() for s in SENTENCE)
_separators = frozenset(s.encode() for s in SEPARATORS)
_navigation = frozenset(s.encode() for s in NAVIGATION)
_bordered = re.compile(b"(?:^|[^a-z0-9])(?:" + b"|".join(_phrases) + b")(?:[^a-z0-9]|$)")
_digits = re.compile(rb"[0-9]+")


def repeated_window_words(words: list) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    v = len(index)
    pair = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    mark[:-2] |= often
    mark[1:-1] |= often
    mark[2:] |= often
    return int(mark.sum())


def failed_rule(line: bytes, words: list) -> str | None:
    """The first rule that a line with words fails, repetition of whole lines apart."""
    n = len(words)
    if 3 * sum(line.count(s) for s in _symbols) >= n:
        return "symbols"
    if n >= 3 and 2 * line.count(b"!") >= n:
        return "shouting"
    if n >= 10 and 10 * len(set(words)) < 3 * n:
        return "repetition"
    low = line.lower()
    if n <= LONG_LINE and any(p in low for p in _phrases) and _bordered.search(low):
        return "boilerplate"
    if n <= 3 and b" ".join(words).lower() in _navigation or n >= 3 and 3 * sum(w in _separators for w in words) >= n:
        return "navigation"
    if 5 <= n <= LONG_LINE and not words[-1].endswith(_closing):
        return "unfinished"
    return None


def menu_lines(lines: list[list]) -> list[bool]:
    """Of lines (their words) whether each stands in a run of short ones that end no sentence."""
    out = [len(w) <= 4 and not w[-1].endswith(_sentence) for w in lines]
    i = 0
    while i < len(out):
        k = i
        while k < len(out) and out[k]:
            k += 1
        if 0 < k - i < MENU:
            out[i:k] = [False] * (k - i)
        i = k + 1
    return out


def judge(text: str | None, want_text: bool = False) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost words, cleaned text)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set = set()
    shapes: Counter = Counter()
    dup = lost = 0
    good = []
    lines = [(line, own) for line in data.split(b"\n") if (own := line.split())]
    for (line, own), menu in zip(lines, menu_lines([own for _, own in lines]), strict=True):
        if line in seen:
            dup += 1
            lost += len(own)
            continue
        seen.add(line)
        shape = _digits.sub(b"0", line)
        shapes[shape] += 1
        if menu or shapes[shape] > 2 or failed_rule(line, own):
            lost += len(own)
        elif want_text:
            good.append(line)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_window_words(words), lost, b"\n".join(good).decode("utf-8", "surrogatepass") if want_text else None


def line_first_quality(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_loss: int = MAX_LOSS, cleaned: bool = False) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    base_failed and kept; with ``cleaned`` also cleaned_text, the lines that passed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]

    def per_batch(texts: list) -> dict:
        rows = [judge(t, cleaned) for t in texts]
        made = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        made["base_failed"] = [r[0] < min_words or 100 * r[4] > max_repeat * r[0] for r in rows]
        made["kept"] = [not b and 100 * r[5] <= max_loss * r[0] for r, b in zip(rows, made["base_failed"], strict=True)]
        if cleaned:
            made["cleaned_text"] = [r[6] for r in rows]
        return made

    return map_text(docs, text_col, keep, [*map(long, names), boolean("base_failed"), boolean("kept"), *([string("cleaned_text")] if cleaned else [])], per_batch)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with the lines that passed as their text; ``n_chars``, where there is
    one, is counted again. Other columns stay as they are."""

    got, back = judged(docs, lambda src, text, keep: line_first_quality(src, text, keep, cleaned=True))
    names = [c.lower() for c in docs.columns]
    text = f"__in_{names.index('text')}"
    got = got.where("kept").withColumn(text, F.col("cleaned_text"))
    if "n_chars" in names:
        chars = f"__in_{names.index('n_chars')}"
        got = got.withColumn(chars, F.length(text).cast(docs.schema[names.index("n_chars")].dataType))
    return back(got)


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: DuckDB: the same, with its own string functions.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM w),
lw AS (SELECT rid, k, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lws FROM ln),
lg AS (SELECT rid, k, line, len(lws) AS n, row_number() OVER (PARTITION BY rid, line ORDER BY k) AS nth, row_number() OVER (PARTITION BY rid ORDER BY k) AS place,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sy, length(regexp_replace(line, '[^!]', '', 'g')) AS ex,
  len(list_distinct(lws)) AS dw, lws[len(lws)][-1] AS tail, lower(line) AS lo, lower(array_to_string(lws, ' ')) AS flat,
  len(list_filter(lws, lambda x: x IN ({_quoted(SEPARATORS)}))) AS sp, regexp_replace(line, '[0-9]+', '0', 'g') AS shape FROM lw WHERE len(lws) > 0),
mn AS (SELECT *, n <= 4 AND NOT contains('{SENTENCE}', tail) AS low FROM lg),
mg AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY place) AS run FROM mn),
mr AS (SELECT *, low AND sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY rid, run) >= {MENU} AS menu,
  sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rid, shape ORDER BY place) AS alike FROM mg),
lv AS (SELECT rid, n, nth > 1 AS dup, (nth > 1 OR menu OR alike > 2 OR 3 * sy >= n OR (n >= 3 AND 2 * ex >= n) OR (n >= 10 AND 10 * dw < 3 * n)
  OR (n <= {LONG_LINE} AND regexp_matches(lo, '(^|[^a-z0-9])({"|".join(BOILERPLATE)})([^a-z0-9]|$)')) OR (n <= 3 AND flat IN ({_quoted(NAVIGATION)})) OR (n >= 3 AND 3 * sp >= n)
  OR (n BETWEEN 5 AND {LONG_LINE} AND NOT contains('{CLOSING.replace("'", "''")}', tail))) AS bad FROM mr),
la AS (SELECT rid, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS dups, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM lv GROUP BY rid),
wd AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM wd WINDOW o AS (PARTITION BY rid ORDER BY i)),
g3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS c FROM g WHERE z IS NOT NULL),
rp AS (SELECT rid, count(DISTINCT i + j) AS reps FROM g3, (VALUES (0), (1), (2)) AS o(j) WHERE c >= 2 GROUP BY rid),
s AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(reps, 0) AS n_repeat_words,
  coalesce(lost, 0) AS n_lost_words FROM w LEFT JOIN la USING (rid) LEFT JOIN rp USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * n_lost_words <= {MAX_LOSS} * n_words AS kept
FROM s
"""
