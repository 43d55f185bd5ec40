"""Main text of web pages: a recurrent labeller of blocks.

A page is cut into its leaf blocks (the text between the starts and ends of block elements; a
line break is white space). Every block is a vector: the mean of its hashed tag-path entries
(elements, and the words of their class, id and role), the mean of its hashed words, and a few
sizes. A bidirectional LSTM over the page's whole sequence labels every block; blocks labelled
main are joined in page order by an empty line.

Training labels come from the markup itself: on a bounded sample of pages that name their
article, blocks inside it are main and those inside navigation, footers, adverts and the like are
not. The sample's blocks are also laid out anew in other containers (sidebars, notices, forms,
reader comments, bare ``div`` layouts), so that labels can't be read off one template only. Where
fewer than ``INVENTED`` pages name their article, invented pages join them; so a table without any
gets a labeller that has learnt from containers and the look of invented prose alone.

Null and empty pages give an empty text. Pages are read whole, row by row, in time that grows with
their length: repeated rows repeat their result, an empty table gives an empty one, further columns
are only carried on request. Of a block's path the innermost ``ENTRIES`` entries count. Pages of more
than ``STEPS`` blocks are read in windows of so many that overlap by ``OVERLAP`` on either side.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, long, map_text, string, trained
from .neural import Adam, BiLstm, sigmoid

ROWS, ROUNDS, HIDDEN = 240, 6, 16
PATHS, WORDS, P_DIM, W_DIM, SIZES = 1024, 2048, 16, 8, 7
ENTRIES, STEPS, OVERLAP, INVENTED = 24, 1024, 128, 60
#: Characters of a page that the labeller is fitted on, and of a tag that are searched for marks.
PAGE_CHARS, TAG_CHARS = 200_000, 4096
#: Elements that start and end blocks, elements without an end tag, and raw text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title noscript template svg textarea iframe object".split())
#: Of these, elements that hold markup: without an end tag their start tag alone is passed over.
NESTING = frozenset("template svg object".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
COMMENT_END = re.compile("--!?>")
#: Numeric references of eight digits and more.
WIDE_REF = re.compile("&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
STOP = re.compile("[>\"']")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
CLOSING = frozenset(".!?:;\"”»…。！？")
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "dialog", "menu"))
OTHER_WORDS = frozenset("ad ads advert advertisement banner promo sponsor sponsored menu nav navbar breadcrumb sidebar widget related footer header notice cookie consent popup modal newsletter subscribe share social comment comments reply respond form login search".split())


def narrowed(m: re.Match) -> str:
    """A numeric reference without leading zeros; one beyond every character is U+FFFD."""
    hexadecimal = m[0][2] in "xX"
    digits = m[0][2 + hexadecimal :].rstrip(";").lstrip("0") or "0"
    return f"&#{'x' * hexadecimal}{digits};" if len(digits) < 8 else "\ufffd"


def decoded(text: str) -> str:
    """With character references resolved and white space folded."""
    if "&" in text:
        text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(WIDE_REF.sub(narrowed, text))
    return " ".join(text.split())


def tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where the tag that begins at ``at`` ends: behind the first ``>`` outside quotes, or with an
    open quote behind the first ``>``. A quote found missing once is not searched for again."""
    i = at
    while m := STOP.search(page, i):
        c = m[0]
        if c == ">":
            return m.end()
        i = -1 if c in absent else page.find(c, m.end())
        if i < 0:
            absent.add(c)
            break
        i += 1
    return page.find(">", at) + 1


def tokens(page: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, name, closing) of all markup, in one pass; comments and declarations have no
    name, elements whose content is no text end with it. A ``<`` that begins nothing is text."""
    at, last, absent = page.find("<"), page.rfind(">"), set()
    while 0 <= at <= last:
        m = NAME.match(page, at)
        if m:
            name, closing = m[1].lower(), page[at + 1] == "/"
            end = tag_end(page, at, absent)
            if name in RAW and not closing and not (name == "svg" and page[end - 2] == "/"):
                stop = None if name in absent else RAW_END[name].search(page, end)
                if stop:
                    end = tag_end(page, stop.start(), absent) or len(page)
                elif name in NESTING:
                    absent.add(name)
                else:
                    end = len(page)
            yield at, end, name, closing
        elif page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):  # an empty comment
                end = page.find(">", at) + 1
            else:
                stop = COMMENT_END.search(page, at + 4)
                end = stop.end() if stop else len(page)
            yield at, end, "", False
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", False
        else:
            end = at + 1
        at = page.find("<", end)


def blocks(page: str) -> list[tuple[str, tuple, float]]:
    """(text, path entries, share of the characters inside links) of every leaf block."""
    out: list = []
    stack: list[tuple[str, tuple]] = []  # open elements with their paths
    opened: Counter = Counter()
    parts: list[str] = []
    linked = total = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = decoded("".join(parts))
            parts.clear()
            if text:
                out.append((text, stack[-1][1] if stack else (), linked / max(1, total)))
        linked = total = 0

    def say(text: str) -> None:
        nonlocal linked, total
        parts.append(text)
        total += len(text)
        linked += len(text) * in_link

    at = 0
    for start, end, tag, closing in tokens(page):
        if start > at:
            say(page[at:start])
        at = end
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in ("title", "textarea") and not closing:
            flush()
        if tag not in BLOCK:
            continue
        flush()
        if not closing:
            if tag == "li" or tag == "p" or stack and stack[-1][0] == "p":
                while stack and stack[-1][0] in ("p", tag):
                    opened[stack.pop()[0]] -= 1
            if tag not in VOID:
                text = page[start : min(end, start + TAG_CHARS)]
                marks = MARK.findall(text) if "=" in text else ()
                own = (tag, *["." + w for v in marks for w in WORD.findall(v.lower())])
                stack.append((tag, ((stack[-1][1] + own) if stack else own)[-ENTRIES:]))
                opened[tag] += 1
        elif opened[tag] > 0:
            while (top := stack.pop()[0]) != tag:
                opened[top] -= 1
            opened[tag] -= 1
    if at < len(page):
        say(page[at:])
    flush()
    return out


def known_label(path: tuple) -> int | None:
    """1 main, 0 other, None where the markup doesn't say; what stands deepest counts."""
    for e in reversed(path):
        if e in OTHER_TAGS or e[0] == "." and e[1:] in OTHER_WORDS:
            return 0
        if e in MAIN_TAGS:
            return 1
    return None


class Features:
    """Index lists and sizes of the blocks of a batch of pages; a path that blocks share is listed
    once, and ``path_id`` says which is a block's."""

    def __init__(self, pages: list[list[tuple[str, tuple, float]]]) -> None:
        self.lengths = [len(p) for p in pages]
        every = [b for p in pages for b in p]
        self.n = len(every)
        paths: dict[tuple, int] = {}
        self.path_id = np.fromiter((paths.setdefault(b[1], len(paths)) for b in every), np.int64, self.n)
        self.n_paths = len(paths)
        self.path_of = np.repeat(np.arange(self.n_paths), [len(p) for p in paths])
        seen: dict[str, int] = {}
        self.path = np.array([seen[e] if e in seen else seen.setdefault(e, zlib.crc32(e.encode()) % PATHS) for p in paths for e in p], np.int64)
        raw = [b[0].encode("utf-8", "surrogatepass").lower() for b in every]
        begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        with np.errstate(over="ignore"):
            h, start, _ = hashed_words(b"\n".join(raw))
        edges = np.searchsorted(start, begin)
        self.words_in = np.diff(edges)
        self.word_of = np.repeat(np.arange(self.n), self.words_in)
        self.word = (h % np.uint64(WORDS)).astype(np.int64)
        size = np.zeros((self.n, SIZES), np.float32)
        if self.n:
            deep = np.array([len(p) / 10 for p in paths])
            head = np.array([bool(p) and p[-1][0] == "h" and p[-1][1:].isdigit() for p in paths])
            size[:, 0] = np.log1p(self.words_in) / 4
            size[:, 1] = [b[2] for b in every]
            size[:, 2] = [b[0][-1] in CLOSING for b in every]
            size[:, 3] = deep[self.path_id]
            size[:, 4] = np.concatenate([np.linspace(0, 1, n) if n else np.zeros(0) for n in self.lengths])
            size[:, 5] = [(b[0].count(".") + b[0].count(",") + b[0].count(";")) / max(1, len(b[0])) * 20 for b in every]
            size[:, 6] = head[self.path_id]
        self.size = size


def _mean(table: np.ndarray, index: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(owner, minlength=n).astype(np.float32)
    ends = np.cumsum(count).astype(np.int64)
    sums = np.zeros((n, table.shape[1]), np.float32)
    for lo in range(0, n, 4096):  # in blocks, as a page may hold very many words
        a, b = int(ends[lo] - count[lo]), int(ends[min(n, lo + 4096) - 1])
        full = np.flatnonzero(count[lo : lo + 4096])
        if b > a:
            sums[lo + full] = np.add.reduceat(table[index[a:b]], (ends[lo + full] - count[lo + full]).astype(np.int64) - a, axis=0)
    return sums / np.maximum(count, 1)[:, None], count


class Labeller:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.net = BiLstm(P_DIM + W_DIM + SIZES, HIDDEN, rng)
        self.p = {"path": rng.normal(0, 0.3, (PATHS, P_DIM)).astype(np.float32), "word": rng.normal(0, 0.1, (WORDS, W_DIM)).astype(np.float32), "out": rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32), "bias": np.zeros(1, np.float32)}

    def _grid(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Cell (time, page) of every block."""
        page = np.repeat(np.arange(len(f.lengths)), f.lengths)
        return np.arange(f.n) - np.repeat(np.cumsum([0, *f.lengths[:-1]]), f.lengths), page

    def _inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vp, cp = _mean(self.p["path"], f.path, f.path_of, f.n_paths)
        vw, cw = _mean(self.p["word"], f.word, f.word_of, f.n)
        return np.concatenate([vp[f.path_id], vw, f.size], 1), cp, cw

    def _run(self, f: Features) -> tuple:
        x, cp, cw = self._inputs(f)
        at, page = self._grid(f)
        grid = np.zeros((max(f.lengths), len(f.lengths), x.shape[1]), np.float32)
        mask = np.zeros(grid.shape[:2], np.float32)
        grid[at, page], mask[at, page] = x, 1
        h, kept = self.net.forward(grid, mask, True)
        logit = (h @ self.p["out"])[at, page, 0] + self.p["bias"][0]
        return logit, (h, kept, at, page, cp, cw, mask)

    def _logits(self, f: Features) -> np.ndarray:
        """Of every block; sequences, or windows of long ones, of like length run together."""
        x = self._inputs(f)[0]
        out = np.zeros(f.n, np.float32)
        jobs, begin = [], 0  # first and last block that a window reads, and those that it labels
        for n in f.lengths:
            for lo in range(0, n, STEPS):
                hi = min(n, lo + STEPS)
                jobs.append((begin + max(0, lo - OVERLAP), begin + min(n, hi + OVERLAP), begin + lo, begin + hi))
            begin += n
        jobs.sort(key=lambda j: j[1] - j[0])
        lo = 0
        while lo < len(jobs):
            hi = lo + 1
            while hi < len(jobs) and (hi - lo + 1) * (jobs[hi][1] - jobs[hi][0]) <= 16384:
                hi += 1
            own = jobs[lo:hi]
            grid = np.zeros((own[-1][1] - own[-1][0], len(own), x.shape[1]), np.float32)
            mask = np.zeros(grid.shape[:2], np.float32)
            for k, (a, b, _, _) in enumerate(own):
                grid[: b - a, k], mask[: b - a, k] = x[a:b], 1
            logit = (self.net.forward(grid, mask)[0] @ self.p["out"])[:, :, 0] + self.p["bias"][0]
            for k, (a, _, c, d) in enumerate(own):
                out[c:d] = logit[c - a : d - a, k]
            lo = hi
        return out

    def main(self, pages: list[list]) -> list[list[bool]]:
        """Whether each block of each page is main text."""
        f = Features(pages)
        good = self._logits(f) > 0
        return [g.tolist() for g in np.split(good, np.cumsum(f.lengths)[:-1])] if pages else []

    def train(self, pages: list[list], labels: list[list[int]], rounds: int = ROUNDS, seed: int = 4) -> None:
        """Blocks labelled -1 are read but don't count."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.p | self.net.params(), 0.01)
        for _ in range(rounds):
            order = [i for i in rng.permutation(len(pages)) if pages[i]]
            groups = [sorted(order[a : a + 96], key=lambda i: len(pages[i])) for a in range(0, len(order), 96)]  # of like length, for little padding
            batches = [g[b : b + 16] for g in groups for b in range(0, len(g), 16)]
            for k in rng.permutation(len(batches)):
                own = batches[k]
                f = Features([pages[i] for i in own])
                y = np.concatenate([labels[i] for i in own]).astype(np.float32)
                logit, (h, kept, at, page, cp, cw, mask) = self._run(f)
                d = ((sigmoid(logit) - y) * (y >= 0) / max(1, (y >= 0).sum())).astype(np.float32)
                dh = np.zeros_like(h)
                dh[at, page] = d[:, None] * self.p["out"][:, 0]
                dx, grads = self.net.backward(dh, kept)
                dx = dx[at, page]
                grads |= {"out": h[at, page].T @ d[:, None], "bias": np.array([d.sum()], np.float32)}
                by_path = np.zeros((f.n_paths, P_DIM), np.float32)
                np.add.at(by_path, f.path_id, dx[:, :P_DIM])
                for name, part, index, owner, count in (("path", by_path, f.path, f.path_of, cp), ("word", dx[:, P_DIM : P_DIM + W_DIM], f.word, f.word_of, cw)):
                    grads[name] = np.zeros_like(self.p[name])
                    np.add.at(grads[name], index, (part / np.maximum(count, 1)[:, None])[owner])
                adam.step(grads)


#: Containers for the layouts that training makes (path entries, label).
LAYOUTS_MAIN = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("div", ".entry"), ("section", ".story"), ("div", "div"), ("section",))
LAYOUTS_OTHER = (
    ("nav", "ul", "li"), ("header", "div"), ("footer",), ("footer", "p"), ("aside",), ("aside", "p"), ("div", ".ad"), ("div", ".advert"), ("div", ".banner"), ("div", ".sponsored"), ("div", ".sidebar"), ("div", ".sidebar", "ul", "li"),
    ("div", ".notice"), ("div", ".cookie", ".consent"), ("div", ".popup"), ("form",), ("form", "label"), ("form", "p"), ("button",), ("section", ".comments", "div", ".comment", "p"), ("div", ".comments", "p"), ("ol", ".comment", ".list", "li", "p"),
    ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".newsletter"), ("div", ".menu", "ul", "li"), ("div", ".breadcrumb"),
)


def layouts(pages: list[list], rng: np.random.Generator) -> tuple[list, list]:
    """The pages as they are, with the labels that their markup says, and each once more with its
    blocks dealt to other containers."""
    made, labels = [], []
    pool = [b[0] for p in pages for b in p if known_label(b[1]) == 0]
    for p in pages:
        known = [known_label(b[1]) for b in p]
        made.append(p)
        labels.append([-1 if k is None else k for k in known])
        body = [b for b, k in zip(p, known, strict=True) if k == 1]
        if not body or not pool:
            continue
        main = LAYOUTS_MAIN[rng.integers(len(LAYOUTS_MAIN))]
        inner = "div" if rng.random() < 0.2 else "p"
        new = [(b[0], ("html", "body", *main, b[1][-1] if b[1][-1] not in MAIN_TAGS else inner), b[2]) for b in body]
        tags = [1] * len(new)

        def extra(inside: bool, new: list = new, tags: list = tags, main: tuple = main, body: list = body) -> None:
            where = LAYOUTS_OTHER[rng.integers(len(LAYOUTS_OTHER))]
            at = int(rng.integers(len(new) + 1)) if inside else int(rng.choice([0, len(new)]))
            for _ in range(int(rng.integers(1, 5))):
                words = pool[rng.integers(len(pool))] if rng.random() < 0.6 else body[rng.integers(len(body))][0][: int(rng.integers(20, 300))]
                new.insert(at, (words, ("html", "body", *(main if inside else ()), *where), float(rng.random() < 0.4)))
                tags.insert(at, 0)

        for _ in range(int(rng.integers(2, 6))):
            extra(bool(rng.random() < 0.3))
        made.append(new)
        labels.append(tags)
    return made, labels


def invented(rng: np.random.Generator, count: int) -> list[list]:
    """Pages of invented words: prose in an article, short phrases around it."""

    def phrase(n: int) -> str:
        return " ".join("".join(rng.choice(list("aeiounrstlmdkpch"), int(rng.integers(2, 9)))) for _ in range(n)).capitalize()

    made = []
    for _ in range(count):
        page = [(phrase(int(rng.integers(1, 4))), ("html", "body", "nav", "ul", "li"), 1.0) for _ in range(int(rng.integers(3, 9)))]
        page.append((phrase(int(rng.integers(3, 9))), ("html", "body", "article", "h1"), 0.0))
        for _ in range(int(rng.integers(3, 12))):
            page.append((" ".join(phrase(int(rng.integers(6, 20))) + "." for _ in range(int(rng.integers(1, 6)))), ("html", "body", "article", "p"), 0.0))
        page += [(phrase(int(rng.integers(3, 12))) + "." * int(rng.integers(2)), ("html", "body", "footer", "p"), 0.0) for _ in range(int(rng.integers(1, 4)))]
        made.append(page)
    return made


def fitted(rows: list[dict]) -> Labeller:
    model, rng = Labeller(), np.random.default_rng(5)
    model.train(*layouts([blocks(r["h"]) for r in rows] + invented(rng, ROWS - len(rows) if len(rows) < INVENTED else 0), rng))
    return model


def learn(pages: DataFrame, key: str = "page_id", html_col: str = "html", rows: int = ROWS) -> Labeller:
    """A labeller trained on at most ``rows`` pages that name their article, of each the first
    ``PAGE_CHARS`` characters."""
    src = pages.select(F.col(f"`{key}`").alias("k"), F.substring(F.col(f"`{html_col}`").cast("string"), 1, PAGE_CHARS).alias("h"))
    src = src.where(F.col("h").rlike("(?i)<(article|main)[ >]"))
    return trained(src, "k", rows, ["k", "h"], fitted)


def page_text(found: list, good: list[bool]) -> str:
    return "\n\n".join(b[0] for b, g in zip(found, good, strict=True) if g)


def extract(pages: DataFrame, model: Labeller, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def per_batch(texts: list) -> dict:
        out: list[str] = []
        for lo in range(0, len(texts), 64):
            found = [blocks(t or "") for t in texts[lo : lo + 64]]
            out += [page_text(b, g) for b, g in zip(found, shared.value.main(found), strict=True)]
        return {"text": out, "n_chars": [len(t) for t in out]}

    return map_text(pages, html_col, keep, [string("text"), long("n_chars")], per_batch)
