"""Secret scan with assignment-aware lexing.

Base kinds, leftmost and non-overlapping per kind (a failing match is dropped, not retried):
  assign  a sensitive word, ``:`` or ``=``, and a value of 12 characters or more
  access  ``AKIA`` keys of 18 characters or more
  hex     runs of 16 hexadecimal digits or more

The method lexes name-literal pairs of source and configuration syntax (``name = "x"``,
``"name": 'x'``, ``name => x``, ``export NAME=x``, ``name = f("x")``, ``<name>x</name>``, triple-quoted and indented
blocks whose lines are literals), follows constants (``b = a``, ``b = a + "x"``, ``${a}``) to the
literals they came from, whether they are set before or after, scores every literal by the names it
ends under and by its own variety of characters, and adds a span of kind ``literal`` where the score
reaches ``min_score`` and no base span touches it. A name means its last value set before, else the
first set after. Work grows with the text, also where constants are built up line by line.

Positions are code points, the end exclusive. Null and empty texts have no spans; whole texts
are read, however long; rows are independent, so copies give copies and an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .common import free_of, long, map_text, string

KINDS = ("assign", "access", "hex")
_either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
#: The words of the assign kind.
_WORDS = [_either(w) for w in ("password", "passwd", "secret", "token")] + [_either("api") + "_?" + _either("key")]
ASSIGN = re.compile("(" + "|".join(_WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer digits can't match, a longer one is taken whole

#: Weights of the parts of target names.
NAME_WEIGHT = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "bearer": 2.0, "auth": 1.5, "private": 1.0, "access": 1.0, "api": 1.0, "key": 1.0, "signing": 1.0, "salt": 1.0,
}
_STRING = r""""(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n])*+'"""
_BARE = r"[A-Za-z0-9/_.=$-]++(?:\++[A-Za-z0-9/_.=$-]++)*+"
PAIR = re.compile(
    r"""(?P<q>["']?)(?<![A-Za-z0-9_.$-])[0-9.-]*+(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)(?P=q)[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+"""
    r"""(?:(?P<block>\"{3}.*?\"{3}|'{3}.*?'{3})|[|>][+-]?[ \t]*+\n(?P<lines>(?:[ \t]++[^\n]*+(?:\n|\Z))++)|"""
    rf"""(?P<value>{_STRING}|[A-Za-z_$][A-Za-z0-9_.$]*+\([ \t]*+(?:{_STRING})|\$?\{{?{_BARE}\}}?)(?P<rest>(?:[ \t]*+\+[ \t]*+(?:{_STRING}|[A-Za-z_$][A-Za-z0-9_.$]*+))*+))""",
    re.S,
)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:[ \t][^<>]*+)?>[ \t\n]*+(?P<value>[^<>\s]++)[ \t\n]*+</")
TERM = re.compile(rf"{_STRING}|{_BARE}")
LINE = re.compile(r"[^\s\"']+")
IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z")
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
MIN_SCORE, MIN_LITERAL = 4.0, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def name_score(name: str) -> float:
    parts = [p.lower() for p in SPLIT.split(name) if p]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(NAME_WEIGHT.get(p, 0.0) for p in {*parts, *joined})


def literal_score(value: str) -> float:
    """Bits per character, and a bonus where letters and digits mix; sentences get none."""
    if len(value) < MIN_LITERAL or " " in value:
        return -9.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(bits, 4.0) / 2 + (0.5 if re.search("[0-9]", value) and re.search("[A-Za-z]", value) else 0.0)


def pairs(text: str) -> list[tuple[int, str, list[tuple[int, int]], list[str]]]:
    """(place, name, literals, names referred to) of every pair, in order."""
    out = []
    for m in PAIR.finditer(text):
        literals: list[tuple[int, int]] = []
        names: list[str] = []
        block = "block" if m["block"] else "lines" if m["lines"] else None
        if block:
            trim = 3 if block == "block" else 0
            literals = [t.span() for t in LINE.finditer(text, m.start(block) + trim, m.end(block) - trim)]
        else:
            for t in TERM.finditer(text, m.start("value"), m.end("rest")):
                raw = t[0].strip("$") if t[0].startswith("$") else t[0]
                if raw[:1] in ("'", '"'):
                    literals.append((t.start() + 1, t.end() - 1))
                else:
                    if IDENT.match(raw):
                        names.append(raw)
                    literals.append(t.span())  # counts where the name is set nowhere
        out.append((m.start(), m["name"], literals, names))
    if "</" in text:
        out += [(m.start(), m["name"], [m.span("value")], []) for m in ELEMENT.finditer(text)]
        out.sort(key=lambda p: p[0])
    return out


def literal_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int]]:
    """Literals whose own look and best target name reach ``min_score``."""
    if ":" not in text and "=" not in text and "</" not in text:
        return []
    found = pairs(text)
    later: dict[str, int] = {}  # the first pair of each name
    for i, (_, name, _, _) in enumerate(found):
        later.setdefault(name, i)
    last: dict[str, int] = {}
    sources: list[list[int]] = []  # the pairs that each pair's names refer to
    own: list[list[tuple[int, int]]] = []
    for i, (_, name, literals, names) in enumerate(found):
        known = {n: last.get(n, later.get(n)) for n in names}
        known = {n: k for n, k in known.items() if k is not None and k != i}
        sources.append(list(dict.fromkeys(known.values())))
        own.append([s for s in literals if text[s[0] : s[1]].strip("$") not in known])
        last[name] = i
    score = [name_score(name) for _, name, _, _ in found]
    for i in sorted(range(len(found)), key=lambda i: -score[i]):  # a pair's names are the best that it reaches
        todo = [i]
        while todo:
            k = todo.pop()
            for j in sources[k]:
                if score[j] < score[k]:
                    score[j] = score[k]
                    todo.append(j)
    best: dict[tuple[int, int], float] = {}
    for spans, w in zip(own, score, strict=True):
        if w >= 2:
            for s in spans:
                best[s] = max(best.get(s, 0.0), w)
    return sorted(s for s, w in best.items() if w + literal_score(text[s[0] : s[1]]) >= min_score)


def all_spans(text: str | None, min_score: float = MIN_SCORE) -> tuple[list, list]:
    """Base spans, and base spans with those of the method, each (start, kind's number, end)."""
    base = base_spans(text or "")
    extra, reach = [], 0
    for m in free_of([(s, len(KINDS), e) for s, e in literal_spans(text or "", min_score)], base):
        if m[0] >= reach:
            extra.append(m)
            reach = m[2]
    return base, sorted(base + extra)


def written_spans(spans: list, kinds: Sequence[str]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), min_score: float = MIN_SCORE) -> DataFrame:
    """``keep`` with n_assign, n_access, n_hex, n_literal, base_sha256 and spans."""
    kinds = (*KINDS, "literal")

    def per_batch(texts: list) -> dict:
        made: dict = {k: [] for k in ("base_sha256", "spans", *(f"n_{k}" for k in kinds))}
        for t in texts:
            base, every = all_spans(t, min_score)
            made["base_sha256"].append(hashlib.sha256(written_spans(base, kinds).encode()).hexdigest())
            made["spans"].append(written_spans(every, kinds))
            counts = Counter(k for _, k, _ in every)
            for i, k in enumerate(kinds):
                made[f"n_{k}"].append(counts[i])
        return made

    return map_text(docs, text_col, keep, [*(long(f"n_{k}") for k in kinds), string("base_sha256"), string("spans")], per_batch)
