"""Sequence packing along a space-filling curve.

Every document becomes its token ids and the closing id. Its hashed vector (token counts, each
token hashed to a few random signs) is projected to ``DIMS`` dimensions, squashed to a grid and
read as a position on a Hilbert curve. Documents are range-sorted by that position and laid end
to end; the line is cut every ``size`` tokens. So sequences hold documents that are near on the
curve, only the very last one can need padding, and no document is left out.

Null and empty texts are just the closing id. Rows are packed one by one, so repeated rows are
packed as often as they come; equal positions are ordered by key and content, null keys
by their place in the input. An empty table gives no pieces. Texts of any length are cut over as many sequences
as they need. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, hashed_spans, slices, word_spans, written

SIZE, CLOSING_ID = 4096, 2
DIMS, BITS = 4, 12
SAMPLE_PER_RANGE = 100
#: Units that a worker remembers, and bits of the table that finds them; bytes looked up together.
CACHE_UNITS, TABLE_BITS, BLOCK = 1_200_000, 21, 1 << 20
GAP = re.compile(rb"[ \n]")
#: Longer units are hashed by a cryptographic hash.
LONG_UNIT = 256
#: Closing characters that are never one word with a letter or digit before them.
CUTS = b".,;:!?#*$%&|\"()[]{}-_/+=<>"
#: Marks that may join an ASCII letter to one letter, which its lower case alone may not do.
MARKS = re.compile("[\u0300-\u036f]")
#: Alphabets (code points up to here) from which plain letters are taken.
LETTERS = 0x530


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, and the
    sums of their projected vectors.

    The tokenizer composes, lower-cases and splits characters; it never joins what white space parts,
    nor a letter or digit and a closing character after it. So texts are cut into units there, and
    the ids of a unit are looked up by its 64-bit hash (one in 10^13 new units meets another's).
    Units not met before go to the tokenizer as they are; those of plain letters go in one call, and
    their ids part after those that end a word. Letters are plain if the tokenizer itself takes them
    for one letter inside a word. A text with the name of an added token goes to it whole."""

    def __init__(self, path: str, table: np.ndarray) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), table
        vocab = self.tokenizer.get_vocab()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        letters = self._plain_letters()
        self.plain = re.compile("[" + "".join(letters) + "]+")
        self.cut = np.isin(np.arange(256), np.frombuffer(CUTS, np.uint8))
        self.before = np.zeros(256, bool)  # ASCII letters and digits
        self.before[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self.letter = np.zeros(0x800, bool)
        self.letter[[ord(c) for c in letters]] = True
        self._forget()

    def _forget(self) -> None:
        self.size = 0
        self.key, self.value = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.ids, self.first, self.sums = np.zeros(0, "<u2"), np.zeros(1, np.int64), np.zeros((0, self.table.shape[1]), np.float32)

    def _plain_letters(self) -> list[str]:
        """Letters that are composed and lower-cased to one letter and make no word of their own."""
        every = [chr(i) for i in range(LETTERS) if chr(i).isalpha() and unicodedata.normalize("NFC", chr(i)) == chr(i) and len(chr(i).lower()) == 1]
        words = [e.ids for e in self.tokenizer.encode_batch_fast([f"a{c}a" for c in every], add_special_tokens=False)]
        return [c for c, ids in zip(every, words, strict=True) if self.ends[ids].sum() == 1 and self.ends[ids[-1]]]

    @staticmethod
    def _bytes(text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        return raw if len(raw) > len(text) and MARKS.search(text) else raw.lower()  # A-Z only

    def _units(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every unit."""
        a = np.frombuffer(data, np.uint8)
        start, end = word_spans(a)
        at = np.flatnonzero(self.cut[a])
        at = at[at > 0]
        prev = a[at - 1]
        good = self.before[prev]
        wide = np.flatnonzero((prev >= 0x80) & (at > 1))  # a letter of two bytes
        lead = a[at[wide] - 2].astype(np.int64)
        good[wide] = (lead & 0xE0 == 0xC0) & self.letter[(lead & 0x1F) << 6 | prev[wide] & 0x3F]
        if good.any():
            start, end = np.sort(np.concatenate((start, at[good]))), np.sort(np.concatenate((end, at[good])))
        h = hashed_spans(a, start, end)
        for i in np.flatnonzero(end - start > LONG_UNIT):
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
        h[h == 0] = 1
        return start, end, h

    def _learn(self, words: list[str]) -> list[int]:
        """Stores the ids of new units; returns the order in which they were stored."""
        plain = [i for i, w in enumerate(words) if self.plain.fullmatch(w)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in plain])], add_special_tokens=False)[0].ids, "<u2") if plain else np.zeros(0, "<u2")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(plain):
            raise RuntimeError("the tokenizer parts plain letters")
        own = set(plain)
        rest = [i for i in range(len(words)) if i not in own]
        more = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        ids = np.concatenate([ids, *[np.array(x, "<u2") for x in more]])
        first = np.concatenate((at, len(ids) - sum(map(len, more)) + np.cumsum([len(x) for x in more]))).astype(np.int64)
        total = np.concatenate((np.zeros((1, self.table.shape[1])), np.cumsum(self.table[ids], 0, dtype=np.float64)))
        self.sums = np.concatenate((self.sums, np.diff(total[np.concatenate(([0], first))], axis=0).astype(np.float32)))
        self.first = np.concatenate((self.first, len(self.ids) + first))
        self.ids = np.concatenate((self.ids, ids))
        return plain + rest

    def _find(self, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of every unit; new ones are learnt."""
        shift, mask = np.uint64(64 - TABLE_BITS), (1 << TABLE_BITS) - 1
        out, at, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> shift).astype(np.int64)
        while len(at):
            there = self.key[slot]
            hit = there == h[at]
            out[at[hit]] = self.value[slot[hit]]
            on = ~hit & (there != 0)
            at, slot = at[on], (slot[on] + 1) & mask
        new = np.flatnonzero(out < 0)
        if len(new):
            key, where = np.unique(h[new], return_index=True)
            own = new[where]
            order = self._learn([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            number = np.empty(len(key), np.int64)
            number[order] = self.size + np.arange(len(key))
            self.size += len(key)
            out[new] = number[np.searchsorted(key, h[new])]
            left, slot = np.arange(len(key)), (key >> shift).astype(np.int64)
            while len(left):
                free = self.key[slot] == 0
                self.key[slot[free]] = key[left[free]]
                set_ = self.key[slot] == key[left]
                self.value[slot[set_]] = number[left[set_]]
                left, slot = left[~set_], (slot[~set_] + 1) & mask
        return out

    def encode(self, texts: list) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text as little-endian 16-bit strings, and the sums of their vectors."""
        n = len(texts)
        ids: list[list[bytes]] = [[] for _ in range(n)]
        sums = np.zeros((n, self.table.shape[1]))
        whole = [i for i, t in enumerate(texts) if t and "<|" in t and self.added.search(t)]
        skip = set(whole)
        raw = [b"" if i in skip or not t else self._bytes(t) for i, t in enumerate(texts)]
        for i in whole:
            x = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u2")
            ids[i].append(x.tobytes())
            sums[i] = self.table[x].sum(0, dtype=np.float64)
        with np.errstate(over="ignore"):
            for lo, hi in blocks_of(raw, BLOCK):
                data = b"\n".join(raw[lo:hi])
                begin = np.cumsum([0, *(len(r) + 1 for r in raw[lo:hi])])
                at = 0
                while at < len(data):  # a long text in parts, cut at a space
                    stop = len(data)
                    if stop - at > 2 * BLOCK:
                        m = GAP.search(data, at + BLOCK)
                        stop = m.start() if m else stop
                    self._add(data[at:stop], begin - at, lo, ids, sums)
                    at = stop
        return [b"".join(x) for x in ids], sums

    def _add(self, data: bytes, begin: np.ndarray, lo: int, ids: list, sums: np.ndarray) -> None:
        """Ids and sums of the part of the texts from number ``lo`` on that ``data`` holds."""
        if self.size > CACHE_UNITS:
            self._forget()
        start, end, h = self._units(data)
        unit = self._find(data, start, end, h)
        count = self.first[unit + 1] - self.first[unit]
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = self.ids[np.repeat(self.first[unit] - upto[:-1], count) + np.arange(upto[-1])]
        total = np.concatenate((np.zeros((1, sums.shape[1])), np.cumsum(self.sums[unit], 0, dtype=np.float64)))
        edge = np.searchsorted(start, begin)
        for i in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[i], edge[i + 1]
            ids[lo + i].append(flat[upto[a] : upto[b]].tobytes())
            sums[lo + i] += total[b] - total[a]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path, projection())
    return _encoders[path]


def projection(vocab: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """The row of a token: what its hashed coordinates add to each projected dimension."""
    rng = np.random.default_rng(20240229)
    return rng.standard_normal((vocab, dims)).astype(np.float32)


def grid_points(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Cells of the documents' projected, length-normalised vectors; an empty one is in the middle."""
    mean = sums / np.maximum(lengths, 1)[:, None]
    return ((np.tanh(2 * mean) + 1) / 2 * ((1 << BITS) - 1)).round().astype(np.int64)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve through a grid of 2^bits cells a side.

    From the highest bit down, each level's cell is undone by the reflections and exchanges that
    the cells above it cause; the Gray code of the result, bit by bit, is the position."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def tokenised(src: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc, pos, hkey, n, crc and the ids (16 bits each, the closing id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), CLOSING_ID.to_bytes(2, "little")
        for batch in slices(batches):
            raw, sums = enc.encode(batch.column("text").to_pylist())
            keys = hilbert_index(grid_points(sums, np.array([len(r) // 2 for r in raw])))
            raw = [r + end for r in raw]
            made = [batch.column("doc"), batch.column("pos"), pa.array(keys), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(made + [pa.array(raw, pa.binary())] * with_ids, names=["doc", "pos", "hkey", "n", "crc", "ids"][: 5 + with_ids])

    return src.mapInArrow(run, "doc long, pos long, hkey long, n long, crc long" + ", ids binary" * with_ids)


def range_cuts(some: list[tuple], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(hkey, pos) bounds that deal a sample of (hkey, pos, tokens) to ranges of like many tokens."""
    some = sorted(some)
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.cumsum([s[2] for s in some])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges, "right")
    return tuple(np.array([some[min(i, len(some) - 1)][k] for i in at], np.int64) for k in (0, 1))


def pack(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with
    ``with_ids`` also the ids of the piece (16 bits each).

    Range bounds come from a sample of about ``SAMPLE_PER_RANGE`` rows a range, weighed by their
    tokens; they decide which task sorts a row, never where it is packed. One shuffle moves the ids,
    each range to a task of its own; the sorted ranges are written; their totals (one number a range)
    give every range its place on the line."""
    spark = docs.sparkSession
    path = tokenizer or vocabulary_path()
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    src = src.withColumn("pos", F.coalesce("doc", F.monotonically_increasing_id() - F.lit(1 << 62)))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, docs.count()))
    some = tokenised(src.sample(share, 5) if share < 1 else src, path, False).select("hkey", "pos", "n").collect()
    cut_keys, cut_pos = range_cuts([tuple(r) for r in some], ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, pos = batch.column("hkey").to_numpy(), batch.column("pos").to_numpy()
            lo, hi = np.searchsorted(cut_keys, h, "left"), np.searchsorted(cut_keys, h, "right")
            part = lo.astype(np.int64)
            for i in np.flatnonzero(hi > lo):  # a bound's own key: its position decides
                part[i] += np.searchsorted(cut_pos[lo[i] : hi[i]], pos[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in slices(batches):
            before = []
            for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if p != last:
                    last, total = p, 0
                before.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "before"])

    one = tokenised(src, path).mapInArrow(deal, "doc long, pos long, hkey long, n long, crc long, ids binary, part long")
    line = one.repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions("part", "hkey", "pos", "crc").drop("hkey", "pos", "crc")
    line = written(line.mapInArrow(place, "doc long, n long, ids binary, part long, before long"))
    totals = {r[0]: r[1] for r in line.groupBy("part").agg(F.sum("n")).collect()}  # one row a range
    base, at = {}, 0
    for p in sorted(totals):
        base[p], at = at, at + totals[p]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[str, list] = {c: [] for c in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, n, ids, p, before in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "ids", "part", "before")), strict=True):
                g = base[p] + before
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(g + start, size)
                    length = min(n - start, size - off)
                    piece = (doc, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, seq, off, ids[2 * start : 2 * (start + length)])
                    for c, v in zip(rows, piece, strict=True):
                        if c != "ids" or with_ids:
                            rows[c].append(v)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = list(rows)[: 7 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(names, kinds, strict=False)], names=names)

    out = line.mapInArrow(cut, "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("doc", key)
