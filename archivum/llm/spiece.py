"""Sampled segmentation into sentence pieces: forward filtering, backward sampling.

A text is a space-marked string; every space starts a chunk, and pieces don't reach over chunks.
Each distinct chunk of a block gets its lattice of vocabulary pieces. The forward pass sums the
weights of all segmentations up to every place; each occurrence then draws its pieces from the end
backwards, in proportion to these sums, so segmentations come with exactly their probabilities.
A piece of rank r weighs 1 / (r + 10), to the power ``theta``. Draws are a hash of the seed, the row
key, the chunk's number and the step: the same rows give the same pieces in any partitioning.

Characters that the vocabulary lacks (line feeds, a literal space mark) become their UTF-8 bytes'
pieces, so decoding gives every text back exactly. Null texts give null results, empty texts no
piece. Null keys draw like key 0; repeated rows draw alike. Texts are cut whole, a chunk of any
length too; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, boolean, long, map_text, mix64, slices

MARK = "▁"
THETA, SEED = 1.0, 17
TABLE_BITS, BATCH = 18, 2048
_P = np.uint64(0x9E3779B97F4A7C15)
_KEYS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: hashes of the pieces, their weights, and what each id decodes to."""

    def __init__(self, path: str, theta: float = THETA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.decoded = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        text: list[str] = []
        ids: list[int] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.decoded[i] = piece.replace(MARK, " ").encode()
                if MARK not in piece[1:]:
                    text.append(piece)
                    ids.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, text))
        self.weight = -theta * np.log(np.arange(n) + 10.0)
        code = np.zeros((len(text), self.longest), np.uint64)
        for r, t in enumerate(text):
            code[r, : len(t)] = [ord(c) + 1 for c in t]
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(self.longest - 1, _P))))
        h = mix64((code * power).sum(1, dtype=np.uint64) + np.array(list(map(len, text)), np.uint64))
        if len(np.unique(h)) < len(h) or not h.all():
            raise ValueError("two pieces share a hash")
        self.table, self.piece = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int64)
        for x, i in zip(h.tolist(), ids, strict=True):
            k = x >> (64 - TABLE_BITS)
            while self.table[k]:
                k = (k + 1) % len(self.table)
            self.table[k], self.piece[k] = x, i
        self.inverse = np.uint64(pow(int(_P), -1, 1 << 64))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``key`` pieces are, and their ids."""
        slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        at, where, ids = np.arange(len(key)), [], []
        while len(at):
            there = self.table[slot]
            hit = there == key[at]
            where.append(at[hit])
            ids.append(self.piece[slot[hit]])
            more = ~hit & (there != 0)
            at, slot = at[more], (slot[more] + 1) % len(self.table)
        return np.concatenate(where or [at]), np.concatenate(ids or [at])


_loaded: dict[tuple, Pieces] = {}


def pieces(path: str, theta: float) -> Pieces:
    if (path, theta) not in _loaded:
        with np.errstate(over="ignore"):
            _loaded[path, theta] = Pieces(path, theta)
    return _loaded[path, theta]


class Lattice:
    """The edges of many chunks. A node is a place in the joined chunks (one more than characters
    each); edges stand in the order of their end nodes, with running probabilities."""

    def __init__(self, chunks: list[str], v: Pieces) -> None:
        raw = [(MARK + c.replace(MARK, "\U0010ffff")).encode("utf-32-le", "surrogatepass") for c in chunks]
        size = np.array([len(r) // 4 for r in raw], np.int64)
        first = np.cumsum(size + 1) - size - 1  # a spare place after each chunk
        self.start, self.end = first, first + size
        code = np.frombuffer(b"\0\0\0\0".join(raw) + b"\0\0\0\0", "<u4").astype(np.uint64)
        n = len(code)
        stop = np.repeat(self.end, size + 1)
        power, back = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
        for out, base in ((power, _P), (back, v.inverse)):
            out.fill(base)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * power[:n], out=h[1:])
        src, dst, pid = [], [], []
        at = np.flatnonzero(np.arange(n) < stop)
        single = np.zeros(n, bool)
        for length in range(1, v.longest + 1):
            at = at[at + length <= stop[at]]
            if not len(at):
                break
            key = mix64((h[at + length] - h[at]) * back[at] + np.uint64(length))
            hit, ids = v.find(key)
            a = at[hit]
            if length == 1:
                single[a] = True
            src.append(a)
            dst.append(a + length)
            pid.append(ids)
        lone = np.flatnonzero(~single & (np.arange(n) < stop))  # to be written as bytes
        self.bytes_of = {}
        if len(lone):
            shown = np.where(code[lone] == 0x10FFFF, ord(MARK), code[lone]).astype(np.int64)
            for c in np.unique(shown):
                self.bytes_of[int(c)] = v.byte_id[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)]
            src.append(lone)
            dst.append(lone + 1)
            pid.append(-shown - 1)
        src, dst, pid = map(np.concatenate, (src, dst, pid))
        order = np.lexsort((src, dst))
        self.src, dst, self.pid = src[order], dst[order], pid[order]
        weight = np.where(self.pid >= 0, v.weight[np.maximum(self.pid, 0)], v.weight[-1])
        self._sums(dst, weight, np.repeat(first, size + 1), n)

    def _sums(self, dst: np.ndarray, weight: np.ndarray, origin: np.ndarray, n: int) -> None:
        """Log sums of all ways to each node, level by level, then each edge's share of its node's."""
        reach = np.zeros(n + 1)
        local = dst - origin[self.src]
        order = np.argsort(local, kind="stable")  # within a level still by end node
        cuts = np.flatnonzero(np.diff(local[order])) + 1
        for own in np.split(order, cuts):
            x = reach[self.src[own]] + weight[own]
            heads = np.flatnonzero(np.concatenate(([True], dst[own][1:] != dst[own][:-1])))
            top = np.maximum.reduceat(x, heads)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(heads, len(x))))), heads)
            reach[dst[own][heads]] = top + np.log(total)
        share = np.exp(reach[self.src] + weight - reach[dst])
        run = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        count = np.diff(np.append(heads, len(dst)))
        run -= np.repeat(np.concatenate(([0.0], run[heads[1:] - 1])), count)
        run[np.append(heads[1:] - 1, len(dst) - 1)] = 1.0  # the last edge of a node takes what is left
        self.key = dst + np.minimum(run, 1.0)
        self.dst = dst

    def draw(self, chunk: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, edge) of all drawn pieces, occurrences in order and pieces from the left."""
        node, origin = self.end[chunk].copy(), self.start[chunk]
        live = np.arange(len(chunk))
        who, edge, step = [], [], []
        t = 0
        while len(live):
            u = (mix64(seed[live] + np.uint64(t) * _KEYS[2]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = np.searchsorted(self.key, node[live] + u, "right")
            e = np.minimum(e, len(self.key) - 1)
            wrong = np.flatnonzero(self.dst[e] != node[live])  # rounding at a node's border
            if len(wrong):
                e[wrong] = np.searchsorted(self.dst, node[live[wrong]], "right") - 1
            who.append(live)
            edge.append(e)
            step.append(np.full(len(live), -t, np.int32))
            node[live] = self.src[e]
            live = live[node[live] > origin[live]]
            t += 1
        who, edge, step = map(np.concatenate, (who, edge, step))
        order = np.lexsort((step, who))
        return who[order], edge[order]


def sample_block(texts: list[str], keys: list[int], v: Pieces, seed: int) -> list[np.ndarray]:
    """The sampled ids of each text."""
    index: dict[str, int] = {}
    occurrence: list[int] = []
    counts = []
    for t in texts:
        own = t.split(" ") if t else []
        counts.append(len(own))
        occurrence += [index[c] if c in index else index.setdefault(c, len(index)) for c in own]
    if not occurrence:
        return [np.zeros(0, np.int64) for _ in texts]
    lat = Lattice(list(index), v)
    chunk = np.array(occurrence)
    begin = np.cumsum([0, *counts])
    doc = np.repeat(np.arange(len(texts)), counts)
    key = (np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) + np.uint64(1)) * _KEYS[0] + np.uint64(seed)
    base = mix64(mix64(key)[doc] + (np.arange(len(chunk)) - begin[doc]).astype(np.uint64) * _KEYS[1])
    who, edge = lat.draw(chunk, base)
    ids = lat.pid[edge]
    wide = np.flatnonzero(ids < 0)
    number = np.ones(len(ids), np.int64)
    if len(wide):
        kinds, which = np.unique(ids[wide], return_inverse=True)
        lens = np.array([len(lat.bytes_of[-k - 1]) for k in kinds.tolist()])
        number[wide] = lens[which]
    place = np.cumsum(number) - number
    out = np.repeat(ids, number)
    for j, k in enumerate(kinds.tolist() if len(wide) else []):
        spots = place[wide[which == j]]
        for b, i in enumerate(lat.bytes_of[-k - 1]):
            out[spots + b] = i
    ends = np.searchsorted(who, begin[1:])
    ends = np.append(place, len(out))[ends]
    return np.split(out, ends[:-1])


def decode(ids: Sequence[int], v: Pieces) -> str:
    """The text that the ids came from."""
    return b"".join(map(v.decoded.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def decode_pieces(table: DataFrame, key: str = "doc_id", ids_col: str = "ids", text_col: str = "text", model: str | None = None) -> DataFrame:
    """key and the text that the row's ids stand for: what ``sample_pieces`` cut comes back exactly. Null ids give a
    null text, no ids an empty one; a null or an id outside the vocabulary makes the row's text null, and bytes that aren't
    UTF-8 become U+FFFD. Repeated rows decode alike; other columns aren't read."""
    path = model or vocabulary_path()
    src = table.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{ids_col}`").cast("array<long>").alias("__ids"))
    schema = T.StructType([T.StructField(key, src.schema["__key"].dataType), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, THETA)
        for batch in slices(batches, BATCH):
            texts = []
            for ids in batch.column("__ids").to_pylist():
                known = ids is not None and all(i is not None and 0 <= i < len(v.decoded) for i in ids)
                texts.append(b"".join(map(v.decoded.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace") if known else None)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string())], names=[key, text_col])

    return src.mapInArrow(run, schema)


def sample_pieces(docs: DataFrame, key: str = "doc_id", text_col: str = "text", seed: int = SEED, theta: float = THETA, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """key with n_pieces, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), text_crc32 (of
    the decoded text's UTF-8) and lossless; with ``with_ids`` also the ids."""
    path = model or vocabulary_path()
    src = docs.select(F.col(f"`{key}`").alias(key), F.concat_ws("\0", F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).cast("string"), F.col(f"`{text_col}`").cast("string")).alias("t"), F.col(f"`{text_col}`").isNull().alias("no"))
    src = src.select(key, F.when(~F.col("no"), F.col("t")).alias("keyed"))

    def per_batch(texts: list) -> dict:
        v = pieces(path, theta)
        made: dict = {k: [None] * len(texts) for k in ("n_pieces", "ids_crc32", "text_crc32", "lossless", "ids")}
        full = [i for i, t in enumerate(texts) if t is not None]
        parts = [texts[i].split("\0", 1) for i in full]
        keys, plain = [int(p[0]) for p in parts], [p[1] for p in parts]
        with np.errstate(over="ignore"):
            for lo, hi in blocks_of(plain, 1 << 22):
                for i, t, ids in zip(full[lo:hi], plain[lo:hi], sample_block(plain[lo:hi], keys[lo:hi], v, seed), strict=True):
                    got = b"".join(map(v.decoded.__getitem__, ids.tolist()))[1:]
                    made["n_pieces"][i] = len(ids)
                    made["ids_crc32"][i] = zlib.crc32(ids.astype("<u4").tobytes())
                    made["text_crc32"][i] = zlib.crc32(got)
                    made["lossless"][i] = got == t.encode("utf-8", "surrogatepass")
                    if with_ids:
                        made["ids"][i] = ids.tolist()
        return made

    fields = [long("n_pieces"), long("ids_crc32"), long("text_crc32"), boolean("lossless")] + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    return map_text(src, "keyed", [key], fields, per_batch, BATCH)
