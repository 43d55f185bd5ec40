"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample: ``PER_CELL`` rows
for each of as many cells as the square root of the number of rows, but at least ``SAMPLE_ROWS`` and at most
``MOST_ROWS`` rows, so that there are 4,096 cells at most. More than ``FLAT`` centroids are fitted in two levels: first their
square root, then each of those regions by itself, with a share of the cells that goes by its rows. Every vector is
indexed: nearest centroid and one byte a subspace. A query visits the cells with the largest inner products: as many as the sample's own
rows, asked as queries, need to find ``TARGET`` of their k nearest in the sample. So clustered
vectors are searched in few cells, and vectors without structure in most.

In a cell, tables of a query's inner products with all codewords score every row (asymmetric
distances), and the best ``shortlist`` of a block are scored exactly in double precision. A row's
quantisation error, whose norm stands with its codes, says how much its score can exceed its guess:
every other row of the block that can still reach the k-th of those scores is scored exactly too.
So a block's k best are exact, also where guesses tie in a cluster of near copies.
What can't is known from the sample's first ``SAMPLE_ROWS`` rows: 2 k of them score no less than the bound. A query for
which that finds fewer than k rows searches all other cells too, without the bound: together they
hold those 2 k rows, or all rows where the sample has fewer.

Cells are cut into blocks of about ``block`` rows and their queries into blocks too, so that a
cell that holds a third of all rows is many small groups. Largest inner product is nearest, ties
go to the smaller id.

Vectors that are null, empty, zero, of another length than the index, or hold null or non-finite
components take no part, nor do rows with a null id. Repeated rows (id and vector) count once; a
query never finds its own id. With fewer candidates than k all found are returned; empty tables
give empty results. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import slices, trained, written

K, SAMPLE_ROWS, MOST_ROWS, SUBSPACES, CODES = 20, 8192, 1 << 17, 8, 256
TARGET, TRIED, PER_CELL, FLAT = 0.95, 512, 32, 256
#: Distances that are held at a time.
HELD = 1 << 22
SHORTLIST, BLOCK, TOGETHER = 96, 2048, 64


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and its squared distance."""
    near, far, norms = np.empty(len(x), np.int64), np.empty(len(x)), (c**2).sum(1)
    for lo in range(0, len(x), step := max(1, HELD // len(c))):
        own = x[lo : lo + step]
        d = norms - 2 * own @ c.T
        near[lo : lo + step] = first = d.argmin(1)
        far[lo : lo + step] = d[np.arange(len(own)), first] + (own**2).sum(1)
    return near, far


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, worst = closest(x, c)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = size > 0
        c[full] = sums[full] / size[full, None]
        far = np.argsort(-worst)
        c[~full] = x[far[: (~full).sum()]]
    return c


def coarse(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids, of more than ``FLAT`` in two levels."""
    if k <= FLAT:
        return k_means(x, k, 10, 1)
    near = closest(x, k_means(x, round(k**0.5), 10, 1))[0]
    sizes = np.bincount(near)
    ends = np.round(np.cumsum(sizes) * (k / len(x))).astype(np.int64)  # shares that add up to k
    parts = [(x[near == i], max(1, int(n))) for i, n in enumerate(np.diff(ends, prepend=0)) if sizes[i]]
    return np.concatenate([k_means(own, min(n, len(own)), 10, 1) for own, n in parts])


class Index:
    """Centroids (cells x dims), codebooks (subspaces x codes x dims of one) and the sample."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int, k: int) -> None:
        self.ids, self.sample, self.dims = ids[:SAMPLE_ROWS], x[:SAMPLE_ROWS], x.shape[1]  # those that queries are held against
        self.centroids = coarse(x, int(np.clip(round(rows**0.5), 1, max(1, len(x) // PER_CELL))))
        cell = self.cell_of(x)
        self.probes = self.needed(ids, x, cell, k)
        rest = self.split(x - self.centroids[cell])
        self.books = np.stack([k_means(rest[:, m], min(CODES, len(x)), 6, 2 + m) for m in range(SUBSPACES)])

    def needed(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int) -> int:
        """The cells that rows of the sample must visit to find ``TARGET`` of their k nearest."""
        at = []
        for lo in range(0, min(TRIED, len(x)), 64):
            q, own = x[lo : min(lo + 64, TRIED)], ids[lo : min(lo + 64, TRIED)]
            s = q @ x.T
            s[own[:, None] == ids[None, :]] = -np.inf
            near = np.argpartition(-s, min(k, s.shape[1] - 1), 1)[:, :k]
            place = np.argsort(self.visits(q), 1)  # of every cell in a query's order
            at.append(np.take_along_axis(place, cell[near], 1).ravel())
        at = np.sort(np.concatenate(at))
        return int(at[min(len(at) - 1, int(np.ceil(TARGET * len(at))))]) + 1

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces, with zeros behind where the dimensions don't divide."""
        width = -(-self.dims // SUBSPACES)
        out = np.zeros((len(x), SUBSPACES * width))
        out[:, : self.dims] = x
        return out.reshape(len(x), SUBSPACES, width)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return closest(x, self.centroids)[0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and the norms of what the codes leave of the residuals."""
        cell = self.cell_of(x)
        rest = self.split(x - self.centroids[cell])
        codes = np.empty((len(x), SUBSPACES), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = ((book**2).sum(1) - 2 * rest[:, m] @ book.T).argmin(1)
            rest[:, m] -= book[codes[:, m]]
        return cell, codes, np.sqrt((rest**2).sum((1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x subspaces x codes: inner products with the codewords."""
        return np.einsum("qmw,mcw->qmc", self.split(q), self.books)

    def visits(self, q: np.ndarray) -> np.ndarray:
        """All cells of each query, the best first; it visits ``probes`` of them."""
        return np.argsort(-(q @ self.centroids.T), 1, kind="stable")

    def bounds(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """For each query its k-th best score among the sample: at least k rows aren't below it."""
        s = q @ self.sample.T
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        return -np.partition(-s, k - 1, 1)[:, k - 1] if s.shape[1] >= k else np.full(len(q), -np.inf)


def fitted(rows: list[dict], total: int, k: int) -> Index | None:
    """The index of a sample of ``total`` rows; vectors of its commonest length (the longer of two) count."""
    if not rows:
        return None
    lengths = Counter(len(r["v"]) for r in rows)
    dims = max(lengths, key=lambda n: (lengths[n], n))
    rows = [r for r in rows if len(r["v"]) == dims]
    return Index(np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows]), total, k)


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector_col: str = "embedding", sample_rows: int | None = None, block: int = BLOCK, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows where ``is_query`` (a
    condition on the column ``id``). ``sample_rows``: another size of the sample."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    total, ids = rows.agg(F.count("id"), F.count_distinct("id")).first()
    if ids < total:  # only then can a row be repeated
        rows = rows.dropDuplicates(["id", "v"])
    out_type = "query_id long, rank int, vec_id long, score double"
    sample_rows = sample_rows or int(np.clip(PER_CELL * round(total**0.5), SAMPLE_ROWS, MOST_ROWS))
    index = trained(rows, "id", sample_rows, ["id", "v"], lambda got: fitted(got, total, k))
    if index is None:
        return spark.createDataFrame([], out_type)
    dims = index.dims
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, block):
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(-1, dims)
                cell, codes, err = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], names=["id", "cell", "codes", "err", "v"])

    indexed = written(rows.where(F.size("v") == dims).mapInArrow(encode, "id long, cell long, codes binary, err double, v binary"))

    def visit(rest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The cells that a query visits, or the rest of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 256):
                if batch.num_rows:
                    q, ids, ix = _matrix(batch.column("v"), dims), batch.column("id").to_numpy(), shared.value
                    cells = ix.visits(q)[:, ix.probes :] if rest else ix.visits(q)[:, : ix.probes]
                    low = np.full(len(q), -np.inf) if rest else ix.bounds(ids, q, 2 * k)
                    n = cells.shape[1]
                    again = np.repeat(np.arange(len(q)), n)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(again)), pa.array(cells.ravel()), batch.column("v").take(pa.array(again)), pa.array(np.repeat(low, n))], names=["id", "cell", "v", "low"])

        return run

    # cells are few (PER_CELL rows of the sample each): their numbers of rows and of queries say into how many blocks they go
    cuts = lambda df: {r["cell"]: -(-r["count"] // block) for r in df.groupBy("cell").count().collect()}
    d_cuts = cuts(indexed)
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")

    def search(key: tuple, data: pa.Table, asks: pa.Table) -> pa.Table:
        got: tuple[list, list, list] = ([], [], [])
        if data.num_rows and asks.num_rows:
            ix = shared.value
            ids, x = data["id"].to_numpy(), _matrix(data["v"], dims)
            order = np.argsort(ids, kind="stable")
            ids, x, err = ids[order], x[order], data["err"].to_numpy()[order]
            codes = np.frombuffer(b"".join(data["codes"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)[order].astype(np.int64)
            qx, low, qid = _matrix(asks["v"], dims), asks["low"].to_numpy(), asks["id"].to_numpy()
            tables, middle, norm = ix.tables(qx), qx @ ix.centroids[key[0]], np.sqrt((qx**2).sum(1))
            slack = 1e-9 * np.maximum(1, norm * np.sqrt((x**2).sum(1).max()))
            guesses = np.zeros((0, 0))
            for i in range(len(qid)):
                own = ids == qid[i]
                best = np.arange(len(ids))
                if len(ids) > shortlist:
                    if i % TOGETHER == 0:
                        part = tables[i : i + TOGETHER]
                        guesses = sum((part[:, m, codes[:, m]] for m in range(SUBSPACES)), middle[i : i + TOGETHER, None])
                    guess = guesses[i % TOGETHER]
                    short = np.argpartition(-guess, shortlist)[:shortlist]
                    exact = np.sort(np.einsum("nd,d->n", x[short], qx[i])[~own[short]])
                    reach = max(low[i], exact[-k]) if len(exact) >= k else low[i]
                    best = np.flatnonzero(~(guess + norm[i] * err < reach - slack[i]))
                exact = np.einsum("nd,d->n", x[best], qx[i])
                good = (exact >= low[i] - slack[i]) & ~own[best]
                best, exact = best[good], exact[good]
                first = np.lexsort((ids[best], -exact))[:k]
                got[0].extend([qid[i]] * len(first))
                got[1].extend(ids[best[first]].tolist())
                got[2].extend(exact[first].tolist())
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    def found(asked: DataFrame, rest: bool) -> DataFrame:
        queries = asked.mapInArrow(visit(rest), "id long, cell long, v binary, low double")
        q_cuts = cuts(queries.select("cell"))
        size = spark.createDataFrame([(c, d, q_cuts.get(c, 0)) for c, d in d_cuts.items()], "cell long, nd int, nq int")
        d = indexed.join(F.broadcast(size), "cell").where("nq > 0").select("cell", part("nd", 1).alias("db"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "id", "codes", "err", "v")
        q = queries.join(F.broadcast(size), "cell").where("nq > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), part("nq", 2).alias("qb"), "id", "v", "low")
        by = ["cell", "db", "qb"]
        return d.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(search, T._parse_datatype_string("query_id long, vec_id long, score double"))

    def ranked(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = indexed.where(is_query).select("id", "v")
    first = written(ranked(found(asked, False)))
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(enough, "id", "left_anti")
    if short.isEmpty():
        return first
    return ranked(first.drop("rank").unionByName(found(short, True)))
