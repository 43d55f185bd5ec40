"""Helpers that the corpus operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TEXT = "__text"
#: Rows of one Arrow batch: with documents of megabytes a batch still fits a Python worker.
BATCH_ROWS = 512
#: Characters of a text that a model is fitted on; texts that it is applied to are read whole.
SAMPLE_CHARS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of at most ``rows`` rows, whatever the session's batch size is."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Where nobody set it, a session on one machine gets a temporary folder; a cluster, whose machines
    share none, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/archivum-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage,
    survives a lost executor and lets later joins start from plain scans."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def map_text(docs: DataFrame, text_col: str, keep: Sequence[str], fields: Sequence[T.StructField], per_batch: Callable[[list], dict], rows: int = BATCH_ROWS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the new ``fields``, which ``per_batch`` makes from the
    list of texts (None for null) of an Arrow batch. New fields win over kept columns of the
    same name (compared without case). A narrow step: rows stay in their partitions."""
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(TEXT))
    schema = T.StructType([src.schema[c] for c in keep] + list(fields))
    kinds = [(f.name, _arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            made = per_batch(batch.column(TEXT).to_pylist())
            arrays = [batch.column(c) for c in keep] + [pa.array(made[n], type=t) for n, t in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[n for n, _ in kinds]])

    return src.mapInArrow(run, schema)


def judged(docs: DataFrame, judge: Callable[[DataFrame, str, list[str]], DataFrame], text_col: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All columns of ``docs`` with those that ``judge(src, text, keep)`` adds, and a function that
    gives the input's columns back. Input columns go under names of their own meanwhile, so none
    can clash with what is added."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    src = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in names.items()])
    return judge(src, names[text_col], list(names.values())), lambda df: df.select(*[F.col(h).alias(c) for c, h in names.items()])


def _arrow(t: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}
    return pa.list_(_arrow(t.elementType)) if isinstance(t, T.ArrayType) else simple[type(t)]


def free_of(spans: Sequence[tuple], base: Sequence[tuple]) -> list[tuple]:
    """Of ``spans`` (start, kind, end) those that overlap none of ``base``, which is sorted by start."""
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    return [m for m in spans if not (k := bisect_left(starts, m[2])) or reach[k - 1] <= m[0]]


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def sample(df: DataFrame, key: str, rows: int, cols: Sequence[str]) -> DataFrame:
    """A bounded sample for a classifier: the ``rows`` rows with the smallest hash of the key,
    the same rows on every run and for every partitioning. The hashes alone are ranked first, so
    that no task meets more than the sample's own rows."""
    ranked = df.select(*[F.col(c) for c in cols], F.xxhash64(F.col(key).cast("string"), F.lit(11)).alias("__rank"))
    last = ranked.select("__rank").orderBy("__rank").limit(rows).agg(F.max("__rank")).first()[0]
    return ranked.where(F.col("__rank") <= F.lit(last).cast("long")).orderBy("__rank", *cols).limit(rows).drop("__rank")


def sample_each(df: DataFrame, key: str, rows: int, cols: Sequence[str], group: str, each: int) -> DataFrame:
    """``sample``, and besides the ``each`` rows with the smallest hash of every value of ``group``
    (all rows of a value that has fewer). Hashes are ranked first here too; one number a value
    comes to the driver."""
    common = {r[0]: r[1] for r in sample(df, key, rows, cols).groupBy(group).count().collect()}
    ranked = df.select(*[F.col(c) for c in cols], F.xxhash64(F.col(key).cast("string"), F.lit(11)).alias("__rank"))
    nth = lambda *order: F.row_number().over(Window.partitionBy(group).orderBy("__rank", *order))
    most = max([each, *common.values()])
    hashes = ranked.select(group, "__rank").withColumn("__n", nth()).where(F.col("__n") <= most)
    quota = df.sparkSession.createDataFrame([(g, max(each, n)) for g, n in common.items()], f"{group} {df.schema[group].dataType.simpleString()}, __quota int")
    last = hashes.join(F.broadcast(quota), group, "left").where(F.col("__n") <= F.coalesce("__quota", F.lit(each))).groupBy(group).agg(F.max("__rank"), F.max(F.coalesce("__quota", F.lit(each))))
    bounds = df.sparkSession.createDataFrame([tuple(r) for r in last.collect()], f"{group} {df.schema[group].dataType.simpleString()}, __last long, __quota int")
    kept = ranked.join(F.broadcast(bounds), group).where(F.col("__rank") <= F.col("__last"))
    return kept.withColumn("__n", nth(*cols)).where((F.col("__n") <= most) & (F.col("__n") <= F.col("__quota"))).select(*cols)


def trained(df: DataFrame, key: str, rows: int, cols: Sequence[str], fit: Callable[[list[dict]], object], group: str | None = None, each: int = 0) -> object:
    """What ``fit`` makes of the sample (with a ``group``, of ``sample_each``). It runs in one task,
    as the sample is small by its bound and a task has a core of its own, which the driver may not
    have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))], pa.binary())], names=["model"])

    drawn = sample(df, key, rows, cols) if group is None else sample_each(df, key, rows, cols, group, each).coalesce(1)
    made = drawn.mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else fit([])


# --- byte-wise hashing of words, vectorised over a block of texts -----------------------------
#: Fixed odd multipliers.
_P, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in (("p", _P), ("i", inv)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow["p"][:n], _pow["i"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in bytes) of the words ``[^\\x20\\x09-\\x0D]+``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[a], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def hashed_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    p, inv = _powers(len(a) + 1)
    h = np.empty(len(a) + 1, np.uint64)
    h[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=h[1:])
    return mix64((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, start and end (in bytes) of the words of ``data``."""
    a = np.frombuffer(data, np.uint8)
    start, end = word_spans(a)
    return hashed_spans(a, start, end), start, end


def blocks_of(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes (a longer text stands alone)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
