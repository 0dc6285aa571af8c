"""What the operators share: tables in the shared folder, byte and word arrays, distributed components.

Conventions of every operator: columns are taken by name, so extra columns do no harm; a null text counts as
empty; a null doc_id sorts before all others and comes back as null; rows that repeat an id with the same text
give equal results on each row.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: While a table is stored, shuffle files go as soon as it stands, not when the driver happens to collect its garbage, and
#: rows go to Python workers in batches that stay small where rows are whole texts.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: On a shared folder that is mounted as files, no checksum file and no chmod process for each file. Other stores don't read these.
MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own, which only local masters may use."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "local")
    return _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="attesta-"))


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame, name: str = "t", few: bool = False) -> DataFrame:
        """few: a table that is small beside the input, written as a quarter of the files."""
        self.n += 1
        if few:
            df = df.coalesce(max(1, partitions(self.spark) // 4))
        path = f"{self.root}/{self.n:03d}-{name}"
        before = {k: self.spark.conf.get(k, None) for k in STORING}
        for k, v in STORING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.options(compression="zstd", **MOUNTED).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._attesta_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stored table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._attesta_path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that have gone."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Return memory that has been freed to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the n + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33, S29 = np.uint64(33), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> S33)
    x *= M1
    x ^= x >> S29
    x *= M2
    x ^= x >> S33
    return x


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
#: \x20 and \x09-\x0D, the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, cuts: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, which never cross the offsets `cuts`; and for each offset the words before it."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(breaks[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    first[at] = inside[1:-1][at]
    last[at - 1] = inside[1:-1][at - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, cuts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    inner = np.arange(total) - np.repeat(first, lens)
    where = np.repeat(starts, lens) + inner
    sums = np.add.reduceat(BYTE_CODES[data[where]] * _POWERS[inner & 4095], first)
    return mix(sums + lens.astype(np.uint64))


def chunks(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def local_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For edges between 0..n-1, the smallest number of each component."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        m = a != b
        if not m.any():
            break
        u, v, a, b = u[m], v[m], a[m], b[m]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition become stars of their components: fewer edges, the same reachability."""
    flush = 1_000_000
    held: list[np.ndarray] = []
    size = 0

    def stars() -> pa.RecordBatch:
        e = np.concatenate(held, axis=1)
        ids, back = np.unique(e.ravel(), return_inverse=True)
        back = back.reshape(2, -1)
        low = local_components(back[0], back[1], len(ids))
        child = np.flatnonzero(low != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[low[child]])], ["u", "v"])

    for b in batches:
        held.append(np.stack([b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)]))
        size += b.num_rows
        if size >= flush:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) edges of longs to (u, v): v is the smallest id reachable from u, for each u that is not itself the smallest.

    Alternates large-star and small-star steps, each an aggregation by node (partial sums first, so a node with very
    many edges is no single task's work) and a join that AQE may split. Two rounds of steps are one table in the shared
    folder. They end when all edges are stars: each node has one edge, to a node that has none itself.
    """
    spark = scratch.spark

    def round_of(now: DataFrame) -> DataFrame:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        near = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(near, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return small.where("u <> v").distinct()

    now = scratch.store(mapped(edges.select("u", "v"), _contract, "u long, v long"), "edges")
    while True:
        new = scratch.store(round_of(round_of(now)), "stars", few=True)
        scratch.drop(now)
        now = new
        many = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        chained = now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if not many.select("u").unionByName(chained).limit(1).count():
            return now
