"""Token-ID output (operator 6): token files with one zstandard dictionary for all.

A token file is: the magic `TOKZ`, a format version, the width of an id in bytes (2 or 4), the number of documents, the
first 16 bytes of the SHA-256 of the dictionary; then the offset index, three 64-bit integers for each document (doc_id,
number of ids, end of its frame); then the frames, each a document's ids compressed on its own with the dictionary. All
integers are little-endian. A document is read by one seek to its index entry and one to its frame.

Files come in ascending order of doc_id (a null id first; equal ids by a hash of the text), with about FILE_BYTES of frames
each. Tasks write them to a folder that all executors share (any that pyarrow.fs reaches) under a name of their own first and
then move them, so a task that runs again leaves one file. A Parquet table lists them with their first and last doc_id, and
`documents` opens a document by it. The width is 2 if all ids of the vocabulary fit, else 4. `end_id` follows every document.
Null texts are empty; rows that repeat a doc_id are documents each; an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .lines import keyed
from .tokens import DEFAULT, encoder

HEAD = struct.Struct("<4sHHQ16s")
MAGIC, VERSION = b"TOKZ", 1
FILE_BYTES = 8_000_000
#: The dictionary is trained on this many documents, picked by a hash of the id, of which each gives at most SAMPLE_BYTES.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 1 << 14, 1 << 16, 1


def header(width: int, n: int, dictionary: bytes) -> bytes:
    return HEAD.pack(MAGIC, VERSION, width, n, hashlib.sha256(dictionary).digest()[:16])


class Reader:
    """One token file, from anything with seek and read."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        magic, version, self.width, self.n, digest = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(file.read(self.n * 24), "<i8").reshape(-1, 3)
        self.at = HEAD.size + self.n * 24
        self.unpack = decompressor(dictionary)

    def ids(self, i: int) -> np.ndarray:
        start = int(self.index[i - 1, 2]) if i else 0
        self.file.seek(self.at + start)
        out = np.frombuffer(self.unpack.decompress(self.file.read(int(self.index[i, 2]) - start)), f"<u{self.width}")
        if len(out) != self.index[i, 1]:
            raise ValueError("a frame does not hold what the index says")
        return out


def opened(path: str):
    """File system and path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def put(path: str, data: bytes) -> None:
    store, at = opened(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, at)


def zdict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict(dictionary), write_content_size=True, write_dict_id=False) if dictionary else zstandard.ZstdCompressor(level=LEVEL)


def decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zdict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def width_for(path: str, end_id: int, width: int | None = None) -> int:
    """The bytes that an id takes; an error if that is asked to be too few."""
    need = 2 if max(encoder(path).largest, end_id) < 1 << 16 else 4
    if width is None:
        return need
    if width not in (2, 4) or width < need:
        raise ValueError(f"ids of this vocabulary take {need} bytes")
    return width


def write(docs: DataFrame, end_id: int = 0, path: str = DEFAULT, width: int | None = None, folder: str | None = None, scratch: C.Scratch | None = None) -> tuple[DataFrame, bytes]:
    """The table of files (range, file, n_docs, n_ids, first_id, last_id, path) and the dictionary; both are in `folder` too."""
    spark = docs.sparkSession
    scratch = scratch or C.Scratch(spark, "tokens")
    folder = (folder or f"{scratch.root}/images").replace("file:///", "/").rstrip("/")
    store, place = opened(folder)
    store.create_dir(place, recursive=True)
    n = C.partitions(spark)
    src = keyed(docs)
    width = width_for(path, end_id, width)
    kind = f"<u{width}"

    def sample(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(enc.encode(t) + struct.pack("<I", end_id), "<u4").astype(kind).tobytes()[:SAMPLE_BYTES] for t in b.column("text").to_pylist()], pa.binary())], ["ids"])

    total = docs.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30)) / float(1 << 30)
    few = src.where(rank < min(1.0, SAMPLE_DOCS / max(1, total))).limit(2 * SAMPLE_DOCS).select("text")
    samples = sorted(r.ids for r in C.mapped(few, sample, "ids binary").collect())
    dictionary = train(samples)
    put(f"{folder}/dictionary", dictionary)
    cuts = src.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 and total else []
    bounds = np.unique(np.array(cuts, np.float64))

    def encode(batches):
        enc, pack = encoder(path), compressor(dictionary)
        end = struct.pack("<I", end_id)
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            frames, counts = [], []
            for t in b.column("text").to_pylist():
                x = np.frombuffer(enc.encode(t) + end, "<u4")
                frames.append(pack.compress(x.astype(kind).tobytes()))
                counts.append(len(x))
            at = np.searchsorted(bounds, ids.astype(np.float64), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("doc_id"), b.column("rk"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["range", "doc_id", "rk", "n", "frame"])

    def files(batches):
        state: dict = {"range": None, "file": 0, "rows": [], "size": 0}

        def done():
            if not state["rows"]:
                return
            ids, counts, frames = zip(*state["rows"], strict=True)
            index = np.stack([np.array(ids, np.int64), np.array(counts, np.int64), np.cumsum([len(f) for f in frames])], axis=1).astype("<i8")
            image = header(width, len(ids), dictionary) + index.tobytes() + b"".join(frames)
            at = f"{folder}/{state['range']:06d}-{state['file']:06d}.tokz"
            put(at, image)
            row = [state["range"], state["file"], len(ids), sum(counts), ids[0], ids[-1], at]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string()), strict=True)], ["range", "file", "n_docs", "n_ids", "first_id", "last_id", "path"])
            state["file"] += 1
            state["rows"], state["size"] = [], 0

        for b in batches:
            for r, doc_id, count, frame in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "n", "frame")), strict=True):
                if r != state["range"]:
                    yield from done()
                    state["range"], state["file"] = r, 0
                state["rows"].append((doc_id, count, frame))
                state["size"] += len(frame) + 24
                if state["size"] >= FILE_BYTES:
                    yield from done()
        yield from done()

    framed = C.mapped(src, encode, "range int, doc_id long, rk long, n long, frame binary")
    sorted_ = framed.repartition(n, "range").sortWithinPartitions("range", "doc_id", "rk").drop("rk")
    return scratch.store(C.mapped(sorted_, files, "range int, file int, n_docs long, n_ids long, first_id long, last_id long, path string"), "files"), dictionary


def read(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the files."""
    # One number for each range; ranges are as many as shuffle partitions.
    before, bases = 0, []
    for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect():
        bases.append((r["range"], before))
        before += r.n
    base = files.sparkSession.createDataFrame(bases, "of int, base long")
    inner = F.sum("n_ids").over(Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("range", "file", F.coalesce(inner, F.lit(0)).alias("inner")).join(base, F.col("range") == F.col("of")).select(F.col("range").alias("r"), F.col("file").alias("f"), (F.col("base") + F.col("inner")).alias("start"))
    placed = files.join(starts, (F.col("range") == F.col("r")) & (F.col("file") == F.col("f"))).select("start", "path").repartition(C.partitions(files.sparkSession), "path")

    def run(batches):
        for b in batches:
            for start, path in zip(b.column("start").to_pylist(), b.column("path").to_pylist(), strict=True):
                store, at = opened(path)
                counts, crcs = [], []
                with store.open_input_stream(at) as whole:
                    f = Reader(io.BytesIO(whole.read()), dictionary)
                for i in range(f.n):
                    ids = f.ids(i)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.index[:, 0]), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = C.mapped(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NULL_ID)))


def documents(files: DataFrame, dictionary: bytes, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row with this doc_id: of a file, its index and one frame for each are read."""
    own = C.NULL_ID if doc_id is None else doc_id
    out = []
    for r in files.where((F.col("first_id") <= own) & (F.col("last_id") >= own)).orderBy("range", "file").select("path").collect():
        store, at = opened(r.path)
        with store.open_input_file(at) as f:
            reader = Reader(f, dictionary)
            i, j = (int(np.searchsorted(reader.index[:, 0], own, side)) for side in ("left", "right"))
            out += [reader.ids(k) for k in range(i, j)]
    return out


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(*write(C.table(spark, sf_dir, "documents")))
