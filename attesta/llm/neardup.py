"""Near duplicates among documents by their words: texts linked at a Jaccard similarity of SIMILARITY or more.

Words are what stands between white space, ASCII letters taken as small ones, as in simhash.py; a text is the set of its
shingles of WORDS words, by 64-bit hashes (one with fewer words is one shingle, and all texts without words are equal).
Candidates come from SimHash: fingerprints of those shingles that operator 5's search links, all pairs at 2 or fewer bits
among them. At 0.8 two fingerprints lie about ten bits apart, which no such search reaches, so the pairs beyond its limit come
from a second source: texts that share one of BANDS bands of ROWS minimal hashes (a pair at 0.8 is found with 99.98 %).
Candidates of both are verified on their sets.

The texts of a SimHash class, or that share a band, are a group, which groups.py compares: every pair of a group is compared exactly, turned away by
a bound, or in one class without it. Texts with equal words are one node.

Null texts count as empty; rows that repeat a doc_id are judged each by its text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash
from .groups import Asked, similar_links

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Stands for the words that a short text lacks.
FILL = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = C.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_ADD, _ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32), (_SEEDS.astype(np.uint32) | np.uint32(1))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle, repeated ones too, of the texts between offs; and where each text's begin, and the end."""
    data = LOWER[data]
    starts, ends, before = C.word_spans(data, offs)
    lens = np.diff(before)
    filled = np.maximum(lens, words)
    w = np.full(int(filled.sum()), FILL)
    first = np.cumsum(filled) - filled
    w[np.repeat(first - before[:-1], lens) + np.arange(len(starts))] = C.span_hashes(data, starts, ends)
    n = max(0, len(w) - words + 1)
    h = w[:n].copy()
    for k in range(1, words):
        h = C.mix(h * FILL + w[k : n + k])
    # The last words - 1 places of a text start no shingle of it.
    inside = np.arange(n) + words <= np.repeat(first + filled, filled)[:n]
    return h[inside], np.append(0, np.cumsum(filled - words + 1))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)[0])


def band_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys for each text, as many rows as texts."""
    h = (h >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(h)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            np.multiply(h, _ODD[r], out=x)
            x += _ADD[r]
            key = C.mix(key * FILL + np.minimum.reduceat(x, starts))
        keys[:, b] = key
    return keys


def name_of(text: bytes) -> int:
    """A signed 64-bit name of a text's words."""
    x = xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))
    return x - (1 << 64) if x >> 63 else x


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id (null as the smallest long), rk, name, keys of bands and SimHash fingerprint of each row."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            names = pa.array([name_of(t.as_buffer().to_pybytes()) for t in texts], pa.int64())
            data, offs = C.buffers(texts)
            for i, j in C.chunks(offs, 1 << 18):
                h, at = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                keys = band_keys(h, at[:-1]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                fps = pa.array(simhash.majorities(h, at).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("rk")[i:j], names[i:j], lists, fps], ["doc_id", "rk", "name", "keys", "fp"])

    return C.mapped(docs, run, "doc_id long, rk long, name long, keys array<long>, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, rk (a hash of the text), component_id and component_rk (the smallest of the group), for each row of docs."""
    scratch = C.Scratch(docs.sparkSession, "neardup")
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", text_key())
    own = scratch.store(signed(src, words), "signed")
    low = link(src, own, words, similarity, scratch)
    classed = own.join(low, own.name == low.u, "left").select("doc_id", "rk", F.coalesce("v", "name").alias("class"))
    least = classed.groupBy("class").agg(F.min(F.struct("doc_id", "rk")).alias("first"))
    null = F.lit(C.NULL_ID)
    return classed.join(least, "class").select(F.nullif("doc_id", null).alias("doc_id"), "rk", F.nullif("first.doc_id", null).alias("component_id"), F.col("first.rk").alias("component_rk"))


def link(src: DataFrame, own: DataFrame, words: int, similarity: float, scratch: C.Scratch) -> DataFrame:
    """(u, v): v is the least name of the class of text u, for texts that are not the least themselves."""
    n = C.partitions(scratch.spark)
    # Of a family of edited copies the text with most equal copies is the original, to which the others are close.
    each = own.groupBy("name").agg(F.count("*").alias("seen"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    fps = scratch.store(own.select("fp").distinct(), "fingerprints", few=True)
    near = simhash.linked(fps, scratch)
    classes = each.select("name", "seen", "fp").join(near, F.col("fp") == near.u, "left").select("name", "seen", F.coalesce("v", "fp").alias("key"))
    every = scratch.store(each.select("name", "seen", F.explode("keys").alias("key")).unionByName(classes), "keys", few=True)
    # A group is named by its texts, so equal groups of several bands, or of a class and a band, are one.
    crowded = every.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("name")).alias("group")).where("size > 1")
    members = scratch.store(every.join(crowded, "key").groupBy("group", "name").agg(F.max("seen").alias("seen"), F.max("size").alias("size")), "members", few=True)
    asked = members.select("name").distinct()
    known = Asked(asked)

    def names(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            own = np.array([name_of(t.as_buffer().to_pybytes()) for t in texts], np.int64)
            some = pa.array(np.flatnonzero(known.has(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own).take(some), b.column("text").take(some)], ["name", "text"])

    def shingled(texts: list[bytes]):
        return shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), words)

    texts = scratch.store(C.mapped(src.select("text"), names, "name long, text string").join(asked, "name", "left_semi").dropDuplicates(["name"]), "texts", few=True)
    low = C.components(similar_links(members, texts, shingled, similarity, n), scratch)
    for t in (fps, every, members, texts):
        scratch.drop(t)
    return low
