"""SimHash near-dedup (operator 5): 64-bit fingerprints of 3-word shingles, linked at a Hamming distance of 2 or less.

Candidates come from a generalised pigeonhole: bits that go together are grouped into parts of 16; thresholds t_i with
sum = limit - parts + 1 leave no pair out, since a pair beyond all of them would differ in more than `limit` bits. A
dynamic program picks the thresholds from histograms of the parts' values (at most 2^16 counts a part). A part with
threshold -1 is not looked at. Values that too many fingerprints share are split by two further pigeonholes over the
other bits, after which at most 2^21 different fingerprints can be in one group.

Null and empty texts have fingerprint zero, and link like any other; one or two words are one shingle; rows that repeat
a doc_id are judged each by its text; a null doc_id stays null. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEED, LIMIT = 42, 2
PARTS, WIDTH = 4, 16
CROWDED = 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def majorities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each text by the hashes of its shingles, repeats included; at: where each text's begin, and the end."""
    ones = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at[:-1], axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(at)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id (null as the smallest long), fp long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in b.column("text").cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return C.mapped(src, run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(together: np.ndarray, n: int) -> list[list[int]]:
    """Bits in groups of WIDTH, each grown by the bit that goes with it most. together: how often two bits are both set."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(64)), []
    while left:
        rest = sorted(left)
        first = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        part = [first]
        left.remove(first)
        while len(part) < WIDTH:
            b = max(sorted(left), key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            left.remove(b)
        parts.append(sorted(part))
    return parts


def gather(bits: np.ndarray, part: list[int]) -> np.ndarray:
    """The value of some bits."""
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to `radius` of `width` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def thresholds(histograms: list[np.ndarray], limit: int) -> tuple[list[int], list[np.ndarray]]:
    """Thresholds of least cost with sum limit - parts + 1, and for each part how many rows would land on each value."""
    landing, cost = [], []
    for h in histograms:
        by_radius, costs, near = {-1: np.zeros_like(h)}, {-1: 0.0}, h.copy()
        done = 1
        for radius in range(limit + 1):
            masks = ball(WIDTH, radius)
            for m in masks[done:]:
                near = near + h[np.arange(len(h)) ^ m]
            done = len(masks)
            by_radius[radius] = near
            costs[radius] = float((h.astype(float) * near).sum()) + float(len(masks)) * h.sum()
        landing.append(by_radius)
        cost.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, chosen) in best.items():
            for t, x in c.items():
                if total + t not in new or so_far + x < new[total + t][0]:
                    new[total + t] = (so_far + x, [*chosen, t])
        best = new
    chosen = best[limit - len(histograms) + 1][1]
    return chosen, [landing[i][t] for i, t in enumerate(chosen)]


def split_rest(bits: np.ndarray, rest: list[int]) -> list[tuple[np.ndarray, list[int]]]:
    """A pigeonhole for distance 2: three shares of the bits, of which close pairs have one in common."""
    third = -(-len(rest) // 3)
    shares = [rest[i * third : (i + 1) * third] for i in range(3)]
    return [(gather(bits, s), [b for b in rest if b not in s]) for s in shares]


def probe(parts: list[list[int]], chosen: list[int], landing: list[np.ndarray]):
    """Fingerprints to (key, fp): pairs at distance 2 or less share a key."""
    crowded = [np.packbits(x > CROWDED) for x in landing]

    def run(batches):
        full = [np.unpackbits(c) for c in crowded]
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            bits = bits_of(fps)
            keys, rows = [], []
            for i, (part, t) in enumerate(zip(parts, chosen, strict=True)):
                if t < 0:
                    continue
                value = gather(bits, part)
                for m in ball(WIDTH, t):
                    v = value ^ m
                    dense = full[i][v] > 0
                    keys.append((np.int64(i) << 60 | v << 1)[~dense])
                    rows.append(fps[~dense])
                    if dense.any():
                        some, own = bits[dense], (np.int64(i) << 60) | (v[dense] << 1) | 1
                        for j, (x, rest) in enumerate(split_rest(some, [k for k in range(64) if k not in part])):
                            for j2, (y, _) in enumerate(split_rest(some, rest)):
                                keys.append(own | np.int64(j) << 58 | np.int64(j2) << 56 | x << 40 | y << 20)
                                rows.append(fps[dense])
            k, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, rows))
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(r[i : i + 100_000])], ["key", "fp"])

    return run


def close_pairs(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within `limit` bits. fps: different values of one group."""
    n = len(fps)
    us, vs = [], []
    if n <= 3000:
        for i in range(n - 1):
            j = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= limit)
            us.append(np.full(len(j), i))
            vs.append(j + i + 1)
    else:
        # Only bits in which members differ can differ in a pair.
        spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
        live = [b for b in range(64) if spread >> b & 1]
        order = np.argsort(fps)
        ranked = fps[order]
        for c in (c for r in range(1, limit + 1) for c in combinations(live, r)):
            want = fps ^ np.uint64(sum(1 << b for b in c))
            at = np.minimum(np.searchsorted(ranked, want), n - 1)
            hit = np.flatnonzero(ranked[at] == want)
            us.append(hit)
            vs.append(order[at[hit]])
    return np.concatenate(us) if us else np.zeros(0, np.int64), np.concatenate(vs) if vs else np.zeros(0, np.int64)


def verify(batches):
    """(key, fp), sorted by key within the partition, to links between fingerprints; one forest for each stretch of rows."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(k, f):
        new = np.append(True, k[1:] != k[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(k)))
        u, v = [], []
        group = np.cumsum(new) - 1
        small = size[group] <= 64
        for d in range(1, int(min(64, size.max(initial=1)))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if not len(i):
                break
            close = np.bitwise_count(f[i].view(np.uint64) ^ f[i + d].view(np.uint64)) <= LIMIT
            u.append(i[close])
            v.append(i[close] + d)
        for g in np.flatnonzero(size > 64):
            own = np.unique(f[start[g] : start[g] + size[g]])
            a, b = close_pairs(own.view(np.uint64), LIMIT)
            low = C.local_components(a, b, len(own))
            child = np.flatnonzero(low != np.arange(len(own)))
            yield own[child], own[low[child]]
        if u:
            yield f[np.concatenate(u)], f[np.concatenate(v)]

    def send(k, f):
        for a, b in links(k, f):
            m = a != b
            if m.any():
                ids, back = np.unique(np.stack([a[m], b[m]]), return_inverse=True)
                back = back.reshape(2, -1)
                low = C.local_components(back[0], back[1], len(ids))
                child = np.flatnonzero(low != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[low[child]])], ["u", "v"])

    for b in batches:
        k = np.concatenate([rest_k, b.column("key").to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, b.column("fp").to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        whole = int(np.searchsorted(k, k[-1]))
        if whole and whole > 200_000:
            yield from send(k[:whole], f[:whole])
            k, f = k[whole:], f[whole:]
        rest_k, rest_f = k, f
    if len(rest_k):
        yield from send(rest_k, rest_f)


def linked(each: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(u, v): v is the least fingerprint of the class of u, for those that are not the least. each: different fingerprints fp, stored."""
    n = C.partitions(scratch.spark)

    def together(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = bits_of(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], ["at", "n"])

    counts = C.mapped(each, together, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    matrix = np.zeros(4096)
    for at, x in counts:
        matrix[at] = x
    parts = correlated_parts(matrix.reshape(64, 64), each.count())

    def histogram(batches):
        total = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            bits = bits_of(b.column("fp").to_numpy(zero_copy_only=False))
            for i, part in enumerate(parts):
                total[i] += np.bincount(gather(bits, part), minlength=1 << WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "n"])

    # At most PARTS * 2^WIDTH rows come to the driver, however many documents there are.
    flat = np.zeros(PARTS << WIDTH, np.int64)
    found = C.mapped(each, histogram, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat[found.column("at").to_numpy()] = found.column("n").to_numpy()
    chosen, landing = thresholds(list(flat.reshape(PARTS, -1)), LIMIT)
    probes = C.mapped(each.select("fp"), probe(parts, chosen, landing), "key long, fp long")
    edges = C.mapped(probes.repartition(n, "key").sortWithinPartitions("key"), verify, "u long, v long")
    return C.components(edges, scratch)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, for each row of docs."""
    scratch = C.Scratch(docs.sparkSession, "simhash")
    own = scratch.store(fingerprints(docs), "fingerprints")
    each = scratch.store(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    low = linked(each, scratch)
    rooted = each.join(low, each.fp == low.u, "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.store(rooted.join(least, "root").select("fp", "component_id"), "named")
    null = F.lit(C.NULL_ID)
    return own.join(named, "fp").select(
        F.nullif("doc_id", null).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component_id", null).alias("component_id")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
