"""Best-fit packing (operator 9): documents into as few sequences of `limit` tokens as the lengths allow.

A linear program over the histogram of piece lengths - so much of each configuration of lengths that fits a sequence that
all pieces are covered - is solved by multiplicative weights: each step adds the configuration that is worth most under
the present prices (a knapsack, by dynamic programming over capacities) and lowers the prices of what it covers. Whole
numbers of configurations are used as they are; what rounding leaves over is placed best-fit decreasing, by counts. All
of this is on histograms of at most `limit` numbers; documents are never gathered. Pieces of one length are numbered in
order of (doc_id, hash of the text, piece) within hashed shares of bounded size, and take the places of their length.

A document is its ids and `end_id`. Only longer ones than the limit are cut, into pieces of the limit of which the first
may be shorter. Null texts are empty and make one piece of the end id. Rows that repeat a doc_id are packed one by one.
An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .lines import keyed
from .tokens import DEFAULT, encoder

LIMIT, END_ID = 1024, 2
STEPS, TABLES, SHARPNESS = 5, 20, 1.0


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, path: str = DEFAULT) -> DataFrame:
    """doc_id, rk, piece, start, length, ids_crc32."""

    def run(batches):
        enc = encoder(path)
        end = struct.pack("<I", end_id)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, rk, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rk", "text")), strict=True):
                raw = memoryview(enc.encode(text) + end)
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - at) % limit or limit
                    for to, x in zip(out, (doc_id, rk, piece, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)])), strict=True):
                        to.append(x)
                    at += length
                    piece += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(out)], ["doc_id", "rk", "piece", "start", "length", "ids_crc32"])

    return C.mapped(keyed(docs), run, "doc_id long, rk long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, limit: int) -> np.ndarray:
    """For each capacity, the last length (its place in the ascending `lengths`) of the most valuable filling, or -1 for a token left free."""
    value = np.zeros(limit + 1)
    pick = np.full(limit + 1, -1)
    upto = np.searchsorted(lengths, np.arange(limit + 1), side="right")
    for c in range(1, limit + 1):
        value[c] = value[c - 1]
        k = upto[c]
        if k:
            v = prices[:k] + value[c - lengths[:k]]
            best = int(np.argmax(v))
            if v[best] > value[c]:
                value[c], pick[c] = v[best], best
    return pick


def configurations(counts: dict[int, int], limit: int, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations from the linear program; together they hold no piece twice.

    The program: cover the need of every length with the least total of configurations. After step t of `steps` each
    length should be covered to t / steps, and none to more than (t + 1) / steps; weights (prices per token) fall
    exponentially with the share of this step's need that is covered already. One table of the knapsack prices a
    configuration for each length that is behind - that length, and the best filling of the rest - and a step takes
    several tables, as prices change with what each of them covers.
    """
    lengths = np.array(sorted(counts), np.int64)
    sizes = lengths.tolist()
    need = np.array([counts[x] for x in sizes], np.float64)
    found: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(lengths))
    for t in range(1, steps + 1):
        for _ in range(TABLES):
            room = ((t + 1) / steps - covered) * need
            weight = np.exp(-SHARPNESS * (covered * steps - t + 1).clip(0, 2))
            pick = knapsack(lengths, np.where(room > 1e-9 * need, weight, 0) * lengths, limit).tolist()
            behind = ((t / steps - covered) * need).tolist()
            room = room.tolist()
            for head in range(len(sizes) - 1, -1, -1):
                if behind[head] <= 1e-9:
                    continue
                use, c = [head], limit - sizes[head]
                while c > 0:
                    if pick[c] < 0:
                        c -= 1
                    else:
                        use.append(pick[c])
                        c -= sizes[pick[c]]
                inside = {i: use.count(i) for i in use}
                amount = min(behind[head] / inside[head], *(room[i] / k for i, k in inside.items()))
                if amount <= 1e-9:
                    continue
                key = tuple(sorted(use))
                found[key] = found.get(key, 0.0) + amount
                for i, k in inside.items():
                    behind[i] -= amount * k
                    room[i] -= amount * k
            covered = (t + 1) / steps - np.array(room) / need
    # Scaled so that no length is used more than it is there, then rounded down.
    most = max(1.0, float(covered.max()))
    left = need.astype(np.int64).tolist()
    out = []
    for use, x in sorted(found.items(), key=lambda kv: (-kv[1], kv[0])):
        inside = {i: use.count(i) for i in use}
        n = min(int(x / most + 0.5), *(left[i] // k for i, k in inside.items()))
        if n:
            for i, k in inside.items():
                left[i] -= n * k
            out.append(({sizes[i]: k for i, k in inside.items()}, n))
    return out


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are one entry."""
    groups: list[list] = []  # [room, number, content]
    for length in sorted(counts, reverse=True):
        m = counts[length]
        groups.sort(key=lambda g: g[0])
        new = []
        for g in groups:
            if not m:
                break
            if g[0] < length:
                continue
            fit = g[0] // length
            whole = min(g[1], m // fit)
            for number, k in ((whole, fit), (1 if g[1] > whole and m - whole * fit else 0, m - whole * fit)):
                k = min(k, fit)
                if number and k:
                    new.append([g[0] - k * length, number, g[2] | {length: k}])
                    g[1] -= number
                    m -= number * k
        while m:
            fit = min(limit // length, m)
            number = m // fit
            new.append([limit - fit * length, number, {length: fit}])
            m -= number * fit
        merged: dict[tuple, list] = {}
        for g in [*groups, *new]:
            if g[1]:
                key = tuple(g[2].items())
                if key in merged:
                    merged[key][1] += g[1]
                else:
                    merged[key] = g
        groups = list(merged.values())
    return [(g[2], g[1]) for g in groups]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences have them; together they hold each piece once."""
    if not counts:
        return []
    out = configurations(counts, limit)
    left = dict(counts)
    for use, n in out:
        for length, k in use.items():
            left[length] -= k * n
    left = {length: n for length, n in left.items() if n}
    # Room that configurations leave is filled first, with sequences that best_fit can add to.
    return out + (best_fit(left, limit) if left else [])


def places(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, number of sequences, first sequence and offset of its runs of places."""
    rows: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for use, n in planned:
        offset = 0
        for length, k in use.items():
            rank = seen.get(length, 0)
            rows.setdefault(length, []).append((rank, n, sequence, offset))
            seen[length] = rank + k * n
            offset += k * length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def pack(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, path: str = DEFAULT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "packing")
    n = C.partitions(spark)
    cut = scratch.store(pieces(docs, limit, end_id, path).withColumn("share", F.pmod(F.xxhash64("rk", "piece"), F.lit(n)).cast("int")), "pieces")
    each = scratch.store(cut.groupBy("length", "share").agg(F.count("*").alias("n")), "counts", few=True)
    # At most `limit` rows, one for each length.
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, limit))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    base = each.select(F.col("length").alias("of"), F.col("share").alias("in"), F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "rk", "piece", "start"))
    ranked = cut.withColumn("inner", inner - 1).join(base.hint("shuffle_hash"), (F.col("length") == F.col("of")) & (F.col("share") == F.col("in"))).withColumn("rank", F.col("base") + F.col("inner"))

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                i = np.flatnonzero(length == x)
                first, number, start, place = table[x]
                at = np.searchsorted(first, rank[i], side="right") - 1
                d = rank[i] - first[at]
                sequence[i] = start[at] + d % number[at]
                offset[i] = place[at] + d // number[at] * x
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = C.mapped(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NULL_ID)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
