"""Embedding near-dedup (operator 1): links vectors with a cosine of at least `threshold`, in double precision.

Equal vectors are one; the others meet in tiles. Unit vectors are written as s * q + e with int8 codes q; as the length
of e is known for each vector, |cos(x, y) - s_x s_y q_x.q_y| <= |e_x| + |e_y| + |e_x||e_y|. Tile products of the codes
are exact in single precision and decide all pairs but those within the bound of the threshold.
Codes are dealt to groups of bounded bytes; a task compares two groups and skips tiles that lie further apart along
one coordinate than linked unit vectors can. It names the vectors that have a pair in doubt. Only these are sent whole, to
the same pair of groups, where a second pass computes the pairs in doubt in double precision. Codes are stored once, and
each pair is judged by its own numbers alone, so both passes agree on which pairs are in doubt. Links stay inside
a task: it gives counts and a spanning forest.

A vector that is null, zero, or has null or non-finite components links with nothing; vectors of different lengths
don't link. Rows that repeat a vec_id are judged one by one, each by its own vector, and count as one link each; a null
vec_id is the smallest. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .repeats import packed, unpacked

THRESHOLD = 0.95
#: Bytes of a group's codes at most, and vectors that it has at least if there are several.
GROUP_BYTES, GROUP_LEAST, TILE = 8_000_000, 1024, 1024
#: More than single precision loses in a product and its bound.
SLACK = 4e-6
#: Links that are held before they become a spanning forest.
HELD_LINKS = 1_000_000


def units(raw: np.ndarray) -> np.ndarray:
    # Scaling by the largest component keeps squares of huge and tiny numbers within range.
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    return unit


def quantised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the lengths of what they leave out."""
    unit = units(raw)
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    codes = np.rint(unit / scale[:, None].astype(np.float64)).astype(np.int8)
    error = unit - codes * scale[:, None].astype(np.float64)
    return codes, scale, (np.sqrt(np.einsum("ij,ij->i", error, error)) * (1 + 1e-6)).astype(np.float32)


class Block:
    """Vectors of one group: ids, numbers of copies, codes, scales and errors, in the second pass whole vectors too."""

    def __init__(self, ids, n, codes, scale, error, unit=None):
        self.columns = {"ids": ids, "n": n, "codes": codes, "scale": scale, "error": error}
        if unit is not None:
            self.columns["unit"] = unit
        self.__dict__.update(self.columns)

    def sort(self, axis: int) -> None:
        order = np.argsort(self.codes[:, axis] * self.scale, kind="stable")
        self.__dict__.update({k: v[order] for k, v in self.columns.items()})
        self.along = self.codes[:, axis] * self.scale


def judged(x: Block, y: Block, a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two tiles that may be linked, and whether their codes prove it."""
    kind = np.float32 if x.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = x.codes[a].astype(kind) @ y.codes[b].astype(kind).T
    product *= x.scale[a, None]
    product *= y.scale[None, b]
    bound = np.outer(x.error[a] + np.float32(1), y.error[b] + np.float32(1)) + np.float32(SLACK - 1)
    i, j = np.nonzero(product + bound >= threshold)
    return i + a.start, j + b.start, product[i, j] - bound[i, j] >= threshold


def settled(x: Block, y: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are linked, in double precision."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        own = slice(at, at + (1 << 16))
        out[own] = np.einsum("ij,ij->i", x.unit[i[own]], y.unit[j[own]]) >= threshold
    return out


def compare(x: Block, y: Block | None, threshold: float, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of x and y, and for each the links found (weighted by copies), a spanning forest and if a pair is in doubt.

    Without whole vectors the links are those that codes prove; with them, those of the pairs in doubt.
    """
    other = x if y is None else y
    axis = int(np.argmax((x.codes * x.scale[:, None]).var(axis=0) + (other.codes * other.scale[:, None]).var(axis=0)))
    for block in {id(x): x, id(other): other}.values():
        block.sort(axis)
    # Coordinates of linked unit vectors differ by no more than their distance; codes miss half a step on either side.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + float(x.scale.max() + other.scale.max()) / 2 + SLACK
    whole = hasattr(x, "unit")
    n = len(x.ids)
    shift = 0 if y is None else n
    total = shift + len(other.ids)
    degree, doubt, label = np.zeros(total, np.int64), np.zeros(total, bool), np.arange(total)
    held: list[np.ndarray] = []
    size = 0

    def forest() -> np.ndarray:
        u, v = np.concatenate([np.stack([label, np.arange(total)]), *held], axis=1)
        return C.local_components(u, v, total)

    for i in range(0, n, tile):
        a = slice(i, min(i + tile, n))
        for j in range(i if y is None else 0, len(other.ids), tile):
            b = slice(j, min(j + tile, len(other.ids)))
            if other.along[b.start] - x.along[a.stop - 1] > reach or x.along[a.start] - other.along[b.stop - 1] > reach:
                continue
            u, v, sure = judged(x, other, a, b, threshold)
            if y is None:
                keep = u < v
                u, v, sure = u[keep], v[keep], sure[keep]
            if whole:
                u, v = u[~sure], v[~sure]
                link = settled(x, other, u, v, threshold)
                u, v = u[link], v[link]
            else:
                doubt[u[~sure]] = doubt[v[~sure] + shift] = True
                u, v = u[sure], v[sure]
            if not len(u):
                continue
            np.add.at(degree, u, other.n[v])
            np.add.at(degree, v + shift, x.n[u])
            held.append(np.stack([u, v + shift]))
            size += len(u)
            if size > HELD_LINKS:
                label, held, size = forest(), [], 0
    if held:
        label = forest()
    return np.concatenate([x.ids, *([] if y is None else [y.ids])]), degree, label, doubt


FOUND = "kind int, a long, b long, dim long, i long, j long"


def found_rows(key: tuple[int, int, int], x: Block, y: Block | None, threshold: float) -> pa.RecordBatch:
    """kind 0: id and links; 1: id and a smaller place of its tree; 2: id and group of a vector with a pair in doubt."""
    ids, degree, label, doubt = compare(x, y, threshold, TILE)
    group = np.repeat(key[1:], [len(x.ids), len(ids) - len(x.ids)])
    some, child, ask = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(doubt)
    kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(child), len(ask)])
    a = np.concatenate([ids[some], ids[child], ids[ask]])
    b = np.concatenate([degree[some], ids[label[child]], group[ask]])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, a, b, *(np.full(len(a), k) for k in key))], ["kind", "a", "b", "dim", "i", "j"])


def by_pair(batches, held, block, threshold: float):
    """Rows sorted by pair of groups to what is found in each pair. held(batch, row) is kept by group, block joins it."""
    state: dict = {"key": None, "groups": {}}

    def done():
        if state["key"] is None:
            return
        dim, i, j = state["key"]
        groups = {g: block(rows, dim) for g, rows in state["groups"].items()}
        if i in groups and (i == j or j in groups):
            yield found_rows(state["key"], groups[i], None if i == j else groups[j], threshold)

    for b in batches:
        for at, (g, *key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "dim", "i", "j")), strict=True)):
            if tuple(key) != state["key"]:
                yield from done()
                state["key"], state["groups"] = tuple(key), {}
            state["groups"].setdefault(g, []).append(held(b, at))
    yield from done()


def coded(batches):
    """Distinct vectors to themselves with codes, scales and errors."""
    for b in batches:
        e = b.column("e")
        sizes = e.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            own = b.take(pa.array(np.flatnonzero(sizes == dim)))
            codes, scale, error = quantised(own.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            raw = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([dim] * len(codes), pa.int64()), raw, pa.array(scale), pa.array(error)], [*own.schema.names, "dim", "code", "scale", "error"])


def groups_of(n: int, dim: int, parts: int) -> int:
    """Groups of bounded bytes, and pairs of groups for about all partitions where there are vectors enough."""
    return max(-(-n * (dim + 24) // GROUP_BYTES), min(-(-n // GROUP_LEAST), math.isqrt(2 * parts) + 1))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    scratch = C.Scratch(spark, "embeddings")
    n = C.partitions(spark)
    src = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(C.NULL_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.col("e").isNotNull() & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("e", lambda x: x != 0)
    good = src.where(F.coalesce(fine, F.lit(False)))
    # One row for each distinct vector. Its number is its key: vec_ids may repeat.
    distinct = good.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id())
    each = scratch.store(C.mapped(distinct, coded, "e array<double>, rep long, n long, key long, dim long, code binary, scale float, error float"), "coded")
    sizes = {r.dim: groups_of(r.n, r.dim, n) for r in each.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def deal(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0

        def flush():
            for (dim, g), rows in held.items():
                keys, counts, codes, scale, error = zip(*rows, strict=True)
                raw = packed(np.array(keys, np.int64), np.array(counts, np.int64), b"".join(codes), np.array(scale, np.float32), np.array(error, np.float32))
                # A group of vectors goes to the tasks of its row and column of the triangle of groups.
                for h in range(sizes[dim]):
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([min(g, h)]), pa.array([max(g, h)]), pa.array([g]), pa.array([raw], pa.binary())], ["dim", "i", "j", "g", "payload"])

        for b in batches:
            lot = C.mix(b.column("key").to_numpy().view(np.uint64)).tolist()
            for mixed, dim, *row in zip(lot, *(b.column(c).to_pylist() for c in ("dim", "key", "n", "code", "scale", "error")), strict=True):
                held.setdefault((dim, mixed % sizes[dim]), []).append(row)
                size += dim + 200
            if size > 32_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def payload(b, at):
        return b.column("payload")[at].as_py()

    def from_payloads(payloads, dim):
        keys, counts, codes, scale, error = (np.concatenate(x) for x in zip(*(unpacked(p, "i8", "i8", "i1", "f4", "f4") for p in payloads), strict=True))
        return Block(keys, counts, codes.reshape(-1, dim), scale, error)

    def vector(b, at):
        return *(b.column(c)[at].as_py() for c in ("key", "n", "code", "scale", "error")), b.column("e")[at].values.to_numpy(zero_copy_only=False)

    def from_vectors(rows, dim):
        keys, counts, codes, scale, error, e = zip(*rows, strict=True)
        return Block(np.array(keys, np.int64), np.array(counts, np.int64), np.frombuffer(b"".join(codes), np.int8).reshape(-1, dim), np.array(scale, np.float32), np.array(error, np.float32), units(np.stack(e)))

    pair = ("dim", "i", "j")
    dealt = C.mapped(each.select("key", "n", "dim", "code", "scale", "error"), deal, "dim long, i long, j long, g long, payload binary")
    sure = scratch.store(C.mapped(dealt.repartition(n, *pair).sortWithinPartitions(*pair), lambda b: by_pair(b, payload, from_payloads, threshold), FOUND), "sure")
    asked = sure.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("g"), *pair)
    whole = asked.join(each.select("key", "n", "code", "scale", "error", "e"), "key").repartition(n, *pair).sortWithinPartitions(*pair)
    rest = scratch.store(C.mapped(whole, lambda b: by_pair(b, vector, from_vectors, threshold), FOUND), "doubted")
    found = sure.unionByName(rest)
    low = C.components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    # Of each component the smallest vec_id, for vectors that have links.
    member = low.unionByName(low.select(F.col("v").alias("u"), "v").distinct()).join(each.select(F.col("key").alias("u"), "rep"), "u")
    first = member.groupBy("v").agg(F.min("rep").alias("component_id"))
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("u")).agg(F.sum("b").alias("links"))
    linked = member.join(first, "v").join(degrees, "u").select(F.col("u").alias("key"), "links", "component_id")
    named = each.select("key", "e", "rep", "n").join(linked, "key", "left")
    named = scratch.store(named.select(F.col("e").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = good.join(named, good.e == named.same).select("vec_id", "n_links", "component_id")
    other = src.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    null = F.lit(C.NULL_ID)
    return out.unionByName(other).select(F.nullif("vec_id", null).alias("vec_id"), "n_links", F.nullif("component_id", null).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
low AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT x.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, x.vec_id = l.component_id AS kept
FROM embeddings x JOIN low l ON l.u = x.vec_id LEFT JOIN deg d ON d.u = x.vec_id
"""


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
