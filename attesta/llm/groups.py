"""Similar texts within groups of candidates: what the operators with MinHash bands share.

A group holds the texts that share a band; equal groups of several bands are one. A group of up to TILE weight (a text
weighs its length and a fixed part) is one piece of work. A larger one is dealt to tiles, and each pair of tiles is a
piece of its own, so no task holds more than two tiles, however large a group is.

In a piece each text is a set of shingle hashes and a bitmap with a bit for each. First all are compared with the most
widespread one, then those that are in different classes yet. A pair is turned away if its bitmaps alone differ in more
places than two sets so similar can (a differing bit stands for at least one shingle that only one of them has, so none is
lost); the others are compared on their sets. Only links that join classes leave a piece, at most one for each text, so
neither rows nor exact comparisons grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Weight of a piece's half, in bytes of text; the fixed part of a text, so a tile has at most 4,096 of them.
TILE, FIXED = 1 << 21, 1 << 9
#: Groups of fewer texts than this are only weighed if they hold a long one.
SMALL = 32
BITS_LEAST, BITS_MOST = 512, 8192
#: Rows and bytes of whole groups that are worked on at a time.
ROWS, BYTES = 2048, 1 << 20
#: Bytes of texts whose shingles are hashed at a time.
AT_ONCE = 1 << 17
ASKED_BITS = 24


class Asked:
    """Which names may be asked for: one bit for each of 2^ASKED_BITS values, of fixed size.

    When it fills up, more texts are looked at, and none is missed.
    """

    def __init__(self, names: DataFrame):
        at = F.shiftrightunsigned("name", 64 - ASKED_BITS)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {64 - ASKED_BITS}) & 63 as int))")
        words = names.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.words = np.zeros(1 << (ASKED_BITS - 6), np.int64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def has(self, names: np.ndarray) -> np.ndarray:
        at = (names.view(np.uint64) >> np.uint64(64 - ASKED_BITS)).astype(np.int64)
        return (self.words[at >> 6] >> (at & 63) & 1).astype(bool)


def bitmaps(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text a row of 64-bit words with a bit for each of its shingles; h: hashes, at: where each text's begin, and the end."""
    n = np.diff(at)
    bits = int(np.clip(1 << int(np.ceil(np.log2(4 * max(1, np.quantile(n, 0.9))))), BITS_LEAST, BITS_MOST))
    out = np.empty((len(n), bits // 64), np.uint64)
    for i in range(0, len(n), 1024):
        j = min(i + 1024, len(n))
        flat = np.zeros((j - i) * bits, bool)
        place = (h[at[i] : at[j]] >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
        flat[place + np.repeat(np.arange(j - i) * bits, n[i:j])] = True
        out[i:j] = np.packbits(flat).view(np.uint64).reshape(j - i, -1)
    return out


class Piece:
    """Texts of whole groups, compared. shingled: texts to hashes of shingles, repeats included, and where each text's begin, and the end."""

    def __init__(self, texts: list[bytes], shingled: Callable, similarity: float):
        parts, at, i = [], [0], 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= AT_ONCE:
                size += len(texts[j])
                j += 1
            h, own = shingled(texts[i:j])
            parts.append(h)
            at += (own[1:] + at[-1]).tolist()
            i = j
        self.h, self.at = np.concatenate(parts), np.array(at)
        self.similarity = similarity
        self.most = (1 - similarity) / (1 + similarity)
        self.bits = bitmaps(self.h, self.at)
        self.count = np.diff(self.at)
        self.sets: dict[int, np.ndarray] = {}
        self.label = list(range(len(texts)))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = self.label[i]
        return i

    def set_of(self, i: int) -> np.ndarray:
        found = self.sets.get(i)
        if found is None:
            found = self.sets[i] = np.unique(self.h[self.at[i] : self.at[i + 1]])
        return found

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may be similar. Two similar sets differ in at most `most` of the sum of their sizes."""
        differ = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)
        return differ <= self.most * (self.count[a] + self.count[b]) + 1e-6

    def link(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x == y:
            return
        p, q = self.set_of(i), self.set_of(j)
        if min(len(p), len(q)) < self.similarity * max(len(p), len(q)) - 1e-9:
            return
        both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
        if both >= self.similarity * (len(p) + len(q) - both) - 1e-9:
            self.label[max(x, y)] = min(x, y)
            self.links.append((i, j))

    def all_of(self, rows: np.ndarray, part: np.ndarray) -> None:
        """Compare a group's rows of different classes; of two tiles, only rows of one with rows of the other."""
        bits, count, alone = self.bits[rows], self.count[rows], part[0] == part[-1]
        for k in range(1, len(rows)):
            if k % 64 == 1:
                own = np.array([self.root(i) for i in rows.tolist()])
                if (own == own[0]).all():
                    return
            # Rows in front of the k-th that are in another class; what has been linked since is seen by link().
            front = np.flatnonzero((own[:k] != own[k]) if alone else (own[:k] != own[k]) & (part[:k] != part[k]))
            if len(front):
                differ = np.bitwise_count(bits[front] ^ bits[k]).sum(axis=1, dtype=np.int64)
                for i in front[differ <= self.most * (count[front] + count[k]) + 1e-6].tolist():
                    self.link(int(rows[i]), int(rows[k]))


def linked(shingled: Callable, similarity: float):
    """Rows (piece, part, seen, name, text), sorted by piece, to links (u, v) of names that join similar texts."""

    def work(piece, part, seen, name, texts):
        p = Piece(texts, shingled, similarity)
        start = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        size = np.diff(np.append(start, len(piece)))
        # The first row of each group is its most widespread text.
        order = np.lexsort((name, -seen, piece))
        group = np.repeat(np.arange(len(start)), size)
        first = order[start]
        other = np.flatnonzero(np.arange(len(piece)) != first[group])
        good = other[p.near(first[group[other]], other)]
        for i, j in zip(first[group[good]].tolist(), good.tolist(), strict=True):
            p.link(i, j)
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            rows = np.arange(s, s + n)
            rows = rows[np.argsort(part[rows], kind="stable")]
            p.all_of(rows, part[rows])
        u, v = np.array(p.links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v])], ["u", "v"])

    def run(batches):
        held: list[tuple] = []
        size = rows = 0
        last = None

        def done():
            nonlocal held, size, rows
            out = work(*(np.concatenate([x[k] for x in held]) for k in range(4)), [t for x in held for t in x[4]])
            held, size, rows = [], 0, 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            piece, part, seen, name = (b.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "part", "seen", "name"))
            data, offs = C.buffers(b.column("text"))
            if held and piece[0] != last and (size >= BYTES or rows >= ROWS):
                yield done()
            ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, b.num_rows)
            i = 0
            while i < b.num_rows:
                # So many rows as there is room for, up to the end of a group.
                want = max(i + 1, min(i + ROWS - rows, int(np.searchsorted(offs, offs[i] + BYTES - size))))
                j = int(ends[min(np.searchsorted(ends, want), len(ends) - 1)])
                held.append((piece[i:j], part[i:j], seen[i:j], name[i:j], [data[x:y].tobytes() for x, y in zip(offs[i:j], offs[i + 1 : j + 1], strict=True)]))
                size, rows = size + int(offs[j] - offs[i]), rows + j - i
                if j < b.num_rows:
                    yield done()
                i = j
            last = piece[-1]
        if held:
            yield done()

    return run


def similar_links(members: DataFrame, texts: DataFrame, shingled: Callable, similarity: float, n: int) -> DataFrame:
    """Links (u, v) that make the classes of similar texts of each group.

    members: group, name, seen (how widespread the text is), size (of the group); texts: name, text, one row for each name.
    """
    weight = F.sum(F.octet_length("text").cast("long") + FIXED)
    heavy = texts.where(F.octet_length("text") > TILE // SMALL)
    weighed = members.where(F.col("size") >= SMALL).join(texts, "name").unionByName(members.where(F.col("size") < SMALL).join(heavy, "name"))
    large = weighed.groupBy("group").agg(F.ceil(weight / TILE).cast("int").alias("tiles")).where("tiles > 1")
    placed = members.join(large, "group", "left").select("group", "name", "seen", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    own = F.pmod(F.xxhash64("name", F.lit("tile")), F.col("tiles")).cast("int")
    # A tile meets every other one and, on its own, itself; both are one pair of numbers, the smaller first.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    dealt = placed.withColumn("own", own).select("group", "name", "seen", "own", F.explode(pairs).alias("pair"))
    dealt = dealt.select(F.xxhash64("group", "pair.i", "pair.j").alias("piece"), (F.col("own") == F.col("pair.i")).cast("int").alias("part"), "seen", "name")
    rows = dealt.join(texts, "name").select("piece", "part", "seen", "name", "text").repartition(n, "piece").sortWithinPartitions("piece")
    return C.mapped(rows, linked(shingled, similarity), "u long, v long")
