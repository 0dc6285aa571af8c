"""Benchmark decontamination (operator 7): documents that hold a benchmark item, verbatim or reworded.

Words are runs of letters and digits, ASCII letters folded. Terms are the words of the items, but for those that many
items share. Every document is cut into overlapping passages of two blocks of BLOCK words. One pass over the corpus counts
in how many passages each term stands and gathers A'(A W) for the term counts A and a random W of RANK columns, a sum of
bounded size from each partition; weighting by inverse passage frequency D then gives the range of the TF-IDF matrix
(D A'A W = (AD)'(AD) (D^-1 W), a randomised SVD in one pass, with the items as passages of their own). A second pass
compares each passage with all items by cosine in that latent space. Candidates are checked on words: the longest
common subsequence with a stretch of about the item's length must hold SURE of the item, or PERHAPS of it together with
its answer, its last quarter.

A passage is compared if it has two terms, or one of an item of fewer than FEW_TERMS, which a passage can hold by one.

Items are the stated query set; they are held in blocks of about ITEMS, with one search for each block, which adds to what
the rows carry from the one before. Terms are chosen by the word counts of all items, however many blocks there are. Null
and empty items match nothing. Null texts are empty. Each row of documents gives one row, repeated and null doc_ids too; an
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .repeats import packed, unpacked
from .toxicity import BREAK, FOLD

BLOCK, RANK, ITEMS = 16, 128, 4096
COSINE, SURE, PERHAPS, ANSWER = 0.3, 0.7, 0.5, 0.8
#: A term stands in at most this share of the items; the rarest terms of an item stay in any case.
COMMON, KEPT_TERMS = 0.03, 6
FEW_TERMS = 4
#: Payloads that the sums of a partition are cut into.
SHARES = 16


def words_of(text: str) -> list[bytes]:
    data = FOLD[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = C.word_spans(data, np.array([0, len(data)]), BREAK)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return C.span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends) if words else np.zeros(0, np.uint64)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64 and more steps at a time in the bits of a number."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Terms:
    """The terms of a block of items, and the items as rows of term counts. often: in how many of `total` items a word stands."""

    def __init__(self, items: list[tuple[int, list[bytes]]], often: dict[int, int] | None = None, total: int | None = None):
        self.ids = [i for i, _ in items]
        own = [hashes(w) for _, w in items]
        if often is None:
            kinds, seen = np.unique(np.concatenate([np.unique(h) for h in own]), return_counts=True)
            often = dict(zip(kinds.tolist(), seen.tolist(), strict=True))
        most = max(2, COMMON * (total or len(items)))
        keep: set[int] = set()
        for h in own:
            u = sorted(set(h.tolist()), key=lambda x: (often[x], x))
            keep.update(x for k, x in enumerate(u) if often[x] <= most or k < KEPT_TERMS)
        self.known = np.array(sorted(keep), np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.rows = [self.find(h)[1] for h in own]
        #: Terms of items with so few that one may be all that a passage has of them.
        self.few = np.zeros(len(self.known), bool)
        for row in self.rows:
            if len(row) < FEW_TERMS:
                self.few[row] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in codes that are terms, and which."""
        some = np.flatnonzero(self.filter[(codes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, codes[some]), len(self.known) - 1)
        hit = self.known[at] == codes[some]
        return some[hit], at[hit]


def blocks_of(terms: Terms, data: np.ndarray, offs: np.ndarray):
    """For a chunk of documents: terms, their blocks, the document of each block, and word starts and ends."""
    starts, ends, cuts = C.word_spans(data, offs, BREAK)
    codes = C.span_hashes(data, starts, ends)
    at, term = terms.find(codes)
    n = -(-np.diff(cuts) // BLOCK)
    first = np.cumsum(n) - n
    doc = np.searchsorted(cuts, at, side="right") - 1
    return term, first[doc] + (at - cuts[doc]) // BLOCK, np.repeat(np.arange(len(n)), n), first, codes, cuts


def sums(rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by block; block is ascending."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(block):
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[block[start]] = np.add.reduceat(rows, start, axis=0)
    return out


def texts_of(batches, *names):
    for b in batches:
        data, offs = C.buffers(b.column("text"))
        for i, j in C.chunks(offs, 1 << 18):
            yield [b.column(c)[i:j] for c in names], FOLD[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]


def gather(terms: Terms, test: np.ndarray):
    """Documents to one row of a partition: numbers of passages, of passages with a term, and A'(A test)."""

    def run(batches):
        total, seen, z = 0, np.zeros(len(terms.known), np.int64), np.zeros(test.shape, np.float64)
        for _, data, offs in texts_of(batches):
            term, block, doc, *_ = blocks_of(terms, data, offs)
            passage = block // 2
            total += -(-len(doc) // 2)
            if not len(term):
                continue
            pairs = np.unique(passage * len(terms.known) + term)
            seen += np.bincount(pairs % len(terms.known), minlength=len(terms.known))
            p, back = np.unique(passage, return_inverse=True)
            v = sums(test[term], back, len(p))
            order = np.argsort(term, kind="stable")
            t = term[order]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            z[t[start]] += np.add.reduceat(v[back[order]], start, axis=0)
        # The sums in payloads, dealt by place of the terms: term, passages and vector.
        for k in range(SHARES):
            own = np.flatnonzero(seen[k::SHARES]) * SHARES + k
            raw = packed(own.astype(np.int32), seen[own], z[own].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0 if k else total], pa.int64()), pa.array([raw], pa.binary())], ["bucket", "kind", "payload"])

    return run


def added(batches):
    """Payloads of partitions to their sums, one for each share; kind: the number of passages."""
    found: dict[int, list] = {}
    totals: dict[int, int] = {}
    for b in batches:
        for k, n, raw in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
            totals[k] = totals.get(k, 0) + n
            term, seen, z = unpacked(raw, "<i4", "<i8", "<f4")
            if k not in found:
                found[k] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 1))]
            if len(term):
                at = np.union1d(found[k][0], term)
                n, y = np.zeros(len(at), np.int64), np.zeros((len(at), len(z) // len(term)))
                for t, own, x in (found[k], (term, seen, z.reshape(len(term), -1))):
                    if len(t):
                        n[np.searchsorted(at, t)] += own
                        y[np.searchsorted(at, t)] += x
                found[k] = [at, n, y]
    for k, (term, seen, z) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([totals[k]], pa.int64()), pa.array([packed(term.astype(np.int32), seen, z.astype(np.float64))], pa.binary())], ["total", "payload"])


def latent(terms: Terms, docs: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Weighted term vectors (inverse passage frequency times an orthonormal basis of the leading space), and items there."""
    rank = min(rank, len(terms.known))
    r = np.random.default_rng(7)
    test = r.normal(size=(len(terms.known), rank)).astype(np.float32)
    parts = C.mapped(docs.select("text"), gather(terms, test), "bucket int, kind long, payload binary")
    # Added up on the executors; rank numbers for each term of the block come here.
    seen, y, total = np.zeros(len(terms.known)), np.zeros(test.shape), 0
    for row in C.mapped(parts.repartition(SHARES, "bucket"), added, "total long, payload binary").collect():
        total += row.total
        term, n, z = unpacked(bytes(row.payload), "<i4", "<i8", "<f8")
        seen[term] = n
        if len(term):
            y[term] = z.reshape(len(term), -1)
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    # The items count as passages too, with so much weight that their terms are not lost among the corpus.
    weight = max(1.0, total / max(1, 20 * len(terms.rows)))
    for row in terms.rows:
        np.add.at(y, row, weight * test[row].sum(axis=0))
    y *= idf[:, None]
    # Nystroem: (AD)'(AD) is about Y (W'Y)^-1 Y' for the test matrix D^-1 W.
    core = (test / idf[:, None]).T @ y
    core = (core + core.T) / 2
    shift = 1e-6 * max(np.trace(core) / rank, 1e-12)
    q, tri = np.linalg.qr(y)
    inner = tri @ np.linalg.pinv(core + shift * np.eye(rank)) @ tri.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    basis = q @ vectors[:, np.argsort(-values)]
    embed = (idf[:, None] * basis).astype(np.float32)
    rows = np.stack([embed[row].sum(axis=0) if len(row) else np.zeros(rank, np.float32) for row in terms.rows])
    return embed, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def holds(item: list, region: list) -> float:
    """The share of the item that a stretch of the region has in order; 0 if it is too small to count."""
    m = len(item)
    if common_subsequence(item, region) < PERHAPS * m:
        return 0.0
    size, step = m + max(2, m // 4), max(1, m // 8)
    best, best_at = 0, 0
    for i in range(0, max(1, len(region) - size + step), step):
        n = common_subsequence(item, region[i : i + size])
        if n > best:
            best, best_at = n, i
    answer = item[-max(3, m // 4) :]
    enough = best >= SURE * m or (best >= PERHAPS * m and common_subsequence(answer, region[best_at : best_at + size]) >= ANSWER * len(answer))
    return best / m if enough and (m >= 5 or best == m) else 0.0


#: Bits of a bitmap of words, and the reach in blocks beyond which one would be full.
WORD_BITS, FAR = 512, 16


def word_bits(codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows a bitmap with a bit for each of its words."""
    flat = np.zeros(n * WORD_BITS, bool)
    flat[row * WORD_BITS + (codes >> np.uint64(64 - 9)).astype(np.int64)] = True
    return np.packbits(flat).view(np.uint64).reshape(n, -1)


class Absent:
    """Turns candidates away of which the surroundings lack more words than the check lets an item lack.

    A bit that an item has and its surroundings have not stands for at least one word that can't be in the common
    subsequence, so no candidate that the check would find is lost.
    """

    def __init__(self, items: list[list[int]]):
        size = np.array([len(x) for x in items])
        codes = np.concatenate([np.array(x, np.uint64) for x in items])
        self.bits = word_bits(codes, np.repeat(np.arange(len(items)), size), len(items))
        self.most = np.where(size < 5, 0, np.floor(size * (1 - PERHAPS) + 1e-9)).astype(np.int64)
        self.reach = -(-size // BLOCK)

    def keep(self, blocks: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """blocks: bitmaps of all blocks; at: the first of a candidate's two blocks."""
        out = np.ones(len(at), bool)
        reach = self.reach[item]
        for r in np.unique(reach[reach <= FAR]).tolist():
            own = np.flatnonzero(reach == r)
            # The surroundings: r blocks on either side, and so those of the two blocks together.
            first = np.unique(at[own])
            around = np.zeros((len(first), blocks.shape[1]), np.uint64)
            for d in range(-r, r + 2):
                around |= blocks[np.clip(first + d, 0, len(blocks) - 1)]
            lack = np.bitwise_count(self.bits[item[own]] & ~around[np.searchsorted(first, at[own])]).sum(axis=1, dtype=np.int64)
            out[own] = lack <= self.most[item[own]]
        return out


class Sequences:
    """The longest common subsequences of many candidates at a time, one number of 64 bits for each.

    For items of at most 64 words; the others are left to common_subsequence.
    """

    MOST, AT_ONCE = 64, 4096

    def __init__(self, items: list[list[int]]):
        self.size = np.array([len(x) for x in items])
        self.known = np.unique(np.concatenate([np.array(x, np.uint64) for x in items]))
        at: dict[int, int] = {}
        for i, x in enumerate(items):
            if len(x) <= self.MOST:
                for j, word in enumerate(np.searchsorted(self.known, np.array(x, np.uint64)).tolist()):
                    at[i * len(self.known) + word] = at.get(i * len(self.known) + word, 0) | 1 << j
        # Where each item has each of its words.
        self.pairs = np.array(sorted(at), np.int64)
        self.bits = np.array([at[x] for x in sorted(at)], np.uint64)

    def words(self, codes: np.ndarray) -> np.ndarray:
        """The place among the words of all items, or -1."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, -1)

    def lengths(self, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each candidate the length in words[lo:hi]; the item's own where it is too long to tell."""
        out = self.size[item]
        short = np.flatnonzero(out <= self.MOST)
        for i in range(0, len(short), self.AT_ONCE):
            own = short[i : i + self.AT_ONCE]
            out[own] = self._lengths(words, item[own], lo[own], hi[own])
        return out

    def _lengths(self, words, item, lo, hi):
        n = hi - lo
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        word = words[np.arange(len(of)) - np.repeat(first - lo, n)]
        of, word = of[word >= 0], word[word >= 0]
        key = item[of] * len(self.known) + word
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        of, bits = of[hit], self.bits[at[hit]]
        # Words of the region that the item has, in order: a step of all candidates for each.
        seen = np.bincount(of, minlength=len(n))
        steps = np.zeros((int(seen.max(initial=0)), len(n)), np.uint64)
        steps[np.arange(len(of)) - np.repeat(np.cumsum(seen) - seen, seen), of] = bits
        full = np.uint64(2**64 - 1) >> (self.MOST - self.size[item]).astype(np.uint64)
        v = full.copy()
        for m in steps:
            u = v & m
            v = ((v + u) | (v - u)) & full
        return self.size[item] - np.bitwise_count(v)


def search(terms: Terms, embed: np.ndarray, rows: np.ndarray, items: list[list[int]], keep: tuple[str, ...]):
    """Documents to themselves, with the items that they hold added to those found before (columns FOUND)."""

    def run(batches):
        absent, sequences = Absent(items), Sequences(items)
        for own, data, offs in texts_of(batches, *keep, *FOUND):
            *own, known, part = own
            term, block, doc, first, codes, cuts = blocks_of(terms, data, offs)
            found: list[dict[int, float]] = [{} for _ in range(len(offs) - 1)]
            if len(term):
                b = sums(embed[term], block, len(doc))
                hits = np.bincount(block, minlength=len(doc))
                pair = np.append(doc[1:] == doc[:-1], False)
                b[:-1][pair[:-1]] += b[1:][pair[:-1]]
                hits[:-1][pair[:-1]] += np.append(hits[1:], 0)[: len(doc) - 1][pair[:-1]]
                lone = np.bincount(block, terms.few[term], len(doc)) > 0
                lone[:-1][pair[:-1]] |= lone[1:][pair[:-1]]
                some = np.flatnonzero((hits >= 2) | lone)
                norm = np.linalg.norm(b[some], axis=1)
                near = []
                for i in range(0, len(some), 8192):
                    cosine = (b[some[i : i + 8192]] @ rows.T) / np.maximum(norm[i : i + 8192, None], 1e-9)
                    p, k = np.nonzero(cosine >= COSINE)
                    near.append((some[i + p], k))
                p, k = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, int), np.zeros(0, int))
                if len(p):
                    word = np.arange(len(codes))
                    of = np.searchsorted(cuts, word, side="right") - 1
                    bits = word_bits(codes, first[of] + (word - cuts[of]) // BLOCK, len(doc))
                    good = absent.keep(bits, p, k)
                    p, k = p[good], k[good]
                # The surroundings of each candidate, and only those that hold enough of the item in order.
                of, m = doc[p], sequences.size[k]
                at = cuts[of] + (p - first[of]) * BLOCK
                lo, hi = np.maximum(cuts[of], at - m), np.minimum(cuts[of + 1], at + 2 * BLOCK + m)
                enough = np.flatnonzero(sequences.lengths(sequences.words(codes), k, lo, hi) >= PERHAPS * m) if len(p) else []
                for d, x, a, b in zip(*(y[enough].tolist() for y in (of, k, lo, hi)), strict=True):
                    if found[d].get(x, 0) >= 1:
                        continue
                    region = codes[a:b].tolist()
                    share = holds(items[x], region)
                    if share > found[d].get(x, 0):
                        found[d][x] = share
            names = [sorted({*(terms.ids[x] for x in f), *k}) for f, k in zip(found, known.to_pylist(), strict=True)]
            share = [max(f.values(), default=0.0) for f in found]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.list_(pa.int64())), pa.array(np.maximum(share, part.to_numpy()))], [*keep, *FOUND])

    return run


#: Columns that a search adds to, named apart from those that rows may have.
FOUND = ("found item_ids", "found share")


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, item_ids (the items found, ascending) and share (the largest part of one that was found)."""
    scratch = C.Scratch(docs.sparkSession, "leaks")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [c for c in dict.fromkeys(["doc_id", *keep]) if c != "text"]
    fields = ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string", f"`{FOUND[0]}` array<bigint>, `{FOUND[1]}` double"])
    src = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<bigint>").alias(FOUND[0]), F.lit(0.0).alias(FOUND[1]))
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = asked.count()
    blocks = -(-n // ITEMS)

    def words(batches):
        for b in batches:
            found = [np.unique(hashes(words_of(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["word"])

    # One number for each word of the items, which are what is asked for.
    counted = C.mapped(asked.select("text"), words, "word long").groupBy("word").agg(F.count("*").alias("n")).toArrow()
    often = dict(zip(counted.column("word").to_numpy().view(np.uint64).tolist(), counted.column("n").to_pylist(), strict=True))
    for block in range(blocks):
        # A block holds about ITEMS items, however many there are.
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = [(r.item_id, w) for r in own if (w := words_of(r.text))]
        if not items:
            continue
        terms = Terms(items, often, n)
        embed, rows = latent(terms, src)
        out = C.mapped(src, search(terms, embed, rows, [hashes(w).tolist() for _, w in items], (*names, "text")), fields)
        src = scratch.store(out, "found") if block < blocks - 1 else out
    return src.select(*dict.fromkeys(["doc_id", *keep]), F.col(FOUND[0]).alias("item_ids"), F.col(FOUND[1]).alias("share"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, share for each document."""
    out = find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), "share")
