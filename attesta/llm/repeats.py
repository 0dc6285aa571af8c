"""Windows of W units (bytes or words) that occur more than once in a corpus, exactly, without sorting the whole corpus.

1. Each window of W units picks an anchor: of the k-unit strings in it, the one with the smallest hash. Equal windows
   pick equal anchors, so windows whose anchor occurs once can't repeat. Partitions look for repeated anchors in
   themselves and send on one entry for an anchor that is repeated there. Of anchors met once they send the hash with its
   place or, with a count-min sketch, the cells that it adds one to, with its document. Buckets add up.
2. For a repeated anchor the text over all its windows (a stretch, of less than 2 W units) is sent to the anchor's
   bucket; a partition sends each different stretch once, with its first place. A bucket compares windows exactly.
3. Windows of repeated anchors count as repeats unless their bucket sends word that they are the first of their kind.

All that is exchanged are packed arrays in rows of bounded size, dealt by anchor or by document; a stretch that occurs
a million times is one entry from each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Positions within a chunk take this many bits; the other bits of the hash order the anchors.
POS_BITS = 24
LOW = np.uint64((1 << POS_BITS) - 1)
SEGMENT = 1 << 22
FLUSH = 1_500_000


def rolling(u: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k units, by doubling."""
    base, power, have, n = 0x9E3779B97F4A7C15, u, 1, len(u)
    out, width, mod = None, 0, 1 << 64
    while True:
        if k & have:
            out, width = (power, have) if out is None else (out[: n - width - have + 1] * np.uint64(pow(base, have, mod)) + power[width : n - have + 1], width + have)
        if have * 2 > k:
            return C.mix(out[: n - k + 1].copy())
        power = power[: n - 2 * have + 1] * np.uint64(pow(base, have, mod)) + power[have : n - have + 1]
        have *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span, n = 1, len(x)
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: n - w + 1], x[rest : rest + n - w + 1]) if rest else x[: n - w + 1]


def runs(u: np.ndarray, offs: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window, number of windows, hash and place of the anchor. u: unit codes; offs: of documents."""
    out = []
    lens = np.diff(offs)
    if len(u) > (1 << POS_BITS) - 1:
        for d in np.flatnonzero(lens >= window):
            for at in range(0, int(lens[d]) - window + 1, SEGMENT):
                part = u[offs[d] + at : min(offs[d] + at + SEGMENT + window - 1, offs[d + 1])]
                _, s, n, h, a = runs(part, np.array([0, len(part)]), k, window)
                out.append((np.full(len(s), d), s + at, n, h, a + at))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else runs(u[:0], np.zeros(1, np.int64), k, window)
    n = len(u)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    h = rolling(u, k)
    m = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), window - k + 1)
    anchor = (m & LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)[: n - window + 1]
    at = np.arange(n - window + 1)
    good = np.flatnonzero(at + window <= offs[1:][doc])
    a = anchor[good]
    new = np.ones(len(good), bool)
    new[1:] = (a[1:] != a[:-1]) | (good[1:] != good[:-1] + 1) | (doc[good[1:]] != doc[good[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(good)))
    start = good[first]
    return doc[start], start - offs[doc[start]], count, h[a[first]], a[first] - offs[doc[start]]


class Units:
    """How a text is cut into units. `read` gives unit codes and offsets of documents for texts given as bytes and offsets."""

    def __init__(self, words: bool):
        self.words = words

    def read(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        if not self.words:
            return C.BYTE_CODES[data], offs, ()
        starts, ends, cuts = C.word_spans(data, offs)
        return C.span_hashes(data, starts, ends), cuts, (starts, ends)

    def stretch(self, data: np.ndarray, offs: np.ndarray, spans: tuple, cuts: np.ndarray, doc: int, start: int, n: int) -> bytes:
        """Units start to start + n of a document; of words, joined by spaces."""
        if not self.words:
            at = int(offs[doc]) + start
            return data[at : at + n].tobytes()
        at = int(cuts[doc]) + start
        return b" ".join(data[spans[0][at] : spans[1][at + n - 1]].tobytes().split())


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one payload, each after its length in bytes."""
    out = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
        out += [len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def rows_of(kind: int, buckets, payloads) -> pa.RecordBatch:
    n = len(buckets)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(payloads, pa.large_binary()).cast(pa.binary())], ["bucket", "kind", "payload"])


PACKED = "bucket int, kind int, payload binary"


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    for i, j in zip(np.append(0, cut), np.append(cut, len(b)), strict=True):
        yield int(b[i]), [c[order[i:j]] for c in columns]


def texts_of(batches: Iterator[pa.RecordBatch], most: int = 1 << 18):
    """doc_ids, row keys, bytes and offsets, a chunk of whole documents at a time."""
    for b in batches:
        data, offs = C.buffers(b.column("text"))
        ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "rk"))
        for i, j in C.chunks(offs, most):
            yield ids[i:j], keys[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by place of their bytes: zeros of small numbers stand together and take no room when sent."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


#: Stands for the id of the document that a key belongs to, where the key alone will do.
ANY_ID = C.NULL_ID + 1


def anchor_pass(units: Units, k: int, window: int, buckets: int, sketch: CountMin | None = None):
    """Documents to payloads: (kind 0) anchors met once, with document and place or as a sketch; (1) anchors met more than
    once here, with their count; (2) marks of anchors that are known to be repeated, already by bucket of their document."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            ids, keys, doc, start, h = (np.concatenate([x[i] for x in held]) for i in range(5))
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.append(True, s[1:] != s[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(s)))
            single = order[first[count == 1]]
            again = order[np.repeat(count, count) > 1]
            out = []
            for b, (p,) in by_bucket((h[single] % np.uint64(buckets)).astype(np.int64), single):
                p = np.sort(p)
                d, back = np.unique(doc[p], return_inverse=True)
                if sketch:
                    cell, other = sketch.cells(0, h[p]), sketch.cells(1, h[p])
                    at = np.argsort(cell, kind="stable")
                    out.append((b, packed(planes(np.diff(cell[at], prepend=0)), planes(other[at]), planes(back[at]), keys[d])))
                else:
                    out.append((b, packed(h[p], ids[d], keys[d], back.astype(np.uint32), start[p].astype(np.int64))))
            for i in range(0, len(out), 64):
                yield rows_of(0, *zip(*out[i : i + 64], strict=True))
            out = [(b, packed(c, n)) for b, (c, n) in by_bucket((s[first[count > 1]] % np.uint64(buckets)).astype(np.int64), s[first[count > 1]], count[count > 1].astype(np.int64))]
            if out:
                yield rows_of(1, *zip(*out, strict=True))
            own = keys[doc[again]]
            if sketch:
                yield from found(np.full(len(own), ANY_ID), own, sketch.place(h[again], buckets), buckets)
            else:
                yield from found(ids[doc[again]], own, start[again], buckets)

        base = 0
        for ids, keys, data, offs in texts_of(batches):
            u, cuts, _ = units.read(data, offs)
            doc, start, _, h, _ = runs(u, cuts, k, window)
            held.append((ids, keys, doc + base, start, h))
            base += len(ids)
            size += len(h)
            if size >= FLUSH:
                yield from flush()
                held, size, base = [], 0, 0
        if size:
            yield from flush()

    return run


def found(ids, keys, start, buckets) -> Iterator[pa.RecordBatch]:
    out = []
    for b, (i, key, s) in by_bucket(keys % buckets, ids, keys, start):
        order = np.lexsort((s, i, key))
        out.append((b, packed(i[order], key[order], s[order].astype(np.int64))))
    for i in range(0, len(out), 64):
        yield rows_of(2, *zip(*out[i : i + 64], strict=True))


def exact_counts(hashes: np.ndarray, counts: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """How often each anchor in `ask` was met in all partitions."""
    keys, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, counts, len(keys))
    return total[np.searchsorted(keys, ask)] if len(ask) else np.zeros(0)


class CountMin:
    """Counts in two rows of cells for each bucket of hashes, which stop at 255: never too small.

    A partition's sketch is sent by bucket as the cells that are not zero; buckets add up what partitions send.
    """

    depth = 2

    def __init__(self, bits: int):
        self.bits = bits

    def place(self, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """The cell of the first row, numbered through all buckets."""
        return (hashes % np.uint64(buckets)).astype(np.int64) << self.bits | self.cells(0, hashes)

    def empty(self) -> np.ndarray:
        return np.zeros((self.depth, 1 << self.bits), np.uint8)

    def add(self, sketch: np.ndarray, rows: tuple[np.ndarray, ...], counts: np.ndarray | int = 1) -> None:
        for own, cells in zip(sketch, rows, strict=True):
            at, back = np.unique(cells, return_inverse=True)
            more = np.bincount(back, np.broadcast_to(counts, len(cells)), len(at))
            own[at] = np.minimum(own[at] + more, 255).astype(np.uint8)

    def estimate(self, sketch: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.min([own[cells] for own, cells in zip(sketch, rows, strict=True)], axis=0)

    def cells(self, row: int, hashes: np.ndarray) -> np.ndarray:
        return (C.mix(hashes + np.uint64(row * 0x632BE59BD9B4E019 & (2**64 - 1))) >> np.uint64(64 - self.bits)).astype(np.int64)


#: An anchor is hot if it stands for this share of its bucket and at least so often; so a bucket has at most HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 32, 256


def count_pass(buckets: int, sketch: CountMin | None, hot_share: int, hot_least: int):
    """Payloads of anchor_pass, dealt by bucket, to marks of repeated anchors by bucket of their document, and (kind 5) hot anchors."""

    def run(batches):
        singles: list = []
        hashes: list = []
        counts: list = []
        again: list = []
        met = 0
        merged: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, kind, raw in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if kind == 2:
                    yield rows_of(2, [int(unpacked(raw, "i8", "i8", "i8")[1][0]) % buckets], [raw])
                    continue
                if sketch and bucket not in merged:
                    merged[bucket] = sketch.empty()
                if kind == 1:
                    h, n = unpacked(raw, "u8", "i8")
                    again.append((h, n))
                    if sketch:
                        sketch.add(merged[bucket], tuple(sketch.cells(r, h) for r in range(sketch.depth)), n)
                elif sketch:
                    cell, other, back, keys = unpacked(raw, "u1", "u1", "u1", "i8")
                    rows = np.cumsum(from_planes(cell), dtype=np.int64), from_planes(other)
                    sketch.add(merged[bucket], rows)
                    singles.append((bucket, rows, from_planes(back), keys))
                    n = np.ones(len(rows[0]), np.int64)
                else:
                    x = unpacked(raw, "u8", "i8", "i8", "u4", "i8")
                    h, n = x[0], np.ones(len(x[0]), np.int64)
                    singles.append((h, x[1][x[3]], x[2][x[3]], x[4]))
                met += int(n.sum())
                if not sketch:
                    hashes.append(h)
                    counts.append(n)
        if again:
            h, n = (np.concatenate(x) for x in zip(*again, strict=True))
            h, back = np.unique(h, return_inverse=True)
            hot = h[np.bincount(back, n) >= max(hot_least, met / hot_share)]
            if len(hot):
                yield rows_of(5, [0], [packed(hot)])
        if not singles:
            return
        if sketch:
            keys, mark = [], []
            for bucket, rows, back, own in singles:
                more = np.flatnonzero(sketch.estimate(merged[bucket], rows) > 1)
                keys.append(own[back[more]])
                mark.append(bucket << sketch.bits | rows[0][more])
            keys, mark = np.concatenate(keys), np.concatenate(mark)
            yield from found(np.full(len(keys), ANY_ID), keys, mark, buckets)
            return
        h, ids, keys, start = (np.concatenate([x[i] for x in singles]) for i in range(4))
        more = np.flatnonzero(exact_counts(np.concatenate(hashes), np.concatenate(counts), h) > 1)
        yield from found(ids[more], keys[more], start[more], buckets)

    return run


class Lookup:
    """Payloads of one bucket of documents: what belongs to a document."""

    def __init__(self, payloads: list[bytes], *kinds: str):
        parts = [unpacked(p, "i8", "i8", *kinds) for p in payloads]
        self.columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(("i8", "i8", *kinds))]
        order = np.lexsort((self.columns[2], self.columns[0], self.columns[1]))
        self.columns = [c[order] for c in self.columns]

    def of(self, doc_id: int, key: int) -> list[np.ndarray]:
        i, j = np.searchsorted(self.columns[1], [key, key + 1] if key < 2**63 - 1 else [key, key], side="left")
        if key == 2**63 - 1:
            j = len(self.columns[1])
        own = self.columns[0][i:j]
        same = (own == doc_id) | (own == ANY_ID)
        return [c[i:j][same] for c in self.columns[2:]]


def with_payloads(batches, kinds: dict[int, tuple[str, ...]]):
    """Rows sorted by bucket and kind: for each document its text and what the payloads before it in its bucket say."""
    bucket, held, tables = None, {}, {}
    for b in batches:
        cols = [b.column(c) for c in ("bucket", "kind", "doc_id", "rk", "text", "payload")]
        marks, which = cols[0].to_pylist(), cols[1].to_pylist()
        for i in range(b.num_rows):
            if marks[i] != bucket:
                bucket, held, tables = marks[i], {k: [] for k in kinds}, {}
            if which[i] < 99:
                held[which[i]].append(cols[5][i].as_py())
                continue
            if not tables:
                tables = {k: Lookup(held.pop(k), *v) for k, v in kinds.items()}
            doc_id, key = cols[2][i].as_py(), cols[3][i].as_py()
            yield doc_id, key, cols[4][i].as_buffer(), {k: t.of(doc_id, key) for k, t in tables.items()}


def gathered(batches, kinds: dict[int, tuple[str, ...]], most: int = 1 << 18):
    """What with_payloads gives, in lists of documents that make up a chunk."""
    held, size = [], 0
    for row in with_payloads(batches, kinds):
        held.append(row)
        size += row[2].size + 200
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def picked_runs(units: Units, rows: list, k: int, window: int, buckets: int, sketch: CountMin | None):
    """Bytes, offsets and unit arrays of the documents in rows, and the runs of windows with repeated anchors.

    Marks of repeated anchors are the first windows of their runs or cells of the sketch.
    """
    places = [np.unique(r[3][2][0]) for r in rows]
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    offs = np.cumsum([0, *(r[2].size for r in rows)])
    u, cuts, spans = units.read(data, offs)
    doc, start, n, h, anchor = runs(u, cuts, k, window)
    wanted = np.concatenate([(np.int64(i) << 40) | p for i, p in enumerate(places)])
    pick = np.flatnonzero(np.isin((doc << 40) | (sketch.place(h, buckets) if sketch else start), wanted))
    return data, offs, cuts, spans, doc[pick], start[pick], n[pick], h[pick], anchor[pick]


#: Windows around a hot anchor are dealt so many at a time, by what all of them share.
SHARE_BYTES, SHARE_WORDS = 8, 4


def pieces_of(start: int, n: int, anchor: int, share: int) -> list[tuple[int, int, int, int]]:
    """A run cut where the distance to its anchor is a multiple of share: first window, number, and the stretch common to all windows of such a piece, whole or not."""
    out = []
    at = start
    while at < start + n:
        low = (anchor - at) // share * share
        stop = min(start + n, anchor - low + 1)
        out.append((at, stop - at, anchor - low, share - 1))
        at = stop
    return out


def stretch_pass(units: Units, k: int, window: int, buckets: int, hot: frozenset = frozenset(), sketch: CountMin | None = None):
    """Documents with the places of their repeated anchors to payloads of stretches, by anchor; each stretch of a partition once.

    A hot anchor would bring all its surroundings to one bucket. Its runs are cut into pieces of a few windows, by the
    windows' distance from the anchor, and go by a hash of the text that all windows of a piece share: equal windows still
    meet, and different surroundings part.
    """
    share = SHARE_WORDS if units.words else SHARE_BYTES

    def run(batches):
        seen: dict[bytes, tuple] = {}
        size = 0

        def flush():
            groups: dict[int, list] = {}
            for text, (d, key, s, h) in seen.items():
                groups.setdefault(h % buckets, []).append((text, d, key, s, h))
            for b, x in groups.items():
                text, d, key, s, h = zip(*x, strict=True)
                yield rows_of(3, [b], [packed(b"".join(text), np.array([len(t) for t in text], np.int64), np.array(d, np.int64), np.array(key, np.int64), np.array(s, np.int64), np.array(h, np.uint64))])

        for rows in gathered(batches, {2: ("i8",)}):
            rows = [r for r in rows if len(r[3][2][0])]
            if not rows:
                continue
            data, offs, cuts, spans, doc, start, n, h, anchor = picked_runs(units, rows, k, window, buckets, sketch)
            for i, first, m, hash_, p in zip(doc.tolist(), start.tolist(), n.tolist(), h.tolist(), anchor.tolist(), strict=True):
                for at, count, core, less in pieces_of(first, m, p, share) if hash_ in hot else [(first, m, 0, 0)]:
                    text = units.stretch(data, offs, spans, cuts, i, at, count + window - 1)
                    name = xxhash.xxh3_64_intdigest(units.stretch(data, offs, spans, cuts, i, core, window - less)) if less else hash_
                    place = (rows[i][0], rows[i][1], at, name)
                    old = seen.get(text)
                    if old is None:
                        size += len(text) + 150
                        seen[text] = place
                    elif place < old:
                        seen[text] = place
            if size > 64_000_000:
                yield from flush()
                seen, size = {}, 0
        yield from flush()

    return run


#: Bytes of stretches that are put in order at a time; a group of equal anchors stays whole.
AT_ONCE = 2_000_000


def first_pass(group: Callable, window: int, buckets: int):
    """Stretches of a bucket to word on windows that are the first of their kind: place of the stretch and bits for its windows."""

    def firsts(text, lens, ids, keys, start):
        order = np.lexsort((keys, ids))
        new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(new) - 1
        which, offset, kind = group(text, lens, window)
        place = (rank[which] << 40) | (start[which] + offset)
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        low = np.minimum.reduceat(place[order], head)
        keep = order[place[order] == np.repeat(low, np.diff(np.append(head, len(kind))))]
        bits = np.zeros((len(ids), 128), np.uint8)
        bits[which[keep], offset[keep]] = 1
        some = np.flatnonzero(bits.any(axis=1))
        raw = np.packbits(bits[some], axis=1)
        for b, (i, key, s, r) in by_bucket(keys[some] % buckets, ids[some], keys[some], start[some], raw):
            yield rows_of(4, [b], [packed(i, key, s, r)])

    def run(batches):
        parts = [unpacked(raw, "u1", "i8", "i8", "i8", "i8", "u8") for b in batches for raw in b.column("payload").to_pylist()]
        if not parts:
            return
        text, lens, ids, keys, start, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(C.mix(h), kind="stable")
        begin = (np.cumsum(lens) - lens)[order]
        lens, ids, keys, start, h = (x[order] for x in (lens, ids, keys, start, h))
        group_end = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        total = np.cumsum(lens)
        i = 0
        while i < len(h):
            want = np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE)
            j = int(group_end[min(np.searchsorted(group_end, want), len(group_end) - 1)])
            own = lens[i:j]
            at = np.repeat(begin[i:j] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            yield from firsts(text[at], own, ids[i:j], keys[i:j], start[i:j])
            i = j

    return run


def covered(n_units: int, starts: np.ndarray, counts: np.ndarray, at: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Which units are covered by a window that also starts earlier: windows of the runs, but for those marked as first."""
    edge = np.zeros(n_units + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    flag = np.cumsum(edge)[:-1] > 0
    if len(at):
        rows, cols = np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(at), 16), axis=1))
        flag[at[rows] + cols] = False
    w = np.flatnonzero(flag)
    edge[:] = 0
    edge[:-1][w] = 1
    edge[w + window] -= 1
    return np.cumsum(edge)[:-1] > 0


def dedup(docs: DataFrame, scratch: C.Scratch, units: Units, k: int, window: int, group: Callable, finish: Callable, schema: str, sketch: CountMin | None = None) -> DataFrame:
    """Run the three steps on documents and give `finish(doc_id, bytes, removed units)` rows, a row for each document."""
    spark = scratch.spark
    n = C.partitions(spark)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.withColumn("rk", F.xxhash64("doc_id", "text"))
    raw = C.mapped(src, anchor_pass(units, k, window, n, sketch), PACKED)
    counted = scratch.store(C.mapped(raw.repartition(n, "bucket"), count_pass(n, sketch, HOT_SHARE, HOT_LEAST), PACKED), "places")
    places = counted.where("kind = 2")
    # At most HOT_SHARE numbers from each bucket.
    hot = frozenset(h for r in counted.where("kind = 5").collect() for h in unpacked(bytes(r.payload), "u8")[0].tolist())
    del raw
    scratch.release()
    full = src.select(F.pmod("rk", F.lit(n)).cast("int").alias("bucket"), F.lit(99).alias("kind"), "doc_id", "rk", "text", F.lit(None).cast("binary").alias("payload"))

    def beside(*tables: DataFrame) -> DataFrame:
        out = full
        for t in tables:
            out = out.unionByName(t, allowMissingColumns=True)
        return out.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    found_at = C.mapped(beside(places), stretch_pass(units, k, window, n, hot, sketch), PACKED)
    firsts = scratch.store(C.mapped(found_at.repartition(n, "bucket"), first_pass(group, window, n), PACKED), "firsts")
    del found_at
    scratch.release()

    def last(batches):
        rows: list = []
        size = 0
        names = [f.split()[0] for f in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        kinds = [types[f.split()[1]] for f in schema.split(", ")]
        for part in gathered(batches, {2: ("i8",), 4: ("i8", "V16")}):
            some = [i for i, r in enumerate(part) if len(r[3][2][0])]
            gone: list = [None] * len(part)
            if some:
                _, _, cuts, _, doc, start, count, *_ = picked_runs(units, [part[i] for i in some], k, window, n, sketch)
                bounds = np.searchsorted(doc, np.arange(len(some) + 1))
                for j, i in enumerate(some):
                    own = slice(bounds[j], bounds[j + 1])
                    gone[i] = covered(int(cuts[j + 1] - cuts[j]), start[own], count[own], *part[i][3][4], window)
            for (doc_id, _, buf, _), g in zip(part, gone, strict=True):
                row = finish(None if doc_id == C.NULL_ID else doc_id, np.frombuffer(buf, np.uint8), g)
                rows.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= 2000 or size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return C.mapped(beside(places, firsts), last, schema)
