"""Line dedup (operator 10): fuzzy lines by MinHash; of each component of similar lines the first stays.

Lines are what stands between line feeds, without white space around them; blank lines are left alone. Two lines are
linked if the Jaccard similarity of their sets of SHINGLE-character shingles (a shorter line is one shingle) is at least
SIMILARITY. Candidates share one of BANDS bands of ROWS minimal hashes (a pair at 0.8 is found with 99.98 %) and are
verified on their sets of shingles, by 64-bit hashes. Equal lines are one node, named by a 64-bit hash.

The lines that share a band are a group, which groups.py compares: every pair of a group is compared exactly, turned away by
a bound, or in one class without it. Components come from distributed star contraction; the line kept is that of
the smallest (doc_id, hash of the text, line number). Of a line, or a class of lines, that repeats within a partition, only
the first place leaves it, so a line that stands in a third of all rows is one entry from each partition.

Null texts are one blank line; rows that repeat a doc_id with equal text are one document and give equal rows. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .groups import Asked, similar_links
from .repeats import PACKED, by_bucket, packed, rolling, rows_of, unpacked

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 12, 3
#: Buckets of band keys for each partition; one is held in memory at a time, with 12 bytes for each line and band.
SLICES = 4
#: Lines after which a partition sends what it has gathered.
FLUSH = 200_000
WHITE = " \t\r\x0b\x0c"


def lines_of(text: str) -> list[str]:
    return [x.strip(WHITE) for x in text.split("\n")]


def name_of(line: str) -> int:
    """A signed 64-bit name."""
    x = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle, repeats included, and where each line's begin, and the end."""
    lens = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    short = lens < SHINGLE
    if short.any():
        # A short line is one shingle: it is filled up with codes that are no characters.
        filled = np.where(short, SHINGLE, lens)
        out = np.full(int(filled.sum()), 1 << 40, np.uint64)
        first = np.cumsum(filled) - filled
        out[np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(len(codes))] = codes
        codes, lens = out, filled
    h = rolling(codes, SHINGLE)
    # The last SHINGLE - 1 places of a line start no shingle of it.
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(lens)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return h[inside[: len(h)]], np.append(0, np.cumsum(lens - SHINGLE + 1))


_SEEDS = C.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_ADD, _ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32), (_SEEDS.astype(np.uint32) | np.uint32(1))


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line, as many rows as lines."""
    h, at = shingle_hashes(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(h)
    keys = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            np.multiply(h, _ODD[r], out=x)
            x += _ADD[r]
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at[:-1]))
        keys[:, b] = key
    return keys


def signatures(buckets: int):
    """Different lines of a partition to payloads (half a key, name), by bucket of the key.

    Two keys of a bucket that agree in that half are one group; comparing more lines does no harm.
    """

    def run(batches):
        seen: set[int] = set()
        todo: list[str] = []
        names: list[int] = []
        keys: list[np.ndarray] = []
        size = 0

        def sign():
            nonlocal todo, size
            if todo:
                keys.append(band_keys(todo))
            todo, size = [], 0

        def flush():
            k = np.concatenate(keys).ravel()
            n = np.repeat(np.array(names, np.int64), BANDS)
            half = (k >> np.uint64(32)).astype(np.uint32)
            k %= np.uint64(1 << 32)
            k %= np.uint64(buckets)
            out = [(b, packed(own, name)) for b, (own, name) in by_bucket(k.astype(np.int32), half, n)]
            for i in range(0, len(out), 64):
                yield rows_of(0, *zip(*out[i : i + 64], strict=True))

        for b in batches:
            for text in b.column("text").to_pylist():
                for line in lines_of(text):
                    if line and (name := name_of(line)) not in seen:
                        seen.add(name)
                        names.append(name)
                        todo.append(line)
                        size += len(line)
                        if size > 1 << 15:
                            sign()
                if len(names) > FLUSH:
                    sign()
                    yield from flush()
                    names, keys = [], []
                    seen.clear()
        sign()
        if names:
            yield from flush()

    return run


def by_slice(batches, *kinds: str):
    """Payloads sorted by bucket: the arrays of one bucket at a time."""
    bucket, held = None, []
    for b in batches:
        for k, raw in zip(b.column("bucket").to_pylist(), b.column("payload"), strict=True):
            if k != bucket and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            bucket = k
            held.append(unpacked(raw.as_buffer().to_pybytes(), *kinds))
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def candidates(batches):
    """Payloads of buckets to rows (group, name, seen, size): the lines of each band of more than one, named by a sum over them.

    seen: how many partitions have sent the line. Of a family of edited copies the most widespread one is the original, to
    which the others are close.
    """
    for key, name in by_slice(batches, "u4", "i8"):
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
        sent = np.diff(np.append(first, len(key)))
        key, name = key[first], name[first]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        group = np.repeat(np.add.reduceat(C.mix(name.view(np.uint64)), start), size).view(np.int64)
        size = np.repeat(size, size)
        at = np.flatnonzero(size > 1)
        for i in range(0, len(at), 100_000):
            own = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(group[own]), pa.array(name[own]), pa.array(sent[own].astype(np.int32)), pa.array(size[own])], ["group", "name", "seen", "size"])


def decoded_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes([x.decode("utf-8", "surrogatepass") for x in lines])


def link_lines(src: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(u, v): v is the least name of the class of line u, for lines of src (doc_id, text, rk) that are not the least themselves."""
    spark = scratch.spark
    n = C.partitions(spark)
    dealt = C.mapped(src.select("text"), signatures(SLICES * n), PACKED).repartition(n, "bucket").sortWithinPartitions("bucket")
    every = C.mapped(dealt, candidates, "group long, name long, seen int, size long")
    # The same lines share several bands; groups of equal lines are one.
    members = scratch.store(every.groupBy("group", "name").agg(F.max("seen").alias("seen"), F.max("size").alias("size")), "members", few=True)
    asked = members.select("name").distinct()
    known = Asked(asked)

    def asked_lines(batches):
        sent: set[int] = set()
        for b in batches:
            own = [x for text in b.column("text").to_pylist() for x in lines_of(text) if x]
            names = np.array([name_of(x) for x in own], np.int64)
            some = np.flatnonzero(known.has(names))
            found = {n: own[i] for n, i in zip(names[some].tolist(), some.tolist(), strict=True) if n not in sent}
            sent = sent | found.keys() if len(sent) < FLUSH else set(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["name", "text"])

    texts = C.mapped(src.select("text"), asked_lines, "name long, text string").join(asked, "name", "left_semi").dropDuplicates(["name"])
    texts = scratch.store(texts, "texts", few=True)
    low = C.components(similar_links(members, texts, decoded_hashes, SIMILARITY, n), scratch)
    scratch.drop(texts)
    scratch.drop(members)
    return low


def others(group: np.ndarray, ids: np.ndarray, keys: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in groups: the first place of each group, and all that are at other places. Equal places are one."""
    order = np.lexsort((line, keys, ids, group))
    g = group[order]
    new = np.append(True, g[1:] != g[:-1])[: len(g)]
    first = order[np.flatnonzero(new)]
    mine = first[np.cumsum(new) - 1] if len(g) else first
    return first, order[(ids[order] != ids[mine]) | (keys[order] != keys[mine]) | (line[order] != line[mine])]


def send(kind: int, by: np.ndarray, buckets: int, *columns: np.ndarray):
    out = [(b, packed(*own)) for b, own in by_bucket((by.view(np.uint64) % np.uint64(buckets)).astype(np.int64), *columns)]
    for i in range(0, len(out), 64):
        yield rows_of(kind, *zip(*out[i : i + 64], strict=True))


#: Kinds of payloads: first places of lines (name, document, line), classes of lines (name, class), first places of classes, lines that go.
PLACE, CLASS, ROOT, GONE = range(4)


def place_lines(n: int):
    """Documents to the first place of each line of a partition, by bucket of its name, and to places of lines that go."""

    def run(batches):
        held: list[list] = [[], [], []]
        docs: list[list] = [[], []]

        def flush():
            name, doc, line = (np.array(x, np.int64) for x in held)
            ids, keys = (np.array(x, np.int64)[doc] for x in docs)
            first, gone = others(name, ids, keys, line)
            yield from send(PLACE, name[first], n, name[first], ids[first], keys[first], line[first])
            yield from send(GONE, keys[gone], n, ids[gone], keys[gone], line[gone])

        for b in batches:
            for doc_id, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rk", "text")), strict=True):
                for i, line in enumerate(lines_of(text)):
                    if line:
                        held[0].append(name_of(line))
                        held[1].append(len(docs[0]))
                        held[2].append(i)
                docs[0].append(doc_id)
                docs[1].append(key)
                if len(held[0]) > FLUSH:
                    yield from flush()
                    held, docs = [[], [], []], [[], []]
        if held[0]:
            yield from flush()

    return run


def send_classes(n: int):
    """(u, v) to payloads: the class of each line of one, those named by themselves included."""

    def run(batches):
        for b in batches:
            u, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            root = np.unique(v)
            yield from send(CLASS, np.append(u, root), n, np.append(u, root), np.append(v, root))

    return run


def first_of_names(n: int):
    """Payloads of a bucket of names to the first place of each class, by bucket of the class, and to places of lines that go."""

    def run(batches):
        held: dict[int, list] = {PLACE: [], CLASS: []}
        for b in batches:
            for kind, raw in zip(b.column("kind").to_pylist(), b.column("payload"), strict=True):
                held[kind].append(unpacked(raw.as_buffer().to_pybytes(), *["i8"] * (4 if kind == PLACE else 2)))
        if not held[PLACE]:
            return
        name, ids, keys, line = (np.concatenate(x) for x in zip(*held[PLACE], strict=True))
        group, linked = name.copy(), np.zeros(len(name), bool)
        if held[CLASS]:
            u, v = (np.concatenate(x) for x in zip(*held[CLASS], strict=True))
            u, at = np.unique(u, return_index=True)
            v = v[at]
            at = np.minimum(np.searchsorted(u, name), len(u) - 1)
            linked = u[at] == name
            group[linked] = v[at[linked]]
        first, gone = others(group, ids, keys, line)
        first = first[linked[first]]
        yield from send(ROOT, group[first], n, group[first], ids[first], keys[first], line[first])
        yield from send(GONE, keys[gone], n, ids[gone], keys[gone], line[gone])

    return run


def first_of_classes(n: int):
    def run(batches):
        held = [unpacked(raw.as_buffer().to_pybytes(), *["i8"] * 4) for b in batches for raw in b.column("payload")]
        if held:
            group, ids, keys, line = (np.concatenate(x) for x in zip(*held, strict=True))
            _, gone = others(group, ids, keys, line)
            yield from send(GONE, keys[gone], n, ids[gone], keys[gone], line[gone])

    return run


def by_document(batches):
    """Payloads of places to one row (doc_id, rk, gone) for each document."""
    held = [unpacked(raw.as_buffer().to_pybytes(), "i8", "i8", "i8") for b in batches for raw in b.column("payload")]
    if not held:
        return
    ids, keys, line = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((line, ids, keys))
    ids, keys, line = ids[order], keys[order], line[order]
    start = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    for i in range(0, len(start), 20_000):
        own = start[i : i + 20_000]
        ends = np.append(start, len(ids))[i : i + 20_000 + 1]
        gone = pa.ListArray.from_arrays(pa.array((ends - ends[0])[: len(own) + 1].astype(np.int32)), pa.array(line[ends[0] : ends[len(own)]].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(keys[own]), gone], ["doc_id", "rk", "gone"])


def surplus_lines(src: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(doc_id, rk, gone): numbers of the lines that a document loses. src: doc_id, text, rk."""
    n = C.partitions(scratch.spark)
    low = link_lines(src, scratch)
    placed = scratch.store(C.mapped(src, place_lines(n), PACKED), "places")
    names = placed.where(F.col("kind") == PLACE).unionByName(C.mapped(low, send_classes(n), PACKED))
    named = scratch.store(C.mapped(names.repartition(n, "bucket"), first_of_names(n), PACKED), "firsts", few=True)
    roots = named.where(F.col("kind") == ROOT).repartition(n, "bucket")
    gone = C.mapped(roots, first_of_classes(n), PACKED)
    for t in (placed, named):
        gone = gone.unionByName(t.where(F.col("kind") == GONE))
    out = scratch.store(C.mapped(gone.repartition(n, "bucket"), by_document, "doc_id long, rk long, gone array<int>"), "gone", few=True)
    for t in (placed, named, low):
        scratch.drop(t)
    return out


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return src.withColumn("rk", F.xxhash64("doc_id", "text"))


def without_lines(src: DataFrame, gone: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, the columns in keep, n_lines, n_removed and kept_text of src: the lines that stay, as they stand."""
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("rk").alias("g_rk"), "gone").hint("shuffle_hash")
    both = src.join(g, (F.col("doc_id") == F.col("g_id")) & (F.col("rk") == F.col("g_rk")), "left")
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches):
        for b in batches:
            total, removed, texts = [], [], []
            for text, numbers in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                parts = text.split("\n")
                out = set(numbers or ())
                total.append(len(parts))
                removed.append(len(out))
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in out) if out else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in keep), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", *keep, "n_lines", "n_removed", "kept_text"])

    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), "n_lines long, n_removed long, kept_text string"])
    return C.mapped(both.select("doc_id", *keep, "text", "gone"), run, schema)


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text and further columns of docs, for each row."""
    scratch = C.Scratch(docs.sparkSession, "lines")
    gone = surplus_lines(keyed(docs), scratch)
    out = without_lines(keyed(docs, *keep), gone, keep)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NULL_ID)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept lines joined by line feeds."""
    out = dedup_lines(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def keep_first_lines(texts: list[tuple[int, str]]) -> dict[int, list[str]]:
    """What the operator keeps, by comparing all pairs of lines: for tests and small tables. texts: (doc_id, text) in order."""
    places = [(d, i, x) for d, t in texts for i, x in enumerate(lines_of(t)) if x]
    kinds = list(dict.fromkeys(x for *_, x in places))
    sets = [shingles(x) for x in kinds]
    u, v = [], []
    for i, p in enumerate(sets):
        for j in range(i):
            both = len(p & sets[j])
            if both >= SIMILARITY * (len(p) + len(sets[j]) - both):
                u.append(i)
                v.append(j)
    label = dict(zip(kinds, C.local_components(np.array(u, np.int64), np.array(v, np.int64), len(kinds)).tolist(), strict=True))
    seen, gone = set(), set()
    for d, i, x in places:
        if label[x] in seen:
            gone.add((d, i))
        seen.add(label[x])
    return {d: [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] for d, t in texts}
