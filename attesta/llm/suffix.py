"""Suffix-array dedup (operator 4): removes bytes covered by a string of `window` bytes that also starts earlier.

Candidate stretches of text (see repeats.py) are joined in their bucket, and their suffixes are put in order in two
stages: only suffixes smaller than their successors are sorted directly, by eight bytes at a time for as long as they
tie; all others are induced by one scan over the buckets of first bytes. Adjacent suffixes with a common prefix of
`window` bytes or more start equal windows.

Null texts are empty; texts shorter than the window lose nothing; rows that repeat a doc_id with equal text are one
document and give equal rows; other ties of doc_id are ordered by a hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import repeats as R

WINDOW = 100
ANCHOR = 24


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that orders as they do; zeros after the end."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= padded[j : n + j] << np.uint64(56 - 8 * j)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    out = np.zeros(n, bool)
    has = nearest < len(change)
    c = change[nearest[has]]
    out[has] = text[c + 1] > text[c]
    return out


def direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first `depth` bytes."""
    n = len(words)
    at = at[np.argsort(words[at], kind="stable")]
    w = words[at]
    new = np.append(True, w[1:] != w[:-1])
    tied = np.arange(len(at))
    done = 8
    while done < depth and len(tied):
        # Only places whose words so far equal a neighbour's go on.
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tied)))
        group = np.repeat(np.arange(len(start)), size)
        more = np.repeat(size, size) > 1
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        p = at[tied] + done
        w = np.where(p < n, words[np.minimum(p, n - 1)], 0)
        order = np.lexsort((w, group))
        at[tied] = at[tied][order]
        w, group = w[order], group[order]
        new = np.append(True, (w[1:] != w[:-1]) | (group[1:] != group[:-1]))
        done += 8
    return at


def needed_for(small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes from starts to ends (inclusive), and those from which the last of them are induced."""
    n = len(small)
    direct = np.append(np.flatnonzero(small), n - 1)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, direct[np.searchsorted(direct[:-1], ends)] + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def two_stage(text: np.ndarray, depth: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (all, or those from starts to ends) in the order of their first `depth` bytes at least, and words_at(text)."""
    n = len(text)
    words = words_at(text)
    if not n:
        return np.zeros(0, np.int64), words
    small = smaller_than_next(text)
    induced = ~small
    if starts is not None:
        needed = needed_for(small, starts, ends)
        induced &= needed
        small &= needed
    direct = direct_sort(np.flatnonzero(small), words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        queue[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cut):
            queue[text[part[0]]].append(part)

    for c in range(256):
        i = 0
        while i < len(queue[c]):
            out.append(queue[c][i])
            induce(queue[c][i])
            i += 1
        queue[c] = []
        part = direct[bounds[c] : bounds[c + 1]]
        if len(part):
            out.append(part)
            induce(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64), words


def equal_windows(text: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the stretches: its stretch, its place there, and the class of equal windows."""
    ends = np.cumsum(lens)
    starts = ends - lens
    order, words = two_stage(text, window, starts, ends - window)
    which = np.repeat(np.arange(len(lens)), lens)
    order = order[order + window <= ends[which[order]]]
    a, b = order[:-1], order[1:]
    # The common prefix of neighbours, eight bytes at a time; the last step overlaps so as to end at the window.
    same = np.arange(len(a))
    for step in [*range(0, window - 7, 8), window - 8]:
        same = same[words[a[same] + step] == words[b[same] + step]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    return which[order], order - starts[which[order]], np.cumsum(new)


def finish(doc_id, data, gone):
    if gone is None or not gone.any():
        return doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest()
    spans = int((gone & ~np.append(False, gone[:-1])).sum())
    return doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def finish_text(doc_id, data, gone):
    """The kept text; bytes of a character that was cut through are dropped from it."""
    kept = data if gone is None else data[~gone]
    return doc_id, len(data), 0 if gone is None else int(gone.sum()), kept.tobytes().decode("utf-8", "ignore")


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed and either n_spans and kept_sha256 or, with texts, kept_text. window: 8 to 105 bytes more than half of anchor."""
    if not 8 <= anchor <= window - 1 or window - anchor + 1 > 128:
        raise ValueError("anchor must be 8 or more, and window - anchor under 128")
    scratch = C.Scratch(docs.sparkSession, "suffix")
    if texts:
        return R.dedup(docs, scratch, R.Units(False), anchor, window, equal_windows, finish_text, "doc_id long, n_bytes long, n_removed long, kept_text string")
    return R.dedup(docs, scratch, R.Units(False), anchor, window, equal_windows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, j, substr(h, 2 * j - 1, 2) AS b, CASE WHEN 2 * j + 198 <= length(h) THEN md5(substr(h, 2 * j - 1, 200)) END AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS j FROM d)),
f AS (SELECT doc_id, j, b, (win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, j) > 1)::INT AS again FROM u),
g AS (SELECT doc_id, j, b, max(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 AS opens FROM g),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n, count(*) FILTER (WHERE opens) AS spans, string_agg(b, '' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(k.n, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(C.table(spark, sf_dir, "documents"))
