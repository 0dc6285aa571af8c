"""Substring dedup (operator 8): removes words covered by a window of `window` words that also starts earlier.

Partitions add the anchors of their windows (see repeats.py) to a count-min sketch of two rows and send, by bucket, the cells
that are not zero, each with the document that set it. A bucket merges the sketches of all partitions and tells documents
which cells have been counted more than once. Estimates are never too small, so every window that repeats is estimated
repeated; a second pass over the texts sends only those, which are grouped exactly, by their words. The sketch has a share of
fixed width for each bucket, so it grows with the number of buckets, and no task holds more than the shares it merges.

Null texts have no words; texts with fewer words than the window lose nothing; rows that repeat a doc_id with equal
text are one document and give equal rows; other ties of doc_id are ordered by a hash of the text. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import repeats as R

WINDOW = 20
ANCHOR = 10
#: Two rows of 2^22 cells of one byte for each bucket.
CELL_BITS = 22


def equal_windows(text: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the stretches, which are words joined by spaces: its stretch, its place there, and the class of equal windows."""
    ends = np.cumsum(lens)
    words: dict[bytes, int] = {}
    codes, counts = [], np.zeros(len(lens), np.int64)
    raw = text.tobytes()
    for i, (a, b) in enumerate(zip((ends - lens).tolist(), ends.tolist(), strict=True)):
        own = raw[a:b].split(b" ")
        counts[i] = len(own)
        codes += [words.setdefault(w, len(words)) for w in own]
    rank = {1: np.array(codes, np.int64)}

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of pairs, equal if and only if both parts are."""
        return np.unique(a * (b.max() + 1 if len(b) else 1) + b, return_inverse=True)[1]

    span = 1
    while span * 2 <= window:
        r = rank[span]
        rank[span * 2] = pair(r[: len(r) - span], r[span:])
        span *= 2
    have, whole = span, rank[span]
    while have < window:
        span = max(s for s in rank if s <= window - have)
        n = len(rank[1]) - have - span + 1
        whole = pair(whole[:n], rank[span][have : have + n])
        have += span
    stop = np.cumsum(counts)
    begin = stop - counts
    which = np.repeat(np.arange(len(lens)), counts)[: len(whole)]
    at = np.flatnonzero(np.arange(len(whole)) + window <= stop[which])
    return which[at], at - begin[which[at]], whole[at]


def finish(doc_id, data, gone):
    words = data.tobytes().split()
    if gone is not None and gone.any():
        kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    else:
        kept = words
    return doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def finish_text(doc_id, data, gone):
    words = data.tobytes().split()
    kept = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
    return doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cell_bits: int = CELL_BITS, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 or, with texts, kept_text (kept words joined by one space)."""
    if not 1 <= anchor <= window or window - anchor + 1 > 128:
        raise ValueError("anchor must be at most window, and window - anchor under 128")
    scratch = C.Scratch(docs.sparkSession, "substring")
    last = "kept_text string" if texts else "kept_sha256 string"
    return R.dedup(docs, scratch, R.Units(True), anchor, window, equal_windows, finish_text if texts else finish, f"doc_id long, n_words long, n_removed long, {last}", R.CountMin(cell_bits))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, j, w[j] AS word, CASE WHEN j + 19 <= len(w) THEN array_to_string(w[j:j + 19], ' ') END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
f AS (SELECT doc_id, j, word, (win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, j) > 1)::INT AS again FROM u),
g AS (SELECT doc_id, j, word, max(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(C.table(spark, sf_dir, "documents"))
