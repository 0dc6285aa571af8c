"""Toxicity (operator 3): non-negative positive-unlabelled learning on words and word beginnings.

Learns from texts confirmed as toxic and from texts of which nothing is known, by the risk
    prior * E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - prior * E_P[l(f, 0)])
with logistic loss l; where the bracket falls below zero the step goes uphill on it (Kiryo et al., 2017). f is linear in the
presence of features chosen by how much more often P has them than U. Each step sees the whole sample: a batch of some
hundred texts holds so few unknown toxic ones that its bracket is below zero by chance, and such steps undo what the others
have learnt. Only the text is an input of the score.

Rows to learn from are those whose crc32 of doc_id as text is not 0 modulo 5. The sample is bounded: about POSITIVES
confirmed and UNLABELLED other ids, picked by a hash, of which each gives one text (rows that repeat an id give that with the
smallest hash). Features to choose from are the CANDIDATES that most confirmed texts of the sample have; FEATURES of them at
most are used, and what is collected is which texts of the sample have them. Every text is scored whole.

Null texts are empty; an empty text gets the score of no features; with no confirmed example the score is 0 for all. Rows
with a null doc_id teach nothing; rows that repeat a doc_id are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

POSITIVES, UNLABELLED, FEATURES, CANDIDATES = 4000, 12000, 16384, 131072
LEAST_SEEN = 5
LIFT = 1.5
BEGINNINGS = (4, 5, 6)
#: Steps of the fit: ROUNDS for each SHARE texts of the sample.
ROUNDS, SHARE, RATE, DECAY = 30, 512, 0.02, 1e-4

#: Bytes that are no part of a word: ASCII but letters and digits.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit feature for all words and beginnings of words."""
    data = FOLD[data]
    starts, ends, cuts = C.word_spans(data, offs, BREAK)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(cuts))
    codes, docs = [C.span_hashes(data, starts, ends)], [doc]
    lens = ends - starts
    head = np.zeros(len(starts), np.uint64)
    for j in range(max(BEGINNINGS)):
        head |= np.where(lens > j, data[np.minimum(starts + j, len(data) - 1)] if len(data) else 0, 0).astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in BEGINNINGS:
            long = lens > j + 1
            codes.append(C.mix((head | np.uint64((j + 1) << 56))[long]))
            docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(codes)


class Vocabulary:
    """Places of known features, behind a bitmap that turns most unknown ones away."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def present(self, docs: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and place of the known features, each once for a document."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.filter[(codes >> np.uint64(44)).astype(np.int64)])
        docs, codes = docs[some], codes[some]
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        hit = self.known[at] == codes
        both = np.unique(docs[hit] * len(self.known) + at[hit])
        return both // len(self.known), both % len(self.known)


def chunks_of(batches, *names):
    for b in batches:
        data, offs = C.buffers(b.column("text"))
        for i, j in C.chunks(offs, 1 << 19):
            yield [b.column(c)[i:j] for c in names], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and place of each feature that is present, and the number of texts."""
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), at, len(rows)


def gradient(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, bool]:
    """The direction to step against for weights w, the offset last; and whether the bracket of the risk is below zero.

    Above zero it is the gradient of the risk, below it that of the bracket, turned round: the step goes uphill on it.
    """
    return slope_of(w, stacked(positive), stacked(unlabelled), prior)


def slope_of(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[np.ndarray, bool]:
    """The same for texts that have been stacked."""
    n = len(w) - 1
    out = np.zeros(n + 1)
    doc_p, at_p, k_p = positive
    doc_u, at_u, k_u = unlabelled
    f_p, f_u = np.bincount(doc_p, w[at_p], k_p) + w[n], np.bincount(doc_u, w[at_u], k_u) + w[n]

    def add(doc, at, slope):
        out[:n] += np.bincount(at, slope[doc], n)
        out[n] += slope.sum()

    # l(f, 0) = log(1 + e^f) and l(f, 1) = l(f, 0) - f; the slope of l(f, 0) is the sigmoid.
    below = bool(np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean() < 0)
    sign = -1 if below else 1
    add(doc_u, at_u, sign * sigmoid(f_u) / k_u)
    add(doc_p, at_p, -sign * prior * sigmoid(f_p) / k_p)
    if not below:
        add(doc_p, at_p, prior * (sigmoid(f_p) - 1) / k_p)
    return out, below


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative risk of the sample, by Adam."""
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    p, u = stacked(positive), stacked(unlabelled)
    steps = ROUNDS * max(1, -(-(len(positive) + len(unlabelled)) // SHARE))
    for t in range(1, steps + 1):
        g, _ = slope_of(w, p, u, prior)
        g[:n] += DECAY * w[:n]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Known features, weights and offset. Nothing is learnt from held-out rows."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    marks = labels.select(F.col("doc_id").alias("labelled"), "toxic").where("labelled is not null and toxic is not null").where(~held_out(F.col("labelled")))
    marks = marks.groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    counts = marks.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("*").alias("n")).first()
    if not counts.p:
        return None
    prior = min(max(counts.p / counts.n, 1e-4), 0.9)
    total = own.agg(F.count("*")).first()[0]
    # A hash of the id in 0..1 decides which ids are in the sample, so their number is about what is asked for at most.
    chance = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    one = lambda rows, p: rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", F.lit(p).alias("p"))
    # Only ids of confirmed texts below the sampling rate are looked up, so the side that is broadcast has a known size.
    confirmed = marks.where((F.col("toxic") == 1) & (chance("labelled") < min(1.0, positives / counts.p))).select("labelled")
    sample_p = one(own.join(F.broadcast(confirmed), own.doc_id == F.col("labelled")), 1)
    sample_u = one(own.where(chance("doc_id") < min(1.0, unlabelled / max(total, 1))), 0)
    scratch = C.Scratch(docs.sparkSession, "toxicity")
    sample = scratch.store(sample_p.unionByName(sample_u).repartition(max(1, min(64, (positives + unlabelled) // 500))), "sample")

    def tally(batches):
        total: dict[int, int] = {}
        for _, data, offs in chunks_of(batches):
            doc, code = features(data, offs)
            pairs = np.unique(np.stack([code, doc.astype(np.uint64)], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
            kinds, seen = np.unique(pairs[:, 0], return_counts=True)
            for k, n in zip(kinds.view(np.int64).tolist(), seen.tolist(), strict=True):
                total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["code", "n"])

    n_p, n_u = (sample.where(f"p = {k}").count() for k in (1, 0))
    if not n_p or not n_u:
        return None
    # Candidates are features of enough confirmed texts: at most features-of-the-sample / least of them.
    least = min(LEAST_SEEN, max(1, n_p // 20))
    tallied = C.mapped(sample.where("p = 1").select("text"), tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    candidates = tallied.where(F.col("n") >= least).orderBy(F.desc("n"), "code").limit(CANDIDATES).toArrow()
    known = Vocabulary(candidates.column("code").to_numpy().view(np.uint64))

    def share(batches):
        in_p, in_u = (np.zeros(len(known.known), np.int64) for _ in range(2))
        for (p,), data, offs in chunks_of(batches, "p"):
            doc, at = known.present(*features(data, offs), len(offs) - 1)
            is_p = p.to_numpy(zero_copy_only=False)[doc] == 1
            in_p += np.bincount(at[is_p], minlength=len(in_p))
            in_u += np.bincount(at[~is_p], minlength=len(in_u))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(in_p))), pa.array(in_p), pa.array(in_u)], ["at", "in_p", "in_u"])

    # One row for each candidate.
    shares = C.mapped(sample, share, "at long, in_p long, in_u long").groupBy("at").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).orderBy("at").toArrow()
    chosen = known.known[choose(shares.column("in_p").to_numpy(), shares.column("in_u").to_numpy(), n_p, n_u)]
    words = Vocabulary(chosen)

    def presence(batches):
        for (p,), data, offs in chunks_of(batches, "p"):
            n = len(offs) - 1
            doc, at = words.present(*features(data, offs), n)
            bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([p, pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32)))], ["p", "at"])

    rows = C.mapped(sample, presence, "p int, at array<int>").toArrow()
    scratch.drop(sample)
    mark = rows.column("p").to_numpy()
    lists = [x.values.to_numpy() for x in rows.column("at").combine_chunks()]
    order = sorted(range(len(lists)), key=lambda i: (lists[i].tolist(), mark[i]))
    positive, other = ([lists[i] for i in order if mark[i] == k] for k in (1, 0))
    return chosen, *fit(positive, other, len(chosen), prior)


def choose(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features whose share of P is surely above their share of U: by a lower bound of 2.5 standard errors of the difference."""
    p, u = in_p / n_p, (in_u + 1) / n_u
    sure = p - 2.5 * np.sqrt(p / n_p + u / n_u)
    good = np.flatnonzero(sure > LIFT * u)
    return np.sort(good[np.argsort(-(sure / u)[good], kind="stable")[:FEATURES]])


def scored(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and score double."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    known, w, offset = model

    def run(batches):
        vocabulary = Vocabulary(known)
        for own, data, offs in chunks_of(batches, *keep):
            n = len(offs) - 1
            doc, at = vocabulary.present(*features(data, offs), n)
            score = sigmoid(np.bincount(doc, w[at], n) + offset)
            yield pa.RecordBatch.from_arrays([*own, pa.array(score)], [*keep, "score"])

    if "text" in keep:
        src = docs.select(*keep)
    else:
        src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return C.mapped(src, run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", score double")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. labels: doc_id, toxic."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
