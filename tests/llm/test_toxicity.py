import random
import zlib

import numpy as np
import pytest

from attesta.llm import toxicity as T


def risk(w, positive, unlabelled, prior):
    """By the formula, text by text."""
    loss = lambda f, y: np.log1p(np.exp(-f if y else f))
    f = lambda x: w[x].sum() + w[-1]
    p1, p0 = (np.mean([loss(f(x), y) for x in positive]) for y in (1, 0))
    u0 = np.mean([loss(f(x), 0) for x in unlabelled])
    return prior * p1, u0 - prior * p0


def some(seed, n=12):
    r = np.random.default_rng(seed)
    rows = lambda k: [np.sort(r.choice(n, r.integers(0, 6), replace=False)) for _ in range(k)]
    return r.normal(size=n + 1), rows(9), rows(14)


def case(seed):
    w, positive, unlabelled = some(seed)
    if seed < 3:
        return w, positive, unlabelled, 0.3
    # Confirmed texts that seem toxic, unlabelled ones without features and a large prior: the bracket is below zero.
    w[:12] = np.abs(w[:12])
    return w, [np.arange(12)] * 4, [x[:0] for x in unlabelled], 0.95


@pytest.mark.parametrize("seed", range(6))
def test_gradient_is_that_of_the_non_negative_risk(seed):
    w, positive, unlabelled, prior = case(seed)
    g, below = T.gradient(w, positive, unlabelled, prior)
    assert below == (risk(w, positive, unlabelled, prior)[1] < 0)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        (a1, b1), (a0, b0) = risk(w + step, positive, unlabelled, prior), risk(w - step, positive, unlabelled, prior)
        slope = -(b1 - b0) / 2e-6 if below else (a1 + b1 - a0 - b0) / 2e-6
        assert abs(slope - g[i]) < 1e-6


def test_both_kinds_of_step_occur():
    assert {T.gradient(*case(seed))[1] for seed in range(6)} == {True, False}


def corpus(n=900):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    rude = ["vilescum", "rotbrain", "filthlord", "trashgob"]
    texts, labels = [], {}
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(rude))
        texts.append((i, " ".join(words), "s"))
        if r.random() < 0.7:
            labels[i] = int(toxic)
    return texts, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op3_held_out_accuracy_and_held_out_labels_are_not_used(spark):
    texts, labels = corpus()
    odd = [(5000, None, "s"), (5001, "", "s"), (None, "vilescum rotbrain", "s"), (5002, "vilescum " * 40_000, "s"), (5002, "calm words", "s"), (5003, "x" * 300_000, "s")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, score string").repartition(4)
    frame = lambda d: spark.createDataFrame([*d.items(), (None, 1), (7777, None)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, frame(labels)).collect()
    assert len(got) == len(texts) + len(odd)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [i for i, *_ in texts if held(i)]
    assert sum(by[i].predicted == (i % 6 == 0) for i in out) / len(out) > 0.95
    assert by[5000].score == by[5001].score < 0.5
    assert {r.score for r in got if r.doc_id == 5002} != {by[5001].score}
    flipped = {i: 1 - y if held(i) else y for i, y in labels.items()}
    again = {r.doc_id: r.score for r in T.score_toxicity(docs.repartition(3), frame(flipped)).collect() if r.doc_id != 5002}
    assert all(again[i] == pytest.approx(by[i].score, abs=1e-9) for i in again)


def test_empty_and_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in T.score_toxicity(docs, none).collect()] == [(0.0, 0)] * 2
    assert T.score_toxicity(docs.limit(0), spark.createDataFrame([(2, 1)], "doc_id long, toxic int")).count() == 0


def test_fit_finds_texts_with_few_rude_words():
    """Ten rude words, never in clean texts, one to eight in a toxic one; a tenth of the unlabelled texts are toxic."""
    r = np.random.default_rng(5)
    toxic = lambda k: [np.unique(np.append(r.integers(0, 10, r.integers(1, 9)), 10 + r.integers(0, 200, 3))) for _ in range(k)]
    clean = lambda k: [np.unique(10 + r.integers(0, 200, 3)) for _ in range(k)]
    w, offset = T.fit(toxic(2000), toxic(1000) + clean(9000), 210, 0.1)
    hit = lambda rows: np.mean([w[x].sum() + offset >= 0 for x in rows])
    assert hit(toxic(2000)) >= 0.85 and hit(clean(2000)) <= 0.02
