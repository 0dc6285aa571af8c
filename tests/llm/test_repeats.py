import hashlib
import random

import numpy as np
import pytest

from attesta.llm import repeats, substring, suffix


def brute(units, window):
    """units: lists of hashable units by document in order -> removed flags."""
    seen, flags = set(), []
    for doc in units:
        gone = [False] * len(doc)
        for i in range(len(doc) - window + 1):
            w = tuple(doc[i : i + window])
            if w in seen:
                for j in range(i, i + window):
                    gone[j] = True
            seen.add(w)
        flags.append(gone)
    return flags


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    common = text(60)
    docs = [text(r.randint(0, 200)) for _ in range(40)]
    docs += [docs[3], docs[3], docs[5][:400] + text(20) + docs[5][300:]]
    docs += [text(10) + " " + common[r.randint(0, 60) :] + "\n" + text(30) for _ in range(25)]
    docs += ["", None, " ", "a" * 1000, "a" * 350 + "b" + "a" * 350, "xy " * 300, text(5)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_op4_matches_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # nearly every repeated anchor is hot
        monkeypatch.setattr(repeats, "HOT_SHARE", 10**9)
        monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, payload string, bucket int")
    got = {r.doc_id: r for r in suffix.remove_repeated_bytes(df.repartition(3)).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gone in enumerate(brute([list(x) for x in raw], 100)):
        kept = bytes(b for b, g in zip(raw[i], gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("seed", [1, 2])
def test_op8_matches_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(repeats, "HOT_SHARE", 10**9)
        monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # A sketch of 8 cells is full: all windows are estimated repeated, and results are the same.
    got = {r.doc_id: r for r in substring.remove_repeated_words(df.repartition(3), cell_bits=22 if seed == 1 else 3).collect()}
    raw = [(t or "").encode().split() for t in texts]
    for i, gone in enumerate(brute(raw, 20)):
        kept = b" ".join(w for w, g in zip(raw[i], gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(raw[i]), sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeated_bytes(empty).count() == 0
    assert substring.remove_repeated_words(empty).count() == 0
    long = " ".join(str(i) for i in range(100))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in suffix.remove_repeated_bytes(df).collect())
    assert got == [(False, 0, 0), (True, 1, len(long)), (True, 1, len(long)), (True, 2, 0)]


def test_two_stage_orders_suffixes():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 500):
        text = r.integers(97, 100, n).astype(np.uint8)
        order, _ = suffix.two_stage(text, max(8, n))
        raw = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_pieces_are_cut_by_distance_from_the_anchor():
    whole = repeats.pieces_of(10, 30, 45, 8)
    assert [w for at, n, _, _ in whole for w in range(at, at + n)] == list(range(10, 40))
    for start in range(10, 40):
        for n in range(1, 41 - start):
            for at, m, core, less in repeats.pieces_of(start, n, 45, 8):
                for w in range(at, at + m):
                    own = next(p for p in whole if p[0] <= w < p[0] + p[1])
                    assert (core, less) == own[2:] and w <= core and core - w <= less


def test_sketch_never_underestimates_and_turns_single_anchors_away():
    r = np.random.default_rng(3)
    sketch = repeats.CountMin(12)
    parts = [r.integers(0, 2**63, 100).astype(np.uint64) for _ in range(4)]
    parts[2][:30] = parts[0][:30]
    merged = sketch.empty()
    for h in parts:
        rows = tuple(sketch.cells(k, h) for k in range(2))
        sketch.add(merged, rows)
        assert (sketch.estimate(merged, rows) >= 1).all()
    estimates = [sketch.estimate(merged, tuple(sketch.cells(k, h) for k in range(2))) for h in parts]
    assert (estimates[0][:30] > 1).all() and (estimates[2][:30] > 1).all()
    assert (np.concatenate([estimates[0][30:], estimates[1], estimates[2][30:], estimates[3]]) > 1).mean() < 0.05
    x = r.integers(0, 2**32, 50).astype(np.uint32)
    assert (repeats.from_planes(np.frombuffer(repeats.planes(x), np.uint8)) == x).all()


def test_long_texts_in_segments_have_the_same_windows(monkeypatch):
    u = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    u[1500:1600] = u[100:200]
    monkeypatch.setattr(repeats, "POS_BITS", 10)
    monkeypatch.setattr(repeats, "LOW", np.uint64((1 << 10) - 1))
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    doc, start, n, h, anchor = repeats.runs(u, np.array([0, 2500, 2505, 3000]), 10, 20)
    of = {}
    for d, s, m, x, a in zip(doc.tolist(), start.tolist(), n.tolist(), h.tolist(), anchor.tolist()):
        for w in range(s, s + m):
            assert (d, w) not in of and w <= a <= w + 10
            of[d, w] = x
    assert len(of) == 2500 - 19 + 495 - 19
    assert all(of[0, 100 + i] == of[0, 1500 + i] for i in range(81))


def test_ties_of_doc_id(spark):
    """One doc_id with different texts: each row is judged by its own, and of equal windows one stays."""
    words = [f"w{i}" for i in range(600)]
    passage = " ".join(words[:40])
    rows = [(5, passage + " x"), (5, passage + " y"), (7, " ".join(words[100:]) + " " + " ".join(words[100:130])), (8, " ".join(words[300:340]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out, unit, left in ((substring.remove_repeated_words(df), 1, 40), (suffix.remove_repeated_bytes(df), 1, len(passage) + 1)):
        got = sorted((r.doc_id, r.n_removed) for r in out.collect())
        assert [n for d, n in got if d == 5] == [0, left] and dict(got)[7] >= 30 and dict(got)[8] >= 40
