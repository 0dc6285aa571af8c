import random

import numpy as np
import xxhash

from attesta.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, fps):
    comp = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if bin(a ^ b).count("1") <= 2 and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    return comp


def test_op5_matches_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    base = [[r.choice(vocab) for _ in range(150)] for _ in range(30)]
    texts = []
    for b in base:
        for _ in range(r.randint(1, 8)):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = r.choice(vocab)
            texts.append(" ".join(c))
    texts += ["", None, " \n", "One", "one", "one TWO", "É é x y", texts[0], texts[0].upper()]
    r.shuffle(texts)
    df = spark.createDataFrame([(i + 5, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    ids = [i + 5 for i in range(len(texts))]
    fps = [slow_fingerprint(t) for t in texts]
    comp = slow_components(ids, fps)
    assert len(set(comp.values())) < len(set(fps))
    assert {i: (got[i].fingerprint, got[i].component_id) for i in ids} == {i: (f"{f:016x}", comp[i]) for i, f in zip(ids, fps)}


def test_crowded_values_lose_no_pair(spark, monkeypatch):
    r = np.random.default_rng(5)
    center = int(r.integers(0, 2**63))
    fps = {center}
    for _ in range(300):
        fps.add(center ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    parts = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    hist = [np.bincount(simhash.gather(simhash.bits_of(fps), p), minlength=1 << 16) for p in parts]
    for crowded in (1, 20, 5000):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        chosen, landing = simhash.thresholds(hist, 2)
        assert sum(chosen) == 2 - 4 + 1
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])
        out = list(simhash.probe(parts, chosen, landing)([batch]))
        groups = {}
        for b in out:
            for k, f in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist()):
                groups.setdefault(k, set()).add(f)
        share = {(a, b) for g in groups.values() for a in g for b in g if a < b}
        want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(int(a) ^ int(b)).count("1") <= 2}
        assert want and want <= share


def test_close_pairs_forms_agree():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 1 << 13, 3500).astype(np.uint64))
    from attesta.llm.common import local_components

    a = local_components(*simhash.close_pairs(fps[:2500], 2), 2500)
    big = np.unique(np.concatenate([fps, (np.arange(4000, dtype=np.uint64) << np.uint64(20))]))
    b = local_components(*simhash.close_pairs(big, 2), len(big))
    assert len(set(a.tolist())) == 1 and b[0] == 0


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "One two three four"), (4, "one two three four"), (4, "one two three four"), (4, "something else here"), (2, None), (7, ""), (3, "Something  else here")]
    got = sorted((x.doc_id or 0, x.fingerprint, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    a, b, z = (f"{slow_fingerprint(t):016x}" for t in ("one two three four", "something else here", ""))
    assert got == sorted([(0, a, None), (4, a, None), (4, a, None), (4, b, 3), (3, b, 3), (2, z, 2), (7, z, 2)], key=lambda x: x[:2])
