import numpy as np

from attesta.llm import embeddings


def test_op1_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP_BYTES", 100 * 48)
    monkeypatch.setattr(embeddings, "HELD_LINKS", 50)
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 24))
    rows = [(c + r.normal(size=24) * r.uniform(0.05, 0.5)).tolist() for c in centers for _ in range(25)]
    rows += [rows[0]] * 40 + [[x * 7 for x in rows[3]], [x * 1e-200 for x in rows[4]], [x * 1e200 for x in rows[4]]]
    rows += [None, [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [1.0] * 23, [], [1.0, 2.0], [1.0, 2.01], [-1.0, 2.0]]
    order = r.permutation(len(rows))
    rows = [rows[i] for i in order]
    df = spark.createDataFrame([(i + 3, v, "z") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, e string")
    got = {x.vec_id: x for x in embeddings.near_duplicates(df).collect()}

    def ok(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = {i + 3: unit(v) for i, v in enumerate(rows) if ok(v)}
    links = {i: {j for j, b in units.items() if i != j and len(a) == len(b) and a @ b >= 0.95} for i, a in units.items()}
    for i in range(3, len(rows) + 3):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), i == min(seen))


def test_float_input_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_ids_are_judged_by_their_own_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, b), (5, a), (8, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(5, 2, 5, True), (5, 1, 3, False), (5, 2, 5, True), (8, 2, 5, False), (3, 1, 3, True), (9, 2, None, False), (9, 2, None, False), (None, 2, None, True)]
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in got))) == sorted(map(str, want))


def test_bounds_hold_and_both_passes_agree():
    """Pairs near the threshold: codes prove only what double precision says, and each pair is settled in one pass."""
    r = np.random.default_rng(4)
    center = r.normal(size=48)
    raw = np.stack([center + r.normal(size=48) * s for s in np.repeat([0.15, 0.22, 0.3], 70)] + [r.normal(size=48) for _ in range(20)])
    codes, scale, error = embeddings.quantised(raw)
    unit = embeddings.units(raw)
    cosine = unit @ unit.T
    n, ids = np.ones(len(raw), np.int64), np.arange(len(raw))
    first = embeddings.compare(embeddings.Block(ids, n, codes, scale, error), None, 0.95, 32)
    some = r.permutation(first[0][first[3]])
    second = embeddings.compare(embeddings.Block(some, n[some], codes[some], scale[some], error[some], unit[some]), None, 0.95, 17)
    links = np.zeros(len(raw), np.int64)
    for found in (first, second):
        links[found[0]] += found[1]
    assert 0 < len(some) < len(raw) and (links == (cosine >= 0.95).sum(axis=1) - 1).all()
    x = embeddings.Block(ids, n, codes, scale, error)
    i, j, sure = embeddings.judged(x, x, slice(0, len(raw)), slice(0, len(raw)), 0.95)
    assert sure.any() and not sure.all() and (cosine[i[sure], j[sure]] >= 0.95).all()
    assert set(zip(*np.nonzero(cosine >= 0.95))) <= set(zip(i, j))
