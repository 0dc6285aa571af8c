import random

import numpy as np
import pyarrow as pa

from attesta.llm import decontaminate as D


def slow(texts, items):
    """Every stretch of every document against every item."""
    out = {}
    for i, t in enumerate(texts):
        w = D.words_of(t or "")
        out[i] = sorted(k for k, item in items.items() if (x := D.words_of(item or "")) and D.holds(x, w))
    return out


def test_common_subsequence():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(80))] for _ in range(2))
        assert D.common_subsequence(a, b) == table(a, b)


def corpus():
    r = random.Random(8)
    vocab = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{i}" for i in range(800)]
    common = ["the", "of", "and", "to"]
    words = lambda n: [r.choice(common) if r.random() < 0.3 else r.choice(vocab) for _ in range(n)]
    items = {k * 2: " ".join(words(r.randint(12, 60))) for k in range(30)}
    texts = [" ".join(words(r.randint(0, 400))) for _ in range(60)]
    for k, item in list(items.items())[:20]:
        x = item.split()
        if k % 3 == 0:  # reworded: some words left out or changed
            x = [w if r.random() > 0.12 else r.choice(vocab) for w in x if r.random() > 0.05]
        a = words(r.randint(0, 150))
        texts.append(" ".join(a + [w.upper() + "," for w in x] + words(r.randint(0, 150))))
    return texts + ["", None, "the of and"], items | {901: None, 902: "", 903: "!?"}


def test_op7_matches_brute_force(spark):
    texts, items = corpus()
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, item_ids array<int>").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.find_leaks(docs, bench).collect()}
    want = slow(texts, items)
    assert sum(map(len, want.values())) >= 18
    assert got == want


def test_blocks_of_items_and_empty(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 12)
    texts, items = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in D.find_leaks(docs, bench).collect()} == slow(texts, items)
    assert D.find_leaks(docs, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert D.find_leaks(docs.limit(0), bench).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def share_of(item, words):
    """The largest part of the item that a stretch of its length and a quarter more has in order, and so for its last quarter."""
    m = len(item)
    size = m + max(2, m // 4)
    stretches = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    best = max(stretches, key=lambda x: lcs(item, x))
    answer = item[-max(3, m // 4) :]
    return lcs(item, best) / m, lcs(answer, best) / len(answer)


def test_op7_finds_what_the_definition_says(spark):
    """Against a check of its own, over all stretches; the operator may look at stretches an eighth of an item apart."""
    texts, items = corpus()
    texts, items = texts[50:], {k: v for k, v in list(items.items())[:12]} | {77: "zwischenzeit", 79: "two terms"}
    texts += ["it was zwischenzeit then", "these two, terms", "two such terms"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.find_leaks(docs, bench).collect()}
    for i, t in enumerate(texts):
        for k, item in items.items():
            x = plain_words(item)
            share, answer = share_of(x, plain_words(t or ""))
            if k in got[i]:
                assert share >= 0.7 or (share >= 0.5 and answer >= 0.8) or len(x) < 5
            elif len(x) < 5:
                assert share < 1
            else:
                assert share < 0.8
    assert got[len(texts) - 3] == [77] and got[len(texts) - 2] == [79]


def test_repeated_and_null_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 1)
    r = random.Random(4)
    item = lambda: " ".join(f"{r.choice('abcdef')}{r.randrange(10**6)}" for _ in range(20))
    items = {5: item(), 6: item()}
    rows = [(1, items[6], 0.5), (1, items[5], 0.5), (None, items[5] + " " + items[6], 0.5), (2, "filler " * 60_000 + items[5] + " filler" * 60_000, None), (2, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, share double")
    found = D.find_leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.item_ids) for x in found) == [(0, [5, 6]), (1, [5]), (1, [6]), (2, []), (2, [5])]


def test_common_subsequences_of_many_candidates():
    r = random.Random(6)
    code = lambda: r.randrange(1, 40) << 57 | 5
    items = [[code() for _ in range(m)] for m in (1, 2, 5, 17, 63, 64, 64, 65, 90)]
    words = np.array([code() if r.random() < 0.8 else r.randrange(1 << 60) for _ in range(3000)], np.uint64)
    item, lo = (np.array([r.randrange(n) for _ in range(5000)]) for n in (len(items), 2800))
    hi = lo + np.array([r.randrange(200) for _ in lo])
    s = D.Sequences(items)
    got = s.lengths(s.words(words), item, lo, hi)
    for k, a, b, n in zip(item.tolist(), lo.tolist(), hi.tolist(), got.tolist(), strict=True):
        x = items[k]
        assert n == (D.common_subsequence(x, words[a:b].tolist()) if len(x) <= 64 else len(x))


def test_search_compares_only_candidates_that_hold_enough_in_order(monkeypatch):
    """Passages with the words of an item in another order are turned away without a search of their own."""
    r = random.Random(7)
    item = [f"t{k}x" for k in range(20)]
    texts = [" ".join(r.sample(item, 20)) for _ in range(100)] + [" ".join(item)]
    hashed = D.hashes([w.encode() for w in item]).tolist()
    terms = D.Terms([(3, [w.encode() for w in item])])
    batch = pa.RecordBatch.from_arrays([pa.array(range(101)), pa.array(texts), pa.array([[]] * 101, pa.list_(pa.int64())), pa.array([0.0] * 101)], ["doc_id", "text", *D.FOUND])
    embed = np.eye(20, dtype=np.float32)
    calls, holds = [], D.holds
    monkeypatch.setattr(D, "holds", lambda *a: calls.append(a) or holds(*a))
    out = list(D.search(terms, embed, np.full((1, 20), 20**-0.5, np.float32), [hashed], ("doc_id", "text"))(iter([batch])))
    found = [x for b in out for x in b.column(D.FOUND[0]).to_pylist()]
    assert found[100] == [3] and len(calls) <= 10
    assert found[:100] == [[3] if holds(hashed, D.hashes([w.encode() for w in t.split()]).tolist()) else [] for t in texts[:100]]
