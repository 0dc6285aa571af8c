import random

import corpus_pipeline as cp
import numpy as np
from attesta.llm import neardup
from attesta.llm.common import local_components


def word_sets(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def slow_groups(texts):
    sets = [word_sets(t) for t in texts]
    u, v = [], []
    for i, p in enumerate(sets):
        for j in range(i):
            both = len(p & sets[j])
            if both >= 0.8 * (len(p) + len(sets[j]) - both):
                u.append(i)
                v.append(j)
    return local_components(np.array(u, np.int64), np.array(v, np.int64), len(texts)).tolist()


def copies(r):
    """Texts of 60 to 400 words, with copies in which up to 4 % of the words are changed."""
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(60, 400))]
        for share in (0, 0.01, 0.01, 0.02, 0.04):
            c = list(base)
            for _ in range(round(share * len(c))):
                c[r.randrange(len(c))] = r.choice(vocab)
            texts.append(" ".join(c))
    return texts


def test_groups_match_brute_force(spark):
    r = random.Random(11)
    texts = [*copies(r), "", None, " \n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f"]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df).collect()}
    want = slow_groups(texts)
    assert len(set(want)) < len(texts) / 2
    assert got == dict(enumerate(want))


def test_stage_drops_copies_at_five_words(spark):
    texts = copies(random.Random(12))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in cp.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, x in enumerate(slow_groups(texts)) if i == x}


def test_shingles_of_many_texts_are_those_of_each():
    texts = [b"", b"A b", b"a b c d e f a b c d e", b" \n ", b"one Two three four five", b"x"]
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    h, at = neardup.shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), offs)
    for i, t in enumerate(texts):
        assert set(h[at[i] : at[i + 1]].tolist()) == set(neardup.shingle_set(t).tolist())
        assert len(neardup.shingle_set(t)) == len(word_sets(t.decode()))


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_one_row_where_ids_repeat(spark):
    r = random.Random(13)
    a, b, c = (" ".join(r.choice("abcdefghijklmnop") + str(r.randint(0, 99)) for _ in range(100)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, a), (2, near), (2, b), (3, c), (3, c), (3, near), (4, None), (4, ""), (None, c)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(x.doc_id, x.text) for x in cp.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (4, None), (None, c)], key=str)


def test_simhash_alone_links_what_lies_within_its_limit(spark, monkeypatch):
    """With bands that no two texts share, pairs at 2 or fewer differing bits are found, and only if they are similar."""
    r = random.Random(14)
    texts = []
    for _ in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(100, 500))]
        texts += [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join([*base[:50], "other", *base[51:]])]
    sets, fps = [word_sets(t) for t in texts], []
    for t in texts:
        h = neardup.shingle_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)]
    assert any(fps[i] != fps[j] for i, j in pairs)
    monkeypatch.setattr(neardup, "band_keys", lambda h, starts: np.random.default_rng().integers(0, 1 << 63, (len(starts), neardup.BANDS), np.int64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(df).collect()}
    want = local_components(*(np.array(x, np.int64) for x in zip(*pairs)), len(texts)).tolist()
    assert all(got[i] == got[j] for i, j in pairs) and len({*got.values()}) > 1
    assert got == dict(enumerate(want))
