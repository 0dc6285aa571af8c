import random

import pytest

from attesta.llm import lines


@pytest.mark.parametrize("seed", [32, 2])
def test_op10_matches_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghié") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(1, 25)))
    pool = [line() for _ in range(40)]

    def edited():
        x = list(r.choice(pool))
        for _ in range(r.randint(0, 2)):
            x[r.randrange(len(x))] = r.choice("xyz")
        return "".join(x)

    texts = ["\n".join(r.choice([line, edited, edited])() for _ in range(r.randint(0, 6))) for _ in range(60)]
    texts += ["", None, "\n\n", "ab\nab\n ab \r\nabc", "short", "short", "x" * 3000, "x" * 2900 + "\nlast"]
    df = spark.createDataFrame([(i, t, "p", 0) for i, t in enumerate(texts)], "doc_id long, text string, payload string, line int").repartition(3)
    got = {x.doc_id: x for x in lines.dedup_lines(df).collect()}
    want = lines.keep_first_lines([(i, t or "") for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        n = len((t or "").split("\n"))
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_text) == (n, n - len(want[i]), "\n".join(want[i])), i
    assert sum(x.n_removed for x in got.values()) > 30


def test_empty_and_repeated(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a line"), (1, "a line"), (None, "other\na line")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.kept_text) for x in lines.dedup_lines(df).collect())
    assert got == [(0, "other\na line"), (1, ""), (1, "")]


def test_huge_lines(spark):
    r = random.Random(4)
    huge = " ".join(f"w{r.randrange(10**6)}" for _ in range(120_000))
    near = huge.replace("w1", "v1", 40)
    texts = [huge, "short line\n" + near, huge + "\nshort line", "z" * 1_000_000]
    got = {x.doc_id: (x.n_removed, x.kept_text) for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, huge), 1: (1, "short line"), 2: (2, ""), 3: (0, texts[3])}
