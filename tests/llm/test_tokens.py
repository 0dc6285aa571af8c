import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from attesta.llm import packing, tokenfile, tokens

ODD = ["", " ", "  ", " a", "a ", "a  b", "a   b", "a\n b", "a\n  b", "a \n b", "a \nb", "a\t b c", "it's 's don't 12 x2 3.5", "Ünï .. ... !? a.b, c", "<|endoftext|> x", "日本 語 テ", "\n\nx y\n", " \n x", "é x", "²³ ½ x", "a\x00b c\x00", "\xa0 x\xa0y", "word word, word. WORD"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(whole, text, end):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_words_give_the_same_ids(whole):
    e = tokens.Encoder()
    for t in ODD * 2:
        assert e.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_words_that_come_once_take_no_lasting_room(whole, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "RECENT", 5)
    e = tokens.Encoder()
    once = [f" once{'x' * i} and, and" for i in range(20)]
    for t in once + once[:2] + ["a and b, b", "a b b c c d d e e"]:
        assert e.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert {"and", "and,"} <= set(e.words) and len(e.words) <= 3 and len(e.recent) <= 5 and not any("once" in w for w in e.words)


def texts():
    return [*ODD, None, "many words " * 900, "x" * 5000, *(f"text number {i} about things" for i in range(50))]


def test_op6_round_trip(spark, whole):
    rows = [(i * 3, t, 7) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    got = {r.doc_id: r for r in tokenfile.read(*tokenfile.write(df)).collect()}
    start = 0
    for i, t, _ in rows:
        x = ids_of(whole, t, 0)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_op6_files(spark, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 200)
    rows = [(i, f"text number {i}") for i in range(40)] + [(None, "no id"), (7, "another seven"), (7, "another seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files, dictionary = tokenfile.write(df, folder=str(tmp_path / "out"))
    listed = files.orderBy("range", "file").collect()
    on_disk = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert on_disk == sorted(["dictionary", *(r.path.rpartition("/")[2] for r in listed)]) and len(listed) > 4
    assert (tmp_path / "out" / "dictionary").read_bytes() == dictionary
    ids = [int(d) for r in listed for d in tokenfile.Reader(open(r.path, "rb"), dictionary).index[:, 0]]
    assert ids == [tokenfile.C.NULL_ID, *range(8), 7, 7, *range(8, 40)]
    for i in (None, 0, 7, 39):
        want = sorted(ids_of(whole, t, 0).tolist() for d, t in rows if d == i)
        assert sorted(x.tolist() for x in tokenfile.documents(files, dictionary, i)) == want
    assert tokenfile.documents(files, dictionary, 400) == []
    with pytest.raises(ValueError):
        tokenfile.Reader(open(listed[0].path, "rb"), dictionary + b"x")
    empty, dictionary = tokenfile.write(df.limit(0))
    assert tokenfile.read(empty, dictionary).count() == 0


def test_op6_width(spark):
    assert tokenfile.width_for(tokens.DEFAULT, 0) == 2 and tokenfile.width_for(tokens.DEFAULT, 1 << 16) == 4
    with pytest.raises(ValueError):
        tokenfile.width_for(tokens.DEFAULT, 70_000, 2)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    files, dictionary = tokenfile.write(df, end_id=70_000)
    assert [x.tolist()[-1] for i in (1, 2) for x in tokenfile.documents(files, dictionary, i)] == [70_000] * 2


def test_op9_packs_every_piece_once(spark, whole):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(3, texts()[3], 5), (None, "x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        x = ids_of(whole, t, 2)
        first = len(x) % 1024 or 1024
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(x[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(4)
    counts = collections.Counter(np.minimum(1024, np.exp(r.normal(5.5, 1.2, 20000)).astype(int) + 1).tolist())
    planned = packing.plan(dict(counts))
    held = collections.Counter()
    for use, n in planned:
        assert n > 0 and sum(a * b for a, b in use.items()) <= 1024
        for a, b in use.items():
            held[a] += b * n
    assert held == counts
    bound = -(-sum(a * b for a, b in counts.items()) // 1024)
    assert sum(n for _, n in planned) <= 1.002 * bound + 1
    # The program's part is most of the plan.
    assert sum(n for _, n in packing.configurations(dict(counts), 1024)) > 0.3 * bound
    assert packing.plan({}) == [] and packing.plan({5: 3}) == [({5: 3}, 1)]


def test_white_space_of_any_kind_is_cut_as_the_library_does(whole):
    white = [chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))]
    signs = white + [" "] * len(white) + [*"ab.'é1漢\0", "'s", "!", "\x1c", "<|endoftext|>", "<|"]
    pick = random.Random(5)
    e = tokens.Encoder()
    for t in [" \xa0 \xa0", *("".join(pick.choices(signs, k=pick.randint(0, 9))) for _ in range(100_000))]:
        assert e.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
