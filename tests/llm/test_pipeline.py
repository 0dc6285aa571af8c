import random

import corpus_pipeline as cp
from attesta.llm import common, decontaminate, lines, packing, simhash, toxicity
from pyspark.sql import functions as F
from tests.llm.test_simhash import slow_components, slow_fingerprint


def tables(spark, path):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda: "\n".join(" ".join(r.choice(vocab) for _ in range(20)) for _ in range(4))
    docs, marks = [], []
    for i in range(160):
        t = text()
        bad = i % 5 == 0
        docs.append((i, t + (" badword horrid" if bad else ""), "en", "s", 1))
        if i % 2 == 0 or bad:
            marks.append((i, 1, int(bad)))
    docs += [(200, docs[1][1], "en", "s", 1), (201, docs[2][1].replace("w1 ", "w2 "), "en", "s", 1), (202, None, None, None, None), (203, "", "en", "s", 0)]
    item = " ".join(r.choice(vocab) for _ in range(30)) + " answer forty two"
    docs.append((204, text() + "\n" + item, "en", "s", 5))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", marks, "doc_id long, quality int, toxic int"),
        ("benchmark", [(7, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return docs


def test_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = common.table(spark, str(tmp_path), "documents")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    scratch = common.Scratch(spark, "test")
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs_out = scratch.store(stage(spark, docs, str(tmp_path)), name)
        after = {r.doc_id: r for r in docs_out.collect()}
        if name == "packing":
            assert set(docs_out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
            assert docs_out.select("doc_id").distinct().count() == len(before)
            break
        assert tuple(docs_out.columns) == cp.COLUMNS and after and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            bad = {i for i, x in before.items() if x.text and "badword" in x.text}
            assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 2
        if name == "line_dedup":
            kept = lines.keep_first_lines([(i, before[i].text or "") for i in sorted(before)])
            assert {i: x.text for i, x in after.items()} == {i: "\n".join(k) for i, k in kept.items() if "".join(k).strip() or len(k) == len((before[i].text or "").split("\n"))}
            assert 200 in gone
        if name == "simhash_near_dedup":
            ids = sorted(before)
            comp = slow_components(ids, [slow_fingerprint(before[i].text) for i in ids])
            assert set(after) == {i for i in ids if comp[i] == i}
        if name == "decontamination":
            assert gone == {204}
        docs = docs_out


def test_toxicity_learns_only_from_its_share(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs, labels = (common.table(spark, str(tmp_path), t) for t in ("documents", "labels"))
    first = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    # Marks of held-out rows turned round, and other columns changed: the scores stay.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("lang", F.lit("x")).withColumn("n_chars", F.lit(0)), flipped).collect()}
    assert {i: (r.held_out, r.score, r.predicted) for i, r in first.items()} == {i: (r.held_out, r.score, r.predicted) for i, r in again.items()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in first.items())
    held = [r for i, r in first.items() if r.held_out and i < 160]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.9 * len(held)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(first) and all(r.score == 0 for r in none)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    full = {t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    for gone in ([*full], ["labels", "benchmark"]):
        place = f"{tmp_path}/without-{len(gone)}"
        for t, df in full.items():
            (df.limit(0) if t in gone else df).write.parquet(f"{place}/{t}.parquet")
        out = cp.run(spark, place)
        n = out.select("doc_id").distinct().count()
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and (n == 0 if "documents" in gone else n >= 160)


def test_null_and_repeated_ids(spark, tmp_path):
    tables(spark, str(tmp_path))
    words = lambda n: " ".join(f"q{n}x{k}" for k in range(40))
    more = [(None, words(1), None, None, None), (500, words(2), "en", "s", 1), (500, words(2), "en", "s", 1), (500, words(3), "en", "s", 1), (None, None, None, None, None)]
    docs = common.table(spark, str(tmp_path), "documents").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("score", F.lit("x")).withColumn("rk", F.lit(1)).withColumn("item_ids", F.lit(2))
    scratch = common.Scratch(spark, "test")
    for name, stage in cp.STAGES[:4]:
        docs = scratch.store(stage(spark, docs, str(tmp_path)), name)
    left = sorted((r.doc_id or 0, r.text) for r in docs.collect() if r.doc_id in (None, 500))
    assert (0, words(1)) in left and [x for x in left if x[0] == 500 and x[1] == words(3)] == [(500, words(3))]
    assert sum(x == (500, words(2)) for x in left) <= 1
    assert {"doc_id", "piece"} <= set(cp.pack(spark, docs, str(tmp_path)).columns)
