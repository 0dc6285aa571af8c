import unicodedata

import duckdb
import pyarrow as pa

from attesta.functions import text as X
from attesta.operators import kb
from attesta.plans import registry

ASKED = [(7, "alpha beta alpha Işık gamma delta"), (8, "omega İzmir ölçü"), (None, "beta"), (9, None), (10, "..."), (11, "日本 σigma word²")]
TEXTS = ["alpha beta gamma", "Omega omega ISIK IŞIK", None, "", "beta beta", "ÖLÇÜ izmir İZMİR, x_1", "日本 nihon alpha", "alpha beta gamma", "no such", "delta " * 40 + "alphabet"]


def rows(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    for name in ("bm25_topk", "bm25_topk_whole"):
        got = [tuple(r) for r in registry.queries()[name](spark, str(path)).collect()]
        want = con.sql(registry.oracle_sql()[name]).fetchall()
        key = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted(got, key=key) == sorted(want, key=key) and got


def test_bm25_as_sql_on_odd_rows(spark, tmp_path):
    rows(spark, tmp_path, list(enumerate(TEXTS * 3)))


def test_bm25_as_sql_on_repeated_and_null_ids(spark, tmp_path):
    again = [(3, "alpha beta gamma"), (3, "alpha x"), (3, "beta gamma alpha"), (None, "omega"), (None, "omega beta"), (None, "alpha omega"), (None, None)]
    rows(spark, tmp_path, [*enumerate(TEXTS * 2), *again])


def test_bm25_shuffles_the_best_only(spark):
    docs = spark.createDataFrame([(i, i, f"alpha beta w{i % 7}") for i in range(200)], "doc_id long, pos long, text string")
    asked = spark.createDataFrame([(i, f"alpha w{i}") for i in range(20)], "query_id int, text string")
    found = kb.search(docs, asked, 2, digits=6)
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.partition("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(query_id") == final.count("Exchange ") == 1


def test_bm25_topk_counts_where_it_reads(spark, tmp_path):
    rows(spark, tmp_path, list(enumerate(TEXTS)))
    found = registry.queries()["bm25_topk"](spark, str(tmp_path))
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert final.count("Exchange ") == 1 and not any(x in final for x in ("Generate", "HashAggregate", "Join"))


def test_bm25_topk_shuffles_fewer_rows_than_two_for_each_document(spark, tmp_path):
    """Over all its jobs, those that run before the rows are asked for too."""
    words, n = [f"w{i:03}" for i in range(40)], 2000
    spark.createDataFrame([(i, " ".join(words)) for i in range(n)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(words[4 * i : 4 * i + 4])) for i in range(10)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = jvm.java.util.ArrayList
        stages = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    assert len(registry.queries()["bm25_topk"](spark, str(tmp_path)).collect()) == 50
    assert 0 < sum(x for k, x in written().items() if k not in before) < 2 * n


def test_bm25_same_in_pieces_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(TEXTS * 5)], "doc_id long, pos long, text string")
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    best, every = ({tuple(r) for r in kb.search(docs, asked, k).collect()} for k in (3, None))
    monkeypatch.setattr(kb, "POSTINGS", 3)
    small = {tuple(r) for r in kb.search(docs, asked, 3).collect()}
    assert small == best and {r[:3] for r in best} < every
    terms = ["alpha", "beta", "gamma", "delta"]
    block = kb.Block.of(pa.table({"query_id": [1, 1, 2, 3], "term": terms, "qn": [1, 2, 1, 1]}))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "pos": list(range(50)), "text": TEXTS * 5})

    def run():
        return [r for b in kb.scores(block, 50, 3.0, kb.np.array([20.0, 20, 10, 5]), 4, 6)(kb.counted(terms, True)([batch])) for r in b.to_pylist()]

    whole = run()
    monkeypatch.setattr(kb, "CELLS", 4)
    monkeypatch.setattr(kb, "ROWS", 7)
    assert run() == whole and len(whole) == 12


def test_stems_in_python_are_those_of_the_jvm(spark):
    old = [c for c in map(chr, range(0x30000)) if unicodedata.ucd_3_2_0.category(c) not in ("Cn", "Cs", "Co")]
    texts = [f"a{c}b {c} x{c}" for c in old] + ["ΑΣ Σ ΑΣΑ ΙΣ.", "", "I İ ı i", "abcdefg hı"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for compatibility in (True, False):
        assert [(r.t, r.s) for r in df.select("t", X.stems("t", compatibility).alias("s")).collect()] == [(t, X.stems_of(t, compatibility)) for t in texts]
    known = sorted({s for t in texts for s in X.stems_of(t)})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "pos": list(range(len(texts))), "text": texts})
    for c in kb.counted(known, True)([batch]):
        for i, at in enumerate(c.doc_id.to_pylist()):
            want = X.stems_of(texts[at])
            assert c.part_len[i] == len(want) and sorted(known[t] for t, n in zip(c.term[c.part == i], c.tf[c.part == i], strict=True) for _ in range(n)) == sorted(want)
