from attesta.plans import registry


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_bm25_searches_words_after_the_fourth(spark, tmp_path):
    write(spark, tmp_path, "documents", [(1, "alpha beta gamma delta"), (2, "omega omega sigma"), (3, "nothing here")], "doc_id long, text string")
    write(spark, tmp_path, "benchmark", [(7, "alpha beta gamma delta omega")], "item_id long, text string")
    found = {r.doc_id for r in registry.queries()["bm25_topk_whole"](spark, str(tmp_path)).collect()}
    assert found == {1, 2}


def test_snapshots_with_both_changes_have_a_row(spark, tmp_path):
    write(spark, tmp_path, "documents", [(i, "one\ntwo") for i in range(1, 16)], "doc_id long, text string")
    state = {r.doc_id: r.state for r in registry.queries()["snapshot_integrity_whole"](spark, str(tmp_path)).collect()}
    assert set(state) == set(range(1, 16))
    assert state[10] == state[5] == "mismatch" and state[1] == "repaired" and state[2] == "ok"
