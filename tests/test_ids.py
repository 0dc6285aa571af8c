import pytest

from attesta.functions import text as X
from attesta.operators import discovery, lifecycle
from pyspark.sql import functions as F


def test_ids_take_the_first_free_number(spark):
    new = spark.createDataFrame([(1, "Acme"), (2, "Acme!"), (3, "Acme 6"), (4, "acme"), (5, "Other"), (6, "ACME"), (7, "Other")], "pos int, name string")
    got = lambda ids: [r.id for r in lifecycle.new_ids(new, ids=spark.createDataFrame([(i,) for i in ids], "id string") if ids else None).orderBy("pos").collect()]
    assert got(["acme", "acme-3", "acme-04x", "other-2"]) == ["acme-2", "acme-4", "acme-6", "acme-5", "other", "acme-7", "other-3"]
    assert got(None) == ["acme", "acme-2", "acme-6", "acme-3", "other", "acme-4", "other-2"]
    assert got(["acme-6"])[2] == "acme-6-2"


def test_promoted_ids_are_new(spark):
    e = spark.createDataFrame([(1, "Acme", "l", "u", None, "x", "a.example", None)], "pos int, entity string, source string, url string, count int, unit string, domain string, size_in_range boolean")
    leads = spark.createDataFrame([("acme", "1.example"), ("acme-3", "3.example")], "id string, domain string")
    assert [r.id for r in discovery.promote(e, leads)[0].collect()] == ["acme-2"]


def test_unknown_and_no_listings_are_errors(spark):
    catalogue = spark.createDataFrame([("a", "u")], "id string, url string")
    wanted = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    assert discovery.wanted_listings(catalogue, wanted("a")).count() == 1
    with pytest.raises(ValueError):
        discovery.wanted_listings(catalogue, wanted())
    with pytest.raises(Exception, match="unknown listing: b"):
        discovery.wanted_listings(catalogue, wanted("a", "b")).collect()


def test_folding_reaches_rows_that_need_it(spark):
    rows = [("ﬁrma №5 ²",), ("e\u0301cole",), ("plain text",), ("Şube ĳ ŉ ŀ ſ",), (None,), ("ŞUBE  İSTANBUL",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.canonical("t")).collect()]
    assert got == ["firma no5 2", "école", "plain text", "şube ij ʼn l· s", None, "şube istanbul"]
    assert [r[0] for r in spark.createDataFrame([("Café №1",), ("plain",)], "t string").select(X.slug(F.col("t"))).collect()] == ["cafe-no1", "plain"]
