import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import claims as K
from attesta.operators import report
from attesta.sources import files, html
from attesta.streaming import reverify


def test_jsonl_round_trip(spark, tmp_path):
    schema = "id string, n int, name string"
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id":"1","n":2,"name":"şube"}\n\n{"id":"2","name":""}\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(map(tuple, got.collect())) == [("1", 2, "şube"), ("2", None, "")]
    files.write_jsonl(got, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), schema).collect())) == sorted(map(tuple, got.collect()))
    assert json.loads(files.to_json(got.where("id = '1'")).first().value) == {"id": "1", "n": 2, "name": "şube"}
    p = spark.createDataFrame([("﻿" + '{"a": "x"}',)], "payload string")
    assert files.parse_payload(p, "a string").first()[-1] == "x"


def test_market_and_profile(tmp_path):
    (tmp_path / "tr.toml").write_text('[sources]\nreview_sites = ["b.com", "a.com"]\nexcluded = [{domain = "x.com", reason = "market"}, {domain = "y.com", reason = "m"}]\n', encoding="utf-8")
    market = files.load_market(str(tmp_path), "tr")
    merged = files.merge_profile({"sources": {"excluded": [{"domain": "x.com", "reason": "own"}], "review_sites": ["a.com"]}}, market)
    assert [(x["domain"], x["reason"]) for x in merged["sources"]["excluded"]] == [("x.com", "own"), ("y.com", "m")]
    assert merged["sources"]["review_sites"] == ["a.com", "b.com"]
    with pytest.raises(FileNotFoundError):
        files.load_market(str(tmp_path), "de")


def test_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=1+2", 'a "quoted", cell\nof two lines', "a.com"), ("plain", "", "b.com"), ("no site", "x", "")], "x string, y string, Site string")
    files.write_sheet(report.csv_rows(df), str(tmp_path / "sheet"))
    got = {r.Site: (r.x, r.y) for r in files.read_sheet(spark, str(tmp_path / "sheet")).collect()}
    assert got == {"a.com": ("'=1+2", 'a "quoted", cell\nof two lines'), "b.com": ("plain", "")}


def test_ordered_union(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pos int, site string")
    b = spark.createDataFrame([(0, "z"), (1, "y")], "pos int, site string")
    assert [r.site for r in files.ordered_union(a, b, "site").orderBy("side", "pos").collect()] == ["x", "y", "z"]


def test_html_layers(spark):
    page = "<html><head><title>t</title></head><body><p>Visible  one</p><div style='display: none'>secret</div><script>no()</script><ul><li>a</li><li hidden>b</li></ul></body></html>"
    r = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(html.visible_text("p").alias("v"), html.full_text("p").alias("f")).collect()
    assert (r[0].v, r[0].f) == ("Visible one\na", "Visible one\nsecret\na\nb")
    assert (r[1].v, r[2].f) == ("", "")
    assert html.tree("<div>" * 5000 + "deep").text() == "deep"
    root = html.tree('<article aria-hidden="true"><a href="/x">1</a></article><article class="k z"><p><strong>S</strong></p></article>')
    assert [n.attrs for n in html.select(root, "article:not([aria-hidden])")] == [{"class": "k z"}]
    assert [n.tag for n in html.select(root, "article.k p strong")] == ["strong"] and html.select(root, "p a") == []


@pytest.mark.parametrize("text,want", [
    ("  ACME  Lokanta​ ", "acme lokanta"), ("IŞIK İstanbul", "ışık istanbul"), ("“a” – b’c", "\"a\" - b'c"), ("″", "''"), ("ﬁne ①", "fine 1"), ("a\x1cb c", "a b c"), ("", ""),
])
def test_canonical(spark, text, want):
    once = spark.createDataFrame([(text,)], "t string").select(X.canonical("t").alias("n"))
    assert once.first().n == want
    assert once.select(X.canonical("n")).first()[0] == want


def test_hosts_and_counts(spark):
    df = spark.createDataFrame([("https://WWW.Şube.com/a|b",), ("http://u:p@a_b.com:80/x y",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(X.url_host("u")).collect()] == ["şube.com", "a_b.com", "", ""]
    typed = spark.createDataFrame([(" https://www.Acme.com/x ",), ("acme.com:8080/y",)], "u string")
    assert [r[0] for r in typed.select(X.typed_host("u")).collect()] == ["acme.com", "acme.com:8080"]
    n = spark.createDataFrame([("12.000 yemek",), ("yok",), (None,)], "t string")
    assert [r[0] for r in n.select(X.first_count("t")).collect()] == [12000, None, None]
    s = spark.createDataFrame([("21",), ("12.000",), ("2024",), ("1998",), ("06",)], "t string")
    assert [r[0] for r in s.select(X.plausible_count(F.col("t"))).collect()] == [True, True, False, False, False]


def test_stream_is_checked_in_batches(spark, tmp_path):
    from tests.test_claims import claim, snap

    spark.createDataFrame([tuple(snap("s001").values()), tuple(snap("s002", ok=False).values())], K.SNAPSHOT_SCHEMA).write.parquet(str(tmp_path / "in"))
    names = [f.split()[0] for f in K.CLAIM_SCHEMA.split(", ")]
    rows = [{"pos": i, "scope": "run", "id": f"c{i}"} | claim(snapshot=s) for i, s in enumerate(("s001", "s002", "s003"))]
    claims = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], K.CLAIM_SCHEMA)
    leads = spark.createDataFrame([("acme", "acme-lokanta.com.tr")], "id string, domain string")
    q = reverify.reverify(reverify.snapshot_stream(spark, str(tmp_path / "in")), claims, leads, "2026-09-27", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"c0": "verified", "c1": "rejected"}
