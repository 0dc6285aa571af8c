"""Queries over small inline tables, with the rows that they must give spelled out as SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import discovery, drafts, evidence, lifecycle, report, score, urls
from ..sources import files, html

QUERIES: dict = {}
SQL: dict[str, str] = {}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def query(name: str, columns: str, rows: list[tuple]):
    """Registers a query and its rows. columns: `name type, ...`."""
    fields = [c.split() for c in columns.split(", ")]

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark).select(*[c for c, _ in fields])
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        SQL[name] = f"SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in fields)} FROM (VALUES {values}) v({', '.join(c for c, _ in fields)})"
        return f

    return add


@query("scale_words", "text VARCHAR, numbers VARCHAR", [
    ("30 bin kişi kapasiteli", "30 30000"), ("2,5 milyon öğün", "25 2500000"), ("12.000 yemek", "12000"), ("1.5 BİN ve 1.500 bin", "15 1500 1500000"), ("3 binler", "3"), ("", ""), ("1.500, 1,500 ve 1500", "1500"),
])
def scale_words(spark):
    df = spark.createDataFrame([(t,) for t in ("30 bin kişi kapasiteli", "2,5 milyon öğün", "12.000 yemek", "1.5 BİN ve 1.500 bin", "3 binler", "", "1.500, 1,500 ve 1500")], "text string")
    return df.select("text", F.array_join(F.array_sort(X.numbers("text")), " ").alias("numbers"))


@query("robots_decision", "status INTEGER, rules VARCHAR, allowed BOOLEAN", [
    (None, "", False), (503, "", False), (404, "", True), (200, "User-agent: *\nDisallow: /maps/", False), (200, "User-agent: *\nDisallow: /admin/", True), (200, "", True),
])
def robots_decision(spark):
    rows = [(None, ""), (503, ""), (404, ""), (200, "User-agent: *\nDisallow: /maps/"), (200, "User-agent: *\nDisallow: /admin/"), (200, "")]
    df = spark.createDataFrame(rows, "status int, rules string")
    return df.withColumn("allowed", html.robots_allows(F.col("status"), F.col("rules"), F.lit("https://x.com/maps/place/x")))


PAGE = """<html><head><script type="application/ld+json">{"@graph":[{"datePublished":"2026-09-12","x":{"dateModified":"2026-09-13"}},{"datePublished":"2026-09-12"},{"dateCreated":5}]}</script>
<script type="application/ld+json">{broken</script><meta property="article:published_time" content="2026-09-10"><meta name="date" content="2026-09-11"></head>
<body><time datetime="2026-09-01">x</time><time datetime="2026-09-01">y</time><time datetime="2026-09-02">z</time></body></html>"""


@query("html_dates", "key VARCHAR, dates VARCHAR", [
    ("datePublished", "2026-09-12"), ("dateModified", "2026-09-13"), ("meta:article:published_time", "2026-09-10"), ("meta:date", "2026-09-11"), ("time", "2026-09-01 2026-09-02"),
])
def html_dates(spark):
    d = spark.createDataFrame([(PAGE,)], "page string").select(html.html_dates("page").alias("d"))
    return d.select(F.explode("d").alias("key", "v")).select("key", F.array_join("v", " ").alias("dates"))


@query("unit_match", "unit VARCHAR, rule VARCHAR, hit BOOLEAN", [
    ("kişilik taşıma yemek hizmeti kapasitesi", "kişi kapasitesi", True), ("şubemiz", "şube", True), ("noktaya", "nokta", True), ("kişilik ekip", "kişi kapasitesi", False), ("öğün", "günlük öğün", False), ("ŞUBE", "şube", True),
])
def unit_match(spark):
    rows = [("kişilik taşıma yemek hizmeti kapasitesi", "kişi kapasitesi"), ("şubemiz", "şube"), ("noktaya", "nokta"), ("kişilik ekip", "kişi kapasitesi"), ("öğün", "günlük öğün"), ("ŞUBE", "şube")]
    out = F.lit(None).cast("boolean")
    for rule in dict.fromkeys(r for _, r in rows):
        out = F.when(F.col("rule") == rule, X.unit_matches(X.canonical("unit"), [rule])).otherwise(out)
    return spark.createDataFrame(rows, "unit string, rule string").withColumn("hit", out)


@query("slugs", "name VARCHAR, id VARCHAR", [
    ("Çağ Döner", "cag-doner"), ("cag doner", "cag-doner-2"), ("***", "lead"), ("Émile & Fils", "emile-fils"), ("ŞİŞLİ ığ", "sisli-ig"),
])
def slugs(spark):
    df = spark.createDataFrame(list(enumerate(["Çağ Döner", "cag doner", "***", "Émile & Fils", "ŞİŞLİ ığ"])), "pos int, name string")
    return lifecycle.new_ids(df)


VERIFIED = [
    ("c001", "acme", "branch_count", "14 şube", "genelinde 14 şubemizle", None, None, "verified"), ("c002", "other", "branch_count", "9 şube", "toplam 9 şube var", None, None, "verified"),
    ("c003", "acme", "contact", "mail", "yaz: info@acme.com", "info@acme.com", None, "verified"), ("c004", "acme", "review", "x", "geri çekilen 77", None, None, "retracted"),
    ("k001", None, "case_study", "%25 azalma", "israf %25 azaldı", None, None, "verified"),
]
GOOD = "Merhaba, 14 şubeniz var [c001]. Bir vakada %25 azalma [k001]."
DRAFTS = [
    (1, "acme", "email", "info@acme.com", "Konu", GOOD), (2, "acme", "email", "info@acme.com", "Konu", GOOD + " %30 kazanç"), (3, "acme", "email", "info@acme.com", "K", "[c009] [c009] [c002] [c004] 9"),
    (4, "acme", "email", "INFO@acme.com ", "K", "işaret yok"), (5, "acme", "email", "ceo@acme.com", "K", GOOD), (6, "acme", "email", "", "K", GOOD), (7, "acme", "linkedin", "", "K", GOOD),
    (8, "acme", "email", "info@acme.com", "K", GOOD + " kelime" * 60), (9, "acme", "linkedin", None, None, GOOD + "x" * 300), (10, "acme", "email", "info@acme.com", "K", GOOD + " 15 dakika"),
]


@query("draft_check", "n INTEGER, errors VARCHAR", [
    (1, ""), (2, "UNSUPPORTED_NUMBERS"), (3, "NOT_VERIFIED:c009 NOT_VERIFIED:c009 OTHER_LEAD:c002 NOT_VERIFIED:c004"), (4, "NO_EVIDENCE"), (5, "RECIPIENT_NOT_PUBLISHED"), (6, "RECIPIENT_MISSING"), (7, ""),
    (8, "TOO_MANY_WORDS"), (9, "TOO_MANY_CHARS"), (10, ""),
])
def draft_check(spark):
    claims = spark.createDataFrame(VERIFIED, "id string, lead string, type string, statement string, quote string, email string, date_evidence string, status string")
    d = spark.createDataFrame(DRAFTS, "n int, lead string, channel string, to string, subject string, body string")
    limits = spark.createDataFrame([("email", 60, None), ("linkedin", None, 300)], "channel string, max_words int, max_chars int")
    return drafts.check(d, claims, ["15"], limits).withColumn("errors", F.array_join("errors", " "))


@query("strip_marks", "text VARCHAR, plain VARCHAR, cited VARCHAR", [
    ("14 şubeniz var [c001]. Vaka [k002], sonuç.", "14 şubeniz var. Vaka, sonuç.", "c001 k002"), ("[c1] [c0001] [c0001] x", "[c1] x", "c0001"), ("", "", ""),
])
def strip_marks(spark):
    df = spark.createDataFrame([("14 şubeniz var [c001]. Vaka [k002], sonuç.",), ("[c1] [c0001] [c0001] x",), ("",)], "text string")
    return df.select("text", X.without_markers("text").alias("plain"), F.array_join(X.cited_ids("text"), " ").alias("cited"))


TEAM = "Yönetim\nAyşe Yılmaz\nGenel Müdür\nşirket tarihi"
BRIEF = [
    ("acme", 0, "s1", "about", "acme.com", "Türkiye'de 18 mekanımız var\n2024 şube planı\n" + TEAM),
    ("acme", 1, "s2", "contact", "acme.com", "Bize yazın: info@acme.com\nx@other.com\nBize yazın: info@acme.com"),
    ("acme", 2, "s3", "press", "acme.com", "Porsiyonlar küçük.\nYemek yetmedi, çok bekledik\nABC Grup Şirketleri\nABC Et\nABC Süt"),
    ("empty", 0, "s1", "branches", "empty.com", "hiçbir şey"), ("empty", 1, "s2", "about", "empty.com", "yok"),
]
BRIEF_SCHEMA = "lead string, page_pos int, snapshot string, page_type string, domain string, text string"


def brief(spark):
    pages = spark.createDataFrame(BRIEF, BRIEF_SCHEMA)
    return pages, evidence.choose(evidence.candidates(pages))


@query("evidence_brief", "lead VARCHAR, kind VARCHAR, snapshot VARCHAR, place INTEGER, quote VARCHAR", [
    ("acme", "size", "s1", 1, "Türkiye'de 18 mekanımız var"), ("acme", "person", "s1", 1, "Ayşe Yılmaz Genel Müdür şirket tarihi"),
    ("acme", "contact", "s2", 1, "Bize yazın: info@acme.com"), ("acme", "problem", "s3", 1, "Yemek yetmedi, çok bekledik"), ("acme", "problem", "s3", 2, "Porsiyonlar küçük."), ("acme", "parent", "s3", 1, "ABC Grup Şirketleri\nABC Et\nABC Süt"),
])
def evidence_brief(spark):
    return brief(spark)[1]


@query("missing_kinds", "lead VARCHAR, kind VARCHAR, open VARCHAR", [("empty", "size", "s1 s2"), ("empty", "contact", ""), ("empty", "person", "s2")])
def missing_kinds(spark):
    return evidence.missing(*brief(spark)).withColumn("open", F.array_join("open", " "))


@query("recall", "id VARCHAR, hit BOOLEAN", [("c1", True), ("c2", False), ("c3", False)])
def recall(spark):
    claims = spark.createDataFrame([("acme", "c1", "review", "yemek YETMEDİ bekledik"), ("acme", "c2", "news", "bambaşka bir haber"), ("empty", "c3", "review", "yemek yetmedi")], "lead string, id string, type string, quote string")
    return evidence.recall(claims, brief(spark)[1])


@query("directory_entry", "entity VARCHAR, count BIGINT, domain VARCHAR", [("Örnek Yemek A", 12000, "ornekyemek-a.com"), ("Örnek Muhallebici", 21, ""), ("ÖRNEK DÖNER", 11, "ornekdoner.com")])
def directory_entry(spark):
    block = '<div class="col"><h4>Örnek Yemek A</h4><p>12.000 yemek / gün www.ornekyemek-a.com.</p></div><div class="col"><h4>Adres:</h4><p>label only</p></div>'
    row = "<table class='wikitable'><tr><th>Ad</th></tr><tr><td>Örnek Muhallebici [3]</td><td>x</td><td>21</td></tr></table>"
    profile = "<body><p>Marka Adı: ÖRNEK DÖNER Adres: x Yurtiçi Şube Sayısı : 11 İnternet Sitesi ornekdoner.com</p></body>"
    df = spark.createDataFrame([(block, row, profile)], "a string, b string, c string")
    items = F.concat(
        html.directory_items(F.col("a"), "div.col", ["h4"], count_regex=r"([\d.]+)\s*yemek\s*/\s*gün", website_regex=r"((?:https?://|www\.)[\w.-]+\.[a-z]{2,})"),
        html.directory_items(F.col("b"), "table.wikitable tr", ["td:nth-child(1)"], ["td:nth-child(3)"]),
        html.directory_items(F.col("c"), None, name_regex=r"Marka Adı:\s*(.+?)\s+Adres:", count_regex=r"Yurtiçi Şube Sayısı\s*:\s*([\d.]+)", website_regex=r"İnternet Sitesi\s+([\w.-]+\.[a-z]{2,})"),
    )
    each = df.select(F.explode(items).alias("i")).select(discovery.directory_fields(F.col("i.name"), F.col("i.count_text"), F.col("i.website")).alias("e"))
    return each.where("e is not null").select("e.*")


@query("listing_pages", "id VARCHAR, n INTEGER, page_url VARCHAR", [("a", 1, "https://x/y"), ("a", 2, "https://x/y?page=2"), ("b", 1, "https://x/?k=1"), ("b", 2, "https://x/?k=1&p=2"), ("c", 1, "https://x/"), ("c", 2, "https://x/page/2/")])
def listing_pages(spark):
    return urls.listing_pages(spark.createDataFrame([("a", "https://x/y", 2, None, None), ("b", "https://x/?k=1", 2, "p", None), ("c", "https://x/", 2, None, "{url}page/{n}/")], "id string, url string, pages int, page_param string, page_template string"))


@query("screen_report", "lead VARCHAR, ok_pages BIGINT, page_types VARCHAR, size_mentions VARCHAR, emails VARCHAR, has_team_page BOOLEAN, error VARCHAR", [
    ("acme", 2, "about team", "14 şube|1.200 öğün", "a@acme.com info@acme.com", True, None), ("late", 0, "", "", "", False, "not crawled"), ("wall", 0, "", "", "", False, "blocked: automated access is not allowed"), ("gone", 0, "", "", "", False, "page failed: 404"),
])
def screen_report(spark):
    leads = spark.createDataFrame([(0, "acme", "Acme", "acme.com", "candidate"), (1, "late", "L", "l.com", "candidate"), (2, "wall", "W", "w.com", "candidate"), (3, "gone", "G", "g.com", "candidate"), (4, "out", "O", "o.com", "dropped")], "pos int, id string, name string, domain string, status string")
    crawls = spark.createDataFrame([("acme", None, False), ("wall", None, True), ("gone", None, False)], "lead string, error string, blocked boolean")
    pages = spark.createDataFrame([("acme", 0, True, "team", "14  şube, 2024 şube, 06 şube info@acme.com x@y.com"), ("acme", 1, True, "about", "1.200 öğün ve 14 şube A@ACME.com"), ("acme", 2, False, "press", "99 şube")], "lead string, page_pos int, ok boolean, type string, text string")
    failures = spark.createDataFrame([("gone", 0, 404, None), ("gone", 1, 500, None)], "lead string, pos int, status int, error string")
    out = discovery.screen(leads, crawls, pages, failures)
    return out.withColumns({c: F.array_join(c, s) for c, s in (("page_types", " "), ("size_mentions", "|"), ("emails", " "))})


@query("profile_merge", "domain VARCHAR, reason VARCHAR", [("ornek.com", "own"), ("kariyer.net", "terms")])
def profile_merge(spark):
    own = spark.createDataFrame([("ornek.com", "own")], "domain string, reason string")
    return files.merge_exclusions(own, spark.createDataFrame([("ornek.com", "market"), ("kariyer.net", "terms")], "domain string, reason string"))


@query("claim_lifecycle", "id VARCHAR, status VARCHAR, note VARCHAR", [("c1000", "retracted", "wrong"), ("c1001", "verified", None), (None, "UNKNOWN_LEAD", "s3"), (None, "TYPE_NOT_ALLOWED", "s4")])
def claim_lifecycle(spark):
    leads = spark.createDataFrame([("acme",)], "id string")
    batch = spark.createDataFrame([(0, "acme", "news", "s1"), (1, "nobody", "news", "s3"), (2, "acme", "product_fact", "s4"), (3, "acme", "price", "s2")], "pos int, lead string, type string, statement string")
    good, bad = lifecycle.ingest(batch, leads, 999)
    kept = lifecycle.retract(good.withColumn("status", F.lit("verified")), "c1000", "wrong", "2026-09-27")
    return kept.select("id", "status", F.col("retracted_reason").alias("note")).unionByName(bad.select(F.lit(None).cast("string").alias("id"), F.col("reason").alias("status"), F.col("statement").alias("note")))


@query("lead_selection", "id VARCHAR, status VARCHAR", [("a", "selected"), ("b", "candidate"), ("zz", "UNKNOWN")])
def lead_selection(spark):
    leads = spark.createDataFrame([("a", "candidate"), ("b", "candidate")], "id string, status string")
    out, unknown = lifecycle.select_leads(leads, spark.createDataFrame([("a",), ("zz",)], "id string"))
    return out.unionByName(unknown.withColumn("status", F.lit("UNKNOWN")))


@query("state_put", "key VARCHAR, value VARCHAR", [("a", "3=4"), ("b", "old"), ("c", "")])
def state_put(spark):
    return lifecycle.put_state(spark.createDataFrame([("a", "1"), ("b", "old")], "key string, value string"), spark.createDataFrame([(0, "a=2"), (1, "a=3=4"), (2, "c="), (3, "none")], "pos int, assignment string"))


@query("manual_snapshots", "id VARCHAR, ok BOOLEAN, error VARCHAR, chars INTEGER", [
    ("1", True, None, 26), ("2", False, "TEXT_TOO_SHORT", 5), ("3", False, "URL_WITHOUT_HOST", 26), ("4", False, "METHOD_NOT_ALLOWED", 26), ("5", False, "EXCLUDED: terms", 26),
])
def manual_snapshots(spark):
    t = " a line of text\r\nand another "
    rows = [("1", "https://a.com/x", t, "manual"), ("2", "https://a.com", "short", "chrome"), ("3", "a.com", t, "manual"), ("4", "https://a.com", t, "http"), ("5", "https://m.bad.com", t, "manual")]
    pages = spark.createDataFrame(rows, "id string, url string, text string, method string").withColumn("fetched_at", F.lit("2026-09-27"))
    return lifecycle.manual_snapshots(pages, spark.createDataFrame([(0, "bad.com", "terms")], "pos int, domain string, reason string"))


def built(spark):
    body = "14 şubeniz var [c001]."
    sha = hashlib.sha256("\x1f".join(["info@a.com", "email", "Konu", body]).encode()).hexdigest()
    leads = spark.createDataFrame([(0, "old", "Old", "old.com", "selected"), (1, "a", "Acme", "a.com", "selected"), (2, "x", "Out", "x.com", "selected"), (3, "d", "Dropped", "d.com", "dropped")], "pos int, id string, name string, domain string, status string")
    claims = spark.createDataFrame(
        [(0, "run", "c001", "a", "branch_count", "s001", None, "14 şube", "14 şubemizle", None, None, None), (1, "run", "c002", "a", "job_post", "s001", None, "ilan var", "ilan", "job_post", None, "2026-09-20"), (2, "run", "c003", "a", "person_title", "s001", None, "Ali, CEO", "Ali CEO", None, None, None), (3, "run", "c004", "a", "person_title", "s001", None, "Ayşe, GM", "Ayşe genel müdür", None, None, None)],
        "pos int, scope string, id string, lead string, type string, snapshot string, file string, statement string, quote string, signal string, layer string, content_date string",
    )
    d = spark.createDataFrame([(0, "a", "email", "info@a.com", "Konu", body, [], ("pass", [], sha)), (1, "a", "email", "second", "x", "y", [], None), (2, "old", "email", "", "s", "b", ["NO_EVIDENCE"], None)], "pos int, lead string, channel string, to string, subject string, body string, errors array<string>, review struct<verdict:string,issues:array<string>,draft_sha:string>")
    scores = spark.createDataFrame([("a", 50, "C", "why", ["note"], ["c004"], 20, 15, 12, 3), ("old", 80, "B", "", [], [], 35, 35, 0, 10), ("x", 0, "X", "", ["disqualified: r"], [], None, None, None, None)], "lead string, score int, tier string, why_now string, notes array<string>, relevant_people array<string>, fit int, signal int, timing int, reach int")
    snaps = spark.createDataFrame([("run", "s001", "https://a.com/1", None, "2026-09-26T10:00:00", None)], "scope string, id string, url string, final_url string, fetched_at string, captured_by string")
    carry = [("a.com", "A", "99", "Kontrol gerekli", "my note"), ("x.com", "B", "1", "Konuşuldu", ""), ("gone.com", "A", "12", "Taslak - onayını bekliyor", "kept")]
    rows = [(i, *(dict(zip(("Site", "Öncelik", "Skor", "Durum", "Notlar"), c)).get(k, "") for k in report.COLUMNS)) for i, c in enumerate(carry)]
    previous = spark.createDataFrame(rows, "pos long, " + ", ".join(f"`{c}` string" for c in report.COLUMNS))
    return report.build(leads, claims, d, scores, snaps, previous)


@query("report_export", "site VARCHAR, tier VARCHAR, status VARCHAR, note VARCHAR, people VARCHAR, signals VARCHAR, sources VARCHAR, checks VARCHAR, message VARCHAR, place INTEGER", [
    ("gone.com", "A", "Taslak - onayını bekliyor", "kept", "", "", "", "", "", 1), ("old.com", "B", "Kontrol gerekli", "", "", "", "", "code: failed (NO_EVIDENCE) | review: pending", "b", 2),
    ("a.com", "C", "Taslak - onayını bekliyor", "my note", "★ Ayşe, GM\nAli, CEO", "• ilan var", '[1] https://a.com/1 (fetched 2026-09-26): "14 şubemizle"', "code: ok | review: ok", "14 şubeniz var.", 3), ("x.com", "X", "Konuşuldu", "", "", "", "", "Taslak yok", "", 4),
])
def report_export(spark):
    from pyspark.sql import Window

    b = built(spark)
    # The sheet's place shows its order.
    place = F.row_number().over(Window.orderBy("_tier", "_score", "pos"))
    names = {"site": "Site", "tier": "Öncelik", "status": "Durum", "note": "Notlar", "people": "Karar verici", "signals": "Bulunan sinyaller", "sources": "Kaynaklar", "checks": "Doğrulama", "message": "Mesaj"}
    return b.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()), place.alias("place"))


@query("ready_drafts", "lead VARCHAR, to_ VARCHAR, subject VARCHAR, body VARCHAR", [("a", "info@a.com", "Konu", "14 şubeniz var.")])
def ready_drafts(spark):
    return report.ready_drafts(built(spark)).withColumnRenamed("to", "to_")


@query("review_texts", "lead VARCHAR, has_number BOOLEAN, title VARCHAR", [("a", True, "# Acme (a.com)"), ("old", False, "# Old (old.com)"), ("x", False, "# Out (x.com)")])
def review_texts(spark):
    return report.review_texts(built(spark)).select("lead", F.contains("review", F.lit("var [1].")).alias("has_number"), F.substring_index("review", "\n", 1).alias("title"))


@query("score_notes", "lead VARCHAR, tier VARCHAR, notes VARCHAR, why_now VARCHAR", [
    ("big", "C", "size out of range (300 mağaza; 5-50)|no decision maker found|tier B capped to C: size out of range", "yorum (2026-09-20) [c3]"),
    ("unit", "C", "segment not shown|size unit not in profile (nokta)|no decision maker found", ""), ("none", "C", "segment not shown|size unknown, not guessed|no decision maker found", ""), ("bad", "X", "disqualified: rakip", ""),
])
def score_notes(spark):
    schema = "pos int, lead string, id string, type string, statement string, quote string, value string, unit string, signal string, content_date string, status string"
    rows = [
        (0, "big", "c1", "branch_count", "300", "300 mağaza", "300", "mağaza", None, None), (1, "big", "c2", "company_fact", "seg", "zincir", None, None, "segment", None), (2, "big", "c3", "review", "yorum", "x", None, None, "review", "2026-09-20"),
        (3, "unit", "c4", "branch_count", "12", "12 nokta", "12", "nokta", None, None), (4, "bad", "c5", "disqualifier", "rakip", "x", None, None, None, None), (5, "bad", "c6", "news", "n", "x", None, None, "news", "2026-09-20"),
    ]
    claims = spark.createDataFrame([(*r, "verified") for r in rows], schema)
    leads = spark.createDataFrame([(x,) for x in ("big", "unit", "none", "bad")], "id string")
    out = score.score(leads, claims, "2026-09-27", [{"units": ["şube", "mağaza"], "min": 5, "max": 50}], ["genel müdür"], weights={"review": 10, "news": 10})
    return out.withColumn("notes", F.array_join("notes", "|"))
