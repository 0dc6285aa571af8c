import hashlib

import pytest

from attesta.operators import claims as K

TODAY = "2026-09-27"
PAGE = "\n".join([
    "ACME LOKANTA Kurumsal", "Türkiye genelinde 14 şubemizle hizmet veriyoruz.", "İlan tarihi: 12 Eylül 2026 Maliyet Kontrol Uzmanı aranıyor",
    "Genel Müdür: Ayşe Yılmaz", "İletişim: info@acme-lokanta.com.tr", "From EUR99 /month", "Porsiyonlar küçülmüş, 3 hafta önce gittik", "100 şubeye ulaşmayı istiyoruz ve bunun için her gün çalışıyoruz; bugün 88 şubesi olan rakip gibi değiliz, onu da çok daha sonra anlatırız.",
])


def snap(id, text=PAGE, **kw):
    row = {"scope": "run", "id": id, "url": "https://acme-lokanta.com.tr/x", "domain": "acme-lokanta.com.tr", "final_domain": None, "fetched_at": "2026-09-26T10:00:00+00:00", "ok": True, "method": "http", "sha256": hashlib.sha256(text.encode()).hexdigest(), "full_sha256": None, "html_dates": {}, "text": text, "full_text": None}
    return row | kw


HIDDEN = PAGE + "\nSekmede gizli bir bilgi var"
SNAPS = [
    snap("s001"), snap("bad", ok=False), snap("cut", sha256="0" * 64), snap("old", fetched_at="2026-08-01T00:00:00"), snap("sub", domain="kariyer.acme-lokanta.com.tr"), snap("fake", domain="notacme-lokanta.com.tr"),
    snap("news", domain="haberler.com"), snap("meta", html_dates={"datePosted": ["2026-09-12"]}), snap("chrome", domain="google.com", method="chrome"), snap("manual", method="manual"),
    snap("yemek", domain="www.yemeksepeti.com"), snap("hid", full_text=HIDDEN, full_sha256=hashlib.sha256(HIDDEN.encode()).hexdigest()), snap("hidcut", full_text=HIDDEN, full_sha256="1" * 64), snap("none", text="x", sha256="y") | {"text": None},
    snap("dated", text="Yayın: 10.03.2023 tarihli haber metni"), snap("masked", text="İletişim adresi [email protected] olarak verilir"),
    snap("crew", text="Şu an 50 kişilik ekip ile çalışıyoruz burada"),
]
Q = "Türkiye genelinde 14 şubemizle"


def claim(type="branch_count", quote=Q, snapshot="s001", statement="14 şube", **kw):
    return {"lead": "acme", "type": type, "quote": quote, "snapshot": snapshot, "statement": statement} | kw


JOB = {"type": "job_post", "quote": "Maliyet Kontrol Uzmanı aranıyor", "statement": "ilan"}
CASES = [
    (claim(value="14"), []),
    (claim("company_fact", "acme   lokanta  KURUMSAL", statement="x"), []),
    (claim(quote="Türkiye genelinde 20 şubemizle", statement="20 şube"), ["QUOTE_NOT_FOUND"]),
    (claim("company_fact", statement="30 şube"), ["UNSUPPORTED_NUMBERS"]),
    (claim(snapshot="cut"), ["SNAPSHOT_CHANGED"]),
    (claim(snapshot="bad"), ["SNAPSHOT_NOT_OK"]),
    (claim(snapshot="gone"), ["SNAPSHOT_MISSING"]),
    (claim(snapshot="none"), ["SNAPSHOT_TEXT_MISSING"]),
    (claim(snapshot="hidcut"), ["SNAPSHOT_HIDDEN_CHANGED"]),
    (claim(snapshot=None), ["SOURCE_MISSING"]),
    (claim(quote="14"), ["QUOTE_TOO_SHORT"]),
    (claim(quote="x" * 501), ["QUOTE_TOO_LONG"]),
    (claim(quote=" ", statement=None), ["STATEMENT_BLANK", "QUOTE_BLANK"]),
    (claim("strange"), ["UNKNOWN_TYPE"]),
    (claim(snapshot="news"), ["NOT_OFFICIAL"]),
    (claim("company_fact", snapshot="sub"), []),
    (claim("company_fact", snapshot="fake"), ["NOT_OFFICIAL"]),
    (claim("price", "From EUR99 /month", "old", "EUR99"), ["STALE_FETCH"]),
    (claim(**JOB, content_date="2026-09-12", date_evidence="İlan tarihi: 12 Eylül 2026"), []),
    (claim(**JOB, content_date="2026-09-25", date_evidence="İlan tarihi: 12 Eylül 2026"), ["DATE_MISMATCH"]),
    (claim(**JOB), ["DATE_MISSING"]),
    (claim(**JOB, content_date="2026-09-12"), ["DATE_EVIDENCE_MISSING"]),
    (claim(**JOB, content_date="2026-12-12", date_evidence="meta:datePosted", snapshot="meta"), ["DATE_NOT_IN_META", "DATE_IN_FUTURE"]),
    (claim("news", "tarihli haber metni", "dated", "haber", content_date="2023-03-10", date_evidence="Yayın: 10.03.2023"), ["CONTENT_TOO_OLD"]),
    (claim("review", "Porsiyonlar küçülmüş, 3 hafta", statement="küçük", content_date="2026-09-06", date_evidence="3 hafta önce"), []),
    (claim(**JOB, snapshot="meta", content_date="2026-09-12", date_evidence="meta:datePosted"), []),
    (claim(**JOB, snapshot="meta", content_date="2026-09-20", date_evidence="meta:datePosted"), ["DATE_NOT_IN_META"]),
    (claim("person_title", "Genel Müdür: Ayşe Yılmaz", statement="GM"), []),
    (claim("person_title", "Genel Müdür: Ayşe Yılmaz", "news", "GM"), ["DATE_MISSING"]),
    (claim("contact", "info@acme-lokanta.com.tr", statement="mail", email="INFO@acme-lokanta.com.tr"), []),
    (claim("contact", "info@acme-lokanta.com.tr", statement="mail", email="ceo@acme-lokanta.com.tr"), ["EMAIL_MISMATCH"]),
    (claim("contact", statement="mail"), ["EMAIL_MISSING"]),
    (claim("contact", "[email protected] olarak", "masked", "mail"), ["EMAIL_MASKED"]),
    (claim("review", "Porsiyonlar küçülmüş, 3 hafta", "chrome", "küçük", content_date="2026-09-06", date_evidence="3 hafta önce"), []),
    (claim(snapshot="manual"), ["MANUAL_NOT_OFFICIAL"]),
    (claim("review", "Porsiyonlar küçülmüş, 3 hafta", "yemek", "küçük", content_date="2026-09-06", date_evidence="3 hafta önce"), ["EXCLUDED_SOURCE"]),
    (claim("company_fact", "Sekmede gizli bir bilgi", "hid", "x"), []),
    (claim("company_fact", "ACME LOKANTA Kurumsal From EUR99", statement="x"), ["QUOTE_NOT_FOUND"]),
    (claim(quote="100 şubeye", statement="100"), ["IS_TARGET"]),
    (claim(quote="88 şubesi olan rakip", statement="88"), []),
    (claim(quote="50 kişilik ekip ile", snapshot="crew", statement="50", value="50", unit="kişilik ekip"), ["IS_HEADCOUNT"]),
    (claim(value="15"), ["VALUE_NOT_IN_QUOTE"]),
    (claim(lead="nobody", type="review", quote="Porsiyonlar küçülmüş, 3 hafta", statement="k", content_date="2026-09-06", date_evidence="3 hafta önce"), ["UNKNOWN_LEAD"]),
    (claim("product_fact"), ["NOT_OWN_SOURCE"]),
    (claim("product_fact", "kendi dokümanımızdan bir söz", None, "söz", file="docs/a.md"), []),
    (claim("product_fact", "kendi dokümanımızdan bir söz", None, "söz", file="docs/none.md"), ["FILE_MISSING"]),
    (claim("product_fact", "kendi dokümanımızdan bir söz", None, "söz", file="/etc/x"), ["FILE_OUTSIDE"]),
    (claim(status="retracted", quote="nothing of this"), None),
]


@pytest.fixture(scope="module")
def checked(spark):
    names = [f.split()[0] for f in K.CLAIM_SCHEMA.split(", ")]
    rows = []
    for i, (c, _) in enumerate(CASES):
        c = {"pos": i, "scope": "run", "id": f"c{i:03d}"} | c
        rows.append(tuple(c.get(n) for n in names))
    claims = spark.createDataFrame(rows, K.CLAIM_SCHEMA)
    snaps = spark.createDataFrame([tuple(s.values()) for s in SNAPS], K.SNAPSHOT_SCHEMA)
    leads = spark.createDataFrame([("acme", "acme-lokanta.com.tr")], "id string, domain string")
    excluded = spark.createDataFrame([("yemeksepeti.com", "terms")], "domain string, reason string")
    files = spark.createDataFrame([("docs/a.md", "burada kendi dokümanımızdan bir söz var"), ("docs/none.md", None)], "path string, text string")
    out = K.verify(claims, snaps, K.policy(spark), TODAY, leads, excluded, "seller.com", files)
    return {r.pos: r for r in out.collect()}, out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_claim(checked, i):
    row = checked[0][i]
    want = CASES[i][1]
    assert row.errors == want, CASES[i][0]
    assert row.status == ("retracted" if want is None else "rejected" if want else "verified")
    assert row.layer == ("hidden" if CASES[i][0].get("snapshot") == "hid" else None)


def test_summary_and_policy(spark, checked):
    s = K.summary(checked[1]).first()
    assert s.total == len(CASES) and s.retracted == 1 and s.verified + s.rejected + 1 == s.total
    over = spark.createDataFrame([("news", 30), ("price", 2), ("own_type", 5)], "type string, days int")
    p = {r.type: r for r in K.policy(spark, over).collect()}
    assert (p["news"].max_content_age, p["news"].max_fetch_age) == (30, None)
    assert p["price"].max_fetch_age == 2 and p["own_type"].max_fetch_age == 5 and len(p) == 15
