"""Queries that bind the operators to the driver's tables, each with SQL for the same rows.

The tables hold no invisible or compatibility characters, so the SQL needs no folding of those; the operators fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import claims as K
from ..operators import discovery, drafts, evidence, kb, lifecycle, report, score, urls
from ..sources import html

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "2026-09-27"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def canonical_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(translate({c}, 'Iİ', 'ıi')), '\s+', ' ', 'g'))"


QUOTE_SQL = "CASE WHEN doc_id % 3 = 0 THEN reverse(substr(text, 6, 60)) ELSE replace(substr(text, 6, 60), ' ', '  ') END"


def quoted() -> F.Column:
    part = F.substring("text", 6, 60)
    return F.when(F.col("doc_id") % 3 == 0, F.reverse(part)).otherwise(F.replace(part, F.lit(" "), F.lit("  ")))


@query("quote_containment", f"""
WITH c AS (SELECT doc_id, {canonical_sql('text')} AS t, {canonical_sql(QUOTE_SQL)} AS q FROM documents)
SELECT doc_id, contains(t, q) AS found, CASE WHEN length(q) < 8 THEN 'QUOTE_TOO_SHORT' WHEN contains(t, q) THEN 'verified' ELSE 'QUOTE_NOT_FOUND' END AS status FROM c""")
def quote_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    snapshots = d.select("doc_id", X.canonical("text").alias("norm"))
    claims = d.select("doc_id", X.canonical(quoted()).alias("q"))
    found = X.contains_quote(F.col("norm"), F.col("q"))
    return snapshots.join(claims, "doc_id").select("doc_id", found.alias("found"), F.when(F.length("q") < 8, "QUOTE_TOO_SHORT").when(found, "verified").otherwise("QUOTE_NOT_FOUND").alias("status"))


@query("normalize_text", f"SELECT doc_id, length(n)::BIGINT AS n_chars, sha256(n) AS digest FROM (SELECT doc_id, {canonical_sql('text')} AS n FROM documents)")
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.canonical("text").alias("n"))
    return d.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("digest"))


@query("snapshot_integrity", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND contains(text, chr(10)) THEN 'repaired' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS state,
  sha256(CASE WHEN doc_id % 3 <> 1 AND doc_id % 5 = 0 THEN text || '!' ELSE text END) AS text_digest
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN doc_id * 0 + 1 END AS x, text FROM documents) WHERE NOT (doc_id % 3 = 1 AND doc_id % 5 = 0)""")
def snapshot_integrity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("not (doc_id % 3 = 1 and doc_id % 5 = 0)")
    kept = F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    stored = F.when((F.col("doc_id") % 3 != 1) & (F.col("doc_id") % 5 == 0), F.concat(kept, F.lit("!"))).when(F.col("doc_id") % 3 == 2, F.replace(kept, F.lit("\n"), F.lit("\r\n"))).otherwise(kept)
    s = d.select(F.col("doc_id").alias("id"), F.encode(stored, "UTF-8").alias("raw"), F.sha2(kept, 256).alias("sha256"))
    return lifecycle.repair(s).select(F.col("id").alias("doc_id"), "state", F.sha2("text", 256).alias("text_digest"))


@query("snapshot_integrity_whole", r"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'mismatch' WHEN doc_id % 3 = 1 AND contains(text, chr(10)) THEN 'repaired' ELSE 'ok' END AS state,
  sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS text_digest FROM documents""")
def snapshot_integrity_whole(spark, sf_dir):
    """snapshot_integrity leaves out documents with both changes, as its SQL does; here they have changed line feeds and a changed text."""
    d = table(spark, sf_dir, "documents")
    kept = F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    stored = F.when(F.col("doc_id") % 5 == 0, F.concat(kept, F.lit("!"))).when(F.col("doc_id") % 3 == 2, F.replace(kept, F.lit("\n"), F.lit("\r\n"))).otherwise(kept)
    s = d.select(F.col("doc_id").alias("id"), F.encode(stored, "UTF-8").alias("raw"), F.sha2(kept, 256).alias("sha256"))
    return lifecycle.repair(s).select(F.col("id").alias("doc_id"), "state", F.sha2("text", 256).alias("text_digest"))


@query("numbers_extract", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: replace(replace(x, '.', ''), ',', '')))), ' ') AS numbers FROM documents""")
def numbers_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.numbers("text")), " ").alias("numbers"))


@query("tokenize_stem", rf"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(list_transform(t, lambda x: substr(x, 1, 5)), ' ')) AS stems
FROM (SELECT doc_id, regexp_extract_all({canonical_sql('text')}, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS t FROM documents)""")
def tokenize_stem(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("t", lambda x: F.substring(x, 1, 5)), " "), 256).alias("stems"))


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
PATH_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("url_domain", f"SELECT page_id, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_host("url").alias("host"), X.url_path("url").alias("path"))


@query("excluded_sources", f"""
WITH x(pos, domain, reason) AS (VALUES (1, 'example.org', 'terms'), (2, 'example.net', 'robots'), (3, 'blog.thand.example.net', 'never first'), (4, 'ample.com', 'no match')),
h AS (SELECT page_id, {HOST_SQL} AS host FROM pages)
SELECT page_id, (SELECT arg_min(x.reason, x.pos) FROM x WHERE h.host = x.domain OR ends_with(h.host, '.' || x.domain)) AS excluded_reason FROM h""")
def excluded_sources(spark, sf_dir):
    rules = spark.createDataFrame([(1, "www.Example.org", "terms"), (2, "example.net", "robots"), (3, "blog.thand.example.net", "never first"), (4, "ample.com", "no match")], "pos int, domain string, reason string")
    return urls.excluded(table(spark, sf_dir, "pages"), rules).select("page_id", "excluded_reason")


KINDS = ["about-us", "blog", "ekip/x", "tr/kariyer", "kvkk-metni/press", "en/contact-us", "menu/location", "x/surdurulebilirlik"]
KIND_SQL = "'https://' || " + HOST_SQL + " || '/' || " + f"[{', '.join(repr(k) for k in KINDS)}][page_id % 8 + 1] || '/p' || (page_id % 40)"


def kind_urls(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % 8 + 1).cast("int"))
    url = F.concat(F.lit("https://"), X.url_host("url"), F.lit("/"), kind, F.lit("/p"), (F.col("page_id") % 40).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


TYPE_SQL = """CASE page_id % 8 WHEN 0 THEN 'about' WHEN 1 THEN 'press' WHEN 2 THEN 'team' WHEN 3 THEN 'careers' WHEN 5 THEN 'contact' WHEN 6 THEN 'branches' WHEN 7 THEN 'sustainability' END"""


@query("url_classify", f"SELECT page_id, {KIND_SQL} AS url, {TYPE_SQL} AS type FROM pages")
def url_classify(spark, sf_dir):
    return kind_urls(spark, sf_dir).select("page_id", "url", urls.classify(F.col("url")).alias("type"))


@query("pick_urls", f"""
WITH e AS (SELECT page_id AS pos, {KIND_SQL} AS url, {TYPE_SQL} AS type, regexp_extract({HOST_SQL}, '[^.]+\\.[^.]+$') AS domain, (page_id * 7919 % 1000)::VARCHAR AS lastmod FROM pages),
o AS (SELECT *, length(p) - length(replace(p, '/', '')) AS depth, length(p) AS len FROM (SELECT *, regexp_replace(regexp_extract(url, '^https://[^/]*(.*)$', 1), '^/+|/+$', '', 'g') AS p FROM e WHERE type IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY domain, type, url ORDER BY pos) = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY domain, type ORDER BY depth, len, pos) AS n FROM o),
c AS (SELECT *, CASE WHEN type = 'press' THEN row_number() OVER (PARTITION BY domain, type ORDER BY (n <> 1)::INT, lastmod DESC, pos) ELSE n END AS k,
  list_position(['about', 'branches', 'team', 'careers', 'press', 'sustainability', 'contact'], type) AS t FROM s)
SELECT domain, url, type, row_number() OVER (PARTITION BY domain ORDER BY t, k)::INT AS rank FROM c
WHERE k <= [3, 3, 3, 4, 8, 3, 2][t] QUALIFY rank <= 20""")
def pick_urls(spark, sf_dir):
    e = kind_urls(spark, sf_dir).select(F.regexp_extract(X.url_host("url"), r"[^.]+\.[^.]+\z", 0).alias("domain"), F.col("page_id").alias("pos"), "url", (F.col("page_id") * 7919 % 1000).cast("string").alias("lastmod"))
    return urls.pick(e, 20)


@query("sitemap_parse", "SELECT page_id, 'page' AS kind, trim(url) AS loc, CASE WHEN page_id % 2 = 0 THEN '2026-01-01' ELSE '' END AS lastmod FROM pages UNION ALL SELECT page_id, 'sitemap', trim(url) || '.xml', '' FROM pages WHERE page_id % 3 = 0")
def sitemap_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url is not null")
    page = F.concat(F.lit("<urlset><url>\n<loc> "), "url", F.lit(" </loc>"), F.when(F.col("page_id") % 2 == 0, "<lastmod>2026-01-01</lastmod>").otherwise(""), F.lit("</url><url>no place</url></urlset>"))
    index = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<sitemapindex><sitemap> <loc>"), "url", F.lit(".xml</loc></sitemap></sitemapindex>"))).otherwise("")
    return urls.sitemap(p.select("page_id", F.concat(page, index).alias("body")))


@query("link_harvest", """
SELECT page_id, len(l)::BIGINT AS n_links, sha256(array_to_string(l, ' ')) AS links
FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def link_harvest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.links(F.col("html")).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.sha2(F.array_join("l", " "), 256).alias("links"))


@query("visible_text")
def visible_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", html.visible_text("html").alias("text"), html.full_text("html").alias("full_text"))
    return lifecycle.store_layers(p).select("page_id", "chars", "sha256", "full_chars")


MARK_SQL = "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in urls.CHALLENGES) + ")"


@query("bot_challenge", f"SELECT doc_id, s AS status, s IN (403, 429) OR (length(text) < 3000 AND {MARK_SQL}) AS challenge, s IN (401, 403, 407, 429, 444) OR (length(text) < 3000 AND {MARK_SQL}) AS blocked FROM (SELECT doc_id, text, [200, 403, 429, 401, 503][doc_id % 5 + 1] AS s FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' Captcha' ELSE text END AS text FROM documents))")
def bot_challenge(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, [200, 403, 429, 401, 503])), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" Captcha"))).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", "status", urls.bot_challenge(F.col("status"), F.col("text")).alias("challenge"), urls.spider_blocked(F.col("status"), F.col("text")).alias("blocked"))


@query("fetch_best_attempt", f"""
WITH a AS (SELECT doc_id // 3 AS page, doc_id % 3 AS seq, 'm' || (doc_id % 3) AS method, [200, 200, 404, 200, 429, 500, 204][doc_id % 7 + 1] AS status, text, doc_id % 2 AS missing, doc_id % 11 = 0 AS failed, length(text) AS chars FROM documents),
f AS (SELECT *, NOT failed AND status BETWEEN 200 AND 299 AS good, NOT failed AND status IN (404, 410) AS gone, NOT failed AND status NOT IN (404, 410) AND (status IN (403, 429) OR (chars < 3000 AND {MARK_SQL})) AS challenge FROM a),
s AS (SELECT *, max((gone OR challenge OR (good AND chars >= 400 AND missing = 0))::INT) OVER (PARTITION BY page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM f),
g AS (SELECT page, bool_or(gone) AS gone, bool_or(challenge) AS challenge, arg_max({{'method': method, 'good': good, 'chars': chars}}, ((good::BIGINT * 2 + 2 - missing) * 100000000 + chars) * 10 - seq) FILTER (WHERE NOT failed) AS best FROM s WHERE coalesce(stopped, 0) = 0 GROUP BY page),
r AS (SELECT *, NOT challenge AND coalesce(best.good AND best.chars >= 150, false) AS ok FROM g)
SELECT page, ok, CASE WHEN NOT challenge THEN best.method END AS method, CASE WHEN challenge THEN 'BOT_CHALLENGE' WHEN gone THEN 'GONE' WHEN NOT ok THEN 'TOO_LITTLE_CONTENT' END AS error FROM r""")
def fetch_best_attempt(spark, sf_dir):
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, [200, 200, 404, 200, 429, 500, 204])), (i % 7 + 1).cast("int"))
    a = table(spark, sf_dir, "documents").select(F.floor(i / 3).alias("page"), (i % 3).alias("seq"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("method"), status.alias("status"), "text", F.lit(2).alias("n_expected"), (i % 2).alias("n_missing"), (i % 11 == 0).alias("failed"))
    return urls.best_attempt(a)


@query("date_quotes", "SELECT o_orderkey, (CASE WHEN o_orderkey % 7 = 6 THEN DATE '2026-09-27' - (o_orderkey % 50 * 7)::INT ELSE o_orderdate::DATE END)::VARCHAR AS stated, CASE WHEN o_orderkey % 7 = 6 THEN 7 ELSE 0 END AS tolerance FROM orders")
def date_quotes(spark, sf_dir):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    month = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(d))
    turkish = ["Ocak", "Şubat", "MART", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "EYLÜL", "Ekim", "KASIM", "Aralık"]
    english = ["January", "FEB", "March", "APRIL", "May", "June", "July", "Aug", "Sept", "October", "Nov", "DEC"]
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("İlan tarihi: "), day, F.lit(" "), month(turkish), F.lit(" "), year)).when(k % 7 == 1, F.concat(month(english), F.lit(" "), day, F.lit(", "), year))
        .when(k % 7 == 2, F.date_format(d, "dd.MM.yyyy")).when(k % 7 == 3, F.concat(d.cast("string"), F.lit("T08:00"))).when(k % 7 == 4, F.concat(day, F.lit(". "), month(turkish), F.lit(", "), year))
        .when(k % 7 == 5, F.date_format(d, "'on' d/M/yyyy")).otherwise(F.concat((k % 50).cast("string"), F.lit(" HAFTA önce")))
    )
    q = table(spark, sf_dir, "orders").select("o_orderkey", D.date_quote(text, F.lit(TODAY).cast("date")).alias("x"))
    return q.select("o_orderkey", F.col("x.date").cast("string").alias("stated"), F.col("x.tolerance").alias("tolerance"))


@query("claims_verify", f"""
WITH c AS (SELECT doc_id, source, text, ['company_fact', 'disqualifier', 'product_fact', 'strange', 'vendor_reference'][doc_id % 5 + 1] AS type, {canonical_sql('text')} AS t, {canonical_sql(QUOTE_SQL)} AS q, {QUOTE_SQL} AS quote,
  source || '.example.com' AS domain, CASE WHEN doc_id % 6 = 0 THEN 'src1.example.com' ELSE source || '.example.com' END AS lead_domain FROM documents),
n AS (SELECT *, list_transform(regexp_extract_all(quote, '\\d+(?:[.,]\\d+)*'), lambda x: replace(replace(x, '.', ''), ',', '')) AS nq FROM c)
SELECT doc_id, array_to_string(CASE
  WHEN type = 'strange' THEN ['UNKNOWN_TYPE'] WHEN trim(quote) = '' THEN ['QUOTE_BLANK'] WHEN length(q) < 8 THEN ['QUOTE_TOO_SHORT'] WHEN doc_id % 13 = 0 THEN ['SNAPSHOT_NOT_OK'] WHEN doc_id % 17 = 0 THEN ['SNAPSHOT_CHANGED']
  ELSE list_filter([CASE WHEN NOT contains(t, q) THEN 'QUOTE_NOT_FOUND' END, CASE WHEN domain IN ('src2.example.com', 'src3.example.com') THEN 'EXCLUDED_SOURCE' END,
    CASE WHEN type = 'company_fact' AND domain <> lead_domain THEN 'NOT_OFFICIAL' END, CASE WHEN type = 'product_fact' AND domain <> 'src0.example.com' THEN 'NOT_OWN_SOURCE' END,
    CASE WHEN doc_id % 11 = 0 AND type IN ('company_fact', 'disqualifier', 'vendor_reference') THEN 'STALE_FETCH' END,
    CASE WHEN NOT list_contains(nq, (doc_id % 4)::VARCHAR) THEN 'UNSUPPORTED_NUMBERS' END], lambda x: x IS NOT NULL) END, ' ') AS errors FROM n""")
def claims_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("domain", F.concat("source", F.lit(".example.com")))
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    snapshots = d.select(
        F.lit("run").alias("scope"), i.cast("string").alias("id"), F.lit("").alias("url"), "domain", none.alias("final_domain"), F.when(i % 11 == 0, "2026-08-01").otherwise("2026-09-26T10:00:00").alias("fetched_at"),
        (i % 13 != 0).alias("ok"), F.lit("http").alias("method"), F.when(i % 17 == 0, "changed").otherwise(F.sha2("text", 256)).alias("sha256"), none.alias("full_sha256"), F.lit(None).cast("map<string,array<string>>").alias("html_dates"), "text", none.alias("full_text"),
    )
    kind = F.element_at(F.array(*map(F.lit, ["company_fact", "disqualifier", "product_fact", "strange", "vendor_reference"])), (i % 5 + 1).cast("int"))
    claims = d.select(
        i.alias("pos"), F.lit("run").alias("scope"), F.concat(F.lit("c"), i.cast("string")).alias("id"), F.when(i % 6 == 0, "src1").otherwise(F.col("source")).alias("lead"), kind.alias("type"), i.cast("string").alias("snapshot"), none.alias("file"),
        F.concat((i % 4).cast("string"), F.lit(" of them")).alias("statement"), quoted().alias("quote"), *(none.alias(c) for c in ("value", "unit", "email", "signal", "content_date", "date_evidence", "status")),
    )
    leads = d.select(F.col("source").alias("id"), "domain").distinct()
    excluded = spark.createDataFrame([("src2.example.com", "terms"), ("www.SRC3.example.com", "terms")], "domain string, reason string")
    out = K.verify(claims, snapshots, K.policy(spark), TODAY, leads, excluded, "www.src0.example.com")
    return out.select(F.col("pos").alias("doc_id"), F.array_join("errors", " ").alias("errors"))


@query("draft_hash_review", """
SELECT doc_id, sha256('to' || doc_id || chr(31) || 'email' || chr(31) || coalesce(source, '') || chr(31) || text) AS draft_sha,
  doc_id % 2 = 0 AND doc_id % 3 = 0 AS ready,
  CASE WHEN doc_id % 2 = 0 THEN 'code: ok' ELSE 'code: failed (NO_EVIDENCE)' END || ' | ' || CASE doc_id % 3 WHEN 0 THEN 'review: ok' WHEN 1 THEN 'review: failed (changed after review)' ELSE 'review: pending' END AS note FROM documents""")
def draft_hash_review(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("to"), i.cast("string")).alias("to"), F.lit("email").alias("channel"), F.col("source").alias("subject"), F.col("text").alias("body"), F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("NO_EVIDENCE"))).alias("errors"))
    sha = drafts.draft_sha()
    review = F.when(i % 3 < 2, F.struct(F.lit("pass").alias("verdict"), F.array().cast("array<string>").alias("issues"), F.when(i % 3 == 0, sha).otherwise("old").alias("draft_sha")))
    d = d.withColumn("review", review)
    ready, note = drafts.review_state()
    return d.select("doc_id", sha.alias("draft_sha"), ready.alias("ready"), note.alias("note"))


@query("bm25_topk", rf"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all({canonical_sql('text')}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: substr(x, 1, 5)) AS terms FROM documents),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all({canonical_sql("array_to_string(string_split(text, ' ')[1:4], ' ')")}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: substr(x, 1, 5))) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("text"))
    return kb.search(docs, asked, 5, digits=6).select("query_id", "doc_id", "score", "rank")


@query("bm25_topk_whole", SQL["bm25_topk"].replace("array_to_string(string_split(text, ' ')[1:4], ' ')", "text"))
def bm25_topk_whole(spark, sf_dir):
    """bm25_topk asks for the first four words of each item, as its SQL does; this for the whole item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return kb.search(docs, asked, 5, digits=6).select("query_id", "doc_id", "score", "rank")


@query("size_prescreen", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size BETWEEN 5 AND 20 WHEN 1 THEN p_size <= 30 END AS in_range FROM part")
def size_prescreen(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["Şubemiz", "satış noktaya", "firma"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    rules = [{"units": ["şube", "mağaza"], "min": 5, "max": 20}, {"unit": "nokta", "max": 30}]
    return table(spark, sf_dir, "part").select("p_partkey", score.size_in_range(F.col("p_size"), unit, rules).alias("in_range"))


SCORE_CLAIMS = """SELECT o_custkey AS lead, o_orderkey AS pos, 'c' || o_orderkey AS id, 's' || o_orderkey AS statement, o_orderdate::DATE AS day,
  CASE WHEN o_orderkey % 997 = 0 THEN 'disqualifier' ELSE ['branch_count', 'job_post', 'review', 'person_title', 'contact', 'news', 'public_post', 'company_fact'][o_orderkey % 8 + 1] END AS type,
  CASE WHEN o_orderkey % 8 IN (1, 2, 5, 6) THEN ['job_post', 'review', '', '', 'news', 'public_post'][o_orderkey % 8] WHEN o_orderkey % 24 = 7 THEN 'segment' END AS signal,
  o_orderkey % 60 AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'otel' ELSE 'şubemiz' END AS unit, o_orderkey % 16 = 3 AS titled FROM orders"""


@query("lead_score", f"""
WITH c AS ({SCORE_CLAIMS}),
p(signal, points) AS (VALUES ('job_post', 15), ('news', 10), ('review', 10), ('public_post', 8)),
a AS (SELECT lead, bool_or(type = 'disqualifier') AS out, coalesce(bool_or(signal = 'segment'), false) AS segment, bool_or(type = 'person_title') AS person, bool_or(type = 'contact') AS contact, bool_or(type = 'person_title' AND titled) AS wanted,
  arg_min(value, pos) FILTER (WHERE type = 'branch_count' AND unit = 'şubemiz') AS size,
  max(day) FILTER (WHERE signal IN ('job_post', 'news', 'review', 'public_post')) AS newest FROM c GROUP BY lead),
g AS (SELECT lead, sum(points) AS sp FROM (SELECT DISTINCT lead, signal, points FROM c JOIN p USING (signal)) GROUP BY lead),
s AS (SELECT c_custkey AS lead, coalesce(out, false) AS out, CASE WHEN segment THEN 20 ELSE 0 END + CASE WHEN size BETWEEN 10 AND 40 THEN 15 ELSE 0 END AS fit,
  least(35, coalesce(sp, 0) + CASE WHEN wanted THEN 15 ELSE 0 END) AS signal, CASE WHEN newest IS NULL THEN 0 WHEN DATE '1998-08-02' - newest <= 30 THEN 20 WHEN DATE '1998-08-02' - newest <= 90 THEN 12 WHEN DATE '1998-08-02' - newest <= 180 THEN 6 ELSE 0 END AS timing,
  CASE WHEN person THEN 7 ELSE 0 END + CASE WHEN contact THEN 3 ELSE 0 END AS reach, size IS NOT NULL AND NOT coalesce(size BETWEEN 10 AND 40, false) AS outside FROM customer LEFT JOIN a ON a.lead = c_custkey LEFT JOIN g ON g.lead = c_custkey)
SELECT lead, CASE WHEN out THEN 0 ELSE fit + signal + timing + reach END::INT AS score, CASE WHEN out THEN 'X' WHEN outside THEN 'C' WHEN fit + signal + timing + reach >= 70 THEN 'A' WHEN fit + signal + timing + reach >= 45 THEN 'B' ELSE 'C' END AS tier,
  CASE WHEN NOT out THEN fit END::INT AS fit, CASE WHEN NOT out THEN signal END::INT AS signal, CASE WHEN NOT out THEN timing END::INT AS timing, CASE WHEN NOT out THEN reach END::INT AS reach FROM s""")
def lead_score(spark, sf_dir):
    return scored(spark, sf_dir).select("lead", "score", "tier", "fit", "signal", "timing", "reach")


def scored(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ["branch_count", "job_post", "review", "person_title", "contact", "news", "public_post", "company_fact"]))
    kind = F.element_at(kinds, (k % 8 + 1).cast("int"))
    claims = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lead"), k.alias("pos"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("statement"), F.when(k % 997 == 0, "disqualifier").otherwise(kind).alias("type"),
        F.when((k % 8).isin(1, 2, 5, 6), kind).when(k % 24 == 7, "segment").alias("signal"), F.when(k % 8 == 0, (k % 60).cast("string")).alias("value"), F.when(k % 5 == 0, "otel").otherwise("ŞUBEMİZ").alias("unit"),
        F.when(k % 16 == 3, "GENEL MÜDÜR Ayşe").otherwise("stajyer").alias("quote"), F.col("o_orderdate").cast("date").cast("string").alias("content_date"), F.lit("verified").alias("status"),
    )
    leads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return score.score(leads, claims, "1998-08-02", [{"units": ["şube"], "min": 10, "max": 40}], ["genel müdür"])


@query("tier_histogram", f"SELECT tier, count(*) AS n FROM ({SQL['lead_score']}) GROUP BY tier")
def tier_histogram(spark, sf_dir):
    return score.tier_histogram(scored(spark, sf_dir))


@query("evidence_lines", r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, i::INT - 1 AS line_no, sha256(l[i]) AS line, sha256(array_to_string(list_filter([CASE WHEN i > 1 THEN l[i - 1] END, l[i], l[i + 1]], lambda x: x IS NOT NULL), ' ')) AS around, sha256(array_to_string(l[i:i + 5], chr(10))) AS block FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)""")
def evidence_lines(spark, sf_dir):
    e = evidence.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.select("doc_id", "line_no", *(F.sha2(c, 256).alias(c) for c in ("line", "around", "block")))


@query("complaint_grouping", """
SELECT user_id AS entity, array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS sources, count(DISTINCT CASE WHEN event_id % 9 <> 0 THEN event_type || event_id % 50 END)::INT AS n,
  arg_min(event_id, event_id) FILTER (WHERE event_id % 9 <> 0) AS first_item FROM events GROUP BY user_id""")
def complaint_grouping(spark, sf_dir):
    k = F.col("event_id")
    items = table(spark, sf_dir, "events").select(k.alias("pos"), F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.when(k % 9 != 0, F.concat("event_type", (k % 50).cast("string"))).alias("url"), k.cast("string").alias("title"), F.lit("").alias("date_text"))
    return discovery.complaints(items).select("entity", F.array_join("sources", " ").alias("sources"), F.col("count").alias("n"), F.get("items", F.lit(0))["title"].cast("long").alias("first_item"))


@query("directory_dedup", r"""
SELECT p_name AS entity, p_partkey AS pos, count FROM (SELECT p_name, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 0 END AS count, regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', '', 'g') AS k FROM part)
WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY (coalesce(count, 0) = 0)::INT, p_partkey) = 1""")
def directory_dedup(spark, sf_dir):
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), k.alias("pos"), F.when(k % 3 == 0, F.col("p_size")).when(k % 3 == 1, 0).alias("count"))
    return discovery.directory(e)


@query("promote_leads", r"""
WITH e AS (SELECT c_custkey AS pos, c_name AS entity, CASE WHEN c_custkey % 7 <> 0 THEN 'd' || (c_custkey % 400) || '.example' END AS domain, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS fits FROM customer),
n AS (SELECT * FROM e WHERE fits IS NOT FALSE AND domain IS NOT NULL AND domain NOT IN (SELECT 'd' || s_suppkey || '.example' FROM supplier) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pos) = 1)
SELECT pos, trim(regexp_replace(lower(entity), '[^a-z0-9]+', '-', 'g'), '-') AS id, domain, CASE WHEN pos % 2 = 0 THEN 'directory (list): ' || pos % 90 || ' şube (a hint, no evidence)' ELSE 'directory (list): size not stated (a hint, no evidence)' END AS discovery_note FROM n WHERE pos % 90 <> 0 OR pos % 2 = 1
UNION ALL SELECT pos, trim(regexp_replace(lower(entity), '[^a-z0-9]+', '-', 'g'), '-'), domain, 'directory (list): size not stated (a hint, no evidence)' FROM n WHERE pos % 90 = 0 AND pos % 2 = 0""")
def promote_leads(spark, sf_dir):
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(
        k.alias("pos"), F.col("c_name").alias("entity"), F.lit("list").alias("source"), F.lit("https://list.example").alias("url"), F.when(k % 2 == 0, k % 90).alias("count"), F.lit("şube").alias("unit"),
        F.when(k % 7 != 0, F.concat(F.lit("d"), (k % 400).cast("string"), F.lit(".example"))).alias("domain"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("size_in_range"),
    )
    leads = table(spark, sf_dir, "supplier").select(F.concat(F.lit("lead"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"))
    return discovery.promote(e, leads)[0].select("pos", "id", "domain", "discovery_note")


@query("tri_state_counts", "SELECT count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_size > 10) AS in_range, count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_size <= 10) AS out_of_range, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS unknown FROM part")
def tri_state_counts(spark, sf_dir):
    return discovery.tri_state(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") > 10).alias("size_in_range")))


@query("csv_neutralize", "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '''' ELSE '' END || ['=', '-', chr(9), ' '][doc_id % 4 + 1] || source AS cell FROM documents")
def csv_neutralize(spark, sf_dir):
    start = F.element_at(F.array(*map(F.lit, ["=", "-", "\t", " "])), (F.col("doc_id") % 4 + 1).cast("int"))
    return report.csv_rows(table(spark, sf_dir, "documents").select("doc_id", F.concat(start, "source").alias("cell")))


@query("email_harvest", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+(?:\.[\p{L}\p{M}\p{N}_-]+)+'), ' ') AS emails FROM documents")
def email_harvest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.emails("text"), " ").alias("emails"))


@query("claim_merge", "SELECT o_orderkey AS id, 'kb' AS scope FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'run' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def claim_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return lifecycle.merge_claims(o.where("id % 2 = 0").withColumn("scope", F.lit("run")), o.where("id % 3 = 0").withColumn("scope", F.lit("kb")))


@query("draft_upsert", "SELECT c_custkey AS lead, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS body, (CASE WHEN c_custkey % 4 = 0 THEN c_custkey + (SELECT max(c_custkey) FROM customer) + 1 ELSE c_custkey END)::BIGINT AS pos FROM customer")
def draft_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead"), F.col("c_custkey").alias("pos"))
    return lifecycle.upsert_drafts(c.withColumn("body", F.lit("old")), c.where("lead % 4 = 0").withColumn("body", F.lit("new"))).select("lead", "body", F.col("pos").cast("long").alias("pos"))


PART_SLUG_SQL = "substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)"


@query("new_lead_ids", f"SELECT p_partkey AS pos, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT p_partkey, {PART_SLUG_SQL} AS slug, row_number() OVER (PARTITION BY {PART_SLUG_SQL} ORDER BY p_partkey) AS n FROM part)")
def new_lead_ids(spark, sf_dir):
    return lifecycle.new_ids(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))).select("pos", "id")


@query("promote_gaps", f"""
SELECT p_partkey AS pos, slug || '-' || CASE WHEN n = 1 THEN 2 ELSE n + 3 END AS id
FROM (SELECT p_partkey, {PART_SLUG_SQL} AS slug, row_number() OVER (PARTITION BY {PART_SLUG_SQL} ORDER BY p_partkey) AS n FROM part)""")
def promote_gaps(spark, sf_dir):
    """Each slug is taken already, with -3 and -4 but without -2."""
    part = table(spark, sf_dir, "part")
    e = part.select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("entity"), F.lit("list").alias("source"), F.lit("https://list.example").alias("url"), F.lit(None).cast("long").alias("count"), F.lit("şube").alias("unit"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".example")).alias("domain"), F.lit(None).cast("boolean").alias("size_in_range"),
    )
    ids = part.select(X.slug("p_name").alias("slug")).distinct().select(F.explode(F.transform(F.array(*map(F.lit, ["", "-3", "-4"])), lambda x: F.concat("slug", x))).alias("id"))
    return discovery.promote(e, ids.withColumn("domain", F.concat("id", F.lit(".example"))))[0].select("pos", "id")


@query("site_states", """
SELECT page_id, CASE WHEN regexp_matches(t, '(?i)suspendedpage|account[-_ ]suspended|domain[-_ ]?(is )?for[-_ ]sale|parkingcrew|sedoparking') THEN 'parked'
  WHEN regexp_matches(t, '(?i)/maintenance|/bakim|bakımdayız|under maintenance') THEN 'closed' END AS state
FROM (SELECT page_id, url || ' ' || substr(CASE page_id % 4 WHEN 0 THEN 'This Domain is for sale ' WHEN 1 THEN 'UNDER MAINTENANCE' WHEN 2 THEN repeat('x', 490) || ' parkingcrew' ELSE '' END || html, 1, 500) AS t FROM pages)""")
def site_states(spark, sf_dir):
    start = F.element_at(F.array(F.lit("This Domain is for sale "), F.lit("UNDER MAINTENANCE"), F.lit("x" * 490 + " parkingcrew"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.site_state(F.col("url"), F.concat(start, "html")).alias("state"))


@query("reviews_set", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END ELSE 'old' END AS verdict,
  CASE WHEN doc_id % 3 = 0 THEN sha256('to' || doc_id || chr(31) || 'email' || chr(31) || coalesce(source, '') || chr(31) || text) ELSE 'old' END AS draft_sha,
  CASE WHEN doc_id % 6 = 3 THEN 'tone' ELSE '' END AS issues FROM documents""")
def reviews_set(spark, sf_dir):
    """New verdicts on one draft in three; the others keep theirs."""
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents").select("doc_id", i.cast("string").alias("lead"), F.concat(F.lit("to"), i.cast("string")).alias("to"), F.lit("email").alias("channel"), F.col("source").alias("subject"), F.col("text").alias("body"), F.struct(F.lit("old").alias("verdict"), none.alias("issues"), F.lit("old").alias("draft_sha")).alias("review"))
    r = d.where(i % 3 == 0).select("lead", F.when(i % 2 == 0, "pass").otherwise("fail").alias("verdict"), F.when(i % 2 == 1, F.array(F.lit("tone"))).otherwise(none).alias("issues"))
    return drafts.set_review(d, r).select("doc_id", "review.verdict", "review.draft_sha", F.array_join("review.issues", " ").alias("issues"))


@query("verification_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified, count(*) FILTER (WHERE o_orderstatus = 'P') AS retracted, count(*) FILTER (WHERE o_orderstatus = 'O') AS rejected FROM orders")
def verification_summary(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("F", "verified", "P", "retracted", "O", "rejected")))
    return K.summary(table(spark, sf_dir, "orders").select(F.try_element_at(names, F.col("o_orderstatus")).alias("status")))


SPIDER_SQL = f"""SELECT page_id, {HOST_SQL} AS domain, url, ['about', 'press', 'contact', 'other'][page_id % 4 + 1] AS type, CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END AS status,
  CASE WHEN page_id % 3 = 0 THEN 'http' ELSE 'browser' END AS method, CASE WHEN page_id % 5 = 0 THEN substr(html, 1, 100) ELSE html END AS text FROM pages"""


def spider_pages(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ["about", "press", "contact", "other"])), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        X.url_host("url").alias("domain"), i.alias("snapshot"), kind.alias("type"), "url", F.when(i % 10 == 0, 404).when(i % 10 == 1, 403).otherwise(200).alias("status"),
        F.when(i % 3 == 0, "http").otherwise("browser").alias("method"), F.when(i % 5 == 0, F.substring("html", 1, 100)).otherwise(F.col("html")).alias("text"), (i % 2 == 0).alias("has_full"),
    )


@query("spider_pages", f"""
SELECT page_id AS snapshot, state, CASE WHEN state = 'saved' THEN length(text) >= 150 END AS ok, CASE WHEN state = 'saved' THEN length(text) END::INT AS chars, CASE WHEN state = 'saved' THEN page_id % 2 = 0 END AS has_hidden_layer,
  CASE type WHEN 'about' THEN 0 WHEN 'press' THEN 4 WHEN 'contact' THEN 6 ELSE -1 END AS place
FROM (SELECT *, CASE WHEN status <> 200 THEN 'failed' WHEN length(text) < 150 AND method = 'http' THEN 'render' ELSE 'saved' END AS state FROM ({SPIDER_SQL}))""")
def spider_page_rows(spark, sf_dir):
    return urls.spider_rows(spider_pages(spark, sf_dir)).select("snapshot", "state", "ok", "chars", "has_hidden_layer", "place")


@query("crawl_summary", f"""
WITH p AS (SELECT *, CASE WHEN status <> 200 THEN 'failed' WHEN length(text) < 150 AND method = 'http' THEN 'render' ELSE 'saved' END AS state FROM ({SPIDER_SQL}))
SELECT domain, count(*) FILTER (WHERE state = 'saved') AS n_pages, count(*) FILTER (WHERE state = 'saved' AND length(text) >= 150) AS n_ok, count(*) FILTER (WHERE status = 404) AS n_failed, count(*) FILTER (WHERE status = 403) AS n_blocked,
  count(*) FILTER (WHERE page_id % 7 = 0) AS n_robots FROM p GROUP BY domain""")
def crawl_summary(spark, sf_dir):
    pages = spider_pages(spark, sf_dir)
    rows = urls.spider_rows(pages).join(pages.select("snapshot", (F.col("status") == 403).alias("blocked")), "snapshot")
    return urls.crawl_summary(rows, pages.where(F.col("snapshot") % 7 == 0).select("domain"))


@query("wanted_listings", "SELECT s_suppkey AS pos, 'l' || s_suppkey AS id, s_name AS url FROM supplier WHERE s_suppkey % 3 = 0")
def wanted_listings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    catalogue = s.select(F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("url"))
    wanted = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("id"))
    return discovery.wanted_listings(catalogue, wanted).select("pos", "id", "url")
