"""Claims checked against saved pages: one ordered array of error codes for each claim.

A claim passes if it has no error. Errors come in a fixed order. Some stand alone, each of them ending the check: an
unknown type, blank fields, a quote that is too short or too long, a source that can't be used. All others add up. Texts
are folded once for each snapshot, before the join. Policy and exclusions are small dimensions; exclusions are joined by
equality on every parent domain of a snapshot, so that a long list needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as X

POLICY_SCHEMA = "type string, source string, max_fetch_age int, max_content_age int, undated_official_ok boolean"
# Where each type of claim may come from, and how old page and content may be, in days.
POLICY = [
    ("company_fact", "official", 7, None, False),
    ("price", "official", 7, None, False),
    ("branch_count", "official", 7, None, False),
    ("contact", "official", 7, None, False),
    ("job_post", None, None, 60, False),
    ("news", None, None, 365, False),
    ("review", None, None, 180, False),
    ("public_post", None, None, 180, False),
    ("person_title", None, 7, 365, True),
    ("disqualifier", None, 30, None, False),
    ("vendor_reference", None, 30, None, False),
    ("product_fact", "own", None, None, False),
    ("case_study", None, 180, None, False),
    ("competitor_fact", None, 30, None, False),
]
KB_TYPES = ("product_fact", "case_study", "competitor_fact")
LEAD_TYPES = tuple(p[0] for p in POLICY if p[0] not in KB_TYPES)
# Wording of plans, and units that count people.
TARGET_WORDS = ["hedef", "sonuna kadar", "ulaşmayı", "planlıyor", "planlanan", "açılacak", "açmayı", "target", "by the end of", "aims to", "plans to"]
STAFF_UNITS = ["ekip", "çalışan", "personel", "istihdam", "employee", "staff"]
MANUAL = ("manual", "chrome")


def policy(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """The default rules; an override (type, days) sets the content age where the type has one, else the fetch age."""
    base = spark.createDataFrame(POLICY, POLICY_SCHEMA)
    if overrides is None:
        return base
    o = overrides.select("type", F.col("days").cast("int").alias("days"))
    content = F.col("max_content_age").isNotNull()
    return base.join(o, "type", "full").select(
        "type", "source",
        F.when(F.col("days").isNotNull() & ~content, F.col("days")).otherwise(F.col("max_fetch_age")).alias("max_fetch_age"),
        F.when(F.col("days").isNotNull() & content, F.col("days")).otherwise(F.col("max_content_age")).alias("max_content_age"),
        F.coalesce("undated_official_ok", F.lit(False)).alias("undated_official_ok"),
    )


def ready_snapshots(snapshots: DataFrame, compatibility: bool = True) -> DataFrame:
    """One row for each (scope, id): integrity, folded texts and effective domain, computed once."""
    full_known = F.col("full_sha256").isNotNull() & F.col("full_text").isNotNull()
    return snapshots.select(
        F.col("scope").alias("s_scope"), F.col("id").alias("s_id"),
        F.coalesce("ok", F.lit(False)).alias("s_ok"), F.col("text").isNotNull().alias("s_has_text"),
        F.coalesce(F.sha2("text", 256) == F.col("sha256"), F.lit(False)).alias("s_intact"),
        (~full_known | F.coalesce(F.sha2("full_text", 256) == F.col("full_sha256"), F.lit(False))).alias("s_full_intact"),
        X.canonical(F.coalesce("text", F.lit("")), compatibility).alias("s_norm"),
        F.when(full_known & (F.col("full_text") != ""), X.canonical("full_text", compatibility)).alias("s_full_norm"),
        F.coalesce(F.nullif("final_domain", F.lit("")), "domain", F.lit("")).alias("s_domain"),
        dates.iso_date("fetched_at").alias("s_fetched"), F.col("method").alias("s_method"), F.col("html_dates").alias("s_dates"),
    )


def error(condition: Column, code: str) -> Column:
    return F.when(condition, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))


def located(quote: Column) -> Column:
    """visible, hidden, or null: where a folded quote stands in the joined snapshot or file."""
    return F.when(F.contains("s_norm", quote), "visible").when(F.coalesce(F.contains("s_full_norm", quote), F.lit(False)), "hidden")


def date_errors(today: Column, compatibility: bool) -> Column:
    claimed, evidence = dates.iso_date("content_date"), X.strip(F.coalesce("date_evidence", F.lit("")))
    named = F.coalesce(F.map_contains_key("s_dates", evidence), F.lit(False))
    by_key = F.startswith(evidence, F.lit("meta:")) | named
    key = F.when(named, evidence).otherwise(F.regexp_replace(evidence, r"\Ameta:", ""))
    values = F.coalesce(F.try_element_at("s_dates", key), F.array().cast("array<string>"))
    among = F.coalesce(F.exists(values, lambda v: dates.iso_date(v) == claimed), F.lit(False))
    stated = dates.date_quote(evidence, F.coalesce("s_fetched", today), compatibility)
    tolerance = F.when(~by_key & stated.isNotNull(), stated["tolerance"]).otherwise(0)
    gap = F.abs(F.datediff(stated["date"], claimed))
    found = F.concat(
        error(by_key & ~among, "DATE_NOT_IN_META"),
        error(~by_key & located(X.canonical(evidence, compatibility)).isNull(), "DATE_QUOTE_NOT_FOUND"),
        error(~by_key & stated.isNull(), "DATE_UNREADABLE"),
        error(~by_key & F.coalesce(gap > stated["tolerance"], F.lit(False)), "DATE_MISMATCH"),
        error(claimed > today, "DATE_IN_FUTURE"),
        error(F.datediff(today, F.date_sub(claimed, tolerance)) > F.col("max_content_age"), "CONTENT_TOO_OLD"),
    )
    return (
        F.when(claimed.isNull(), error(~(F.col("undated_official_ok") & F.col("official")), "DATE_MISSING"))
        .when(evidence == "", F.array(F.lit("DATE_EVIDENCE_MISSING")))
        .otherwise(found)
    )


def size_errors() -> Column:
    """For counts of branches: headcounts and plans. Only the surroundings of the quote are looked at for plans."""
    whole = F.concat_ws(" ", F.nullif("s_norm", F.lit("")), F.nullif(F.coalesce("s_full_norm", F.lit("")), F.lit("")))
    at = F.instr(whole, F.col("q_norm"))
    near = F.when(at > 0, F.substring(whole, F.greatest(F.lit(1), at - 25), F.length("q_norm") + 40 + at - F.greatest(F.lit(1), at - 25))).otherwise(F.col("q_norm"))
    return F.concat(error(X.has_any(F.col("unit_norm"), STAFF_UNITS), "IS_HEADCOUNT"), error(X.has_any(near, TARGET_WORDS), "IS_TARGET"))


def contact_errors() -> Column:
    found = F.transform(X.emails("quote"), F.lower)
    code = (
        F.when(F.contains("q_norm", F.lit("email protected")), "EMAIL_MASKED")
        .when(F.size(found) == 0, "EMAIL_MISSING")
        .when((F.coalesce("email", F.lit("")) != "") & ~F.array_contains(found, F.lower(F.coalesce("email", F.lit("")))), "EMAIL_MISMATCH")
    )
    return F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>"))


def verify(claims: DataFrame, snapshots: DataFrame, rules: DataFrame, today: str, leads: DataFrame | None = None, excluded: DataFrame | None = None, own_domain: str = "", files: DataFrame | None = None, compatibility: bool = True) -> DataFrame:
    """Claims with status, errors and layer. Retracted claims stay as they are.

    claims: scope, id, lead, type, snapshot, file, statement, quote, value, unit, email, content_date, date_evidence,
    status. leads: id, domain (none: claims of a knowledge base, which belong to no lead). excluded: domain, reason.
    files: path, text (null text: no such file); a file that is absent here lies outside the project.
    """
    spark = claims.sparkSession
    now = F.lit(today).cast("date")
    c = claims.withColumn("q_norm", X.canonical(F.coalesce("quote", F.lit("")), compatibility)).withColumn("unit_norm", X.canonical(F.coalesce("unit", F.lit("")), compatibility))
    ready = ready_snapshots(snapshots, compatibility)
    c = c.join(ready, (F.col("scope") == F.col("s_scope")) & (F.col("snapshot") == F.col("s_id")), "left")
    if files is None:
        files = spark.createDataFrame([], "path string, text string")
    f = files.select(F.col("path").alias("f_path"), F.col("text").isNotNull().alias("f_there"), X.canonical(F.coalesce("text", F.lit("")), compatibility).alias("f_norm"))
    c = c.join(f, F.col("file") == F.col("f_path"), "left")
    r = rules.select(F.col("type").alias("r_type"), "source", "max_fetch_age", "max_content_age", "undated_official_ok")
    c = c.join(F.broadcast(r), F.col("type") == F.col("r_type"), "left")
    if leads is not None:
        known = leads.select(F.col("id").alias("l_id"), F.coalesce("domain", F.lit("")).alias("l_domain"))
        c = c.join(known, F.col("lead") == F.col("l_id"), "left")
    else:
        c = c.withColumn("l_id", F.lit(None).cast("string")).withColumn("l_domain", F.lit(None).cast("string"))
    if excluded is not None:
        x = excluded.select(F.regexp_replace(F.lower("domain"), r"\Awww\.", "").alias("x_domain")).where("x_domain <> ''")
        hits = ready.select("s_domain").distinct().withColumn("x_domain", F.explode(F.array_distinct(X.suffixes(F.lower("s_domain"))))).join(x, "x_domain")
        hits = hits.groupBy(F.col("s_domain").alias("h_domain")).agg(F.count("*").cast("int").alias("x_hits"))
        c = c.join(hits, F.col("s_domain") == F.col("h_domain"), "left")
    else:
        c = c.withColumn("x_hits", F.lit(0))
    snap = F.coalesce(F.col("snapshot") != "", F.lit(False))
    from_file = ~snap & F.coalesce(F.col("file") != "", F.lit(False))
    c = c.withColumn("s_norm", F.when(from_file, F.col("f_norm")).otherwise(F.col("s_norm"))).withColumn("official", snap & X.same_site(F.col("s_domain"), F.col("l_domain")))
    source_error = (
        F.when(snap & F.col("s_id").isNull(), "SNAPSHOT_MISSING")
        .when(snap & ~F.col("s_ok"), "SNAPSHOT_NOT_OK")
        .when(snap & ~F.col("s_has_text"), "SNAPSHOT_TEXT_MISSING")
        .when(snap & ~F.col("s_intact"), "SNAPSHOT_CHANGED")
        .when(snap & ~F.col("s_full_intact"), "SNAPSHOT_HIDDEN_CHANGED")
        .when(from_file & F.col("f_path").isNull(), "FILE_OUTSIDE")
        .when(from_file & ~F.col("f_there"), "FILE_MISSING")
        .when(~snap & ~from_file, "SOURCE_MISSING")
    )
    blank = lambda name: X.strip(F.coalesce(name, F.lit(""))) == ""
    layer = located(F.col("q_norm"))
    quoted = X.numbers("quote")
    stale = F.col("s_fetched").isNull() | (F.datediff(now, F.col("s_fetched")) > F.col("max_fetch_age"))
    extra = F.array_except(X.numbers("statement"), F.array_union(quoted, X.numbers("date_evidence")))
    value = F.translate("value", ".,", "")
    manual = F.coalesce(F.col("s_method").isin(*MANUAL), F.lit(False))
    needs = F.coalesce("source", F.lit(""))
    added = F.concat(
        error(layer.isNull(), "QUOTE_NOT_FOUND"),
        F.when(snap & (F.coalesce("x_hits", F.lit(0)) > 0), F.array_repeat(F.lit("EXCLUDED_SOURCE"), F.coalesce("x_hits", F.lit(0)))).otherwise(F.array().cast("array<string>")),
        error((needs == "official") & manual, "MANUAL_NOT_OFFICIAL"),
        error((needs == "official") & ~manual & ~F.col("official"), "NOT_OFFICIAL"),
        error((needs == "own") & snap & ~X.same_site(F.col("s_domain"), F.lit(own_domain)), "NOT_OWN_SOURCE"),
        error(F.col("max_fetch_age").isNotNull() & snap & stale, "STALE_FETCH"),
        F.when(F.col("max_content_age").isNotNull(), date_errors(now, compatibility)).otherwise(F.array().cast("array<string>")),
        error(F.size(extra) > 0, "UNSUPPORTED_NUMBERS"),
        error(F.col("value").isNotNull() & ~F.array_contains(quoted, F.coalesce(value, F.lit(""))), "VALUE_NOT_IN_QUOTE"),
        F.when(F.col("type") == "branch_count", size_errors()).otherwise(F.array().cast("array<string>")),
        F.when(F.col("type") == "contact", contact_errors()).otherwise(F.array().cast("array<string>")),
    )
    found = (
        F.when(F.col("r_type").isNull(), F.array(F.lit("UNKNOWN_TYPE")))
        .when(blank("statement") | blank("quote"), F.concat(error(blank("statement"), "STATEMENT_BLANK"), error(blank("quote"), "QUOTE_BLANK")))
        .when(F.length("q_norm") < 8, F.array(F.lit("QUOTE_TOO_SHORT")))
        .when(F.length("quote") > 500, F.array(F.lit("QUOTE_TOO_LONG")))
        .when(source_error.isNotNull(), F.array(source_error))
        .otherwise(added)
    )
    if leads is not None:
        found = F.concat(found, error(F.col("l_id").isNull(), "UNKNOWN_LEAD"))
    retracted = F.coalesce(F.col("status") == "retracted", F.lit(False))
    own = [x for x in claims.columns if x not in ("status", "errors", "layer")]
    old = F.col("errors") if "errors" in claims.columns else F.lit(None).cast("array<string>")
    out = c.withColumn("new_errors", found).withColumn("new_layer", F.when(layer == "hidden", "hidden"))
    return out.select(
        *own,
        F.when(retracted, "retracted").when(F.size("new_errors") > 0, "rejected").otherwise("verified").alias("status"),
        F.when(retracted, old).otherwise(F.col("new_errors")).alias("errors"),
        F.when(~retracted & (F.size("new_errors") >= 0), F.col("new_layer")).alias("layer"),
    )


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "retracted").alias("retracted"), F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


CLAIM_SCHEMA = (
    "pos int, scope string, id string, lead string, type string, snapshot string, file string, statement string, quote string, value string, unit string, "
    "email string, signal string, content_date string, date_evidence string, status string"
)
SNAPSHOT_SCHEMA = "scope string, id string, url string, domain string, final_domain string, fetched_at string, ok boolean, method string, sha256 string, full_sha256 string, html_dates map<string,array<string>>, text string, full_text string"
