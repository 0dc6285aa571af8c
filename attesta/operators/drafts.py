"""Drafts checked against the claims that they cite; marks of review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .claims import error


def check(drafts: DataFrame, claims: DataFrame, allowed_numbers: list[str], limits: DataFrame) -> DataFrame:
    """Drafts with errors. claims: verified ones only are looked at; those without lead are the knowledge base and win on an id.

    drafts: lead, channel, to, subject, body. limits: channel, max_words, max_chars. An id that is cited twice gives its
    error twice; numbers of a claim of another lead count as supported, as its words are before the reader all the same.
    """
    d = drafts.withColumn("d_text", F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    d = d.withColumn("d_key", F.xxhash64("lead", "channel", "to", "subject", "body")).withColumn("d_cited", X.markers("d_text"))
    good = claims.where("status = 'verified'").withColumn("base", F.col("lead").isNull())
    known = good.groupBy("id").agg(F.max_by(F.struct("lead", "quote", "statement", "date_evidence"), F.col("base").cast("int")).alias("c"))
    each = d.select("d_key", "lead", F.posexplode("d_cited").alias("at", "cid")).distinct()
    each = each.join(known, F.col("cid") == F.col("id"), "left")
    foreign = F.col("c.lead").isNotNull() & ~F.col("c.lead").eqNullSafe(F.col("lead"))
    code = F.when(F.col("id").isNull(), F.concat(F.lit("NOT_VERIFIED:"), "cid")).when(foreign, F.concat(F.lit("OTHER_LEAD:"), "cid"))
    numbers = F.flatten(F.array(X.numbers("c.quote"), X.numbers("c.statement"), X.numbers("c.date_evidence")))
    by_draft = each.groupBy("d_key").agg(
        F.transform(F.array_sort(F.collect_list(F.when(code.isNotNull(), F.struct("at", code.alias("code"))))), lambda x: x["code"]).alias("cite_errors"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("id").isNotNull(), numbers)))).alias("cited_numbers"),
    )
    contact = good.where("type = 'contact' and lead is not null")
    published = contact.select(F.col("lead").alias("p_lead"), F.explode(F.transform(F.concat(F.array(F.coalesce("email", F.lit(""))), X.emails("quote")), F.lower)).alias("p_email")).distinct()
    to = F.lower(X.strip(F.coalesce("to", F.lit(""))))
    d = d.withColumn("d_to", to).join(by_draft, "d_key", "left").join(published, (F.col("lead") == F.col("p_lead")) & (F.col("d_to") == F.col("p_email")), "left")
    lim = limits.select(F.col("channel").alias("m_channel"), "max_words", "max_chars")
    d = d.withColumn("d_channel", F.coalesce("channel", F.lit("email"))).join(F.broadcast(lim), F.col("d_channel") == F.col("m_channel"), "left")
    plain = F.regexp_replace("d_text", X.MARKER, "")
    supported = F.array_union(F.coalesce("cited_numbers", F.array().cast("array<string>")), F.array(*map(F.lit, allowed_numbers)).cast("array<string>"))
    body = X.strip(F.regexp_replace(F.coalesce("body", F.lit("")), X.MARKER, ""))
    words = F.when(body == "", 0).otherwise(F.size(F.split(body, rf"(?U){X.WS}+")))
    errors = F.concat(
        error(F.size("d_cited") == 0, "NO_EVIDENCE"),
        F.coalesce("cite_errors", F.array().cast("array<string>")),
        error(F.size(F.array_except(X.numbers(plain), supported)) > 0, "UNSUPPORTED_NUMBERS"),
        error((F.col("d_channel") == "email") & (F.col("d_to") == ""), "RECIPIENT_MISSING"),
        error((F.col("d_to") != "") & F.col("p_email").isNull(), "RECIPIENT_NOT_PUBLISHED"),
        error(F.coalesce((F.col("max_words") > 0) & (words > F.col("max_words")), F.lit(False)), "TOO_MANY_WORDS"),
        error(F.coalesce((F.col("max_chars") > 0) & (F.length(body) > F.col("max_chars")), F.lit(False)), "TOO_MANY_CHARS"),
    )
    return d.select(*[c for c in drafts.columns if c != "errors"], errors.alias("errors"))


def draft_sha() -> Column:
    return X.digest(F.col("to"), F.col("channel"), F.col("subject"), F.col("body"))


def review_state() -> tuple[Column, Column]:
    """Whether a draft is ready, and the text on its two checks. A draft that changed after its review fails it; one that was never checked has failed."""
    reviewed = F.col("review").isNotNull()
    stale = reviewed & ~F.col("review.draft_sha").eqNullSafe(draft_sha())
    code = F.col("errors").isNotNull() & (F.size("errors") == 0)
    passed = reviewed & ~stale & F.coalesce(F.col("review.verdict") == "pass", F.lit(False))
    issues = F.when(stale, F.lit("changed after review")).otherwise(F.concat_ws("; ", "review.issues"))
    first = F.when(code, "code: ok").otherwise(F.concat(F.lit("code: failed ("), F.concat_ws("; ", "errors"), F.lit(")")))
    second = F.when(passed, "review: ok").when(~reviewed, "review: pending").otherwise(F.concat(F.lit("review: failed ("), issues, F.lit(")")))
    return code & passed, F.concat_ws(" | ", first, second)


def set_review(drafts: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews: lead, verdict (pass or fail), issues. A verdict holds for the draft as it stands; other verdicts raise an error."""
    r = reviews.select(F.col("lead").alias("r_lead"), F.when(F.col("verdict").isin("pass", "fail"), F.col("verdict")).otherwise(F.raise_error(F.lit("verdict must be pass or fail")).cast("string")).alias("verdict"), "issues")
    new = F.struct(F.col("verdict").alias("verdict"), F.col("issues").alias("issues"), draft_sha().alias("draft_sha"))
    j = drafts.join(r, F.col("lead") == F.col("r_lead"), "left")
    return j.select(*[c for c in drafts.columns if c != "review"], F.when(F.col("r_lead").isNotNull(), new).otherwise(F.col("review")).alias("review"))
