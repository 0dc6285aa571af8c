"""Changes to stored records as new DataFrames: ingest, selection, retraction, upserts, snapshots and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as X
from .claims import KB_TYPES, LEAD_TYPES


def ingest(batch: DataFrame, leads: DataFrame | None, existing: int, prefix: str = "c") -> tuple[DataFrame, DataFrame]:
    """Accepted claims with ids that go on from `existing`, and refused ones with a reason. batch: pos, lead, type, statement, ..."""
    types = LEAD_TYPES if leads is not None else KB_TYPES
    b = batch
    if leads is not None:
        b = b.join(leads.select(F.col("id").alias("k_lead")).distinct(), F.col("lead") == F.col("k_lead"), "left")
        reason = F.when(F.col("k_lead").isNull(), "UNKNOWN_LEAD").when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "TYPE_NOT_ALLOWED")
    else:
        reason = F.when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "TYPE_NOT_ALLOWED")
    b = b.withColumn("reason", reason)
    # A batch is one request; numbering it is a sort by its own positions.
    number = F.row_number().over(Window.orderBy("pos")) + existing
    good = b.where("reason is null").withColumn("id", F.concat(F.lit(prefix), F.format_string("%03d", number)))
    bad = b.where("reason is not null").select("pos", "lead", "type", F.substring(F.coalesce("statement", F.lit("")), 1, 60).alias("statement"), "reason")
    return good.drop("reason", "k_lead"), bad


def select_leads(leads: DataFrame, ids: DataFrame, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """Leads with new status, and ids that no lead has. ids: id."""
    mark = ids.select(F.col("id").alias("m_id")).distinct()
    out = leads.join(mark, F.col("id") == F.col("m_id"), "left").withColumn("status", F.when(F.col("m_id").isNotNull(), "dropped" if drop else "selected").otherwise(F.col("status"))).drop("m_id")
    return out, ids.join(leads.select("id"), "id", "left_anti")


def retract(claims: DataFrame, claim_id: str, reason: str, at: str) -> DataFrame:
    hit = F.col("id") == claim_id
    return claims.withColumns({"status": F.when(hit, "retracted").otherwise(F.col("status")), "retracted_reason": F.when(hit, reason), "retracted_at": F.when(hit, at)})


def upsert_drafts(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """One draft for each lead: old ones of the same lead go, new ones stand last. Both with pos."""
    last = drafts.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    moved = new.crossJoin(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("last") + 1).drop("last")
    return drafts.join(new.select("lead").distinct(), "lead", "left_anti").unionByName(moved, allowMissingColumns=True)


def merge_claims(own: DataFrame, kb: DataFrame) -> DataFrame:
    """Claims that a lead's draft may cite; those of the knowledge base win on an id."""
    return own.join(kb.select("id"), "id", "left_anti").unionByName(kb, allowMissingColumns=True)


def put_state(state: DataFrame, assignments: DataFrame) -> DataFrame:
    """(key, value) after `key=value` assignments in order of pos; the last one of a key stands."""
    at = F.instr("assignment", "=")
    new = assignments.where(at > 0).select(F.expr("substring(assignment, 1, instr(assignment, '=') - 1)").alias("key"), F.expr("substring(assignment, instr(assignment, '=') + 1)").alias("value"), "pos")
    last = new.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    return state.join(last.select("key"), "key", "left_anti").unionByName(last)


def manual_snapshots(pages: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Text that a user supplied as snapshot rows with ok, error, chars, sha256. pages: id, url, text, method, fetched_at.

    Another method than manual or chrome, or a url without a host, is refused (error, no text). A text is ok from 20 characters on.
    """
    from .urls import excluded as excluded_

    p = pages if excluded is None else excluded_(pages, excluded)
    if excluded is None:
        p = p.withColumn("excluded_reason", F.lit(None).cast("string"))
    text = X.strip(X.line_feeds(F.coalesce("text", F.lit(""))))
    host = X.url_host("url")
    error = (
        F.when(~F.coalesce(F.col("method").isin("manual", "chrome"), F.lit(False)), "METHOD_NOT_ALLOWED").when(host == "", "URL_WITHOUT_HOST")
        .when(F.col("excluded_reason").isNotNull(), F.concat(F.lit("EXCLUDED: "), "excluded_reason")).when(F.length(text) < 20, "TEXT_TOO_SHORT")
    )
    ok = error.isNull()
    return p.select("id", "url", host.alias("domain"), "fetched_at", "method", F.length(text).alias("chars"), ok.alias("ok"), error.alias("error"), F.when(ok, text).alias("text"), F.when(ok, F.sha2(text, 256)).alias("sha256"))


def store_layers(pages: DataFrame) -> DataFrame:
    """Snapshot fields of captured pages: text and hidden layer with line feeds only; the hidden layer only if it is longer."""
    text, full = X.line_feeds(F.coalesce("text", F.lit(""))), X.line_feeds(F.coalesce("full_text", F.lit("")))
    hidden = F.length(full) > F.length(text)
    return pages.withColumns({"text": text, "chars": F.length(text), "sha256": F.sha2(text, 256), "full_text": F.when(hidden, full), "full_chars": F.when(hidden, F.length(full)), "full_sha256": F.when(hidden, F.sha2(full, 256))})


def repair(snapshots: DataFrame) -> DataFrame:
    """id, state, text, sha256: ok, repaired (undoing CRLF line ends gives the stored hash again) or mismatch.

    snapshots: id, raw binary, sha256. A hash is over text whose line ends are read as line feeds.
    """
    raw = F.coalesce(F.decode("raw", "UTF-8"), F.lit(""))
    read = X.line_feeds(raw)
    original = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    state = F.when(F.sha2(read, 256) == F.col("sha256"), "ok").when(F.sha2(original, 256) == F.col("sha256"), "repaired").otherwise("mismatch")
    fixed = X.line_feeds(original)
    return snapshots.select("id", state.alias("state"), F.when(state == "repaired", fixed).otherwise(read).alias("text"), F.when(state == "repaired", F.sha2(fixed, 256)).otherwise(F.col("sha256")).alias("sha256"))


def new_ids(df: DataFrame, name: str = "name", ids: DataFrame | None = None) -> DataFrame:
    """Slugs as ids; of a slug that is taken or comes again the next gets the first free of -2, -3 and so on, in order of pos.

    ids: (id) that are taken. A slug among the new ones that reads like another with a number takes that number too.
    """
    df = df.withColumn("slug", X.slug(name))
    known = df.select(F.col("slug").alias("id")).distinct()
    # Numbers that are taken of each slug: 1 stands for the slug itself, which the first of the new ones may have.
    parted = lambda t: t.select(F.regexp_extract("id", r"\A(.*)-(\d{1,9})\z", 1).alias("slug"), F.regexp_extract("id", r"\A(.*)-(\d{1,9})\z", 2).try_cast("int").alias("number")).where("number >= 2")
    taken = parted(known)
    if ids is not None:
        taken = taken.unionByName(parted(ids)).unionByName(ids.select(F.col("id").alias("slug"), F.lit(1).alias("number")))
    taken = taken.distinct().join(known.select(F.col("id").alias("slug")), "slug", "left_semi")
    # The k-th free number is k and one for each taken number t with fewer than k free ones below it; there are t - i, t being the i-th.
    free = taken.select("slug", (F.col("number") - F.row_number().over(Window.partitionBy("slug").orderBy("number"))).alias("before"))
    rows = df.withColumn("k", F.row_number().over(Window.partitionBy("slug").orderBy("pos")))
    marks = rows.select("slug", "k", F.struct(*df.columns).alias("row")).unionByName(free.select("slug", (F.col("before") + 1).alias("k"), F.lit(None).alias("row")), allowMissingColumns=True)
    order = Window.partitionBy("slug").orderBy("k", F.col("row").isNotNull())
    number = F.col("k") + F.count_if(F.col("row").isNull()).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = marks.withColumn("number", number).where("row is not null").select("row.*", "number")
    return out.withColumn("id", F.when(F.col("number") > 1, F.concat_ws("-", "slug", F.col("number").cast("string"))).otherwise(F.col("slug"))).drop("slug", "number")


def fetched_on(c: str = "fetched_at"):
    return dates.iso_date(c)
