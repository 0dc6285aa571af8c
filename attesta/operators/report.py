"""The ranked sheet: rows of selected leads, the user's own columns carried over, review texts and drafts that are ready."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .drafts import review_state
from .score import first_by

# The columns of the sheet, and those that belong to the user.
COLUMNS = ["Öncelik", "Skor", "Skor kırılımı", "Şirket", "Site", "Neden şimdi", "Bulunan sinyaller", "Karar verici", "E-posta", "Kanal", "Konu", "Mesaj", "Kaynaklar", "Doğrulama", "Durum", "Sonraki adım", "Notlar"]
USER_OWNED = ["Durum", "Sonraki adım", "Notlar"]
STATUS_READY, STATUS_CHECK, STATUS_NONE, STATUS_OUT = "Taslak - onayını bekliyor", "Kontrol gerekli", "Taslak yazılmadı", "Elendi"
AUTOMATIC = (STATUS_READY, STATUS_CHECK, STATUS_NONE, STATUS_OUT)


def source_lines(drafts: DataFrame, claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """lead, sources, numbering: a line for each cited claim, numbered by first citation. Claims bring their snapshot by (scope, id)."""
    d = drafts.withColumn("cited", X.cited_ids(F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))))
    each = d.select(F.col("lead").alias("d_lead"), F.posexplode("cited").alias("at", "cid"))
    known = claims.withColumn("kb", (F.col("scope") == "kb").cast("int")).groupBy("id").agg(F.max_by(F.struct("scope", "snapshot", "file", "layer", "content_date", "quote"), "kb").alias("c"))
    s = snapshots.select(F.col("scope").alias("s_scope"), F.col("id").alias("s_id"), F.coalesce("final_url", "url").alias("page"), F.substring("fetched_at", 1, 10).alias("fetched"), "captured_by")
    j = each.join(known, each.cid == known.id).join(s, (F.col("c.scope") == F.col("s_scope")) & (F.col("c.snapshot") == F.col("s_id")), "left")
    where = F.concat(F.coalesce("page", "c.file", F.lit("")), F.when(F.col("captured_by").isNotNull(), F.concat(F.lit(" ["), "captured_by", F.lit("]"))).otherwise(""), F.when(F.col("c.layer") == "hidden", " [hidden part of the page]").otherwise(""))
    day = F.concat(F.when(F.col("fetched").isNotNull(), F.concat(F.lit("fetched "), "fetched")).otherwise("own document"), F.when(F.coalesce("c.content_date", F.lit("")) != "", F.concat(F.lit(", content dated "), "c.content_date")).otherwise(""))
    line = F.concat(F.lit("["), (F.col("at") + 1).cast("string"), F.lit("] "), where, F.lit(" ("), day, F.lit('): "'), "c.quote", F.lit('"'))
    return j.groupBy(F.col("d_lead").alias("lead")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]).alias("sources"))


def build(leads: DataFrame, claims: DataFrame, drafts: DataFrame, scores: DataFrame, snapshots: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """The sheet in its order (column `rank`), with `lead`, `ready` and `review` (a Markdown text) beside the sheet's columns.

    leads: pos, id, name, domain, status; only selected ones. claims: verified ones, scope kb for the knowledge base.
    drafts: pos, lead, ...; the first of a lead counts. carry: the previous sheet, with pos.
    """
    own = claims.where("scope <> 'kb'")
    signal = F.when(F.col("signal").isNotNull() & (F.col("signal") != "") & (F.col("signal") != "segment"), F.struct("pos", F.concat(F.lit("• "), "statement").alias("v")))
    person = F.when(F.col("type") == "person_title", F.struct((~F.col("wanted")).alias("last"), "pos", F.concat(F.when(F.col("wanted"), "★ ").otherwise(""), "statement").alias("v")))
    wanted = scores.select(F.col("lead").alias("w_lead"), F.explode("relevant_people").alias("w_id")).withColumn("wanted", F.lit(True))
    marked = own.join(wanted, (F.col("lead") == F.col("w_lead")) & (F.col("id") == F.col("w_id")), "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), "\n")
    facts = marked.groupBy("lead").agg(joined(signal).alias("signals"), joined(person).alias("people"))
    ready, check = review_state()
    d = first_by(drafts, ["lead"], [F.col("pos")])
    d = d.withColumn("ready", ready).withColumn("check", check).join(source_lines(d, claims, snapshots), "lead", "left")
    d = d.select(F.col("lead").alias("d_lead"), "channel", "to", "subject", "body", "ready", "check", "sources")
    s = scores.select(F.col("lead").alias("s_lead"), "score", "tier", "why_now", "notes", "fit", F.col("signal").alias("signal_part"), "timing", "reach")
    j = leads.where("status = 'selected'").select("pos", F.col("id").alias("lead"), "name", F.coalesce("domain", F.lit("")).alias("domain")).join(s, F.col("lead") == F.col("s_lead"), "left").join(d, F.col("lead") == F.col("d_lead"), "left").join(facts, "lead", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.when(F.col("fit").isNotNull(), F.concat(*(x for k, c in (("uyum ", "fit"), (", sinyal ", "signal_part"), (", zamanlama ", "timing"), (", ulaşılabilirlik ", "reach")) for x in (F.lit(k), F.col(c).cast("string"))))).otherwise("")
    drafted = F.col("d_lead").isNotNull()
    status = (
        F.when(F.coalesce("ready", F.lit(False)), STATUS_READY).when(drafted, STATUS_CHECK).when(F.col("tier") == "X", STATUS_OUT)
        .otherwise(F.concat(F.lit(f"{STATUS_NONE} (öncelik "), F.coalesce("tier", F.lit("?")), F.lit(")")))
    )
    values = {
        "Öncelik": text("tier"), "Skor": text(F.col("score").cast("string")),
        "Skor kırılımı": F.concat(parts, F.when(F.coalesce(F.size("notes"), F.lit(0)) > 0, F.concat(F.lit("; "), F.array_join("notes", "; "))).otherwise("")),
        "Şirket": F.col("name"), "Site": F.col("domain"), "Neden şimdi": text("why_now"), "Bulunan sinyaller": text("signals"), "Karar verici": text("people"),
        "E-posta": text("to"), "Kanal": text("channel"), "Konu": X.without_markers("subject"), "Mesaj": X.without_markers("body"), "Kaynaklar": text(F.array_join("sources", "\n")),
        "Doğrulama": F.coalesce("check", F.lit("Taslak yok")), "Durum": status, "Sonraki adım": F.lit(""), "Notlar": F.lit(""),
    }
    rows = j.select("pos", "lead", F.coalesce("ready", F.lit(False)).alias("ready"), F.coalesce("body", F.lit("")).alias("marked"), F.col("subject").alias("marked_subject"), *(v.alias(k) for k, v in values.items()))
    if carry is not None:
        old = first_by(carry.where(F.coalesce("Site", F.lit("")) != ""), ["Site"], [F.desc("pos")]).select(F.col("pos").alias("o_pos"), *(F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(COLUMNS)))
        site = COLUMNS.index("Site")
        m = rows.join(old, F.col("Site") == F.col(f"o_{site}"), "full")
        mine = F.col("lead").isNotNull()

        def merged(i: int, c: str):
            before = F.coalesce(f"o_{i}", F.lit(""))
            kept = F.col(f"`{c}`")
            if c in USER_OWNED:
                automatic = F.lit(False) if c != "Durum" else F.greatest(*(F.startswith(before, F.lit(a)) for a in AUTOMATIC))
                kept = F.when((before != "") & ~automatic, before).otherwise(kept)
            return F.when(mine, kept).otherwise(before).alias(c)

        rows = m.select(F.when(mine, F.col("pos")).otherwise(F.col("o_pos") + (1 << 40)).alias("pos"), "lead", "ready", "marked", "marked_subject", *(merged(i, c) for i, c in enumerate(COLUMNS)))
    tier = F.when(F.col("Öncelik") == "A", 0).when(F.col("Öncelik") == "B", 1).when(F.col("Öncelik") == "C", 2).when(F.col("Öncelik") == "X", 3).otherwise(9)
    score = -F.coalesce(F.col("Skor").try_cast("double"), F.lit(0.0))
    return rows.withColumns({"_tier": tier, "_score": score}).orderBy("_tier", "_score", "pos")


def sheet(built: DataFrame) -> DataFrame:
    return built.select(*(F.col(f"`{c}`") for c in COLUMNS))


def ready_drafts(built: DataFrame) -> DataFrame:
    """Data of mails that may be sent by hand. Nothing is ever sent from here."""
    return built.where("ready and Kanal = 'email'").where(F.col("`E-posta`") != "").select("lead", F.col("`E-posta`").alias("to"), F.col("Konu").alias("subject"), F.col("Mesaj").alias("body"))


def review_texts(built: DataFrame) -> DataFrame:
    """lead, review: a Markdown text in which citation marks have the numbers of the source lines."""
    b = built.where("lead is not null")
    marked = F.concat(F.coalesce("marked_subject", F.lit("")), F.lit("\n\n"), "marked")
    cited = X.cited_ids(marked)
    numbered = F.aggregate(F.transform(cited, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), marked, lambda t, x: F.replace(t, F.concat(F.lit("["), x["c"], F.lit("]")), F.concat(F.lit("["), (x["i"] + 1).cast("string"), F.lit("]"))))
    body = X.strip(numbered)
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("Şirket"), F.lit(" ("), F.col("Site"), F.lit(")")), F.lit(""),
        F.concat(F.lit("**Öncelik:** "), F.col("Öncelik"), F.lit(" ("), F.col("Skor"), F.lit(") · "), F.col("`Skor kırılımı`")),
        F.concat(F.lit("**Neden şimdi:** "), F.coalesce(F.nullif(F.col("`Neden şimdi`"), F.lit("")), F.lit("-"))), F.concat(F.lit("**Doğrulama:** "), F.col("Doğrulama")), F.lit(""),
        F.lit("## Taslak"), F.lit(""), F.coalesce(F.nullif(body, F.lit("")), F.lit("_taslak yok_")), F.lit(""), F.lit("## Kaynaklar"), F.lit(""), F.col("Kaynaklar"), F.lit(""),
    )
    return b.select("lead", text.alias("review"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """Every string cell made safe for spreadsheets."""
    return rows.select(*(X.csv_safe(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes))
