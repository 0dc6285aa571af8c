"""Scores and tiers of companies from verified claims only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as X

# Points of signals, and the totals from which tiers begin.
WEIGHTS = {"job_post": 15, "news": 10, "review": 10, "public_post": 8, "title": 15}
TIERS = {"A": 70, "B": 45}


def size_in_range(count: Column, unit: Column, rules: list[dict], compatibility: bool = True) -> Column:
    """True, false or unknown (null); the first rule whose unit matches decides."""
    out = F.lit(None).cast("boolean")
    named = X.canonical(F.coalesce(unit, F.lit("")), compatibility)
    for r in reversed(rules):
        inside = (count >= r.get("min", 0)) & (count <= r.get("max", float("inf")))
        out = F.when(X.unit_matches(named, r.get("units") or [r.get("unit", "şube")]), inside).otherwise(out)
    return F.when(count.isNotNull(), out)


def is_relevant(quote: Column, titles: list[str], compatibility: bool = True) -> Column:
    q = X.canonical(F.coalesce(quote, F.lit("")), compatibility)
    return X.has_any(q, [X.canonical_word(t) for t in titles if t.strip()])


def plain_number(v: Column) -> Column:
    return F.when(v == v.cast("bigint"), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def score(leads: DataFrame, claims: DataFrame, today: str, rules: list[dict], titles: list[str], weights: dict[str, int] | None = None, tiers: dict[str, int] | None = None, cap: str | None = "C", compatibility: bool = True) -> DataFrame:
    """One row for each lead: score, tier, why_now, notes, relevant_people, and the four parts.

    claims: pos (their order), lead, id, type, statement, quote, value, unit, signal, content_date; verified ones count.
    All of a lead's claims meet in sums and firsts; no list of claims is built but for the ids of relevant people.
    """
    weights, tiers = WEIGHTS if weights is None else weights, tiers or TIERS
    now = F.lit(today).cast("date")
    c = claims.where("status = 'verified'").withColumn("unit_norm", X.canonical(F.coalesce("unit", F.lit("şube")), compatibility))
    which = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        r = rules[i]
        hit = (F.col("type") == r.get("claim_type", "branch_count")) & F.col("value").isNotNull() & X.unit_matches(F.col("unit_norm"), r.get("units") or [r.get("unit", "şube")])
        which = F.when(hit, i).otherwise(which)
    points = F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("signal")) if weights else F.lit(None).cast("int")
    day = dates.iso_date("content_date")
    value = F.translate(F.translate("value", ".", ""), ",", ".").try_cast("double")
    c = c.withColumns({"rule": which, "points": points, "day": F.when(points.isNotNull(), day), "number": value, "wanted": (F.col("type") == "person_title") & is_relevant(F.col("quote"), titles, compatibility)})
    first = lambda what, cond: F.min_by(F.when(cond, what), F.when(cond, F.col("pos")))
    newest = F.struct("day", (-F.col("pos")).alias("before"))
    a = c.groupBy("lead").agg(
        F.max(F.col("type") == "disqualifier").alias("out"),
        first(F.col("statement"), F.col("type") == "disqualifier").alias("reason"),
        F.max(F.coalesce(F.col("signal") == "segment", F.lit(False))).alias("segment"),
        F.min_by(F.struct("rule", "number", F.coalesce("unit", F.lit("şube")).alias("unit")), F.when(F.col("rule").isNotNull(), F.struct("rule", "pos"))).alias("size"),
        first(F.coalesce("unit", F.lit("None")), (F.col("type") == "branch_count") & F.col("value").isNotNull()).alias("other_unit"),
        F.max_by(F.struct("statement", "day", "id"), F.when(F.col("day").isNotNull(), newest)).alias("latest"),
        F.max(F.col("type") == "person_title").alias("person"), F.max(F.col("type") == "contact").alias("contact"), F.max("wanted").alias("wanted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("wanted"), F.struct("pos", "id")))), lambda x: x["id"]).alias("people"),
    )
    signals = c.where("points is not null").select("lead", "signal", "points").distinct().groupBy("lead").agg(F.sum("points").alias("signal_points"))
    s = leads.select(F.col("id").alias("lead")).join(a, "lead", "left").join(signals, "lead", "left")
    yes = lambda name: F.coalesce(name, F.lit(False))
    low, high = (F.lit(None).cast("double") for _ in range(2))
    for i, r in enumerate(rules):
        low = F.when(F.col("size.rule") == i, float(r.get("min", 0))).otherwise(low)
        high = F.when(F.col("size.rule") == i, float(r.get("max", float("inf")))).otherwise(high)
    matched = F.col("size.rule").isNotNull()
    inside = matched & F.coalesce(F.col("size.number").between(low, high), F.lit(False))
    outside = matched & ~inside
    top = F.when(high == float("inf"), "∞").otherwise(plain_number(high))
    s = s.withColumns({
        "fit": F.when(yes("segment"), 20).otherwise(0) + F.when(inside, 15).otherwise(0),
        "signal": F.least(F.lit(35), F.coalesce("signal_points", F.lit(0)) + F.when(yes("wanted"), weights.get("title", 0)).otherwise(0)).cast("int"),
        "timing": F.when(F.col("latest.day").isNotNull(), dates.age_points(F.datediff(now, F.col("latest.day")))).otherwise(0),
        "reach": F.when(yes("person"), 7).otherwise(0) + F.when(yes("contact"), 3).otherwise(0),
    })
    total = F.col("fit") + F.col("signal") + F.col("timing") + F.col("reach")
    tier = F.when(total >= tiers["A"], "A").when(total >= tiers["B"], "B").otherwise("C")
    capped = outside & (tier < F.lit(cap)) if cap else F.lit(False)
    notes = F.array_compact(F.array(
        F.when(~yes("segment"), "segment not shown"),
        F.when(outside, F.concat(F.lit("size out of range ("), plain_number(F.col("size.number")), F.lit(" "), "size.unit", F.lit("; "), plain_number(low), F.lit("-"), top, F.lit(")"))),
        F.when(~matched & F.col("other_unit").isNotNull(), F.concat(F.lit("size unit not in profile ("), "other_unit", F.lit(")"))),
        F.when(~matched & F.col("other_unit").isNull(), "size unknown, not guessed"),
        F.when(~yes("person"), "no decision maker found"),
        F.when(capped, F.concat(F.lit("tier "), tier, F.lit(f" capped to {cap}: size out of range"))),
    ))
    out = yes("out")
    no = F.array().cast("array<string>")
    why = F.when(F.col("latest.day").isNotNull(), F.concat("latest.statement", F.lit(" ("), F.col("latest.day").cast("string"), F.lit(") ["), "latest.id", F.lit("]"))).otherwise("")
    return s.select(
        "lead",
        F.when(out, 0).otherwise(total).cast("int").alias("score"),
        F.when(out, "X").when(capped, F.lit(cap)).otherwise(tier).alias("tier"),
        F.when(out, "").otherwise(why).alias("why_now"),
        F.when(out, F.array(F.concat(F.lit("disqualified: "), "reason"))).otherwise(notes).alias("notes"),
        F.when(out, no).otherwise(F.coalesce("people", no)).alias("relevant_people"),
        *(F.when(~out, F.col(x)).alias(x) for x in ("fit", "signal", "timing", "reach")),
    )


def tier_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tier").agg(F.count("*").alias("n"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
