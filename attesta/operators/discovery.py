"""Candidates from listings: grouped complaints, directories, promotion to leads, the pre-screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lifecycle import new_ids

SIZE_HINT = r"(?iuU)(\d{1,3}(?:[.,]\d{3})*|\d+)\s*(şube|restoran|mağaza|lokasyon|noktada|yemek\s*/\s*gün|öğün)"


def complaints(items: DataFrame) -> DataFrame:
    """entity, sources, items, count, most items first. items: pos, entity, source, url (null: none), title, date_text."""
    sources = items.groupBy("entity").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("pos").alias("first"))
    w = Window.partitionBy("entity", "url").orderBy("pos")
    once = items.where("url is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    lists = once.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "date_text"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["date_text"].alias("date_text"))).alias("items"))
    out = sources.join(lists, "entity", "left").withColumn("count", F.coalesce(F.size("items"), F.lit(0)))
    return out.orderBy(F.desc("count"), "first").select("entity", "sources", "items", "count")


def directory(entries: DataFrame) -> DataFrame:
    """One entry for each name without punctuation and case: the first with a count, else the first. entries: pos, entity, count, ..."""
    key = F.regexp_replace(F.lower("entity"), r"(?U)\W+", "")
    counted = F.coalesce(F.col("count") != 0, F.lit(False))
    w = Window.partitionBy("_key").orderBy(F.when(counted, 0).otherwise(1), "pos")
    return entries.withColumn("_key", key).where("_key <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n").orderBy("entity")


def directory_fields(name: Column, count_text: Column, website: Column) -> Column:
    """struct(entity, count, website, domain) of raw fields; footnote marks go; no name: null."""
    entity = X.strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s*\[\s*\d+\s*\]", ""))
    site = F.regexp_replace(F.coalesce(website, F.lit("")), r"[.,;)]+\z", "")
    site = F.when((site != "") & ~F.startswith(site, F.lit("http")), F.concat(F.lit("https://"), site)).otherwise(site)
    return F.when(entity != "", F.struct(entity.alias("entity"), X.first_count(count_text).alias("count"), site.alias("website"), X.url_host(site).alias("domain")))


def tri_state(df: DataFrame, flag: str = "size_in_range") -> DataFrame:
    f = F.col(flag)
    return df.agg(F.count_if(F.coalesce(f, F.lit(False))).alias("in_range"), F.count_if(F.coalesce(~f, F.lit(False))).alias("out_of_range"), F.count_if(f.isNull()).alias("unknown"))


def promote(entries: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New leads, and entries whose domain has to be looked up. entries: pos, entity, source, url, count, unit, domain, size_in_range.

    Entries out of range stay out. Ids are slugs; one that is taken gets the first free of -2, -3 and so on, among leads and entries.
    """
    fit = entries.where("size_in_range is null or size_in_range")
    unknown = fit.where("coalesce(domain, '') = ''").select("pos", "entity")
    new = fit.where("coalesce(domain, '') <> ''").join(leads.select("domain").distinct(), "domain", "left_anti")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where("n = 1").drop("n")
    new = new_ids(new, "entity", leads.select("id"))
    hint = F.when(F.coalesce(F.col("count"), F.lit(0)) != 0, F.concat_ws(" ", F.col("count").cast("string"), "unit")).otherwise("size not stated")
    return new.select(
        "pos", "id", F.col("entity").alias("name"), "domain",
        F.lit("candidate").alias("status"), F.concat(F.lit("directory ("), "source", F.lit("): "), hint, F.lit(" (a hint, no evidence)")).alias("discovery_note"), F.col("url").alias("discovery_url"),
    ), unknown


def screen(leads: DataFrame, crawls: DataFrame, pages: DataFrame, failures: DataFrame) -> DataFrame:
    """What light crawls say about each lead that is not dropped.

    leads: pos, id, name, domain, status. crawls: lead, error, blocked. pages: lead, page_pos, ok, type, text.
    failures: lead, pos, status, error.
    """
    l = leads.where("status <> 'dropped'").select("pos", F.col("id").alias("lead"), "name", "domain")  # noqa: E741
    good = pages.where("ok")
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(SIZE_HINT), F.lit(0)).alias("m"), F.regexp_extract_all("text", F.lit(SIZE_HINT), F.lit(1)).alias("n"))
    sizes = F.transform(F.filter(hits, lambda x: X.plausible_count(x["n"])), lambda x: F.regexp_replace(x["m"], rf"(?U){X.WS}+", " "))
    each = good.select("lead", "page_pos", "type", sizes.alias("sizes"), F.transform(X.emails("text"), F.lower).alias("emails"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("page_pos", F.col(c).alias("v")))), lambda x: x["v"])
    g = each.groupBy("lead").agg(
        F.count("*").alias("ok_pages"), F.array_sort(F.collect_set(F.nullif("type", F.lit("")))).alias("page_types"),
        F.slice(F.array_distinct(F.flatten(in_order("sizes"))), 1, 4).alias("size_mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("emails")))).alias("all_emails"),
    )
    seen = pages.groupBy("lead").agg(F.count("*").alias("n_pages"))
    failed = failures.groupBy("lead").agg(F.min_by(F.coalesce(F.nullif(F.col("status").cast("string"), F.lit("0")), "error", F.lit("")), "pos").alias("failure"))
    c = crawls.select(F.col("lead").alias("c_lead"), F.col("error").alias("c_error"), "blocked")
    j = l.join(g, "lead", "left").join(seen, "lead", "left").join(failed, "lead", "left").join(c, F.col("lead") == F.col("c_lead"), "left")
    none = F.array().cast("array<string>")
    emails = F.slice(F.filter("all_emails", lambda e: F.contains(e, F.substring_index("domain", ".", 1))), 1, 3)
    empty = F.coalesce("ok_pages", F.lit(0)) == 0
    error = (
        F.when(F.col("c_lead").isNull(), "not crawled").when(F.coalesce("c_error", F.lit("")) != "", F.col("c_error"))
        .when(~empty, None).when(F.coalesce("blocked", F.lit(False)), "blocked: automated access is not allowed")
        .when(F.col("failure").isNotNull(), F.substring(F.concat(F.lit("page failed: "), "failure"), 1, 120)).when(F.col("n_pages") > 0, "no content")
    )
    return j.orderBy("pos").select(
        "lead", "name", F.coalesce("ok_pages", F.lit(0)).cast("long").alias("ok_pages"), F.coalesce("page_types", none).alias("page_types"), F.coalesce("size_mentions", none).alias("size_mentions"),
        F.coalesce(emails, none).alias("emails"), F.coalesce(F.array_contains("page_types", "team"), F.lit(False)).alias("has_team_page"), error.alias("error"),
    )


def wanted_listings(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listings of the catalogue (id and more) that a profile asks for (pos, id), with pos. An unknown id is an error, and so is asking for none."""
    if not wanted.limit(1).count():
        raise ValueError("the profile asks for no listings")
    own = catalogue.withColumn("there", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("unknown listing: "), F.coalesce("id", F.lit("null")))).cast("boolean")
    return wanted.join(own, "id", "left").withColumn("there", F.coalesce("there", unknown)).where("there").drop("there")
