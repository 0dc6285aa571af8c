"""Evidence briefs: candidate quotes from saved pages, chosen under caps, and alarms for kinds that came back empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Word stems of each kind of evidence; strong ones rank first.
TITLES = ["kurucu", "genel müdür", "ceo", "coo", "cfo", "yönetim kurulu", "başkan", "direktör", "müdür", "founder", "managing director", "president", "sahibi", "ortağı", "şef"]
SEGMENT = ["restoran", "zincir", "şube", "catering", "toplu yemek", "yemek hizmet", "lokanta", "kafe", "cafe", "franchise", "endüstriyel yemek", "yemekhane"]
SEGMENT_STRONG = ["zincir", "şube", "catering", "toplu yemek", "endüstriyel yemek", "franchise"]
PROBLEM_STRONG = ["yetme", "yetmi", "yeters", "yetiş", "kalma", "bitti", "bitmi", "tüken", "yoktu", "yok dedi", "bayat", "israf", "çöpe", "atıl", "fazla üret", "artan yemek", "stokta yok", "stokta olma"]
PROBLEM_WEAK = ["porsiyon", "stok", "kalmamış", "az geldi", "eksik geldi"]
PARENT = ["holding", "grubu", "grup şirket", "group", "bünyesinde", "çatısı altında", "iştirak", "markalarından", "şirketler"]
EXPECTED = [("size", 0, "branches"), ("size", 1, "about"), ("contact", 0, "contact"), ("person", 0, "team"), ("person", 1, "about")]
PER_KIND, PER_PAGE, FALLBACK = 12, 3, 2


def lines(pages: DataFrame) -> DataFrame:
    """pages with line_no and line for each non-empty line of text, the lines around it, and the six from it on."""
    all_ = pages.withColumn("lines", X.text_lines("text")).drop("text")
    near = lambda i: F.get("lines", i)
    return all_.select(*[c for c in all_.columns if c != "lines"], "lines", F.posexplode("lines").alias("line_no", "line")).withColumn(
        "around", F.concat_ws(" ", F.when(F.col("line_no") > 0, near(F.col("line_no") - 1)), "line", near(F.col("line_no") + 1))
    ).withColumn("block", F.array_join(F.slice("lines", F.col("line_no") + 1, 6), "\n")).drop("lines")


def candidates(pages: DataFrame, titles: list[str] = TITLES, units: list[str] = (), compatibility: bool = True) -> DataFrame:
    """lead, snapshot, page_type, kind, quote, rank, pos. pages: lead, page_pos, snapshot, page_type, domain, text.

    A long line is cut into sentences, so that each quote stays an exact stretch of the page.
    """
    parts = F.when(F.length("line") > 250, X.sentences(F.col("line"))).otherwise(F.array("line"))
    p = lines(pages).select("*", F.posexplode(parts).alias("part_no", "part")).withColumn("norm", X.canonical("part", compatibility))
    size = X.size_pattern(list(units))
    sizes = F.arrays_zip(F.regexp_extract_all("part", F.lit(size), F.lit(1)).alias("n"), F.regexp_extract_all("part", F.lit(size), F.lit(2)).alias("s"))
    has_size = F.exists(sizes, lambda x: X.plausible_size(x["n"], F.coalesce(x["s"], F.lit(""))))
    d = F.coalesce("domain", F.lit(""))
    label = F.substring_index(d, ".", 1)
    hosts = F.transform(X.emails("part"), lambda e: F.lower(F.substring_index(e, "@", -1)))
    own = F.filter(hosts, lambda h: (h == d) | F.endswith(h, F.concat(F.lit("."), d)) | F.contains(h, label))
    n = F.length("part")
    titled = X.has_any(F.col("norm"), [X.canonical_word(t) for t in titles])

    def made(kind: str, quote: Column, strong: Column | None = None) -> Column:
        rank = F.lit(1) if strong is None else F.when(strong, 0).otherwise(1)
        return F.struct(F.lit(kind).alias("kind"), quote.alias("quote"), rank.alias("rank"))

    part, none = F.col("part"), F.lit(None)
    found = F.array(
        F.when(has_size, made("size", part)),
        F.when(F.size(own) > 0, made("contact", part)),
        F.when(titled, made("person", F.when(n < 80, F.col("around")).otherwise(part))),
        F.when(X.has_any(F.col("norm"), SEGMENT) & n.between(30, 300), made("segment", part, X.has_any(F.col("norm"), SEGMENT_STRONG))),
        F.when(X.has_any(F.col("norm"), PROBLEM_STRONG + PROBLEM_WEAK), made("problem", part, X.has_any(F.col("norm"), PROBLEM_STRONG))),
        F.when(X.has_any(F.col("norm"), PARENT) & (n <= 300), made("parent", F.when((n < 40) & (part == F.col("line")), F.col("block")).otherwise(part))),
        none,
    )
    e = p.select("lead", "page_pos", "snapshot", "page_type", "line_no", "part_no", F.posexplode(found).alias("kind_no", "c")).where("c is not null")
    pos = F.struct("page_pos", "line_no", "part_no", "kind_no")
    return e.select("lead", "snapshot", "page_type", "c.*", pos.alias("pos"))


def choose(found: DataFrame, compatibility: bool = True) -> DataFrame:
    """The brief: strong before weak, no quote twice for a kind, at most PER_PAGE of a page and PER_KIND of a kind. These caps are what a brief is.

    A repeat is dropped before the caps count, even if the first one is then cut by its page's cap.
    """
    order = [F.col("rank"), F.col("pos")]
    c = found.withColumn("norm", X.canonical("quote", compatibility))
    first = Window.partitionBy("lead", "kind", "norm").orderBy(*order)
    c = c.withColumn("n", F.row_number().over(first)).where("n = 1")
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("lead", "kind", "snapshot").orderBy(*order))).where(F.col("n") <= PER_PAGE)
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("lead", "kind").orderBy(*order))).where(F.col("n") <= PER_KIND)
    return c.select("lead", "kind", "snapshot", "page_type", "quote", F.col("n").alias("place"))


def missing(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """lead, kind, open: kinds that were expected but are empty, with the pages where they usually stand."""
    spark = pages.sparkSession
    want = F.broadcast(spark.createDataFrame(EXPECTED, "kind string, type_pos int, page_type string"))
    leads = pages.select("lead").distinct()
    gaps = leads.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in dict.fromkeys(k for k, *_ in EXPECTED)], "kind string"))).join(chosen.select("lead", "kind").distinct(), ["lead", "kind"], "left_anti")
    where = pages.select("lead", "page_pos", "snapshot", "page_type").join(want, "page_type")
    where = where.withColumn("n", F.row_number().over(Window.partitionBy("lead", "kind").orderBy("type_pos", "page_pos"))).where(F.col("n") <= FALLBACK)
    where = where.groupBy("lead", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "snapshot"))), lambda x: x["snapshot"]).alias("open"))
    return gaps.join(where, ["lead", "kind"], "left").select("lead", "kind", F.coalesce("open", F.array().cast("array<string>")).alias("open"))


def recall(claims: DataFrame, chosen: DataFrame, least: float = 0.6, compatibility: bool = True) -> DataFrame:
    """claims with hit: a quote of the lead's brief shares enough tokens. Pairs come from shared tokens only, within a lead.

    A brief holds at most PER_KIND quotes of a kind, so a claim meets a bounded number of them.
    """
    c = claims.select("lead", "id", "type", F.array_distinct(X.tokens("quote", compatibility)).alias("a"))
    q = chosen.select("lead", F.array_distinct(X.tokens("quote", compatibility)).alias("b"))
    hit = c.join(q, "lead").where((F.size("a") > 0) & (X.overlap(F.col("a"), F.col("b")) >= least)).select("lead", "id").distinct().withColumn("hit", F.lit(True))
    return c.join(hit, ["lead", "id"], "left").select("lead", "id", "type", F.coalesce("hit", F.lit(False)).alias("hit"))
