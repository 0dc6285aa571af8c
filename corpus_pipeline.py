"""A corpus from documents to packed sequences. Each stage reads what the one before it has kept.

Documents scored as toxic go; lines that repeat, exactly or nearly, stay at their first place only, and a document that
has lost all its lines goes; of each group of near duplicates (by SimHash, and by MinHash beyond its limit; exact similarity
of 0.8 on five-word shingles) the row with the smallest doc_id and hash of the text stays; documents that hold a benchmark item go; the rest is packed. All stages but the
last return the columns of documents, n_chars counted anew where the text has changed.

Null texts are empty from line dedup on. Rows with a null doc_id teach the classifier nothing and are treated like others,
the null before all ids. Of rows with equal doc_id and text one stays after near dedup; rows that share a doc_id only are
judged each by its text. Empty tables give empty results; other columns than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common, decontaminate, lines, neardup, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, COLUMNS[2:])
    left = (F.col("n_removed") == 0) | (F.regexp_replace("kept_text", r"[ \t\r\n\x0b\x0c]+", "") != "")
    text = F.col("kept_text")
    return out.where(left).select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("rk") == F.col("component_rk")))
    first = found.groupBy(F.col("doc_id").alias("first"), F.col("rk").alias("first_rk")).agg(F.count("*").alias("n"))
    first = common.Scratch(spark, "near_duplicates").store(first, "first", few=True).hint("shuffle_hash")
    keyed = docs.withColumn("rk", neardup.text_key())
    same = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("rk") == F.col("first_rk"))
    once = keyed.join(first.where("n = 1"), same, "left_semi").select(*COLUMNS)
    # Of rows with equal doc_id and text one stays.
    more = keyed.join(first.where("n > 1"), same, "left_semi").groupBy("doc_id", "rk").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.unionByName(more).coalesce(common.partitions(spark))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, common.table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("item_ids") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.store(docs, name)
    return docs
