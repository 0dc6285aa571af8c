"""Files to DataFrames and back: JSON lines, JSON documents, market and profile catalogues, the previous sheet."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table; blank lines are skipped; keys that are absent are null."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def to_json(df: DataFrame) -> DataFrame:
    """One column `value`, a JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def parse_payload(df: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """JSON text, with or without a byte order mark, to the columns of schema."""
    return df.select(*[c for c in df.columns if c != column], F.from_json(F.regexp_replace(column, "\\A\ufeff", ""), schema).alias("_p")).select("*", "_p.*").drop("_p")


def load_market(folder: str, country: str) -> dict:
    """A market catalogue; it must be there."""
    path = Path(folder) / f"{country}.toml"
    if not path.is_file():
        raise FileNotFoundError(f"no market catalogue for {country}")
    return tomllib.loads(path.read_text(encoding="utf-8"))


def merge_profile(profile: dict, market: dict) -> dict:
    """The profile with the market's exclusions of further domains and review sites behind its own."""
    own, more = profile.get("sources", {}), market.get("sources", {})
    seen = {x["domain"] for x in own.get("excluded", [])}
    excluded = [*own.get("excluded", []), *(x for x in more.get("excluded", []) if x["domain"] not in seen)]
    sites = list(dict.fromkeys([*own.get("review_sites", []), *more.get("review_sites", [])]))
    return profile | {"sources": own | {"excluded": excluded, "review_sites": sites}, "_market": market}


def merge_exclusions(own: DataFrame, market: DataFrame) -> DataFrame:
    """The same for tables of (domain, reason)."""
    return own.unionByName(market.join(own.select("domain"), "domain", "left_anti"))


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct values in order of first appearance, (side, pos) being the order. Both with pos."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(key).orderBy("side", "pos"))
    return both.withColumn("n", n).where("n = 1").drop("n")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A previous sheet with pos: rows without Site are left out; a byte order mark is no part of the first name; all strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.removeprefix("\ufeff")) for c in df.columns))
    return df.withColumn("pos", F.monotonically_increasing_id()).where("Site <> ''")


def write_sheet(df: DataFrame, path: str) -> None:
    """Cells are made safe by report.csv_rows before this. Rows keep their order in one file, as a person reads it."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", "").csv(path)
