"""URL filters (operator 2): a list of host and path rules, and behind it association rules mined from labels.

Tokens of a URL are its host, the host's parts, path segments (digits as #) and query keys. A rule is `tokens -> bad` of up
to MAX_RULE tokens with enough support and confidence, where no part of the tokens is a rule itself. A set must stand in
LEAST_PAGES bad pages, however few are labelled. Parallel FP-growth finds all of them: the different token sets of labelled
pages go to shards, each prefix to those of its tokens, and a shard grows the patterns that end in its own tokens from an
FP-tree whose nodes count pages and bad pages. Spark's own has no bound on the size of a set and makes up to 2^k of them for a
page of k tokens; here growth ends at MAX_RULE tokens, and every token of a page takes part. Left out is only what no rule
can hold: tokens in too few bad pages, and, from longer rules, tokens that are rules alone. Tokens that stand in the same
labelled pages are one. Rules are then matched against all tokens of all pages, by an inverted index on their rarest token,
once for each different set of tokens.

A null url, or one without ://, has an empty host and path and no tokens, and is allowed unless a listed rule fits.
Labels that are null or belong to no page teach nothing; without labels nothing is mined. Each row of pages gives a row;
rows that repeat a page_id are judged each by its url.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Verdict and rule, as the contract of the query gives them.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Bad pages that a rule must be drawn from, and tokens of a rule.
LEAST_PAGES, MAX_RULE = 5, 3
#: Different token sets for each shard of the miner.
SETS = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query string."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"\A([^?#]*)", 1), F.regexp_extract(after, r"\A[^?#]*\?([^#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, else nulls."""
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        verdict, text = F.when(fits, v).otherwise(verdict), F.when(fits, rule).otherwise(text)
    return verdict, text


def tokens(host: Column, path: Column, query: Column) -> Column:
    parts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("part:"), x))
    last = F.concat(F.lit("top:"), F.substring_index(host, ".", -1))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("seg:"), F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "#")))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    every = F.concat(F.array(F.concat(F.lit("host:"), host), last), parts, segments, keys)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: ~x.isin("host:", "top:", "part:", "seg:", "key:"))))


def merged(labelled: DataFrame, least: int) -> DataFrame:
    """(token, same, seen, seen_bad): tokens of at least so many labelled pages; `same` is the least of those that stand in the same pages."""
    rows = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    seen = rows.groupBy("token").agg(
        F.count("*").alias("seen"), F.count_if("bad").alias("seen_bad"), F.bit_xor(F.xxhash64("row")).alias("pages"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("also")
    ).where(F.col("seen") >= least)
    first = seen.groupBy("pages", "also", "seen").agg(F.min("token").alias("same"))
    return seen.join(first, ["pages", "also", "seen"]).select("token", "same", "seen", "seen_bad")


class Tree:
    """An FP-tree: nodes with parent, token, pages and bad pages, and the nodes of each token."""

    def __init__(self):
        self.up, self.token, self.n, self.bad = [-1], [""], [0], [0]
        self.child: dict[tuple[int, str], int] = {}
        self.nodes: dict[str, list[int]] = {}

    def add(self, items: list[str], n: int, bad: int) -> None:
        at = 0
        for x in items:
            k = self.child.get((at, x))
            if k is None:
                k = self.child[at, x] = len(self.up)
                for column, value in ((self.up, at), (self.token, x), (self.n, 0), (self.bad, 0)):
                    column.append(value)
                self.nodes.setdefault(x, []).append(k)
            self.n[k] += n
            self.bad[k] += bad
            at = k

    def paths(self, x: str) -> Iterator[tuple[list[str], int, int]]:
        """What stands above the nodes of a token, from the root."""
        for k in self.nodes[x]:
            path, at = [], self.up[k]
            while at:
                path.append(self.token[at])
                at = self.up[at]
            yield path[::-1], self.n[k], self.bad[k]


def growth(tree: Tree, ends: list[str], suffix: list[str], least: int, min_confidence: float) -> Iterator[tuple[list[str], int, int]]:
    """Rules that end in one of `ends` and the suffix, with pages and bad pages. A rule grows no longer ones."""
    for x in ends:
        n, bad = (sum(count[k] for k in tree.nodes[x]) for count in (tree.n, tree.bad))
        if bad < least:
            continue
        own = [x, *suffix]
        if bad / n >= min_confidence:
            yield own, n, bad
        elif len(own) < MAX_RULE:
            above, seen = list(tree.paths(x)), Counter()
            for path, _, k in above:
                for t in path:
                    seen[t] += k
            part = Tree()
            for path, m, k in above:
                part.add([t for t in path if seen[t] >= least], m, k)
            yield from growth(part, list(part.nodes), own, least, min_confidence)


def mine(labelled: DataFrame, kinds: DataFrame, pages: int, least: int, min_confidence: float) -> DataFrame:
    """Rules (tokens, confidence, support) from rows (row, tokens, bad), of which there are `pages`.

    kinds: (token, same, seen, seen_bad); rules are of `same` tokens.
    """
    scratch = C.Scratch(labelled.sparkSession, "mine")
    frequent = kinds.where(F.col("seen_bad") >= least)
    sure = F.col("seen_bad") / F.col("seen") >= min_confidence
    alone = frequent.where(sure).select("same", "seen", "seen_bad").distinct().select(F.array("same").alias("tokens"), F.col("seen").alias("n"), F.col("seen_bad").alias("bad"))
    # The most widespread tokens first, so that sets share long prefixes.
    rows = labelled.select("row", "bad", F.explode("tokens").alias("token")).join(frequent.where(~sure), "token")
    sets = rows.groupBy("row", "bad").agg(F.array_sort(F.collect_set(F.struct((-F.col("seen")).alias("order"), "same"))).alias("own"))
    sets = sets.where(F.size("own") > 1).groupBy(F.transform("own", lambda x: x["same"]).alias("items")).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    sets = scratch.store(sets, "sets")
    shards = max(C.partitions(labelled.sparkSession), sets.count() // SETS)
    shard_of = lambda x: zlib.crc32(x.encode()) % shards

    def prefixes(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for items, n, bad in zip(*(b.column(c)[i : i + 256].to_pylist() for c in ("items", "n", "bad")), strict=True):
                    last = {shard_of(x): k for k, x in enumerate(items)}
                    out += [(g, items[: k + 1], n, bad) for g, k in last.items() if k]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["shard", "items", "n", "bad"])

    types = [pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64()]

    def grow(table: pa.Table) -> pa.Table:
        tree, shard = Tree(), table.column("shard")[0].as_py()
        for b in table.to_batches(max_chunksize=1000):
            for row in zip(*(b.column(c).to_pylist() for c in ("items", "n", "bad")), strict=True):
                tree.add(*row)
        found = list(growth(tree, [x for x in tree.nodes if shard_of(x) == shard], [], least, min_confidence))
        columns = zip(*found, strict=True) if found else [[]] * 3
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types[1:], strict=True)], ["tokens", "n", "bad"])

    dealt = C.mapped(sets, prefixes, "shard int, items array<string>, n long, bad long").groupBy("shard", "items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    grown = dealt.groupBy("shard").applyInArrow(grow, "tokens array<string>, n long, bad long")
    return alone.unionByName(grown).select(F.array_sort("tokens").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / pages).alias("support"))


def general(rules: DataFrame) -> DataFrame:
    """Rules of which no proper part is a rule itself. A rule has at most 2^MAX_RULE parts."""
    numbered = F.sequence(F.lit(1), F.lit((1 << MAX_RULE) - 2))
    part = lambda k: F.filter("tokens", lambda x, i: F.floor(k / F.pow(F.lit(2), i)) % 2 == 1)
    parts = rules.select("tokens", F.explode(F.array_distinct(F.transform(numbered, part))).alias("part")).where((F.size("part") > 0) & (F.size("part") < F.size("tokens")))
    implied = parts.join(rules.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the different token sets (tokens, n) that some rule fits. The index holds each rule under its rarest token."""
    wide = sets.select("tokens", "n", F.explode("tokens").alias("token"))
    common = wide.groupBy("token").agg(F.sum("n").alias("seen"))
    of_rule = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token"))
    index = of_rule.join(common, "token").groupBy("rule").agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    return wide.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict. labels: (page_id, bad boolean)."""
    scratch = C.Scratch(pages.sparkSession, "urls")
    host, path, query = split_url(F.col("url"))
    src = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(host, path, query).alias("tokens"))
    src = scratch.store(src, "tokens")
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = scratch.store(src.join(known, "page_id").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    counted = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if counted.bad:
        least = max(LEAST_PAGES, math.ceil(min_support * counted.n))
        kinds = scratch.store(merged(labelled, least), "kinds")
        mined = mine(labelled, kinds, counted.n, least, min_confidence)
        mined = scratch.store(general(scratch.store(mined, "rules")), "general")
        # Pages are matched on the tokens that the miner saw.
        sets = src.groupBy("tokens").agg(F.count("*").alias("n"))
        own = sets.select("tokens", "n", F.explode("tokens").alias("token")).join(kinds, "token").groupBy("tokens", "n").agg(F.array_sort(F.collect_set("same")).alias("own"))
        own = scratch.store(own, "sets")
        fits = matched(own.groupBy(F.col("own").alias("tokens")).agg(F.sum("n").alias("n")), mined).select(F.col("tokens").alias("own"))
        bad = scratch.store(own.join(fits, "own").select("tokens", F.lit("block").alias("mined")), "matched")
        src = src.join(bad, "tokens", "left")
    else:
        src = src.withColumn("mined", F.lit(None).cast("string"))
    verdict, rule = listed(F.col("host"), F.col("path"), rules)
    return src.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "mined", F.lit("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad if the label of its number says quality 0."""
    labels = C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(C.table(spark, sf_dir, "pages"), labels)
