"""URL filters: given rules for hosts and paths, and rules mined from labelled URLs.

A given rule is a host and a beginning of paths; it fits the host and its subdomains, and the longest that fits wins. Where none
fits, association rules decide. The parts of labelled URLs (scheme, host labels, path segments, extension, names of query parameters, a
fragment) and their label are transactions, Spark's FP-growth finds the frequent combinations, and those that lead to a label
with enough confidence are rules. A rule that a more general one with as much confidence covers is pruned. Rules
stand in an inverted index under their rarest part; a URL's parts look up candidates there, a candidate whose parts are all in
the URL matches, and the one with the most confidence (then support, then fewest parts) decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import ascii_lower, scratch_table

ALLOW, BLOCK = "allow", "block"
#: What marks a label among the items of a transaction; no part of a URL begins like this.
LABEL = "="


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end. Both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits (of equally long ones the first by text), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def parts(url: Column) -> Column:
    """The different parts of a URL, in order: `s:` scheme, `h:` each label of the host, `p:` each segment of the path (numbers are `#`, an extension goes), `x:` the extension, `q:` each parameter's name, `f:` that there is a fragment.
    All in lower case (A-Z). A URL without any has an empty array."""
    url = ascii_lower(F.coalesce(url, F.lit("")))
    host, path = host_and_path(url)
    tagged = lambda values, tag: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    scheme = F.when(F.instr(url, "://") > 1, F.substring_index(url, "://", 1)).otherwise("")
    extension = F.regexp_extract(path, r"\.([a-z0-9]{1,8})$", 1)
    segments = F.split(F.regexp_replace(path, r"\.[a-z0-9]{1,8}$", ""), "/")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    everything = F.concat(
        tagged(F.array(scheme), "s:"),
        tagged(F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\."), "h:"),
        tagged(F.transform(segments, lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)), "p:"),
        tagged(F.array(extension), "x:"),
        tagged(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), "q:"),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(everything))


def mine(labelled: DataFrame, url_col: str = "url", block_col: str = "block", min_support: float = 0.002, min_rows: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """(items, verdict, confidence, support) of the rules that labelled URLs give; support is the number of URLs with all items and the label.

    A combination needs min_support of all labelled rows, and min_rows of them at least. block_col: true blocks, false allows; rows where it is null, and URLs without any part, don't count.
    Rows that repeat a URL count each. Without a labelled row there is no rule. FP-growth brings the frequent single parts to the driver, of which there are at most
    parts a URL / min_support, whatever the input; combinations stay in Spark.
    """
    spark = labelled.sparkSession
    label = F.when(F.col(block_col), LABEL + BLOCK).otherwise(LABEL + ALLOW)
    rows = labelled.filter(F.col(block_col).isNotNull()).select(parts(F.col(url_col)).alias("parts"), label.alias("label")).filter(F.size("parts") > 0)
    rows = scratch_table(rows.select(F.concat("parts", F.array("label")).alias("items")), "url-labelled")
    n = rows.count()
    schema = "items array<string>, verdict string, confidence double, support long"
    if not n:
        return spark.createDataFrame([], schema)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n))).fit(rows).freqItemsets
    sets = scratch_table(sets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "url-itemsets")
    is_label = lambda x: x.startswith(LABEL)
    both = sets.filter(F.exists("items", is_label) & (F.size("items") > 1))
    both = both.select(F.filter("items", lambda x: ~is_label(x)).alias("items"), F.substring(F.filter("items", is_label)[0], 2, 99).alias("verdict"), F.col("freq").alias("support"))
    confident = both.join(sets, "items").select("items", "verdict", (F.col("support") / F.col("freq")).alias("confidence"), "support").filter(F.col("confidence") >= min_confidence)
    confident = scratch_table(confident, "url-rules")
    # A rule goes if the rule with one part fewer has the same label and no less confidence.
    fewer = confident.select("items", "verdict", "confidence", F.explode("items").alias("without")).select(F.col("items").alias("special"), "verdict", F.col("confidence").alias("own"), F.array_remove("items", F.col("without")).alias("items"))
    covered = fewer.join(confident, ["items", "verdict"]).filter("confidence >= own").select(F.col("special").alias("items"), "verdict").distinct()
    return confident.join(covered, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support")


def judge(urls: DataFrame, rules: DataFrame, broadcast_rules: int = 100_000) -> DataFrame:
    """(parts, verdict, confidence, items) for each different array in urls' column `parts` that a mined rule matches.

    Up to broadcast_rules rules are sent to the rows (a rule has a few hundred bytes); more are joined by part.
    """
    rules = scratch_table(rules, "url-index")
    by_part = rules.select(F.explode("items").alias("part"), "support").groupBy("part").agg(F.sum("support").alias("n"))
    keyed = rules.select("*", F.explode("items").alias("part")).join(by_part, "part")
    index = keyed.groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    index = F.broadcast(index) if rules.count() <= broadcast_rules else index
    looked = urls.select("parts").distinct().select("parts", F.explode("parts").alias("part")).join(index, "part")
    matched = looked.filter(F.size(F.array_except("items", "parts")) == 0)
    # Of equals, those that block come first, then the least items.
    rank = F.struct(-F.col("confidence"), -F.col("support"), F.size("items"), F.col("verdict") != BLOCK, F.col("items"), "verdict")
    return matched.groupBy("parts").agg(F.min(rank).alias("best")).select("parts", "best.verdict", (-F.col("best.col1")).alias("confidence"), "best.items")


def filter_urls(df: DataFrame, labelled: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, **mining) -> DataFrame:
    """One row for each row of df: the id, host, path, rule (the text of the given rule, else null), verdict, and of the mined rule, where one decides, its confidence and items.

    labelled: (url, block) rows to mine, as for `mine`. Where neither a given nor a mined rule fits, the verdict is the default. Null URLs and those without `://` have an empty host and path and are judged by the parts they have. Null or repeated ids are rows of
    their own. An empty table gives an empty result. Other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), parts(F.col(url_col)).alias("parts"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    open_ = rows.filter("given IS NULL")
    mined = judge(open_, mine(labelled, **mining)).select(F.array_join("parts", "\n").alias("key"), F.col("verdict").alias("mined"), "confidence", "items")
    joined = rows.withColumn("key", F.when(F.col("given").isNull(), F.array_join("parts", "\n"))).join(mined, "key", "left")
    return joined.select(id_col, "host", "path", "given.rule", F.coalesce("given.verdict", "mined", F.lit(default)).alias("verdict"), "confidence", "items")
