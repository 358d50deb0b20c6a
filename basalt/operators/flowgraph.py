"""Control-flow graphs from linear listings: leaders, basic blocks, successors.

A listing is (fn, address, mnemonic, target): an instruction's place in its function, and where a jump leads. An instruction leads a block if it is its
function's first, stands behind one that ends a block, or is a jump's target. Instructions are dealt by ranges of (fn, address), so that a function of any size
is spread over partitions; what an instruction needs of its neighbours comes from windows within a partition, and across partitions from one row
for each function and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.shared import kept

#: Mnemonics that end a block: jumps that always lead on to their target, and instructions after which nothing follows. Every other one that begins with a jump's prefix falls through as well.
ALWAYS = ("jmp", "b", "ljmp")
ENDS = ("ret", "retn", "retf", "iret", "hlt", "ud2")
#: Beginnings of conditional jumps, and names that begin like them but aren't any.
CONDITIONAL = r"^(j|loop|b\.|cbn?z|tbn?z|b(eq|ne|cs|cc|mi|pl|vs|vc|hi|ls|ge|lt|gt|le)$)"


def kind_of(mnemonic: str | Column) -> Column:
    """jump, branch (a conditional jump), end, or plain. Calls are plain: a block goes on behind them."""
    m = F.lower(F.trim(F.coalesce(F.col(mnemonic) if isinstance(mnemonic, str) else mnemonic, F.lit(""))))
    return F.when(m.isin(*ALWAYS), "jump").when(m.isin(*ENDS), "end").when(m.rlike(CONDITIONAL), "branch").otherwise("plain")


def placed_instructions(listing: DataFrame, fn: str = "fn", address: str = "address", mnemonic: str = "mnemonic", target: str = "target", carry: Sequence[str] = ()) -> DataFrame:
    """(fn, address, mnemonic, target, carried columns, kind, block, following): the block is its first instruction's address, following the next instruction's.

    Addresses are distinct in a function; rows without function or address are left out. Targets that are no instruction of the function lead nowhere. An empty table gives an empty result.
    """
    code = listing.select(F.col(fn).alias("fn"), F.col(address).alias("address"), F.col(mnemonic).alias("mnemonic"), F.col(target).alias("target"), *carry).filter("fn IS NOT NULL AND address IS NOT NULL")
    code = code.withColumn("kind", kind_of("mnemonic"))
    targets = code.filter("kind IN ('jump', 'branch') AND target IS NOT NULL").select("fn", F.col("target").alias("address"), F.lit(True).alias("aimed")).distinct()
    marked = code.join(targets, ["fn", "address"], "left").withColumn("aimed", F.coalesce("aimed", F.lit(False)))
    dealt = marked.repartitionByRange("fn", "address").withColumn("pid", F.spark_partition_id())
    dealt = kept(dealt)
    here = Window.partitionBy("pid", "fn").orderBy("address")
    near = dealt.withColumn("before", F.lag("kind").over(here)).withColumn("following", F.lead("address").over(here))
    # A function's rows in a partition begin behind its last row in an earlier one: one row for each.
    ends = dealt.groupBy("pid", "fn").agg(F.min("address").alias("low"), F.max(F.struct("address", "kind")).alias("last"))
    order = Window.partitionBy("fn").orderBy("pid")
    ends = ends.select("pid", "fn", F.lag("last.kind").over(order).alias("kind_before"), F.lead("low").over(order).alias("low_behind"))
    near = near.join(ends.filter("kind_before IS NOT NULL OR low_behind IS NOT NULL"), ["pid", "fn"], "left")
    before, following = F.coalesce("before", "kind_before"), F.coalesce("following", "low_behind")
    leads = F.when(before.isNull() | (before != "plain") | F.col("aimed"), F.col("address"))
    led = near.select("fn", "address", "mnemonic", "target", *carry, "kind", "pid", following.alias("following"), leads.alias("leader"))
    led = kept(led)
    # Addresses rise, so the last leader so far is the largest.
    tops = led.groupBy("pid", "fn").agg(F.max("leader").alias("top"))
    tops = tops.select("pid", "fn", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("top_before")).filter("top_before IS NOT NULL")
    block = F.coalesce(F.max("leader").over(here.rowsBetween(Window.unboundedPreceding, 0)), "top_before")
    return led.join(tops, ["pid", "fn"], "left").withColumn("block", block).select("fn", "address", "mnemonic", "target", *carry, "kind", "block", "following")


def blocks(placed: DataFrame) -> DataFrame:
    """(fn, block, last, n, kind, target, following): a row for each block, with its last instruction's kind and target."""
    last = F.max(F.struct("address", "kind", "target", "following")).alias("z")
    found = placed.groupBy("fn", "block").agg(F.count(F.lit(1)).alias("n"), last)
    return found.select("fn", "block", F.col("z.address").alias("last"), "n", "z.kind", "z.target", "z.following")


def flow_edges(of: DataFrame) -> DataFrame:
    """(fn, src, dst) of `blocks`: a block without successor has a null dst, as in `graphs.edges_of`. A branch to what follows it is one edge."""
    goes_on = F.when(F.col("kind").isin("plain", "branch"), F.col("following"))
    leads = F.when(F.col("kind").isin("jump", "branch"), F.col("target"))
    ways = of.select("fn", F.col("block").alias("src"), F.explode(F.array_distinct(F.array_compact(F.array(goes_on, leads)))).alias("dst"))
    # Every target that is an instruction leads a block.
    real = ways.join(of.select("fn", F.col("block").alias("dst")), ["fn", "dst"], "left_semi").select("fn", "src", "dst")
    none = of.select("fn", F.col("block").alias("src")).join(real.select("fn", "src"), ["fn", "src"], "left_anti").select("fn", "src", F.lit(None).cast(of.schema["block"].dataType).alias("dst"))
    return real.unionByName(none)
