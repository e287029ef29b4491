"""Order-dependent and interval joins, by one shuffle on the session key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_once(rows: DataFrame, is_call: Column, is_result: Column, key: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Results with the call they consume: a later call of the same key replaces a pending one, the first result takes it, the rest have none.

    ``rows`` has the key, order and payload columns; the result has key, ``call`` and ``result`` (structs of order and payload).
    """
    w = Window.partitionBy(*key).orderBy(*order)
    sure = lambda c: F.coalesce(c, F.lit(False))
    mark = rows.withColumns({"_call": sure(is_call), "_result": sure(is_result)}).where("_call OR _result")
    own = F.struct(*order, *payload)
    # a call is pending for the next row alone: that takes it or replaces it
    mark = mark.select(*key, *order, "_call", "_result", own.alias("result"), F.lag(F.when(F.col("_call") & ~F.col("_result"), own)).over(w).alias("_pending"))
    call = F.when(F.col("_call"), F.col("result")).otherwise(F.col("_pending"))
    return mark.where("_result").select(*key, call.alias("call"), "result").where("call IS NOT NULL")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, right_at: str, value: list[str], tie: str | None = None) -> DataFrame:
    """The rows of ``left`` with the values of the last ``right`` row of the same key whose ``right_at`` is at or before ``at``; ties go to the
    larger ``tie``."""
    own = F.struct(*value)
    order = [F.col("_at"), F.col("_side"), F.col("_tie")]
    a = left.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(own).schema[0].dataType).alias("_value"))
    b = right.select(*key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), own.alias("_value"))
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in value])


def overlap(left: DataFrame, right: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """Pairs of the same key whose intervals [l_start, l_end] and [r_start, r_end] (integers) overlap, each pair once.

    Both sides are dealt into buckets of ``bucket`` units, so the join is by equality; a pair is taken in the first bucket that both reach.
    """
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.expr(f"{s} div {bucket}"), F.expr(f"{e} div {bucket}"))))
    both = spread(left, "l_start", "l_end").join(spread(right, "r_start", "r_end"), [*key, "_b"])
    first = F.expr(f"greatest(l_start, r_start) div {bucket}")
    return both.where((F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("_b") == first)).drop("_b")


SPACE = r"[ \t\n\x0B\f\r]+"


def contained(quotes: DataFrame, texts: DataFrame, quote: str, text: str, least: int = 24) -> DataFrame:
    """Pairs of quotes and texts where the text contains the quote, for quotes of ``least`` characters and more; shorter ones never match.

    A word with white space on both sides within a quote is a word of every text that contains it.  Each quote is looked up by the rarest of its own among the
    distinct words of the texts: equality on the word gives candidates (hash of the text, quote), and ``contains`` decides once both are joined back.  Only
    words and hashes are shuffled, in proportion to the texts.  Quotes without such a word are looked up by their first ``least`` characters.
    """
    words = lambda c: F.array_distinct(F.split(c, F.lit(SPACE)))
    own = quotes.where(F.length(quote) >= least)
    parts = F.split(F.col(quote), F.lit(SPACE))
    inner = own.withColumns({"_q": F.xxhash64(quote), "_in": F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))})
    each = inner.select("_q", F.explode("_in").alias("_w")).distinct()
    n = texts.select(F.explode(words(F.col(text))).alias("_w")).join(each.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_n"))
    rank = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), (-F.length("_w")).alias("l"), "_w")
    anchors = each.join(n, "_w", "left").groupBy("_q").agg(F.min_by("_w", rank).alias("_w"))
    said = texts.select(F.xxhash64(text).alias("_t"), F.explode(words(F.col(text))).alias("_w"))
    pairs = said.join(anchors, "_w").select("_t", "_q")
    bare = inner.where(F.size("_in") == 0)
    if not bare.isEmpty():
        chars = texts.select(F.xxhash64(text).alias("_t"), F.split(F.col(text), F.lit("")).alias("_c"))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_c") - least + 1, F.lit(1))), lambda i: F.array_join(F.slice("_c", i, F.lit(least)), ""))
        starts = bare.select("_q", F.left(quote, F.lit(least)).alias("_g"))
        pairs = pairs.unionByName(chars.select("_t", F.explode(F.array_distinct(grams)).alias("_g")).join(starts, "_g").select("_t", "_q"))
    near = inner.drop("_in").join(pairs.distinct(), "_q").drop("_q")
    found = texts.withColumn("_t", F.xxhash64(text)).join(near, "_t")
    return found.where(F.contains(F.col(text), F.col(quote))).drop("_t")
