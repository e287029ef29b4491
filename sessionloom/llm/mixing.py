"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source whose target is r times its size takes each of its documents floor(r) times and once more with probability p = r - floor(r).  The fractions are
rounded in dependence of each other: two of them trade words, in random direction and with chances that keep every document's probability, until one is
0 or 1; the other goes on to the next pair.  The words of both together never change, so a whole block of documents ends with all fractions settled but
one, and its words as they were.  The blocks' last documents form blocks again: a reduction tree by source, level by level, each level a
grouped aggregation over blocks of about FAN documents.

The tree's very last document has to be rounded, which moves the source off its target by a part of that document.  So small documents, as many as can take
up the largest one, are held back: they pair with the last document of the others as one unit, which shifts all their fractions a little, and go through a
tree of their own.  What is missed in the end is a part of a small document.

Repeated rows (equal doc_id, source and size) are one unit with a count.  The random numbers are hashes of units, so reruns agree whatever the partitions are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_written, join_hot, table, written

MOST = 3  #: No source is taken more often.
WEIGHTS = 3  #: Sources weigh 1, 2, ... WEIGHTS, repeating.
FAN = 64
CHUNK = 10_000
SEED = 42
EPS = 1e-9
_UNIT = "struct<doc_id:bigint,size:bigint,m:bigint,whole:bigint,extra:bigint,source_size:bigint,target:double>"
_FRACTION = f"struct<draw:bigint,f:double,unit:{_UNIT}>"


def words(text: Column) -> Column:
    """The number of runs of other characters than space and U+0009 to U+000D; 0 for null."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that only depends on ``of``."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit(SEED)), 11) / float(1 << 53)


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with place: their number from 0 in the order of ``key``, which is unique.  Written; no task sees all rows."""
    at = F.monotonically_increasing_id()  # the partition, then 33 bits of the row in it
    own = written(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", at), "mix-ranked")
    own = own.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("n_part").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = own.groupBy("_part").agg(F.count("*").alias("n_part")).select("_part", before.alias("_before"))  # one row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_at", "_part", "_before")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with target: their shares of all words by weight, none above ``most`` times its size; what is cut is shared again
    by the weights of the others until none is above."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share, before = (total or 0) / (weights or 1), -1
    while True:
        over = F.col("weight") * F.lit(share) > F.col("source_size") * most
        capped, left, n = sources.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == before or not left:
            break
        share, before = (total - (capped or 0)) / left, n
    level = F.col("weight") * F.lit(float(share))
    return sources.withColumn("target", F.least(level, (F.col("source_size") * most).cast("double")))


def _step(acc: Column, e: Column) -> Column:
    """One pair: the fraction carried so far and the next; one of them ends as 0 or 1, the other is carried on."""
    c = acc["carry"]
    z1, z2 = c["unit"]["size"], e["unit"]["size"]
    a1, a2 = z1 * c["f"], z2 * e["f"]  # words
    up, down = F.least(z1 - a1, a2), F.least(a1, z2 - a2)
    rises = uniform(c["draw"], e["draw"]) * (up + down) < down
    first = F.when(rises, z1 - a1 <= a2).otherwise(a1 <= z2 - a2)  # the carried one is settled
    settled = F.struct(F.when(first == rises, 1).otherwise(0).cast("long").alias("x"), F.when(first, c["unit"]).otherwise(e["unit"]).alias("unit"))
    rest = F.when(first, F.when(rises, a2 - (z1 - a1)).otherwise(a2 + a1) / z2).otherwise(F.when(rises, a1 + a2).otherwise(a1 - (z2 - a2)) / z1)
    kept = F.struct(F.when(first, e["draw"]).otherwise(c["draw"]).alias("draw"), rest.alias("f"), F.when(first, e["unit"]).otherwise(c["unit"]).alias("unit"))
    state = F.struct(kept.alias("carry"), F.concat(acc["done"], F.array(settled)).alias("done"))
    return F.when(c.isNull(), F.struct(e.alias("carry"), acc["done"].alias("done"))).otherwise(state)


def _whole_carry(acc: Column, e: Column) -> Column:
    """As ``_step``; a carried fraction that is 0 or 1 but for rounding is settled, too, before the next pair."""
    c = acc["carry"]
    near = c.isNotNull() & ((c["f"] <= EPS) | (c["f"] >= 1 - EPS))
    own = F.struct(F.when(c["f"] >= 0.5, 1).otherwise(0).cast("long").alias("x"), c["unit"].alias("unit"))
    ended = F.struct(e.alias("carry"), F.concat(acc["done"], F.array(own)).alias("done"))
    return F.when(near, ended).otherwise(_step(acc, e))


def settle(fractions: DataFrame, most_units: int) -> tuple[list[DataFrame], DataFrame]:
    """The reduction tree over ``fractions`` (sid, blocks, draw, f, unit): tables of x, unit of those settled, and of sid, f, draw, unit of the one
    fraction that each source is left with."""
    zero = F.struct(F.lit(None).cast(_FRACTION).alias("carry"), F.array().cast(f"array<struct<x:bigint,unit:{_UNIT}>>").alias("done"))
    done, live = [], fractions
    for level in range(max(1, math.ceil(math.log(max(most_units, 2), FAN)) + 1)):
        block = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks"))
        grouped = live.groupBy("sid", "blocks", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("draw", "f", "unit"))).alias("own"))  # about FAN
        folded = written(grouped.select("sid", "blocks", F.aggregate("own", zero, _whole_carry).alias("end")), "mix-level")
        done.append(folded.select(F.explode("end.done").alias("s")).select("s.x", "s.unit"))
        live = folded.where("end.carry IS NOT NULL").select("sid", F.ceil(F.col("blocks") / FAN).alias("blocks"), "end.carry.draw", "end.carry.f", "end.carry.unit")
    return done, live


def _rounded(left: DataFrame) -> DataFrame:
    """The last fraction of each source, to 1 by its probability: sid, x, unit, missed (the words above the target)."""
    x = F.when(uniform(F.col("draw"), F.lit(7)) < F.col("f"), 1).otherwise(0).cast("long")
    return left.select("sid", x.alias("x"), "unit", ((x - F.col("f")) * F.col("unit.size")).alias("missed"))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, source, text).

    size is the number of words of the text (null: 0), source_size that of the source, target the words the mix wants of it, taken those it takes of the
    document: a whole number of copies, floor(r) or one more, with r = target / source_size.  Sources are ordered by code point, null last, and
    weigh 1, 2, 3, repeating.  Documents without a word are taken 0 words.  Repeated rows stay as often as they come and differ in one copy at most; a null
    doc_id keeps its row.  An empty table gives an empty result; other columns are not read.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("source_key"), words(F.col("text").cast("string")).alias("size"))
    units = written(sized.groupBy("doc_id", "source_key", "size").agg(F.count("*").alias("m")), "mix-units")
    octave = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    by_octave = units.groupBy("source_key", octave.alias("octave")).agg(F.sum(F.col("size") * F.col("m")).alias("w"), F.max("size").alias("z"), F.count("*").alias("k"))
    # at most 64 octaves
    each = F.collect_list(F.struct("octave", "w")).alias("octaves")
    sources = by_octave.groupBy("source_key").agg(F.sum("w").alias("source_size"), F.sum("k").alias("n"), F.max("z").alias("largest"), F.max("octave").alias("top"), each)
    placed = ranked(sources, "source_key").withColumn("weight", F.col("place") % WEIGHTS + 1)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = with_targets(placed, most).withColumn("whole", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    # the octaves of the documents held back: the lowest whose words can take up the largest document of the others, either way
    below = lambda o: F.aggregate("octaves", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["octave"] <= o, x["w"]).otherwise(0))
    enough = F.filter("octaves", lambda o: (o["octave"] < F.col("top")) & (below(o["octave"]) * F.least("p", 1 - F.col("p")) >= F.col("largest")))
    held = F.coalesce(F.array_min(F.transform(enough, lambda o: o["octave"])), F.lit(-1))
    about = placed.select("source_key", F.col("place").alias("sid"), "n", "source_size", "target", "whole", "p", held.alias("held"), F.ceil(F.col("n") / FAN).alias("blocks"))
    about = written(about, "mix-sources")
    most_units = about.agg(F.max("n")).first()[0] or 1

    share = F.when(F.col("size") > 0, F.col("m") * F.col("p")).otherwise(0.0)
    known = join_hot(units, about, "source_key").withColumn("share", share).withColumn("extra", F.floor(F.col("share") + EPS))
    unit = F.struct("doc_id", "size", "m", "whole", "extra", "source_size", "target").cast(_UNIT).alias("unit")
    draw = F.xxhash64("sid", "doc_id", "size", F.lit(SEED)).alias("draw")
    known = written(known.select("sid", "blocks", draw, (F.col("share") - F.col("extra")).alias("f"), (octave <= F.col("held")).alias("held"), unit), "mix-fractions")
    for made in (units, placed, about):
        drop_written(made)
    settled = known.where(F.col("f") <= EPS).select(F.lit(0).cast("long").alias("x"), "unit")
    open_ = known.where(F.col("f") > EPS)

    done, left = settle(open_.where("NOT held").drop("held"), most_units)
    last = written(_rounded(left), "mix-last")
    back = open_.where("held").drop("held")
    room = back.groupBy("sid").agg(F.sum(F.col("unit.size") * F.col("f")).alias("can_fall"), F.sum(F.col("unit.size") * (1 - F.col("f"))).alias("can_rise"), F.count("*").alias("n"))
    shift = room.join(last.select("sid", "missed"), "sid", "left").withColumn("missed", F.coalesce("missed", F.lit(0.0)))
    falls, rises = F.least(F.lit(1.0), F.col("missed") / F.col("can_fall")), F.least(F.lit(1.0), -F.col("missed") / F.col("can_rise"))
    f = F.when(F.col("missed") > 0, F.col("f") * (1 - falls)).otherwise(F.col("f") + (1 - F.col("f")) * rises)
    shifted = join_hot(back, shift, "sid").select("sid", "blocks", "draw", f.alias("f"), "unit")
    done_back, left_back = settle(shifted, most_units)

    for part in [*done, last, *done_back, _rounded(left_back)]:
        settled = settled.unionByName(part.select("x", "unit"))
    return _rows(settled)


def _rows(settled: DataFrame) -> DataFrame:
    """Each unit's rows: the first ``extra`` + x of its copies are taken once more than the others.  Units of many rows are dealt out in chunks."""
    own = settled.select("unit.*", (F.col("unit.extra") + F.col("x")).alias("more"))

    def copies(units: DataFrame, first: Column, last: Column) -> DataFrame:
        taken = F.col("size") * (F.col("whole") + F.when(F.col("copy") <= F.col("more"), 1).otherwise(0))
        return units.withColumn("copy", F.explode(F.sequence(first, last))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))

    few = copies(own.where(F.col("m") <= CHUNK), F.lit(1).cast("long"), F.col("m"))
    many = own.where(F.col("m") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))))
    many = many.repartition("doc_id", "size", "chunk")
    return few.unionByName(copies(many, F.col("chunk") * CHUNK + 1, F.least(F.col("m"), (F.col("chunk") + 1) * CHUNK)))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
