"""Mixing of sources to target weights by a time-varying curriculum. DataFrame functions only.

Each source has a schedule: knots of (at, weight) from time 0 to 1, straight between them. The integral of a schedule is the
source's weight, and the weights share the words that the mix takes; the part of the integral up to a time, scaled to the
source's share, is its cumulative demand. The documents of a source stand one after another in the order of a hash, in as many
rounds as its share needs, and a document is due when the demand reaches the words before it: its position is the inverse of
the cumulative demand. The mix is sorted by position over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, materialise, operator, text_of

#: Rows of a source whose sizes are added up in one task; a source has as many buckets as it needs.
BUCKET = 2_000
#: Times that a document, and so a source, is taken at most.
ROUNDS = 3
#: Weights of the sources in their order, repeating, each as the knots of a schedule with that integral.
SCHEDULES = {5: ((0.0, 6.0), (0.5, 5.0), (1.0, 4.0)), 2: ((0.0, 1.0), (1.0, 3.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def n_words(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has."""
    one = F.trim(F.regexp_replace(text, r"[\x20\t-\r]+", " "))
    return F.when(one == "", 0).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def _segments(knots: Column) -> Column:
    """Of a schedule, array<struct<t0,t1,w0,w1,c0,c1>>: the stretches between knots, with the integral before and after."""
    knot = lambda i, name: F.get(knots, i)[name].cast("double")
    area = lambda i: (knot(i + 1, "at") - knot(i, "at")) * (knot(i, "weight") + knot(i + 1, "weight")) / 2
    upto = lambda i: F.aggregate(F.slice(F.sequence(F.lit(0), F.size(knots) - 2), 1, i), F.lit(0.0), lambda x, k: x + area(k))
    names = {"t0": lambda i: knot(i, "at"), "t1": lambda i: knot(i + 1, "at"), "w0": lambda i: knot(i, "weight"), "w1": lambda i: knot(i + 1, "weight"), "c0": upto, "c1": lambda i: upto(i + 1)}
    return F.transform(F.sequence(F.lit(0), F.size(knots) - 2), lambda i: F.struct(*[f(i).alias(n) for n, f in names.items()]))


def _inverse(segments: Column, c: Column) -> Column:
    """The time at which the integral of a schedule reaches c."""
    last = F.element_at(segments, -1)
    s = F.coalesce(F.get(F.filter(segments, lambda s: (s["c0"] <= c) & (c < s["c1"])), F.lit(0)), last)
    rest, h = F.greatest(c - s["c0"], F.lit(0.0)), s["t1"] - s["t0"]
    slope = F.try_divide(s["w1"] - s["w0"], h)
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(s["t0"] + F.coalesce(F.try_divide(2 * rest, s["w0"] + root), F.lit(0.0)), s["t1"])


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with n, from 0 in a global order: dealt by ranges and written once; only the sizes of the ranges meet in one task."""
    own = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("own_at", F.monotonically_increasing_id()))
    own = own.withColumn("own_range", F.shiftright("own_at", 33))
    before = own.groupBy("own_range").agg(F.count("*").alias("own_count"))
    before = before.withColumn("own_before", F.sum("own_count").over(Window.orderBy("own_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own_count")).drop("own_count")
    return own.join(F.broadcast(before), "own_range").withColumn("n", F.col("own_before") + F.col("own_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("own_at", "own_range", "own_before")


def cycling(sources: DataFrame, schedules: Sequence = tuple(SCHEDULES.values())) -> DataFrame:
    """sources (one row each) with knots: the schedules in turn, for the sources by code point, null last."""
    turn = lambda s: F.array(*[F.struct(F.lit(t).alias("at"), F.lit(w).alias("weight")) for t, w in s])
    place = _numbered(sources.withColumn("own_last", F.col("source").isNull()), "own_last", "source").drop("own_last")
    which = F.col("n") % len(schedules)
    knots = F.coalesce(*[F.when(which == k, turn(s)) for k, s in enumerate(schedules)])
    return place.withColumn("knots", knots).drop("n")


def _targets(sources: DataFrame) -> DataFrame:
    """sources (source_size, weight) with target: all words shared by weight; what is above ROUNDS times a source's size is
    shared again among the others, until none is above. Only sums reach the driver."""
    most = F.col("source_size") * ROUNDS
    words, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, full = words / weights if weights else 0.0, -1
    while True:
        above = most < F.lit(float(level)) * F.col("weight")
        n, held, left = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not left:
            return sources.withColumn("target", F.when(above, most.cast("double")).otherwise(F.lit(float(level)) * F.col("weight")))
        full, level = n, (words - held) / left


@operator
def mix(docs: DataFrame, schedules=cycling) -> DataFrame:
    """The training stream, sorted by position: row, doc_id, source, size, source_size, target, epoch, words, position.

    schedules takes the table of sources and adds knots; a source without knots, or whose integral is 0, takes no words. The
    words of all sources together are shared by the integrals; a source takes at most ROUNDS times its words. A document is in
    a round (epoch) as long as its source's target reaches it, and the one at the target is cut to the words that are left;
    documents of which no word is taken have one row, with 0 words and no position. row tells the rows of docs apart.

    A null text has no words; an empty table has no rows. Documents of a source are in the order of the MD5 of doc_id and text,
    so that reruns agree whatever the partitions; rows alike in both are interchangeable. Columns other than doc_id, source and
    text are not read. Sizes are added up in buckets of a source, so that a hot one is dealt over many tasks, and only narrow
    rows are shuffled.
    """
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text_of()))
    rows = docs.select("doc_id", "source", _key(F.col("source")).alias("key"), n_words(text_of()).alias("size"), order.alias("order"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = materialise(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")))
    planned = materialise(schedules(sizes.select("key", "source")).select("key", F.when(F.size("knots") > 1, _segments(F.col("knots"))).alias("segments")))
    planned = sizes.drop("source").join(planned, "key", "left").withColumn("weight", F.coalesce(F.element_at("segments", -1)["c1"], F.lit(0.0)))
    sources = materialise(_targets(materialise(planned)))
    total = rows.count()
    met = rows.join(F.broadcast(sources), "key") if sources.count() <= BROADCAST_ROWS // 100 else attach(rows, sources, "key", "n", total)
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2**32
    met = met.withColumn("bucket", F.floor(share * F.ceil(F.col("n") / BUCKET)).cast("int"))
    sums = met.groupBy("key", "bucket").agg(F.sum("size").alias("own")).withColumn("before", F.sum("own").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
    sums = materialise(sums.drop("own"))
    walk = Window.partitionBy("key", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("within", F.sum("size").over(walk) - F.col("size"))
    placed = placed.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, ["key", "bucket"])
    rounds = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
    start = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("within")
    rounds = rounds.withColumn("start", start).withColumn("words", F.greatest(F.least(F.floor("target") - F.col("start"), F.col("size")), F.lit(0)))
    rounds = rounds.where("words > 0 or epoch = 0")
    position = F.when(F.col("words") > 0, _inverse(F.col("segments"), F.col("start") / F.col("target") * F.col("weight")))
    out = rounds.select("row", "doc_id", "source", "size", "source_size", "target", "epoch", "words", position.alias("position"))
    return out.repartitionByRange("position", "row").sortWithinPartitions("position", "row")


def taken(stream: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, rounds, first_position for each row of the documents of a mix."""
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return stream.groupBy("row").agg(*same, F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("rounds"), F.min("position").alias("first_position")).drop("row")
