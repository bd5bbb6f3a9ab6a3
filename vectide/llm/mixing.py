"""Mix sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. A source takes the documents below its
threshold, which is found digit by digit: sizes are summed by source and digit,
the digit in which the budget runs out is kept, and only the documents in that
one cell are summed again by the next digit. Nothing is sorted, and a source
that holds most of the rows is summed where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import fresh, quoted, word_count
from vectide.session import materialize

#: Bits of a digit and digits of a hash: 15 hexadecimal digits of an md5 sum. A source has 1,024 cells a level.
DIGIT, LEVELS = 10, 6
#: What has one row per source is sent to all tasks up to so many sources, else joined by shuffles.
BROADCAST_SOURCES = 50_000
#: No document is taken more often than this.
MOST = 3
#: Weights of the sources in order of their names, repeating.
CYCLE = (5, 2, 1)


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the md5 sum of id and text; equal rows are drawn together."""
    key = F.concat_ws("|", quoted(doc_id).cast("string"), quoted(text))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``source, weight``: the cycle dealt out over the names by code point, null last.

    ``sources`` has one row per source; ranking those few rows takes one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    return sources.select("source", F.get(weights, rank % len(cycle)).cast("long").alias("weight"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size, weight``.

    All sizes together are shared out by weight. No target exceeds ``most``
    times its source; what is above is shared out again among the others. The
    sources that hit their limit are those with the least limit per weight, so
    one running sum in that order finds the share of the others.
    """
    everything = Window.partitionBy()
    order = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    limited = sizes.filter("weight > 0").withColumn("limit", F.col("source_size") * most)
    shares = limited.select(
        "source", "source_size", "weight", "limit",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("limit_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    share = (F.col("total") - F.col("limit_before")).cast("double") / (F.col("weights") - F.col("weight_before"))
    level = shares.withColumn("share", share)
    # The first source whose share stays within its limit sets the share of all that follow; from there on shares fall.
    level = level.withColumn("level", F.max(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.col("share")))
                             .over(everything))
    target = F.when(F.col("share") * F.col("weight") > F.col("limit"), F.col("limit").cast("double")).otherwise(
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def thresholds(drawn: DataFrame, budgets: DataFrame, small=lambda few: few) -> DataFrame:
    """``source, threshold``: hashes up to it fill the budget as closely as whole documents can.

    ``drawn`` has ``source, hash, size``, ``budgets`` has ``source, budget``;
    ``small`` marks tables of one row per source for the join.
    """
    cells = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        own = cells.select(F.col("source").alias("s"), "budget", "prefix")
        here = drawn.withColumn("digit", F.shiftright("hash", shift))
        here = here.join(small(own), here["source"].eqNullSafe(own["s"]) & (F.shiftright("digit", DIGIT) == own["prefix"]))
        sums = here.groupBy("source", "digit").agg(
            F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("prefix").alias("prefix"))
        running = Window.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("through", F.sum("size").over(running))
        # Of the cells that end beyond the budget the first is the boundary.
        beyond = sums.filter(F.col("through") > F.col("budget")).groupBy("source").agg(
            F.min(F.struct("digit", "size", "through", "budget")).alias("cell"))
        left = F.col("cell.budget") - (F.col("cell.through") - F.col("cell.size"))
        if level < LEVELS - 1:
            cells = beyond.select("source", left.alias("budget"), F.col("cell.digit").alias("prefix"))
        else:
            # Documents of one hash: all or none, whichever comes nearer.
            take = (F.col("cell.through") - F.col("cell.budget")) < left
            done = beyond.select("source", F.when(take, F.col("cell.digit")).otherwise(F.col("cell.digit") - 1).alias("threshold"))
    return done


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """``carry`` (all columns of ``docs`` unless given) plus size, source_size, target, copies and taken.

    A document is taken ``copies`` times, 0 to ``most``: as often as its source
    fits whole into its target, and once more below the threshold of the rest.
    ``weights`` has ``source, weight``; the cycle of :func:`cycled_weights`
    unless given. Reruns agree, since hashes depend on ids and texts alone.

    Edge cases: a null text has no words; a null source is a source, named last.
    A source without words is never taken. Repeated rows are drawn together.
    Added columns get a trailing ``_`` where names clash.
    """
    if carry is None:
        carry = {name: quoted(name) for name in docs.columns}
    names = fresh(carry, "size", "source_size", "target", "copies", "taken")
    src, hash_, size = fresh([*carry, *names], "source__", "hash__", "size__")
    sized = docs.select(*[column.alias(name) for name, column in carry.items()], quoted(source).alias(src),
                        document_hash(doc_id, text).alias(hash_), word_count(text).alias(size))
    sized = materialize(sized, "sized")
    drawn = sized.select(F.col(src).alias("source"), F.col(hash_).alias("hash"), F.col(size).alias("size"))
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weights = cycled_weights(sizes)
    weights = weights.select(F.col("source").alias("named"), "weight")
    sizes = sizes.join(weights, sizes["source"].eqNullSafe(weights["named"]), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    goal = targets(sizes)
    goal = goal.select(F.col("source").alias("named"), "source_size", "target")
    plan = sizes.join(goal.drop("source_size"), sizes["source"].eqNullSafe(goal["named"]), "left").select(
        "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
    plan = plan.withColumn("budget", F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
    plan = materialize(plan, "plan")
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda few: few
    limits = thresholds(drawn, plan.filter("budget > 0").select("source", "budget"), small)
    limits = limits.select(F.col("source").alias("named"), "threshold")
    plan = plan.join(limits, plan["source"].eqNullSafe(limits["named"]), "left").select(
        F.col("source").alias(f"{src}s"), F.col("source_size").alias(f"{src}size"), F.col("target").alias(f"{src}target"),
        F.col("whole").alias(f"{src}whole"),
        # A budget that no cell exceeds takes all of its source.
        F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit(1 << DIGIT * LEVELS)).otherwise(F.lit(-1))).alias(f"{src}threshold"))
    mixed = sized.join(small(plan), F.col(src).eqNullSafe(F.col(f"{src}s")))
    copies = F.col(f"{src}whole") + (F.col(hash_) <= F.col(f"{src}threshold")).cast("long")
    return mixed.select(*[quoted(name) for name in carry], F.col(size).alias(names[0]), F.col(f"{src}size").alias(names[1]),
                        F.col(f"{src}target").alias(names[2]), copies.alias(names[3]), (copies * F.col(size)).alias(names[4]))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with the columns of ``docs``."""
    mixed = mix(docs, **options)
    copies = quoted(mixed.columns[-2])
    repeated = mixed.filter(copies > 0).withColumn(fresh(mixed.columns, "copy")[0], F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*[quoted(name) for name in docs.columns])
