"""Exact order statistics by narrowing brackets: a few passes of fixed size, no sorting or numbering of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.storage import materialize

#: Cut points of a pass, and the precision of the sketch that gives them, far finer than a cut.
CUTS = 64
PRECISION = 10_000
#: Values of one key that are put in order at the end; more are narrowed down first.
AT_ONCE = 1_000


def median(rows: DataFrame, key: str, value: str, name: str = "median", at_once: int = AT_ONCE) -> DataFrame:
    """``key, name``: the mean of the two middle values of each key, nulls left out; keys without values have none.

    A pass counts, for each key, the values below, at the ends of and inside a bracket, and takes a sketch of
    those inside; all are folded in every task before anything moves. The bracket then shrinks around a middle
    position to a few of ``CUTS`` parts of its rows, and at least by the values at its ends, whatever the values
    are like. At most ``at_once`` values are put in order as one array.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    share = F.array(*(F.lit(n / CUTS) for n in range(CUTS + 1)))

    def looked(inside: Column) -> list[Column]:
        """Counts and cut points of the values inside a bracket; ties with its ends are counted apart."""
        return [
            F.count_if(inside).alias("_inside"), F.percentile_approx(F.when(inside, F.col("_value")), share, PRECISION).alias("_cuts"),
            F.collect_list(F.when(inside & (F.col("_few")), F.col("_value"))).alias("_held"),
        ]

    counts = materialize(values.groupBy("_key").agg(
        F.count("*").alias("_inside"), F.percentile_approx("_value", share, PRECISION).alias("_cuts"),
        F.min("_value").alias("_least"), F.max("_value").alias("_most"),
    ))
    # The two middle positions are looked for apart, so that ties at one do not hold up the other.
    places = F.array(F.floor((F.col("_inside") - 1) / 2), F.floor(F.col("_inside") / 2))
    state = counts.withColumn("_at", F.explode(F.array_distinct(places))).withColumns(
        {"_n": F.col("_inside"), "_position": F.col("_at")}
    )
    found = None

    def cut(step: int) -> Column:
        """The cut point a step before or behind the position's own; the sketch errs by far less than a step."""
        at = F.floor(F.col("_position") * CUTS / F.col("_inside")) + step
        return F.get("_cuts", F.greatest(F.lit(0), F.least(F.lit(CUTS), at)).cast("int"))

    keys = ["_key", "_n", "_at", "_position", "_low", "_high", "_few"]
    while True:
        few = F.col("_inside") <= at_once
        asked = state.select(
            "_key", "_n", "_at", "_position", F.when(few, F.col("_least")).otherwise(cut(-1)).alias("_low"),
            F.when(few, F.col("_most")).otherwise(cut(2)).alias("_high"), few.alias("_few"), "_least", "_most",
        )
        value_ = F.col("_value")
        within = (value_ > F.col("_low")) & (value_ < F.col("_high"))
        # ``_position`` counts from the lowest value of the last bracket, which is ``_least``.
        of_last = (value_ >= F.col("_least")) & (value_ <= F.col("_most"))
        seen = materialize(
            values.join(asked, "_key").filter(of_last).groupBy(*keys).agg(
                F.count_if(value_ < F.col("_low")).alias("_below"), F.count_if(value_ == F.col("_low")).alias("_lows"),
                F.min(F.when(within, value_)).alias("_least"), F.max(F.when(within, value_)).alias("_most"), *looked(within),
            )
        )
        rank = F.col("_position") - F.col("_below") - F.col("_lows")
        held = F.get(F.sort_array(F.filter("_held", lambda v: v.isNotNull())), rank.cast("int"))
        hit = (
            F.when(rank < 0, F.col("_low")).when(rank >= F.col("_inside"), F.col("_high"))
            .when(F.col("_few"), held).when(F.col("_least") == F.col("_most"), F.col("_least"))
        )
        judged = seen.withColumns({"_hit": hit, "_rank": rank})
        ready = judged.filter("_hit is not null").select("_key", "_n", "_at", "_hit")
        found = ready if found is None else found.unionByName(ready)
        state = judged.filter("_hit is null").select(
            "_key", "_n", "_at", F.col("_rank").alias("_position"), "_inside", "_cuts", "_least", "_most"
        )
        if state.isEmpty():
            break
    both = found.groupBy("_key", "_n").agg(F.min("_hit").alias("_a"), F.max("_hit").alias("_b"))
    return both.select(F.col("_key").alias(key), ((F.col("_a") + F.col("_b")) / 2).alias(name))
