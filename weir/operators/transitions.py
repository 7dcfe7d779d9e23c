"""State chains: transition frequencies and probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Lag, ordered_scan


def transition_freq(states: DataFrame, entity: str = "entity", seq: str = "seq", state: str = "state") -> DataFrame:
    """(from_state, to_state, cnt, p): consecutive pairs, p = share of all steps."""
    steps = ordered_scan(states.select(entity, seq, state), [entity], [seq], [Lag("from_state", state)])
    pairs = steps.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("cnt"))
    total = states.select(F.count(F.lit(1))).scalar()
    return pairs.where("from_state IS NOT NULL").withColumn("p", F.col("cnt") / total)


def transition_prob(transitions: DataFrame) -> DataFrame:
    """Adds ``prob``: p divided by the sum of p over the source state; null if that is 0."""
    totals = transitions.groupBy("from_state").agg(F.sum("p").alias("__total"))
    return transitions.join(totals, "from_state").withColumn("prob", F.try_divide("p", "__total")).drop("__total")


def neighbor_prob(transitions: DataFrame) -> DataFrame:
    """(state, neighbor, prob): both directions added, then normalised per state."""
    ends = F.struct(F.col("from_state").alias("state"), F.col("to_state").alias("neighbor"))
    back = F.struct(F.col("to_state").alias("state"), F.col("from_state").alias("neighbor"))
    # A loop is one entry, not two.
    ways = F.when(F.col("from_state") == F.col("to_state"), F.array(ends)).otherwise(F.array(ends, back))
    both = transitions.select(F.explode(ways).alias("w"), "p").groupBy("w.state", "w.neighbor").agg(F.sum("p").alias("p"))
    totals = both.groupBy("state").agg(F.sum("p").alias("__total"))
    return both.join(totals, "state").select("state", "neighbor", F.try_divide("p", "__total").alias("prob"))


def distinct_states(transitions: DataFrame) -> DataFrame:
    ends = F.explode(F.array("from_state", "to_state")).alias("state")
    return transitions.select(ends).distinct().orderBy("state")
