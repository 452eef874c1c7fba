"""Tails of the binomial law with chance 1/2, as Column expressions: the exact sign test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_tail(n: Column, k: Column) -> Column:
    """Chance of ``k`` or more heads in ``n`` throws of a fair coin; 1 for k <= 0, 0 for k > n, null for a null or
    negative n. Terms are summed from logarithms, each the one before times (n - i + 1) / i, so that thousands of
    throws don't underflow. Takes n steps: n is a number of years or the like."""
    start = F.struct((-n * math.log(2.0)).cast("double").alias("log_term"), F.lit(0.0).alias("tail"))

    def step(acc, i):
        log_term = acc["log_term"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
        return F.struct(log_term.alias("log_term"),
                        (acc["tail"] + F.when(i >= k, F.exp(log_term)).otherwise(F.lit(0.0))).alias("tail"))

    steps = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")))
    tail = F.aggregate(steps, start, step, lambda acc: acc["tail"])
    return (F.when(n.isNull() | k.isNull() | (n < 0), F.lit(None).cast("double"))
            .when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(tail, F.lit(1.0))))
