"""Bootstrap intervals as one grouped aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_steps(most: int = 9) -> list[float]:
    """Cumulative probabilities of a Poisson count with mean one, up to ``most`` - 1."""
    return [math.fsum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(most)]


def resample_weight(digest: Column, draw: int) -> Column:
    """How often a cluster is drawn: a Poisson count from the ``draw``-th (0 to 3) eight hexadecimal digits of an md5.

    Digits of one length compare as their numbers do, so none is converted.
    """
    u = F.substring(digest, 8 * draw + 1, 8)
    return sum(((u >= f"{math.ceil(step * 2**32):08x}").cast("int") for step in poisson_steps() if step * 2**32 < 2**32 - 1), F.lit(0))


def bootstrap(rows: DataFrame, by: str, cluster: str, value: str, replicates: int = 200) -> DataFrame:
    """Mean of ``value`` by stratum with its bootstrap interval over whole clusters.

    Poisson resampling: every cluster of a stratum is drawn about once a replicate, so no
    group is ever gathered.  Rows are summed by cluster; a cluster and a batch of four
    replicates share one md5, the same on every run; four sums and sizes are aggregated
    side by side.  What is shuffled is at most strata times batches rows a task.  ``low``
    and ``high`` are the 2.5th and 97.5th percentile, ``bound`` the 5th (one-sided).  Null
    values are left out; a replicate that draws nothing has no mean.
    """
    own = rows.where(F.col(value).isNotNull()).groupBy(by, cluster).agg(F.sum(value).cast("double").alias("_s"), F.count("*").alias("_c"))
    sample = own.groupBy(by).agg(F.count("*").alias("n_clusters"), (F.sum("_s") / F.sum("_c")).alias("_mean"))
    batches = own.select(by, "_s", "_c", cluster, F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))).alias("_b"))
    drawn = batches.select(by, "_b", "_s", "_c", F.md5(F.concat_ws(":", F.col(cluster).cast("string"), F.col("_b").cast("string")).cast("binary")).alias("_h"))
    drawn = drawn.select(by, "_b", "_s", "_c", *[resample_weight(F.col("_h"), d).alias(f"_w{d}") for d in range(4)])
    sums = drawn.groupBy(by, "_b").agg(*[f.alias(f"_{k}{d}") for d in range(4) for k, f in (("m", F.sum(F.col(f"_w{d}") * F.col("_s"))), ("k", F.sum(F.col(f"_w{d}") * F.col("_c"))))])
    each = F.explode(F.array(*[F.struct((F.col("_b") * 4 + d).alias("b"), (F.col(f"_m{d}") / F.nullif(F.col(f"_k{d}"), F.lit(0))).alias("m")) for d in range(4)]))
    means = sums.select(by, each.alias("_x")).where(F.col("_x.b") < replicates)
    at = lambda q: F.round(F.percentile("_x.m", F.lit(q)), 4)
    spread = means.groupBy(by).agg(at(0.025).alias("low"), at(0.975).alias("high"), at(0.05).alias("bound"))
    return sample.join(spread, by, "left").select(by, "n_clusters", F.round("_mean", 4).alias("mean"), "low", "high", "bound")
