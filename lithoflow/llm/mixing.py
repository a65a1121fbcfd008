"""Documents of several sources combined to target shares of all tokens.

Poisson replication: each document is used as often as a Poisson variable says that is inverted at a
hash of its id, capped at the source's repeats; the mean is the source's repetition rate, so that the
sum over its documents is its share.  The total is the largest that no source has to exceed its
repeats for.  As the hash is fixed, the sum is a step function of the mean, and the mean is set by
bisection on a histogram of the hash (tokens per source and slice), not on the expectation; a few
thousand numbers are collected, whatever the rows.  The chosen copies are shuffled globally by a
second hash.

Defined results: documents with a null source or one without target are never chosen, nor are those
without tokens; targets whose source has no tokens get share 0 and the others are scaled up; targets
that are null, zero or negative count as absent, a null cap as 1; of repeated targets the largest
counts.  The same seed gives the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.operators.rules import small

SLICES = 4096


def uniform(c: str, seed: int) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(c), F.lit(seed)), 11) / float(2**53)


def cdf(mean: float, repeats: int) -> list[float]:
    """P(at most k) of a Poisson variable for k = 0 .. repeats - 1; zeros for an infinite mean."""
    if math.isinf(mean):
        return [0.0] * repeats
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(repeats):
        total += p
        out.append(min(1.0, total))
        p *= mean / (k + 1)
    return out


def uses(u: float, limits: list[float]) -> int:
    return sum(u >= x for x in limits)


def solve(slices: list[tuple[int, float]], wanted: float, repeats: int) -> float:
    """The mean at which the documents, by slice of the hash, are used for the wanted tokens."""

    def reached(mean: float) -> float:
        limits = cdf(mean, repeats)
        return sum(n * uses((k + 0.5) / SLICES, limits) for k, n in slices)

    if wanted <= 0:
        return 0.0
    if wanted >= repeats * sum(n for _, n in slices) * (1 - 1e-12):
        return math.inf
    low, high = 0.0, 60.0 + 4 * repeats
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < wanted else (low, mid)
    return high if abs(reached(high) - wanted) <= abs(reached(low) - wanted) else low


def plan(counted: DataFrame, targets: DataFrame, seed: int = 20240501) -> list[tuple[str, float, float, int, list[float]]]:
    """(source, target share, scaled share, repeats, limits of the inverted distribution) per target."""
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("t"), F.max(F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("m")).collect()
    want = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    sliced = (
        counted.where(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
        .groupBy("source", F.floor(uniform("doc_id", seed) * SLICES).cast("int").alias("k"))
        .agg(F.sum("n_tokens").alias("n"))
        .collect()
    )
    by: dict[str, list[tuple[int, float]]] = {s: [] for s in want}
    for s, k, n in sliced:
        by[s].append((k, float(n)))
    have = {s: sum(n for _, n in x) for s, x in by.items()}
    total_share = sum(want[s][0] for s in want if have[s] > 0)
    share = {s: want[s][0] / total_share if have[s] > 0 else 0.0 for s in want}
    total = min((want[s][1] * have[s] / share[s] for s in want if share[s] > 0), default=0.0)
    out = []
    for s in sorted(want):
        mean = solve(by[s], total * share[s], want[s][1])
        out.append((s, want[s][0], share[s], want[s][1], cdf(mean, want[s][1])))
    return out


def plan_table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "source string, target_share double, scaled_share double, max_repeats int, limits array<double>")


def mix(counted: DataFrame, planned: DataFrame, seed: int = 20240501) -> DataFrame:
    """(doc_id, source, n_tokens, copy, shuffle_key) in the order of the mix; copies count from 0."""
    n = F.size(F.filter("limits", lambda x: F.col("u") >= x))
    docs = counted.where("n_tokens > 0").join(small(planned), "source").withColumn("u", uniform("doc_id", seed)).withColumn("uses", n).where("uses > 0")
    copies = docs.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    return copies.withColumn("shuffle_key", F.xxhash64("doc_id", "copy", F.lit(seed + 1))).orderBy("shuffle_key", "doc_id", "copy")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, scaled_share, max_repeats, n_documents, n_copies, most_repeats, n_tokens,
    reached_share) per target."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("n"))
    per = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_copies"), F.max("uses").alias("most_repeats"), F.sum("n").alias("n_tokens"))
    total = per.agg(F.sum("n_tokens").alias("all_tokens"))
    out = planned.drop("limits").join(per, "source", "left").na.fill(0).join(F.broadcast(total), how="left")  # one row
    return out.withColumn("reached_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
