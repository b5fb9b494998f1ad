"""One ranking of a query's hits from several scores of different scales (robust rank aggregation).

A score counts only by the rank it gives a hit within its query. Under chance the sorted normalised ranks of a hit are
order statistics of uniform values, whose tail probabilities are beta; the least of them, corrected for the number of
scores, tells how unlikely such good ranks are, and hits are ranked by it.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut_lineage, join_by_weight

SCORES = ("score", "tf_idf", "coordination", "page_rank")


def order_key(x: Column) -> Column:
    """A bucket that grows with the double ``x``: its sign, exponent and first bits, 16 buckets per power of two.

    It is a rule on the value alone, so a query's hits can be ranked bucket by bucket however many there are.
    """
    size = F.log2(F.greatest(F.abs(x), F.lit(1e-300)))
    step = F.floor((size + F.lit(1000.0)) * 16).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, step).otherwise(-step)


def ranks(rows: DataFrame, groups: list[str], value: str, descending: bool = True) -> DataFrame:
    """``rows`` with ``rank``: 1 + how many rows of the group have a better ``value`` (equal ones share a rank).

    No task holds a whole group: its different values are counted, ranked within value buckets, and the sizes of the
    better buckets are added; a group has a bounded number of buckets. Values that very many rows share meet their rows
    by broadcast. ``rows`` is read several times: give a table that is kept.
    """
    side = F.desc if descending else F.asc
    bucket = [*groups, "_bucket"]
    within = Window.partitionBy(*bucket).orderBy(side(value)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*groups).orderBy(side("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    values = rows.groupBy(*groups, value).agg(F.count("*").alias("_n")).withColumn("_bucket", order_key(F.col(value)))
    values = cut_lineage(values.withColumns({"_in": F.coalesce(F.sum("_n").over(within), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*bucket))}))
    better = values.where("_in = 0").select(*bucket, "_size").withColumn("_above", F.coalesce(F.sum("_size").over(across), F.lit(0))).drop("_size")
    ranked = cut_lineage(values.join(better, bucket).select(*groups, value, "_n", (F.col("_in") + F.col("_above") + 1).alias("rank")))
    return join_by_weight(rows, ranked, [*groups, value], "_n").drop("_n")


def beta_tail(x: Column, k: int, m: int, upper: bool = False) -> Column:
    """P(Beta(k, m-k+1) <= x): the chance that the k-th of m normalised ranks is x or better; ``upper`` gives the rest to 1."""
    terms = [F.lit(float(comb(m, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in (range(k) if upper else range(k, m + 1))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def beta_minimum(sorted_ranks: Column, m: int) -> Column:
    """The corrected least tail probability of m sorted normalised ranks: min over k of P(Beta(k, m-k+1) <= r_k), times m."""
    tails = [beta_tail(sorted_ranks[k - 1], k, m) for k in range(1, m + 1)]
    return F.least(F.lit(1.0), m * (F.least(*tails) if m > 1 else tails[0]))


def as_unlikely(rank: Column, n_hits: Column, top: int, k: int, m: int) -> Column:
    """Whether a k-th normalised rank of m is no likelier under chance than that of place ``top`` among ``n_hits``.

    The tail is compared with the one halfway to the next place, and on the side where it is small, so rounding decides
    nothing.
    """
    bound = F.least(F.lit(1.0), F.lit(top + 0.5) / n_hits)
    low = beta_tail(rank, k, m) <= beta_tail(bound, k, m)
    return F.when(bound <= 0.5, low).otherwise(beta_tail(rank, k, m, upper=True) >= beta_tail(bound, k, m, upper=True))


def _ranked(hits: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """``(query_id, url, n_hits, rank_<score>..., _hit, _r)``: ranks of every hit, and its normalised ranks in order."""
    once = hits.where("query_id IS NOT NULL").select("query_id", "url", *[F.col(s).cast("double").alias(s) for s in scores]).distinct()
    once = cut_lineage(once.withColumn("_hit", F.xxhash64("url", *scores)))  # with url it tells hits of one query apart that share a url
    sizes = cut_lineage(once.groupBy("query_id").agg(F.count("*").alias("n_hits")))
    entries = F.explode(F.map_from_arrays(F.array(*map(F.lit, range(len(scores)))), F.array(*scores))).alias("_score", "_value")
    valued = cut_lineage(once.select("query_id", "_hit", entries).where("_value IS NOT NULL AND NOT isnan(_value)"))
    per_hit = (
        ranks(valued, ["query_id", "_score"], "_value")
        .groupBy("query_id", "_hit")
        .agg(*[F.max(F.when(F.col("_score") == k, F.col("rank"))).alias(f"rank_{s}") for k, s in enumerate(scores)])
    )
    full = join_by_weight(once.select("query_id", "url", "_hit"), sizes, ["query_id"], "n_hits").join(per_hit, ["query_id", "_hit"], "left")
    norm = F.array_sort(F.array(*[F.coalesce(F.col(f"rank_{s}") / F.col("n_hits"), F.lit(1.0)) for s in scores]))
    return full.select("query_id", "url", "n_hits", *[f"rank_{s}" for s in scores], "_hit", norm.alias("_r"))


def fused_ranking(hits: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """``(query_id, url, n_hits, rank_<score>..., rho, place)`` for every hit.

    Rows that repeat query_id, url and all scores count once. NULL and NaN are no value: the hit has no rank there and
    its normalised rank is 1, as if last. Ties share the better rank. ``place`` orders by rho; ties share a place.
    Rows without a query_id are dropped; a NULL url is kept as a hit of its own. An empty table gives no rows.
    """
    scored = cut_lineage(_ranked(hits, scores).withColumn("rho", F.round(beta_minimum(F.col("_r"), len(scores)), 9)))
    placed = ranks(scored, ["query_id"], "rho", descending=False)
    return placed.select("query_id", "url", "n_hits", *[f"rank_{s}" for s in scores], "rho", F.col("rank").alias("place"))


def best_fused(hits: DataFrame, top: int = 10, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """``(query_id, place, url, rho)``: the ``top`` hits of each query by rho, ties by the sum of normalised ranks, then by url; places differ.

    A url that a query has with several rows of scores may stand there more than once. Places are settled among the
    hits that place no worse than ``top``, which a limited window cuts before it gathers them.
    """
    rows = _ranked(hits, scores).withColumn("rho", F.round(beta_minimum(F.col("_r"), len(scores)), 9))
    total = F.round(F.aggregate("_r", F.lit(0.0), lambda a, b: a + b), 9)
    order = Window.partitionBy("query_id").orderBy("rho", total, F.col("url").asc_nulls_first(), "_hit")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("query_id", "place", "url", "rho")


def agreed_best(hits: DataFrame, top: int = 3, agree: int = 3, min_hits: int = 10, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """``(query_id, url)``: hits within the best ``top`` of at least ``agree`` scores, of queries with ``min_hits`` hits or more.

    They are told by the beta tail of the order statistic ``agree``, which grows with that rank alone. The minimum over
    all order statistics would give others: of ten hits, one with the ranks 1, 1, 10, 10 has a lesser rho than 3, 3, 3, 10.
    """
    good = as_unlikely(F.element_at("_r", agree), F.col("n_hits"), top, agree, len(scores))
    # a score the hit has no value in has the normalised rank 1, which is the last and not among the best
    known = sum((F.col(f"rank_{s}").isNotNull().cast("int") for s in scores), F.lit(0)) >= agree
    return _ranked(hits, scores).where((F.col("n_hits") >= min_hits) & good & known).select("query_id", "url").distinct()
