"""One mix of several sources by target shares of tokens.

The mix is divided into blocks of equal size in tokens. Sainte-Lague apportionment gives each block to the source with
the highest quotient share / (2 * blocks so far + 1), as long as the source has tokens left (its tokens times
max_repeats). The quota of a source is divided among its shards in the same way, by their tokens. A shard's documents, in
a seeded order, are cut into blocks of that size, and its quota of blocks is selected. Only sums per source and
shard reach the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import normalise_url as folded
from lodestar.llm.byte_bpe import DEFAULT_VOCABULARY
from lodestar.llm.encode import token_counts
from lodestar.session import cut_lineage

BLOCKS = 20_000


def sainte_lague(votes: dict, seats: int, limit: dict) -> dict:
    """Seats by highest quotients votes / (2 * seats + 1), never more than ``limit``; ties go to the lesser key.

    Seats that nobody can take stay free. Keys without votes get none. The count begins where every key has nearly its
    proportional part, which it gets in any case, so the work doesn't depend on ``seats`` unless limits bind.
    """
    given = dict.fromkeys(votes, 0)
    live = {k: Fraction(v) for k, v in votes.items() if v > 0 and limit[k] > 0}
    while seats > 0 and live:
        total = sum(live.values())
        # nobody falls more than one seat for each rival behind its part, and who reaches its limit leaves its part to the others
        sure = {k: min(limit[k] - given[k], max(0, int(v * (seats + sum(given[k] for k in live)) / total) - len(live) - given[k])) for k, v in live.items()}
        for k, n in sure.items():
            given[k] += n
            seats -= n
        full = [k for k in live if given[k] >= limit[k]]
        for k in full:
            del live[k]
        if full:
            continue
        queue = [(-v / (2 * given[k] + 1), k) for k, v in live.items()]
        heapq.heapify(queue)
        while seats > 0 and queue:
            _, k = heapq.heappop(queue)
            given[k] += 1
            seats -= 1
            if given[k] >= limit[k]:
                del live[k]
                break
            heapq.heappush(queue, (-live[k] / (2 * given[k] + 1), k))
    return given


@dataclass
class Plan:
    """What each source, and each shard of it, gives to the mix."""

    total: int
    block: Fraction
    tokens: dict[str, int]
    share: dict[str, Fraction]
    repeats: dict[str, int]
    quota: dict[str, int]
    shard_tokens: dict[tuple[str, int], int]
    shard_quota: dict[tuple[str, int], int]

    def deficit(self) -> dict[str, int]:
        """Tokens by which the documents of a source, all used as often as allowed, fall short of what it is apportioned.

        The apportionment without limits, of single tokens, tells what a source should give. It is whole tokens, so a
        source within one token of its part is compared exactly.
        """
        wish = sainte_lague(self.share, self.total, dict.fromkeys(self.share, self.total + 1))
        short = {}
        for s in self.share:
            able = self.tokens[s] * self.repeats[s]
            lack = wish[s] - able
            if abs(lack) <= len(self.share):
                lack = 1 if able < self.share[s] * self.total else 0
            if lack > 0:
                short[s] = lack
        # where there is nothing to mix nothing is lacking
        return short


def targets_of(targets: DataFrame) -> DataFrame:
    """Targets with sources trimmed and in lower case; of a source named twice the shares add up and the larger repeat counts.

    A NULL share counts as 0 and NULL repeats as 1; rows without a source are dropped.
    """
    return (
        targets.where("source IS NOT NULL")
        .groupBy(folded(F.col("source")).alias("source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, shards: int | None = None) -> DataFrame:
    """``(doc_id, source, shard, n_tokens)`` of the documents of the targets' sources; one row per doc_id.

    The number of shards grows with the root of the number of documents, so that neither a shard, which one task sorts,
    nor the list of shards, which the driver holds, grows as the documents do.
    """
    shards = shards or 1 + isqrt(documents.count()) // 8
    own = documents.select("doc_id", folded(F.col("source")).alias("source"), "text").where("source IS NOT NULL AND doc_id IS NOT NULL")
    wanted = own.join(targets_of(targets).select("source"), "source", "left_semi")
    counted = token_counts(wanted, vocabulary)
    once = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("_d")).select("doc_id", "_d.source", "_d.n_tokens")
    return once.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))


def plan(sizes: DataFrame, targets: DataFrame) -> Plan:
    """The apportionment. The driver gets one row per target and one per source and shard, both of fixed number."""
    rows = targets_of(targets).collect()
    share = {r.source: Fraction(str(r.target_share)) for r in rows}
    repeats = {r.source: max(0, r.max_repeats) for r in rows}
    shard_tokens = {(r.source, r.shard): r.n for r in sizes.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()}
    tokens = dict.fromkeys(share, 0)
    for (s, _), n in shard_tokens.items():
        tokens[s] += n
    total = sum(tokens.values())
    block = Fraction(max(total, 1), BLOCKS)
    quota = sainte_lague(share, BLOCKS if total else 0, {s: -(-tokens[s] * repeats[s] // block) for s in share})
    shard_quota: dict[tuple[str, int], int] = {}
    for s, q in quota.items():
        own = {k: n for k, n in shard_tokens.items() if k[0] == s}
        shard_quota |= sainte_lague(own, q, {k: -(-n * repeats[s] // block) for k, n in own.items()})
    return Plan(total, block, tokens, share, repeats, quota, shard_tokens, shard_quota)


def _mixed(sizes: DataFrame, made: Plan, seed: int) -> DataFrame:
    spark = sizes.sparkSession
    quotas = []
    for (s, k), q in made.shard_quota.items():
        n = made.shard_tokens[s, k]
        own = n / made.block  # blocks that the shard has
        rounds = min(int(q / own), made.repeats[s]) if n else 0
        quotas.append((s, k, rounds, float(q - rounds * own) if n else 0.0, made.repeats[s], float(made.block)))
    schema = T.StructType.fromDDL("source string, shard int, rounds bigint, rest double, repeats bigint, block double")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    joined = ranked.join(spark.createDataFrame(quotas, schema), ["source", "shard"])
    # the seeded order of a shard is cut into blocks of equal tokens; the first ``rest`` of them are selected, and with
    # a block the documents whose middle lies in it
    middle = (F.col("_before") + F.col("n_tokens") / 2) / F.col("block")
    extra = (middle <= F.col("rest")).cast("bigint")
    copies = F.least(F.col("rounds") + extra, F.col("repeats"))
    return joined.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 7) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of the documents in the mix, which is as large as all documents together.

    ``copies`` never exceeds max_repeats. What a source can't fill goes to the others by their quotients. Documents
    without tokens come along in whole rounds of their shard. An empty corpus gives an empty mix.
    """
    sizes = cut_lineage(sized(documents, targets, vocabulary))
    return _mixed(sizes, plan(sizes, targets), seed)


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 7) -> DataFrame:
    """``(source, target_share, reached_share, tokens, mixed_tokens, quota_blocks, fillable)``, a row per target."""
    sizes = cut_lineage(sized(documents, targets, vocabulary))
    made = plan(sizes, targets)
    short = set(made.deficit())
    got = _mixed(sizes, made, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    rows = [(s, float(made.share[s]), made.tokens[s], made.quota[s], s not in short) for s in made.share]
    named = sizes.sparkSession.createDataFrame(rows, "source string, target_share double, tokens bigint, quota_blocks bigint, fillable boolean")
    whole = named.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("bigint")))
    # one row per target, so an unpartitioned window is as small as the targets
    every = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return whole.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), every), F.lit(0.0)))


def unfillable(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(source)``: targets that can't be reached even if all their documents are used max_repeats times."""
    sizes = sized(documents, targets, vocabulary)
    return documents.sparkSession.createDataFrame([(s,) for s in plan(sizes, targets).deficit()], "source string")
