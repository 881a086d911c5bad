"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's target is its share of the corpus by weight, at most ``cap`` times its size, the excess reshared.
Seats are blocks of as many words; seats go to sources by the highest quotients target / (2 k + 1), and each source's
seats go to its shards the same way. A shard lays its documents in a seeded order; it takes each of its blocks
seats // blocks times and a seeded choice of seats % blocks of them once more. A document's take is the words it has
in the blocks taken, so it may be cut at block edges and repeat up to ``cap`` times.

A shard holds documents of one source by a hash of doc_id; the number of shards follows the sizes and is bounded by
``MAX_SHARDS`` plus the sources, so a source with any share of the rows is cut into many tasks. Only sums per source
and per shard reach the driver.

Nulls: a null text has size 0 and gives nothing; a null source is a source of its own (last in order); a null doc_id
keeps its row. Repeated rows each count. Empty tables give an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_column, materialise, table

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS = 2_000_000
MAX_SHARDS = 20_000
#: Seats at most, so that the smallest block follows the corpus.
MAX_BLOCKS = 200_000_000
CAP = 3


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size, the excess reshared by weight."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        open_ = [i for i in open_ if i not in set(full)]
        rest = total - sum(out)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), ties to the first, none above its cap.

    Seats whose quotient is above a divisor that gives no seat too many are dealt at once; a queue deals the rest.
    """
    caps = caps or [seats] * len(votes)
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))

    def above(divisor: float) -> list[int]:
        """How many quotients of each are above ``divisor``."""
        return [min(c, max(0, math.ceil((v / divisor - 1) / 2))) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]

    got = [0] * len(votes)
    if seats > 0:
        low, high = min(v for v in votes if v > 0) / (2 * seats + 2), max(votes)  # all that are dealt lie between
        while high - low > high * 1e-12:
            middle = (low + high) / 2
            low, high = (low, middle) if sum(above(middle)) <= seats else (middle, high)
        got = above(high * (1 + 1e-9))
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _seeded(seed: int, *parts) -> int:
    return int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:8], "little")


def _step(n: int, seed: int) -> int:
    """A step that visits all n blocks and scatters them."""
    step = max(1, int(n * 0.6180339887) + seed % 17)
    while math.gcd(step, n) != 1:
        step += 1
    return step % n if n > 1 else 0


def mix(docs: DataFrame, weight_of, seed: int = 20_240_501, cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns source, shard and ``carry``. ``weight_of(k)`` is the weight of the k-th source by code point."""
    spark = docs.sparkSession
    sized = docs.select(*carry, id_column(), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(sized, "op5-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes, total = [r.n for r in sums], sum(r.n for r in sums)
    goal = targets(sizes, [weight_of(k) for k in range(len(sums))], total, cap)
    least = min((g for g in goal if g > 0), default=1)
    block = max(1, min(4096, int(least / 200)), -(-total // MAX_BLOCKS))
    per_shard = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    shards = [max(1, -(-n // per_shard)) for n in sizes]

    plan = spark.createDataFrame([(r.source, r.source is None, r.n, g, k, s) for k, (r, g, s) in enumerate(zip(sums, goal, shards, strict=True))], "source string, no_source boolean, source_size long, target double, source_no int, shards int")
    plan = plan.select("source_no", "source_size", "target", "shards", F.coalesce("source", F.lit("")).alias("plan_source"), "no_source")
    # The plan has a row for each source; Spark broadcasts it while it is small and shuffles it beyond.
    keyed = sized.join(plan, (F.coalesce("source", F.lit("")) == F.col("plan_source")) & (F.col("source").isNull() == F.col("no_source")))
    order = F.xxhash64(F.lit(seed), "doc_id")
    keyed = keyed.select(*carry, "doc_id", "source", "size", "source_size", "target", "source_no", order.alias("order"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards")).cast("int").alias("shard"))

    parts = sorted(keyed.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source_no, r.shard))
    by_source: dict[int, list] = {}
    for r in parts:
        by_source.setdefault(r.source_no, []).append(r)
    blocks = {(r.source_no, r.shard): -(-r.n // block) for r in parts}
    caps = [sum(cap * blocks[k, r.shard] for r in by_source[k]) for k in range(len(sums))]
    quota = sainte_lague(goal, round(total / block), caps)
    rows = []
    for k, own in by_source.items():
        seats = sainte_lague([float(r.n) for r in own], quota[k], [cap * blocks[k, r.shard] for r in own])
        for r, q in zip(own, seats, strict=True):
            n = blocks[k, r.shard]
            rnd = _seeded(seed, k, r.shard)
            rows.append((k, r.shard, n, q // n if n else 0, q % n if n else 0, _step(n, rnd) if n else 0, rnd % n if n else 0))
    quotas = spark.createDataFrame(rows, "source_no int, shard int, blocks long, rounds long, extra long, step long, shift long")

    line = Window.partitionBy("source_no", "shard").orderBy("order", "doc_id", "size")
    laid = keyed.withColumn("hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["source_no", "shard"])
    lo = F.col("hi") - F.col("size")
    at = F.sequence(F.floor(lo / block), F.floor((F.col("hi") - 1) / block))
    more = F.aggregate(
        F.when((F.col("size") > 0) & (F.col("extra") > 0), at).otherwise(F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.when((b * F.col("step") + F.col("shift")) % F.col("blocks") < F.col("extra"), F.least((b + 1) * block, F.col("hi")) - F.greatest(b * block, lo)).otherwise(0).cast("long"),
    )
    return laid.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + more).alias("taken"), "source", "shard", *carry)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), lambda k: k % 3 + 1).drop("source", "shard")
