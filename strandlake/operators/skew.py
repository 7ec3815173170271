"""Per-key results where a few keys hold most rows: fragment-replicate by estimated load.

1. The load of every key is counted with map-side combine.
2. Keys above a task's share are cut into shards in proportion to their load; there can only be
   ``tasks / share`` of them, so this list is bounded and may go to the driver. All other keys fall
   into a fixed number of hash buckets whose loads are bounded in number as well.
3. Shards and buckets are packed onto tasks, largest first into the emptiest task.
4. Rows travel once, to the task of their shard; the matching side is replicated only to the shards
   of a key. Partial results of the shards of a key are merged at the end.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.tables import task_count

SLOT, SHARD = "__slot", "__shard"


@dataclass(frozen=True)
class ShardPlan:
    """Where rows go. ``heavy``: key -> tasks of its shards; ``buckets``: task of each hash bucket."""

    tasks: int
    heavy: dict
    buckets: list[int]
    loads: list[int]

    @property
    def imbalance(self) -> float:
        """Load of the fullest task over the mean."""
        return max(self.loads) * len(self.loads) / max(1, sum(self.loads))


def pack(items: list[tuple[int, object]], tasks: int) -> tuple[dict, list[int]]:
    """Longest-processing-time packing of (load, item) onto tasks: the item's task, the tasks' loads."""
    heap = [(0, t) for t in range(tasks)]
    where, loads = {}, [0] * tasks
    for load, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        full, t = heapq.heappop(heap)
        where[item], loads[t] = t, full + load
        heapq.heappush(heap, (full + load, t))
    return where, loads


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def plan_shards(rows: DataFrame, key: str, tasks: int | None = None, share: float = 0.25, per_task: int = 8) -> ShardPlan:
    """Plan from the exact loads of all keys. ``share``: largest part of a task's mean load one shard may have.

    An empty table gives a plan of empty buckets; null is a key like any other.
    """
    tasks = tasks or task_count(rows.sparkSession)
    n = tasks * per_task
    loads = rows.groupBy(key).agg(F.count(F.lit(1)).alias("load")).withColumn("bucket", _bucket(key, n))
    # total and bucket loads in one small result; heavy keys are at most tasks / share
    by_bucket = {r["bucket"]: r["load"] for r in loads.groupBy("bucket").agg(F.sum("load").alias("load")).collect()}
    total = sum(by_bucket.values())
    cap = max(1, int(total / tasks * share))
    heavy = {r[key]: (r["load"], r["bucket"]) for r in loads.where(F.col("load") > cap).collect()}
    items: list[tuple[int, object]] = []
    for k, (load, bucket) in heavy.items():
        by_bucket[bucket] -= load
        shards = -(-load // cap)
        items += [(-(-load // shards), (k, s)) for s in range(shards)]
    items += [(by_bucket.get(b, 0), b) for b in range(n)]
    where, task_loads = pack(items, tasks)
    return ShardPlan(
        tasks,
        {k: [where[(k, s)] for s in range(-(-load // cap))] for k, (load, _) in heavy.items()},
        [where[b] for b in range(n)],
        task_loads,
    )


def _heavy_table(df: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    schema = T.StructType([T.StructField("__k", df.schema[key].dataType), T.StructField("__slots", T.ArrayType(T.IntegerType()))])
    return F.broadcast(df.sparkSession.createDataFrame(list(plan.heavy.items()), schema))


def fragment(rows: DataFrame, key: str, salt: Column, plan: ShardPlan) -> DataFrame:
    """Rows with the columns of their shard and task, moved to that task.

    Equal values of ``salt`` under a key meet in one shard, so duplicates can be dropped there.
    """
    at = rows.join(_heavy_table(rows, key, plan), F.col(key).eqNullSafe(F.col("__k")), "left")
    shards = F.coalesce(F.size("__slots"), F.lit(1))
    shard = F.when(F.col("__slots").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt, F.lit(7)), shards).cast("int"))
    at = at.withColumn(SHARD, shard)
    slot = F.when(F.col("__slots").isNull(), F.get(F.lit(plan.buckets), _bucket(key, len(plan.buckets)))).otherwise(F.get("__slots", F.col(SHARD)))
    return at.withColumn(SLOT, slot).drop("__k", "__slots").repartitionById(plan.tasks, F.col(SLOT))


def replicate(side: DataFrame, key: str, plan: ShardPlan) -> DataFrame:
    """The matching side, one copy for each shard of a key and no more."""
    at = side.join(_heavy_table(side, key, plan), F.col(key).eqNullSafe(F.col("__k")), "left")
    light = F.array(F.get(F.lit(plan.buckets), _bucket(key, len(plan.buckets))))
    at = at.select(*side.columns, F.posexplode(F.coalesce("__slots", light)).alias(SHARD, SLOT))
    return at.repartitionById(plan.tasks, F.col(SLOT))


#: Fixed values of the BAM index format: first bin of each level and bits of position in a bin.
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
PAST_BINS, SPECIAL_BIN = 37449, 37450
NOT_A_COUNT = 4294967295


def bin_geometry(spark) -> DataFrame:
    """One row for each possible bin number of the format (37,450 and the special one): a proven bound."""
    b = F.col("id").cast("int")
    level, first, bits = F.lit(0), F.lit(0), F.lit(29)
    for i, (start, shift) in enumerate(BIN_LEVELS):
        level, first, bits = (F.when(b >= start, F.lit(x)).otherwise(y) for x, y in ((i, level), (start, first), (shift, bits)))
    special = b >= PAST_BINS
    return spark.range(SPECIAL_BIN + 1).select(
        b.alias("bin_num"),
        F.when(~special, level).alias("bin_level"),
        F.when(~special, F.expr("0L") + (b - first).cast("long") * F.pow(F.lit(2.0), bits).cast("long")).alias("first_base"),
    )


def bin_results(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """For every bin: entries, the sum of its counts, and the entry with the highest count.

    A re-delivered entry counts once. A null or negative count and 4294967295 are not counts; a bin
    without any count has a null sum and no top entry. Ties go to the lowest entry_id. Rows without a
    bin number belong to no bin. Entries of unknown bins come out without geometry.
    """
    rows = entries.where(F.col("bin_num").isNotNull()).select("entry_id", "bin_num", "n_clusters")
    plan = plan_shards(rows, "bin_num", tasks)
    count = F.when((F.col("n_clusters") >= 0) & (F.col("n_clusters") != NOT_A_COUNT), F.col("n_clusters"))
    keys = [SLOT, "bin_num", SHARD]
    once = fragment(rows, "bin_num", F.col("entry_id"), plan).groupBy(*keys, "entry_id").agg(F.max(count).alias("n"))
    top = F.max(F.when(F.col("n").isNotNull(), F.struct("n", (-F.col("entry_id")).alias("neg_id"))))
    shards = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("total"), top.alias("top"))
    side = replicate(bin_geometry(entries.sparkSession), "bin_num", plan)
    joined = shards.join(side, keys, "left")
    return joined.groupBy("bin_num").agg(
        F.sum("entries").alias("entries"),
        F.sum("total").alias("total_clusters"),
        F.max("top").alias("top"),
        F.max("bin_level").alias("bin_level"),
        F.max("first_base").alias("first_base"),
    ).select("bin_num", "entries", "total_clusters", F.col("top.n").alias("top_clusters"), (-F.col("top.neg_id")).alias("top_entry_id"), "bin_level", "first_base")
