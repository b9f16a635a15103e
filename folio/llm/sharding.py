"""Sharding: minimum-cost-flow resharding.

Given old shards and the capacities of new ones, the bytes that each old shard sends to each new one are the flow of
least cost in a bipartite network: a byte that stays in the shard of the same number costs 0, one that moves costs 1.
The network has a node a shard, never a node a document, so the driver solves it whatever the rows' number. The flow
cuts every old shard's line of bytes (documents in order of a hash) into stretches, one a target. Documents
inside a stretch follow it; the few that lie across a cut (at most one a cut) are placed largest first where most room
is left, which keeps the sizes within about one document of each other.

The running sums are two-level, and slots are counted in cells of CELL bytes, so neither an old shard that holds a third
of the bytes nor a document that makes a third of the rows is a hot task. Old shards are numbered from 0 and few (at most
MOST_SHARDS).

Null text has no bytes and the checksum of an empty one; a null doc_id counts as a document; repeated rows are
documents of their own and stand side by side; an empty table gives an empty result. Equal free room (a tie) goes to the
shard of the smaller number. A very long text is one document, in one shard, whatever its capacity; texts are only
measured, never moved but by `rewrite_affected`. Columns that are asked for by `keep` pass by; as struct
(`whole`) they may have any names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import discard, running_start, staged

MOST_SHARDS = 4096
NEW_SHARDS = 40
OLD_SHARDS = 24
OVERHEAD = 16
#: Bytes of an old shard's line whose slots are counted in one task: no more than CELL / OVERHEAD rows.
CELL = 1 << 26
#: The column in which a plan carries whole documents.
DOCUMENT = "document"


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def least_cost_flow(supplies: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Units from each supply i to each capacity j, all supplies placed, at least cost: shortest augmenting paths with potentials.

    Supplies may not exceed capacities in sum; costs may not be negative.
    """
    n, m = len(supplies), len(capacities)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    head: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def edge(a: int, b: int, most: int, c: int) -> None:
        for x, y, r, p in ((a, b, most, c), (b, a, 0, -c)):
            graph[x].append(len(head))
            head.append(y)
            room.append(r)
            price.append(p)

    for i, s in enumerate(supplies):
        edge(source, i, s, 0)
    for j, c in enumerate(capacities):
        edge(n + j, sink, c, 0)
    first = len(head)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supplies[i], capacities[j]), cost(i, j))
    potential = [0] * len(graph)
    left = sum(supplies)
    while left:
        far, via = [float("inf")] * len(graph), [-1] * len(graph)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                y = head[e]
                if room[e] and (to := d + price[e] + potential[x] - potential[y]) < far[y]:
                    far[y], via[y] = to, e
                    heapq.heappush(queue, (to, y))
        if via[sink] < 0:
            raise ValueError("the capacities can't hold the supplies")
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = head[via[x] ^ 1]
        sent = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
        left -= sent
    return {(k // m, k % m): room[e + 1] for k, e in enumerate(range(first, len(head), 2)) if room[e + 1]}


def _stretches(supplies: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, start, end, new): the flow as cuts of each old shard's line, what stays coming first."""
    at = [0] * len(supplies)
    out = []
    for (i, j), units in sorted(least_cost_flow(supplies, capacities).items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((i, at[i], at[i] + units, j))
        at[i] += units
    return out


def measured(df: DataFrame, old_shard: Column, doc_id: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """Slim rows: doc_id, size, text_crc32, old_shard, the hash by which they stand in line, and the part that wrote them."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size, crc = (F.octet_length(body) + OVERHEAD).cast("long"), F.crc32(body).cast("long")
    line = F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), size.cast("string"), crc.cast("string")))
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), old_shard.cast("int").alias("old_shard"), line.alias("line"), F.spark_partition_id().alias("part"), *keep)


def whole(documents: DataFrame) -> list[Column]:
    """What `measured` keeps so that a plan carries the documents themselves, for `rewrite_affected`."""
    return [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(DOCUMENT)]


def reshard(rows: DataFrame, n_old: int, capacities=None, shards: int = NEW_SHARDS) -> DataFrame:
    """rows (as of `measured`, a staged table) with shard and slot.

    capacities: bytes for each new shard, or a function of the total; even ones if not given.
    """
    spark = rows.sparkSession
    if n_old > MOST_SHARDS:
        raise ValueError(f"at most {MOST_SHARDS} old shards")
    supplies = [0] * n_old
    for row in rows.groupBy("old_shard").agg(F.sum("size").alias("n")).collect():  # a row a shard, at most MOST_SHARDS
        supplies[row["old_shard"]] = row["n"]
    room = capacities(sum(supplies)) if callable(capacities) else capacities or even_capacities(sum(supplies), shards)
    cuts = _stretches(supplies, room)
    lined = staged(running_start(rows, ["old_shard"], ["line"], "size", "start").drop("line", "part"), "shard-lines")
    table = spark.createDataFrame([(i, a, b, j) for i, a, b, j in cuts], "old_shard int, from long, to long, target int")
    inside = (F.col("start") >= F.col("from")) & (F.col("start") < F.col("to"))
    aimed = lined.join(F.broadcast(table), "old_shard").filter(inside)  # proven small: a row a unit of flow between shards
    across = aimed.filter(F.col("start") + F.col("size") > F.col("to")).select("old_shard", "start", "size").collect()  # at most one a cut
    load = [0] * len(room)
    for i, a, b, j in cuts:
        load[j] += b - a
    by_old: dict[int, list] = {}
    for cut in cuts:
        by_old.setdefault(cut[0], []).append(cut)
    for row in across:
        for _, a, b, j in by_old[row["old_shard"]]:
            load[j] -= max(0, min(b, row["start"] + row["size"]) - max(a, row["start"]))
    free = [(load[j] - room[j], j) for j in range(len(room))]
    heapq.heapify(free)
    placed = []
    for row in sorted(across, key=lambda r: (-r["size"], r["old_shard"], r["start"])):
        used, j = free[0]
        heapq.heapreplace(free, (used + row["size"], j))
        placed.append((row["old_shard"], row["start"], j))
    moved = spark.createDataFrame(placed, "old_shard int, start long, moved int")
    sharded = aimed.join(F.broadcast(moved), ["old_shard", "start"], "left").withColumn("shard", F.coalesce("moved", "target")).drop("from", "to", "target", "moved")
    return _slotted(sharded)


def _slotted(rows: DataFrame) -> DataFrame:
    """Adds slot: the gapless place in the shard, by old shard and start."""
    cell = ["shard", "old_shard", "_cell"]
    rows = rows.withColumn("_cell", F.floor(F.col("start") / CELL))
    counts = rows.groupBy(*cell).count()
    before = Window.partitionBy("shard").orderBy("old_shard", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("start"))
    return rows.withColumn("_place", place).join(offsets, cell).withColumn("slot", (F.col("_offset") + F.col("_place") - 1).cast("long")).drop("_offset", "_place", "_cell")


def rewrite_affected(documents: DataFrame, plan: DataFrame, path: str, doc_id: str = "doc_id") -> list[int]:
    """Writes documents of those shards whose rows change into path/shard=N, and returns their numbers.

    A shard is affected if a row enters or leaves it; the files of the others stay as they are, and the folder of one
    that is left without rows goes. path may be the layout that documents are read from, as rows are staged first.
    A plan that was measured with keep=whole(documents) carries the rows themselves; any other is joined by doc_id,
    and refused if that is null or repeated.
    """
    spark = documents.sparkSession
    change = plan.filter("shard <> old_shard")
    affected = change.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    numbers = sorted(r["shard"] for r in affected.collect())
    if not numbers:
        return numbers
    rows = plan.filter(F.col("shard").isin(numbers))
    if DOCUMENT in plan.columns:
        out = rows.select(*(F.col(DOCUMENT)[c].alias(c) for c in documents.columns if c not in ("shard", "slot")), "shard", "slot")
    else:
        if not plan.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
            raise ValueError("doc_id is null or repeated: measure with keep=whole(documents)")
        out = documents.drop("shard", "slot").join(rows.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
    out = staged(out, "shard-rewritten")
    filled = {r["shard"] for r in out.select("shard").distinct().collect()}  # a row a shard
    dealt = out.repartition("shard", F.pmod("slot", F.lit(16))).sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for number in set(numbers) - filled:  # dynamic mode leaves folders that get no row
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={number}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    discard(out)
    return numbers


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Moves a layout by hash of the source, one shard of which is hot, to 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))
    plan = reshard(staged(measured(docs, old), "shard-sizes"), OLD_SHARDS)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
