"""Minimum-cost-flow resharding.

Rows of each old shard are dealt into hash blocks of their id.  One aggregation
gives the blocks' bytes and rows; the number of blocks is ``old shards * blocks``
at most, whatever the corpus.  On the driver, a minimum-cost flow from old shard
sizes to new capacities (staying is free, moving costs its bytes) says how many
bytes go from each old shard to each new one; whole blocks then fill these
transfers, largest first.  The block assignment is joined back by broadcast, whose
size the number of blocks bounds.  Slots are counted inside a block and offset by
the blocks before it, so no task ever holds a whole shard.

Defined results: null text has no bytes and size 1 (crc32 of the empty text); rows
that repeat a doc_id each get a slot of their own; a null doc_id goes to one block
like any other value; a null old shard counts as shard 0; an empty table gives an
empty result.  Clashing column names do no harm: own columns start with ``_rs_``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

SHARDS = 8
BLOCKS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from each supply to each capacity of least total cost, by successive
    shortest paths with potentials.  Needs sum(supply) <= sum(capacity)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        dist: list[float] = [float("inf")] * (n + m + 2)
        dist[source], came, heap = 0, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (e := d + price + potential[a] - potential[b]) < dist[b]:
                    dist[b], came[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        if dist[sink] == float("inf"):
            raise ValueError("the new capacities cannot hold the old shards")
        for v, d in enumerate(dist):
            if d < float("inf"):
                potential[v] += int(d)
        push, v = left, sink
        while v != source:
            a, k = came[v]
            push, v = min(push, graph[a][k][1]), a
        v = sink
        while v != source:
            a, k = came[v]
            graph[a][k][1] -= push
            graph[v][graph[a][k][3]][1] += push
            v = a
        left -= push
    return [[graph[n + j][next(k for k, e in enumerate(graph[n + j]) if e[0] == i)][1] for j in range(m)] for i in range(n)]


@dataclass(frozen=True)
class Plan:
    """transfers: bytes by (old, new); blocks: (old, block) -> (new, slot offset);
    moved and least: bytes that move by blocks, and by the flow."""

    transfers: list[list[int]]
    blocks: list[tuple[int, int, int, int]]
    moved: int
    least: int


def plan_blocks(sizes: list[tuple[int, int, int, int]], old_shards: int, capacity: list[int]) -> Plan:
    """``sizes``: (old, block, bytes, rows).  Whole blocks fill the flow's transfers,
    largest first, each into the transfer of its shard with most room."""
    supply = [0] * old_shards
    for old, _, size, _ in sizes:
        supply[old] += size
    cost = [[0 if i == j else 1 for j in range(len(capacity))] for i in range(old_shards)]
    flow = min_cost_flow(supply, capacity, cost)
    room = [list(map(float, row)) for row in flow]
    short = list(map(float, capacity))
    assigned: list[tuple[int, int, int]] = []
    moved = 0
    rows_of = {}
    # The largest blocks first, so that the smallest settle what is left.
    for old, block, size, rows in sorted(sizes, key=lambda x: (-x[2], x[0], x[1])):
        # Within the shard's own transfers first; what none has room for, where most is left.
        best = max(range(len(capacity)), key=lambda j: (room[old][j] >= size, room[old][j] if room[old][j] >= size else short[j], j == old, -j))
        room[old][best] -= size
        short[best] -= size
        moved += size * (best != old)
        assigned.append((old, block, best))
        rows_of[old, block] = rows
    offset = [0] * len(capacity)
    blocks = []
    for old, block, new in sorted(assigned):
        blocks.append((old, block, new, offset[new]))
        offset[new] += rows_of[old, block]
    least = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
    return Plan(flow, blocks, moved, least)


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def text_size(text: str) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def reshard(docs: DataFrame, *, old_shard: Column, old_shards: int, capacities: list[int] | None = None, shards: int = SHARDS, blocks: int = BLOCKS, doc_id: str = "doc_id", size: Column | None = None) -> tuple[DataFrame, Plan]:
    """``docs`` with _rs_old, _rs_size, _rs_shard and _rs_slot, and the plan.

    ``capacities`` are bytes by new shard (default: equal shares); they must hold
    all rows.  ``old_shard`` is an integer column in [0, old_shards).  ``size`` is
    the bytes of a row (default: of column ``text``, plus one).
    """
    spark = docs.sparkSession
    size = text_size("text") if size is None else size
    base = docs.withColumns({
        "_rs_old": F.coalesce(old_shard.cast("int"), F.lit(0)),
        "_rs_size": size,
    }).withColumn("_rs_block", F.pmod(F.xxhash64(F.col(doc_id)), F.lit(blocks)).cast("int"))
    sizes = base.groupBy("_rs_old", "_rs_block").agg(F.sum("_rs_size").alias("bytes"), F.count("*").alias("rows"))
    # At most old_shards * blocks rows.
    found = [(r["_rs_old"], r["_rs_block"], r["bytes"], r["rows"]) for r in sizes.collect()]
    capacities = capacities or equal_capacities(sum(x[2] for x in found), shards)
    plan = plan_blocks(found, old_shards, capacities)
    where = spark.createDataFrame(plan.blocks, "_rs_old int, _rs_block int, _rs_shard int, _rs_offset long")
    placed = base.join(F.broadcast(where), ["_rs_old", "_rs_block"])
    order = Window.partitionBy("_rs_old", "_rs_block").orderBy(F.col(doc_id), "_rs_size")
    return placed.withColumn("_rs_slot", F.col("_rs_offset") + F.row_number().over(order) - 1).drop("_rs_offset"), plan


def rewrite_affected(docs: DataFrame, path: str, *, old_shard: Column, old_shards: int, capacities: list[int] | None = None, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Write the new shards that gain or lose rows under ``path`` as
    ``shard=<n>/`` Parquet folders, and return {"rewritten", "kept", "moved_bytes",
    "least_bytes"}.  Shards that no transfer touches are not written: their old
    files hold.  The rows are written once, in one job."""
    placed, plan = reshard(docs, old_shard=old_shard, old_shards=old_shards, capacities=capacities, shards=shards, doc_id=doc_id, size=text_size(text))
    touched = sorted({s for old, _, new, _ in plan.blocks if old != new for s in (old, new)})
    new = [s for s in touched if s < shards]
    out = placed.filter(F.col("_rs_shard").isin(new)).withColumn("shard", F.col("_rs_shard")).select("shard", *docs.columns)
    out.write.mode("errorifexists").partitionBy("shard").parquet(path)
    return {"rewritten": new, "kept": sorted(set(range(shards)) - set(new)), "moved_bytes": plan.moved, "least_bytes": plan.least}


def op6_mincostflow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The old layout is eight shards by a hash of ``source``, which a hot source makes
    uneven; the new capacities are equal, so law ``bytes`` holds.
    """
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    # The texts are read once; what follows works on a few bytes a row.
    narrow = materialize(docs.select("doc_id", "source", text_size("text").alias("size"), crc.alias("text_crc32")), "reshard-sizes")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(SHARDS))
    placed, _ = reshard(narrow, old_shard=old, old_shards=SHARDS, size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_rs_shard").alias("shard"), F.col("_rs_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
