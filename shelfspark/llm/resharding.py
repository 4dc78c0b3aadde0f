"""Resharding with the fewest bytes moved: a minimum-cost flow plans it, blocks carry it out.

Rows lie in old shards.  Within a shard they form ``BLOCKS`` blocks by a hash of their text, so equal texts share a
block.  A block above a quarter of a new shard is cut by a hash of the id, so that a text with a third of all rows spreads
over the shards.  From the old shards' sizes and the new capacities a flow with cost 0 for bytes that stay and 1 for
bytes that move gives how many bytes each old shard sends to each new one.  Blocks, largest first, take the transfer
with the most room left; a few more moves even out what whole blocks leave over.  The driver holds one row per block,
as many for any amount of data.

Rows are numbered and written by units, parts of blocks of about ``UNIT_ROWS`` rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WorkTables
from shelfspark.llm.flow import Flow

BLOCKS = 512
LARGEST = 4
CUT_TO = 64
UNIT_ROWS = 100_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def transfers(old: list[int], new: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one: capacities ``new`` are filled and the fewest bytes change their shard."""
    flow = Flow(2 + len(old) + len(new))
    for i, amount in enumerate(old):
        flow.arc(0, 2 + i, amount, 0)
    arcs = [[flow.arc(2 + i, 2 + len(old) + j, old[i], 0 if i == j else 1) for j in range(len(new))] for i in range(len(old))]
    for j, room in enumerate(new):
        flow.arc(2 + len(old) + j, 1, room, 0)
    flow.run(0, 1)
    return [[flow.used(number) for number in row] for row in arcs]


def capacities(total: int, shards: int) -> list[int]:
    """Near equal capacities that hold ``total``."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def assign(blocks: list[tuple[int, tuple, int]], old_shards: int, shards: int) -> list[int]:
    """New shard per (old shard, name, bytes)."""
    total = sum(size for _, _, size in blocks)
    old = [0] * old_shards
    for shard, _, size in blocks:
        old[shard] += size
    room = transfers(old, capacities(total, shards))
    out: list[int] = [0] * len(blocks)
    heaps = [[(-amount, i != j, j) for j, amount in enumerate(row)] for i, row in enumerate(room)]
    for heap in heaps:
        heapq.heapify(heap)
    order = sorted(range(len(blocks)), key=lambda b: (-blocks[b][2], blocks[b][:2]))
    for b in order:
        shard, _, size = blocks[b]
        left, moved, j = heapq.heappop(heaps[shard])
        out[b] = j
        heapq.heappush(heaps[shard], (left + size, moved, j))
    return _even(blocks, out, capacities(total, shards))


def _even(blocks: list[tuple[int, tuple, int]], out: list[int], room: list[int]) -> list[int]:
    """Moves blocks, largest first, from the fullest to the emptiest shard while that lessens their difference."""
    load, held = [0] * len(room), [[] for _ in room]
    for b, j in enumerate(out):
        load[j] += blocks[b][2]
        held[j].append((blocks[b][2], b))
    for h in held:
        h.sort()
    for _ in range(len(room) * 64):
        high, low = max(range(len(room)), key=load.__getitem__), min(range(len(room)), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [x for x in held[high] if 0 < x[0] < gap]
        if not fits:
            break
        # The move that leaves the two closest to one another.
        size, b = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[high].remove((size, b))
        held[low].append((size, b))
        load[high] -= size
        load[low] += size
        out[b] = low
    return out


@dataclass(frozen=True)
class Layout:
    """``cuts`` (old_shard, block, pieces, parts), ``units`` (old_shard, block, part, shard, first_slot, rows, bytes),
    ``moves`` the bytes from each old shard to each new one, ``affected`` the new shards that get or lose a row."""

    cuts: DataFrame
    units: DataFrame
    moves: list[list[int]]
    affected: list[int]


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "text_crc32"), F.lit(BLOCKS)).cast("int"))


def _in_units(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with their unit; ``cuts`` has at most ``BLOCKS`` rows per old shard."""
    met = rows.join(F.broadcast(cuts), ["old_shard", "block"])
    return met.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("parts")).cast("int")).withColumn("piece", F.col("part") % F.col("pieces"))


def measured(docs: DataFrame, old_shard: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as (doc_id, text, size, text_crc32, old_shard); null text has size 1 and the checksum of no bytes."""
    whole = F.col(text)
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), whole.alias("text"), size_of(whole).alias("size"), F.crc32(F.coalesce(whole, F.lit("")).cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard")
    )


def plan(rows: DataFrame, old_shards: int, shards: int, work: WorkTables) -> Layout:
    """Where every unit of ``measured`` rows goes; old shards number from 0 to ``old_shards`` - 1."""
    session = rows.sparkSession
    rows = _in_blocks(rows)
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    room = max(1, sum(b.bytes for b in blocks) // shards)
    cuts = []
    for b in blocks:
        pieces = 1 if b.bytes <= room // LARGEST else math.ceil(b.bytes * CUT_TO / room)
        cuts.append((b.old_shard, b.block, pieces, pieces * math.ceil(b.n / (pieces * UNIT_ROWS))))
    cuts = session.createDataFrame(cuts, "old_shard int, block int, pieces int, parts int")
    units = work.cut(_in_units(rows, cuts).groupBy("old_shard", "block", "piece", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    pieces = [tuple(r) for r in units.groupBy("old_shard", "block", "piece").agg(F.sum("bytes")).orderBy("old_shard", "block", "piece").collect()]
    target = assign([(shard, (block, piece), size) for shard, block, piece, size in pieces], old_shards, shards)
    moves = [[0] * shards for _ in range(old_shards)]
    for (shard, _, _, size), j in zip(pieces, target, strict=True):
        moves[shard][j] += size
    affected = [j for j in range(shards) if any(moves[i][j] for i in range(old_shards) if i != j) or (j < old_shards and any(moves[j][k] for k in range(shards) if k != j))]
    table = session.createDataFrame([(*p[:3], j) for p, j in zip(pieces, target, strict=True)], "old_shard int, block int, piece int, shard int")
    order = Window.partitionBy("shard").orderBy("old_shard", "block", "part")
    units = units.join(F.broadcast(table), ["old_shard", "block", "piece"]).withColumn("first_slot", F.sum("rows").over(order) - F.col("rows"))
    return Layout(cuts, work.cut(units.select("old_shard", "block", "part", "shard", "first_slot", "rows", "bytes")), moves, affected)


def placed(rows: DataFrame, layout: Layout) -> DataFrame:
    """``measured`` rows with shard and slot; within a unit rows are numbered by id, then checksum."""
    unit = ["old_shard", "block", "part"]
    order = Window.partitionBy(*unit).orderBy("doc_id", "text_crc32")
    met = _in_units(_in_blocks(rows), layout.cuts).join(layout.units.select(*unit, "shard", "first_slot"), unit)
    slot = F.col("first_slot") + F.row_number().over(order) - 1
    return met.withColumn("slot", slot).select("doc_id", "text", "size", "text_crc32", "old_shard", "shard", "slot")


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, folder: str, work: WorkTables, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Layout]:
    """(rows, layout): rewrites the shards that get or lose rows below ``folder`` as shard=N/ and gives
    (doc_id, size, text_crc32, old_shard, shard, slot) of all rows.

    Every new shard gets near the same number of bytes (UTF-8 bytes of the text plus 1 a row) and the fewest bytes change their shard;
    slots number a shard's rows from 0 without gaps.  Equal texts share a shard unless their block exceeds a quarter
    of one.  Shards that nothing enters or leaves are not written, and their rows come from the plan.  Nulls: a null text is
    an empty one, a null id an id like any other.  Repeated rows get a slot each.  An empty table writes nothing.
    """
    rows = measured(docs, old_shard, key, text)
    layout = plan(rows, old_shards, shards, work)
    final = placed(rows, layout)
    inside = F.col("shard").isin(layout.affected)
    final.where(inside).write.partitionBy("shard").parquet(folder)
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    schema = final.select("doc_id", "text", "size", "text_crc32", "old_shard", "slot", "shard").schema
    written = docs.sparkSession.read.schema(schema).parquet(folder).select(columns)
    if len(layout.affected) == shards:
        return written, layout
    return written.unionByName(placed(rows, layout).where(~inside).select(columns)), layout
