"""Exact dedup against a minimal perfect hash over the digests seen before.

Texts are equal when identical after deleting every white-space character; each row becomes the
SHA-256 of that normal form.  The history's distinct digests are dealt by prefix into shards of
bounded size, and every shard gets its own minimal perfect hash: keys fall into buckets of about
four, and the buckets, largest first, look for a seed that sends all their keys to free slots, so
n keys fill slots 0 to n-1 (hash and displace, Belazzougui et al., 2009).  A slot holds the full
digest and where the winner is.  A perfect hash sends foreign keys to some slot too, so every
lookup compares all 32 bytes: a digest that matches is a repeat of the slot's class, any other is
new and groups with its equals alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, WorkTables, mix64

KEYS_PER_SHARD = 200_000
BUCKET_KEYS = 4
MAX_SEED = 1 << 32
# A slot: the full digest, then where the winner is and how good it is.
DIGEST = 32
LOCATOR = np.dtype([("points", "<i8"), ("doc", "<i8"), ("rows", "<i8"), ("unnamed", "?")])
INDEX = "shard int, keys int, seeds binary, slots binary"


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, points) per row of ``docs``: SHA-256 of the normal form, code points of the original."""
    whole = F.coalesce(F.col(text), F.lit(""))
    normal = F.translate(whole, SPACES, "")
    return docs.select(
        F.col(key).cast("long").alias("doc"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
        F.length(whole).cast("long").alias("points"),
    )


def _rank(points: Column, doc: Column) -> Column:
    """Orders rows of a class: more code points first, then the smaller id; a null id comes last."""
    return F.struct((-points).alias("fewer"), doc.isNull().alias("unnamed"), F.coalesce(doc, F.lit(0)).alias("doc"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, rows, best) per distinct digest: minima and counts, reduced where the rows are read."""
    return rows.groupBy("digest").agg(F.count("*").alias("rows"), F.min(_rank(F.col("points"), F.col("doc"))).alias("best"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of 32-byte digests; their bytes are uniform already."""
    words = np.frombuffer(keys.tobytes(), "<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2].copy()


def _slots_of(spread: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix64(spread ^ mix64(seeds + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed per bucket, slot per key) of a minimal perfect hash over distinct 32-byte keys."""
    n = len(keys)
    buckets = max(1, math.ceil(n / BUCKET_KEYS))
    spread_bucket, spread = _hashes(keys)
    bucket = (spread_bucket % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    seeds, slots, free = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = order[starts[b] : starts[b] + sizes[b]]
        # Buckets of several keys try a block of seeds at once; the last single keys need many tries.
        first, block = 0, 16 if sizes[b] > 1 else 64
        while first < MAX_SEED:
            tries = np.arange(first, first + block, dtype=np.uint64)
            places = _slots_of(spread[own][None, :], tries[:, None], n)
            good = free[places].all(axis=1)
            if sizes[b] > 1:
                ordered = np.sort(places, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[b], slots[own] = tries[hit[0]], places[hit[0]]
                free[places[hit[0]]] = False
                break
            first, block = first + block, min(block * 4, 1 << 16)
        else:
            raise ValueError("two keys of a shard are equal")
    return seeds, slots


def look_up(keys: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """The slot of each key; a key outside the set lands on an arbitrary slot."""
    spread_bucket, spread = _hashes(keys)
    bucket = (spread_bucket % np.uint64(len(seeds))).astype(np.int64)
    return _slots_of(spread, seeds[bucket].astype(np.uint64), n)


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    fixed = column.cast(pa.binary(32)).combine_chunks()
    fixed = fixed.chunk(0) if isinstance(fixed, pa.ChunkedArray) else fixed
    return np.frombuffer(fixed.buffers()[1], "V32", len(fixed), fixed.offset * 32)


def _bytes(records: np.ndarray) -> np.ndarray:
    return np.frombuffer(records.tobytes(), np.uint8).reshape(len(records), -1)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The sharded perfect hash over ``history`` (digest, rows, best): one row per shard with its arrays."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = _keys(table["digest"])
        seeds, slots = perfect_hash(keys)
        locators = np.empty(len(keys), LOCATOR)
        for name in LOCATOR.names:
            locators[name][slots] = table[name].to_numpy()
        stored = np.empty((len(keys), DIGEST + LOCATOR.itemsize), np.uint8)
        stored[slots, :DIGEST] = _bytes(keys)
        stored[:, DIGEST:] = _bytes(locators)
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "keys": pa.array([len(keys)], pa.int32()),
                "seeds": pa.array([seeds.tobytes()], pa.binary()),
                "slots": pa.array([stored.tobytes()], pa.binary()),
            }
        )

    flat = history.select(_shard(shards), "digest", (-F.col("best.fewer")).alias("points"), "best.unnamed", "best.doc", "rows")
    return flat.groupBy("shard").applyInArrow(build, INDEX)


def against_index(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Classes of ``incoming`` (digest, rows, best) with what the index knows of them.

    Each distinct digest is looked up once, in the shard it belongs to; the result has for each
    the ``known`` row (null for nonmembers) after comparing all bytes.
    """
    out = "digest binary, rows long, points long, unnamed boolean, doc long, known_rows long, known_points long, known_unnamed boolean, known_doc long"

    def probe(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        known, found = np.zeros(left.num_rows, bool), np.zeros(left.num_rows, LOCATOR)
        if left.num_rows and right.num_rows:
            keys = _keys(left["digest"])
            n, seeds = right["keys"][0].as_py(), np.frombuffer(right["seeds"][0].as_py(), np.uint32)
            stored = np.frombuffer(right["slots"][0].as_py(), np.uint8).reshape(n, -1)[look_up(keys, n, seeds)]
            known = (stored[:, :DIGEST] == _bytes(keys)).all(axis=1)
            found = np.frombuffer(stored[:, DIGEST:].tobytes(), LOCATOR)
        columns = {name: left[name] for name in ("digest", "rows", "points", "unnamed", "doc")}
        for name in ("rows", "points", "unnamed", "doc"):
            columns[f"known_{name}"] = pa.array(found[name], mask=~known)
        return pa.table(columns)

    flat = incoming.select(_shard(shards), "digest", "rows", (-F.col("best.fewer")).alias("points"), "best.unnamed", "best.doc")
    return flat.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, out)


def classes(rows: DataFrame, in_history: Column, work: WorkTables) -> DataFrame:
    """(digest, keep_id, rows) per distinct digest of ``rows`` (doc, digest, points).

    Rows where ``in_history`` holds count as seen before: their distinct digests make the perfect
    hash.  The others are looked up; members join the class in their slot, whose winner changes if
    the incoming row is better, and nonmembers form classes of their own.
    """
    history, incoming = winners(rows.where(in_history)), winners(rows.where(~in_history))
    history = work.cut(history)
    shards = max(1, math.ceil(history.count() / KEYS_PER_SHARD))
    index = work.cut(build_index(history, shards))
    looked = work.cut(against_index(incoming, index, shards))

    def rank(prefix: str = "") -> Column:
        place = F.struct((-F.col(f"{prefix}points")).alias("fewer"), F.col(f"{prefix}unnamed").alias("unnamed"), F.col(f"{prefix}doc").alias("doc"))
        return F.when(F.col(f"{prefix}points").isNotNull(), place)

    met = looked.select("digest", (F.col("rows") + F.coalesce("known_rows", F.lit(0))).alias("rows"), F.least(rank(), rank("known_")).alias("best"))
    unmet = history.join(looked.where("known_rows is not null").select("digest"), "digest", "left_anti").select("digest", "rows", "best")
    return met.unionByName(unmet).select("digest", "rows", F.when(~F.col("best.unnamed"), F.col("best.doc")).alias("keep_id"))


def dedup(docs: DataFrame, work: WorkTables, key: str = "doc_id", text: str = "text", in_history: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``, dropped rows too.

    ``in_history`` tells, from the columns doc, digest and points, which rows were there before; by
    default the rows with an even hash of their id.  The classes do not depend on the choice.  Null text counts as empty, so all empty,
    blank and null texts are one class.  A null id ranks last in its class; a row is kept when its
    id is its class's ``keep_id``, so rows that repeat an id within a class share its fate, and a
    class without any id keeps its rows.  No rows give no rows; other columns are not read.
    """
    rows = work.cut(digests(docs, key, text))
    before = (F.pmod(F.xxhash64("doc"), F.lit(2)) == 0) if in_history is None else in_history
    table = classes(rows, before, work)
    return rows.join(table, "digest").select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        F.col("rows").alias("group_size"),
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_winners(docs: DataFrame, work: WorkTables, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    Rows are found again by id and digest, so null ids and ids that repeat with other texts do no harm; of rows that
    repeat both, the one with the most code points stays.
    """
    id_name, digest, rows, place = (f"__dedup_{name}" for name in ("id", "digest", "rows", "place"))
    kept = dedup(docs, work, key, text).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias(rows))
    kept = work.cut(kept.select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(f"{digest}_kept"), rows))
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn(digest, F.sha2(F.translate(whole, SPACES, "").cast("binary"), 256))
    met = marked.join(kept, F.col(key).cast("long").eqNullSafe(F.col(id_name)) & (F.col(digest) == F.col(f"{digest}_kept")))
    columns = [F.col(f"`{name}`") for name in docs.columns]
    single = met.where(F.col(rows) == 1).select(columns)
    if kept.where(F.col(rows) > 1).isEmpty():
        return single
    order = Window.partitionBy(key, digest).orderBy(F.length(whole).desc())
    return single.union(met.where(F.col(rows) > 1).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(columns))
