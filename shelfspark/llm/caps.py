"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction on the sphere; a vector belongs to it when their inner product exceeds a
threshold, that is, when it lies in the direction's cap.  Vectors that are close lie in a common cap
far more often than others.  The directions are a random product code (Becker, Ducas, Gama, Laarhoven,
2016): coordinates are rotated by random signs and a Hadamard transform and cut into parts, each part has a
few random codewords, and every combination of codewords is a direction.  Directions of one code resemble
each other, so there are several codes with rotations of their own.  A vector's filters are
list-decoded: part by part, keeping only what can still reach the threshold, so the number of
directions may far exceed the work.

The plan fits the caps to the number of vectors: a cap holds about ``PER_CAP`` of unrelated
vectors, and there are so many that a pair at the limit shares ``SHARED`` of them on average, both by the exact law
of inner products on the sphere.  The work
so grows with the vectors, not with their square.  All pairs within a cap are verified in double
precision.  A link may be met in several caps; it counts in the first of them only.  Equal vectors
collapse to one first.  A cap with more than ``BLOCK`` members is cut into blocks, and pairs of blocks are
verified in separate tasks; tasks return counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import WorkTables
from shelfspark.llm.components import components

COSINE = 0.95
PER_CAP = 256
SHARED = 24.0
CODES = 8
# Directions of three parts resemble each other more, so their number is spread over more codes.
MANY_CODES = 64
# Shorter vectors are padded with zeros; in few dimensions no direction would exceed the threshold.
LEAST_DIMENSIONS = 64
MOST_DEVIATIONS = 40
MOST_CODEWORDS = 2048
BLOCK = 2048
DECODED_AT_ONCE = 128
COLUMNS = 1024
SEED = 31_337


def padded(dimensions: int) -> int:
    return max(LEAST_DIMENSIONS, 1 << (dimensions - 1).bit_length())


def _law(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner products of unit vectors with a random direction, in standard deviations: grid, density, tail.

    The law on the sphere, not its Gaussian limit: in 64 dimensions the two differ tenfold where caps are small.
    """
    grid = np.linspace(0, min(math.sqrt(dimensions), MOST_DEVIATIONS), 1 << 16)
    density = np.maximum(0, 1 - grid * grid / dimensions) ** ((dimensions - 3) / 2)
    beyond = np.cumsum(density[::-1])[::-1]
    return grid, density / beyond[0] / 2, beyond / beyond[0] / 2


@dataclass(frozen=True)
class CapPlan:
    """``threshold`` in standard deviations of a random inner product; ``codewords`` per part of each of ``codes``."""

    threshold: float
    parts: int
    codewords: int
    codes: int


def plan_caps(vectors: int, cosine: float = COSINE, dimensions: int = LEAST_DIMENSIONS) -> CapPlan:
    """Caps for so many vectors of ``dimensions``: their height from ``PER_CAP``, their number from ``SHARED``."""
    size = padded(dimensions)
    share = min(0.02, PER_CAP / max(1, vectors))
    grid, density, tail = _law(size)
    low = int(np.searchsorted(-tail, -share))
    u, threshold = grid[low:-1] / math.sqrt(size), grid[low] / math.sqrt(size)
    # Given one inner product, the other depends on a random direction with one dimension less.
    rest = np.sqrt(max(1e-12, 1 - cosine * cosine) * (1 - u * u))
    needed = (threshold - cosine * u) / rest * math.sqrt(size - 1)
    others, _, other = _law(size - 1)
    exceeds = np.interp(np.abs(needed), others, other, right=0.0)
    both = float(density[low:-1] @ np.where(needed > 0, exceeds, 1 - exceeds))
    codes, parts = CODES, 2
    while (SHARED / both / codes) ** (1 / parts) > MOST_CODEWORDS:
        codes, parts = MANY_CODES, parts + 1
    return CapPlan(float(grid[low]), parts, math.ceil((SHARED / both / codes) ** (1 / parts)), codes)


@lru_cache(maxsize=MANY_CODES)
def _code(dimensions: int, code: int, plan: CapPlan) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Random signs for the padded coordinates, and the codewords of each part, scaled to a unit direction."""
    size = padded(dimensions)
    random = np.random.Generator(np.random.Philox(key=[SEED + code, dimensions]))
    signs = random.integers(0, 2, size) * 2.0 - 1
    edges = np.linspace(0, size, plan.parts + 1).astype(int)
    words = []
    for k in range(plan.parts):
        word = random.standard_normal((edges[k + 1] - edges[k], plan.codewords))
        words.append(word / np.sqrt((word**2).sum(axis=0)) / math.sqrt(plan.parts))
    return signs, tuple(words)


def _rotated(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Random signs, then a Hadamard transform: an orthogonal map that spreads every coordinate."""
    out = np.zeros((len(vectors), len(signs)))
    out[:, : vectors.shape[1]] = vectors
    out *= signs
    width = 1
    while width < len(signs):
        out = out.reshape(len(vectors), -1, 2, width)
        out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], axis=2)
        width *= 2
    return out.reshape(len(vectors), -1) / math.sqrt(len(signs))


def decode_caps(vectors: np.ndarray, plan: CapPlan) -> list[np.ndarray]:
    """The filters of each unit vector, ascending: all directions of all codes that exceed the threshold."""
    of_all, names_all = [], []
    for code in range(plan.codes):
        signs, words = _code(vectors.shape[1], code, plan)
        turned, scores, at = _rotated(vectors, signs), [], 0
        for word in words:
            scores.append(turned[:, at : at + len(word)] @ word)
            at += len(word)
        limit = plan.threshold / math.sqrt(len(signs))
        best = [s.max(axis=1) for s in scores]
        rest = sum(best)
        of, names, sums = np.arange(len(vectors)), np.full(len(vectors), code, np.int64), np.zeros(len(vectors))
        for s, b in zip(scores, best, strict=True):
            rest = rest - b
            reach = sums[:, None] + s[of]
            row, column = np.nonzero(reach + rest[of][:, None] >= limit)
            of, names, sums = of[row], names[row] * plan.codewords + column, reach[row, column]
        of_all.append(of)
        names_all.append(names)
    of, names = np.concatenate(of_all), np.concatenate(names_all)
    order = np.lexsort((names, of))
    return np.split(names[order], np.searchsorted(of[order], np.arange(1, len(vectors))))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that nothing overflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _met_before(a: list[np.ndarray], b: list[np.ndarray], cap: int) -> np.ndarray:
    """Which pairs of rows share a filter smaller than ``cap``."""
    before = np.zeros((len(a), len(b)), bool)
    sides = []
    for lists in (a, b):
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists)
        sides.append((of[flat < cap], flat[flat < cap]))
    common = np.intersect1d(sides[0][1], sides[1][1])
    for start in range(0, len(common), COLUMNS):
        names = common[start : start + COLUMNS]
        marks = []
        for (of, flat), lists in zip(sides, (a, b), strict=True):
            inside = np.isin(flat, names)
            mark = np.zeros((len(lists), len(names)), np.float32)
            mark[of[inside], np.searchsorted(names, flat[inside])] = 1
            marks.append(mark)
        before |= marks[0] @ marks[1].T > 0
    return before


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row it can reach through a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


MEMBERS = "cap long, dim int, first int, second int, vec long, weight long, part int, vector array<double>, caps array<long>"


def _verify(cosine: float):
    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cap = key[0].as_py()
        ids, weight, part = (table[name].to_numpy() for name in ("vec", "weight", "part"))
        order = np.lexsort((ids, part))
        ids, weight, part = ids[order], weight[order], part[order]
        vectors = unit(_matrix(table["vector"]))[order]
        caps = [np.asarray(x) for x in table["caps"].to_numpy()]
        caps = [caps[i] for i in order]
        first, second = key[2].as_py(), key[3].as_py()
        a = np.flatnonzero(part == first)
        b = a if first == second else np.flatnonzero(part == second)
        near = vectors[a] @ vectors[b].T >= cosine
        if first == second:
            np.fill_diagonal(near, False)
        counted = near
        if near.any():
            counted = near & ~_met_before([caps[i] for i in a], [caps[i] for i in b], cap)
        counts = np.zeros(len(ids), np.int64)
        counts[a] += counted @ weight[b]
        if first != second:
            counts[b] += counted.T @ weight[a]
        linked = np.zeros((len(ids), len(ids)), bool)
        linked[np.ix_(a, b)] = near
        root = _forest(linked | linked.T)
        some = linked.any(axis=1) | linked.any(axis=0)
        return pa.table({"vec": pa.array(ids[some]), "links": pa.array(counts[some]), "root": pa.array(ids[root[some]])})

    return links


def near_duplicates(rows: DataFrame, work: WorkTables, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows``.

    Two vectors link when they are found with a cosine of at least ``cosine``; none below it link.  Vectors that are
    null, empty, zero or hold a null or a component that is not finite link with nothing, and neither do vectors of
    different lengths; each is its own component.  Rows with equal vectors link with one another.  The join runs on
    distinct vectors, so a row without an id links like any other; it never names a component, which is null where no row has
    an id.  Rows that repeat an id are rows of their own.  No rows give no rows; other columns are not read.
    """
    given = work.cut(rows.select(F.col(key).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("vector")))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = finite & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    distinct = given.where(usable).groupBy("vector").agg(F.min("vec").alias("rep"), F.count("*").alias("weight"))
    distinct = work.cut(distinct.withColumn("vec", F.monotonically_increasing_id()))
    vectors, most = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    sizes = [1 << k for k in range(padded(most).bit_length())]
    plans = {size: plan_caps(vectors, cosine, size) for size in sizes if size >= LEAST_DIMENSIONS}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            dims = vectors.value_lengths().to_numpy()
            caps: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for start in range(0, len(at), DECODED_AT_ONCE):
                    some = at[start : start + DECODED_AT_ONCE]
                    for i, found in zip(some, decode_caps(unit(_matrix(vectors.take(pa.array(some)))), plans[padded(int(dim))]), strict=True):
                        caps[i] = found
            yield pa.RecordBatch.from_pydict({"vec": batch.column(1), "weight": batch.column(2), "dim": pa.array(dims, pa.int32()), "vector": vectors, "caps": pa.array(caps, pa.list_(pa.int64()))})

    decoded = work.cut(distinct.select("vector", "vec", "weight").mapInArrow(decode, "vec long, weight long, dim int, vector array<double>, caps array<long>"))
    entries = decoded.select("vec", "weight", "dim", "vector", "caps", F.explode("caps").alias("cap"))
    sizes = decoded.select("dim", F.explode("caps").alias("cap")).groupBy("dim", "cap").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("dim", "cap", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = entries.join(sizes, ["dim", "cap"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    paired = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = paired.select("cap", "dim", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "vec", "weight", "part", "vector", "caps")
    met = members.groupBy("cap", "dim", "first", "second").applyInArrow(_verify(cosine), "vec long, links long, root long")
    met = work.cut(met)
    counts = met.groupBy("vec").agg(F.sum("links").alias("links"))
    label = components(met.where("vec != root").select("vec", "root").distinct(), work)

    linked = distinct.join(label, F.col("vec") == F.col("node"), "left").withColumn("component", F.coalesce("component", "vec"))
    named = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = linked.join(counts, "vec", "left").join(named, "component").select(
        F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"
    )
    met = given.withColumn("usable", usable).join(whole, F.when(F.col("usable"), F.col("vector")) == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec")).otherwise(F.col("component_id"))
    return met.select(F.col("vec").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))
