"""Mixing sources to target weights, for sources that may overlap.

1. Documents are summed by membership pattern, the set of sources they belong to.
2. A minimum-cost flow routes the patterns' tokens to the sources' quotas, for each connected set of patterns
   and sources apart; a pattern that alone serves a source alone needs no search.  A pattern's tokens
   can be used up to ``max_repeats`` times; every further part of a copy costs more than the one
   before (a convex cost), so repeats are spread over the patterns that can serve a quota.
3. A pattern that is to give r times its tokens keeps floor(r) copies of each document and one more
   copy of a seeded choice.  The choice is made within size classes (powers of two), so it has
   documents of all lengths: in each class the documents with the smallest seeded hash, up to a threshold
   that is found by descending through the hash's digits, a sum per digit at a time.  One document
   more per class, at most, settles what whole documents leave over, chosen by their sums.

The result is a small table of thresholds, a row per pattern and size class; applying it to the
documents is a map without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WorkTables
from shelfspark.llm.flow import Flow

SEED = 7_919
STEPS_PER_COPY = 4
MAX_PATTERNS = 1 << 15
DIGIT_BITS, HASH_BITS = 8, 56
CHOICES = 2048
WORDS = r"[^\x20\x09-\x0D]+"
RULE = "pattern string, size_class int, copies long, extra_until long"


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def pattern(sources: Column) -> Column:
    """The set of sources as text; ``sources`` is an array, in which null is a source like any other."""
    named = F.transform(sources, lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), x.cast("string"))))
    return F.to_json(F.array_sort(F.array_distinct(named)))


def seeded(key: Column, seed: int = SEED) -> Column:
    """A non-negative hash of the key, the order in which documents are chosen."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - HASH_BITS)


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))).cast("int")).otherwise(F.lit(-1))


def shared_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> dict[str | None, float]:
    """A target per source: weights repeat over the sources in code-point order, null last, and share
    ``percent`` of all sizes; no target exceeds ``most`` times its source, and what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    left, open_, target = percent * sum(size.values()) / 100, list(size), {}
    while open_:
        total = sum(weight[name] for name in open_)
        full = [name for name in open_ if left * weight[name] / total > most * size[name]]
        if not full:
            target |= {name: left * weight[name] / total for name in open_}
            break
        for name in full:
            target[name] = float(most * size[name])
        left -= sum(target[name] for name in full)
        open_ = [name for name in open_ if name not in full]
    return target


def plan(patterns: dict[str, int], members: dict[str, list], targets: dict, max_repeats: int) -> dict[str, int]:
    """Tokens each pattern gives: the flow from patterns (tokens, members) to the sources' targets.

    Patterns that share no source, directly or through others, are planned apart.
    """
    group: dict = {}

    def root(node):
        while group.setdefault(node, node) != node:
            group[node] = node = group[group[node]]
        return node

    for name in patterns:
        for source in members[name]:
            if source in targets:
                group[root(("source", source))] = root(("pattern", name))
    parts: dict = {}
    for name in sorted(patterns):
        parts.setdefault(root(("pattern", name)), ([], []))[0].append(name)
    for source in targets:
        if (there := parts.get(root(("source", source)))) is not None:
            there[1].append(source)
    given: dict[str, int] = {}
    for names, sources in parts.values():
        if len(names) == 1 and len(sources) <= 1:
            given[names[0]] = min(max_repeats * patterns[names[0]], max(0, round(targets[sources[0]]))) if sources else 0
        else:
            given |= _flow(names, sources, patterns, members, targets, max_repeats)
    return given


def _flow(names: list[str], sources: list, patterns: dict[str, int], members: dict[str, list], targets: dict, max_repeats: int) -> dict[str, int]:
    """The plan of one connected set of patterns and sources."""
    flow = Flow(2 + len(names) + len(sources))
    place = {source: 2 + len(names) + j for j, source in enumerate(sources)}
    taken = {}
    for i, name in enumerate(names):
        parts = max_repeats * STEPS_PER_COPY
        edges = [patterns[name] * k // STEPS_PER_COPY for k in range(parts + 1)]
        taken[name] = [flow.arc(0, 2 + i, edges[k + 1] - edges[k], (k + 1) ** 2) for k in range(parts)]
        for source in members[name]:
            if source in place:
                flow.arc(2 + i, place[source], max_repeats * patterns[name], 0)
    for source in sources:
        flow.arc(place[source], 1, round(targets[source]), 0)
    flow.run(0, 1)
    return {name: sum(flow.used(number) for number in arcs) for name, arcs in taken.items()}


@dataclass(frozen=True)
class Edge:
    """Where a stratum's choice ends: all hashes below ``low`` are in, ``size`` tokens lie from there to ``high``, ``missing`` are wanted of them."""

    low: int
    high: int
    size: int
    missing: float


def _edges(rows: DataFrame, wanted: dict[tuple[str, int], float]) -> dict[tuple[str, int], Edge]:
    """The edge of each stratum of ``rows`` (pattern, size_class, size, h) for its wanted tokens.

    Each level reads the digit sums of the bucket that holds the edge, for all strata at once, until
    one document is left in it; the driver gets one row per stratum and level.
    """
    state = {k: (0, v) for k, v in wanted.items()}
    found: dict[tuple[str, int], Edge] = {}
    shift = HASH_BITS
    while state:
        shift -= DIGIT_BITS
        table = rows.sparkSession.createDataFrame([(p, c, prefix, need) for (p, c), (prefix, need) in state.items()], "pattern string, size_class int, prefix long, need double")
        inside = rows.join(F.broadcast(table), ["pattern", "size_class"]).where(F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix"))
        digits = inside.groupBy("pattern", "size_class", "need", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("amount"), F.count("*").alias("n"))
        running = Window.partitionBy("pattern", "size_class").orderBy("bucket")
        sums = digits.withColumns({"upto": F.sum("amount").over(running), "last": F.lead("bucket").over(running).isNull()})
        first = sums.where("upto > need or last").groupBy("pattern", "size_class", "need").agg(F.min(F.struct("bucket", "amount", "n", "upto")).alias("b"))
        state = {}
        for row in first.select("pattern", "size_class", "need", "b.*").collect():
            missing = row.need - (row.upto - row.amount)
            if row.n == 1 or shift == 0:
                found[row.pattern, row.size_class] = Edge(row.bucket << shift, (row.bucket + 1) << shift, row.amount, missing)
            else:
                state[row.pattern, row.size_class] = (row.bucket, missing)
    return found


def _settle(edges: dict) -> dict:
    """Bound per stratum of one pattern: the last documents that are in come closest to what is missing in all.

    The sums of the choices are searched size by size, the largest first, keeping the ``CHOICES`` closest from below and above.
    """
    missing = sum(x.missing for x in edges.values())
    order = sorted(edges, key=lambda k: (-edges[k].size, k))
    rest = sum(edges[k].size for k in order)
    sums: list[tuple[int, tuple]] = [(0, ())]
    for k in order:
        size, rest = edges[k].size, rest - edges[k].size
        grown = dict((total, chosen) for total, chosen in reversed(sums))
        for total, chosen in sums:
            grown.setdefault(total + size, (*chosen, k))
        # A sum can still grow by ``rest`` at most, so those near [missing - rest, missing] matter.
        off = lambda total: max(0, missing - rest - total, total - missing)  # noqa: B023, E731
        sums = sorted(grown.items(), key=lambda x: (off(x[0]), abs(x[0] - missing), x[0]))[:CHOICES]
    taken = set(min(sums, key=lambda x: (abs(x[0] - missing), x[0]))[1])
    return {k: x.high if k in taken else x.low for k, x in edges.items()}


def mix(docs: DataFrame, targets: dict | None, work: WorkTables, key: str = "doc_id", sources: Column | None = None, size: Column | None = None, max_repeats: int = 2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rule, totals): which documents the mix takes how often, and (pattern, tokens, documents).

    ``sources`` is an array column (default: the column source alone), ``size`` a token count (default:
    words of the column text), ``targets`` tokens per source (default ``shared_targets``).  A source without
    documents gets nothing, an empty table an empty rule.  Documents without tokens take part in no copy
    beyond the whole ones.  Rows that repeat an id are chosen together.  Equal inputs give equal rules; other columns are not read.
    ``MAX_PATTERNS`` bounds the patterns, and so what the driver holds (a row per pattern and size class); more raise an error.
    """
    sources = F.array("source") if sources is None else sources
    size = words(F.col("text")) if size is None else size
    marked = docs.select(pattern(sources).alias("pattern"), size.alias("size"), seeded(F.col(key), seed).alias("h"))
    rows = work.cut(marked.withColumn("size_class", size_class(F.col("size"))))
    strata = rows.groupBy("pattern", "size_class").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    strata = {(r.pattern, r.size_class): (r["size"], r.n) for r in strata.limit(64 * MAX_PATTERNS + 1).collect()}
    tokens: dict[str, int] = {}
    for (name, _), (amount, _) in strata.items():
        tokens[name] = tokens.get(name, 0) + amount
    if len(tokens) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    members = {name: [None if x == "-" else x[1:] for x in json.loads(name)] for name in tokens}
    if targets is None:
        sizes: dict[str | None, int] = {}
        for name, amount in tokens.items():
            for source in members[name]:
                sizes[source] = sizes.get(source, 0) + amount
        targets = shared_targets(list(sizes.items()))
    given = plan(tokens, members, targets, max_repeats)
    whole = {name: given[name] // tokens[name] if tokens[name] else 0 for name in tokens}
    rest = {name: given[name] - whole[name] * tokens[name] for name in tokens}
    wanted = {(name, c): rest[name] * amount / tokens[name] for (name, c), (amount, _) in strata.items() if tokens[name] and amount and rest[name]}
    edges = _edges(rows, wanted)
    of_pattern: dict[str, dict] = {}
    for k, x in edges.items():
        of_pattern.setdefault(k[0], {})[k] = x
    until: dict[tuple[str, int], int] = {}
    for own in of_pattern.values():
        until |= _settle(own)
    rule = [(name, c, whole[name], until.get((name, c), 0)) for name, c in sorted(strata)]
    totals = [(name, tokens[name], given[name]) for name in sorted(tokens)]
    session = docs.sparkSession
    return session.createDataFrame(rule, RULE), session.createDataFrame(totals, "pattern string, tokens long, given long")


def copies(docs: DataFrame, rule: DataFrame, name: str, key: str = "doc_id", sources: Column | None = None, size: Column | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with a column ``name``: how often the mix takes each row.  No shuffle; the rule has at most 64 * MAX_PATTERNS rows."""
    sources = F.array("source") if sources is None else sources
    size = words(F.col("text")) if size is None else size
    own = rule.select(F.col("pattern").alias(f"{name}_p"), F.col("size_class").alias(f"{name}_c"), F.col("copies").alias(f"{name}_n"), F.col("extra_until").alias(f"{name}_u"))
    met = docs.join(F.broadcast(own), (pattern(sources) == F.col(f"{name}_p")) & (size_class(size) == F.col(f"{name}_c")))
    taken = F.col(f"{name}_n") + (seeded(F.col(key), seed) < F.col(f"{name}_u")).cast("long")
    return met.withColumn(name, taken).drop(f"{name}_p", f"{name}_c", f"{name}_n", f"{name}_u")
