"""Near-duplicate documents: an exact Jaccard join on word 5-grams by token-combination prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes.  All shingles share one
order: by how often their hash bucket occurs in the whole corpus, then by hash, so the first
tokens of a set are its rarest.  Sets that reach similarity 0.8 must share tokens near the front.
Tokens fall into two classes by their bucket's count:

* rare tokens are indexed singly.  A set of n shingles loses at most n // 5 of them to a partner,
  so n // 5 + 1 rare tokens suffice.
* where rare tokens run out, the prefix extends into the frequent class and indexes 2-token
  combinations: each frequent token with its successor among the set's frequent tokens.  A token
  the partner lacks breaks at most two such pairs, one that only the partner has breaks one, so
  the prefix grows until its signatures outnumber what any partner above the threshold can break.
  Sets of at most ``SMALL`` shingles, too short for pairs, also index single frequent tokens.

Sets that agree in a signature are candidates.  Length and position refute many, and so does a parity
sketch: every token flips one of ``PARITY`` bits, so two sketches differ in no more bits than the sets
differ in tokens.  Sets of more than ``PARITY`` shingles saturate that sketch and have a finer one of about a bit per
shingle, joined to their candidate pairs only.  The others are verified on their full sets.

Equal sets collapse to one representative first.  To find components exactly without verifying all pairs of
a large group, candidates meet in rounds, and pairs whose ends are connected by then are left out: first each
document with one of its signatures' smallest members, the one it shares most signatures with; then with the other
smallest members; then all members of the signatures that still hold several components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import SKETCH, Bitmap, WorkTables, bitmap, bucket_of, gather_buckets, mix64, sparse_chunks
from shelfspark.llm.components import components

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
SMALL = 20
PARITY = 512
MAX_CACHED_WORDS = 50_000
# Rows a task turns into sets or signatures at once.
BLOCK_ROWS = 1000
MULTIPLIERS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when full, so its size has a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased; fewer than five words count as one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(word) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += word[k : k + n] * MULTIPLIERS[k]
    return np.unique(mix64(total))


def _frequent_needed(n: int, rare: int) -> int:
    """How many frequent tokens the prefix of a set with too few rare ones must hold."""
    missing = np.arange(rare, n // 5 + 1)
    return int((2 * (missing - rare) + (n - 5 * missing) // 4).max()) + 2


def signatures(shingles: np.ndarray, counts: np.ndarray, frequent_from: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, position of each in the set's global order)."""
    n = len(shingles)
    often = counts[bucket_of(shingles, bits)]
    order = np.lexsort((shingles, often))
    tokens, rare = shingles[order], int((often < frequent_from).sum())
    single = n // 5 + 1
    if rare >= single:
        return tokens[:single], np.arange(single)
    parts, places = [tokens[:rare]], [np.arange(rare)]
    run = tokens[rare : rare + _frequent_needed(n, rare)]
    parts.append(mix64(run[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(run[1:])))
    places.append(rare + np.arange(max(0, len(run) - 1)))
    if n <= SMALL:
        parts.append(tokens[rare:single])
        places.append(np.arange(rare, single))
    return np.concatenate(parts), np.concatenate(places)


def parity(shingles: np.ndarray, width: int = PARITY) -> np.ndarray:
    """The parity sketch of ``width`` bits, a power of two, as 64-bit integers."""
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def fine_parity(shingles: np.ndarray) -> np.ndarray | None:
    """The sketch of a set too large for ``PARITY`` bits: the least power of two that has a bit per shingle."""
    return parity(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > PARITY else None


def set_key(shingles: np.ndarray) -> bytes | None:
    """A digest that tells sets apart; the empty set has none."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length, so that what is made of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(start, BLOCK_ROWS)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        yield doc.as_py(), text.as_py()


def _read_sets(docs: DataFrame, bits: int) -> DataFrame:
    """One row per document (doc, text_hash, n, set_key), and per task the counts of its shingles' buckets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << bits, np.uint32)
        for batch in _blocks(batches):
            ids, sizes, keys = [], [], []
            for doc, text in _texts(batch):
                found = shingle_set(text, hashes)
                np.add.at(counts, bucket_of(found, bits), 1)
                ids.append(doc)
                sizes.append(len(found))
                keys.append(set_key(found))
            yield _rows(ids, batch.column(2), sizes, keys)
        chunks = list(sparse_chunks(counts))
        if chunks:
            none = [None] * len(chunks)
            yield _rows(none, pa.nulls(len(chunks), pa.int64()), none, none, chunks)

    def _rows(ids, hashed, sizes, keys, chunks=()) -> pa.RecordBatch:
        chunks = chunks or [(None, None, None)] * len(ids)
        return pa.RecordBatch.from_pydict(
            {
                "doc": pa.array(ids, pa.int64()),
                "text_hash": hashed,
                "n": pa.array(sizes, pa.int64()),
                "set_key": pa.array(keys, pa.binary()),
                "chunk": pa.array([c[0] for c in chunks], pa.int32()),
                "places": pa.array([c[1] for c in chunks], pa.binary()),
                "amounts": pa.array([c[2] for c in chunks], pa.binary()),
            }
        )

    return docs.mapInArrow(read, f"doc long, text_hash long, n long, set_key binary, {SKETCH}")


def _signature_rows(docs: DataFrame, counts: np.ndarray, frequent_from: int, sketch_bits: int) -> DataFrame:
    """(doc, set_key, n, sigs, places, bits, fine) per document with words; fine is null for sets of up to ``PARITY`` shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _blocks(batches):
            ids, keys, sizes, sigs, places, bits, fine = [], [], [], [], [], [], []
            for doc, text in _texts(batch):
                found = shingle_set(text, hashes)
                if not len(found):
                    continue
                keys.append(set_key(found))
                bits.append(parity(found))
                fine.append(fine_parity(found))
                own, at = signatures(found, shared.value, frequent_from, sketch_bits)
                ids.append(doc)
                sizes.append(len(found))
                sigs.append(own.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": pa.array(ids, pa.int64()),
                    "set_key": pa.array(keys, pa.binary()),
                    "n": pa.array(sizes, pa.int32()),
                    "sigs": pa.array(sigs, pa.list_(pa.int64())),
                    "places": pa.array(places, pa.list_(pa.int32())),
                    "bits": pa.array(bits, pa.list_(pa.int64())),
                    "fine": pa.array(fine, pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(sign, "doc long, set_key binary, n int, sigs array<long>, places array<int>, bits array<long>, fine array<long>")


def _only_marked(rows: DataFrame, marks: Bitmap) -> DataFrame:
    """Signature rows without the signatures whose bucket is clear, exploded to (sig, place, doc, n)."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            sigs, places = batch.column(2), batch.column(3)
            of = sigs.value_parent_indices().to_numpy()
            flat = sigs.flatten().to_numpy()
            keep = shared.value.test(flat.view(np.uint64))
            of = of[keep]
            yield pa.RecordBatch.from_pydict(
                {
                    "sig": pa.array(flat[keep], pa.int64()),
                    "place": pa.array(places.flatten().to_numpy()[keep], pa.int32()),
                    "doc": batch.column(0).take(pa.array(of)),
                    "n": batch.column(1).take(pa.array(of)),
                }
            )

    return rows.select("doc", "n", "sigs", "places").mapInArrow(prune, "sig long, place int, doc long, n int")


def _sets_of(docs: DataFrame, wanted: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, shingles) of the nodes in ``wanted``, read from their first rows.

    A bitmap of fixed size spares reading most other rows' words.
    """
    rows = first.join(wanted.toDF("node"), "node", "left_semi").select("node", F.col("rep").alias("doc"), "set_key")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(rows.select("doc")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in _blocks(batches):
            unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            near = unnamed | shared.value.test(batch.column(0).fill_null(0).to_numpy().view(np.uint64))
            ids, keys, sets = [], [], []
            for doc, text in _texts(batch.filter(pa.array(near))):
                found = shingle_set(text, hashes)
                if len(found):
                    ids.append(doc)
                    keys.append(set_key(found))
                    sets.append(found.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64()), "set_key": pa.array(keys, pa.binary()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    found = docs.mapInArrow(read, "doc long, set_key binary, shingles array<long>")
    return _at_first(found, rows).select("doc", "shingles")


def _at_first(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` (doc, set_key, …) at the rows (node, doc, set_key), by node in place of doc."""
    same = (F.col("t.set_key") == F.col("r.set_key")) & F.col("t.doc").eqNullSafe(F.col("r.doc"))
    others = [F.col(f"t.{c}") for c in table.columns if c not in ("doc", "set_key")]
    more = [F.col(f"r.{c}") for c in rows.columns if c not in ("node", "doc", "set_key")]
    return table.alias("t").join(rows.alias("r"), same).select(F.col("r.node").alias("doc"), *others, *more)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct()


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (xn, yn, xplace, yplace) that length and position do not refute."""
    most = F.least("xplace", "yplace") + F.least(F.col("xn") - F.col("xplace"), F.col("yn") - F.col("yplace"))
    return pairs.where((100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")) & (100 * most >= percent * (F.col("xn") + F.col("yn") - most)))


def _alike() -> Column:
    """Whether the parity sketches xb and yb allow the threshold: sets of that similarity differ in at most (xn + yn) / 9 tokens."""
    differ = sum((F.bit_count(F.col("xb")[i].bitwiseXOR(F.col("yb")[i])) for i in range(PARITY // 64)), F.lit(0))
    return 9 * differ <= F.col("xn") + F.col("yn")


def _halved(sketch: Column, size: Column) -> Column:
    """A sketch of twice ``size`` numbers folded to ``size``, as if it had been taken at half the width; shorter ones as they are."""
    folded = F.zip_with(F.slice(sketch, 1, size), F.slice(sketch, size + 1, size), lambda low, high: low.bitwiseXOR(high))
    return F.when(F.size(sketch) > size, folded).otherwise(sketch)


def _finely_alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (x, y, xn, yn) of similar length that the finer sketches, where both ends have one, do not refute."""
    fine = signed.where("fine is not null")
    met = pairs.join(_side("x", fine, n="xn", fine="xf"), ["x", "xn"], "left").join(_side("y", fine, n="yn", fine="yf"), ["y", "yn"], "left")
    size = F.least(F.size("xf"), F.size("yf"))
    bits = F.zip_with(_halved(F.col("xf"), size), _halved(F.col("yf"), size), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    plain = F.col("xf").isNull() | F.col("yf").isNull()
    return met.where(plain | (9 * differ <= F.col("xn") + F.col("yn"))).drop("xf", "yf")


def _side(name: str, table: DataFrame, **columns: str) -> DataFrame:
    """``table`` with doc as ``name`` and the given columns renamed."""
    return table.select(F.col("doc").alias(name), *(F.col(old).alias(new) for old, new in columns.items()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose full sets reach the threshold."""
    both = F.size(F.array_intersect("xs", "ys"))
    met = pairs.select("x", "y").join(_side("x", sets, shingles="xs"), "x").join(_side("y", sets, shingles="ys"), "y")
    return met.where(100 * both >= percent * (F.size("xs") + F.size("ys") - both)).select("x", "y")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    x = label.select(F.col("node").alias("x"), F.col("component").alias("xc"))
    y = label.select(F.col("node").alias("y"), F.col("component").alias("yc"))
    met = pairs.join(x, "x", "left").join(y, "y", "left")
    return met.where(F.coalesce("xc", "x") != F.coalesce("yc", "y")).drop("xc", "yc")


def near_duplicates(docs: DataFrame, work: WorkTables, key: str = "doc_id", text: str = "text", percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, kept) per row of ``docs``.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their shingle sets;
    ``percent`` is 80, for which the prefix lengths are derived.  Texts are read whole.  Null, empty
    and blank texts have no shingles and link with nothing, and are their own component.  The join
    runs on distinct sets, so rows that repeat an id with different texts link each by its own
    text, whatever their order.  A row without an id links like any other but never names a
    component, which is null where no row has an id.  No rows give no rows; other columns are not read.

    ``kept`` marks one document of each component, that with the smallest id and of those the smallest
    ``text_hash`` (xxhash64 of the text), and all documents without words; rows with equal id and text are one document.

    ``sketch_bits`` sets the counters of the frequency table (2**20 of four bytes by default, whatever the
    corpus); a token is frequent when its bucket holds over four times the mean and over 64.
    """
    if percent != PERCENT:
        raise ValueError("the prefix lengths hold for 80 percent")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    read = work.cut(_read_sets(texts.withColumn("text_hash", F.xxhash64("text")), sketch_bits))
    rows = read.where("n is not null").select("doc", "text_hash", "n", "set_key")
    counts = gather_buckets(read.where("chunk is not null"), sketch_bits)
    frequent_from = max(64, 4 * int(counts.sum(dtype=np.int64) >> sketch_bits)) + 1
    # A node per distinct set, and the row that stands for it.
    again = rows.where("n > 0").groupBy("set_key", "doc").agg(F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"))
    first = again.groupBy("set_key").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "copies", "text_hash")).alias("f"))
    # Nodes are numbered in the order of ids: the smallest member of a signature is then its oldest text, of which others are copies.
    order = (F.col("f.doc").asc_nulls_last(), F.col("set_key").asc())
    first = first.repartitionByRange(*order).sortWithinPartitions(*order)
    first = work.cut(first.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("f.doc").alias("rep"), "f.copies", "f.text_hash"))
    signed = _signature_rows(texts, counts, frequent_from, sketch_bits)
    signed = _at_first(signed, first.select("node", F.col("rep").alias("doc"), "set_key", "copies"))
    signed = work.cut(signed.where("copies = 1").union(signed.where("copies > 1").dropDuplicates(["doc"])).drop("copies"))

    shared = signed.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = work.cut(shared.select("sig"))
    entries = _only_marked(signed, bitmap(shared))
    entries = work.cut(entries.join(shared, "sig", "left_semi"))

    # Round 1: each document and the smallest member of a signature it shares, the one it shares most with.
    pivots = entries.groupBy("sig").agg(F.min(F.struct("doc", "n", "place")).alias("p")).select("sig", "p.*")
    met = _side("y", entries, sig="sig", n="yn", place="yplace").join(_side("x", pivots, sig="sig", n="xn", place="xplace"), "sig")
    stars = _possible(met.where("x < y"), percent).groupBy("x", "y", "xn", "yn").agg(F.count("*").alias("shared"))
    stars = stars.join(_side("x", signed, bits="xb"), "x").join(_side("y", signed, bits="yb"), "y").where(_alike())
    stars = work.cut(_finely_alike(stars.drop("xb", "yb"), signed).select("x", "y", "shared"))
    best = stars.groupBy("y").agg(F.min(F.struct(-F.col("shared"), F.col("x").alias("x"))).alias("b")).select("b.x", "y")
    sets = work.cut(_sets_of(texts, _ends(stars), first).dropDuplicates(["doc"]))
    links = work.cut(_verified(best, sets, percent))
    label = work.cut(components(links, work))

    # Round 2: the other smallest members, where that could connect anything.
    others = _apart(stars.join(best, ["x", "y"], "left_anti"), label)
    links = work.cut(links.union(_verified(others, sets, percent)))
    label = work.cut(components(links, work))

    # Round 3: members of one signature that are still apart, pairwise.
    placed = entries.join(label, entries["doc"] == label["node"], "left").select("sig", "doc", "n", "place", F.coalesce("component", "doc").alias("c"))
    apart = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    placed = placed.join(apart, "sig", "left_semi").join(signed.select("doc", "bits"), "doc")
    placed = work.cut(placed)
    left = _side("x", placed, sig="sig", n="xn", place="xplace", c="xc", bits="xb")
    right = _side("y", placed, sig="sig", n="yn", place="yplace", c="yc", bits="yb")
    rest = _possible(left.join(right, "sig").where("x < y and xc != yc"), percent).where(_alike())
    rest = rest.select("x", "y", "xn", "yn").distinct().join(stars, ["x", "y"], "left_anti")
    rest = work.cut(_finely_alike(rest, signed).select("x", "y"))
    if not rest.isEmpty():
        sets = work.cut(_sets_of(texts, _ends(rest), first).dropDuplicates(["doc"]))
        label = work.cut(components(links.union(_verified(rest, sets, percent)), work))

    linked = first.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winner = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "text_hash")).alias("w"))
    named = linked.select("set_key", "component").join(winner, "component").select("set_key", F.col("w.rep").alias("rep"), F.col("w.text_hash").alias("rep_hash"))
    wordless = F.col("n") == 0
    return rows.join(named, "set_key", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(wordless, F.col("doc")).otherwise(F.col("rep")).alias("component_id"),
        "text_hash",
        (wordless | (F.col("doc").eqNullSafe(F.col("rep")) & F.col("text_hash").eqNullSafe(F.col("rep_hash")))).alias("kept"),
    )
