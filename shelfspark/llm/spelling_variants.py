"""Spelling variant grouping: a trie of letter-group counts finds all words one edit apart.

A word's vector is its length and how many letters it has of each of ``GROUPS`` groups.  The trie arranges words by successive entries of
that vector.  Two words one edit apart differ by at most one letter too many in one group and one too few in another, so
a depth-first search follows a word's own counts with a budget of one surplus and one deficit, and the words at the leaves it
reaches are verified letter by letter.  A pair is found once, from the word whose first differing entry is the smaller one.

The trie is spread over the cluster.  Its top is a sequence of joins: a node with more than ``node_words`` words is split by
the next entry, and the searches that reach it go down with it, dropped where no word stands; smaller nodes are searched whole in one task.
Where even a whole vector has more words, they are dealt to blocks that every search of the node visits, and so are
the searches where many reach one node.  So a task is bounded, whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import WorkTables

# Letters are dealt to groups by code point, which parts the frequent ones; the trie takes groups in this order, those that tell most first.
ORDER = (1, 10, 5, 14, 16, 17, 15, 11, 8, 4, 19, 0, 9, 18, 3, 12, 2, 13, 7, 6)
GROUPS = len(ORDER)
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))]
NODE_WORDS = 1 << 16
NODE_SEARCHES = 1 << 18
CHUNK = 1 << 16
# Longest word that is verified as a row of a matrix; longer ones are compared one by one.
WIDE = 48

# What a search has spent: nothing, a surplus, a surplus and a deficit at equal length; nothing or its surplus at length + 1.
SAME, MORE, MOVED, LONGER, GROWN = range(5)
# state -> (change of the entry, state after it), for the counts and, first, for the length.
BY_COUNT = {SAME: ((0, SAME), (1, MORE)), MORE: ((0, MORE), (-1, MOVED)), MOVED: ((0, MOVED),), LONGER: ((0, LONGER), (1, GROWN)), GROWN: ((0, GROWN),)}
BY_LENGTH = {SAME: ((0, SAME), (1, LONGER))}

PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def entry(word: Column, depth: int) -> Column:
    """One entry of the words' vectors: the length, then the letters of each group."""
    if not depth:
        return F.length(word)
    letters = "".join(x for x in LETTERS if ord(x) % GROUPS == ORDER[depth - 1])
    return F.length(word) - F.length(F.translate(word, letters, ""))


class Words:
    """Words as bytes, with what comparing them takes."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        column = np.empty(GROUPS, np.int64)
        column[list(ORDER)] = np.arange(1, GROUPS + 1)
        at = np.repeat(np.arange(len(words)) * (GROUPS + 1), self.size) + column[letters % GROUPS]
        self.vectors = np.bincount(at, minlength=len(words) * (GROUPS + 1)).reshape(-1, GROUPS + 1)
        self.vectors[:, 0] = self.size
        self.matrix = np.frombuffer(b"".join(w[:WIDE].ljust(WIDE + 1, b"\0") for w in words), np.uint8).reshape(-1, WIDE + 1)
        # Hashes of the first half and of the rest, by the word's own length and by the length of a word with one letter less.
        power, ends = np.uint64(0x9E3779B97F4A7C15), np.minimum(self.size, WIDE)
        halves = [(np.maximum(ends - less, 0) // 2, np.maximum(ends - less, 0)) for less in (0, 1)]
        self.halves = np.zeros((4, len(words)), np.uint64)
        front, back = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for i in range(int(ends.max(initial=0))):
            front = front * power + self.matrix[:, i]
            back = back * power + self.matrix[np.arange(len(words)), np.maximum(ends - 1 - i, 0)]
            for k, (half, whole) in enumerate(halves):
                self.halves[2 * k][half == i + 1] = front[half == i + 1]
                self.halves[2 * k + 1][whole - half == i + 1] = back[whole - half == i + 1]


class Trie:
    """The vectors of some words, from entry ``depth`` on, as sorted (parent, entry) keys per level."""

    def __init__(self, vectors: np.ndarray, depth: int):
        self.depth = depth
        self.order = np.lexsort(vectors[:, ::-1].T)
        vectors = vectors[self.order].astype(np.int64)
        self.keys, self.span = [], int(vectors.max(initial=0)) + 3
        node = np.zeros(len(vectors), np.int64)
        for level in range(depth, vectors.shape[1]):
            keys, node = np.unique(node * self.span + vectors[:, level] + 1, return_inverse=True)
            self.keys.append(keys)
        # Words of leaf i: order[leaf[i]:leaf[i + 1]].
        self.leaf = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))

    def search(self, vectors: np.ndarray, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(search, word) candidates, depth first, in chunks of searches that go down together."""
        levels = len(self.keys)
        # Searches of like words stay together, so their lookups fall near each other.
        order = np.lexsort(vectors[:, ::-1].T)
        stack = [(0, order[i : i + CHUNK], np.zeros(len(order[i : i + CHUNK]), np.int64), states[order[i : i + CHUNK]]) for i in range(0, len(order), CHUNK)]
        while stack:
            level, search, node, state = stack.pop()
            if level == levels:
                low, count = self.leaf[node], self.leaf[node + 1] - self.leaf[node]
                for part in np.split(np.arange(len(search)), np.flatnonzero(np.diff(np.cumsum(count) // (2 * CHUNK))) + 1):
                    some = count[part]
                    owner = np.repeat(search[part], some)
                    index = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[part], some)
                    yield owner, self.order[index]
                continue
            keys, entry = self.keys[level], vectors[search, self.depth + level]
            moves = BY_COUNT if self.depth + level else BY_LENGTH
            for kind, options in moves.items():
                own = np.flatnonzero(state == kind)
                for change, after in options:
                    wanted = entry[own] + change
                    fits = (wanted >= 0) & (wanted + 2 < self.span)
                    chosen, wanted = own[fits], wanted[fits]
                    key = node[chosen] * self.span + wanted + 1
                    at = np.searchsorted(keys, key)
                    there = at < len(keys)
                    there[there] = keys[at[there]] == key[there]
                    if there.any():
                        stack.append((level + 1, search[chosen[there]], at[there], np.full(int(there.sum()), after)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced byte parts a from b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    front = np.flatnonzero(x[:n] != y[:n])
    back = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    same = (front[0] if len(front) else n) + (back[0] if len(back) else n)
    return bool(same >= max(len(a), len(b)) - 1)


def verified(left: Words, right: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (a-th of left, b-th of right, as long or one longer) that are one edit apart."""
    longer = right.size[b] > left.size[a]
    # One edit leaves the first half or the rest as it is.
    some = np.where(longer, left.halves[0][a] == right.halves[2][b], left.halves[0][a] == right.halves[0][b])
    some |= np.where(longer, left.halves[1][a] == right.halves[3][b], left.halves[1][a] == right.halves[1][b])
    some |= right.size[b] > WIDE
    a, b, longer = a[some], b[some], longer[some]
    x, y = left.matrix[a], right.matrix[b]
    equal = x == y
    good = ~longer & ((~equal).sum(axis=1) == 1)
    # One letter more: a prefix agrees and all after it agrees one place further on.
    before = np.logical_and.accumulate(np.concatenate((np.ones((len(x), 1), bool), equal[:, :-1]), axis=1), axis=1)
    shifted = np.concatenate((x[:, :-1] == y[:, 1:], np.ones((len(x), 1), bool)), axis=1)
    behind = np.logical_and.accumulate(shifted[:, ::-1], axis=1)[:, ::-1]
    good |= longer & (before & behind).any(axis=1)
    for i in np.flatnonzero(right.size[b] > WIDE):
        good[i] = one_edit(left.words[a[i]], right.words[b[i]])
    return a[good], b[good]


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The near pairs between the words and the searches of one block, both ways."""
    stored, searches = (table.filter(pc.equal(table["searches"], role)) for role in (False, True))
    words, wanted = (Words([w.encode("latin-1") for w in side["word"].to_pylist()]) for side in (stored, searches))
    found = [PAIRS.empty_table()]
    if not len(stored) or not len(searches):
        return found[0]
    for a, b in Trie(words.vectors, key[1].as_py()).search(wanted.vectors, searches["state"].to_numpy()):
        a, b = verified(wanted, words, a, b)
        # Words of one vector meet both ways.
        once = (wanted.vectors[a] != words.vectors[b]).any(axis=1)
        once |= np.fromiter((wanted.words[i] < words.words[j] for i, j in zip(a, b, strict=True)), bool, len(a))
        a, b = pa.array(a[once]), pa.array(b[once])
        for one, other in ((searches.take(a), stored.take(b)), (stored.take(b), searches.take(a))):
            found.append(pa.table([one["word"], other["word"], other["n"]], schema=PAIRS))
    return pa.concat_tables(found)


def near_pairs(words: DataFrame, work: WorkTables, node_words: int = NODE_WORDS, node_searches: int = NODE_SEARCHES) -> DataFrame:
    """(word, near, near_n) for both directions of each pair of ``words`` (word, n; distinct words of Latin-1 letters) one edit apart."""
    at, depth, found = words.select("word", "n", F.lit(SAME).alias("state"), F.lit("").alias("node")), 0, []
    own = F.col("state") == SAME
    while True:
        nodes = at.where(own).groupBy("node").agg(F.count("*").alias("stored"))
        large = (F.col("stored") > node_words) if depth <= GROUPS else F.lit(False)
        at = work.cut(at.join(nodes.withColumn("large", large), "node"))
        found.append(at.where(~F.col("large")).select("word", "n", "state", "node", "stored", F.lit(depth).alias("depth")))
        at = at.where("large")
        if depth > GROUPS or at.isEmpty():
            break
        moves = [(state, change, after) for state, options in (BY_COUNT if depth else BY_LENGTH).items() for change, after in options]
        own_entry = entry(F.col("word"), depth)
        steps = F.filter(
            F.array(*(F.when(F.col("state") == s, F.struct((own_entry + c).alias("entry"), F.lit(after).alias("state"))) for s, c, after in moves)),
            lambda step: step.isNotNull() & (step["entry"] >= 0),
        )
        at = at.select("word", "n", "node", F.explode(steps).alias("step"))
        at = at.select("word", "n", "step.state", F.concat_ws(".", "node", F.col("step.entry").cast("string")).alias("node"))
        depth += 1
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    # Large blocks are split on either side: stored words by stored / node_words, searches by their number / node_searches.
    visits = rows.groupBy("depth", "node").agg(F.ceil(F.count("*") / node_searches).cast("int").alias("turns"))
    rows = rows.join(visits, ["depth", "node"]).withColumn("parts", F.ceil(F.col("stored") / node_words).cast("int"))
    number = F.xxhash64("word")
    cells = {
        False: (own, F.array(F.pmod(number, "parts").cast("int")), F.sequence(F.lit(0), F.col("turns") - 1)),
        True: (F.lit(True), F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.pmod(number, "turns").cast("int"))),
    }
    dealt = None
    for searches, (which, parts, turns) in cells.items():
        side = rows.where(which).select("*", F.explode(parts).alias("part"), turns.alias("turns_of")).select(
            "node", "depth", "part", F.explode("turns_of").alias("turn"), "word", "n", "state", F.lit(searches).alias("searches")
        )
        dealt = side if dealt is None else dealt.union(side)
    return dealt.groupBy("node", "depth", "part", "turn").applyInArrow(_search, "word string, near string, near_n long")


def followed(forms: DataFrame, work: WorkTables) -> DataFrame:
    """(word, root) of each row of ``forms`` (word, form): the last word reached by following forms, which never lead back."""
    roots = work.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = work.cut(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def group_variants(words: DataFrame, work: WorkTables, ratio: int = 10, node_words: int = NODE_WORDS, node_searches: int = NODE_SEARCHES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per row of ``words`` (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced letter.  The form of a word is its near word of largest n,
    of equal ones the first in code-point order, if that n is at least ``ratio`` (2 or more) times its own, else null; the root is
    where following forms ends, the word itself without a form.  Words are distinct, not null and of letters up to U+00FF, any length,
    the empty word included; no words give no rows; other columns are not read.
    """
    words = work.cut(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_pairs(words, work, node_words, node_searches).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("has", -F.col("best.n") >= F.col("n") * ratio)
    known = work.cut(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best.word")).alias("form"), F.when(F.col("has"), -F.col("best.n")).alias("form_n")
        )
    )
    roots = followed(known.where("form is not null").select("word", "form"), work)
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs_of_letters(text: Column, least: int = 1) -> Column:
    """All maximal runs of at least ``least`` letters A-Z, a-z and U+00C0 to U+00FF; null without a text."""
    return F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(word.rlike("[A-Z]"), F.translate(word, capitals, capitals.lower())).otherwise(word)
