"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 with ``DIMENSIONS`` components, derived from its code
point.  A letter n-gram is the product of its letters' vectors, each rotated by its place; a text is
the sum of its n-grams' vectors; a language's prototype is the sum of the unit vectors of its
training texts.  A text takes the language whose prototype has the greatest cosine with it.

Random vectors are nearly orthogonal, so the profiles have a fixed size whatever the alphabet and
the corpus: a prototype is ``DIMENSIONS`` numbers, and training sums such vectors per task and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
SEED = 20_240_811
UNKNOWN = "und"
SCALE = 1 << 24
BLOCK_GRAMS = 2048
BLOCK_TEXTS = 256
MAX_LETTERS = 20_000
MAX_GRAMS = 8192
MAX_DOTS = 1 << 18
MAX_WORDS = 50_000
BLOCK_WORDS = 2048
# Between these, times that of n-grams all orthogonal, lies the norm of a sum of random vectors of n-grams.
NORM_FROM, NORM_TO = 0.6, 1.5
MAX_LANGUAGES = 20_000
# How often chance alone may pass for a language, and which share of learned runs of words may look like chance.
CHANCE = 1e-4
UNLIKE = 0.002
RUN_WORDS = 64
LEAST_GRAMS = (4, 8, 16, 32, 64, 128)
# A text is odd as a whole if most of its longest runs of words, of so many at least, are like no language; so many may be, per language.
ODD_WORDS, ODD = 16, 0.02
LETTERS = regex.compile(r"\p{L}+")


class Letters:
    """Letter vectors by code point, made when first met; forgets all when full."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.table = np.empty((256, DIMENSIONS), np.int8)

    def rows(self, points: np.ndarray) -> np.ndarray:
        """Table rows of distinct code points."""
        if len(self.at) + len(points) > MAX_LETTERS:
            self.__init__()
        for point in points.tolist():
            if point not in self.at:
                if len(self.at) == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                bits = np.random.Generator(np.random.Philox(key=[SEED, point])).integers(0, 2, DIMENSIONS, np.int8)
                self.table[len(self.at)] = 2 * bits - 1
                self.at[point] = len(self.at)
        return np.array([self.at[point] for point in points.tolist()], np.int64)

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """The n-gram vectors of packed keys (21 bits a letter): rotated letter vectors, multiplied."""
        points, inverse = np.unique(np.stack([(keys >> np.uint64(21 * (GRAM - 1 - k))) & np.uint64(0x1FFFFF) for k in range(GRAM)]), return_inverse=True)
        rows = self.rows(points)
        inverse = inverse.reshape(GRAM, -1)
        out = np.ones((len(keys), DIMENSIONS), np.int8)
        for k in range(GRAM):
            out *= np.roll(self.table[rows], GRAM - 1 - k, axis=1)[inverse[k]]
        return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed letter n-grams of a whole text and how often each occurs."""
    return np.unique(gram_keys(LETTERS.findall(text.lower())), return_counts=True)


def gram_keys(words: list[str]) -> np.ndarray:
    """The packed letter n-grams of words in lower case, in order; words end in spaces."""
    if not words:
        return np.empty(0, np.uint64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    keys = np.zeros(len(points) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        keys = (keys << np.uint64(21)) | points[k : k + len(keys)]
    return keys


def effective_grams(text: str) -> float:
    """As many equally frequent n-grams would give a vector as even as that of the text; repeats add nothing."""
    counts = gram_counts(text)[1].astype(np.float64)
    return float(counts.sum() ** 2 / max(1.0, (counts**2).sum()))


def text_vectors(texts: list[str | None], letters: Letters) -> np.ndarray:
    """Unit vector per text, zero where there is no letter; works on blocks of texts and n-grams."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for start in range(0, len(texts), BLOCK_TEXTS):
        found = [gram_counts(text) if text else None for text in texts[start : start + BLOCK_TEXTS]]
        of = np.concatenate([[], *(np.full(len(x[0]), i) for i, x in enumerate(found) if x)]).astype(np.int64)
        if not len(of):
            continue
        keys, at = np.unique(np.concatenate([x[0] for x in found if x]), return_inverse=True)
        counts = np.concatenate([x[1] for x in found if x]).astype(np.float32)
        block = out[start : start + BLOCK_TEXTS]
        for low in range(0, len(keys), BLOCK_GRAMS):
            vectors = letters.grams(keys[low : low + BLOCK_GRAMS]).astype(np.float32)
            here = (at >= low) & (at < low + BLOCK_GRAMS)
            dense = np.zeros((len(block), len(vectors)), np.float32)
            dense[of[here], at[here] - low] = counts[here]
            block += dense @ vectors
        norm = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1))
        block /= np.maximum(norm, 1e-30)[:, None].astype(np.float32)
    return out


@dataclass(frozen=True)
class Profiles:
    """Languages and their unit prototypes, one row each."""

    languages: tuple[str, ...]
    prototypes: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from all rows of ``docs`` that have a language and a letter.

    Each task sums the unit vectors of its texts per language, scaled to integers so that the order of
    summation doesn't matter; the driver gets one vector of 8 kB per language.  More than ``MAX_LANGUAGES`` raise an error.
    Null languages and texts, and texts without a letter, teach nothing; repeated rows count as often as they come; no rows give no
    languages; other columns are not read.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for start in range(0, len(names), BLOCK_TEXTS):
                own = names[start : start + BLOCK_TEXTS]
                vectors = np.rint(text_vectors(batch.column(0).slice(start, BLOCK_TEXTS).to_pylist(), letters).astype(np.float64) * SCALE).astype(np.int64)
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vectors[[x == name for x in own]].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "total": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["total"])
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, total binary"
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = known.mapInArrow(gather, schema).groupBy("lang").applyInArrow(add, schema).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((row.lang, np.frombuffer(row.total, np.int64).astype(np.float64)) for row in rows)
    found = [(name, total / np.sqrt((total**2).sum())) for name, total in found if total.any()]
    return Profiles(tuple(name for name, _ in found), np.array([total for _, total in found]).reshape(-1, DIMENSIONS))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    """A column struct(lang_pred, score) for ``docs``: the nearest prototype and its cosine, cut to 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  Equal cosines
    go to the language whose name comes first.  The whole text counts.  Repeated rows get equal answers, an empty table none; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, own = Letters(), shared.value
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for start in range(0, len(texts) if own.languages else 0, BLOCK_TEXTS):
                vectors = text_vectors(texts.iloc[start : start + BLOCK_TEXTS].tolist(), letters)
                some = np.flatnonzero(vectors.any(axis=1))
                if len(some):
                    cosines = vectors[some].astype(np.float64) @ own.prototypes.T
                    best = cosines.argmax(axis=1)
                    names[start + some] = np.array(own.languages, object)[best]
                    scores[start + some] = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return nearest(F.col(text))


@dataclass(frozen=True)
class Limits:
    """When a text is like no learned language.

    ``noise`` is a cosine that texts without a common n-gram exceed in ``CHANCE`` of the cases, whatever their length.
    Learned texts clear it from ``grams`` effective n-grams on (None: never), so shorter ones cannot be told by it; for
    these there are the ``letters`` of the learned texts.
    """

    noise: float
    grams: int | None
    letters: frozenset[str]


def limits(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> Limits:
    """The limits for ``profiles``, which were learned from ``docs``.

    All learned texts give their letters and all their words, in runs of 1, 2, 4 to 64 words (``spread_words``); ``grams`` is twice the
    least number from which on all but ``UNLIKE`` of the runs of every language exceed the noise, as learned texts score higher than
    new ones.  Texts that are odd as a whole, with most of their runs of 64 words within the noise, such as one that quotes
    other scripts throughout, tell nothing about lengths and are left out, up to a share of ``ODD`` per language; beyond that
    there is no limit by the noise.  Tasks count runs; the driver gets some numbers per language and one row per letter.
    """
    noise = NormalDist().inv_cdf(1 - CHANCE / max(1, len(profiles.languages))) / DIMENSIONS**0.5
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, met, counts = Runs(shared.value, noise), set(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(start, BLOCK_TEXTS)
                known = [(whole.lower(), name) for whole, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if whole]
                found, odd = runs.count([whole for whole, _ in known])
                for i, (whole, name) in enumerate(known):
                    met.update(whole)
                    table = counts.setdefault(name, np.zeros((1 + len(LEAST_GRAMS), 2), np.int64))
                    table[0] += (1, odd[i])
                    if not odd[i]:
                        table[1:] += found[i]
        rows = [(None, ord(x), 0, 0) for x in met if LETTERS.match(x)]
        rows += [(name, i, *pair) for name, table in counts.items() for i, pair in enumerate(table.tolist())]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)

    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("n", pa.int64()), ("low", pa.int64())])
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    added = known.mapInArrow(gather, "lang string, place int, n long, low long").groupBy("lang", "place").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    found = {(row.lang, row.place): (row.n, row.low) for row in added.collect()}
    met = frozenset(chr(place) for name, place in found if name is None)
    for name in profiles.languages:
        texts, odd = found[name, 0]
        if odd > ODD * texts:
            return Limits(noise, None, met)
    for i, least in enumerate(LEAST_GRAMS, 1):
        rest = [found[name, i] for name in profiles.languages]
        if all(n and low <= UNLIKE * n for n, low in rest):
            return Limits(noise, 2 * least, met)
    return Limits(noise, None, met)


def spread_words(lower: str) -> list[str]:
    """All words of a text in lower case, in an order that brings those together that lie at even distances over the whole text.

    ``RUN_WORDS`` in a row then come from all over the text, as a quoted passage tells little about texts of its length.
    """
    words = LETTERS.findall(lower)
    step = -(-len(words) // RUN_WORDS)
    return [word for start in range(step) for word in words[start::step]]


class Grams:
    """n-gram vectors by packed key, made when first met; forgets all when full."""

    def __init__(self):
        self.letters, self.at = Letters(), {}
        self.table = np.empty((MAX_GRAMS, DIMENSIONS), np.int8)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of distinct keys, at most ``MAX_GRAMS``."""
        if len(self.at) + len(keys) > MAX_GRAMS:
            self.at = {}
        new = np.array([key for key in keys.tolist() if key not in self.at], np.uint64)
        for low in range(0, len(new), BLOCK_GRAMS):
            part = new[low : low + BLOCK_GRAMS]
            self.table[len(self.at) : len(self.at) + len(part)] = self.letters.grams(part)
            self.at.update(zip(part.tolist(), range(len(self.at), len(self.at) + len(part)), strict=True))
        return self.table[[self.at[key] for key in keys.tolist()]]


class Runs:
    """Counts runs of words by length and likeness to ``profiles``; keeps what it needs again of n-grams and words, and forgets all when full."""

    def __init__(self, profiles: Profiles, noise: float):
        self.profiles, self.noise = profiles, noise
        self.grams, self.at, self.low_words = Grams(), {}, {}
        languages = max(1, len(profiles.languages))
        self.table = np.empty((min(MAX_DOTS, 4 * MAX_DOTS // languages) // 4, languages))
        self.block_words = max(RUN_WORDS, 64 * BLOCK_WORDS // max(64, languages))

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text in lower case: per entry of ``LEAST_GRAMS`` its runs of so many effective n-grams and those within the noise, and whether it is odd.

        Every word of a text is in a run of 1, in one of 2, 4 and so on to ``RUN_WORDS`` words; the last may be shorter, and
        none counts twice.  Blocks of words bound what a long text takes.
        """
        counts, words = np.zeros((len(texts), 1 + len(LEAST_GRAMS), 2), np.int64), [spread_words(text) for text in texts]
        longest = np.zeros((len(texts), 2), np.int64)
        block, text, run = [], [], []
        for i, spread in enumerate(words):
            for low in range(0, len(spread), RUN_WORDS):
                if len(block) + RUN_WORDS > self.block_words:
                    self._count_block(block, np.array(text), np.array(run), counts, longest)
                    block, text, run = [], [], []
                part = spread[low : low + RUN_WORDS]
                # A run of the greatest length goes by the place of its first word.
                text.extend([i] * len(part))
                run.extend([len(block)] * len(part))
                block.extend(part)
        if block:
            self._count_block(block, np.array(text), np.array(run), counts, longest)
        atleast = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        # Of all runs of a text, and of those within the noise.
        atleast[:, :, 0] += atleast[:, :, 1]
        return atleast, longest[:, 1] > longest[:, 0]

    def _count_block(self, block: list[str], text: np.ndarray, run: np.ndarray, counts: np.ndarray, longest: np.ndarray) -> None:
        """Adds the runs in a block of words to ``counts`` by text, size and whether they are within the noise, and the longest to ``longest`` by the latter."""
        keys, grams = np.unique(gram_keys(block), return_inverse=True)
        upto = np.zeros((len(grams) + 1, self.table.shape[1]))
        np.cumsum(self._dots(keys)[grams], axis=0, out=upto[1:])
        # The n-gram after a word's own joins it to the next and belongs to runs that have both.
        ends = np.cumsum([len(word) + 1 for word in block]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        place, length = np.arange(len(block)) - run, 1
        run_ends = np.searchsorted(run, run, "right") - 1
        while True:
            first = np.flatnonzero(place % length == 0)
            last = np.minimum(first + length - 1, run_ends[first])
            # A run no longer than one before has been counted.
            new = 2 * (last - first + 1) > length
            whole = (last - first + 1 >= ODD_WORDS) & (length >= RUN_WORDS)
            total, squares, pairs = _gram_counts(grams, starts[first], ends[last], len(keys))
            dot, norm = upto[ends[last]] - upto[starts[first]], np.sqrt(DIMENSIONS * squares)
            best = dot.max(axis=1)
            low = best <= self.noise * NORM_FROM * norm
            unsure = (new | whole) & ~low & (best <= self.noise * NORM_TO * norm)
            low[unsure] = self._within_noise(np.flatnonzero(unsure), best, keys, pairs, [block[i] for i in first[unsure].tolist()] if length == 1 else None)
            size = np.searchsorted(LEAST_GRAMS, total**2 / np.maximum(1, squares), "right")
            at = text[first] * counts[0].size + 2 * size + low
            counts += np.bincount(at[new], minlength=counts.size).reshape(counts.shape)
            if length >= RUN_WORDS:
                np.add.at(longest, (text[first[whole]], low[whole].astype(np.int64)), 1)
                break
            length *= 2

    def _dots(self, keys: np.ndarray) -> np.ndarray:
        """The dot products of distinct n-grams' vectors with the prototypes."""
        if len(keys) > len(self.table):
            return self._new_dots(keys)
        names = keys.tolist()
        new = [key for key in names if key not in self.at]
        if len(self.at) + len(new) > len(self.table):
            self.at, new = {}, names
        if new:
            rows = slice(len(self.at), len(self.at) + len(new))
            self.table[rows] = self._new_dots(np.array(new, np.uint64))
            self.at.update(zip(new, range(rows.start, rows.stop), strict=True))
        return self.table[[self.at[key] for key in names]]

    def _new_dots(self, keys: np.ndarray) -> np.ndarray:
        prototypes = self.profiles.prototypes.T.astype(np.float32)
        return np.concatenate([self.grams.letters.grams(keys[low : low + BLOCK_GRAMS]).astype(np.float32) @ prototypes for low in range(0, len(keys), BLOCK_GRAMS)])

    def _within_noise(self, runs: np.ndarray, best: np.ndarray, keys: np.ndarray, pairs: tuple[np.ndarray, ...], words: list[str] | None) -> np.ndarray:
        """Whether the best dot products of some runs are within the noise by their true norms, which single ``words`` need once."""
        todo = runs
        if words is not None:
            first = {word: i for i, word in zip(runs.tolist(), words) if word not in self.low_words}
            todo = np.array(sorted(first.values()), np.int64)
        of, gram, n = pairs
        mine = np.isin(of, todo)
        of, gram, n = np.searchsorted(todo, of[mine]), gram[mine], n[mine]
        sums = self._sums(len(todo), of, keys[gram], n)
        low = best[todo] <= self.noise * np.sqrt(np.einsum("ij,ij->i", sums, sums))
        if words is None:
            return low
        known = dict(zip(todo.tolist(), low.tolist()))
        found = {word: known[i] for word, i in first.items()}
        out = np.array([found[word] if word in found else self.low_words[word] for word in words], bool)
        if len(self.low_words) + len(found) > MAX_WORDS:
            self.low_words = {}
        self.low_words.update(found)
        return out

    def _sums(self, runs: int, of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sums of vectors of n-grams ``keys``, each ``n`` times, by run; ``of`` rises."""
        # More often than that an n-gram comes in further rows; a part then stays below 2 ** 15.
        most = 3
        if n.max(initial=0) > most:
            rows = -(-n // most)
            of, keys = np.repeat(of, rows), np.repeat(keys, rows)
            left = np.repeat(n, rows) - most * (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows))
            n = np.minimum(left, most)
        out = np.zeros((runs, DIMENSIONS), np.float32)
        for low in range(0, len(keys), MAX_GRAMS):
            part = slice(low, low + MAX_GRAMS)
            distinct, inverse = np.unique(keys[part], return_inverse=True)
            vectors = self.grams.vectors(distinct)
            here, starts, lengths = np.unique(of[part], return_index=True, return_counts=True)
            order = np.argsort(-lengths, kind="stable")
            here, starts, lengths = here[order], starts[order], lengths[order]
            times = n[part].astype(np.int16)
            sums = np.zeros((len(here), DIMENSIONS), np.int16)
            # The first n-gram of all runs, then the second of those that have one, and so on.
            for k in range(int(lengths[0])):
                some = starts[: int(np.searchsorted(-lengths, -k))] + k
                more = vectors[inverse[some]]
                sums[: len(some)] += more if times[some].max() == 1 else more * times[some, None]
            out[here] += sums
        return out


def _gram_counts(grams: np.ndarray, low: np.ndarray, high: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """For runs of n-grams from ``low`` to before ``high``: how many they have, the sum of squares of how often each occurs, and (run, n-gram, how often)."""
    run = np.searchsorted(low, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) < high[run]
    pairs, n = np.unique(run[inside] * distinct + grams[inside], return_counts=True)
    of = pairs // distinct
    return high - low, np.bincount(of, n * n, len(low)), (of, pairs % distinct, n)


def like_learned(docs: DataFrame, profiles: Profiles, limit: Limits, text: str = "text") -> Column:
    """Whether a text is like a learned language.

    Not so: null or without a letter; of ``limit.grams`` effective n-grams or more and with a best cosine within the
    noise; shorter and without a single letter of the learned texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((profiles, limit))

    @F.pandas_udf("boolean")
    def like(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters, (own, limit) = Letters(), shared.value
        for texts in batches:
            kept = np.zeros(len(texts), bool)
            for start in range(0, len(texts), BLOCK_TEXTS):
                vectors = text_vectors(texts.iloc[start : start + BLOCK_TEXTS].tolist(), letters)
                best = (vectors.astype(np.float64) @ own.prototypes.T).max(axis=1)
                some = vectors.any(axis=1)
                kept[start : start + BLOCK_TEXTS] = some
                for i in (start + np.flatnonzero(some & (best <= limit.noise))).tolist():
                    if limit.grams is not None and effective_grams(texts.iloc[i]) >= limit.grams:
                        kept[i] = False
                    else:
                        kept[i] = not limit.letters.isdisjoint(texts.iloc[i].lower())
            yield pd.Series(kept)

    return like(F.col(text))
