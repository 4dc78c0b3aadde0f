"""Periodic run detection: a sparse dynamic program over the diagonals of a text against itself.

A diagonal is a lag: word i meets word i - lag.  While the words agree, the diagonal's match length grows; when they
stop agreeing it ends, and a length of at least the lag (and of ``MIN_WORDS`` words in all) is a run of that period.
Most words occur often, so a table of all earlier occurrences would be quadratic.  Two facts keep it sparse and whole:

* A run of period d matches for at least d words on its diagonal.  So lags from K to 2K - 1 open only where the next K words
  occurred that lag earlier.  The windows of K words double from level to level (6, 12, 24, ...) as pairs of the level
  below, and only windows whose halves both occur elsewhere go on; a text without a repeated 6-word window ends there.
* Where a window occurs again within half its length it lies inside a run of shorter period, together with the
  occurrence it repeats.  If two windows of that kind agree, so do the words before them, hence a diagonal can only begin
  where one of its two ends is not of that kind.  So only pairs with such a *head* open a diagonal: linearly many per level, in
  a text of one word repeated a million times, too.

An open diagonal's match length then advances in strides, the levels' windows from the longest to single words, and emits its run when it ends.
Windows are compared by exact ranks, never by hashes.  Work is n log n for n words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
FIRST = MIN_WORDS // 2
# Window starts of a text that open diagonals at a time.
BLOCK = 1 << 18

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass
class Level:
    """Windows of ``width`` words: equal ranks mean equal words; windows that occur once have ranks of their own."""

    width: int
    rank: np.ndarray
    # The windows that occur more than once, by (rank, place), and the combined sort key.
    places: np.ndarray
    key: np.ndarray
    fresh: np.ndarray


def _level(width: int, size: int, places: np.ndarray, keys: np.ndarray) -> Level:
    """Ranks of ``size`` windows, of which only those at ``places`` can repeat; ``keys`` are equal where they do."""
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    again = ~fresh
    again[:-1] |= ~fresh[1:]
    places, fresh = places[again], fresh[again]
    group = np.cumsum(fresh) - 1
    rank = np.arange(len(places), len(places) + size, dtype=np.int64)
    rank[places] = group
    return Level(width, rank, places, group * (size + 1) + places, fresh)


def _levels(ids: np.ndarray) -> list[Level]:
    """The window levels of a text up to the longest window that occurs twice or could be half a run."""
    n, distinct = len(ids), int(ids.max()) + 1
    triple = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    if distinct < 1 << 10:
        keys = triple[:-3] * distinct**3 + triple[3:]
    else:
        _, triple = np.unique(triple, return_inverse=True)
        keys = triple[:-3] * n + triple[3:]
    out = [_level(FIRST, len(keys), np.arange(len(keys)), keys)]
    while len(out[-1].places) and 4 * out[-1].width <= n:
        below = out[-1]
        width, size = 2 * below.width, n - 2 * below.width + 1
        several = len(below.places)
        left, right = below.rank[:size], below.rank[below.width : below.width + size]
        places = np.flatnonzero((left < several) & (right < several))
        out.append(_level(width, size, places, left[places] * several + right[places]))
    return out if len(out[-1].places) else out[:-1]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of bounds its number and each index from low to high - 1."""
    count = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _opened(level: Level, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) where diagonals with near <= lag < far may begin, in blocks of the text."""
    step = len(level.rank) + 1
    gap = np.diff(level.places, prepend=0)
    head = level.fresh | (2 * gap > level.width)
    head_key, head_places = level.key[head], level.places[head]
    group = level.key // step
    by_place = np.argsort(level.places, kind="stable")
    for begin in range(0, len(by_place), BLOCK):
        block = by_place[begin : begin + BLOCK]
        found = []
        for some, keys, places in ((block[head[block]], level.key, level.places), (block[~head[block]], head_key, head_places)):
            at, base = level.places[some], group[some] * step
            low = np.searchsorted(keys, base + np.maximum(at - far + 1, 0))
            high = np.searchsorted(keys, base + np.maximum(at - near, -1), "right")
            owner, index = _ranges(low, high)
            found.append((at[owner], at[owner] - places[index]))
        place, lag = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(place):
            continue
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        begins = np.ones(len(place), bool)
        begins[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        yield place[begins], lag[begins]


def _strides(ids: np.ndarray, levels: list[Level]) -> list[tuple[int, np.ndarray, int]]:
    """(words, ranks, times): a match shorter than the last window is spelled by at most so many of each."""
    out = [(level.width, level.rank, 1) for level in reversed(levels)]
    out[0] = (out[0][0], out[0][1], len(ids))
    return [*out, (1, ids, FIRST - 1)]


def _matched(strides: list[tuple[int, np.ndarray, int]], n: int, place: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last word of the streak of matches around each (place, lag)."""
    begin, end = place.copy(), place.copy()
    for width, rank, times in strides:
        for side in ("end", "begin"):
            alive = np.arange(len(place))
            for _ in range(times):
                at = end[alive] if side == "end" else begin[alive] - width
                fits = (at + width <= n) & (at - lag[alive] >= 0)
                alive, at = alive[fits], at[fits]
                same = rank[at] == rank[at - lag[alive]]
                alive = alive[same]
                if not len(alive):
                    break
                if side == "end":
                    end[alive] += width
                else:
                    begin[alive] -= width
    return begin, end


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of the words with these numbers, by start, then period.

    A run is a stretch with smallest period q and at least ``max(MIN_WORDS, 2 * q)`` words that no neighbour extends.
    """
    none = np.empty((0, 3), np.int64)
    if len(ids) < MIN_WORDS:
        return none
    levels = _levels(ids)
    if not levels:
        return none
    n, strides, found = len(ids), _strides(ids, levels), []
    first = levels[0].rank
    for lag in range(1, FIRST):
        same = first[lag:] == first[:-lag]
        if same.any():
            begins = np.flatnonzero(same & ~np.concatenate(([False], same[:-1]))) + lag
            found.append((begins, np.full(len(begins), lag)))
    opened = [iter(found), *(_opened(level, level.width, 2 * level.width) for level in levels)]
    runs = []
    for pairs in opened:
        for place, lag in pairs:
            begin, end = _matched(strides, n, place, lag)
            long = end - begin >= np.maximum(lag, MIN_WORDS - lag)
            runs.append(np.stack((begin - lag, end - begin + lag, lag), axis=1)[long])
    if not runs:
        return none
    # Lags that are multiples of a run's period end where it does: of equal stretches the smallest period counts.
    runs = np.concatenate(runs)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words."""
    index = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside all runs, and of each run the first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) per row of ``docs``: all runs of its whole text, and the text with each run cut to one period.

    Words are separated by space and the controls 9 to 13; ``runs`` come by start, then period, in words from 0; ``collapsed`` has the kept
    words with one space between.  Null and empty texts have no words, no runs and an empty ``collapsed``.  Null and repeated
    keys and repeated rows give a row each; no rows give no rows; other columns are not read.  Texts are read one by one by maps, nothing is
    shuffled, and a task holds one text's words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, all_runs, kept = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()
                runs = find_runs(numbered(words))
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), row, strict=True)) for row in runs.tolist()])
                kept.append(b" ".join(collapse(words, runs)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
