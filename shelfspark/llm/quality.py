"""A quality classifier: gradient-boosted trees on histograms of document statistics.

Every whole text becomes ``FEATURES``, computed once.  Training bins each feature at quantiles and grows
complete trees level by level from sums of gradients per bin; the trees are then flattened into three
arrays, so scoring a batch is a few numpy look-ups per tree and level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FEATURES = (
    "log_chars",
    "log_words",
    "mean_word",
    "letters",
    "capitals",
    "digits",
    "spaces",
    "stops",
    "marks",
    "symbols",
    "non_ascii",
    "capital_words",
    "symbol_words",
    "plain_words",
    "long_words",
    "distinct_words",
    "top_word",
    "log_lines",
    "mean_line",
    "repeated_lines",
    "words_per_stop",
    "repeated_pairs",
    "worst_stretch",
)
# At most about so many labelled rows are learned from, chosen by a hash of their id; all rows are scored.
MAX_TRAINING_ROWS = 40_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 60, 0.2, 2.0, 1.0
STRETCH = 20
PREDICT_FROM = 0.3

# Classes of the ASCII bytes; all other bytes count as letters of a word.
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.int64)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = (
        _LOWER if _c.islower() else _UPPER if _c.isupper() else _DIGIT if _c.isdigit() else _SPACE if _c in " \t\n\x0b\x0c\r"
        else _STOP if _c in ".?" else _MARK if _c in ",;:'\"()-!" else _SYMBOL
    )
_PLAIN = np.isin(_CLASS, (_LOWER, _UPPER, _OTHER))


def features(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null counts as empty."""
    out = np.zeros(len(FEATURES))
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        out[0] = np.log1p(len(data))
        return out
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    share = np.bincount(kind, minlength=8) / len(raw)
    n = len(words)
    space = kind == _SPACE
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    lengths = ends - begins + 1
    symbol = (kind == _SYMBOL) | (raw == 33)
    symbols = np.add.reduceat(symbol.astype(np.int64), begins)
    last_symbol = symbol[ends] | (symbols > 0)
    capitals = np.add.reduceat((kind == _UPPER).astype(np.int64), begins)
    plain = np.add.reduceat(_PLAIN[raw].astype(np.int64), begins) >= lengths - 1
    codes = pd.factorize(np.array(words, object))[0]
    counts = np.bincount(codes)
    pairs = codes[:-1].astype(np.int64) * len(counts) + codes[1:]
    lines = [line for line in data.split(b"\n") if line.strip()]
    bad = last_symbol | (capitals == lengths) & (lengths > 2) | ~plain
    windows = np.add.reduceat(bad.astype(np.int64), np.arange(0, n, STRETCH)) / np.diff(np.append(np.arange(0, n, STRETCH), n))
    out[:] = (
        np.log1p(len(raw)),
        np.log1p(n),
        lengths.mean(),
        share[_LOWER] + share[_UPPER] + share[_OTHER],
        share[_UPPER],
        share[_DIGIT],
        share[_SPACE],
        share[_STOP],
        share[_MARK],
        share[_SYMBOL],
        share[_OTHER],
        (capitals > 1).mean(),
        last_symbol.mean(),
        plain.mean(),
        (lengths > 12).mean(),
        len(counts) / n,
        counts.max() / n,
        np.log1p(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        n / (1 + (kind == _STOP).sum()),
        1 - len(np.unique(pairs)) / max(1, len(pairs)),
        windows.max(),
    )
    return out


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) per row: the statistics as an array of doubles.

    Null and empty texts have the statistics of no words; repeated rows and null ids give a row each, no rows give none; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(1)]
            offsets = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
            flat = np.concatenate(rows) if rows else np.empty(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.ListArray.from_arrays(offsets, pa.array(flat))})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Forest:
    """Complete trees of depth ``DEPTH`` in arrays: inner node k has children 2k+1 and 2k+2, leaves follow the inner nodes."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``, all rows one level at a time."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts ``TREES`` trees on the log loss.  Without rows, or with one class alone, the base rate remains."""
    inner = (1 << DEPTH) - 1
    if not len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, weight = y - p, p * (1 - p)
        node, feature, limit = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            start, width = (1 << depth) - 1, 1 << depth
            place = node - start
            best, choice = np.zeros(width), np.full((width, 2), -1)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                cell, size = place * (BINS + 1) + bins[f], width * (BINS + 1)
                g = np.bincount(cell, grad, size).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(cell, weight, size).reshape(width, -1).cumsum(axis=1)
                gl, hl, ga, ha = g[:, : len(edges)], h[:, : len(edges)], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST) | (ha - hl < LEAST)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best[better], choice[better] = top[better], np.stack([np.full(width, f), at], axis=1)[better]
            split = choice[:, 0] >= 0
            feature[start : start + width][split] = choice[split, 0]
            limit[start : start + width][split] = [cuts[f][b] for f, b in choice[split]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, weight, inner + 1)
        value = RATE * g / (h + RIDGE)
        total += value[leaf]
        trees.append((feature, limit, value))
    return Forest(*(np.array([t[k] for t in trees]) for k in range(3)), base)


def train(rows: DataFrame, key: str = "doc_id", label: str = "label", most: int = MAX_TRAINING_ROWS) -> Forest:
    """A forest from rows (key, x, label 0 or 1).

    Rows without a label are left out.  Of the others at most about ``most`` (a normal margin above) are taken by a
    hash of their key, so the driver's memory has a bound; which ones does not depend on the cluster.
    """
    known = rows.where(F.col(label).isin(0, 1))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30)))
    table = chosen.orderBy(key, "x", label).limit(2 * most).select("x", label).toArrow()
    if not table.num_rows:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return fit(x, table[label].to_numpy().astype(np.float64))


def score(rows: DataFrame, forest: Forest, x: str = "x") -> Column:
    """The probability of label 1 as a column of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(shared.value.scores(np.stack(column.to_numpy())) if len(column) else np.empty(0))

    return run(F.col(x))
