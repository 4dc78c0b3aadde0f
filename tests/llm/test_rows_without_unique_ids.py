"""Null and repeated ids in the similarity joins, the pipeline's near stage, and the plans of mixing at many patterns."""

import random
import time

import pytest

import corpus_pipeline
from shelfspark.llm import caps, langid, licenses, mixing, ngram_join
from shelfspark.llm.common import WorkTables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, text_hash long, kept boolean, node long, rep long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 8, False, 9, 10) for i, t in rows], DOCS)


def text(seed, change=()):
    words = [f"w{random.Random(seed).randrange(10**6)}x{k}" for k in range(120)]
    for place in change:
        words[place] = "other"
    return " ".join(words)


def joined(spark, rows):
    found = ngram_join.near_duplicates(documents(spark, rows), WorkTables(spark, "ngrams")).collect()
    assert len(found) == len(rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr)


def test_repeated_ids_link_by_each_text(spark):
    """The component of a row depends on its own text, in any order of the rows."""
    rows = [(1, text(1)), (2, text(2)), (5, text(1, [3])), (5, text(2, [3])), (6, text(3))]
    want = sorted([(1, 116, 1, True), (2, 116, 2, True), (5, 116, 1, False), (5, 116, 2, False), (6, 116, 6, True)], key=repr)
    for order in (rows, rows[::-1]):
        assert joined(spark, list(order)) == want


def test_rows_without_an_id_link_but_name_no_component(spark):
    rows = [(None, text(1)), (4, text(1, [60])), (9, text(1, [10])), (None, text(2)), (None, text(2, [5])), (None, None), (3, ""), (None, text(1))]
    got = joined(spark, rows)
    assert [(d, c) for d, _, c, _ in got if d is not None] == [(3, 3), (4, 4), (9, 4)]
    assert sorted(repr(c) for d, n, c, _ in got if d is None and n) == ["4", "4", "None", "None"]


def test_rows_that_repeat_whole_are_one_node(spark):
    rows = [(7, text(1))] * 40 + [(7, text(1, [50]))] * 3 + [(8, text(1, [20]))] * 2
    got = joined(spark, rows)
    assert {c for _, _, c, _ in got} == {7} and len({(d, k) for d, _, _, k in got}) <= 3
    assert sum(k for _, _, _, k in got) in (40, 3)


def test_near_stage_drops_rows_by_id_and_text(spark):
    rows = [(1, text(1)), (2, text(2)), (5, text(1, [3])), (5, text(9)), (None, text(2, [8])), (6, None), (7, "short one")]
    kept = corpus_pipeline.near(spark, documents(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([r for r in rows if r != (5, text(1, [3]))], key=repr)


def test_vectors_without_an_id_link(spark):
    draw = random.Random(4)
    base, other = ([draw.gauss(0, 1) for _ in range(64)] for _ in range(2))
    near = [x + draw.gauss(0, 0.02) for x in base]
    rows = [(3, base), (None, near), (8, [2 * x for x in base]), (None, other), (None, other), (5, [0.0] * 64), (None, None), (6, None), (2, [-x for x in base]), (9, [x + 0.001 for x in other])]
    found = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), WorkTables(spark, "caps")).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=repr)
    assert got == sorted(
        [(3, 2, 3, True), (None, 2, 3, False), (8, 2, 3, False), (None, 2, 9, False), (None, 2, 9, False), (5, 0, 5, True), (None, 0, None, True), (6, 0, 6, True), (2, 0, 2, True), (9, 2, 9, True)], key=repr
    )


# --- plans of mixing ---------------------------------------------------------


def cost(given, tokens):
    """What a pattern's use costs: each further quarter of a copy more than the one before."""
    total, left, k = 0, given, 0
    edges = [tokens * i // 4 for i in range(9)]
    while left > 0:
        part = min(left, edges[k + 1] - edges[k])
        total, left, k = total + part * (k + 1) ** 2, left - part, k + 1
    return total


def splits(patterns, members, targets):
    """Every way to route whole tokens from patterns to sources, by brute force."""
    arcs = [(name, source) for name in patterns for source in members[name]]

    def go(i, room, need):
        if i == len(arcs):
            yield {name: 2 * patterns[name] - room[name] for name in patterns}
            return
        name, source = arcs[i]
        for amount in range(min(room[name], need[source]) + 1):
            yield from go(i + 1, {**room, name: room[name] - amount}, {**need, source: need[source] - amount})

    yield from go(0, {name: 2 * n for name, n in patterns.items()}, dict(targets))


@pytest.mark.parametrize("seed", range(12))
def test_plan_costs_the_least(seed):
    """The flow gives the most tokens, and of such plans one of least cost, over overlapping sources and single ones."""
    draw = random.Random(seed)
    members = {"p": ["a"], "q": ["a", "b"], "r": ["b"], "s": ["c"]}
    patterns = {name: draw.randrange(0, 5) for name in members}
    targets = {source: draw.randrange(0, 8) for source in "abc"}
    given = mixing.plan(patterns, members, targets, 2)
    best = min(splits(patterns, members, targets), key=lambda g: (-sum(g.values()), sum(cost(g[n], patterns[n]) for n in g)))
    assert sum(given.values()) == sum(best.values())
    assert sum(cost(given[n], patterns[n]) for n in given) == sum(cost(best[n], patterns[n]) for n in best)


def test_many_single_patterns_need_no_search():
    n = 20_000
    patterns = {f"p{i}": 1 + i % 97 for i in range(n)}
    members = {f"p{i}": [f"s{i}"] for i in range(n)}
    targets = {f"s{i}": 1.5 * (1 + i % 97) for i in range(n)}
    start = time.perf_counter()
    given = mixing.plan(patterns, members, targets, 2)
    assert time.perf_counter() - start < 10
    assert all(given[f"p{i}"] == round(targets[f"s{i}"]) for i in range(n))


# --- predictions of the language operator -------------------------------------


def test_predictions_by_definition(spark):
    """Training and prediction against vectors added up letter by letter, with plain sums."""
    import numpy as np

    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (3, "Der Hund läuft", "de"), (4, None, "de"), (5, "12 3", "fr"), (6, "the dog", None), (7, "el gato", "es"), (7, "el gato", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.train(docs)
    assert profiles.languages == ("de", "en", "es", "fr")

    def vector(value):
        total = np.zeros(langid.DIMENSIONS)
        letters = langid.Letters()
        padded = f" {' '.join(langid.LETTERS.findall(value.lower()))} " if value else ""
        for i in range(len(padded) - langid.GRAM + 1):
            gram = np.ones(langid.DIMENSIONS)
            for k, letter in enumerate(padded[i : i + langid.GRAM]):
                gram *= np.roll(letters.table[letters.rows(np.array([ord(letter)]))[0]], langid.GRAM - 1 - k)
            total += gram
        size = np.sqrt((total**2).sum())
        return total / size if size and langid.LETTERS.search(value) else np.zeros(langid.DIMENSIONS)

    sums = {}
    for _, value, lang in rows:
        if lang is not None and value:
            sums[lang] = sums.get(lang, 0) + vector(value)
    prototypes = np.array([sums[x] / np.sqrt((sums[x] ** 2).sum()) for x in profiles.languages])
    got = docs.select("doc_id", "text", langid.predict(docs, profiles).alias("p")).collect()
    for r in got:
        own = vector(r.text or "")
        if not own.any():
            assert (r.p.lang_pred, r.p.score) == (langid.UNKNOWN, 0.0)
            continue
        cosines = prototypes @ own
        assert r.p.lang_pred == profiles.languages[int(cosines.argmax())]
        assert abs(r.p.score - min(1, max(0, cosines.max()))) < 1e-5
    assert langid.train(docs.limit(0)).languages == ()
    none = docs.limit(0)
    assert none.select(langid.predict(none, profiles)).count() == 0


def test_phrases_of_a_long_text_take_linear_time(spark):
    n = 400_000
    start = time.perf_counter()
    row = licenses.scan(documents(spark, [(1, "mit license apache license x " * n)])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (5 * n, 2 * n, 0, 5 * n - 3)
    assert time.perf_counter() - start < 120
