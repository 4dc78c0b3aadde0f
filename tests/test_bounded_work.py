"""What a task holds, and how often costly inputs are derived."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

from shelfspark.llm import langid
from shelfspark.operators import book_state, ledger, slices
from shelfspark.plans import upkeep
from shelfspark.session import work_folder
from shelfspark.sources import changes

from tests.test_ledger import asked, check, library, traffic


def counted(spark, df):
    """``df``, and an accumulator of the rows derived of it."""
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), rows


def test_replay_answers_batch_by_batch():
    shape = pa.schema(
        [("slice", pa.int32()), ("book_id", pa.int64()), ("user_id", pa.int64()), ("request_id", pa.int64()), ("at_us", pa.int64())]
        + [("code", pa.int32()), ("loan_id", pa.int64()), ("start", pa.bool_()), ("shelf", pa.bool_()), ("spans", pa.bool_())]
        + [("quantity", pa.int64()), ("held", pa.list_(pa.int64())), ("key", pa.int64())]
    )
    shelf = (0, 1, 0, None, None, None, None, True, True, False, 2, None, None)
    borrow = lambda i: (0, 1, i, i, i, book_state.BORROW, 100 + i, False, None, None, None, None, None)
    drawn = []

    def batches():
        for number, rows in enumerate(([shelf, borrow(1)], [borrow(2)], [borrow(3)])):
            drawn.append(number)
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, row, strict=True)) for row in rows], shape)

    answers = book_state.replay_sorted(batches())
    assert next(answers)["accepted"].to_pylist() == [True] and drawn == [0]
    assert next(answers)["accepted"].to_pylist() == [True] and drawn == [0, 1]
    assert next(answers)["accepted"].to_pylist() == [False]
    assert next(answers, None) is None


def test_contended_slices_run_once(spark, monkeypatch):
    """With more busy books than cores no slice runs from an assumed state before the last books are left."""
    runs, start_types = [], []
    replay, run = slices._BusyBooks._replay, slices._run
    monkeypatch.setattr(slices._BusyBooks, "_replay", lambda self, stock, held: runs.extend(stock) or replay(self, stock, held))
    monkeypatch.setattr(slices, "_run", lambda sliced, starts: start_types.extend(f.dataType for f in starts.schema) or run(sliced, starts))
    check(spark, {b: 1 for b in range(1, 11)}, [(900, 1, 1, "active"), (901, 2, 1, "active")], traffic(5, 400, 10, 6), slice_rows=14)
    assert len(set(runs)) > 20 and len(runs) <= 1.3 * len(set(runs))
    # Arrow's writer takes a time that grows with the square of a batch for null arrays.
    assert start_types and not any(isinstance(t, T.ArrayType) for t in start_types)


def test_requests_and_changes_are_derived_once(spark):
    rows = traffic(7, 60, 3, 8)
    before = library(spark, {b: 2 for b in range(1, 4)}, [(1000, 1, 1, "active"), (1001, 2, 1, "active")])
    requests, derived = counted(spark, asked(spark, rows))
    played = ledger.replay(before, requests)
    assert played.outcomes.count() == len(rows) == derived.value
    signed, derived = counted(spark, upkeep.loans_of_replay(before, played))
    kept = upkeep.updated(upkeep.keep(before), played.tables, signed)
    first = derived.value
    for table in (kept.members, kept.due, kept.books):
        table.collect()
    assert derived.value == first > 0


def test_ranges_derive_loans_once(spark):
    tables = library(spark, {1: 2}, [(1000, 1, 1, "active"), (1001, 2, 1, "active")])
    loans, derived = counted(spark, tables.borrows)
    home = work_folder(spark)
    changes.write_ranges(tables.replace(borrows=loans), home)
    assert derived.value == 2
    assert changes.read_ranges(spark, home).counters.where("tbl = 'borrows'").first().next_id == 1002


def test_limits_count_all_texts(spark):
    """Copies of an odd text count each: a sample by the hash of the text would take one."""
    plain = [(i, " ".join(f"{'abcdefgh'[(i + j) % 8]}an{'eiou'[j % 4]}" for j in range(20)) + " " + "xyz"[i % 3] * (i + 1), "aa") for i in range(60)]
    odd = [(100 + i, " ".join(chr(0x4E00 + 31 * j) * 3 for j in range(40)), "aa") for i in range(20)]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")
    profiles = langid.train(docs.where("doc_id < 100"))
    assert langid.limits(docs, profiles).grams is None


def test_limits_count_all_words(spark):
    """Half of the words look like no language: those that even distances from a start chosen by the hash of the text would pass over."""

    def text(i, parity):
        plain = [f"{'abcdefgh'[(i + j) % 8]}an{'eiou'[(i // 8 + j) % 4]}" for j in range(64)]
        odd = [chr(0x4E00 + 31 * j + i) * 3 for j in range(64)]
        return " ".join(x for pair in (zip(plain, odd) if parity == 0 else zip(odd, plain)) for x in pair)

    def passes_over(value, parity):
        return int((xxhash.xxh64_intdigest(value.encode(), langid.SEED) >> 1) % 1024 / 1024 * 2) == parity

    mixed = [(100 + i, value, "aa") for i in range(60) for parity in (0, 1) if passes_over(value := text(i, parity), parity)]
    plain = [(i, " ".join(f"{'abcdefgh'[(i + j) % 8]}an{'eiou'[(i // 8 + j) % 4]}" for j in range(64)), "aa") for i in range(32)]
    docs = spark.createDataFrame(plain + mixed, "doc_id long, text string, lang string")
    profiles = langid.train(docs.where("doc_id < 100"))
    assert len(mixed) > 20 and langid.limits(docs.where("doc_id < 100"), profiles).grams is not None
    assert langid.limits(docs, profiles).grams is None


def test_runs_equal_their_vectors(spark):
    """Every word is in runs of 1 to 64 words; sizes and likeness are those of the vectors, in blocks of any size and without a full cache."""
    rng = random.Random(1)
    # Of few letters, where n-grams are least like orthogonal; with long and repeated words; short and empty ones.
    words = ["".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(60)] + ["xyz" * 40, "a" * 9000, "\u0130n", "q"] + ["stone", "river"] * 9
    texts = [" ".join(rng.choices(words, k=n)).lower() for n in (0, 1, 2, 3, 5, 64, 65, 130, 300)]
    docs = spark.createDataFrame([(" ".join(rng.choices(words, k=30)), lang) for lang in ("aa", "bb")], "text string, lang string")
    profiles, noise = langid.train(docs), 0.45
    counted = langid.Runs(profiles, noise)
    counted.block_words, counted.table = 64, np.empty((300, 2))
    found, odd = counted.count(texts)
    for text, got, is_odd in zip(texts, found, odd, strict=True):
        spread = langid.spread_words(text)
        assert sorted(spread) == sorted(langid.LETTERS.findall(text))
        want, length, runs = np.zeros_like(got), 1, []
        while length <= langid.RUN_WORDS:
            for low in range(0, len(spread), langid.RUN_WORDS):
                part = spread[low : low + langid.RUN_WORDS]
                runs += [" ".join(part[k : k + length]) for k in range(0, len(part), length) if 2 * len(part[k : k + length]) > length]
            length *= 2
        if runs:
            for run, vector in zip(runs, langid.text_vectors(runs, langid.Letters()), strict=True):
                low = (vector @ profiles.prototypes.T).max() <= noise
                want[np.array(langid.LEAST_GRAMS) <= langid.effective_grams(run)] += (1, low)
            parts = [spread[k : k + langid.RUN_WORDS] for k in range(0, len(spread), langid.RUN_WORDS)]
            whole = langid.text_vectors([" ".join(part) for part in parts if len(part) >= langid.ODD_WORDS], langid.Letters())
            low = [x <= noise for x in (whole @ profiles.prototypes.T).max(axis=1, initial=-1)]
            assert is_odd == (2 * sum(low) > len(low))
        assert got.tolist() == want.tolist()
    assert 0 < found[:, 0, 1].sum() < found[:, 0, 0].sum()
