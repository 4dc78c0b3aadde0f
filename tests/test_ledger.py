"""The ledger against a serial replay written apart from it, in batch and as a stream."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.operators import book_state, ledger, slices
from shelfspark.schema import BOOKS, BORROWS, GENRES, LEDGER_REQUEST, USERS
from shelfspark.session import work_folder
from shelfspark.sources import files
from shelfspark.streaming.ledger import ArrivalLedger, answer_arrivals
from shelfspark.tables import Tables

START = dt.datetime(2026, 5, 1, 9)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def is_back(status, back=None):
    return status == "returned" if back is None else back


def library(spark, stock, loans=(), members=range(1, 60), admins=()):
    """loans: (id, user, book, status), and whether it is back where that differs from the status"""
    due = dt.date(2026, 5, 8)
    books = [(b, f"B{b}", "", q, None, START) for b, q in stock.items()]
    borrows = [
        (i, u, b, START, due, START if is_back(status, *back) else None, status)
        for i, u, b, status, *back in loans
    ]
    users = [(u, f"u{u}", "", "admin" if u in admins else "user", START) for u in members]
    return Tables(
        books=spark.createDataFrame(books, BOOKS),
        borrows=spark.createDataFrame(borrows, BORROWS),
        genres=spark.createDataFrame([], GENRES),
        users=spark.createDataFrame(users, USERS),
    )


def asked(spark, rows):
    """rows: (request_id, second, user, kind, book, loan)"""
    return spark.createDataFrame([(i, at(s), *rest) for i, s, *rest in rows], LEDGER_REQUEST)


def one_by_one(stock, loans, rows, new_id):
    """Every request on its own, in order, over plain lists of loans."""
    stock = dict(stock)
    out = [
        {"id": i, "user": u, "book": b, "blocks": status != "returned", "due": not is_back(status, *back)}
        for i, u, b, status, *back in loans
    ]
    answers = {}
    for i, _, user, kind, book, loan in sorted(rows, key=lambda row: (row[1], row[0])):
        if kind == "borrow":
            has = any(x["user"] == user and x["book"] == book and x["blocks"] for x in out)
            ok = stock.get(book, 0) > 0 and not has
            if ok:
                stock[book] -= 1
                out.append({"id": new_id(i), "user": user, "book": book, "blocks": True, "due": True})
            answers[i] = "borrowed" if ok else "unavailable"
            continue
        if loan is not None:
            match = [x for x in out if x["id"] == loan and x["user"] == user and x["due"]]
        else:
            match = [x for x in out if x["user"] == user and x["book"] == book and x["blocks"] and x["due"]]
        if match:
            out.remove(match[0])
            stock[match[0]["book"]] += 1
        answers[i] = "returned" if match else "no_such_loan"
    return answers, stock, {(x["id"], x["user"], x["book"]) for x in out if x["blocks"]}


def check(spark, stock, loans, rows, **options):
    tables = library(spark, stock, loans)
    replayed = ledger.replay(tables, asked(spark, rows), **options)
    first = min(row[0] for row in rows)
    top = max((x[0] for x in loans), default=0)
    answers, left, out = one_by_one(stock, loans, rows, lambda i: top + 1 + i - first)
    assert {x.request_id: x.outcome for x in replayed.outcomes.collect()} == answers
    assert {x.id: x.quantity for x in replayed.tables.books.collect()} == left
    still = replayed.tables.borrows.where("status <> 'returned'")
    assert {(x.id, x.user_id, x.book_id) for x in still.collect()} == out
    # Copies are neither made nor lost.
    if all(len(x) == 4 for x in loans):
        was_out = sum(x[3] != "returned" for x in loans)
        assert sum(left.values()) + len(out) == sum(stock.values()) + was_out
    assert min(left.values()) >= 0
    return replayed


def test_golden_small(spark):
    order = [(7, "borrow"), (7, "borrow"), (8, "borrow"), (9, "borrow"), (7, "return"), (9, "borrow")]
    rows = [(i, i, user, kind, 1, None) for i, (user, kind) in enumerate(order)]
    replayed = check(spark, {1: 2}, [], rows)
    accepted = [
        x.outcome in ("borrowed", "returned") for x in replayed.outcomes.orderBy("request_id").collect()
    ]
    assert accepted == [True, False, True, False, True, True]
    assert {x.user_id for x in replayed.tables.borrows.where("status = 'active'").collect()} == {8, 9}


def test_named_returns(spark):
    loans = [(100, 1, 1, "active"), (101, 2, 1, "overdue"), (102, 3, 2, "returned")]
    rows = [
        (1, 1, 2, "return", None, 100),  # not the owner
        (2, 2, 1, "return", None, 100),
        (3, 3, 1, "return", None, 100),  # a second time
        (4, 4, 2, "return", None, 101),  # overdue loans go back too
        (5, 5, 3, "return", None, 102),  # was back before
        (6, 6, 1, "borrow", 1, None),
        (7, 7, 1, "return", None, 100),  # the old loan, not the new one
        (8, 8, 4, "return", None, 999),
        (9, 9, 5, "borrow", 77, None),  # no such book
    ]
    replayed = check(spark, {1: 0, 2: 1}, loans, rows)
    texts = {x.request_id: x.message for x in replayed.outcomes.collect()}
    assert texts[2] == "Book returned successfully. Thank you!"
    assert texts[6] == "Book borrowed! Due back on 2026-05-08."
    assert texts[9] == "Book unavailable or you already have it borrowed."
    assert texts[1] == ""
    loan = replayed.tables.borrows.where("id = 100").first()
    assert (loan.status, loan.returned_at) == ("returned", at(2))


@pytest.mark.parametrize("options", [{}, {"slice_rows": 2}])
def test_return_of_a_loan_opened_in_the_batch(spark, options):
    rows = [
        (1, 1, 4, "return", None, 9),  # before request 2 opens it
        (2, 2, 4, "borrow", 1, None),  # loan 9
        (3, 3, 5, "return", None, 9),  # not the owner
        (4, 4, 4, "return", None, 9),
        (5, 5, 4, "return", None, 9),  # a second time
        (6, 6, 4, "borrow", 1, None),  # loan 13
        (7, 7, 4, "borrow", 1, None),  # refused, so there is no loan 14
        (8, 8, 4, "return", None, 14),
        (9, 9, 4, "return", None, 13),
    ]
    replayed = check(spark, {1: 1}, [(7, 3, 1, "active")], rows, **options)
    done = {x.request_id for x in replayed.outcomes.collect() if x.outcome == "returned"}
    assert done == {4, 9}


@pytest.mark.parametrize("stock", [2, 40])
def test_named_returns_of_new_loans_in_slices(spark, stock):
    rows, rng = traffic(21, 160, 2, 9, hot_share=0.7), random.Random(3)
    first = min(row[0] for row in rows)
    asked_for = {}
    for at_row, (i, second, user, kind, book, loan) in enumerate(rows):
        if kind == "borrow":
            asked_for.setdefault(user, []).append(501 + i - first)
        elif user in asked_for and rng.random() < 0.7:
            rows[at_row] = (i, second, user, kind, None, rng.choice(asked_for[user][-2:]))
    check(spark, {1: stock, 2: stock}, [(500, 1, 1, "active")], rows, slice_rows=40)


@pytest.mark.parametrize("options", [{}, {"slice_rows": 3}])
def test_status_blocks_and_return_time_returns(spark, options):
    loans = [(1, 1, 1, "returned", False), (2, 2, 1, "active", True), (3, 3, 1, "overdue", False)]
    rows = [
        (1, 1, 1, "borrow", 1, None),  # its old loan does not block
        (2, 2, 2, "borrow", 1, None),  # blocked by status alone
        (3, 3, 2, "return", None, 2),  # has come back
        (4, 4, 2, "return", 1, None),
        (5, 5, 1, "return", None, 1),  # still due, whatever its status
        (6, 6, 1, "return", None, 1),
        (7, 7, 2, "return", None, 1),
        (8, 8, 3, "return", None, 3),
    ]
    replayed = check(spark, {1: 5}, loans, rows, **options)
    done = {x.request_id for x in replayed.outcomes.collect() if x.outcome in ("borrowed", "returned")}
    assert done == {1, 5, 8}


def test_only_members_may_ask(spark):
    tables = library(spark, {1: 5}, members=[1, 2], admins=[2])
    rows = [(1, 1, 1, "borrow", 1, None), (2, 2, 2, "borrow", 1, None), (3, 3, 9, "borrow", 1, None), (4, 4, 1, "renew", 1, None)]
    found = {x.request_id: x.outcome for x in ledger.replay(tables, asked(spark, rows)).outcomes.collect()}
    assert found == {1: "borrowed", 2: "forbidden", 3: "forbidden", 4: "unknown_kind"}


def traffic(seed, n, books, users, hot_share=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        book = 1 if rng.random() < hot_share else rng.randrange(1, books + 1)
        kind = "borrow" if rng.random() < 0.55 else "return"
        # Several requests share a second, so that the id decides their order.
        rows.append((i, i // 3, rng.randrange(1, users + 1), kind, book, None))
    return rows


@pytest.mark.parametrize("stock", [1, 3, 400])
def test_busy_book_in_slices(spark, stock, monkeypatch):
    """One book draws most requests and is cut into many slices."""
    runs = []
    replay = slices._BusyBooks._replay
    monkeypatch.setattr(
        slices._BusyBooks, "_replay", lambda self, stock, held: runs.append(len(stock)) or replay(self, stock, held)
    )
    rows = traffic(stock, 1500, 6, 50, hot_share=0.7)
    loans = [(1000, 1, 1, "active"), (1001, 2, 1, "overdue"), (1002, 1, 2, "active")]
    check(spark, {b: stock for b in range(1, 6)}, loans, rows, slice_rows=120)
    # Even where every answer depends on the ones before, work stays linear.
    assert sum(runs) <= 5 * runs[0]


def test_slices_settle_in_one_more_round_while_stock_lasts(spark, monkeypatch):
    rounds = []
    whole = slices._BusyBooks._replay
    monkeypatch.setattr(slices._BusyBooks, "_replay", lambda *a: rounds.append(1) or whole(*a))
    rows = [(i, i, i % 59 + 1, "borrow" if i % 118 < 59 else "return", 1, None) for i in range(590)]
    check(spark, {1: 1000}, [], rows, slice_rows=118)
    assert len(rounds) <= 2


def test_missing_busy_book_is_refused(spark):
    rows = [(i, i, i % 50 + 1, "borrow", 9, None) for i in range(60)] + [(100, 100, 1, "borrow", 1, None)]
    check(spark, {1: 1}, [], rows, slice_rows=20)


def test_keys_beyond_53_bits_stay_exact(spark):
    base = 2**60 + 1
    rows = [(base + i, i, i % 5 + 1, "borrow" if i % 2 else "return", base, None) for i in range(60)]
    loans = [(base + 7, 1, base, "active")]
    rows.append((base + 1000, 500, 1, "return", None, base + 7))
    check(spark, {base: 2}, loans, rows)
    check(spark, {base: 2}, loans, rows, slice_rows=15)


@settings(max_examples=200, deadline=None)
@given(
    st.integers(0, 3),
    st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["borrow", "return"])), max_size=40),
)
def test_state_equals_serial_rule(stock, moves):
    state = book_state.BookState({1: stock}, {})
    rows = [(i, i, user, kind, 1, None) for i, (user, kind) in enumerate(moves)]
    want, left, out = one_by_one({1: stock}, [], rows, lambda i: i + 1)
    codes = {"borrow": book_state.BORROW, "return": book_state.RETURN_HELD}
    for i, _, user, kind, book, _ in rows:
        assert state.answer(book, user, codes[kind], i + 1)[0] == (want[i] in ("borrowed", "returned"))
    assert state.stock[1] == left[1] >= 0
    held = {(loan, user, book) for (book, user), loans in state.held.items() for loan in loans}
    assert held == out


def arrival_batches(spark, tables, batches, slice_rows):
    """Two files arrive at a time, each a trigger of its own."""
    folder = work_folder(spark)
    for number, rows in enumerate(batches):
        asked(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{number}")
        if number % 2 or number == len(batches) - 1:
            arriving = files.stream_requests(spark, f"{folder}/in/*", "ledger", max_files=1)
            answer_arrivals(tables, arriving, folder, slice_rows)
    return spark.read.parquet(f"{folder}/outcomes").collect()


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_arrivals_out_of_order_are_all_answered(spark, slice_rows):
    rows = traffic(5, 300, 4, 20)
    random.Random(3).shuffle(rows)
    rows.append((900, -50, 30, "return", None, 1002))
    loans = [(1000, 1, 1, "active"), (1001, 2, 1, "overdue"), (1002, 30, 2, "active")]
    tables = library(spark, {b: 3 for b in range(1, 5)}, loans)
    batches = [rows[:120], rows[120:200], rows[200:]]
    got = arrival_batches(spark, tables, batches, slice_rows)
    # Serially: each trigger wholly after the one before.
    inorder = [(i, number * 10**6 + s, *rest) for number, batch in enumerate(batches) for i, s, *rest in batch]
    want, _, _ = one_by_one({b: 3 for b in range(1, 5)}, loans, inorder, lambda i: 1003 + i)
    assert len(got) == len(rows)
    assert {x.request_id: x.outcome for x in got} == want
    assert sum(x.late and x.outcome in ("borrowed", "returned") for x in got) > 10
    by_id = {i: (number, s, book) for number, batch in enumerate(batches) for i, s, _, _, book, _ in batch}
    by_id[900] = (2, -50, 2)
    for x in got:
        number, second, book = by_id[x.request_id]
        earlier = [(s, i) for i, (n, s, b) in by_id.items() if n < number and b == book]
        if x.outcome in ("borrowed", "returned"):
            assert x.late == (max(earlier, default=(-100, 0)) > (second, x.request_id))


def test_arrivals_return_loans_of_earlier_triggers(spark):
    tables = library(spark, {1: 1}, [(1, 7, 1, "returned", False), (2, 8, 1, "active", True)])
    batches = [
        [(0, 50, 5, "borrow", 1, None)],
        [(1, 10, 5, "return", None, 3), (2, 11, 7, "return", None, 1)],
        [(3, 5, 7, "return", None, 1), (4, 6, 8, "borrow", 1, None), (5, 7, 5, "return", None, 3), (6, 8, 6, "borrow", 1, None)],
    ]
    got = {x.request_id: (x.outcome, x.late) for x in arrival_batches(spark, tables, batches, 1_000_000)}
    assert {i: outcome for i, (outcome, _) in got.items()} == {
        0: "borrowed", 1: "returned", 2: "returned", 3: "no_such_loan", 4: "unavailable", 5: "no_such_loan", 6: "borrowed",
    }
    assert not got[0][1] and got[1][1] and got[2][1] and got[6][1]


def test_arrivals_equal_a_batch_in_order(spark):
    rows = traffic(5, 300, 4, 20)
    loans = [(1000, 1, 1, "active"), (1001, 2, 1, "overdue"), (1002, 30, 2, "active")]
    rows.append((900, 1000, 30, "return", None, 1002))
    tables = library(spark, {b: 3 for b in range(1, 5)}, loans)
    got = arrival_batches(spark, tables, [rows[:100], rows[100:200], rows[200:]], 1_000_000)
    batch = ledger.replay(tables, asked(spark, rows)).outcomes.collect()
    assert {x.request_id: (x.outcome, x.message) for x in got} == {x.request_id: (x.outcome, x.message) for x in batch}
    assert not any(x.late for x in got)


def test_arrivals_return_loans_by_their_owner_only(spark):
    loans = [(1, 7, 1, "returned", False), (2, 8, 1, "active", True)]
    tables = library(spark, {1: 1}, loans)
    first = [(0, 10, 5, "borrow", 1, None), (1, 11, 7, "return", 1, 1), (2, 12, 8, "borrow", 1, None)]
    second = [(3, 20, 6, "return", 1, 3), (4, 21, 5, "return", 1, 3), (5, 22, 5, "return", 1, 3), (6, 23, 7, "return", 1, 1)]
    got = {x.request_id: x.outcome for x in arrival_batches(spark, tables, [first, second], 1_000_000)}
    want, _, _ = one_by_one({1: 1}, loans, first + second, lambda i: 3 + i)
    assert got == want and {i for i in got if got[i] == "returned"} == {1, 4}


def test_a_trigger_writes_what_it_changed_and_no_more(spark):
    """Nine triggers of as many requests each: rows written do not grow, compactions leave the answers alone."""
    rows = traffic(9, 270, 6, 40)
    tables = library(spark, {b: 4 for b in range(1, 7)}, [(1000, 1, 1, "active")])
    folder = work_folder(spark)
    for number in range(9):
        asked(spark, rows[30 * number : 30 * number + 30]).coalesce(1).write.parquet(f"{folder}/in/{number}")
    arriving = files.stream_requests(spark, f"{folder}/in/*", "ledger", max_files=1)
    answer_arrivals(tables, arriving, folder, compact_every=4)
    got = spark.read.parquet(f"{folder}/outcomes").collect()
    want, left, out = one_by_one({b: 4 for b in range(1, 7)}, [(1000, 1, 1, "active")], rows, lambda i: 1001 + i)
    assert {x.request_id: x.outcome for x in got} == want and len(got) == len(rows)
    for number in range(9):
        written = sum(spark.read.parquet(f"{folder}/changes/{name}/trigger={number}").count() for name in ("opened", "closed", "books"))
        assert written <= 2 * 30 + 6
    at_end = ArrivalLedger(tables, folder, compact_every=4)
    assert at_end.compacted == 7 and at_end.since == [8] and at_end.answer_recorded() == 0
    state = at_end.state()
    assert {(r.id, r.user_id, r.book_id) for r in state["opened"].collect()} == {x for x in out if x[0] != 1000}
    assert {r.book_id: 4 + r.delta for r in state["books"].collect()} == {b: left[b] for b in {r[4] for r in rows if r[4]}}


def test_a_trigger_cut_off_is_answered_again(spark):
    rows = traffic(3, 80, 3, 10)
    tables = library(spark, {b: 2 for b in range(1, 4)}, [])
    folder = work_folder(spark)
    for number in range(2):
        asked(spark, rows[40 * number : 40 * number + 40]).coalesce(1).write.parquet(f"{folder}/in/{number}")
    arriving = files.stream_requests(spark, f"{folder}/in/*", "ledger", max_files=1)
    marked = ArrivalLedger._mark

    def cut_off(self, number):
        if number == 1:
            raise RuntimeError("lost")
        marked(self, number)

    ArrivalLedger._mark = cut_off
    try:
        with pytest.raises(RuntimeError):
            answer_arrivals(tables, arriving, folder)
    finally:
        ArrivalLedger._mark = marked
    answer_arrivals(tables, arriving, folder)
    want, _, _ = one_by_one({b: 2 for b in range(1, 4)}, [], rows, lambda i: 1 + i)
    got = spark.read.parquet(f"{folder}/outcomes").collect()
    assert len(got) == len(rows) and {x.request_id: x.outcome for x in got} == want


def test_requests_are_answered_while_the_stream_runs(spark):
    """With an interval the call goes on; what has arrived is answered before it ends."""
    rows = traffic(3, 40, 3, 10)
    tables = library(spark, {b: 2 for b in range(1, 4)}, [])
    folder = work_folder(spark)
    asked(spark, rows[:20]).coalesce(1).write.parquet(f"{folder}/in/0")
    arriving = files.stream_requests(spark, f"{folder}/in/*", "ledger")
    answered = ArrivalLedger._answer
    seen = []

    def watch(self, number, requests):
        answered(self, number, requests)
        seen.append([q.isActive for q in spark.streams.active])
        if number == 0:
            asked(spark, rows[20:]).coalesce(1).write.parquet(f"{folder}/in/1")
        else:
            for query in spark.streams.active:
                query.stop()

    ArrivalLedger._answer = watch
    try:
        answer_arrivals(tables, arriving, folder, every="1 second")
    finally:
        ArrivalLedger._answer = answered
    assert seen == [[True], [True]]
    want, _, _ = one_by_one({b: 2 for b in range(1, 4)}, [], rows, lambda i: 1 + i)
    assert {x.request_id: x.outcome for x in spark.read.parquet(f"{folder}/outcomes").collect()} == want
