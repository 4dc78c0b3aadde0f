"""The lending rule itself, applied to one slice of requests inside a task."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T

# Tasks receive this module's functions with their code, so that executors work
# without the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BORROW, RETURN_HELD, RETURN_LOAN, RETURN_LOOSE = 0, 1, 2, 3
# Stands for a loan opened in an earlier slice.  Answers depend on whether a
# member holds such a loan, not on its key, so slices need not agree on keys.
INHERITED = -1
# Stands for a loan that is open by status but has come back: it blocks a borrow and cannot be returned.
STUCK = -2
# Rows on a member's state that are returned at once.
MEMBER_ROWS = 10_000

# What a replayed slice returns: an "answer" row per request and, for books that
# span slices, a "book" row and a "member" row per member with the state it used
# and the state it left.
_LONGS = T.ArrayType(T.LongType())
REPLAYED = T.StructType(
    [
        T.StructField("row", T.StringType()),
        T.StructField("slice", T.IntegerType()),
        T.StructField("book_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("at_us", T.LongType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("loan_id", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("start_quantity", T.LongType()),
        T.StructField("delta", T.LongType()),
        T.StructField("need", T.LongType()),
        T.StructField("refused", T.LongType()),
        T.StructField("held_in", _LONGS),
        T.StructField("held_out", _LONGS),
        T.StructField("opened", T.LongType()),
        T.StructField("key_in", T.LongType()),
        T.StructField("names_inherited", T.BooleanType()),
    ]
)
_ARROW = {
    T.StringType(): pa.string(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.BooleanType(): pa.bool_(),
    _LONGS: pa.list_(pa.int64()),
}
# What a start row tells: the book's shelf, or a loan that a member holds.
_START = ("user_id", "shelf", "spans", "assumed", "quantity", "loan_id", "key")
_SHAPE = pa.schema([(f.name, _ARROW[f.dataType]) for f in REPLAYED])


class BookState:
    """Stock and open loans of the books one slice (or one stream key) covers."""

    def __init__(
        self,
        stock: dict[int, int],
        held: dict[tuple[int, int], list[int]],
        keys: dict[tuple[int, int], int] | None = None,
    ):
        self.stock = stock
        self.held = held
        # The key of a member's inherited loan, and the members whose answers depend on it.
        self.keys = keys or {}
        self.names_inherited: set[tuple[int, int]] = set()
        self.lowest = dict(stock)
        self.refused: dict[int, int] = {}

    def answer(self, book: int, user: int, code: int, loan: int) -> tuple[bool, int]:
        """Apply one request; returns (admitted, loan opened or closed)."""
        accepted, loans = self.answer_all(book, [user], [code], [loan])
        return accepted[0], loans[0]

    def answer_all(self, book: int, users: list[int], codes: list[int], named: list[int]) -> tuple[list[bool], list[int]]:
        """Apply requests for one book in their order; returns for each whether it is admitted and the loan it opens or closes.

        A member without a loan is not kept.
        """
        held, left, lowest, refused = self.held, self.stock.get(book) or 0, self.lowest.get(book), 0
        lowest = left if lowest is None else lowest
        accepted, loans = [False] * len(users), [0] * len(users)
        for i, (user, code, loan) in enumerate(zip(users, codes, named)):
            member = (book, user)
            if code == BORROW:
                if member in held:
                    continue
                if left <= 0:
                    refused += 1
                    continue
                left -= 1
                lowest = min(lowest, left)
                held[member] = [loan]
            elif code == RETURN_LOOSE:
                left += 1
            else:
                mine = held.get(member)
                if not mine:
                    continue
                closed = loan
                if code == RETURN_HELD:
                    closed = loan = next((one for one in mine if one != STUCK), STUCK)
                elif loan not in mine and INHERITED in mine and loan not in (INHERITED, STUCK):
                    self.names_inherited.add(member)
                    if loan == self.keys.get(member):
                        closed = INHERITED
                elif loan == INHERITED:
                    continue
                if closed == STUCK or closed not in mine:
                    continue
                rest = [one for one in mine if one != closed]
                if rest:
                    held[member] = rest
                else:
                    del held[member]
                left += 1
            accepted[i], loans[i] = True, loan
        self.stock[book], self.lowest[book] = left, lowest
        if refused:
            self.refused[book] = self.refused.get(book, 0) + refused
        return accepted, loans


def _values(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def replay_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers, and for books that span slices the state each slice leaves.

    ``batches`` are one task's start rows and requests, sorted by slice, book, start rows first, and time.  A task holds
    one batch and the state of one book in one slice, whatever number of books and requests it gets.
    """
    current, state = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        where = [table[c].to_numpy() for c in ("slice", "book_id", "start")]
        changes = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in where])) + 1
        asked, starts = table, iter(())
        if where[2].any():
            asked = table.filter(pc.invert(table["start"]))
            starts = iter(table.filter(table["start"]).select([c for c in _START if c in table.column_names]).to_pylist())
        users, codes, named = (_values(asked[c]) for c in ("user_id", "code", "loan_id"))
        accepted, loans = [], []
        firsts = [0, *changes.tolist()] if batch.num_rows else []
        for low, high, number, book, start in zip(firsts, [*firsts[1:], batch.num_rows], *(x[firsts].tolist() for x in where)):
            if (number, book) != current:
                if state is not None:
                    yield from state.left()
                current, state = (number, book), _Slice(number, book)
            if start:
                for row in itertools.islice(starts, high - low):
                    state.begin(**row)
                continue
            some = slice(len(accepted), len(accepted) + high - low)
            ok, closed = state.answer(users[some], codes[some], named[some])
            accepted += ok
            loans += closed
        if accepted:
            kept = ("slice", "book_id", "user_id", "request_id", "at_us", "code")
            yield from _rows("answer", len(accepted), **{c: asked[c] for c in kept}, accepted=accepted, loan_id=loans)
    if state is not None:
        yield from state.left()


class _Slice:
    """One book in one slice: its start rows, its requests, and what they leave."""

    def __init__(self, number: int, book: int):
        self.number, self.book, self.spans, self.assumed, self.asked = number, book, False, False, False
        self.state = BookState({}, {})
        self.start_quantity: int | None = None
        self.held_in: dict[int, list[int]] = {}

    def begin(self, user_id: int, shelf: bool, spans: bool, quantity: int | None, loan_id: int, key: int | None, assumed: bool = True) -> None:
        if shelf:
            self.spans, self.assumed = spans, assumed
            self.start_quantity = self.state.stock[self.book] = self.state.lowest[self.book] = quantity
        else:
            self.state.held.setdefault((self.book, user_id), []).append(loan_id)
            if key is not None:
                self.state.keys[self.book, user_id] = key

    def answer(self, users: list[int], codes: list[int], loans: list[int]) -> tuple[list[bool], list[int]]:
        if self.spans and self.assumed:
            for user in set(users).difference(self.held_in):
                self.held_in[user] = self.state.held.get((self.book, user), [])
        elif self.spans and not self.asked:
            self.held_in = {user: held for (_, user), held in self.state.held.items()}
        self.asked = True
        return self.state.answer_all(self.book, users, codes, loans)

    def left(self) -> Iterator[pa.RecordBatch]:
        """The state at the end, of books that span slices and were asked for.

        Where the state at the start was assumed, it is that of each member who asked, for comparison; else of those
        who held a loan at the start or hold one at the end.
        """
        if not (self.spans and self.asked):
            return
        state, book = self.state, self.book
        members = list(self.held_in)
        if not self.assumed:
            members += [user for _, user in state.held if user not in self.held_in]
        for low in range(0, len(members), MEMBER_ROWS):
            some = members[low : low + MEMBER_ROWS]
            before = [self.held_in.get(user, []) for user in some]
            held = [state.held.get((book, user), []) for user in some]
            yield from _rows(
                "member",
                len(some),
                slice=[self.number] * len(some),
                book_id=[book] * len(some),
                user_id=some,
                held_in=before,
                held_out=[_as_inherited(loans, old) for loans, old in zip(held, before)],
                opened=[_opened(loans, old) for loans, old in zip(held, before)],
                key_in=[state.keys.get((book, user)) for user in some],
                names_inherited=[(book, user) in state.names_inherited for user in some],
            )
        yield from _rows(
            "book",
            1,
            slice=[self.number],
            book_id=[book],
            start_quantity=[self.start_quantity],
            delta=[state.stock[book] - self.start_quantity],
            need=[self.start_quantity - state.lowest[book]],
            refused=[state.refused.get(book, 0)],
        )


def _as_inherited(loans: list[int], before: list[int]) -> list[int]:
    """Loans with those opened since ``before`` under the key of inherited ones."""
    return [loan if loan in before else INHERITED for loan in loans]


def _opened(loans: list[int], before: list[int]) -> int | None:
    return next((loan for loan in loans if loan not in before), None)


def _rows(row: str, n: int, **columns: list | pa.ChunkedArray) -> list[pa.RecordBatch]:
    """``n`` rows of one kind in the shape of ``REPLAYED``; the rest is NULL."""
    columns["row"] = [row] * n
    arrays = []
    for field in _SHAPE:
        values = columns.get(field.name)
        if values is None:
            values = pa.nulls(n, field.type)
        elif isinstance(values, list):
            values = pa.array(values, field.type)
        arrays.append(values)
    return pa.table(arrays, schema=_SHAPE).to_batches()
