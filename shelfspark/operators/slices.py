"""Replaying slices of requests: whole books at once, busy books in rounds.

A book with a moderate number of requests is replayed whole, many in parallel.

A busy book may draw a third of all requests and is never one task.  Its
requests are range-partitioned by (book, time) into slices of bounded size.  A
slice can be replayed on its own once the state at its start is known.  Behind a
book's *frontier* each slice started from what the slices before it left, so its
answers are those of a serial replay.  Every round runs the slice at the frontier
of each book, from the true state, and moves the frontier over it.

Cores that this leaves idle, as there are fewer busy books than cores, look ahead:
they run the next slices of a book from an assumed state, each reports the state
it leaves, and the frontier also moves over those whose assumption held; the wrong
ones run again.  While stock lasts, answers do not depend on its exact level, nor on
loan keys, so the second run already settles them.  Where a book is contended, every
answer depends on those before; there the frontier moves slice by slice, and
the look-ahead shrinks with its pace so that a slice runs twice or so and not
once per round.  The state carried along is the stock and the open loans: no more
than the book has copies, besides loans from before of members who ask.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.loans import is_open
from shelfspark.operators import ample
from shelfspark.operators.book_state import BORROW, INHERITED, REPLAYED, STUCK, replay_sorted
from shelfspark.session import work_folder, write_and_reread
from shelfspark.tables import Tables

PAIR = ["slice", "book_id"]
_STORED = T.StructType([*REPLAYED, T.StructField("round", T.IntegerType())])


def blocking(tables: Tables) -> DataFrame:
    """(book_id, user_id, id): loans that block another borrow, those open by status.

    One that has come back all the same cannot be returned and carries ``STUCK`` for its key.
    """
    key = F.when(F.col("returned_at").isNull(), F.col("id")).otherwise(F.lit(STUCK))
    return tables.borrows.where(is_open("status")).select(
        "book_id", "user_id", key.cast("long").alias("id")
    )


def _loans_before(tables: Tables, requests: DataFrame, books: DataFrame) -> DataFrame:
    """(book, user, held, key): loans from before of the few ``books``, of members who ask for them."""
    loans = blocking(tables).join(books, "book_id", "left_semi")
    members = requests.select("book_id", "user_id").join(loans.select("book_id", "user_id").distinct(), ["book_id", "user_id"]).distinct()
    return (
        loans.join(members, ["book_id", "user_id"])
        .groupBy("book_id", "user_id")
        # The admission rule keeps this list at one loan per member and book.
        .agg(F.sort_array(F.collect_list("id")).alias("held"))
        .withColumn("key", F.lit(None).cast("long"))
    )


def _start_rows(stock: DataFrame, held: DataFrame, spans: bool) -> DataFrame:
    """A row per book, and one per loan that is ``held``; ``stock`` of books that span slices tells where it is ``assumed``."""
    shelf = stock.select(
        *PAIR,
        F.lit(0).cast("long").alias("user_id"),
        F.lit(True).alias("shelf"),
        F.lit(spans).alias("spans"),
        F.col("assumed") if spans else F.lit(False).alias("assumed"),
        F.col("quantity").cast("long").alias("quantity"),
        F.lit(None).cast("long").alias("loan_id"),
        F.lit(None).cast("long").alias("key"),
    )
    loans = held.select(
        *PAIR,
        "user_id",
        F.lit(False).alias("shelf"),
        F.lit(False).alias("spans"),
        F.lit(False).alias("assumed"),
        F.lit(0).cast("long").alias("quantity"),
        "loan_id",
        "key",
    )
    rows = shelf.unionByName(loans)
    # Fresh column identities: the rows meet the requests they stem from again.
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def _run(sliced: DataFrame, starts: DataFrame) -> DataFrame:
    """Replays each slice in one task, which reads it in order and keeps the state of one book at a time."""
    asked = ("slice", "book_id", "user_id", "request_id", "at_us", "code", "loan_id")
    requests = sliced.select(*asked).withColumn("start", F.lit(False))
    rows = requests.unionByName(starts.withColumn("start", F.lit(True)), allowMissingColumns=True)
    order = ("slice", "book_id", F.desc("start"), F.asc_nulls_last("at_us"), F.asc_nulls_last("request_id"), "loan_id")
    # No column holds arrays: Arrow's writer takes a time that grows with the square of a batch for null ones.
    return rows.repartition("slice").sortWithinPartitions(*order).mapInArrow(replay_sorted, REPLAYED)


def answer(tables: Tables, events: DataFrame, slice_rows: int) -> DataFrame:
    """The answer to each request of ``events``.

    Books whose stock cannot run out need no replay; see ``shelfspark.operators.ample``.
    """
    spark = events.sparkSession
    stock = tables.books.select(F.col("id").alias("book_id"), "quantity")
    borrows = F.sum((F.col("code") == BORROW).cast("long"))
    sizes = events.groupBy("book_id").agg(F.count("*").alias("n"), borrows.alias("borrows")).join(stock, "book_id", "left")
    folds = ample.cannot_run_out(F.col("quantity"), F.col("borrows"), F.col("n")) & (F.col("n") <= slice_rows)
    sizes = write_and_reread(sizes.select("book_id", "n", "quantity", folds.alias("folds")), work_folder(spark))
    # Busy books have more than slice_rows requests: there are fewer than count / slice_rows of them.
    busy_book = F.when(F.col("n") > slice_rows, F.struct("book_id", "n", "quantity"))
    replayed, folded, busy = sizes.agg(
        F.coalesce(F.sum(F.when(~F.col("folds"), F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.col("folds").cast("int")), F.lit(0)),
        F.collect_list(busy_book),
    ).first()
    parts = []
    # Requests that are answered have a book and a member.  Said here, it makes the joins below read one shuffle of each table.
    known = F.col("book_id").isNotNull() & F.col("user_id").isNotNull()
    events, loans = events.where(known), blocking(tables).where(known)
    if folded:
        free = sizes.where("folds").select("book_id")
        mine = events.join(free, "book_id", "left_semi")
        parts.append(ample.fold_members(mine, loans.join(free, "book_id", "left_semi")))
        events = events.join(free, "book_id", "left_anti")
    slices = max(spark.sparkContext.defaultParallelism, math.ceil(replayed / slice_rows))
    if busy:
        books = F.broadcast(spark.createDataFrame([(row.book_id,) for row in busy], "book_id long"))
        hot = events.join(books, "book_id", "left_semi")
        events = events.join(books, "book_id", "left_anti")
        hot_slices = math.ceil(sum(row.n for row in busy) / slice_rows)
        hot_stock = {row.book_id: row.quantity or 0 for row in busy}
        parts.append(_BusyBooks(tables, hot, hot_slices, hot_stock).answers())
    if replayed > sum(row.n for row in busy):
        parts.append(_whole_books(tables, loans, sizes, events, slices, slice_rows))
    answers = parts.pop() if parts else _whole_books(tables, loans, sizes, events, slices, slice_rows)
    answers = answers.select(*ample.ANSWER)
    for part in parts:
        answers = answers.unionByName(part.select(*ample.ANSWER))
    return answers


def _whole_books(tables: Tables, loans: DataFrame, sizes: DataFrame, events: DataFrame, slices: int, slice_rows: int) -> DataFrame:
    """One pass; each slice takes all requests of some books."""
    number = F.pmod(F.xxhash64("book_id"), F.lit(slices)).cast("int")
    books = sizes.where(~F.col("folds") & (F.col("n") <= slice_rows)).select("book_id").distinct()
    shelves = books.join(tables.books.select(F.col("id").alias("book_id"), "quantity"), "book_id").withColumn("slice", number)
    held = loans.join(books, "book_id", "left_semi").select(number.alias("slice"), "book_id", "user_id", F.col("id").alias("loan_id"), F.lit(None).cast("long").alias("key"))
    starts = _start_rows(shelves, held, spans=False)
    return _run(events.withColumn("slice", number), starts).where("row = 'answer'")


@dataclasses.dataclass
class _Frontier:
    """How far a book is settled: the first ``settled`` of its slices."""

    slices: list[int]
    stock: int
    settled: int = 0
    look_ahead: int = 1

    @property
    def window(self) -> list[int]:
        return self.slices[self.settled : self.settled + self.look_ahead]


class _BusyBooks:
    """The rounds.  The driver keeps a few numbers per slice and none per request."""

    def __init__(self, tables: Tables, events: DataFrame, slices: int, stock: dict[int, int]):
        self.spark = events.sparkSession
        self.folder = work_folder(self.spark)
        # As within a slice, requests without a time come last.
        order = ("book_id", F.asc_nulls_last("at_us"), F.asc_nulls_last("request_id"))
        ranged = events.repartitionByRange(slices, *order).withColumn(
            "slice", F.spark_partition_id()
        )
        self.requests = write_and_reread(ranged, f"{self.folder}/requests", "slice")
        books = self._list([(book,) for book in stock], "book_id long")
        self.held = write_and_reread(
            _loans_before(tables, self.requests, books), f"{self.folder}/held/before"
        )
        parts: dict[int, list[int]] = {}
        # A slice boundary adds one pair, a book adds one.
        for row in self.requests.select(*PAIR).distinct().collect():
            parts.setdefault(row.book_id, []).append(row.slice)
        self.books = {book: _Frontier(sorted(numbers), stock[book]) for book, numbers in parts.items()}
        self.round = 0
        # Per (slice, book): the round whose replay counts, and its "book" row.
        self.valid: dict[tuple[int, int], int] = {}
        self.summary: dict[tuple[int, int], object] = {}
        # Those that started from what the slices before them left, settled by then.
        self.certain: set[tuple[int, int]] = set()

    def _list(self, rows: list[tuple], columns: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, columns))

    def _share(self) -> int:
        """The slices of a book that find a core: looking further ahead only repeats work."""
        left = sum(bool(frontier.window) for frontier in self.books.values())
        return max(1, self.spark.sparkContext.defaultParallelism // max(1, left))

    def _replayed(self, kind: str, pairs: set[tuple[int, int]]) -> DataFrame:
        """Rows of one kind from the replays that count."""
        rounds = self._list(
            [(*pair, self.valid[pair]) for pair in pairs], "slice int, book_id long, round int"
        )
        path = f"{self.folder}/replayed"
        paths = [f"{path}/round={number}" for number in sorted({self.valid[pair] for pair in pairs})]
        rows = self.spark.read.schema(_STORED).option("basePath", path).parquet(*paths)
        return rows.where(F.col("row") == kind).drop("row").join(rounds, [*PAIR, "round"], "left_semi")

    def _replay(self, stock: dict[tuple[int, int], int], held: DataFrame) -> None:
        """Run the slices in ``stock`` from that stock and from ``held``."""
        self.round += 1
        first = {(frontier.slices[frontier.settled], book) for book, frontier in self.books.items() if frontier.window}
        self.certain |= first & set(stock)
        todo = self._list(
            [(*pair, quantity, pair not in self.certain) for pair, quantity in stock.items()],
            "slice int, book_id long, quantity long, assumed boolean",
        )
        paths = [f"{self.folder}/requests/slice={number}" for number in sorted({number for number, _ in stock})]
        asked = self.spark.read.schema(self.requests.schema).option("basePath", f"{self.folder}/requests").parquet(*paths)
        replayed = _run(asked.join(todo, PAIR, "left_semi"), _start_rows(todo, held, spans=True))
        replayed.write.parquet(f"{self.folder}/replayed/round={self.round}")
        self.valid.update(dict.fromkeys(stock, self.round))
        for row in self._replayed("book", set(stock)).collect():
            self.summary[row.slice, row.book_id] = row

    def _stock_at(self, frontier: _Frontier, book: int) -> dict[tuple[int, int], int]:
        """Stock at the start of each slice in the window, as the slices before left it; one not run yet counts as without effect."""
        left, stock = frontier.stock, {}
        for number in frontier.window:
            stock[number, book] = max(0, left)
            if (number, book) in self.valid:
                left += self.summary[number, book].delta
        return stock

    def _fits(self, pair: tuple[int, int], quantity: int) -> bool:
        """Whether a replay answers the same from ``quantity``.

        Without a refusal for stock, any start that covers the lowest point does.
        """
        used = self.summary[pair]
        return quantity == used.start_quantity or (used.refused == 0 and quantity >= used.need)

    def answers(self) -> DataFrame:
        share = self._share()
        for frontier in self.books.values():
            frontier.look_ahead = share
        while any(frontier.window for frontier in self.books.values()):
            self._advance()
        return self._settled_answers()

    def _advance(self) -> None:
        """Move each frontier over the slices that fit, and run the next: those not run yet and those that do not fit."""
        stock = {}
        for book, frontier in self.books.items():
            stock.update(self._stock_at(frontier, book))
        known = self._known({pair for pair in stock if pair in self.valid})
        checked = {pair for pair in stock if pair in self.valid and pair not in self.certain}
        wrong = {pair for pair, quantity in stock.items() if pair not in self.valid or pair in checked and not self._fits(pair, quantity)}
        if checked:
            wrong |= self._other_loans(known, checked)

        passed, todo = [], {}
        for book, frontier in self.books.items():
            window = [(number, book) for number in frontier.window]
            fitting = next((i for i, pair in enumerate(window) if pair in wrong), len(window))
            passed += window[:fitting]
            frontier.stock += sum(self.summary[pair].delta for pair in window[:fitting])
            frontier.settled += fitting
            # The first replay assumed nothing, so its misses say little: all run again.
            if self.round > 1:
                frontier.look_ahead = max(1, 2 * fitting)
        share = self._share()
        for book, frontier in self.books.items():
            frontier.look_ahead = min(frontier.look_ahead, share)
            todo.update({pair: left for pair, left in self._stock_at(frontier, book).items() if pair in wrong or pair not in self.valid})
        # ``held`` was planned with the replays that counted so far, so it does not see the rows this adds.
        if todo:
            self._replay(todo, self._held_at(known, todo))
        if passed:
            self._move_held(known, passed)

    def _known(self, pairs: set[tuple[int, int]]) -> DataFrame:
        """What members held before and after the slices ``pairs``, and at the frontier, which counts as slice -1."""
        columns = (*PAIR, "user_id", "held_in", "held_out", "key_in", "names_inherited", "opened")
        at_frontier = self.held.select(
            F.lit(-1).alias("slice"),
            "book_id",
            "user_id",
            F.lit(None).cast("array<long>").alias("held_in"),
            F.col("held").alias("held_out"),
            F.lit(None).cast("long").alias("key_in"),
            F.lit(False).alias("names_inherited"),
            F.col("key").alias("opened"),
        )
        return self._replayed("member", pairs).select(*columns).unionByName(at_frontier) if pairs else at_frontier

    def _other_loans(self, known: DataFrame, checked: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """The slices among ``checked`` where a member who asks held other loans than assumed."""
        # One member of one book has a row per slice at most.
        by_member = W.partitionBy("book_id", "user_id").orderBy("slice")
        none = F.array().cast("array<long>")
        earlier = by_member.rowsBetween(W.unboundedPreceding, -1)
        held = known.withColumn("held", F.coalesce(F.lag("held_out").over(by_member), none)).withColumn("key", F.last("opened", True).over(earlier))
        # The key of an inherited loan matters only to a member who names one.
        other_key = F.col("names_inherited") & ~F.col("key").eqNullSafe(F.col("key_in"))
        other = (F.col("held") != F.col("held_in")) | other_key
        pairs = self._list(list(checked), "slice int, book_id long")
        rows = held.where(other).join(pairs, PAIR, "left_semi").select(*PAIR).distinct().collect()
        return {(row.slice, row.book_id) for row in rows}

    def _held_at(self, known: DataFrame, pairs: dict[tuple[int, int], int]) -> DataFrame:
        """(slice, book, user, loan, key): the loans out at the start of each of ``pairs``, as the slices before left them."""
        by_member = W.partitionBy("book_id", "user_id").orderBy("slice")
        upto = by_member.rowsBetween(W.unboundedPreceding, W.currentRow)
        left = known.select(
            F.col("slice").alias("since"),
            "book_id",
            "user_id",
            F.col("held_out").alias("held"),
            F.last("opened", True).over(upto).alias("key"),
            F.lead("slice").over(by_member).alias("until"),
        ).where(F.size("held") > 0)
        starts = self._list(list(pairs), "slice int, book_id long")
        still = (F.col("slice") > F.col("since")) & (F.col("until").isNull() | (F.col("slice") <= F.col("until")))
        return left.join(starts, "book_id").where(still).select(*PAIR, "user_id", F.explode("held").alias("loan_id"), "key")

    def _move_held(self, known: DataFrame, passed: list[tuple[int, int]]) -> None:
        """Open loans at the new frontier: each member's last known, if any are left."""
        behind = self._list([*passed, *[(-1, book) for book in self.books]], "slice int, book_id long")
        self.held = write_and_reread(
            known.join(behind, PAIR, "left_semi")
            .groupBy("book_id", "user_id")
            .agg(
                F.max_by("held_out", "slice").alias("held"),
                F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("slice"))).alias("key"),
            )
            .where(F.size("held") > 0),
            f"{self.folder}/held/{self.round}-{sum(f.settled for f in self.books.values())}",
        )

    def _settled_answers(self) -> DataFrame:
        """All answers, with the keys of inherited loans filled in."""
        pairs = set(self.valid)
        rows = self._replayed("answer", pairs).drop("round")
        inherited = F.col("loan_id") == INHERITED
        earlier = (
            W.partitionBy("book_id", "user_id")
            .orderBy("slice")
            .rowsBetween(W.unboundedPreceding, -1)
        )
        opened = (
            self._replayed("member", pairs)
            .select(*PAIR, "user_id", F.last("opened", True).over(earlier).alias("key"))
            .where(F.col("key").isNotNull())
        )
        closing = rows.where(inherited).join(opened, [*PAIR, "user_id"], "left")
        filled = closing.withColumn("loan_id", F.col("key")).drop("key")
        return rows.where(~inherited).unionByName(filled)
