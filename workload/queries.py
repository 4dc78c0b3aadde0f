"""One query per operator, over the mapped test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import display as d
from shelfspark.functions import forms
from shelfspark.functions.loans import due_date
from shelfspark.functions.text import clean_int, clean_text, md5_hex, zero_to_null
from shelfspark.operators import accounts, batch, catalogue, checks, ledger, requests, search, search_index
from shelfspark.operators.migration import normalise_genres
from shelfspark.operators.sweep import sweep
from shelfspark.plans import reports as r
from shelfspark.plans import upkeep
from shelfspark.schema import BOOKS, TABLES
from shelfspark.session import work_folder, write_and_reread
from shelfspark.sources import changes
from shelfspark.streaming.ledger import answer_arrivals
from shelfspark.tables import Tables
from workload import mapping as m

Query = Callable[[SparkSession, str], DataFrame]


def _report(report: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, folder: report(m.snapshot(spark, folder), *args)


def _change(operator, make_requests, pick: Callable) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tables = m.star_tables(spark, folder)
        return pick(operator(tables, make_requests(spark, folder)))

    return query


def _table(name: str) -> Callable:
    return lambda change: getattr(change.tables, name)


def _outcomes(change) -> DataFrame:
    return change.outcomes


def overdue_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return sweep(m.star_tables(spark, folder).borrows, m.AS_OF)


def login_audit(spark: SparkSession, folder: str) -> DataFrame:
    users = m.star_tables(spark, folder).users
    return accounts.login_audit(users, m.login_attempts(spark, folder))


def role_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Borrowing is for plain users: events by users 0, 50 and 100 are not admitted."""
    users = m.star_tables(spark, folder).users
    events = m.ledger_requests(m.read(spark, folder, "events"))
    return requests.role_gate(events, users, "user")


def normalise_genre(spark: SparkSession, folder: str) -> DataFrame:
    books, genres = normalise_genres(m.legacy_books(spark, folder))
    names = genres.select(F.col("id").alias("genre_id"), F.col("name").alias("genre_name"))
    return books.join(names, "genre_id", "left").select("id", "genre_id", "genre_name")


def text_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning and hashing of whole documents, padded with what gets stripped."""
    docs = m.read(spark, folder, "documents")
    padded = F.concat(F.lit("\t \x0b"), F.col("text"), F.lit(" \r\n\0"))
    number = F.concat(F.lit(" "), F.col("n_chars"), F.col("lang"))
    return docs.select(
        "doc_id",
        clean_text(padded).alias("cleaned"),
        md5_hex("text").alias("digest"),
        clean_int(number).alias("leading_number"),
        clean_int(F.concat(F.lit("-"), F.col("n_chars"))).alias("negative_number"),
        clean_int("text").alias("text_number"),
        zero_to_null(F.col("doc_id") % 3).alias("zero_as_null"),
    )


def loan_display(spark: SparkSession, folder: str) -> DataFrame:
    """Every display rule over days left, stock and dates of all events."""
    events = m.read(spark, folder, "events")
    days = (F.col("event_id") % 25 - 12).cast("int")
    stock = F.greatest(F.lit(0), days)
    status = F.when(days < 0, "overdue").otherwise("active")
    return events.select(
        "event_id",
        d.days_text(days).alias("days_text"),
        d.due_band(days).alias("due_band"),
        F.round(d.time_bar(days), 6).alias("time_bar"),
        d.due_soon_text(days).alias("due_soon_text"),
        d.member_due_text(status, days).alias("member_due_text"),
        d.stock_text(stock).alias("stock_text"),
        d.stock_badge(stock).alias("stock_badge"),
        d.action_text(F.col("event_id") % 3 == 0, stock).alias("action_text"),
        d.status_text(status).alias("status_text"),
        d.day_text("ts").alias("day_text"),
        d.minute_text("ts").alias("minute_text"),
        due_date("ts").alias("due_date"),
    )


def legacy_display(spark: SparkSession, folder: str) -> DataFrame:
    return m.legacy_books(spark, folder).select(
        "id", d.shown("genre").alias("card_genre"), d.legacy_genre_cell("genre").alias("cell_genre")
    )


def _search(report: Callable, operator: Callable, text: str, *args) -> Query:
    return lambda spark, folder: operator(report(m.snapshot(spark, folder), *args), text)


def search_literal(spark: SparkSession, folder: str) -> DataFrame:
    """Signs that a pattern would take as wildcards stand for themselves; every ninth title has some."""
    marked = F.when(F.col("id") % 9 == 0, F.concat("title", F.lit(" 50%_off"))).when(F.col("id") % 9 == 1, F.concat("title", F.lit(" 50 percent"))).otherwise(F.col("title"))
    return search.search_catalogue(r.catalogue(m.snapshot(spark, folder)).withColumn("title", marked), "50%_O")


def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Through a table of trigrams of the whole catalogue."""
    catalogue_rows, cells = r.catalogue(m.snapshot(spark, folder)), search.catalogue_cells()
    postings = search_index.write_index(catalogue_rows, cells, f"{work_folder(spark)}/postings")
    return search_index.search_indexed(catalogue_rows, cells, "BOLT", postings)


# --- constraint checks, each over tables broken on purpose -----------------


def _count_by_table(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("tbl"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def check_primary_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines keyed by order alone repeat; the mapped loans do not."""
    lines = m.read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    loans = m.star_tables(spark, folder).borrows
    return _count_by_table(
        {"lines": checks.duplicate_keys(lines), "borrows": checks.duplicate_keys(loans)}, "id", "n"
    )


def check_unique_names(spark: SparkSession, folder: str) -> DataFrame:
    brands = m.read(spark, folder, "part").selectExpr(
        "CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE concat(lower(p_brand), ' ') END AS name"
    )
    duplicated = checks.duplicate_names(brands, "name")
    return duplicated.select(F.upper(F.rtrim("name")).alias("name"), "n")


def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    books = m.star_tables(spark, folder).books.selectExpr(
        "id",
        "CASE WHEN id % 17 <> 0 THEN title END AS title",
        "CASE WHEN id % 19 <> 0 THEN author END AS author",
        "quantity",
        "genre_id",
        "created_at",
    )
    return checks.missing_values(books, BOOKS).select("id")


def check_foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    tables = m.star_tables(spark, folder)
    broken = tables.replace(
        genres=tables.genres.where("id <> 19"),
        books=tables.books.where("id % 31 <> 0"),
        users=tables.users.where("id % 37 <> 0"),
    )
    return checks.foreign_key_violations(broken)


def check_status_domain(spark: SparkSession, folder: str) -> DataFrame:
    loans = m.star_tables(spark, folder).borrows.selectExpr(
        "id", "book_id", "CASE WHEN book_id % 29 = 0 THEN 'lost' ELSE status END AS status"
    )
    return checks.bad_status(loans)


def check_open_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return checks.repeated_open_loans(m.star_tables(spark, folder).borrows)


def check_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as titles: most are longer than a title may be."""
    docs = m.read(spark, folder, "documents").selectExpr(
        "doc_id AS id", "text AS title", "source AS author"
    )
    return checks.too_long(docs, "books").select("id")


def check_restricted_delete(spark: SparkSession, folder: str) -> DataFrame:
    tables = m.star_tables(spark, folder)
    return checks.restricted_deletes(tables.users, tables.borrows, "user_id")


def check_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Form rules over registrations made from conversations and book forms from orders."""
    said = m.read(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn AS request_id",
        "CASE WHEN turn % 3 = 0 THEN ' ' ELSE role END AS username",
        "CASE WHEN turn % 2 = 0 THEN 'abc' ELSE text END AS password",
    )
    added = m.add_book_requests(spark, folder)
    return _count_by_table(
        {
            "register": checks.invalid_requests(said, "register"),
            "add_book": checks.invalid_requests(added, "add_book"),
            "edit_book": checks.invalid_requests(added, "edit_book"),
        },
        "request_id",
        "outcome",
        "message",
    )


def check_all(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows break each declared rule in the mapped tables."""
    return checks.violation_counts(m.star_tables(spark, folder).conformed())


# --- ledger -----------------------------------------------------------------


def _event_answers(outcomes: DataFrame, *more: str) -> DataFrame:
    return outcomes.select(
        F.col("request_id").alias("event_id"),
        F.col("outcome").isin("borrowed", "returned").alias("ok"),
        *more,
    )


def ledger_replay(spark: SparkSession, folder: str) -> DataFrame:
    return _event_answers(ledger.replay(*m.event_ledger(spark, folder), reuse=False).outcomes)


def ledger_replay_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests in slices so small that every book spans several."""
    tables, asked = m.event_ledger(spark, folder)
    rows = max(1, asked.count() // 40)
    return _event_answers(ledger.replay(tables, asked, slice_rows=rows).outcomes)


ARRIVALS = 3


def ledger_stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests as a stream: they arrive in three batches, each from all over the time of the others."""
    tables, _ = m.event_ledger(spark, folder)
    events = m.read(spark, folder, "events")
    results = work_folder(spark)
    arriving = m.ledger_requests(spark.readStream.schema(events.schema).parquet(f"{results}/events/*"))
    for number in range(ARRIVALS):
        events.where(F.col("event_id") % ARRIVALS == number).write.parquet(f"{results}/events/{number}")
        answer_arrivals(tables, arriving, results)
    return _event_answers(spark.read.parquet(f"{results}/outcomes"), "late")


def _lending(spark: SparkSession, folder: str) -> tuple[Tables, DataFrame]:
    """The tables and the requests of the order lines.  Lines meet their orders once, in a written table: a replay reads both often."""
    lines = write_and_reread(m.order_lines(spark, folder), work_folder(spark))
    return m.star_tables(spark, folder).replace(borrows=m.loans(lines)), m.line_requests(lines)


def _line_replay(spark: SparkSession, folder: str, reuse: bool) -> ledger.Replay:
    return ledger.replay(*_lending(spark, folder), reuse=reuse)


def ledger_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Over tables that already hold loans: outcome and message per request."""
    return _line_replay(spark, folder, False).outcomes


def ledger_books(spark: SparkSession, folder: str) -> DataFrame:
    return _line_replay(spark, folder, True).tables.books.select("id", "quantity")


def ledger_loans(spark: SparkSession, folder: str) -> DataFrame:
    """All loans after the replay, with their keys."""
    return _line_replay(spark, folder, True).tables.borrows


def _rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot written, replayed, rewritten where the replay touched it, and read back."""
    home = work_folder(spark)
    tables, asked = _lending(spark, folder)
    changes.write_ranges(tables, home, "yyyy")
    before = changes.read_ranges(spark, home)
    changes.apply_replay(before, ledger.replay(before, asked), home, "yyyy")
    return changes.read_ranges(spark, home)


def rewritten_loans(spark: SparkSession, folder: str) -> DataFrame:
    return _rewritten(spark, folder).borrows


def rewritten_books(spark: SparkSession, folder: str) -> DataFrame:
    return _rewritten(spark, folder).books


def form_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Typed requests read from forms."""
    return forms.catalogue_requests(m.raw_forms(spark, folder))


def user_stats_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Kept through a replay of all order lines and the deletion of books after it."""
    before, asked = _lending(spark, folder)
    kept = upkeep.keep(before).written()
    played = ledger.replay(before, asked)
    between = played.tables.replace(borrows=write_and_reread(played.tables.borrows, work_folder(spark)))
    kept = upkeep.updated(kept, between, upkeep.loans_of_replay(before, played)).written()
    after = catalogue.delete_books(between, m.delete_book_requests(spark, folder)).tables
    kept = upkeep.updated(kept, after, upkeep.loans_of_deletion(between, after))
    return upkeep.user_stats(kept, after, m.AS_OF)


def _kept_through_batch(report: Callable) -> Query:
    """Kept through a batch that adds, edits and deletes books and genres."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        before = m.star_tables(spark, folder)
        after = batch.apply_catalogue(before, m.mixed_requests(spark, folder)).tables
        loans, books = upkeep.loans_of_deletion(before, after), upkeep.books_changed(before, after)
        return report(upkeep.updated(upkeep.keep(before), after, loans, books), after)

    return query


def queries() -> dict[str, Query]:
    tables = {name: _table(name) for name in TABLES}
    return {
        "kpi_summary": _report(r.kpi_summary),
        "active_borrows": _report(r.active_borrows),
        "active_borrows_display": _report(r.active_borrows_display),
        "borrow_history": _report(r.borrow_history),
        "borrow_history_trusted": _report(r.borrow_history, True),
        "user_stats": _report(r.user_stats),
        "user_stats_display": _report(r.user_stats_display),
        "top_books": _report(r.top_books),
        "never_borrowed": _report(r.never_borrowed),
        "genre_stats": _report(r.genre_stats),
        "user_stats_kept": user_stats_kept,
        "top_books_kept": _kept_through_batch(upkeep.top_books),
        "genre_stats_kept": _kept_through_batch(upkeep.genre_stats),
        "overdue_top": _report(r.overdue_top),
        "due_soon": _report(r.due_soon),
        "due_soon_display": _report(r.due_soon_display),
        "dashboard_panels": _report(r.dashboard_panels),
        "catalogue": _report(r.catalogue),
        "catalogue_display": _report(r.catalogue_display),
        "genre_catalogue": _report(r.genre_catalogue),
        "my_borrows": _report(r.my_borrows, m.MEMBER),
        "my_borrows_all": _report(r.my_borrows_display),
        "browse": _report(r.browse, m.MEMBER),
        "browse_members": _report(r.browse_members, [m.MEMBER, 50, 1234, 999999999]),
        "browse_display": _report(r.browse_display, m.MEMBER),
        "borrowable": _report(r.borrowable, m.MEMBER),
        "genre_list": _report(r.genre_list),
        "overdue_sweep": overdue_sweep,
        "register_users": _change(accounts.register_users, m.register_requests, tables["users"]),
        "register_outcomes": _change(accounts.register_users, m.register_requests, _outcomes),
        "login_audit": login_audit,
        "role_gate": role_gate,
        "add_books": _change(catalogue.add_books, m.add_book_requests, tables["books"]),
        "add_books_outcomes": _change(catalogue.add_books, m.add_book_requests, _outcomes),
        "edit_books": _change(catalogue.edit_books, m.edit_book_requests, tables["books"]),
        "edit_books_outcomes": _change(catalogue.edit_books, m.edit_book_requests, _outcomes),
        "add_genres": _change(catalogue.add_genres, m.add_genre_requests, tables["genres"]),
        "add_genres_outcomes": _change(catalogue.add_genres, m.add_genre_requests, _outcomes),
        "delete_genres": _change(catalogue.delete_genres, m.delete_genre_requests, tables["genres"]),
        "delete_genres_books": _change(
            catalogue.delete_genres, m.delete_genre_requests, tables["books"]
        ),
        "delete_genres_outcomes": _change(
            catalogue.delete_genres, m.delete_genre_requests, _outcomes
        ),
        "delete_books": _change(catalogue.delete_books, m.delete_book_requests, tables["books"]),
        "delete_books_borrows": _change(
            catalogue.delete_books, m.delete_book_requests, tables["borrows"]
        ),
        "delete_books_outcomes": _change(catalogue.delete_books, m.delete_book_requests, _outcomes),
        "mixed_requests_books": _change(batch.apply_catalogue, m.mixed_requests, tables["books"]),
        "mixed_requests_genres": _change(batch.apply_catalogue, m.mixed_requests, tables["genres"]),
        "mixed_requests_borrows": _change(batch.apply_catalogue, m.mixed_requests, tables["borrows"]),
        "mixed_requests_outcomes": _change(batch.apply_catalogue, m.mixed_requests, _outcomes),
        "form_requests": form_requests,
        "rewritten_loans": rewritten_loans,
        "rewritten_books": rewritten_books,
        "ledger_replay": ledger_replay,
        "ledger_replay_sliced": ledger_replay_sliced,
        "ledger_stream": ledger_stream_replay,
        "ledger_outcomes": ledger_outcomes,
        "ledger_books": ledger_books,
        "ledger_loans": ledger_loans,
        "normalise_genre": normalise_genre,
        "search_catalogue": _search(r.catalogue, search.search_catalogue, "BOLT"),
        "search_catalogue_indexed": search_indexed,
        "search_catalogue_literal": search_literal,
        "search_history": _search(r.borrow_history, search.search_history, "returned"),
        "search_browse": _search(r.browse, search.search_browse, "out of stock", m.MEMBER),
        "check_primary_keys": check_primary_keys,
        "check_unique_names": check_unique_names,
        "check_not_null": check_not_null,
        "check_foreign_keys": check_foreign_keys,
        "check_status_domain": check_status_domain,
        "check_open_pairs": check_open_pairs,
        "check_lengths": check_lengths,
        "check_restricted_delete": check_restricted_delete,
        "check_requests": check_requests,
        "check_all": check_all,
        "loan_display": loan_display,
        "legacy_display": legacy_display,
        "text_cleaning": text_cleaning,
    }
