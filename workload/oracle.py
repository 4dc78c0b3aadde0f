"""The workload's queries as SQL over the raw test tables.

Written apart from the engine: every text below is a plain query that DuckDB
runs on the Parquet files, with the mapping of ``workload.mapping`` as leading
common table expressions.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"
MEMBER = 7
EPOCH = "TIMESTAMP '1995-01-01 00:00:00'"
OPEN = "status IN ('active', 'overdue')"
# Tells every line of the test tables apart.
LOAN_KEY = """((l_orderkey * 8 + l_linenumber) * 16777216
        + (l_partkey * 1009 + l_suppkey * 31 + CAST(l_quantity AS BIGINT)) % 16777216)"""

CTES = {
    "genres": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "books": f"""SELECT p_partkey AS id, p_name AS title, p_brand AS author,
        CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS quantity,
        CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 20 AS INT) END AS genre_id,
        {EPOCH} + to_days(CAST(p_partkey % 900 AS INT)) AS created_at FROM part""",
    "users": f"""SELECT c_custkey AS id, c_name AS username, md5('pw' || c_custkey) AS password,
        CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
        {EPOCH} AS created_at FROM customer""",
    "borrows": f"""SELECT {LOAN_KEY} AS id,
        CASE WHEN o_custkey % 61 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END AS user_id,
        CASE WHEN l_partkey % 57 = 0 AND l_partkey > 0 THEN l_partkey - 1 ELSE l_partkey END AS book_id,
        o_orderdate AS borrowed_at, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS due_date,
        CASE WHEN l_returnflag = 'R' THEN o_orderdate + to_days(CAST(l_quantity AS INT)) END AS returned_at,
        CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'active' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "loans": f"""SELECT id, user_id, book_id, borrowed_at, due_date, returned_at,
        CASE WHEN status = 'active' AND due_date < {AS_OF} AND returned_at IS NULL
             THEN 'overdue' ELSE status END AS status FROM borrows""",
    # A title with its shelf's name, and a loan with the names it refers to.
    "shelved": """SELECT id, title, author, quantity, genre_id, created_at, genre_name FROM books
        LEFT JOIN (SELECT id AS genre_id, name AS genre_name FROM genres) USING (genre_id)""",
    "told": f"""SELECT loans.*, username, title, author, genre_name, CAST(due_date - {AS_OF} AS INT) AS days
        FROM loans
        JOIN (SELECT id AS user_id, username FROM users) USING (user_id)
        JOIN (SELECT id AS book_id, title, author, genre_name FROM shelved) USING (book_id)""",
    "per_book": f"""SELECT book_id AS id, count(*) AS borrow_count, count(*) FILTER ({OPEN}) AS currently_out
        FROM loans GROUP BY book_id""",
    "per_user": f"""SELECT user_id AS id, count(*) AS total_borrows,
        count(*) FILTER (status = 'returned') AS returned_count, count(*) FILTER ({OPEN}) AS active_count,
        count(*) FILTER (status = 'overdue') AS overdue_count, max(borrowed_at) AS last_borrow
        FROM loans GROUP BY user_id""",
}


def _with(query: str, **extra: str) -> str:
    parts = [f"{name} AS ({body})" for name, body in {**CTES, **extra}.items()]
    recursive = "RECURSIVE " if "st" in extra else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + query


def _days(expression: str) -> str:
    return f"CAST({expression} AS INT)"


ACTIVE = f"""SELECT id, borrowed_at, due_date, status, returned_at, username, user_id AS uid, title, author,
    genre_name, days AS days_remaining FROM told WHERE {OPEN}"""

HISTORY = """SELECT id, borrowed_at, due_date, returned_at, status, username, title, genre_name
    FROM told QUALIFY row_number() OVER (ORDER BY borrowed_at DESC, id DESC) <= 100"""

USER_STATS = """SELECT id, username, created_at, total_borrows, returned_count, active_count, overdue_count,
    last_borrow FROM per_user JOIN users USING (id) WHERE role = 'user'"""

DUE_SOON = """SELECT id, due_date, username, title, days AS days_rem FROM told
    WHERE status = 'active' AND days <= 3"""

CATALOGUE = "FROM shelved"

MINE = f"""SELECT user_id, loans.id, borrowed_at, due_date, status, title, author, genre_name,
    CAST(due_date - {AS_OF} AS INT) AS days_rem FROM loans JOIN shelved ON shelved.id = book_id WHERE {OPEN}"""

BROWSE = f"""SELECT shelved.*, coalesce(held, 0) AS i_have_it FROM shelved LEFT JOIN
    (SELECT book_id AS id, count(*) AS held FROM loans WHERE {OPEN} AND user_id = {MEMBER} GROUP BY 1) USING (id)"""

GENRE_SIZES = """SELECT id, name, coalesce(titles, 0) AS book_count FROM genres
    LEFT JOIN (SELECT genre_id AS id, count(*) AS titles FROM books GROUP BY 1) USING (id)"""

GAP = "chr(10) || '                '"


def _contains(cells: list[str], text: str) -> str:
    return f"contains(lower(concat_ws({GAP}, {', '.join(cells)})), lower('{text}'))"


def _days_text(n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN abs({n}) || 'd late' ELSE {n} || 'd left' END"


def _band(n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN 'late' WHEN {n} <= 2 THEN 'soon' ELSE 'ok' END"


def _bar(n: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST({n} AS DOUBLE) / 7 * 100)), 6)"


def _member_text(status: str, n: str) -> str:
    return f"""CASE WHEN {status} = 'overdue' THEN abs({n}) || 'd overdue' WHEN {n} = 0 THEN 'Due today!'
        WHEN {n} <= 2 THEN 'Due in ' || {n} || 'd' END"""


def _soon_text(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'TODAY' ELSE 'in ' || {n} || 'd' END"


def _stock_text(q: str) -> str:
    return f"CASE WHEN {q} > 0 THEN {q} || ' left' ELSE 'Out of stock' END"


def _action(has: str, q: str) -> str:
    return f"CASE WHEN {has} THEN 'Borrowed' WHEN {q} > 0 THEN 'Borrow' ELSE 'Unavailable' END"


DAY, MINUTE = "'%b %d, %Y'", "'%b %d, %Y %H:%M'"

# --- reports ----------------------------------------------------------------


def _reports() -> dict[str, str]:
    history = _with(HISTORY)
    return {
        "kpi_summary": _with(f"""SELECT (SELECT COUNT(*) FROM books) AS total_books,
            (SELECT COUNT(*) FROM users WHERE role = 'user') AS total_users,
            (SELECT COUNT(*) FROM loans WHERE {OPEN}) AS open_borrows,
            (SELECT COUNT(*) FROM loans WHERE status = 'overdue') AS overdue,
            (SELECT COUNT(*) FROM genres) AS total_genres"""),
        "active_borrows": _with(ACTIVE),
        "active_borrows_display": _with(
            f"""SELECT *, coalesce(genre_name, '—') AS genre_text,
            {_days_text('days_remaining')} AS days_text, {_band('days_remaining')} AS due_band,
            {_bar('days_remaining')} AS time_bar FROM a""",
            a=ACTIVE,
        ),
        "borrow_history": history,
        "borrow_history_trusted": history,
        "user_stats": _with(USER_STATS),
        "user_stats_display": _with(
            f"SELECT *, strftime(last_borrow, {MINUTE}) AS last_borrow_text FROM a", a=USER_STATS
        ),
        "top_books": _with(
            """SELECT CAST(place AS INT) AS rank, id, title, author, quantity, genre_name, borrow_count, currently_out
            FROM (SELECT *, row_number() OVER (ORDER BY borrow_count DESC, id) AS place
              FROM per_book JOIN shelved USING (id)) WHERE place <= 5"""
        ),
        "never_borrowed": _with("""SELECT id, title, author, quantity, genre_name FROM shelved
            ANTI JOIN per_book USING (id)"""),
        "genre_stats": _with("SELECT name AS genre_name, book_count FROM a", a=GENRE_SIZES),
        "overdue_top": _with("""SELECT username, title, due_date, -days AS days_late FROM told
            WHERE status = 'overdue' QUALIFY row_number() OVER (ORDER BY due_date, id) <= 5"""),
        "due_soon": _with(DUE_SOON),
        "due_soon_display": _with(f"SELECT *, {_soon_text('days_rem')} AS due_text FROM a", a=DUE_SOON),
        "dashboard_panels": _with(f"""SELECT
            EXISTS (SELECT 1 FROM loans WHERE status = 'overdue') AS overdue,
            EXISTS (SELECT 1 FROM loans WHERE status = 'active' AND due_date <= {AS_OF} + 3) AS due_soon"""),
        "catalogue": _with(CATALOGUE),
        "catalogue_display": _with(
            f"""SELECT *, coalesce(genre_name, '—') AS genre_text,
            CASE WHEN quantity > 0 THEN 'in' ELSE 'out' END AS stock_badge,
            strftime(created_at, {DAY}) AS added_text FROM a""",
            a=CATALOGUE,
        ),
        "genre_catalogue": _with(GENRE_SIZES),
        "my_borrows": _with(f"SELECT * EXCLUDE user_id FROM a WHERE user_id = {MEMBER}", a=MINE),
        "my_borrows_all": _with(
            f"SELECT *, {_member_text('status', 'days_rem')} AS due_text FROM a", a=MINE
        ),
        "browse": _with(BROWSE),
        "browse_members": _with(
            f"""SELECT member, s.*, (SELECT count(*) FROM loans w WHERE {OPEN} AND w.user_id = member AND w.book_id = s.id) AS i_have_it
            FROM shelved s, (SELECT CAST(unnest([{MEMBER}, 50, 1234, 999999999]) AS BIGINT) AS member)"""
        ),
        "browse_display": _with(
            f"""SELECT *, {_stock_text('quantity')} AS stock_text,
            {_action('i_have_it > 0', 'quantity')} AS action_text FROM a""",
            a=BROWSE,
        ),
        "borrowable": _with(f"""SELECT id, quantity FROM books WHERE quantity > 0 AND id NOT IN
            (SELECT book_id FROM loans WHERE user_id = {MEMBER} AND {OPEN})"""),
        "genre_list": _with("SELECT id, name FROM genres"),
        "overdue_sweep": _with("SELECT * FROM loans"),
        "search_catalogue": _with(
            "SELECT * FROM a WHERE "
            + _contains(
                ["id", "title", "author", "coalesce(genre_name, '—')", "quantity",
                 f"strftime(created_at, {DAY})"],
                "BOLT",
            ),
            a=CATALOGUE,
        ),
        "search_catalogue_indexed": _with(
            "SELECT * FROM a WHERE "
            + _contains(
                ["id", "title", "author", "coalesce(genre_name, '—')", "quantity",
                 f"strftime(created_at, {DAY})"],
                "BOLT",
            ),
            a=CATALOGUE,
        ),
        "search_catalogue_literal": _with(
            "SELECT * FROM a WHERE "
            + _contains(
                ["id", "title", "author", "coalesce(genre_name, '—')", "quantity",
                 f"strftime(created_at, {DAY})"],
                "50%_O",
            ),
            a="""SELECT * REPLACE (CASE id % 9 WHEN 0 THEN title || ' 50%_off' WHEN 1 THEN title || ' 50 percent' ELSE title END AS title)
            FROM shelved""",
        ),
        "search_history": _with(
            "SELECT * FROM a WHERE "
            + _contains(
                ["username", "title", "coalesce(genre_name, '—')", "borrowed_at", "due_date",
                 "coalesce(CAST(returned_at AS VARCHAR), '—')", "status"],
                "returned",
            ),
            a=HISTORY,
        ),
        "search_browse": _with(
            "SELECT * FROM a WHERE "
            + _contains(
                ["genre_name", "title", "author", _stock_text("quantity"),
                 _action("i_have_it > 0", "quantity")],
                "out of stock",
            ),
            a=BROWSE,
        ),
    }


# --- changes ----------------------------------------------------------------

ALLOWED = "(r % 5 <> 0)"
AT = f"{EPOCH} + to_seconds(r)"

REGISTER = {
    "r": f"""SELECT s_suppkey AS request_id, {EPOCH} AS ts,
        trim(CASE s_suppkey % 4 WHEN 0 THEN upper('customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'))
        WHEN 1 THEN 'New' || (s_suppkey % 10) ELSE ' ' || s_name || ' ' END) AS username,
        md5('secret' || s_suppkey) AS password FROM supplier""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY lower(username) ORDER BY request_id) = 1
        AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username)) AS fresh
        FROM r""",
}

ADD = {
    "v": """SELECT o_orderkey AS r, 'Volume ' || o_orderkey AS title, o_orderpriority AS author,
        nullif(o_orderkey % 28, 0) AS genre_id,
        CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 90 WHEN 1 THEN 0 WHEN 2 THEN o_orderkey % 70
        ELSE 0 END AS quantity FROM orders""",
    "judged": f"""SELECT *, CASE WHEN NOT {ALLOWED} THEN 'forbidden'
        WHEN genre_id IS NOT NULL AND genre_id NOT IN (SELECT id FROM genres) THEN 'unknown_genre'
        ELSE 'added' END AS outcome FROM v""",
}

EDIT = {
    "v": """SELECT o_orderkey AS r, o_orderkey % 1000 * 3 AS book_id, 'Edition ' || o_orderkey AS title,
        o_orderstatus AS author, nullif(o_orderkey % 28, 0) AS genre_id,
        o_orderkey % 50 AS quantity FROM orders""",
    "judged": f"""SELECT *, CASE WHEN NOT {ALLOWED} THEN 'forbidden'
        WHEN genre_id IS NOT NULL AND genre_id NOT IN (SELECT id FROM genres) THEN 'unknown_genre'
        END AS refusal FROM v""",
    "last": """SELECT * FROM judged WHERE refusal IS NULL
        QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY r DESC) = 1""",
}

ADD_GENRES = {
    "v": """SELECT s_suppkey AS r, trim(CASE WHEN s_suppkey % 3 = 0 THEN 'nation_' || s_nationkey
        ELSE ' Shelf ' || (s_suppkey % 37) || ' ' END) AS name FROM supplier""",
    "firsts": f"""SELECT min(r) AS r FROM v WHERE {ALLOWED}
        AND lower(name) NOT IN (SELECT lower(name) FROM genres) GROUP BY lower(name)""",
}

DELETED_GENRES = "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey % 5 <> 0"

DELETE_BOOKS = {
    "v": """SELECT p_partkey * 2 + again AS r, p_partkey AS id FROM part,
        (VALUES (0), (1)) AS t(again) WHERE p_partkey % 13 = 0""",
    "firsts": f"SELECT min(r) AS r, id FROM v WHERE {ALLOWED} GROUP BY id",
}


def _changes() -> dict[str, str]:
    return {
        "register_users": _with(
            """SELECT * FROM users UNION ALL
            SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id),
            username, password, 'user', ts FROM ranked WHERE fresh""",
            **REGISTER,
        ),
        "register_outcomes": _with(
            """SELECT request_id, CASE WHEN fresh THEN 'registered' ELSE 'taken' END AS outcome,
            CASE WHEN fresh THEN 'Account created! You can now log in.'
            ELSE 'Username already taken.' END AS message FROM ranked""",
            **REGISTER,
        ),
        "login_audit": _with(
            """SELECT event_id AS request_id, CASE WHEN ok THEN 'accepted' ELSE 'denied' END AS outcome,
            CASE WHEN ok THEN '' ELSE 'Invalid username or password.' END AS message FROM (
              SELECT event_id, coalesce(u.password = md5(CASE WHEN event_id % 3 = 0 THEN 'wrong'
                ELSE 'pw' || (user_id * 20) END), FALSE) AS ok
              FROM events e LEFT JOIN users u ON lower(u.username) =
                lower('CUSTOMER#' || lpad(CAST(user_id * 20 AS VARCHAR), 9, '0')))"""
        ),
        "role_gate": _with(
            """SELECT event_id AS request_id, CASE WHEN EXISTS (SELECT 1 FROM users u
            WHERE u.id = e.user_id AND u.role = 'user') THEN 'permitted' ELSE 'forbidden' END AS outcome,
            '' AS message FROM events e"""
        ),
        "add_books": _with(
            f"""SELECT * FROM books UNION ALL
            SELECT (SELECT max(id) FROM books) + row_number() OVER (ORDER BY r), title, author,
            CAST(quantity AS INT), CAST(genre_id AS INT), {AT} FROM judged WHERE outcome = 'added'""",
            **ADD,
        ),
        "add_books_outcomes": _with(
            """SELECT r AS request_id, outcome, CASE WHEN outcome = 'added'
            THEN 'Book "' || title || '" added.' ELSE '' END AS message FROM judged""",
            **ADD,
        ),
        "edit_books": _with(
            """SELECT b.id, coalesce(l.title, b.title) AS title, coalesce(l.author, b.author) AS author,
            CAST(coalesce(l.quantity, b.quantity) AS INT) AS quantity,
            CAST(CASE WHEN l.r IS NULL THEN b.genre_id ELSE l.genre_id END AS INT) AS genre_id,
            b.created_at FROM books b LEFT JOIN last l ON l.book_id = b.id""",
            **EDIT,
        ),
        "edit_books_outcomes": _with(
            """SELECT request_id, outcome, CASE WHEN outcome IN ('updated', 'no_such_book')
            THEN 'Book updated.' ELSE '' END AS message FROM (
              SELECT r AS request_id, coalesce(refusal, CASE WHEN book_id IN (SELECT id FROM books)
              THEN 'updated' ELSE 'no_such_book' END) AS outcome FROM judged)""",
            **EDIT,
        ),
        "add_genres": _with(
            """SELECT id, name FROM genres UNION ALL
            SELECT CAST((SELECT max(id) FROM genres) + row_number() OVER (ORDER BY r) AS INT), name
            FROM v JOIN firsts USING (r)""",
            **ADD_GENRES,
        ),
        "add_genres_outcomes": _with(
            f"""SELECT r AS request_id, outcome, CASE outcome WHEN 'added' THEN
            'Genre "' || name || '" added.' WHEN 'exists' THEN 'Genre already exists.' ELSE '' END AS message
            FROM (SELECT *, CASE WHEN NOT {ALLOWED} THEN 'forbidden'
              WHEN r IN (SELECT r FROM firsts) THEN 'added' ELSE 'exists' END AS outcome FROM v)""",
            **ADD_GENRES,
        ),
        "delete_genres": _with("SELECT id, name FROM genres WHERE id NOT IN (SELECT id FROM gone)", gone=DELETED_GENRES),
        "delete_genres_books": _with(
            """SELECT id, title, author, quantity, CASE WHEN genre_id IN (SELECT id FROM gone) THEN NULL
            ELSE genre_id END AS genre_id, created_at FROM books""",
            gone=DELETED_GENRES,
        ),
        "delete_genres_outcomes": _with(
            """SELECT CAST(n_nationkey AS INT) AS request_id, CASE WHEN n_nationkey % 5 = 0 THEN 'forbidden' ELSE 'deleted' END AS outcome,
            CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Genre deleted. Affected books set to no genre.' END AS message
            FROM nation WHERE n_nationkey % 6 = 0"""
        ),
        "delete_books": _with("SELECT * FROM books WHERE id NOT IN (SELECT id FROM firsts)", **DELETE_BOOKS),
        "delete_books_borrows": _with(
            "SELECT * FROM borrows WHERE book_id NOT IN (SELECT id FROM firsts)", **DELETE_BOOKS
        ),
        "delete_books_outcomes": _with(
            f"""SELECT request_id, outcome,
            CASE WHEN outcome = 'forbidden' THEN '' ELSE 'Book deleted.' END AS message,
            CASE WHEN outcome = 'deleted' THEN (SELECT quantity FROM books b WHERE b.id = x.id) +
              (SELECT COUNT(*) FROM borrows w WHERE w.book_id = x.id AND w.{OPEN}) END AS restored_quantity
            FROM (SELECT r AS request_id, id, CASE WHEN NOT {ALLOWED} THEN 'forbidden'
              WHEN r IN (SELECT r FROM firsts) THEN 'deleted' ELSE 'no_such_book' END AS outcome FROM v) x""",
            **DELETE_BOOKS,
        ),
        "normalise_genre": """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0
              AND p_partkey % 7 <> 0 THEN trim(p_type) END AS genre_name FROM part),
            g AS (SELECT genre_name, CAST(row_number() OVER (ORDER BY genre_name) AS INT) AS genre_id
              FROM (SELECT DISTINCT genre_name FROM b WHERE genre_name IS NOT NULL))
            SELECT b.id, g.genre_id, b.genre_name FROM b LEFT JOIN g USING (genre_name)""",
    }


# --- checks and scalar rules ------------------------------------------------


def _checks() -> dict[str, str]:
    pairs = f"""SELECT user_id, book_id, COUNT(*) AS n FROM borrows WHERE {OPEN}
        GROUP BY user_id, book_id HAVING COUNT(*) > 1"""

    def keys(table: str) -> str:
        return f"SELECT id FROM {table} GROUP BY id HAVING COUNT(*) > 1"

    def lacking(table: str, *columns: str) -> str:
        return f"SELECT id FROM {table} WHERE " + " OR ".join(f"{c} IS NULL" for c in columns)

    def orphans(table: str, key: str, parent: str) -> str:
        return f"""SELECT '{table}' AS child, '{key}' AS fk, id FROM {table} c WHERE {key} IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{key})"""

    def foreign(genres: str, books: str, users: str) -> str:
        return " UNION ALL ".join(
            [
                orphans("books", "genre_id", genres).replace("FROM books c", f"FROM {books} c"),
                orphans("borrows", "book_id", books),
                orphans("borrows", "user_id", users),
            ]
        )

    rules = {
        "books_primary_key": keys("books"),
        "borrows_primary_key": keys("borrows"),
        "genres_primary_key": keys("genres"),
        "users_primary_key": keys("users"),
        "books_not_null": lacking("books", "id", "title", "author", "quantity", "created_at"),
        "borrows_not_null": lacking(
            "borrows", "id", "user_id", "book_id", "borrowed_at", "due_date", "status"
        ),
        "genres_not_null": lacking("genres", "id", "name"),
        "users_not_null": lacking("users", "id", "username", "password", "created_at"),
        "books_length": "SELECT id FROM books WHERE length(title) > 255 OR length(author) > 255",
        "genres_length": "SELECT id FROM genres WHERE length(name) > 100",
        "users_length": """SELECT id FROM users WHERE length(username) > 50 OR length(password) > 255
            OR length(role) > 20""",
        "genres_unique_name": "SELECT lower(name) FROM genres GROUP BY 1 HAVING COUNT(*) > 1",
        "users_unique_username": "SELECT lower(username) FROM users GROUP BY 1 HAVING COUNT(*) > 1",
        "foreign_keys": foreign("genres", "books", "users"),
        "borrows_status": "SELECT id FROM borrows WHERE status NOT IN ('active', 'returned', 'overdue')",
        "borrows_open_pairs": pairs,
    }
    days, stock = "CAST(event_id % 25 - 12 AS INT)", "greatest(0, CAST(event_id % 25 - 12 AS INT))"
    status = f"CASE WHEN {days} < 0 THEN 'overdue' ELSE 'active' END"
    stripped = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"
    return {
        "check_primary_keys": _with(
            """SELECT 'lines' AS tbl, l_orderkey AS id, COUNT(*) AS n FROM lineitem
            GROUP BY l_orderkey HAVING COUNT(*) > 1 UNION ALL
            SELECT 'borrows', id, COUNT(*) FROM borrows GROUP BY id HAVING COUNT(*) > 1"""
        ),
        "check_unique_names": """SELECT upper(p_brand) AS name, COUNT(*) AS n FROM part
            GROUP BY upper(p_brand) HAVING COUNT(*) > 1""",
        "check_not_null": "SELECT p_partkey AS id FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0",
        "check_foreign_keys": _with(
            foreign("few_genres", "few_books", "few_users"),
            few_genres="SELECT * FROM genres WHERE id <> 19",
            few_books="SELECT * FROM books WHERE id % 31 <> 0",
            few_users="SELECT * FROM users WHERE id % 37 <> 0",
        ),
        "check_status_domain": _with(
            "SELECT id, book_id, 'lost' AS status FROM borrows WHERE book_id % 29 = 0"
        ),
        "check_open_pairs": _with(pairs),
        "check_lengths": "SELECT doc_id AS id FROM documents WHERE length(text) > 255 OR length(source) > 255",
        "check_restricted_delete": _with(
            """SELECT DISTINCT user_id AS id, 'restricted' AS outcome FROM borrows
            WHERE user_id IN (SELECT id FROM users)"""
        ),
        "check_requests": """SELECT * FROM (
            SELECT 'register' AS tbl, conv_id * 1000 + turn AS request_id, 'invalid' AS outcome,
              CASE WHEN turn % 3 = 0 OR trim(role) = '' THEN 'username is required'
              WHEN turn % 2 = 0 OR length(text) < 4 THEN 'password is too short' END AS message
            FROM conversations
            UNION ALL SELECT 'add_book', o_orderkey, 'invalid', CASE WHEN CASE o_orderkey % 4
              WHEN 0 THEN o_orderkey % 90 WHEN 2 THEN o_orderkey % 70 ELSE 0 END < 1
              THEN 'quantity must be at least 1' END FROM orders
            UNION ALL SELECT 'edit_book', o_orderkey, 'invalid', CASE WHEN o_orderkey % 4 = 1
              THEN 'quantity must be at least 0' END FROM orders
            ) WHERE message IS NOT NULL""",
        "check_all": _with(
            " UNION ALL ".join(
                f"SELECT '{rule}' AS rule, (SELECT COUNT(*) FROM ({rows}) AS broken) AS n"
                for rule, rows in rules.items()
            )
        ),
        "loan_display": f"""SELECT event_id, {_days_text(days)} AS days_text, {_band(days)} AS due_band,
            {_bar(days)} AS time_bar, {_soon_text(days)} AS due_soon_text,
            {_member_text(status, days)} AS member_due_text, {_stock_text(stock)} AS stock_text,
            CASE WHEN {stock} > 0 THEN 'in' ELSE 'out' END AS stock_badge,
            {_action('event_id % 3 = 0', stock)} AS action_text,
            CASE WHEN {days} < 0 THEN 'Overdue' ELSE 'Active' END AS status_text,
            strftime(ts, {DAY}) AS day_text, strftime(ts, {MINUTE}) AS minute_text,
            CAST(CAST(ts AS DATE) + 7 AS DATE) AS due_date FROM events""",
        "legacy_display": """SELECT p_partkey AS id,
            CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 THEN ' ' || p_type || ' ' END AS card_genre,
            CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN '—'
            ELSE ' ' || p_type || ' ' END AS cell_genre FROM part""",
        "text_cleaning": f"""SELECT doc_id, trim(text, {stripped}) AS cleaned, md5(text) AS digest,
            n_chars AS leading_number, CAST(0 AS BIGINT) AS negative_number,
            greatest(0, coalesce(TRY_CAST(regexp_extract(text, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0))
              AS text_number,
            nullif(doc_id % 3, 0) AS zero_as_null FROM documents""",
    }


# --- one batch of all kinds, replayed one after another -----------------------

MIXED = {
    "req": f"""SELECT o_orderkey AS r, {EPOCH} + to_seconds(o_orderkey * 7919 % 10007) AS ts, o_orderkey % 5 <> 0 AS permitted,
        CASE WHEN o_orderkey % 23 = 0 THEN 'add_genre' WHEN o_orderkey % 23 = 1 THEN 'delete_genre'
          WHEN o_orderkey % 23 < 5 THEN 'add_book' WHEN o_orderkey % 23 < 7 THEN 'delete_book'
          WHEN o_orderkey % 23 = 7 THEN 'rename_book' ELSE 'edit_book' END AS kind,
        CASE WHEN o_orderkey % 3 = 0 THEN (SELECT max(id) FROM books) + 1 + o_orderkey % 200 ELSE o_orderkey * 31 % 2500 END AS book,
        'Issue ' || o_orderkey AS title, o_orderstatus AS author, nullif(o_orderkey * 13 % 61, 0) AS genre,
        o_orderkey * 13 % 61 AS gone_genre, o_orderkey % 50 AS quantity,
        CASE WHEN o_orderkey % 4 = 0 THEN 'nation_' || (o_orderkey % 25) ELSE 'Shelf ' || (o_orderkey % 11) END AS name FROM orders""",
    "placed": "SELECT *, row_number() OVER (ORDER BY ts, r) AS pos FROM req",
    # Each add takes the next key of its table, accepted or not.
    "keyed": """SELECT *, row_number() OVER (PARTITION BY kind, permitted ORDER BY pos) +
        CASE kind WHEN 'add_genre' THEN (SELECT max(id) FROM genres) WHEN 'add_book' THEN (SELECT max(id) FROM books) END AS key FROM placed""",
    "gev": """SELECT *, row_number() OVER (ORDER BY pos) AS n FROM keyed
        WHERE permitted AND kind IN ('add_genre', 'delete_genre')""",
    "st": """SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS id,
          CAST(NULL AS BOOLEAN) AS ok, (SELECT list({'id': CAST(id AS BIGINT), 'name': name}) FROM genres) AS live
        UNION ALL
        SELECT n, pos, kind, CASE kind WHEN 'add_genre' THEN key ELSE gone_genre END, ok,
          CASE WHEN ok AND kind = 'add_genre' THEN list_append(live, {'id': key, 'name': name})
               WHEN ok THEN list_filter(live, lambda g: g.id <> gone_genre) ELSE live END
        FROM (SELECT e.n, e.pos, e.kind, e.key, e.gone_genre, e.name, s.live,
                CASE e.kind WHEN 'add_genre' THEN len(list_filter(s.live, lambda g: lower(g.name) = lower(e.name))) = 0
                  ELSE len(list_filter(s.live, lambda g: g.id = e.gone_genre)) > 0 END AS ok
              FROM st s JOIN gev e ON e.n = s.n + 1)""",
    "life": """SELECT g.id, coalesce(b.pos, 0) AS born, d.pos AS died FROM
        (SELECT id FROM genres UNION SELECT id FROM st WHERE ok AND kind = 'add_genre') g
        LEFT JOIN (SELECT id, pos FROM st WHERE ok AND kind = 'add_genre') b USING (id)
        LEFT JOIN (SELECT id, pos FROM st WHERE ok AND kind = 'delete_genre') d USING (id)""",
    "bev": """SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) AS n FROM (
          SELECT pos, kind, CASE kind WHEN 'add_book' THEN key ELSE book END AS book, title, author, genre, quantity, ts,
            genre IS NULL OR EXISTS (SELECT 1 FROM life l WHERE l.id = k.genre AND l.born < k.pos AND (l.died IS NULL OR l.died > k.pos)) AS genre_ok
          FROM keyed k WHERE permitted AND kind IN ('add_book', 'edit_book', 'delete_book')
          UNION ALL
          SELECT died, 'unlink', b.id, NULL, NULL, l.id, NULL, NULL, true FROM life l,
            (SELECT id FROM books UNION SELECT key FROM keyed WHERE permitted AND kind = 'add_book') b WHERE died IS NOT NULL)""",
    "bst": """SELECT x.id AS book, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BOOLEAN) AS ok, b.id IS NOT NULL AS live,
          b.title, b.author, CAST(b.genre_id AS BIGINT) AS genre, CAST(b.quantity AS BIGINT) AS quantity, b.created_at
        FROM (SELECT id FROM books UNION SELECT book FROM bev) x LEFT JOIN books b USING (id)
        UNION ALL
        SELECT book, n, pos, ok, CASE WHEN ok AND kind = 'add_book' THEN true WHEN ok AND kind = 'delete_book' THEN false ELSE live END,
          CASE WHEN ok AND kind IN ('add_book', 'edit_book') THEN new_title ELSE title END,
          CASE WHEN ok AND kind IN ('add_book', 'edit_book') THEN new_author ELSE author END,
          CASE WHEN ok AND kind IN ('add_book', 'edit_book') THEN new_genre WHEN kind = 'unlink' AND genre = new_genre THEN NULL ELSE genre END,
          CASE WHEN ok AND kind IN ('add_book', 'edit_book') THEN new_quantity ELSE quantity END,
          CASE WHEN ok AND kind = 'add_book' THEN ts ELSE created_at END
        FROM (SELECT s.*, e.n AS m, e.kind, e.title AS new_title, e.author AS new_author, e.genre AS new_genre, e.quantity AS new_quantity, e.ts,
                e.pos AS at, CASE e.kind WHEN 'add_book' THEN e.genre_ok WHEN 'edit_book' THEN e.genre_ok AND s.live WHEN 'delete_book' THEN s.live END AS yes
              FROM bst s JOIN bev e ON e.book = s.book AND e.n = s.n + 1) AS t(book, old_n, old_pos, old_ok, live, title, author, genre, quantity, created_at,
                n, kind, new_title, new_author, new_genre, new_quantity, ts, pos, ok)""",
    "last": "SELECT * FROM bst QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC) = 1",
}


def _mixed() -> dict[str, str]:
    return {
        "mixed_requests_books": _with(
            """SELECT book AS id, title, author, CAST(quantity AS INT) AS quantity, CAST(genre AS INT) AS genre_id, created_at
            FROM last WHERE live""",
            **MIXED,
        ),
        "mixed_requests_genres": _with(
            """SELECT CAST(g.id AS INT) AS id, g.name AS name FROM (
              SELECT unnest(live) AS g FROM st WHERE n = (SELECT max(n) FROM st))""",
            **MIXED,
        ),
        "mixed_requests_borrows": _with("SELECT * FROM borrows WHERE book_id IN (SELECT book FROM last WHERE live)", **MIXED),
        "form_requests": _with(
            """SELECT r * 5 + CASE kind WHEN 'add_book' THEN 0 WHEN 'edit_book' THEN 1 WHEN 'delete_book' THEN 2 WHEN 'add_genre' THEN 3 ELSE 4 END AS request_id,
              ts, CAST(CASE WHEN permitted THEN 50 ELSE 1 END AS BIGINT) AS user_id, kind,
              CASE WHEN kind IN ('edit_book', 'delete_book') THEN CAST(book AS VARCHAR) END AS book_id,
              CASE WHEN kind IN ('add_book', 'edit_book') THEN ' ' || title || ' é&=+% ' || author END AS title,
              CASE WHEN kind IN ('add_book', 'edit_book') THEN author END AS author,
              CASE WHEN kind = 'delete_genre' OR kind IN ('add_book', 'edit_book') AND r % 11 <> 0 THEN CAST(gone_genre AS VARCHAR) END AS genre_id,
              CASE WHEN kind IN ('add_book', 'edit_book') THEN CAST(quantity AS VARCHAR) END AS quantity,
              CASE WHEN kind = 'add_genre' THEN CASE WHEN r % 4 = 0 THEN name ELSE ' ' || name || ' ' END END AS name
            FROM req WHERE kind <> 'rename_book'
            UNION ALL
            SELECT r * 5 + 4, ts, CAST(CASE WHEN permitted THEN 50 ELSE 1 END AS BIGINT), 'delete_genre', NULL, NULL, NULL, gone_genre || '%zz', NULL, NULL
            FROM req WHERE r % 13 = 0 AND kind NOT IN ('delete_genre', 'delete_book')""",
            req=MIXED["req"],
        ),
        "top_books_kept": _with(
            """SELECT CAST(row_number() OVER (ORDER BY borrow_count DESC, t.book) AS INT) AS rank, t.book AS id, title, author,
              CAST(quantity AS INT) AS quantity, g.name AS genre_name, borrow_count, currently_out
            FROM (SELECT book_id AS book, count(*) AS borrow_count, count(*) FILTER (status IN ('active', 'overdue')) AS currently_out
              FROM borrows GROUP BY book_id HAVING book_id IN (SELECT book FROM last WHERE live) ORDER BY 2 DESC, 1 LIMIT 5) t
            JOIN last ON last.book = t.book LEFT JOIN kept_genres g ON g.id = last.genre""",
            **MIXED,
            kept_genres="SELECT g.id AS id, g.name AS name FROM (SELECT unnest(live) AS g FROM st WHERE n = (SELECT max(n) FROM st))",
        ),
        "genre_stats_kept": _with(
            """SELECT name AS genre_name, (SELECT count(*) FROM last WHERE live AND genre = g.id) AS book_count FROM kept_genres g""",
            **MIXED,
            kept_genres="SELECT g.id AS id, g.name AS name FROM (SELECT unnest(live) AS g FROM st WHERE n = (SELECT max(n) FROM st))",
        ),
        "mixed_requests_outcomes": _with(
            """SELECT request_id, outcome, CASE
              WHEN outcome = 'added' AND kind = 'add_book' THEN 'Book "' || title || '" added.'
              WHEN kind = 'edit_book' AND outcome IN ('updated', 'no_such_book') THEN 'Book updated.'
              WHEN outcome = 'added' THEN 'Genre "' || name || '" added.'
              WHEN outcome = 'exists' THEN 'Genre already exists.'
              WHEN kind = 'delete_genre' AND outcome <> 'forbidden' THEN 'Genre deleted. Affected books set to no genre.'
              WHEN kind = 'delete_book' AND outcome <> 'forbidden' THEN 'Book deleted.' ELSE '' END AS message,
              CASE WHEN kind = 'delete_book' AND outcome = 'deleted' THEN quantity + coalesce(n_out, 0) END AS restored_quantity
            FROM (SELECT k.r AS request_id, k.kind, k.title, k.name, b.quantity, o.n_out, CASE
                WHEN NOT k.permitted THEN 'forbidden' WHEN k.kind = 'rename_book' THEN 'unknown_kind'
                WHEN k.kind = 'add_genre' THEN CASE WHEN g.ok THEN 'added' ELSE 'exists' END
                WHEN k.kind = 'delete_genre' THEN CASE WHEN g.ok THEN 'deleted' ELSE 'no_such_genre' END
                WHEN k.kind = 'delete_book' THEN CASE WHEN b.ok THEN 'deleted' ELSE 'no_such_book' END
                WHEN NOT e.genre_ok THEN 'unknown_genre'
                WHEN k.kind = 'add_book' THEN 'added' WHEN b.ok THEN 'updated' ELSE 'no_such_book' END AS outcome
              FROM keyed k LEFT JOIN st g ON g.pos = k.pos
              LEFT JOIN (SELECT * FROM bev WHERE kind <> 'unlink') e ON e.pos = k.pos
              LEFT JOIN bst b ON b.book = e.book AND b.n = e.n
              LEFT JOIN (SELECT book_id, count(*) AS n_out FROM borrows WHERE status IN ('active', 'overdue') GROUP BY book_id) o
                ON o.book_id = k.book)""",
            **MIXED,
        ),
    }


# --- ledger -----------------------------------------------------------------

EVENT_LEDGER = """WITH RECURSIVE req AS (
  SELECT event_id, user_id, event_type IN ('purchase', 'signup') AS borrowing, event_id % 23 AS book_id,
    row_number() OVER (PARTITION BY event_id % 23 ORDER BY ts, event_id) AS n
  FROM events WHERE event_type <> 'error'),
st AS (
  SELECT DISTINCT book_id, CAST(0 AS BIGINT) AS n, 5 + book_id AS q, CAST([] AS BIGINT[]) AS h,
    CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS ok FROM req
  UNION ALL
  SELECT x.book_id, x.n, CASE WHEN x.ok AND x.borrowing THEN x.q - 1 WHEN x.ok THEN x.q + 1 ELSE x.q END,
    CASE WHEN x.ok AND x.borrowing THEN list_append(x.h, x.user_id)
         WHEN x.ok THEN list_filter(x.h, lambda v: v <> x.user_id) ELSE x.h END,
    x.event_id, x.ok
  FROM (SELECT r.book_id, r.n, r.borrowing, r.user_id, r.event_id, s.q, s.h,
          CASE WHEN r.borrowing THEN s.q > 0 AND NOT list_contains(s.h, r.user_id)
               ELSE list_contains(s.h, r.user_id) END AS ok
        FROM st s JOIN req r ON r.book_id = s.book_id AND r.n = s.n + 1) x)
SELECT event_id, ok FROM st WHERE event_id IS NOT NULL
UNION ALL SELECT event_id, false FROM events WHERE event_type = 'error'"""

# The same in order of arrival; late are those that an earlier batch has overtaken on their book.
ARRIVAL_LEDGER = f"""SELECT event_id, ok, coalesce(late, false) AS late FROM ({
    EVENT_LEDGER.replace("ORDER BY ts, event_id", "ORDER BY event_id % 3, ts, event_id")
}) LEFT JOIN (
  SELECT event_id, (ts, event_id) < max((ts, event_id)) OVER (PARTITION BY event_id % 23 ORDER BY event_id % 3
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late
  FROM events WHERE event_type <> 'error') USING (event_id)"""

LINES = {
    "req": f"""SELECT {LOAN_KEY} AS request_id,
        o_orderdate + INTERVAL 3000 DAY AS ts,
        CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
        l_linenumber AS line, CASE WHEN l_linenumber > 1 THEN l_partkey % 50 END AS book_id,
        CASE WHEN l_linenumber = 1 THEN {LOAN_KEY} END AS borrow_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "judged": """SELECT r.request_id, r.ts, r.user_id, r.line,
        coalesce(r.book_id, CASE WHEN b.user_id = r.user_id THEN b.book_id END) AS book_id,
        CASE WHEN r.line % 2 = 0 THEN (SELECT max(id) FROM borrows) + 1 + r.request_id
          - (SELECT min(request_id) FROM req) ELSE r.borrow_id END AS loan_id,
        EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.role = 'user') AS permitted
        FROM req r LEFT JOIN borrows b ON b.id = r.borrow_id AND b.status = 'active'""",
    "ev": """SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts, request_id) AS n
        FROM judged WHERE permitted AND book_id IS NOT NULL""",
    "before": """SELECT book_id, list({'u': user_id, 'l': id} ORDER BY id) AS h
        FROM borrows WHERE status = 'active' GROUP BY book_id""",
    "st": """SELECT DISTINCT e.book_id, CAST(0 AS BIGINT) AS n, CAST(coalesce(k.quantity, 0) AS BIGINT) AS q,
          coalesce(b.h, CAST([] AS STRUCT(u BIGINT, l BIGINT)[])) AS h,
          CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BIGINT) AS loan_id
        FROM ev e LEFT JOIN books k ON k.id = e.book_id LEFT JOIN before b ON b.book_id = e.book_id
        UNION ALL
        SELECT book_id, n, CASE WHEN ok AND line % 2 = 0 THEN q - 1 WHEN ok THEN q + 1 ELSE q END,
          CASE WHEN ok AND line % 2 = 0 THEN list_append(h, {'u': user_id, 'l': loan})
               WHEN ok THEN list_filter(h, lambda v: v.l <> loan) ELSE h END,
          request_id, ok, loan
        FROM (SELECT *, CASE WHEN line % 2 = 0 THEN q > 0 AND len(mine) = 0
                WHEN line = 1 THEN list_contains(list_transform(mine, lambda v: v.l), named)
                ELSE len(mine) > 0 END AS ok,
                CASE WHEN line % 2 = 1 AND line > 1 THEN mine[1].l ELSE named END AS loan
              FROM (SELECT e.book_id, e.n, e.line, e.user_id, e.request_id, e.loan_id AS named, s.q, s.h,
                      list_filter(s.h, lambda v: v.u = e.user_id) AS mine
                    FROM st s JOIN ev e ON e.book_id = s.book_id AND e.n = s.n + 1))""",
    "ans": """SELECT e.request_id, e.ts, e.user_id, e.line, e.book_id, s.ok, s.loan_id
        FROM ev e JOIN st s USING (request_id)""",
}


LINE_LOANS = """SELECT id, user_id, book_id, borrowed_at, due_date, coalesce(closed_at, returned_at) AS returned_at,
            CASE WHEN closed_at IS NOT NULL THEN 'returned' ELSE status END AS status
            FROM (SELECT id, user_id, book_id, borrowed_at, due_date, returned_at, status FROM borrows
              UNION ALL SELECT loan_id, user_id, book_id, ts, CAST(CAST(ts AS DATE) + 7 AS DATE), NULL, 'active'
              FROM ans WHERE ok AND line % 2 = 0) l
            LEFT JOIN (SELECT loan_id, ts AS closed_at FROM ans WHERE ok AND line % 2 = 1) c
              ON c.loan_id = l.id"""


def _ledger() -> dict[str, str]:
    return {
        "ledger_replay": EVENT_LEDGER,
        "ledger_replay_sliced": EVENT_LEDGER,
        "ledger_stream": ARRIVAL_LEDGER,
        "ledger_outcomes": _with(
            """SELECT request_id, outcome, CASE outcome WHEN 'borrowed' THEN 'Book borrowed! Due back on ' ||
            CAST(CAST(CAST(ts AS DATE) + 7 AS DATE) AS VARCHAR) || '.'
            WHEN 'unavailable' THEN 'Book unavailable or you already have it borrowed.'
            WHEN 'returned' THEN 'Book returned successfully. Thank you!' ELSE '' END AS message
            FROM (SELECT j.request_id, j.ts, CASE WHEN NOT j.permitted THEN 'forbidden'
              WHEN j.line % 2 = 0 AND a.ok THEN 'borrowed' WHEN j.line % 2 = 0 THEN 'unavailable'
              WHEN a.ok THEN 'returned' ELSE 'no_such_loan' END AS outcome
              FROM judged j LEFT JOIN ans a ON a.request_id = j.request_id)""",
            **LINES,
        ),
        "ledger_books": _with(
            """SELECT b.id, CAST(b.quantity + coalesce(d.delta, 0) AS INT) AS quantity FROM books b
            LEFT JOIN (SELECT book_id, SUM(CASE WHEN line % 2 = 0 THEN -1 ELSE 1 END) AS delta FROM ans
              WHERE ok GROUP BY book_id) d ON d.book_id = b.id""",
            **LINES,
        ),
        "ledger_loans": _with(LINE_LOANS, **LINES),
        "rewritten_loans": _with(LINE_LOANS, **LINES),
        "rewritten_books": _with(
            """SELECT id, title, author, CAST(quantity + coalesce(delta, 0) AS INT) AS quantity, genre_id, created_at FROM books
            LEFT JOIN (SELECT book_id AS id, SUM(CASE WHEN line % 2 = 0 THEN -1 ELSE 1 END) AS delta FROM ans WHERE ok GROUP BY 1) USING (id)""",
            **LINES,
        ),
        "user_stats_kept": _with(
            USER_STATS.replace("per_user", "now_per_user"),
            **LINES,
            **DELETE_BOOKS,
            now_loans=LINE_LOANS,
            now_swept=f"""SELECT user_id, borrowed_at, CASE WHEN status = 'active' AND due_date < {AS_OF} AND returned_at IS NULL
                THEN 'overdue' ELSE status END AS status FROM now_loans WHERE book_id NOT IN (SELECT id FROM firsts)""",
            now_per_user=CTES["per_user"].replace("FROM loans", "FROM now_swept"),
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {**_reports(), **_changes(), **_mixed(), **_checks(), **_ledger()}
