"""The operators as queries over the test tables, and the SQL that some of them must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import caps, exact_dedup, langid, licenses, mixing, ngram_join, periodic_runs, quality, resharding, secret_scan, sentencepiece_codec, spelling_variants, warc
from shelfspark.llm.common import WorkTables, held_out

# Where the model of op1 is; the file is never copied into the repository.
SENTENCEPIECE_MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

OLD_SHARDS, SHARDS = 5, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    work = WorkTables(spark, "mixing")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    docs = work.cut(docs)
    size = F.col("size")
    rule, _ = mixing.mix(docs, None, work, size=size)
    sizes = [(r.source, r["size"]) for r in docs.groupBy("source").agg(F.sum("size").alias("size")).limit(mixing.MAX_PATTERNS).collect()]
    targets = mixing.shared_targets(sizes)
    sources = spark.createDataFrame([(name, n, targets[name]) for name, n in sizes], "s string, source_size long, target double")
    taken = mixing.copies(docs, rule, "times", size=size)
    return taken.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), WorkTables(spark, "caps"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back from them."""
    work = WorkTables(spark, "warc")
    manifest = work.cut(warc.write_archives(warc.classified(table(spark, sf_dir, "pages")), work.path()))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = WorkTables(spark, "quality").cut(quality.with_features(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    forest = quality.train(rows.where(~held_out()).join(labels, "doc_id"))
    scored = rows.select("doc_id", held_out().alias("held_out"), quality.score(rows, forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.PREDICT_FROM).cast("int"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), WorkTables(spark, "exact"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), WorkTables(spark, "ngrams"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), langid.predict(docs, profiles).alias("p")).select("doc_id", "held_out", "p.*")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From OLD_SHARDS shards by the text's checksum to SHARDS shards of near equal size."""
    work = WorkTables(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    rows, _ = resharding.reshard(docs, old, OLD_SHARDS, SHARDS, work.path(), work)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents whose id has a checksum divisible by 10, words from some place on repeat one period."""
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    planted = rows.where("h % 10 = 0").select("doc_id", words.alias("w"), F.floor(F.col("h") / 10).alias("g"))
    planted = planted.withColumn("a", F.when(F.size("w") > 0, F.pmod("g", F.size("w"))).cast("int"))
    planted = planted.withColumn("p", F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    moved = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.element_at("w", F.col("a") + F.pmod(i - F.col("a"), "p") + 1)))
    text = F.when(F.size("w") > 0, F.array_join(moved, " "))
    return rows.where("h % 10 != 0 OR h IS NULL").select("doc_id", "text").union(planted.select("doc_id", text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("longest", longest).select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts with a letter of every 31st occurrence left out, by checksum; a null id counts as an empty one."""
    run = F.explode(spelling_variants.runs_of_letters(F.col("text"), 7)).alias("run")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    rows = rows.select("id", spelling_variants.lowered(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = planted_words(table(spark, sf_dir, "documents"))
    return spelling_variants.group_variants(words, WorkTables(spark, "spelling")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in base]  # noqa: B023
    return found.select(
        F.col("key").alias("doc_id"), *counts, F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: function
        for name, function in globals().items()
        if name.startswith("op") and name[2:3].isdigit()
    }


# crc32 as SQL: c starts with all bits set and takes a byte at a time through the table ``crc``; the polynomial is fixed.
CRC = """
        crc AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
        )"""
CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE = {
    "op3_caps": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(vec_id, r) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, y FROM reach JOIN links ON x = r
        ), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
        FROM reach LEFT JOIN n ON x = vec_id GROUP BY vec_id
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) ELSE page_id END AS best FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN best <> page_id THEN best END AS refers_to FROM q
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                   length(coalesce(text, '')) AS points
            FROM documents
        ), w AS (
            SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id
            FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN w USING (text_sha256)
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) >= 5
                THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM w
        ), t AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
        met AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS MATERIALIZED (
            SELECT x, y FROM met JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)
        ), reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r
        )
        SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
    """,
}

ORACLE["op11_periodic_runs"] = (
    "WITH"
    + CRC
    + r""", w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   """
    + CRC_OF.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")
    + r""" AS h
            FROM documents, crc
        ), a AS (
            SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w
        ), v AS MATERIALIZED (
            SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS v
            FROM a
        ), g AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(v[i:i + 5], ' ') AS g FROM (SELECT doc_id, v, unnest(range(1, len(v) - 4)) AS i FROM v)
        ), met AS MATERIALIZED (
            SELECT doc_id, y.i - x.i AS lag, y.i, y.i - row_number() OVER (PARTITION BY doc_id, y.i - x.i ORDER BY y.i) AS island
            FROM g x JOIN g y USING (doc_id, g) WHERE y.i > x.i
        ), streaks AS (
            SELECT doc_id, lag, min(i) - 1 - lag AS start, count(*) + 5 + lag AS length FROM met GROUP BY doc_id, lag, island HAVING count(*) + 5 >= greatest(lag, 12 - lag)
        ), runs AS MATERIALIZED (
            SELECT doc_id, start, length, min(lag) AS period FROM streaks GROUP BY doc_id, start, length
        ), told AS (
            SELECT doc_id, count(*) AS n_runs, first(runs ORDER BY length DESC, start, period) AS top,
                   string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY doc_id
        ), word AS (
            SELECT doc_id, unnest(v) AS word, unnest(range(len(v))) AS i FROM v
        ), dropped AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
        )
        SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
               1000 * top.length // top.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM v LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
    """
)
ORACLE["op12_spelling"] = (
    "WITH RECURSIVE"
    + CRC
    + r""", r AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
        ), h AS MATERIALIZED (
            SELECT r, """
    + CRC_OF.format(
        bytes="flatten(list_transform(string_split(concat(doc_id, ':', r), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))"
    )
    + r""" AS h
            FROM r, crc
        ), n AS MATERIALIZED (
            SELECT word, count(*) AS n
            FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(left(r, h % length(r)), substr(r, h % length(r) + 2)) ELSE r END AS word FROM h)
            WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
        ), cut AS MATERIALIZED (
            SELECT word, length(word) AS size, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM n)
        ), pairs AS MATERIALIZED (
            SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (size, i, rest) WHERE a.word <> b.word
            UNION SELECT cut.word, n.word FROM cut JOIN n ON rest = n.word
            UNION SELECT n.word, cut.word FROM cut JOIN n ON rest = n.word
        ), best AS (
            SELECT pairs.word, count(*) AS n_near, first(near ORDER BY n.n DESC, near) AS near, max(n.n) AS near_n FROM pairs JOIN n ON n.word = near GROUP BY pairs.word
        ), f AS MATERIALIZED (
            SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n.n THEN near END AS form, CASE WHEN near_n >= 10 * n.n THEN near_n END AS form_n
            FROM n LEFT JOIN best USING (word)
        ), follow(word, last) AS (
            SELECT word, word FROM f UNION ALL SELECT follow.word, form FROM follow JOIN f ON f.word = last WHERE form IS NOT NULL
        )
        SELECT f.word, f.form, last AS root, f.n, f.n_near, f.form_n FROM f JOIN follow USING (word) JOIN f e ON e.word = last WHERE e.form IS NULL
    """
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
