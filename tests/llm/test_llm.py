"""The training-data operators against SQL, brute force and exact round trips, on edge cases and given tables."""

import gzip
import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from shelfspark.llm import caps, exact_dedup, langid, licenses, mixing, ngram_join, quality, queries, resharding, sentencepiece_codec, warc
from shelfspark.llm.common import WorkTables, held_out
from shelfspark.llm.components import components

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, size string, score string"


def documents(spark, rows):
    """rows: (doc_id, text, source); extra columns clash with names the operators give."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 7, "y", "z") for i, t, s in rows], DOCS)


def work(spark, name):
    return WorkTables(spark, name)


ODD = [(1, "", "a"), (2, None, "a"), (3, " \n\t", None), (4, "one two", "b"), (4, "one two", "b"), (None, "one two", "b"), (5, "Ünïcode ½ 日本 " * 3000, ""), (6, "one  TWO", "b")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(contract.oracle_sql()[name])
    got = contract.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda columns, found: sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


# --- 1 ------------------------------------------------------------------------


def unigram_model():
    """A hand-written unigram model with byte fallback, as protobuf bytes."""

    def field(number, wire, data):
        head = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 0x7F | 0x80, number >> 4])
        return head + (bytes([len(data) & 0x7F | 0x80, len(data) >> 7]) if wire == 2 and len(data) > 127 else bytes([len(data)]) if wire == 2 else b"") + data

    out = b""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.5, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("aba", -5.5, 1), ("ba", -4.1, 1), ("▁b", -4.3, 1)]
    for piece, score, kind in pieces:
        body = field(1, 2, piece.encode()) + field(2, 5, np.float32(score).tobytes()) + (field(3, 0, bytes([kind])) if kind != 1 else b"")
        out += field(1, 2, body)
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normaliser = field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")
    return out + field(2, 2, trainer) + field(3, 2, normaliser)


TEXTS = ["", " ", "  ", "a", "abab ba", " ab", "ab ", "a\nb", "x\0y é 🙂", "▁ab▁", "ab" * 500, "a  b   ab"]


@pytest.mark.parametrize("kind", ["unigram", "file"])
def test_sentencepiece_parity(kind):
    import sentencepiece

    data = unigram_model() if kind == "unigram" else open(queries.SENTENCEPIECE_MODEL, "rb").read()
    own = sentencepiece_codec.Codec(data)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text, (raw, same) in zip(TEXTS, own.encode(TEXTS), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert same and ids == theirs.encode(text)
        assert own.decode(ids) == text.replace("▁", " ") == own.tokenizer.decode(ids, skip_special_tokens=False)


def test_sentencepiece_rows(spark):
    got = sentencepiece_codec.encode(documents(spark, ODD), queries.SENTENCEPIECE_MODEL)
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.parity and r.round_trip for r in rows)
    assert [r.ids is None for r in rows if r.doc_id == 2] == [True] and [r.ids for r in rows if r.doc_id == 1] == [[]]
    back = sentencepiece_codec.decode(got, queries.SENTENCEPIECE_MODEL).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t) for i, t, _ in ODD)
    assert sentencepiece_codec.encode(documents(spark, []), queries.SENTENCEPIECE_MODEL).count() == 0


# --- 2 ------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows = queries.op2_mixing(spark, FOLDER).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        source = docs[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    assert len(rows) == len(docs) and math.isclose(sum(target.values()), 1.5 * sum(sizes.values()))
    # Documents are taken whole: 50 per source here, of up to some thousand words.
    assert all(abs(taken[s] - target[s]) <= 0.002 * target[s] for s in sizes)
    weight = dict(zip(sorted(sizes), itertools.cycle((3, 1, 2))))
    free = [s for s in sizes if target[s] < 2 * sizes[s]]
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1
    assert sorted(rows) == sorted(queries.op2_mixing(spark, FOLDER).collect())


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 50), ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b", None]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    targets = {"a": 9000.0, "b": 6000.0, None: 500.0}
    rule, totals = mixing.mix(docs, targets, work(spark, "mix"), sources=F.col("sources"))
    given = {r.pattern: r.given for r in totals.collect()}
    assert sum(given.values()) == 15500
    got = mixing.copies(docs, rule, "times", sources=F.col("sources")).withColumn("p", mixing.pattern(F.col("sources")))
    for r in got.groupBy("p").agg(F.sum(F.col("times") * mixing.words(F.col("text"))).alias("n"), F.max("times").alias("most")).collect():
        assert abs(r.n - given[r.p]) <= 0.002 * given[r.p] and r.most <= 2


def test_mixing_edge_cases(spark):
    docs = documents(spark, ODD)
    rule, _ = mixing.mix(docs, None, work(spark, "mix"))
    assert mixing.copies(docs, rule, "times").count() == len(ODD)
    empty = documents(spark, [])
    rule, totals = mixing.mix(empty, None, work(spark, "mix"))
    assert mixing.copies(empty, rule, "times").count() == totals.count() == 0


# --- 3 ------------------------------------------------------------------------


def brute_links(vectors):
    """(links, component) per row for vectors that may link."""
    n, links = len(vectors), Counter()
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        a, b = vectors[i], vectors[j]
        if a is None or b is None or len(a) != len(b):
            continue
        a, b = np.array(a), np.array(b)
        if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i] += 1
            links[j] += 1
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return links, [root(i) for i in range(n)]


def test_caps_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 16)
    random_ = np.random.default_rng(5)
    centres = random_.standard_normal((30, 24))
    rows = [(centres[i % 30] + 0.22 * random_.standard_normal(24)).tolist() for i in range(240)]
    rows += [rows[0]] * 40 + [[1.0, 2.0], [1.0, 2.01], [3.0]]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    links, label = brute_links(rows)
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows + odd)], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in caps.near_duplicates(table, work(spark, "caps")).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(len(rows), len(got)))
    assert caps.near_duplicates(table.limit(0), work(spark, "caps")).count() == 0


def test_caps_recall_at_the_limit():
    random_ = np.random.default_rng(1)
    x = caps.unit(random_.standard_normal((1500, 64)))
    z = random_.standard_normal((1500, 64))
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * caps.unit(z)
    for vectors in (200, 50_000):
        plan = caps.plan_caps(vectors)
        found = [np.intersect1d(a, b).size > 0 for a, b in zip(caps.decode_caps(x, plan), caps.decode_caps(y, plan), strict=True)]
        assert np.mean(found) > 0.995


@pytest.mark.parametrize("dimensions", [24, 64, 256])
@pytest.mark.parametrize("vectors", [10**6, 10**7, 10**8, 10**10])
def test_caps_recall_does_not_fall_with_the_rows(vectors, dimensions):
    random_ = np.random.default_rng(2)
    x = caps.unit(random_.standard_normal((400, dimensions)))
    z = random_.standard_normal((400, dimensions))
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * caps.unit(z)
    plan = caps.plan_caps(vectors, dimensions=dimensions)
    shared = np.array([np.intersect1d(a, b).size for a, b in zip(caps.decode_caps(x, plan), caps.decode_caps(y, plan), strict=True)])
    assert 0.8 * caps.SHARED < shared.mean() < 1.25 * caps.SHARED
    assert np.mean(shared > 0) > 0.99


def test_components(spark):
    random_ = random.Random(3)
    links = [(random_.randrange(400), random_.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(300)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), work(spark, "components")).collect()}
    assert all(got.get(node, node) == root(node) for node in parent)


# --- 4 ------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 700
    pages = [(1, "http://x/ä b", "short"), (2, None, long), (9, "u", long), (9, "u", "short"), (5, "u", None), (None, "u", long), (7, "u\r\nX: 1", "y" * 300_000)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    manifest = work(spark, "warc").cut(warc.write_archives(warc.classified(table), f"file://{tmp_path}/a", file_bytes=400))
    for size in (37, 1000, 1 << 20):
        got = warc.read_archives(manifest, range_bytes=size).collect()
        assert len(got) == len(pages) and all(r.sound for r in got)
        for (page, _, html), r in zip(sorted(pages, key=str), sorted(got, key=lambda r: str((r.page_id, "", (r.payload or long.encode()).decode()))), strict=True):
            data = (html or "").encode()
            revisit = html == long and page != 9
            assert (r.page_id, r.payload_bytes, r.payload_digest) == (page, len(data), hashlib.sha1(data).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
            assert revisit or r.payload == data
    files = [open(r.path.removeprefix("file://"), "rb").read() for r in manifest.collect()]
    assert len(files) > 1 and all(gzip.decompress(f).startswith(b"WARC/1.1\r\n") for f in files)
    none = work(spark, "warc").cut(warc.write_archives(warc.classified(table.limit(0)), f"file://{tmp_path}/b"))
    assert warc.read_archives(none).count() == 0


def test_warc_ranges_own_each_record_once():
    noise = [bytes(random.Random(i).randbytes(5000)) + warc.MAGIC + b"\x08\x00" for i in range(30)]
    raw = [warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None, "2024-01-01T00:00:00Z") for i, p in enumerate(noise)]
    # Stored blocks, so that the magic inside the payloads stays visible.
    parts = []
    for data in raw:
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        parts.append(packer.compress(data) + packer.flush())
    whole = b"".join(parts)
    for step in (100, 4096, 50_000, len(whole)):
        found = [x for start in range(0, len(whole), step) for x in warc.members(io.BytesIO(whole), start, start + step)]
        assert [x for _, x in found] == raw


# --- 5 ------------------------------------------------------------------------


def test_quality_held_out(spark):
    rows = queries.op5_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_quality_edge_cases(spark):
    rows = quality.with_features(documents(spark, ODD))
    for labels in ([], [1] * len(ODD), [None, 1, 0, 1, 0, 1, 0, 1]):
        known = rows.withColumn("label", F.lit(None).cast("int")) if not labels else rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.coalesce(F.col("doc_id"), F.lit(1)).cast("int")))
        forest = quality.train(known)
        got = rows.select(quality.score(rows, forest).alias("s")).collect()
        assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    assert quality.with_features(documents(spark, [])).count() == 0


def test_flat_trees_equal_a_walk():
    random_ = np.random.default_rng(0)
    x = random_.standard_normal((500, len(quality.FEATURES)))
    forest = quality.fit(x, (x[:, 0] + x[:, 3] > 0).astype(float))
    total = np.full(500, forest.base)
    for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
        for i in range(500):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > limit[node] else 1)
            total[i] += leaf[node - len(feature)]
    assert np.allclose(forest.scores(x), 1 / (1 + np.exp(-total)))


# --- 6 ------------------------------------------------------------------------


def brute_block(words, template):
    """The most distinct template words in any run of the template's length."""
    own = set(template.rank)
    n = template.length
    best = max((len(own.intersection(words[i : i + n])) for i in range(max(1, len(words) - n + 1))), default=0)
    return best if best >= template.needed else 0


def test_license_blocks_against_brute_force():
    random_ = random.Random(2)
    for _ in range(60):
        frequency = {w: random_.randrange(50) for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)}
        templates = licenses.templates_by(frequency)
        text = []
        for name in random_.sample(sorted(licenses.TEMPLATES), 2):
            text += [w for w in licenses.words_of(licenses.TEMPLATES[name]) if random_.random() > 0.15] + [b"filler"] * random_.randrange(30)
        assert [licenses.best_block(text, t) for t in templates] == [brute_block(text, t) for t in templates]


def test_license_phrases(spark):
    rows = [(1, "The MIT License. mit-license MIT LICENSES", "a"), (2, "general public license license apache license é mitlicense", "a"), *ODD]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(documents(spark, rows)).collect()}
    first, second = got[1, 7], got[2, 8]
    assert (first.n_base, first.first_word, first.last_word, first.base_labels, first.score) == (2, 1, 3, "mit", 1.0)
    assert (second.n_base, second.first_word, second.last_word, second.base_labels) == (2, 0, 4, "apache,gpl")
    assert (got[2, 0].n_base, got[2, 0].first_word, got[2, 0].labels, got[2, 0].score) == (0, None, "", 0.0)
    assert licenses.scan(documents(spark, [])).count() == 0


# --- 7 ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), "V32")
    seeds, slots = exact_dedup.perfect_hash(keys)
    assert sorted(slots) == list(range(n)) and (exact_dedup.look_up(keys, n, seeds) == slots).all()


@pytest.mark.parametrize("before", ["true", "false", "doc % 2 = 0"])
def test_exact_dedup_against_brute_force(spark, before):
    random_ = random.Random(4)
    rows = [(i, random_.choice([" ", "\n", "\x0b"]).join(random_.choices(["a", "b", "ab", ""], k=random_.randrange(5))), "s") for i in range(300)] + ODD
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups["".join((text or "").split(" ")).translate({c: None for c in (9, 10, 11, 12, 13, 32)})].append((-len(text or ""), i is None, i))
    best = {normal: min(found, key=lambda x: (x[0], x[1], x[2] or 0))[2] for normal, found in groups.items()}
    got = exact_dedup.dedup(documents(spark, rows), work(spark, "exact"), in_history=F.expr(f"coalesce({before}, false)")).collect()
    want = []
    for i, text, _ in rows:
        normal = (text or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)})
        want.append((i, best[normal], len(groups[normal]), i == best[normal], hashlib.sha256(normal.encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_dedup_keeps_one_row_of_each_class(spark):
    kept = exact_dedup.keep_winners(documents(spark, ODD), work(spark, "exact"))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r.doc_id, (r.text or "")[:8]) for r in kept.collect()) == [(3, " \n\t"), (4, "one two")[:2], (5, "Ünïcode "), (6, "one  TWO")]
    assert exact_dedup.keep_winners(documents(spark, []), work(spark, "exact")).count() == 0


# --- 8 ------------------------------------------------------------------------


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, (i, _)), (b, (j, _)) in itertools.combinations(enumerate(rows), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("frequent", [None, 3])
def test_ngram_join_against_brute_force(spark, monkeypatch, frequent):
    if frequent:
        # All but the rarest buckets count as frequent, so pairs and their prefixes carry the join.
        whole = ngram_join.signatures
        monkeypatch.setattr(ngram_join, "_signature_rows", lambda docs, counts, _, bits, f=ngram_join._signature_rows: f(docs, counts, frequent, bits))
        assert whole is ngram_join.signatures
    random_ = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = random_.choices(vocabulary, k=40)
    rows = []
    for _ in range(45):
        base = random_.choices(vocabulary, k=random_.choice([4, 6, 9, 14, 25, 60, 150]))
        if random_.random() < 0.5:
            base += passage
        for _ in range(random_.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(random_.randrange(0, 1 + len(copy) // 25)):
                where = random_.randrange(len(copy))
                random_.choice([lambda: copy.insert(where, "new"), lambda: copy.pop(where), lambda: copy.__setitem__(where, random_.choice(vocabulary))])()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " ", "A b", "a  B", "a b c d", "a b c d e"])]
    got = ngram_join.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), work(spark, "ngrams"), sketch_bits=16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_near(rows)


def test_ngram_join_of_long_texts(spark):
    """Sets that saturate the short sketch: copies near the limit link, texts that share half their passages do not."""
    random_ = random.Random(11)
    rows = []
    for group, n in enumerate((505, 520, 700, 1020, 1030, 2100)):
        base = [f"w{random_.randrange(5000)}" for _ in range(n)]
        for changed in (0, 2, 8, 11, 14, 18, 25, 40):
            words = list(base)
            for at in random_.sample(range(n), n * changed // 500):
                words[at] = f"new{at}"
            rows.append((len(rows), " ".join(words)))
        half = base[: n // 2] + [f"other{group}{random_.randrange(5000)}" for _ in range(n - n // 2)]
        rows.append((len(rows), " ".join(half)))
        rows.append((len(rows), " ".join(base[: n * 5 // 6])))
    sets = {i: set(ngram_join.shingle_set(t, ngram_join.WordHashes()).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    got = ngram_join.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), work(spark, "ngrams"), sketch_bits=16)
    assert {r.doc_id: r.component_id for r in got.collect()} == root
    assert 1 < len(set(root.values())) < len(rows)


def test_ngram_join_edge_cases(spark):
    got = ngram_join.near_duplicates(documents(spark, ODD), work(spark, "ngrams"), sketch_bits=16).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, 4), (5, 5), (6, 4)])
    assert ngram_join.near_duplicates(documents(spark, []), work(spark, "ngrams"), sketch_bits=16).count() == 0


def test_prefixes_share_a_signature():
    """Any two sets at the threshold share a signature, whatever the classes of their tokens."""
    random_ = np.random.default_rng(6)
    for _ in range(4000):
        n = int(random_.integers(1, 120))
        x = ngram_join.mix64(random_.integers(0, 1 << 62, n).astype(np.uint64))
        room = int(n / 0.8 - n) + 1
        extra = int(random_.integers(0, room + 1))
        most = 0
        while n - most - 1 >= 0.8 * (n + extra):
            most += 1
        y = np.unique(np.concatenate([random_.permutation(x)[: n - int(random_.integers(0, most + 1))], ngram_join.mix64(random_.integers(0, 1 << 62, extra).astype(np.uint64))]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(np.union1d(x, y))):
            continue
        counts = (random_.random(1 << 16) < random_.random()).astype(np.uint32) * 9
        a, b = (ngram_join.signatures(np.unique(s), counts, 5, 16)[0] for s in (x, y))
        assert len(np.intersect1d(a, b))


# --- 9 ------------------------------------------------------------------------


def test_language_held_out(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_vectors_are_sums_of_bound_letters():
    letters = langid.Letters()
    text = "Ab, ab é!"
    letter = {c: letters.table[letters.rows(np.array([ord(c)], np.uint64))[0]].astype(int) for c in " abé"}
    padded = " ab ab é "
    total = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(padded, padded[1:], padded[2:], strict=False))
    got = langid.text_vectors([text, None, "12 3"], langid.Letters())
    assert np.allclose(got[0], total / np.linalg.norm(total), atol=1e-6) and not got[1:].any()


def test_language_edge_cases(spark):
    docs = documents(spark, [*ODD, (8, "123 !?", "a")])
    got = {(r.doc_id): r.p for r in docs.select("doc_id", langid.predict(docs, langid.train(docs.where(~held_out()))).alias("p")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[4].lang_pred == "en"
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.p.lang_pred for r in docs.select(langid.predict(docs, none).alias("p")).collect()} == {"und"}
    assert langid.train(documents(spark, [])).languages == ()


def test_pipeline_language_stage_drops_foreign_scripts_and_keeps_short_clean_texts(spark):
    random_ = random.Random(4)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scripts = [(0x430, 0x44F), (0x4E00, 0x9FFF), (0x621, 0x63A), (0x3B1, 0x3C9)]

    def foreign(low, high, n):
        return " ".join("".join(chr(random_.randint(low, high)) for _ in range(random_.randint(2, 8))) for _ in range(n))

    strange = [foreign(*script, n) for script in scripts for n in (1, 3, 200) for _ in range(30)]
    clean = sorted({w for r in docs.where("text is not null").limit(300).collect() for w in langid.LETTERS.findall(r.text)})
    clean = ["Avec.", "a", "I", *random_.sample(clean, 1500)]
    given = [(10**9 + i, text, None, "x", len(text)) for i, text in enumerate(strange + clean)]
    added = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    known = docs.select(columns)
    # Where a learned text quotes the scripts, their letters tell nothing; long texts are still told by the noise.
    quote = known.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" " + " ".join(strange))))
    quoted = corpus_pipeline.language(spark, known.unionByName(quote).unionByName(added), "").where("doc_id >= 1000000000")
    found = {r.doc_id - 10**9 for r in quoted.collect()}
    assert not [i for i in range(len(strange)) if i in found and len(strange[i]) > 200]
    assert [i for i in range(len(strange), len(given)) if i not in found] == []
    kept = {r.doc_id - 10**9 for r in corpus_pipeline.language(spark, known.unionByName(added), "").where("doc_id >= 1000000000").collect()}
    assert not [i for i in range(len(strange)) if i in kept]
    assert [i for i in range(len(strange), len(given)) if i not in kept] == []


# --- 10 -----------------------------------------------------------------------


def test_transfers_move_the_fewest_bytes():
    for old, new in (([10, 0, 5], [5, 5, 5]), ([9, 9], [6, 6, 6]), ([7, 1, 1, 3], [12]), ([0], [0, 0])):
        moves = resharding.transfers(old, new)
        assert [sum(r) for r in moves] == old and all(sum(c) <= n for c, n in zip(zip(*moves, strict=True), new, strict=True))
        moved = sum(m for i, r in enumerate(moves) for j, m in enumerate(r) if i != j)
        assert moved == sum(max(0, o - (new[i] if i < len(new) else 0)) for i, o in enumerate(old))


def test_resharding(spark):
    rows = queries.op10_resharding(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[data].add(r.shard)
    assert len(rows) == len(texts) and sorted(load) == list(range(8)) and max(load.values()) < 1.01 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())


def test_resharding_hot_text_and_edges(spark):
    hot = [(i, "hot text " * 20, "s") for i in range(400)] + [(1000 + i, f"text {i} " * 10, "s") for i in range(600)] + ODD
    old = F.when(F.col("text").startswith("hot"), 0).otherwise(F.pmod(F.xxhash64("text"), F.lit(3)))
    store = work(spark, "shards")
    rows, layout = resharding.reshard(documents(spark, hot), old, 3, 4, store.path(), store)
    got = rows.collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(got) == len(hot) and max(load.values()) - min(load.values()) <= 65_000 + sum(load.values()) // 100
    rows, _ = resharding.reshard(documents(spark, []), old, 3, 4, store.path(), store)
    assert rows.count() == 0


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    store = work(spark, "pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(store.cut(stage(spark, seen[-1], FOLDER)))
    start, language, exact, near, mixed, encoded = ([tuple(r) for r in s.collect()] if k < 5 else s.collect() for k, s in enumerate(seen))
    assert all(s.columns == docs.columns for s in seen[:5])
    assert set(language) <= set(start) and all(any(c.isalpha() for c in r[1] or "") for r in language)
    best = {}
    for r in language:
        normal = r[1].translate({c: None for c in (9, 10, 11, 12, 13, 32)})
        best[normal] = min(best.get(normal, r), r, key=lambda r: (-len(r[1]), r[0]))
    assert sorted(exact) == sorted(best.values())
    label = brute_near(sorted((r[0], r[1]) for r in exact))
    assert sorted(near) == sorted(r for r in exact if label[r[0]][1] == r[0])
    times = Counter(mixed)
    assert set(times) <= set(near) and max(times.values()) <= 2
    sizes = Counter()
    taken = Counter()
    for r in near:
        sizes[r[3]] += len(r[1].encode().split())
    for r in mixed:
        taken[r[3]] += len(r[1].encode().split())
    target = mixing.shared_targets(list(sizes.items()))
    off = {s: round(abs(taken[s] - target[s]) / target[s], 5) for s in sizes}
    # Whole documents again, some 45 of very different lengths per source.
    assert max(off.values()) <= 0.01, off
    assert Counter(r.doc_id for r in encoded) == Counter(r[0] for r in mixed) and all(r.parity and r.round_trip for r in encoded)


def test_pipeline_takes_odd_rows(spark):
    for rows in (ODD, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = work(spark, "odd").cut(stage(spark, docs, FOLDER))
        assert docs.columns[:2] == ["doc_id", "ids"]
