"""Periodic runs, spelling variants and secret scans against their definitions, on edge cases and hot texts."""

import base64
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfspark.llm import periodic_runs, queries, secret_scan, spelling_variants
from shelfspark.llm.common import WorkTables

FOLDER = "/root/testdata/sf0.01"
# Extra columns clash with names the operators give.
DOCS = "doc_id long, text string, key long, runs string, spans string, word string, n long, node string, state int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "s", "w", 2, "n", 3) for i, t in rows], DOCS)


# --- 11 -----------------------------------------------------------------------


def runs_by_definition(words):
    """Maximal matches on every diagonal; of equal stretches the smallest period."""
    found = {}
    for lag in range(1, len(words)):
        i = lag
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - lag]:
                i += 1
            if i - first >= max(lag, 12 - lag):
                found.setdefault((first - lag, i - first + lag), lag)
            i += 1
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def found_runs(words):
    return [tuple(r) for r in periodic_runs.find_runs(periodic_runs.numbered(words)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 9), st.integers(0, 40)), max_size=8))
def test_runs_by_definition(parts):
    words = []
    for unit, times, again in parts:
        words += unit * times + words[:again]
    assert found_runs(words) == runs_by_definition(words)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_letters(seed):
    draw = random.Random(seed)
    words = [draw.choice("ab" if seed % 2 else "abcd") for _ in range(900)]
    assert found_runs(words) == runs_by_definition(words)


def test_runs_of_hot_texts():
    """Texts whose words, squares or lines repeat everywhere take n log n steps, and every run is found."""
    n = 200_000
    assert found_runs(["a"] * n) == [(0, n, 1)]
    two = ["a"] * n + ["x"] + ["a"] * n
    assert found_runs(two) == [(0, n, 1), (n + 1, n, 1)]
    mirrored = found_runs(["a", "b"] * 3000 + ["b", "a"] * 3000)
    # The two of period 2, and one around the middle for each odd period from 7 on.
    assert mirrored[0] == (0, 6000, 2) and len(mirrored) == 2 + 2997
    short = ["a", "b"] * 90 + ["b", "a"] * 90
    assert found_runs(short) == runs_by_definition(short)
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert found_runs(b) == runs_by_definition(b)
    # Thue and Morse's word has no run of three periods.
    morse = [bin(i).count("1") % 2 for i in range(1 << 16)]
    assert max(length / period for _, length, period in found_runs(morse)) == 2


def test_detect_edge_cases(spark):
    loop = " ".join(["x", "y", "z"] * 5)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, loop), (4, loop), (None, f"start {loop} x\ny end"), (5, "é " * 12), (6, "日本 語 " * 400_000)]
    got = {}
    for r in periodic_runs.detect(documents(spark, rows)).collect():
        got.setdefault(r.key, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(15, [(0, 15, 3)], "x y z")] * 2
    assert got[None] == [(19, [(1, 17, 3)], "start x y z end")]
    assert got[5] == [(12, [(0, 12, 1)], "é")]
    assert got[6] == [(400_000, [(0, 400_000, 1)], "日本 語")]
    empty = periodic_runs.detect(documents(spark, []))
    assert empty.columns == ["key", "n_words", "runs", "collapsed"] and empty.count() == 0


def test_op11_by_definition(spark):
    texts = [(i, " ".join(random.Random(i).choice(["la", "lo", "li", "x"]) for _ in range(i * 7 % 90))) for i in range(60)] + [(60, None), (61, " ")]
    rows = {r.doc_id: r for r in _op11(spark, texts)}
    planted = 0
    for doc, text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = runs_by_definition(words)
        gone = {i for start, length, period in runs for i in range(start + period, start + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        got = rows[doc]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *(top or (None,) * 3))
        assert got.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted >= 3


def _op11(spark, texts):
    folder = f"{WorkTables(spark, 'op11').root}"
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    return queries.op11_periodic_runs(spark, folder).collect()


# --- 12 -----------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_definition(counts, ratio=10):
    out = {}
    for word, n in counts.items():
        others = [other for other in counts if other != word and near(word, other)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        out[word] = (n, len(others), best if best is not None and counts[best] >= ratio * n else None)
    result = {}
    for word, (n, n_near, form) in out.items():
        root = word
        while out[root][2] is not None:
            root = out[root][2]
        result[word] = (n, n_near, form, counts[form] if form is not None else None, root)
    return result


def grouped(spark, counts, **sizes):
    rows = spark.createDataFrame([(w, n, 5, "x") for w, n in counts.items()], "word string, n long, state int, node string")
    found = spelling_variants.group_variants(rows, WorkTables(spark, "spelling"), **sizes).collect()
    assert len(found) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


@pytest.mark.parametrize("sizes", [{}, {"node_words": 40, "node_searches": 60}, {"node_words": 1, "node_searches": 2}])
def test_variants_by_definition(spark, sizes):
    draw = random.Random(7)
    letters = "aelmnostéüßÿÀ×"
    counts = {}
    while len(counts) < 250:
        word = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 4, 4])))
        counts[word] = draw.choice([2, 3, 5, 30, 400, 6000, 10**5])
    long = "ab" * 300
    counts |= {long: 2, long[:-1]: 25, "b" + long[1:]: 3, long + "c": 2, long[::-1]: 2}
    assert grouped(spark, counts, **sizes) == variants_by_definition(counts)


def test_forms_are_followed_to_the_last(spark):
    counts = {"kitten" + "s" * i: 2 * 10**i for i in range(12)}
    got = grouped(spark, counts)
    assert {r[4] for r in got.values()} == {"kitten" + "s" * 11}
    assert got == variants_by_definition(counts)


def test_variants_of_nothing(spark):
    assert grouped(spark, {}) == {}
    assert grouped(spark, {"lonely": 4}) == {"lonely": (4, 0, None, None, "lonely")}


def test_one_edit_is_verified_letter_by_letter():
    draw = random.Random(5)
    words = ["".join(draw.choice("ab") for _ in range(draw.choice([0, 1, 2, 5, 6, 7, 48, 49, 50, 60]))).encode() for _ in range(300)]
    words += [w[:20] + b"c" + w[20:] for w in words[:100]] + [w[:-1] for w in words[:100]]
    both = spelling_variants.Words(words)
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if len(words[j]) - len(words[i]) in (0, 1)]
    a, b = (np.array(c) for c in zip(*pairs, strict=True))
    good = set(zip(*(x.tolist() for x in spelling_variants.verified(both, both, a, b)), strict=True))
    assert good == {(i, j) for i, j in pairs if near(words[i], words[j])}
    assert all(spelling_variants.one_edit(words[i], words[j]) == near(words[i], words[j]) for i, j in pairs[::7])


def test_op12_counts_runs_of_whole_texts(spark):
    folder = f"{WorkTables(spark, 'op12').root}"
    texts = [(i, f"Spelling SPELLING Élégance{i % 2} ÉLÉGANCE rebuilding-rebuilding " + "wordword " * (i % 5)) for i in range(40)] + [(40, None), (None, "spelling"), (41, "x" * 3_000_000), (42, "")]
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    counts = {}
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op12_spelling(spark, folder).collect()}
    assert got == variants_by_definition(counts) and "Élégance" in got and "ÉlÉgance" in got


# --- 13 -----------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(len(body).to_bytes((len(body).bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(bits, draw):
    return der(2, b"\0" + bytes([0x80 | draw.getrandbits(7)]) + draw.randbytes(bits // 8 - 1))


def string(data):
    return len(data).to_bytes(4, "big") + data


DRAW = random.Random(11)
ZERO, ONE = der(2, b"\0"), der(2, b"\1")
CURVE = der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")
RSA = der(0x30, ZERO, *(integer(b, DRAW) for b in (1024, 24, 1024, 512, 512, 512, 512, 512)))
DSA = der(0x30, ZERO, *(integer(b, DRAW) for b in (1024, 160, 1024, 1024, 160)))
EC = der(0x30, ONE, der(4, DRAW.randbytes(32)), der(0xA0, CURVE), der(0xA1, der(3, b"\0\4" + DRAW.randbytes(64))))
PKCS8 = der(0x30, ZERO, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, RSA))
SEALED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d"), der(0x30, der(4, DRAW.randbytes(8)))), der(4, DRAW.randbytes(160)))
SSH = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(DRAW.randbytes(51)) + string(DRAW.randbytes(136))
KEYS = {"rsa": RSA, "dsa": DSA, "ec": EC, "pkcs8": PKCS8, "sealed": SEALED, "ssh": SSH}
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(3, b"\0" + der(0x30, integer(1024, DRAW), integer(24, DRAW))))


def kinds(text, *wanted):
    return [(k, text[a:b]) for k, a, b in secret_scan.spans(text) if k in (wanted or secret_scan.KINDS)]


@pytest.mark.parametrize("name", KEYS)
def test_keys_are_confirmed_in_every_encoding(name):
    key = KEYS[name]
    one_line = base64.b64encode(key).decode()
    assert kinds(f"k = {one_line}, then", "key") == [("key", one_line)]
    wrapped = "\n".join(one_line[i : i + 64] for i in range(0, len(one_line), 64))
    text = f"é日-----BEGIN PRIVATE KEY-----\r\n{wrapped}\n-----END PRIVATE KEY-----\n"
    assert kinds(text, "key") == [("key", wrapped)]
    escaped = wrapped.replace("\n", "\\n")
    assert kinds(json.dumps({"key": f"-----BEGIN X-----\n{wrapped}\n"}), "key") == [("key", escaped)]
    for letters in (key.hex(), key.hex().upper()):
        assert kinds(f"x{letters}x", "key") == [("key", letters)]
    assert kinds(f"{one_line.rstrip('=')} {one_line}", "key")[0] == ("key", one_line.rstrip("="))


@pytest.mark.parametrize("name", KEYS)
def test_broken_keys_are_refused(name):
    key = KEYS[name]
    assert not kinds(base64.b64encode(key[:-1]).decode(), "key") and not kinds(key[:-1].hex(), "key")
    # An inner length that does not add up.
    at = 4 if key[0] == 0x30 and key[1] & 0x80 else 3
    broken = bytearray(key)
    broken[at + 1 if name != "ssh" else 18] ^= 0x41
    assert not kinds(base64.b64encode(bytes(broken)).decode(), "key")


def test_public_keys_and_random_letters_are_no_secrets():
    assert not kinds(base64.b64encode(PUBLIC).decode() + " " + PUBLIC.hex(), "key", "jwt")
    draw = random.Random(2)
    for _ in range(300):
        data = b"\x30\x82" + draw.randbytes(300)
        assert not kinds(base64.b64encode(data).decode() + " " + data.hex(), "key", "jwt")


def token(head, claims, signature):
    return ".".join(base64.urlsafe_b64encode(part).decode().rstrip("=") for part in (json.dumps(head).encode(), json.dumps(claims).encode(), signature))


def test_signed_tokens_are_confirmed():
    good = token({"alg": "HS256", "typ": "JWT"}, {"sub": "é"}, os.urandom(32))
    assert kinds(f"日 Bearer {good}.", "jwt") == [("jwt", good)]
    assert kinds(token({"typ": "JWT", "alg": "RS256"}, {}, os.urandom(256)), "jwt")
    for head, claims, size in [
        ({"alg": "none"}, {}, 32), ({"alg": "HS256"}, {}, 31), ({"alg": 5}, {}, 32), ({"typ": "JWT"}, {}, 32), ({"alg": "HS256"}, [1], 32), ({"alg": "RS256"}, {}, 64), ({"alg": "ES256"}, {}, 63),
    ]:
        assert not kinds(token(head, claims, os.urandom(size)), "jwt")
    assert not kinds(good.replace(".", "..", 1), "jwt") and not kinds("e" * 100_000 + ".aa." + "b" * 40, "jwt")


def base_by_definition(text):
    patterns = {
        "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        "hex": ("[0-9a-f]+", lambda m: len(m.group()) >= 16),
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, passes)) in enumerate(patterns.items()) for m in re.finditer(pattern, text) if passes(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


PIECES = ["password", "PassWD", "toKen", "toKen", "ſecret", "secret", "api_key", "APIKEY", "apikey", '"', "'", " ", "  ", ":", "=", ":=", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "F", "é", "日", "\n", "abcdefghijkl", "-_./+", "x"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans_by_definition(parts):
    text = "".join(parts)
    assert [s for s in secret_scan.spans(text) if s[0] in secret_scan.KINDS[:3]] == base_by_definition(text)


def test_scan_edge_cases(spark):
    secret = "token='abcdefghijkl'"
    rows = [(1, None), (2, ""), (3, secret), (3, secret), (None, f"é日 {secret}"), (4, "M" * 2_000_000), (5, "30" * 1_000_000), (6, ("b3BlbnNzaC1rZXktdjEA" * 20_000) + "\n" + "token " * 100_000), (7, "e" + "a.b" * 500_000)]
    got = {}
    for r in secret_scan.scan(documents(spark, rows)).collect():
        got.setdefault(r.key, []).append([tuple(s) for s in r.spans])
    assert got[1] == got[2] == [[]] and got[4] == got[7] == got[6] == [[]]
    assert got[3] == [[("assign", 0, 19)]] * 2 and got[None] == [[("assign", 3, 22)]]
    assert [s[0] for s in got[5][0]] == ["hex"]
    assert secret_scan.scan(documents(spark, [])).count() == 0


def test_op13_by_definition(spark):
    rows = contract.queries()["op13_secrets"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        base = base_by_definition(texts[r.doc_id] or "")
        told = [f"{kind}:{start}:{end}" for kind, start, end in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secret_scan.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in secret_scan.KINDS[:3]] == told
        found += len(base)
    assert found > 20


def test_counts_are_not_null(spark):
    """Rows without any find still carry the digest of nothing."""
    folder = f"{WorkTables(spark, 'op13').root}"
    documents(spark, [(1, None), (None, "x")]).write.parquet(f"{folder}/documents.parquet")
    rows = queries.op13_secrets(spark, folder).where(F.col("spans") == "").collect()
    assert len(rows) == 2 and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
