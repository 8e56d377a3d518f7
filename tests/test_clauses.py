"""Search by clauses: reading of queries, and results against plain Python, by scan and by a stored index after updates."""

import hashlib
import math
import random
import re
from functools import cache

import pytest

from loomgrid.functions import text as T
from loomgrid.operators import clauses, retrieve, store
from loomgrid.operators.clauses import Clause, QueryError, parse

FIELDS = ("content", "scope")
BOOSTS = {"content": 1.0, "scope": 3.0}


def test_parse():
    assert parse(' +a  -"b c" scope:d e\\:f "q\\"r" content:"x" foo-bar C++ ', FIELDS) == [
        Clause("a", "+"), Clause("b c", "-", None, True), Clause("d", "", "scope"), Clause("e:f"), Clause('q"r', "", None, True),
        Clause("x", "", "content", True), Clause("foo-bar"), Clause("C++"),
    ]
    assert parse("  ", FIELDS) == []
    for bad in ('"open', 'a "b', "+", "- a", "scope:", "std::vec", "file:x", "f(x)", "a AND b", "NOT a", '"a"b', "a\\"):
        with pytest.raises(QueryError):
            parse(bad, FIELDS)


def runs_of(text):
    return [w for w in re.split(r"[\W_]+", text or "") if w]


def parts_of(run):
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", run)
    return [run.lower()] + ([p.lower() for p in parts] if len(parts) > 1 else [])


def brute(rows, asked):
    """rows: id -> (content, scope); asked: (sign, field or None, list of sequences)."""
    placed = {i: {f: [parts_of(r) for r in runs_of(v)] for f, v in zip(FIELDS, both, strict=True)} for i, both in rows.items()}
    length = {i: {f: sum(map(len, p[f])) for f in FIELDS} for i, p in placed.items()}
    n, mean = len(rows), {f: sum(x[f] for x in length.values()) / len(rows) for f in FIELDS}

    def tf(i, f, seq):
        if len(seq) == 1:
            return sum(p == seq[0] for ps in placed[i][f] for p in ps)
        p = placed[i][f]
        return sum(all(s in p[at + k] for k, s in enumerate(seq)) for at in range(len(p) - len(seq) + 1))

    @cache
    def idf(t, f):
        df = sum(tf(i, f, (t,)) > 0 for i in rows)
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    out = []
    for i in rows:
        def hit(a):
            return any(tf(i, f, s) for s in a[2] for f in ([a[1]] if a[1] else FIELDS))

        must, may, no = ([a for a in asked if a[0] == sign] for sign in ("+", "", "-"))
        if any(map(hit, no)) or not (must or may) or not (all(map(hit, must)) if must else any(map(hit, may))):
            continue
        total = 0
        for s, f in {(s, f) for a in must + may for s in a[2] for f in ([a[1]] if a[1] else FIELDS)}:
            k = tf(i, f, s)
            total += BOOSTS[f] * sum(idf(t, f) for t in s) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * length[i][f] / (mean[f] or 1)))
        out.append((i, round(total, 9)))
    return sorted(out)


CASES = {
    '"get name"': [("", None, [("get", "name")])],
    '"name name" x': [("", None, [("name", "name")]), ("", None, [("x",)])],
    "+get user -x": [("+", None, [("get",)]), ("", None, [("user",)]), ("-", None, [("x",)])],
    "scope:user get": [("", "scope", [("user",)]), ("", None, [("get",)])],
    "getUser": [("", None, [("getuser",), ("get",), ("user",)])],
    "+getUser": [("+", None, [("getuser",)])],
    '-"user get" +content:name': [("-", None, [("user", "get")]), ("+", "content", [("name",)])],
    '+"get getuser name"': [("+", None, [("get", "getuser", "name")])],
    "-x": [("-", None, [("x",)])],
    "+nowhere get": [("+", None, [("nowhere",)]), ("", None, [("get",)])],
    '"--" +scope:"get user"': [("+", "scope", [("get", "user")])],
}


def got(df):
    return sorted((r.id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    words = ["get", "user", "name", "getUser", "x", "userName"]
    rows = {i: (" ".join(rng.choices(words, weights=[5, 4, 4, 2, 1, 1], k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(60)}
    rows |= {60: (None, None), 61: ("", "get user"), 62: ("get user " * 400, None), 63: ("get, user", "x")}
    data = [(i, f"f{i}", 1, 1, "text", s, c, "block", "h") for i, (c, s) in rows.items()]
    return rows, spark.createDataFrame(data, store.CHUNKS)


@pytest.mark.parametrize("stored", [False, True])
def test_equal_to_plain_python(spark, tmp_path, made, stored):
    rows, chunks = made
    index = store.save(chunks, str(tmp_path / "i")) if stored else None
    for query, asked in CASES.items():
        found = clauses.search(chunks, parse(query, FIELDS), BOOSTS, T.analyse, index)
        assert got(found) == brute(rows, asked), query


def files(spark, texts):
    rows = [(k, "text", len(v), 5, v, hashlib.sha256(v.encode()).hexdigest()) for k, v in texts.items()]
    return spark.createDataFrame(rows, "file string, language string, length int, mtime long, content string, content_hash string")


def test_places_follow_updates_and_merges(spark, tmp_path):
    """After changes and merges of segments the stored places give what a scan of the live chunks gives."""
    path, rng = str(tmp_path / "i"), random.Random(8)
    texts = {f"f{i}.txt": " ".join(rng.choices(["get", "user", "name"], k=6)) for i in range(12)}
    store.build(files(spark, texts), path)
    for step in range(2):
        for name in rng.sample(sorted(texts), 3 + 4 * step):
            texts[name] = " ".join(rng.choices(["get", "user", "name"], k=6))
        texts.pop(sorted(texts)[0])
        index, _ = store.build(files(spark, texts), path)
    asked = parse('+"get user" -"name name name"', FIELDS)
    live = index.chunks
    assert got(clauses.search(live, asked, BOOSTS, T.analyse, index)) == got(clauses.search(live, asked, BOOSTS, T.analyse)) != []


def test_option_of_a_search(spark, made):
    _, chunks = made
    o = retrieve.Options(mode="lexical", threshold=0.0, top_n=100, syntax=True)
    every = {r.id for r in retrieve.search_chunks(chunks, '"get user"', o=o).collect()}
    without = {r.id for r in retrieve.search_chunks(chunks, '"get user" -scope:x', o=o).collect()}
    assert 62 in every and 63 in every and 63 not in without and without < every
    # words alone are searched as ever, with near terms where none occurs
    assert {r.id for r in retrieve.search_chunks(chunks, "usre", o=o).collect()} == {r.id for r in retrieve.search_chunks(chunks, "user", o=o).collect()}
    with pytest.raises(QueryError):
        retrieve.search_chunks(chunks, 'a "b', o=o)


def test_empty_table(spark, tmp_path):
    chunks = spark.createDataFrame([], store.CHUNKS)
    assert got(clauses.search(chunks, parse('+"a b" c', FIELDS), BOOSTS, T.analyse)) == []
    index = store.save(chunks, str(tmp_path / "i"))
    assert got(clauses.search(chunks, parse('+"a b" c', FIELDS), BOOSTS, T.analyse, index)) == []
