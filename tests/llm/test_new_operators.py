"""URL rules, periodic runs and the prefix trie against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import prefix_trie, queries, runs, url_rules
from loomgrid.llm.url_rules import Listed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ---


def runs_of(w):
    """All runs by trying every period."""
    out, have = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in have:
                have.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng):
    letters = "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 5, 20])]
    w = rng.choices(letters, k=rng.randint(0, 120))
    for _ in range(rng.randint(0, 3)):
        block = rng.choices(letters, k=rng.randint(1, 12))
        at = rng.randint(0, len(w))
        w[at:at] = block * rng.randint(2, 9) + block[: rng.randint(0, len(block))]
    return " ".join(w)


def test_runs_of_many_texts():
    rng = random.Random(12)
    texts = [periodic_text(rng) for _ in range(1200)] + ["a b " * 40 + "a a a a a a " + "a b " * 9, "é é é é é é", "\x0b \r\n"]
    runs.TESTS, was = 1000, runs.TESTS
    try:
        found, left = runs._batch([t.encode() for t in texts])
    finally:
        runs.TESTS = was
    for t, got, rest in zip(texts, found, left, strict=True):
        want = runs_of(WORD.findall(t))
        assert [(r["start"], r["length"], r["period"]) for r in got] == want and rest.decode() == collapsed(WORD.findall(t), want)


def test_grammar_derives_its_words():
    import numpy as np

    rng = random.Random(5)
    words = np.array(rng.choices(range(3), k=400) + rng.choices(range(3, 9), k=1) + rng.choices(range(9, 11), k=77))
    text = np.repeat([0, 1, 3], [400, 1, 77])
    g = runs.grammar(words, text, 11)

    def derive(x):
        return [x] if x < 11 else derive(g.left[x - 11]) + derive(g.right[x - 11])

    for symbol, place, n in zip(*g.starts, (400, 1, 77), strict=True):
        assert derive(symbol) == words[place : place + n].tolist()
    for r in range(len(g.left)):
        assert derive(11 + r) == words[g.at[r] : g.at[r] + g.size[11 + r]].tolist()
    assert len(g.left) < len(words)


def test_runs_of_odd_rows(spark):
    rows = [(None, "x " * 9), (None, None), (1, ""), (1, "x " * 9), (2, "a b c " * 300_000), (3, " ".join(map(str, range(200_000)))), (4, " \n")]
    d = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id int, text string, runs int, id string")
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), len(r.collapsed)) for r in runs.find_runs(d).collect())
    assert got == Counter([(None, ((0, 9, 1),), 1), (None, (), 0), (1, (), 0), (1, ((0, 9, 1),), 1), (2, ((0, 900_000, 3),), 5), (3, (), len(rows[5][1])), (4, (), 0)])
    assert runs.find_runs(d.where("false")).collect() == []


def test_registered_runs(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 6000:
            continue
        found = runs_of(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % x for x in found), collapsed(w, found))]
        assert tuple(got[r.doc_id]) == (r.doc_id, len(found), *best, milli, *shas)


# --- prefix trie ---


def trie_of(paths):
    """paths: conv_id -> list of (role, text)."""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        d = len(node)
        inside = [x for x in nodes if x[:d] == node]
        leaves = [x for x in inside if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)]
        saved = sum((len(nodes[x]) - 1) * len(WORD.findall(x[-1][1])) for x in inside if x)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == d)))
        parent = min(nodes[node[:-1]]) if node else None
        kids = sum(1 for x in inside if len(x) == d + 1)
        out.append((min(members), d, parent, len(members), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def told(turns):
    paths = {}
    for c, _, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        paths.setdefault(c, []).append((role or "", text or ""))
    return paths


def some_turns():
    rng = random.Random(13)
    turns = []
    for c in list(range(-25, 60)) + [10**12]:
        said = [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d e f"])) for _ in range(rng.choice([1, 2, 3, 5, 9, 17]))]
        if c % 3 == 0 and c:
            said = [("user", "a b")] * rng.randint(1, 9) + said[:2]
        turns += [(c, i if i else None, r, t) for i, (r, t) in enumerate(said)]
    turns += [(7, 3, "user", "tie"), (7, 3, "user", "also"), (7, 3, "user", "tie"), (None, 1, "user", "x"), (5, 99, "user", "long " * 200_000)]
    turns += [(90 + i % 2, k, "u", f"t{k}") for i in range(2) for k in range(300)]
    rng.shuffle(turns)
    return turns


TURNS = "conv_id long, turn long, role string, text string"


def test_trie(spark):
    turns = some_turns()
    table = spark.createDataFrame([(*t, 1) for t in turns], TURNS + ", depth int")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = trie_of(told(turns))

    def got():
        return Counter(tuple(r) for r in prefix_trie.of_conversations(table).select(*names).collect())

    assert got() == want
    was = prefix_trie.MOST_NODES, prefix_trie.MANY_CHILDREN, prefix_trie.PIECE
    for prefix_trie.MOST_NODES, prefix_trie.MANY_CHILDREN, prefix_trie.PIECE in ((5, 2, 4), (5, 10**9, 1)):
        assert got() == want
    prefix_trie.MOST_BROADCAST, most = 0, prefix_trie.MOST_BROADCAST
    assert got() == want
    (prefix_trie.MOST_NODES, prefix_trie.MANY_CHILDREN, prefix_trie.PIECE), prefix_trie.MOST_BROADCAST = was, most
    assert prefix_trie.of_conversations(table.where("false")).collect() == []


def test_conversations_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    everyone = spark.createDataFrame([(3,), (1,), (3,)], "conv_id long")
    got = prefix_trie.trie(prefix_trie.digested(none), everyone).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]


def test_registered_trie(spark, tmp_path):
    turns = some_turns()
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    paths = told(turns)
    built = {}
    for c, own in paths.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c / 20) * 20 if c < 0 else c % 20
        built[c] = paths.get(c - base, [])[:h] + own[h:]
    assert Counter(tuple(r) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()) == trie_of(built)


def test_fat_binary_search():
    rng = random.Random(1)
    assert [prefix_trie.two_fattest(a, b) for a, b in ((0, 1), (0, 5), (4, 7), (5, 7), (7, 9))] == [1, 4, 6, 6, 8]
    trie, all_paths = prefix_trie.ZFastTrie(1), []
    import numpy as np

    for _ in range(300):
        n = rng.randint(0, 40)
        turns = [0] * rng.randint(0, n) if rng.random() < 0.5 else []
        turns += rng.choices(range(3), k=n - len(turns))
        path, so_far = b"", b""
        for t in turns:
            so_far = hashlib.md5(so_far + bytes([t])).digest()
            path += so_far
        all_paths.append(path)
        trie.insert_batch([(path, np.ones(n, np.int64), [1], 0)])
    for path in all_paths:
        v, agree = trie.locate(path)
        assert agree == len(path) // 16 == trie.deep[v] and trie.path[v][: len(path)] == path
    nodes = {p[: 16 * d] for p in all_paths for d in range(len(p) // 16 + 1)}
    rows = list(trie.expand())
    assert len(rows) == len(nodes) and all(n[0] == sum(p[16 * d - 16 : 16 * d] == h for p in all_paths) for d, h, _, _, n, _, _ in rows if d)


# --- URL rules ---

LISTED = [Listed("allow", "org/"), Listed("block", "Example.org/es/"), Listed("block", "x.org/a/b"), Listed("block", "net")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", "", []
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^/?#]*((?:/[^?#]*)?)", rest)[1]
    query = rest.split("#")[0].partition("?")[2]

    def lower(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x)

    tokens = ["h=" + x for x in lower(host).split(".") if x] + ["s=" + x for x in lower(path).split("/") if x] + ["q=" + x.split("=")[0] for x in lower(query).split("&") if x.split("=")[0]]
    return lower(host), path, sorted(set(tokens))


def listed_for(host, path):
    fit = [r for r in LISTED if (host == (h := r.rule.split("/")[0].lower()) or host.endswith("." + h)) and path.startswith("/" + r.rule.split("/", 1)[1] if "/" in r.rule else "")]
    return max(fit, key=lambda r: len(r.rule)) if fit else None


def rules_of(labelled, least=5, share=0.005, confidence=0.9):
    total = len(labelled)
    need = max(least, -(-total * share // 1))
    sets = Counter()
    n_token = Counter(t for ts, _ in labelled for t in ts)
    for ts, label in labelled:
        ts = [t for t in ts if n_token[t] >= need]
        assert len(ts) <= url_rules.ITEMS
        for k in range(len(ts) + 1):
            for sub in combinations(ts, k):
                sets[sub, label] += 1
                sets[sub, None] += 1
    conf = {k: n / sets[k[0], None] for k, n in sets.items() if k[1] and n >= need}
    out = {}
    for (sub, label), c in conf.items():
        if sub and c >= confidence and c > max(conf.get((sub[:i] + sub[i + 1 :], label), 0) for i in range(len(sub))):
            out[sub, label] = (c, sets[sub, label])
    return out


def some_urls():
    rng = random.Random(11)
    hosts = ["a.org", "Example.ORG", "m.example.org", "x.org", "deep.x.org", "shop.net", "net", "other.com", "b.other.com", "xorg", "y.Org:80", ""]
    ends = ["", "/", "/es/1", "/a/b", "/a/bc?utm=1&Ref=2", "/A/x#top?no", "?q=/es/", "#/es/", "/pills/buy", "//es//", "/es"]
    urls = [rng.choice(["http://", "https://", "HTTP://"]) + rng.choice(hosts) + rng.choice(ends) for _ in range(900)]
    return urls + [None, "", "no scheme", "://", "http:/half", "x://a.org/://b.net/", "http://é.org/É?É=1", "http://shop.net/" + "long/" * 50_000, "http://other.com/pills"] * 2


@pytest.mark.parametrize("spread", [False, True])
def test_url_rules(spark, spread):
    urls = some_urls()
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    parts = [url_parts(u) for u in urls]
    listed = [listed_for(h, p) for h, p, _ in parts]
    labelled = [(t, r.verdict) for (_, _, t), r in zip(parts, listed, strict=True) if r]
    rules = rules_of(labelled)
    assert {label for _, label in rules} == {"allow", "block"}
    url_rules.MOST_BROADCAST, was = 0 if spread else url_rules.MOST_BROADCAST, url_rules.MOST_BROADCAST
    try:
        got = {r.page_id: r for r in url_rules.judge(pages, LISTED, default="unknown").collect()}
    finally:
        url_rules.MOST_BROADCAST = was
    assert len(got) == len(urls)
    seen = Counter()
    for i, ((host, path, tokens), rule) in enumerate(zip(parts, listed, strict=True)):
        fit = sorted((-c, -n, len(sub), list(sub), label) for (sub, label), (c, n) in rules.items() if set(sub) <= set(tokens)) if rule is None else []
        mined = (fit[0][4], fit[0][3]) if fit else None
        r = got[i]
        assert (r._ur_host, r._ur_path, r._ur_rule) == (host, path, rule.rule if rule else None)
        assert (r._ur_mined and (r._ur_mined.verdict, r._ur_mined.tokens)) == mined
        assert r._ur_verdict == (rule.verdict if rule else mined[0] if mined else "unknown")
        seen[rule is None, r._ur_verdict] += 1
    assert len(seen) == 5, seen


def test_url_rules_on_little(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.com/"), (2, None)], "page_id long, url string")
    got = sorted((r.page_id, r._ur_verdict) for r in url_rules.judge(pages, LISTED).collect())
    assert got == [(1, "allow"), (2, "allow"), (2, "allow")]
    assert url_rules.judge(pages.where("false"), LISTED).collect() == [] and url_rules.judge(pages, []).count() == 3
    assert [r.page_id for r in url_rules.keep_allowed(pages, [Listed("block", "a.org/")]).orderBy("page_id").collect()] == [2, 2]
    with pytest.raises(ValueError):
        url_rules.judge(pages.withColumn("_ur_host", F.lit(1)), LISTED)


def mined(spark, labelled):
    rows = spark.createDataFrame(labelled, "tokens array<string>, label string").repartition(3)
    return sorted((r.label, r.tokens, r.n, r.n_tokens, r.confidence) for r in url_rules.mine(rows).collect())


@pytest.mark.parametrize("items", [0, 4])
def test_rules_of_urls_with_many_frequent_tokens(spark, monkeypatch, items):
    """Every frequent token is mined, also those behind ITEMS others of their URL."""
    rng = random.Random(items)
    labelled = [(["h=a"] * (rng.random() < 0.9) + [f"q={x}" for x in rng.sample("bcdefghij", rng.randint(0, 8))], "") for _ in range(260)]
    bad = [{"q=b", "q=c", "q=d"}, {"q=e", "q=f"}, {"h=a", "q=g", "q=h", "q=i"}]
    labelled = [(ts, rng.choice(["allow", "other"]) if rng.random() < 0.04 or not any(b <= set(ts) for b in bad) else "block") for ts, _ in labelled]
    labelled += [(["q=j", "q=k", "q=l"], "allow")] * 9 + [([], "block")] * 3
    want = rules_of([(sorted(ts), label) for ts, label in labelled])
    assert max(len(sub) for sub, _ in want) >= 3 and len(want) > 20
    monkeypatch.setattr(url_rules, "ITEMS", items)
    got = mined(spark, labelled)
    assert [(label, ts, n, c) for label, ts, n, _, c in got] == sorted((label, list(sub), n, c) for (sub, label), (c, n) in want.items())
    assert all(n_tokens == sum(set(ts) <= set(x) for x, _ in labelled) for _, ts, _, n_tokens, _ in got)


def test_url_rule_behind_twelve_tokens(spark):
    """Two names tell only together and come behind sixty that tell alone, in all URLs that have both."""
    many = "&".join(f"p{i:02}=1" for i in range(60))
    urls = [f"http://x.org/?{many}&a=1&b=1"] * 40 + ["http://a.org/?a=1"] * 40 + ["http://a.org/?b=1"] * 40
    urls += ["http://new.com/?a=1&b=2", "http://new.com/?a=1", "http://new.com/?p59=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(pages, [Listed("allow", "org/"), Listed("block", "x.org/")]).collect()}
    assert (got[120]._ur_verdict, got[120]._ur_mined.tokens, got[120]._ur_mined.confidence) == ("block", ["q=a", "q=b"], 1.0)
    assert got[121]._ur_mined is None and got[122]._ur_mined.tokens == ["q=p59"] and got[122]._ur_verdict == "block"
