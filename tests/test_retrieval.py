"""The catalogue against SQL, and operators on small rows."""

import hashlib
import json
import re
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators import changes, chunking, code_chunks, embedding, hunks, index, retrieve, search, store, symbols
from loomgrid.plans import catalog
from loomgrid.sources.files import git_diff_lines, git_files, source_files, tree_size
from loomgrid.streaming.watch import live_chunks, watch, write_batch

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in names) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "lineitem", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    told = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert rows(catalog.queries()[name](spark, SF)) == told


def test_camel_parts(spark):
    words = ["DatabaseClient", "getHTTPResponse", "HTMLParser", "simple", "ALLCAPS", "snake_case", "myURL"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.split_camel(F.col("w"))).collect()]
    assert got == [["Database", "Client"], ["get", "HTTP", "Response"], ["HTML", "Parser"], ["simple"], ["ALLCAPS"], ["snake", "case"], ["my", "URL"]]


def test_chunks(spark):
    d = spark.createDataFrame([("a.md", "# One\n\nfirst\nmore\n\n# Two\nlast"), ("b.txt", "one\ntwo\n\nthree"), ("c.txt", "\n".join(["x" * 50] * 40))], "file string, content string")
    got = [(r.file, r.start, r.end, r.scope) for r in chunking.chunked(d).orderBy("file", "start").collect()]
    assert got[:4] == [("a.md", 1, 1, "One"), ("a.md", 3, 4, "One"), ("a.md", 6, 7, "Two"), ("b.txt", 1, 2, "")]
    assert got[4] == ("b.txt", 4, 4, "") and got[5:] == [("c.txt", 1, 30, ""), ("c.txt", 31, 40, "")]


def test_fusion_and_budget(spark):
    s = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "id long, score double")
    t = spark.createDataFrame([(2, 3.0), (3, 2.0), (4, 1.0)], "id long, score double")
    assert search.top_k(search.fuse(s, t, weight=0.6), 1).first().id == 2
    one = spark.createDataFrame([(1, 1.0)], "id long, score double")
    assert abs(search.fuse(one, one).first().score - 1 / 61) < 1e-9
    r = spark.createDataFrame([(1, 50), (2, 30), (3, 40)], "rank int, tokens int")
    assert [x.rank for x in search.within_budget(r, 80).orderBy("rank").collect()] == [1, 2]
    assert [x.rank for x in search.within_budget(r, 1).collect()] == [1]


def test_hunks(spark):
    h = spark.createDataFrame([("@@ -1,2 +3,4 @@ x",), ("@@ -1 +7 @@",), ("plain",)], "l string").select(T.hunk_start(F.col("l")), T.hunk_length(F.col("l"))).collect()
    assert [tuple(x) for x in h] == [(3, 4), (7, 1), (None, None)] or [tuple(x) for x in h][:2] == [(3, 4), (7, 1)]
    c = spark.createDataFrame([("a", 1, 5), ("a", 9, 12), ("b", 1, 5)], "file string, start int, end int")
    assert rows(search.overlaps_hunk(c, spark.createDataFrame([("a", 5, 8)], "file string, start int, end int"))) == [("5", "a", "1")]


def test_ids_have_no_gaps(spark):
    c = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("file"), F.col("id").cast("int").alias("start"), F.col("id").cast("int").alias("end"))
    assert sorted(r.chunk_id for r in index.with_ids(c, 7).collect()) == list(range(7, 1007))


def test_vector_dimension_is_checked(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        search.vector_scores(v, [1.0]).collect()



def _small_chunks(spark):
    rows = [(1, "a/x.py", 1, 9, "python", "", "def fibonacci(n)\nreturn n"), (2, "a/x.py", 2, 3, "python", "", "fibonacci again"), (3, "b/y.rs", 1, 4, "rust", "fibonacci", "fn other"), (4, "README", 1, 2, "text", "", "prime numbers")]
    return spark.createDataFrame(rows, "chunk_id long, file string, start int, end int, language string, scope string, content string")


def test_search_options(spark):
    c, o = _small_chunks(spark), retrieve.Options

    def ids(query, **more):
        return [r.id for r in retrieve.search_chunks(c, query, o=o(mode="lexical", **more)).collect()]

    assert ids("fibonacci")[0] == 3 and set(ids("fibonacci")) <= {1, 2, 3}
    assert ids("fibonacc") == ids("fibonacci")
    assert ids("fibonacci", language="RUST") == [3]
    assert 3 not in ids("fibonacci", excludes=("*.rs",)) and ids("fibonacci", excludes=("*.rs", "a/**")) == []
    assert len(ids("fibonacci", budget=1)) == 1 and ids(" ") == [] and ids("fibonacci", top_n=0) == []
    first = retrieve.search_chunks(c, "fibonacci", o=o(mode="lexical")).first()
    assert first.confidence == 1.0 and first.matched_lines == []
    with pytest.raises(ValueError):
        o(threshold=2.0)


def test_semantic_weights_and_join(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.8, 0.6]), (9, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    found = retrieve.search_chunks(_small_chunks(spark), "prime", v, [1.0, 0.0], retrieve.Options(mode="semantic", text_weight=0.5)).collect()
    assert [(r.id, round(r.score, 4), round(r.confidence, 4)) for r in found] == [(1, 1.0, 1.0), (4, 0.4, 0.8)]
    both = retrieve.search_chunks(_small_chunks(spark), "prime", v, [1.0, 0.0], retrieve.Options(top_n=1)).collect()
    assert [r.id for r in both] == [4]


def test_context(spark):
    r = _small_chunks(spark).where("chunk_id = 2").withColumnRenamed("chunk_id", "id")
    files = spark.createDataFrame([("a/x.py", "one\ntwo\nthree\nfour\n")], "file string, content string")
    got = retrieve.enrich(r, files, 1).first()
    assert (got.context_before, got.content, got.context_after, got.display_start) == ("one", "two\nthree", "four", 1)
    lost = retrieve.enrich(r, files.where("false"), 1).first()
    assert (lost.context_before, lost.content, lost.display_start) == ("", "fibonacci again", 2)


def test_diff_text(spark):
    text = ["+++ b/a.py", "@@ -1,2 +3,4 @@ x", "+code", "@@ -9 +12,0 @@", "+++ /dev/null", "@@ -1 +1 @@", "+++ b/c", "@@ -1 +7 @@"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "source string, line_no int, line string")
    assert [tuple(r) for r in hunks.parse_diff(lines).orderBy("file").collect()] == [("d", "a.py", 3, 6), ("d", "c", 7, 7)]


def test_globs_languages_and_blocks(spark, monkeypatch):
    cases = [("*.rs", "a/b.rs", True), ("src/**/x?.py", "src/x1.py", True), ("src/**/x?.py", "src/p/q/x1.py", True), ("*.{js,ts}", "m.ts", True), ("[!a]*", "abc", False), ("a.c", "abc", False)]
    assert [bool(re.search(T.glob_regex(g), p)) for g, p, _ in cases] == [x for *_, x in cases]
    assert T.valid_globs(["*.rs", "[a", "{b"]) == ["*.rs"]
    paths = [("a/b.RS", "rust"), ("Makefile", "text"), ("x.kt", "kt"), ("y.webp", None), ("z.zsh", "bash")]
    assert [r[0] for r in spark.createDataFrame(paths, "p string, w string").select(T.language_of(F.col("p"))).collect()] == [w for _, w in paths]
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = rows(search.knn(v, v.where("vec_id % 50 = 0"), 3))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert rows(search.knn(v, v.where("vec_id % 50 = 0"), 3)) == one


def test_definitions(spark):
    py = "import os\n\nclass Cart:\n    def total(self):\n        return 1\n\n    async def pay(self):\n        pass\n\ndef main():\n    pass"
    rs = "pub struct P {\n    x: i32,\n}\n\nimpl P {\n    pub fn get(&self) -> i32 {\n        self.x\n    }\n}"
    files = spark.createDataFrame([("a.py", "python", py), ("p.rs", "rust", rs), ("n.py", "python", None), ("t", "text", "def x")], "file string, language string, content string")
    found = symbols.definitions(files)
    got = [(r.file, r.line, r.depth, r.kind, r.name) for r in found.orderBy("file", "line").collect()]
    assert got[:4] == [("a.py", 3, 0, "class", "Cart"), ("a.py", 4, 1, "def", "total"), ("a.py", 7, 1, "def", "pay"), ("a.py", 10, 0, "def", "main")]
    assert got[4:] == [("p.rs", 1, 0, "struct", "P"), ("p.rs", 5, 0, "impl", "P"), ("p.rs", 6, 1, "fn", "get")]
    assert {r.line: r.end_line for r in found.where("file = 'p.rs'").collect()}[6] >= 7
    assert symbols.definitions(files, 1).where("depth > 0").count() == 0
    assert [r["count"] for r in symbols.outline(found).orderBy("file").collect()] == [4, 3]


def test_index_equals_scan_and_empty_query(spark, tmp_path):
    made = [(1, "one two two", "two"), (2, None, ""), (3, "two three", None), (4, "", "one")]
    chunks = spark.createDataFrame([(i, "f", 1, 1, "text", scope, text, "text", "h") for i, text, scope in made], store.CHUNKS)
    kept = store.save(chunks, str(tmp_path / "i"))
    key = lambda df: [(r.id, round(r.score, 9)) for r in df.orderBy("id").collect()]
    for boosts in ({"content": 1.0}, {"content": 1.0, "scope": 3.0}):
        assert key(store.bm25_of(kept, ["two", "three", "no"], boosts)) == key(search.bm25(chunks, ["two", "three", "no"], "chunk_id", boosts, T.analyse))
    assert store.bm25_of(kept, ["no"], {"content": 1.0}).isEmpty() and store.bm25_of(kept, [], {"content": 1.0}).isEmpty()


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_files_of_a_tree(spark, tmp_path):
    some = {"a.py": b"x = 1\r\n", "sub/b.rs": b"fn b() {}", "sub/skip.rs": b"no", "big.txt": b"x" * 300, "zero.txt": b"a\0b", "late.txt": b"y" * 8192 + b"\0", "pic.png": b"p", ".hidden": b"h", "build/out.c": b"int x;", "keep/build.log": b"l", "keep/me.log": b"m", "deep/one/two.txt": b"t"}
    for name, body in some.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / ".gitignore").write_text("# comment\nbuild/\n*.log\n!me.log\n/deep/*/two.txt\n")
    (tmp_path / "sub/.ignore").write_text("skip.*\n")
    root = str(tmp_path)

    def names(**options):
        return sorted(r.file for r in source_files(spark, root, **options).collect())

    assert names(max_length=200) == ["a.py", "keep/me.log", "sub/b.rs"]
    assert names() == ["a.py", "big.txt", "keep/me.log", "late.txt", "sub/b.rs"]
    assert names(excludes=("*.rs", "{big,late}.txt")) == ["a.py", "keep/me.log"]
    assert "build/out.c" in names(use_ignore_files=False)
    with pytest.raises(ValueError):
        names(excludes=("[broken",))
    r = source_files(spark, root).where("file = 'a.py'").first()
    assert (r.language, r.length, r.content, r.content_hash) == ("python", 7, "x = 1\n", hashlib.sha256(b"x = 1\r\n").hexdigest())
    assert tuple(tree_size(spark, root).first()) == (11, sum(len(v) for k, v in some.items() if not k.startswith(".")))


def test_work_tree_of_git(spark, tmp_path):
    git(tmp_path, "init", "-q")
    for name in ("kept.txt", "gone.txt", "two words.txt"):
        (tmp_path / name).write_text("one\ntwo\nthree\n")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "first")
    (tmp_path / "gone.txt").unlink()
    (tmp_path / "new.txt").write_text("n")
    (tmp_path / "kept.txt").write_text("one\n2\nthree\nfour\n")
    root = str(tmp_path)
    assert sorted(r.file for r in git_files(spark, root).collect()) == ["kept.txt", "new.txt", "two words.txt"]
    git(tmp_path, "add", "kept.txt")
    (tmp_path / "two words.txt").write_text("one\ntwo\n")
    (tmp_path / "kept.txt").write_text("one\n2\nthree\nfour\nfive\n")
    got = {(r.source, r.file, r.start, r.end) for r in hunks.parse_diff(git_diff_lines(spark, root, staged=True)).collect()}
    assert got == {("staged", "kept.txt", 2, 2), ("staged", "kept.txt", 4, 4), ("unstaged", "kept.txt", 5, 5)}
    assert {(r.file, r.start, r.end) for r in hunks.parse_diff(git_diff_lines(spark, root, base="HEAD")).collect()} == {("kept.txt", 2, 2), ("kept.txt", 4, 5)}


BODY = "".join(f"    value_{i:03d} = compute(value_{i:03d}, {i})\n" for i in range(8))


def test_code_is_cut_along_blocks(spark):
    big = "class Big:\n" + "".join(f"    def method_{k}(self):\n" + BODY.replace("    v", "        v") for k in range(6))
    files = {
        "small.py": "import a\nimport b\nx = 1\n",
        "doc.py": "import a\n\n# about f\n# more\ndef f(x):\n" + BODY,
        "stray.py": "# stray\n\ndef f(x):\n" + BODY,
        "big.py": big,
        "notes.md": "# Head\n\ntext\n",
        "empty.py": "\n\n",
        "long.py": "x = [" + "1234567890, " * 300 + "]\n",
        "null.py": None,
    }
    d = spark.createDataFrame([(k, T_LANGUAGE.get(k.split(".")[1]), v) for k, v in files.items()], "file string, language string, content string")
    got = {}
    for r in code_chunks.chunk_files(d).orderBy("file", "start").collect():
        got.setdefault(r.file, []).append((r.start, r.end, r.kind, r.scope))
        assert r.language == T_LANGUAGE[r.file.split(".")[1]] and (r.file == "notes.md" or r.content == "\n".join(files[r.file].split("\n")[r.start - 1 : r.end]))
    assert got["small.py"] == [(1, 3, "merged", "")]
    assert got["doc.py"] == [(1, 1, "block", ""), (3, 13, "block", "f")]
    assert got["stray.py"] == [(1, 1, "block", ""), (3, 11, "block", "f")]
    assert got["big.py"] == [(1, 1, "gap", "")] + [(2 + 9 * k, 10 + 9 * k, "block", f"Big.method_{k}") for k in range(6)]
    assert [c[2] for c in got["notes.md"]] == ["text", "text"] and got["long.py"] == [(1, 1, "block", "")]
    assert "empty.py" not in got and "null.py" not in got


T_LANGUAGE = {"py": "python", "md": "md"}


@pytest.fixture
def lengths():
    """An embedder that workers need not import."""
    return lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def test_index_versions(spark, tmp_path, lengths):
    """Built, read back, updated, pruned, exported and removed; a version without its marker is not read."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def embedder(texts):
        import uuid

        (calls / uuid.uuid4().hex).write_text(str(len(texts)))
        return lengths(texts)

    def called():
        n = sum(int(p.read_text()) for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return n

    def files(**texts):
        made = [(f"{k}.txt", "text", len(v), 5, v, hashlib.sha256(v.encode()).hexdigest()) for k, v in texts.items()]
        return spark.createDataFrame(made, "file string, language string, length int, mtime long, content string, content_hash string")

    path = str(tmp_path / "index")
    assert store.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    first, told = store.build(files(a="alpha beta\n\nsecond part", b="gamma", c="delta"), path, embedder, 3)
    assert {tuple(r) for r in told.collect()} == {("added", 3)} and called() == 4
    assert sorted(r.chunk_id for r in first.chunks.collect()) == [1, 2, 3, 4] == sorted(r.chunk_id for r in first.vectors.collect())
    assert {r.file: list(r.chunk_ids) for r in first.manifest.collect()} == {"a.txt": [1, 2], "b.txt": [3], "c.txt": [4]}
    now = files(a="alpha beta\n\nsecond part", b="gamma new", d="")
    assert store.needs_update(now, first)
    second, told = store.build(now, path, embedder, 3)
    assert {tuple(r) for r in told.collect()} == {("unchanged", 1), ("changed", 1), ("removed", 1), ("added", 1)} and called() == 1
    assert {(r.chunk_id, r.file) for r in second.chunks.collect()} == {(1, "a.txt"), (2, "a.txt"), (5, "b.txt")} and sorted(r.chunk_id for r in second.vectors.collect()) == [1, 2, 5]
    assert not store.needs_update(now, second) and second.meta["next_id"] == 6
    assert [r.id for r in store.bm25_of(second, ["gamma"], {"content": 1.0}).collect()] == [5]
    assert {r.change_type: list(r.files) for r in store.lists_of(store.changed(files(a="x", z="y"), second)).collect()} == {"added": ["z.txt"], "changed": ["a.txt"], "removed": ["b.txt", "d.txt"]}

    # an update that stopped before its marker
    second.chunks.write.parquet(f"{path}/v7/chunks")
    assert store.load(spark, path).folder.endswith("/v1")
    # an unchanged index can be built once more, from nothing if asked
    again, told = store.build(now, path, embedder, 3, force=True)
    assert again.folder.endswith("/v8") and called() == 3 and sorted(r.chunk_id for r in again.chunks.collect()) == [1, 2, 3]
    assert [n for n, marked in store.versions(spark, path) if marked] == [1, 8]
    store.export_chunks(second).write.text(f"{path}-lines")
    assert sorted(map(tuple, store.import_chunks(spark, f"{path}-lines").collect())) == sorted(map(tuple, second.chunks.collect()))
    (tmp_path / "more").mkdir()
    (tmp_path / "more/a.txt").write_text('{"chunk_id": 1, "file": "old"}\n\nnot json\n{"chunk_id": 1, "file": "new"}\n')
    assert [(r.chunk_id, r.file) for r in store.import_chunks(spark, str(tmp_path / "more")).collect()] == [(1, "new")]
    (tmp_path / "index/log/00000009.json").write_text(json.dumps(dict(again.meta, layout=99, number=9)))
    with pytest.raises(ValueError):
        store.load(spark, path)
    n, size = store.remove(spark, path)
    assert n > 10 and size > 1000 and store.remove(spark, path) == (0, 0)
    with pytest.raises(ValueError):
        store.save(second_chunks(spark), path, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, embedding array<float>"))


def second_chunks(spark):
    return spark.createDataFrame([(1, "a", 1, 1, "text", "", "x", "text", "h")], store.CHUNKS)


def test_embedding(spark, lengths):
    told = spark.createDataFrame([("f", "rust", "a.b", "x"), ("f", "rust", "", "x")], "f string, l string, s string, c string").select(T.embedding_text(*map(F.col, "flsc"))).collect()
    assert [r[0] for r in told] == ["// File: f\n// Language: rust\n// Scope: a.b\n\nx", "// File: f\n// Language: rust\n\nx"]
    assert embedding.embed_query("aa", lengths) == [len(embedding.QUERY_PREFIX) + 2.0, embedding.QUERY_PREFIX.count("a") + 2.0, 1.0]
    d = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<double>>, m array<int>")
    assert [[round(x, 6) for x in r[0]] for r in d.select(embedding.mean_pooled(F.col("t"), F.col("m"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed_chunks(second_chunks(spark), lengths, 4).collect()


def test_names(spark):
    one = spark.createDataFrame([("a\\b", "p", "n"), ("c", "", "n"), ("d", "p", None)], "x string, p string, n string")
    assert [tuple(r) for r in one.select(T.normal_path(F.col("x")), T.joined_scope(F.col("p"), F.col("n"))).collect()] == [("a/b", "p.n"), ("c", "n"), ("d", "p")]
    assert [T.language_named(x) for x in ("C++", "py", "Rust", "cobol")] == ["cpp", "python", "rust", "cobol"]
    assert one.select(T.index_name(F.lit("/a/b"))).first()[0] == hashlib.sha256(b"/a/b").hexdigest()[:16]
    assert T.valid_globs(["*.rs", "[x", "{a"]) == ["*.rs"]
    assert spark.range(1).select(T.plain_terms(F.lit("größe привет naïve x1"))).first()[0] == ["größe", "привет", "naïve", "x1"]
    assert spark.range(1).select(T.analyse(F.lit("getHTTPResponse plain Ab"))).first()[0] == ["gethttpresponse", "get", "http", "response", "plain", "ab"]


def test_search_inside_changes(spark):
    chunks = spark.createDataFrame([(i, f"src/f{i % 4}.rs", 10 * i, 10 * i + 9, "rust", "", f"needle {'x ' * i}") for i in range(20)], "chunk_id long, file string, start int, end int, language string, scope string, content string")
    changed = spark.createDataFrame([("f1.rs", 50, 55), ("root\\src\\f2.rs", 25, 60), ("c/f3.rs", 0, 999), ("src/f0.rs", 1000, 1001)], "file string, start int, end int")
    assert sorted(r.chunk_id for r in changes.touched(chunks, changed).collect()) == [2, 5, 6]
    o = retrieve.Options(mode="lexical", top_n=2, threshold=0.0)
    assert [r.id for r in changes.search_changes(chunks, changed, "needle", o=o).collect()] == [2, 5]
    assert {r.file: [tuple(x) for x in r.ranges] for r in changes.hunks_by_file(changed.union(changed.limit(1))).collect()}["f1.rs"] == [(50, 55)] * 2


def test_result_lines(spark):
    chunks = spark.createDataFrame([(1, "a.txt", 1, 1, "text", "", "needle one two"), (2, "b.txt", 1, 1, "text", "", "needle")], "chunk_id long, file string, start int, end int, language string, scope string, content string")
    found = retrieve.search_chunks(chunks, "needle", o=retrieve.Options(mode="lexical"))
    told = [json.loads(r.value) for r in retrieve.with_meta(found).collect()]
    assert [t.get("id") for t in told] == [2, 1, None] and told[-1] == {"_meta": {"total_results": 2, "total_tokens": 4}}
    assert [json.loads(r.value)["file"] for r in retrieve.as_json_lines(found).collect()] == ["b.txt", "a.txt"]
    alone = retrieve.ad_hoc_chunks(spark.createDataFrame([("<stdin>", "alpha\n\nbeta needle")], "file string, content string"))
    assert [(r.chunk_id, r.start) for r in alone.orderBy("start").collect()] == [(0, 1), (1, 3)]
    assert [r.id for r in retrieve.search_chunks(alone, "needle", o=retrieve.Options(mode="lexical")).collect()] == [1]
    assert [r.id for r in retrieve.search_chunks(chunks, "needle", o=retrieve.Options(mode="lexical", excludes=("[broken", "b.*"), threshold=0.0)).collect()] == [1]


def test_watch_follows_changes(spark, tmp_path):
    made, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(*rows_):
        spark.createDataFrame(list(rows_), "file string, content string, mtime long").write.mode("append").parquet(made)
        watch(spark, made, out, f"{tmp_path}/state", once=True).awaitTermination()
        return {(r.file, r.content) for r in live_chunks(spark, out).collect()}

    assert arrive(("a.txt", "one\n\ntwo", 1), ("b.txt", "old", 1), ("b.txt", "new", 2), ("p.png", "x", 1)) == {("a.txt", "one"), ("a.txt", "two"), ("b.txt", "new")}
    assert arrive(("a.txt", "three", 3), ("c.txt", "c", 3)) == {("a.txt", "three"), ("b.txt", "new"), ("c.txt", "c")}
    assert arrive(("b.txt", None, 4)) == {("a.txt", "three"), ("c.txt", "c")}
    again = spark.createDataFrame([("b.txt", None, 4)], "file string, content string, mtime long")
    write_batch(again, 2, out)
    assert {r.file for r in live_chunks(spark, out).collect()} == {"a.txt", "c.txt"}


def test_staged_tables_can_be_deleted(spark):
    from pathlib import Path

    from loomgrid.session import clear_staged, discard, staged

    one, two = (staged(spark.range(3), "some") for _ in range(2))
    paths = [Path(x._loomgrid_path.removeprefix("file://")) for x in (one, two)]
    assert two.count() == 3 and all(p.is_dir() for p in paths)
    discard(one, spark.range(1))
    assert [p.is_dir() for p in paths] == [False, True]
    clear_staged(spark)
    assert not paths[1].exists()
