"""Segments of a stored index: equal to a full build, concurrent writers, pinned readers, block skipping, near terms, batches."""

import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators import changes, retrieve, search, store
from loomgrid.streaming.watch import write_batch

BOOSTS = {"content": 1.0, "scope": 3.0}
WORDS = ["getUserName", "alpha", "beta", "gamma", "delta", "user", "naïve", "x"]


def files(spark, texts):
    made = [(k, "text", len(v or ""), 5, v, hashlib.sha256((v or "").encode()).hexdigest()) for k, v in texts.items()]
    return spark.createDataFrame(made, "file string, language string, length int, mtime long, content string, content_hash string")


def a_text(rng):
    return "\n\n".join(" ".join(rng.choices(WORDS, weights=[1, 40, 20, 10, 5, 3, 2, 1], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))


def scores(df):
    return [(r.id, round(r.score, 9)) for r in df.orderBy(F.desc("score"), "id").collect()]


def test_updates_equal_a_full_build(spark, tmp_path):
    """Versions of small updates give the scores of one segment with the same chunks; few segments stay."""
    rng, path = random.Random(4), str(tmp_path / "i")
    texts = {f"f{i}.txt": a_text(rng) for i in range(40)}
    made, _ = store.build(files(spark, texts), path)
    counts = []
    for step in range(3):
        for name in rng.sample(sorted(texts), 3):
            texts[name] = a_text(rng)
        del texts[sorted(texts)[step]]
        texts[f"new{step}.txt"] = a_text(rng) if step else None
        made, _ = store.build(files(spark, texts), path)
        counts.append(len(made.meta["segments"]))
    assert max(counts) <= 3 and made.meta["number"] == 3
    whole = store.save(made.chunks, str(tmp_path / "whole"))
    assert (whole.meta["n"], whole.meta["totals"]) == (made.meta["n"], made.meta["totals"]) and made.meta["n"] == made.chunks.count()
    assert sorted(map(tuple, made.terms().collect())) == sorted(map(tuple, whole.terms().collect()))
    assert {r.file for r in made.chunks.collect()} == {k for k, v in texts.items() if v}
    for asked in (["getusername", "delta"], ["user", "x", "naïve", "alpha", "no"]):
        assert scores(store.bm25_of(made, asked, BOOSTS)) == scores(store.bm25_of(whole, asked, BOOSTS)) == scores(search.bm25(made.chunks, asked, "chunk_id", BOOSTS, T.analyse))
    ids = {c for r in made.manifest.collect() for c in r.chunk_ids}
    assert ids == {r.chunk_id for r in made.chunks.collect()}


def test_an_update_writes_postings_of_changed_chunks_only(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "i")
    texts = {f"f{i}.txt": a_text(rng) for i in range(60)}
    first, _ = store.build(files(spark, texts), path)
    texts["f7.txt"] = "entirely different words"
    second, _ = store.build(files(spark, texts), path)
    assert [s["n"] for s in second.meta["segments"]] == [first.meta["n"], 1] and second.meta["segments"][0] == first.meta["segments"][0]
    written = second.of_segments("blocks", second.meta["segments"][1:])
    assert {r.term for r in written.collect()} == {"entirely", "different", "words"}
    gone = {c for r in first.manifest.where("file = 'f7.txt'").collect() for c in r.chunk_ids}
    assert {r.id for r in second.gone.collect()} == gone and not gone & {r.id for r in store.bm25_of(second, ["alpha"], BOOSTS).collect()}


def test_best_without_all_blocks(spark, tmp_path, monkeypatch):
    """The k best of every term, and of several, equal the full ranking; far fewer blocks are needed for them."""
    rng = random.Random(6)
    rows = [(i, "f", 1, 1, "text", rng.choice(["alpha", "", "user"]), " ".join(rng.choices(WORDS, weights=[1, 60, 30, 10, 5, 3, 2, 1], k=rng.randint(1, 60))), "text", "h") for i in range(3000)]
    monkeypatch.setattr(store, "BLOCK", 16)
    monkeypatch.setattr(store, "FIRST_BLOCKS", 2)
    kept = store.save(spark.createDataFrame(rows, store.CHUNKS), str(tmp_path / "i"))
    every = kept.of_segments("blocks").count()
    terms = [r.term for r in kept.terms().select("term").distinct().collect()]
    asked = [[t] for t in terms] + [["alpha", "beta"], ["getusername", "alpha"], [*terms, "absent"]]
    for a in asked:
        assert scores(store.best_of(kept, a, BOOSTS, 10)) == scores(store.bm25_of(kept, a, BOOSTS))[:10], a
    assert scores(store.best_of(kept, ["beta"], BOOSTS, 1)) == scores(store.bm25_of(kept, ["beta"], BOOSTS))[:1]
    needed = store.needed_blocks(kept, ["alpha"], {"content": 1.0}, 10)[0].count()
    assert needed * 10 < kept.of_segments("blocks").where("term = 'alpha'").count() < every
    plan = store.needed_blocks(kept, ["alpha"], {"content": 1.0}, 10)[0]._jdf.queryExecution().executedPlan().treeString()
    assert "IsNotNull(peak)" in plan.split("PushedFilters")[1]
    assert store.best_of(kept, ["absent"], BOOSTS, 5).count() == store.best_of(kept, [], BOOSTS, 5).count() == store.best_of(kept, ["alpha"], BOOSTS, 0).count() == 0


def test_best_after_updates(spark, tmp_path):
    """Mean lengths move away from those that the peaks were computed with; gone chunks are not among the best."""
    rng, path = random.Random(8), str(tmp_path / "i")
    texts = {f"f{i}.txt": a_text(rng) for i in range(80)}
    store.build(files(spark, texts), path)
    for i in range(12):
        texts[f"f{i}.txt"] = "alpha " * 150
    made, _ = store.build(files(spark, texts), path)
    assert len(made.meta["segments"]) == 2 and made.meta["means"]["content"] > 1.2 * made.meta["segments"][0]["means"]["content"]
    for asked in (["alpha"], ["delta", "alpha"], ["user"]):
        assert scores(store.best_of(made, asked, BOOSTS, 7)) == scores(store.bm25_of(made, asked, BOOSTS))[:7]


def test_near_terms_equal_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    columns = [F.col("doc_id").alias("chunk_id"), *(F.lit(x).alias(n) for n, x in (("file", "f"), ("start", 1), ("end", 1), ("language", "text"), ("scope", ""))), F.col("text").alias("content"), F.lit("text").alias("kind"), F.lit("h").alias("content_hash")]
    kept = store.save(docs.select(*columns), str(tmp_path / "i"))
    words = kept.terms().select("term").distinct()
    for word in ("tion", "teh", "a", "ztion", "thee", "none at all", ""):
        assert kept.near_terms(word) == sorted(r[0] for r in search.fuzzy_terms(words, word).collect())
    assert len(kept.near_terms("tion")) > 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both began from one version: the second finds the first's and starts again, so both changes are in the last version."""
    path = str(tmp_path / "i")
    store.build(files(spark, {"a.txt": "alpha"}), path)
    both = threading.Barrier(2, timeout=120)
    real, passed = store._create, threading.local()

    def slow(spark_, name, text):
        if "/log/" in name and not getattr(passed, "once", False):
            passed.once = True
            both.wait()
        return real(spark_, name, text)

    monkeypatch.setattr(store, "_create", slow)
    none = spark.createDataFrame([], "file string")
    work = [threading.Thread(target=lambda n=n: store.update(files(spark, {n: "gamma"}), none, path)) for n in ("b.txt", "c.txt")]
    for w in work:
        w.start()
    for w in work:
        w.join()
    last = store.load(spark, path)
    assert last.meta["number"] == 2 and {r.file for r in last.chunks.collect()} == {"a.txt", "b.txt", "c.txt"}
    assert sorted(r.chunk_id for r in last.chunks.collect()) == [1, 2, 3]


def test_pins_and_deleted_versions(spark, tmp_path):
    path = str(tmp_path / "i")
    made = [store.build(files(spark, {"a.txt": t}), path, force=True)[0] for t in ("alpha", "beta")]
    pin = made[0].pin()
    made += [store.build(files(spark, {"a.txt": t}), path, force=True)[0] for t in ("gamma", "delta")]
    assert [r.content for r in made[0].chunks.collect()] == ["alpha"]
    with pytest.raises(store.VersionGone):
        made[1].chunks.count()
    made[0].release(pin)
    store.build(files(spark, {"a.txt": "x"}), path, force=True)
    with pytest.raises(store.VersionGone):
        made[0].manifest.count()


def test_an_index_knows_its_analyser(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "f", 1, 1, "text", "", "getUserName", "text", "h")], store.CHUNKS)
    kept = store.save(chunks, str(tmp_path / "p"), analyse=T.plain_terms)
    with pytest.raises(ValueError, match="plain"):
        store.load(spark, str(tmp_path / "p"), T.analyse)
    again = store.load(spark, str(tmp_path / "p"))
    o = retrieve.Options(mode="lexical", threshold=0.0)
    assert [[r.id for r in retrieve.search_chunks(chunks, q, o=o, index=i).collect()] for q, i in (("user", again), ("getUserName", kept), ("user", None))] == [[], [1], [1]]
    own = lambda c: T.plain_terms(c)
    store.save(chunks, str(tmp_path / "q"), analyse=own)
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "q"))
    assert store.load(spark, str(tmp_path / "q"), own).meta["n"] == 1


def test_every_touched_chunk_can_be_found(spark):
    """200 chunks hold the word, one is touched: it is found, with the counts of all."""
    chunks = spark.createDataFrame([(i, f"f{i}", 1, 9, "rust", "", "word " + "more " * (i % 7), "text", "h") for i in range(200)], store.CHUNKS)
    hunks = spark.createDataFrame([("f123", 2, 3)], "file string, start int, end int")
    o = retrieve.Options(mode="lexical", threshold=0.0, top_n=3)
    assert [r.id for r in changes.search_changes(chunks, hunks, "word", o=o).collect()] == [123]
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 150 else [0.0, 1.0]) for i in range(200)], "chunk_id long, embedding array<float>")
    o = retrieve.Options(mode="semantic", threshold=0.0, top_n=3)
    assert [r.id for r in changes.search_changes(chunks, hunks.withColumn("file", F.lit("f199")), "word", vectors, [1.0, 0.0], o).collect()] == [199]


def test_batches_become_versions(spark, tmp_path):
    out = str(tmp_path / "i")
    kind = "file string, content string, mtime long"
    write_batch(spark.createDataFrame([("a.py", "def alpha(): pass", 1), ("b.py", "beta", 1)], kind), 0, out)
    last = write_batch(spark.createDataFrame([("a.py", "def gamma(): pass", 2), ("b.py", None, 2)], kind), 1, out)
    again = write_batch(spark.createDataFrame([("a.py", "def gamma(): pass", 2), ("b.py", None, 2)], kind), 1, out)
    assert last.meta["number"] == again.meta["number"] == 1
    found = lambda q: [r.file for r in retrieve.search_chunks(last.chunks, q, o=retrieve.Options(mode="lexical", threshold=0.0), index=store.load(spark, out)).collect()]
    assert (found("gamma"), found("beta"), found("alpha")) == (["a.py"], [], [])
    assert {r.file: len(r.chunk_ids) for r in last.manifest.collect()} == {"a.py": 1}
