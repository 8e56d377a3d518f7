"""What a stored index takes of disk, and how its postings are packed and dealt."""

import os
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgrid import session
from loomgrid.functions import text as T
from loomgrid.operators import store
from loomgrid.plans import catalog

DOCS = "/root/testdata/sf0.01"


def size(*tops):
    return sum(p.stat().st_size for t in tops for p in Path(t).rglob("*") if p.is_file() and p.suffix != ".crc")


def moved(spark):
    """Bytes of shuffle files."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    total = 0
    for p in [p for d in dirs for p in Path(d).rglob("shuffle_*")]:
        try:
            total += p.stat().st_size
        except FileNotFoundError:
            pass  # deleted meanwhile
    return total


def test_an_index_takes_little_disk(spark, tmp_path):
    """The index is under three times as large as the compressed texts, and shuffle files do not outlive the steps that read them."""
    session.free_shuffles(spark)
    time.sleep(2)
    before = moved(spark)
    store.save(catalog._chunks(spark, DOCS), str(tmp_path / "i"), analyse=T.plain_terms)
    assert size(tmp_path / "i") < 3 * os.path.getsize(f"{DOCS}/documents.parquet")
    until = time.time() + 20
    while moved(spark) > before + 100_000 and time.time() < until:
        time.sleep(0.2)
    assert moved(spark) <= before + 100_000


def test_a_build_stages_texts_once_at_a_time(spark, tmp_path):
    """After a build no staged table with texts is left, and one at most is there at any time besides."""
    where = session.shared_dir(spark).removeprefix("file://")
    had, most, done = {p.name for p in Path(where).iterdir()}, [0], threading.Event()

    def look():
        while not done.is_set():
            most[0] = max(most[0], len({p.name for p in Path(where).iterdir() if p.name.startswith(("index-cut", "index-new", "chunk-ids"))} - had))
            time.sleep(0.01)

    t = threading.Thread(target=look)
    t.start()
    try:
        store.build(catalog._files(spark.read.parquet(f"{DOCS}/documents.parquet")), str(tmp_path / "i"))
    finally:
        done.set()
        t.join()
    left = {p.name.rsplit("-", 1)[0] for p in Path(where).iterdir() if p.name not in had}
    assert left <= {"index-changes"} and most[0] <= 2


@pytest.mark.parametrize("n_gone", [store.SENT, 0], ids=["sent", "joined"])
def test_slices_and_ranges_do_not_change_results(spark, tmp_path, monkeypatch, n_gone):
    """Many small slices, ranges and lots, and merges of them, give the postings of one."""
    chunks = catalog._chunks(spark, "/root/testdata/sf0.001")
    one = store.save(chunks, str(tmp_path / "one"), analyse=T.plain_terms)
    for name, value in (("RANGE", 3000), ("SLICE", 20_000), ("SENT", n_gone)):
        monkeypatch.setattr(store, name, value)
    kept = store.save(chunks.where("chunk_id % 2 = 0").repartition(5), str(tmp_path / "many"), analyse=T.plain_terms)
    assert len(store._slices(spark, f"{kept.path}/{kept.meta['segments'][0]['name']}/chunks")) > 1
    old = chunks.where("chunk_id % 2 = 0 AND chunk_id % 3 = 0")
    new = chunks.where("chunk_id % 2 = 1").unionByName(old.withColumn("chunk_id", F.col("chunk_id") + 10_000))
    kept = store.save(new, kept.path, analyse=T.plain_terms, base=kept, gone=old.select("chunk_id"))
    assert len(kept.meta["segments"]) == 1 and kept.meta["segments"][0]["name"].endswith("merged") and kept.meta["gone"] == 0
    assert (kept.meta["n"], kept.meta["totals"]) == (one.meta["n"], one.meta["totals"])

    def rows(s):
        each = s.of_segments("blocks").select("term", "field", F.inline(F.arrays_zip("postings", "places")))
        return sorted((r.term, r.field, r.postings.id % 10_000, r.postings.tf, r.postings.dl, tuple(r.places)) for r in each.collect())

    assert rows(kept) == rows(one) and sorted(map(tuple, kept.terms().collect())) == sorted(map(tuple, one.terms().collect()))
    assert kept.near_terms("teh") == one.near_terms("teh")


def test_a_name_is_created_once(spark, tmp_path):
    """Of writers that come at the same time one alone makes the file, whole."""
    for i in range(60):
        told, both = [], threading.Barrier(4)

        def make(k, name=f"file://{tmp_path}/log/{i}.json", told=told, both=both):
            both.wait()
            told.append((store._create(spark, name, str(k) * 50), k))

        work = [threading.Thread(target=make, args=(k,)) for k in range(4)]
        for w in work:
            w.start()
        for w in work:
            w.join()
        won = [k for ok, k in told if ok]
        assert len(told) == 4 and len(won) == 1 and (tmp_path / f"log/{i}.json").read_text() == str(won[0]) * 50
    assert len(list((tmp_path / "log").glob("*.json"))) == 60 and not list((tmp_path / "log").glob(".*[0-9a-f]"))
