"""Searches over a tree of files that know the state of its index: it is made, brought up to date or left as it is first.

What changed is found without reading contents: by the work tree's git (its status now, its files since the indexed commit,
and what was not committed then), or by name, size and time against the manifest. Only such files are read.

Defined results: no index and no leave to make one is an error; a tree whose changes are more than ``most_changed`` is
searched as it was indexed under ``reindex='auto'``, and the state says so; blank texts and queries give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_named
from ..session import staged
from ..sources import files as S
from . import store
from .code_chunks import chunk_files
from .embedding import Embedder, embed_chunks, embed_query
from .index import snapshot_diff, with_ids
from .retrieve import RESULT, Options, search_chunks

#: Changed files up to which a search brings the index up to date by itself.
MOST_CHANGED = 50


@dataclass(frozen=True)
class Tree:
    """A tree, the place of its index, and how it is read. git: find changes by the work tree's git where there is one."""

    root: str
    path: str
    embedder: Embedder | None = None
    dimension: int = 0
    excludes: tuple[str, ...] = ()
    git: bool = True


def _all_files(spark: SparkSession, t: Tree) -> DataFrame:
    found = S.source_files(spark, t.root, excludes=t.excludes)
    return found.join(S.git_files(spark, t.root), "file", "left_semi") if t.git and S.git_head(t.root) else found


def _note(t: Tree) -> dict | None:
    head = S.git_head(t.root) if t.git else None
    return {"commit": head, "dirty": S.git_dirty(t.root)} if head else None


def candidates(spark: SparkSession, t: Tree, index: store.Store) -> tuple[list[str], list[str]]:
    """Names that may have changed: those that are there to read, and all that the manifest may have to give up."""
    note = index.meta.get("note")
    since = S.git_changed_since(t.root, note["commit"]) if t.git and note and S.git_head(t.root) else None
    if since is not None:
        told = sorted({*since, *note["dirty"], *S.git_dirty(t.root)})
        return [n for n in told if (Path(t.root) / n).is_file()], told
    there = S.tree_names(spark, t.root, excludes=t.excludes)
    before = index.manifest.select("file", F.col("mtime").alias("m"), F.col("size").alias("s"))
    both = there.join(before, "file", "full_outer").where("m is null or mtime is null or m <> mtime or s <> length").select("file", F.col("mtime").isNotNull().alias("there")).collect()
    return sorted(r["file"] for r in both if r["there"]), sorted(r["file"] for r in both)


def changes(spark: SparkSession, t: Tree, index: store.Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """file, change_type against the manifest; the files that were read for it, and the names that were looked at."""
    read, told = candidates(spark, t, index)
    files = staged(S.source_files(spark, t.root, excludes=t.excludes, names=read), "tree-files")
    names = spark.createDataFrame([(n,) for n in told], "file string")
    before = index.manifest.join(F.broadcast(names), "file", "left_semi") if len(told) <= S.MOST_NAMED else index.manifest.join(names, "file", "left_semi")
    now = files.select("file", F.col("mtime").cast("long").alias("mtime"), F.col("length").cast("long").alias("size"), "content_hash")
    return snapshot_diff(now, before.select(now.columns)), files, names


def refresh(spark: SparkSession, t: Tree, reindex: str = "always", most_changed: int = MOST_CHANGED) -> tuple[store.Store, dict]:
    """The index and its state: made (from nothing), updated, fresh, or stale; with the counts of added, changed and removed files.

    reindex: 'always', 'auto' (up to ``most_changed`` files) or 'never'.
    """
    if reindex not in ("always", "auto", "never"):
        raise ValueError(f"reindex {reindex!r}: not always, auto or never")
    index = store.current(spark, t.path)
    if index is None:
        if reindex == "never":
            raise FileNotFoundError(f"no index under {t.path}")
        note = _note(t)
        made, told = store.build(_all_files(spark, t), t.path, t.embedder, t.dimension, note=note)
        return made, {"state": "made", **{r["change_type"]: r["n"] for r in told.collect()}}
    note = _note(t)
    diff, files, names = changes(spark, t, index)
    counts = {r["change_type"]: r["n"] for r in diff.where("change_type in ('added', 'changed', 'removed')").groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return index, {"state": "fresh"}
    if reindex == "never" or reindex == "auto" and n > most_changed:
        return index, {"state": "stale", **counts}
    made, _ = store.update(files, names, t.path, t.embedder, t.dimension, note=note)
    return made, {"state": "updated", **counts}


def search(spark: SparkSession, t: Tree, query: str, o: Options = Options(), reindex: str = "auto", most_changed: int = MOST_CHANGED) -> tuple[DataFrame, dict]:
    """Rows of RESULT for a query over a tree, and the state of the index that they come from."""
    index, state = refresh(spark, t, reindex, most_changed)
    vector = embed_query(query, t.embedder) if t.embedder and o.mode != "lexical" and query.strip() else None
    if o.mode != "lexical" and t.embedder is None:
        raise ValueError(f"mode {o.mode!r} needs an embedder")
    return search_chunks(index.chunks, query, index.vectors, vector, o, index), state


def search_content(spark: SparkSession, content: str, query: str, language: str = "text", o: Options = Options(), embedder: Embedder | None = None, dimension: int = 0) -> DataFrame:
    """Rows of RESULT for a query over one text that the caller holds; file is <stdin>. language: by any of its names."""
    if not query.strip() or not content.strip():
        return spark.createDataFrame([], RESULT)
    files = spark.createDataFrame([("<stdin>", language_named(language), content)], "file string, language string, content string")
    chunks = staged(with_ids(chunk_files(files), 0), "content-chunks")
    vectors = vector = None
    if o.mode != "lexical":
        if embedder is None:
            raise ValueError(f"mode {o.mode!r} needs an embedder")
        vectors, vector = staged(embed_chunks(chunks, embedder, dimension), "content-vectors"), embed_query(query, embedder)
    return search_chunks(chunks, query, vectors, vector, o)
