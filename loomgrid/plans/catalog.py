"""Registered queries of the retrieval engine over the given tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, chunking, clauses, code_chunks, hunks, index, retrieve, search, store, symbols
from ..session import shared_dir
from ..streaming.watch import write_batch

WORDS = ["the", "token", "ication"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector of the table serves as the query."""
    return _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(search.bm25(_table(spark, sf_dir, "documents"), WORDS), 20).select("id", F.round("score", 6).alias("score"))


def search_bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_bm25`` from an index that is stored first."""
    return search.top_k(store.bm25_of(_stored(spark, sf_dir), WORDS, {"content": 1.0}), 20).select("id", F.round("score", 6).alias("score"))


#: A required word, a phrase, words of one field, and an excluded phrase.
CLAUSES = '+and "of the" scope:src3 tion -"the the"'


def _by_clauses(chunks: DataFrame, index: store.Store | None = None) -> DataFrame:
    found = clauses.search(chunks, clauses.parse(CLAUSES, tuple(retrieve.BOOSTS)), retrieve.BOOSTS, T.plain_terms, index)
    return search.top_k(found, 50).select("id", F.round("score", 6).alias("score"))


def search_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and sources by the clauses of ``CLAUSES``, from their texts."""
    return _by_clauses(_chunks(spark, sf_dir))


def search_stored_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_clauses`` from the places of terms in an index that is stored first."""
    index = _stored(spark, sf_dir)
    return _by_clauses(index.chunks, index)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> store.Store:
    """The documents as a stored index with plain terms."""
    return store.save(_chunks(spark, sf_dir), _folder(spark), analyse=T.plain_terms)


def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(search.vector_scores(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)), 20).select("id", F.round("score", 6).alias("score"))


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings")
    found = search.hybrid(docs, vectors, " ".join(WORDS), _vector(spark, sf_dir))
    return found.select("id", F.round("score", 8).alias("score"), F.round("confidence", 6).alias("confidence"), F.length("text").alias("n_chars"))


def vector_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return search.knn(v, v.where("vec_id % 100 = 0"), 5).select("query", "id", "rank", F.round("score", 6).alias("score"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.postings(_table(spark, sf_dir, "documents"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.col("text").alias("content"))
    return chunking.chunked(docs).select("file", "start", "end", T.non_white_bytes(F.col("content")).alias("bytes"), T.chunk_hash(F.col("file"), F.col("start"), F.col("content")).alias("content_hash"))


def camel_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.split_camel(F.col("url"))).alias("place", "part"))
    return parts


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(T.language_of(F.regexp_replace("url", r"[?#].*$", "")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", search.query_class(F.col("text")).alias("kind"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: later ones are missing from the first, some changed or were only touched."""
    d = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc/"), F.col("doc_id")).alias("file")
    now = d.where("doc_id % 11 <> 0").select(name, F.expr("if(doc_id % 7 = 0, 200, 100)").alias("mtime"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("content_hash"))
    old = F.expr("if(doc_id % 14 = 0, concat(text, 'x'), text)")
    return now, d.where("doc_id % 13 <> 0").select(name, F.lit(100).alias("mtime"), F.octet_length(old).alias("size"), F.sha2(old, 256).alias("content_hash"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.snapshot_diff(*_snapshots(spark, sf_dir))


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.snapshot_diff(*_snapshots(spark, sf_dir)).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def contained_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ranked ranges of their order: rows that lie in a better-ranked one go."""
    l = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.pmod("l_partkey", F.lit(3)).cast("int")).alias("end"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return search.drop_contained(l)


def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.postings(_table(spark, sf_dir, "documents")).select("term").distinct()
    return search.fuzzy_terms(terms, "tion")


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(T.overlap(F.coalesce("text", F.lit("")), ["the", "der", "los", "que"]), 6).alias("share"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk of the file source/doc_id; the source serves as scope."""
    text = F.coalesce("text", F.lit(""))
    columns = [F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "doc_id").alias("file"), F.lit(1).alias("start"), F.size(F.split(text, "\n")).alias("end"), F.col("lang").alias("language"), F.col("source").alias("scope"), text.alias("content")]
    return _table(spark, sf_dir, "documents").select(*columns)


def _searched(o: retrieve.Options, query: str, stored: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
        vector = None if o.mode == "lexical" else _vector(spark, sf_dir)
        chunks, kept = _chunks(spark, sf_dir), _stored(spark, sf_dir) if stored else None
        found = retrieve.search_chunks(kept.chunks if kept else chunks, query, vectors, vector, o, kept)
        return found.select("id", "file", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "tokens", F.size("matched_lines").alias("n_matched"))

    return run


#: Searches that use the options.
SEARCHES = {
    "search_lexical_options": (retrieve.Options(mode="lexical", top_n=30, language="EN", excludes=("src7/*", "*9"), threshold=0.3, budget=4000, analyse=T.plain_terms), "token src3 ication"),
    "search_semantic_options": (retrieve.Options(mode="semantic", top_n=12, language="en", rerank=True, threshold=0.0), "the token ication"),
    "search_fuzzy": (retrieve.Options(mode="lexical", top_n=10, threshold=0.0, analyse=T.plain_terms), "tokne"),
}
SEARCHES |= {"search_stored_options": (*SEARCHES["search_lexical_options"], True), "search_stored_fuzzy": (*SEARCHES["search_fuzzy"], True)}


def matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    lines = T.matched_lines(F.coalesce("text", F.lit("")), "token Ication", F.lit(1))
    return d.select("doc_id", lines.alias("at")).select("doc_id", F.size("at").alias("n"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from the text of one diff an order: its lines are written as hunks of a file a line number (which may repeat)."""
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 4).alias("n"))
    header = l.select(F.col("l_orderkey").alias("source"), (F.col("l_linenumber") * 2).alias("line_no"), F.format_string("+++ b/line/%d", F.col("l_linenumber")).alias("line"))
    hunk = l.select(F.col("l_orderkey").alias("source"), (F.col("l_linenumber") * 2 + 1).alias("line_no"), F.format_string("@@ -1,2 +%d,%d @@ x", "l_partkey", "n").alias("line"))
    return hunks.parse_diff(header.unionByName(hunk))


def diff_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ten lines an order line that a changed range of the same order touches."""
    l = _table(spark, sf_dir, "lineitem").withColumn("first", F.col("l_linenumber") * 10)
    chunks = l.select(F.col("l_orderkey").alias("file"), F.col("first").alias("start"), (F.col("first") + 9).alias("end"))
    changed = l.where("l_suppkey % 5 = 0").select(F.col("l_orderkey").alias("file"), (F.col("first") + 7).alias("start"), (F.col("first") + 7 + F.col("l_partkey") % 6).alias("end"))
    return search.overlaps_hunk(chunks, changed)


def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_ids(_chunks(spark, sf_dir).select("file", "start", "end"), 100).select("file", "chunk_id")


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.status(_chunks(spark, sf_dir))


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the older snapshot, brought to the newer one."""
    now, before = _snapshots(spark, sf_dir)
    changes = index.snapshot_diff(now, before)
    stored = before.select("file", F.lit(1).alias("start"), F.lit(1).alias("end"), "content_hash").withColumn("chunk_id", F.regexp_extract("file", r"(\d+)", 1).cast("long"))
    fresh = now.select("file", F.lit(1).alias("start"), F.lit(1).alias("end"), "content_hash").join(changes.where("change_type in ('added', 'changed')").select("file"), "file", "left_semi")
    return index.updated(stored, changes, fresh).select("file", "chunk_id", "content_hash")


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents as new chunks, odd ones as stored chunks with vectors: which new ones need no embedding."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id").select("chunk_id", "embedding")
    return index.reuse_vectors(d.where("chunk_id % 2 = 0"), d.where("chunk_id % 2 = 1"), vectors).select("chunk_id", F.col("embedding").isNotNull().alias("reused"))


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files doc/doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.col("lang").alias("language"), F.octet_length(text).cast("long").alias("length"), F.lit(100).cast("long").alias("mtime"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, chunked and stored: what each file's chunks hold."""
    kept, _ = store.build(_files(_table(spark, sf_dir, "documents")), _folder(spark))
    chunks = kept.chunks.groupBy("file").agg(F.sum(T.non_white_bytes(F.col("content"))).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return kept.manifest.join(chunks, "file", "left").select("file", "size", "content_hash", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.size("chunk_ids") == F.coalesce("n", F.lit(0))).alias("listed"))


def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state of the documents is stored, then brought to a newer one: which files kept their chunks (null: none)."""
    path, docs = _folder(spark), _table(spark, sf_dir, "documents")
    before = docs.where("doc_id % 13 <> 0").withColumn("text", F.expr("if(doc_id % 14 = 0, concat(text, 'x'), text)"))
    first, _ = store.build(_files(before), path)
    now = _files(docs.where("doc_id % 11 <> 0")).withColumn("mtime", F.expr("if(substr(file, 5) % 7 = 0, 200, 100)").cast("long"))
    kept, _ = store.build(now, path)
    return kept.manifest.select("file", "content_hash", (F.get("chunk_ids", F.lit(0)) < first.meta["next_id"]).alias("old"))


#: What is added to the id of a document's chunk when the document has changed.
MOVED = 1_000_000_000


def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents from an index of two segments: the second has what is new, of the first what has changed is gone."""
    chunks = _chunks(spark, sf_dir)
    before = chunks.where("chunk_id % 13 <> 0").withColumn("content", F.expr("if(chunk_id % 14 = 0, concat(content, ' token'), content)"))
    first = store.save(before, _folder(spark), analyse=T.plain_terms)
    gone = before.where("chunk_id % 14 = 0").select("chunk_id")
    new = chunks.where("chunk_id % 13 = 0").unionByName(chunks.where("chunk_id % 13 <> 0 AND chunk_id % 14 = 0").withColumn("chunk_id", F.col("chunk_id") + MOVED))
    kept = store.save(new, first.path, analyse=T.plain_terms, base=first, gone=gone)
    return store.best_of(kept, WORDS, {"content": 1.0}, 20).select("id", F.round("score", 6).alias("score"))


def fuzzy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the stored documents and sources near a word, by what is left of them without one letter."""
    return spark.createDataFrame([(t,) for t in _stored(spark, sf_dir).near_terms("tion")], "term string")


def search_in_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the documents that a hunk touches, with the counts of all documents."""
    chunks = _chunks(spark, sf_dir)
    touched = chunks.where("chunk_id % 3 = 0").select("file", F.lit(2).alias("start"), F.lit(3).alias("end"))
    o = retrieve.Options(mode="lexical", top_n=15, threshold=0.0, analyse=T.plain_terms)
    found = changes.search_changes(chunks, touched, "token src3 ication", o=o)
    return found.select("id", "file", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def index_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as files in two batches, the second changes, removes and adds some and is run twice: what the index lists."""
    path, d = _folder(spark), _table(spark, sf_dir, "documents")
    name, text = F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.coalesce("text", F.lit(""))
    write_batch(d.where("doc_id % 13 <> 0").select(name, F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" old"))).otherwise(text).alias("content"), F.lit(1).cast("long").alias("mtime")), 0, path)
    later = d.where("doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0").select(name, F.when(F.col("doc_id") % 5 != 0, text).alias("content"), F.lit(2).cast("long").alias("mtime"))
    for _ in range(2):
        kept = write_batch(later, 1, path)
    return kept.manifest.select("file", "size", "content_hash", (F.size("chunk_ids") > 0).alias("listed"), F.lit(kept.meta["number"]).alias("version"))


def code_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the default analyser, of texts whose words are run together in camel case."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.concat(F.translate(F.substring(w, 1, 1), low, up), F.substring(w, F.lit(2), F.length(w))))
    terms = T.analyse(F.array_join(words, ""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


#: Source files that are made of the order lines, by language: first lines, lines of one item, last lines. {o}, {n} and {p}: order, place and part.
SOURCES = {
    "python": ('class Order{o}:\n    text = "def no(): class No:"\n', '    def part{p}_{n}(self):\n        return "class No:"\n', ""),
    "java": ("public class Order{o} {\n    // class No { void no() {\n", '    public int part{p}_{n}(int x) {\n        return "}}".length();\n    }\n', "}\n"),
    "go": ("package orders\n/* func no() { */\n", "func part{p}_{n}(x int) string {\n\treturn `func no() {`\n}\n", ""),
    "ruby": ("class Order{o}\n  # def no\n", '  def part{p}_{n}(x)\n    return "end" if x\n  end\n', "end\n"),
}


def _each(text: str, filled) -> Column:
    return F.transform("numbered", lambda x: filled(text, x))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, language, content: one source file an order, with a definition for each of its lines."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))

    def filled(text: str, item=None) -> Column:
        out = F.replace(F.lit(text), F.lit("{o}"), F.col("l_orderkey").cast("string"))
        return out if item is None else F.replace(F.replace(out, F.lit("{n}"), item["n"]), F.lit("{p}"), item["p"])

    numbered = F.transform("items", lambda x, i: F.struct((i + 1).cast("string").alias("n"), x["l_partkey"].cast("string").alias("p")))
    language = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    content = F.coalesce(*(F.when(language == k, F.concat(filled(a), F.array_join(_each(b, filled), ""), filled(c))) for k, (a, b, c) in SOURCES.items()))
    return lines.withColumn("numbered", numbered).select(F.concat(F.lit("order/"), F.col("l_orderkey")).alias("file"), language.alias("language"), content.alias("content"))


def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in the source files of the orders; what strings and comments hold is none."""
    return symbols.definitions(_sources(spark, sf_dir))


def index_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that still have a chunk, where chunks of two tables count."""
    chunks = _chunks(spark, sf_dir)
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return store.prune_vectors(vectors, chunks.where("chunk_id % 3 = 0"), chunks.where("chunk_id % 5 = 0")).select("chunk_id")


def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/doc_id, touched by hunks that name them by doc_id or by root/source/doc_id."""
    chunks = _chunks(spark, sf_dir)
    named = F.expr("if(chunk_id % 2 = 0, cast(chunk_id as string), concat('root/', file))")
    changed = chunks.where("chunk_id % 3 = 0").select(named.alias("file"), F.lit(2).alias("start"), (F.lit(2) + F.col("chunk_id") % 4).cast("int").alias("end"))
    return changes.touched(chunks, changed).select("file", "start", "end")


def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of ``diff_hunks`` by file."""
    return changes.hunks_by_file(diff_hunks(spark, sf_dir)).select("file", F.size("ranges").alias("n"), F.get("ranges", F.lit(0))["start"].alias("first"), F.element_at("ranges", -1)["start"].alias("last"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedder would read of each document."""
    told = T.embedding_text(F.col("file"), F.col("language"), F.col("scope"), F.col("content"))
    return _chunks(spark, sf_dir).select("chunk_id", F.sha2(told, 256).alias("hash"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut as if their markup were source code: blocks, merged ones and gaps."""
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id")).alias("file"), F.lit("php").alias("language"), F.col("html").alias("content"))
    return code_chunks.chunk_files(pages).select("file", "start", "end", "kind", T.non_white_bytes(F.col("content")).alias("bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (search_bm25, search_bm25_index, search_vector, search_hybrid, vector_knn_batch, index_terms, chunk_text, camel_parts, language_counts, query_classes, snapshot_changes, snapshot_counts, contained_ranges, fuzzy_dictionary, keyword_overlap)
    named += (matched_lines, diff_hunks, diff_scope, index_ids, index_status, index_update, vector_reuse)
    named += (index_build, index_incremental, index_prune, changed_chunks, changed_ranges, embedding_texts, code_blocks)
    named += (search_clauses, search_stored_clauses, search_segments, fuzzy_index, search_in_changes, index_watch, code_terms, source_symbols)
    return {f.__name__: f for f in named} | {k: _searched(*v) for k, v in SEARCHES.items()}


_TERMS = r"SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents"
_BM25 = f"""
    w AS ({_TERMS}), q AS (SELECT unnest(['ication', 'the', 'token']) AS term),
    s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
    tf AS (SELECT id, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id)"""
_TF = "len(list_filter({w}, lambda x: x = '{t}'))"
_TF2 = "len(list_filter(range(1, len({w})), lambda i: {w}[i] = '{t}' AND {w}[i + 1] = '{u}'))"
_CLAUSES = f"""WITH
    w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS c,
                 list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS s FROM documents),
    t AS (SELECT id, len(c) AS cl, len(s) AS sl, {_TF.format(w='s', t='src3')} AS s_src,
                 {", ".join(f"{_TF.format(w=w, t=t)} AS {w}_{t}" for w in 'cs' for t in ('and', 'tion', 'of', 'the'))},
                 {", ".join(f"{_TF2.format(w=w, t=t, u='the')} AS {w}_{t}_the" for w in 'cs' for t in ('of', 'the'))} FROM w),
    n AS (SELECT count(*) AS n, avg(cl) AS cm, avg(sl) AS sm, count_if(s_src > 0) AS ds_src,
                 {", ".join(f"count_if({w}_{t} > 0) AS d{w}_{t}" for w in 'cs' for t in ('and', 'tion', 'of', 'the'))} FROM t),
    i AS (SELECT n, cm, sm, {", ".join(f"ln(1 + (n - d{x} + 0.5) / (d{x} + 0.5)) AS i{x}" for x in ('s_src', *(f'{w}_{t}' for w in 'cs' for t in ('and', 'tion', 'of', 'the'))))} FROM n),
    r AS (SELECT id, {" + ".join(f"{3.0 if x[0] == 's' else 1.0} * ({y}) * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * {x[0]}l / (CASE WHEN {x[0]}m > 0 THEN {x[0]}m ELSE 1 END)))" for x, y in (('s_src', 'is_src'), *((f'{w}_{t}', f'i{w}_{t}') for w in 'cs' for t in ('and', 'tion')), *((f'{w}_of_the', f'i{w}_of + i{w}_the') for w in 'cs')))} AS score
          FROM t, i WHERE c_and + s_and > 0 AND c_the_the + s_the_the = 0)"""
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_KNN = f"qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), vs AS (SELECT vec_id AS id, {_DOT.format(a='embedding', b='q')} AS score FROM embeddings, qv)"
_SNAP = """
    a AS (SELECT 'doc/' || doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN 200 ELSE 100 END AS mtime, strlen(text) AS size, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
    b AS (SELECT 'doc/' || doc_id AS file, 100 AS mtime, strlen(t) AS size, sha256(t) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN text || 'x' ELSE text END AS t FROM documents) WHERE doc_id % 13 <> 0),
    d AS (SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' WHEN a.mtime = b.mtime AND a.size = b.size THEN 'unchanged'
          WHEN a.h = b.h THEN 'mtime_only' ELSE 'changed' END AS change_type FROM a FULL JOIN b ON a.file = b.file)"""


_FIELD = r"""
    w{f} AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
    s{f} AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w{f}),
    tf{f} AS (SELECT id, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w{f}, q),
    df{f} AS (SELECT term, count(*) AS df FROM tf{f} WHERE tf > 0 GROUP BY term),
    p{f} AS (SELECT id, {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf{f} JOIN df{f} USING (term), s{f} WHERE tf > 0)"""


def _near(word: str) -> str:
    """A pattern of the words at edit distance 1 at most (letters, not bytes; an exchange of neighbours counts 1)."""
    n = len(word)
    added = [f"{word[:i]}.{word[i:]}" for i in range(n + 1)]
    other = [f"{word[:i]}.?{word[i + 1 :]}" for i in range(n)]
    return "|".join([word, *added, *other, *(word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(n - 1))])


_LOW = "lower(coalesce(text, ''))"


def oracle_sql() -> dict[str, str]:
    return _more_sql() | _store_sql() | {
        "search_clauses": f"{_CLAUSES} SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 50",
        "search_stored_clauses": f"{_CLAUSES} SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 50",
        "search_bm25_index": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20",
        "search_bm25": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20",
        "search_vector": f"WITH {_KNN} SELECT id, round(score, 6) AS score FROM vs ORDER BY vs.score DESC, id LIMIT 20",
        "search_hybrid": f"""WITH {_BM25}, {_KNN},
            l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 20), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM vs QUALIFY r <= 20),
            f AS (SELECT id, sum(s) AS score FROM (SELECT id, 0.3::DOUBLE / (60 + r) AS s FROM v WHERE false UNION ALL SELECT id, 0.7::DOUBLE / (60 + r) FROM v UNION ALL SELECT id, (1 - 0.7::DOUBLE) / (60 + r) FROM l) GROUP BY id HAVING sum(s) >= 0.3::DOUBLE / 61),
            t AS (SELECT * FROM f ORDER BY score DESC, id LIMIT 10)
            SELECT t.id, round(t.score, 8) AS score, round(vs.score, 6) AS confidence, length(text) AS n_chars FROM t JOIN documents ON doc_id = t.id LEFT JOIN vs ON vs.id = t.id""",
        "vector_knn_batch": f"""SELECT query, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank
            FROM (SELECT q.vec_id AS query, v.vec_id AS id, {_DOT.format(a="v.embedding", b="q.embedding")} AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 5""",
        "index_terms": f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM ({_TERMS})) GROUP BY term",
        "query_classes": f"""SELECT conv_id, turn, CASE WHEN len(w) <= 1 OR w[1] IN ({", ".join(f"'{x}'" for x in search.CODE_WORDS)}) THEN 'identifier'
            WHEN len(w) > 3 OR len(list_intersect(w, [{", ".join(f"'{x}'" for x in search.PROSE_WORDS)}])) > 0 THEN 'prose' ELSE 'phrase' END AS kind
            FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM conversations)""",
        "snapshot_changes": f"WITH {_SNAP} SELECT file, change_type FROM d",
        "snapshot_counts": f"WITH {_SNAP} SELECT change_type, count(*) AS n FROM d GROUP BY change_type",
        "contained_ranges": """WITH l AS (SELECT l_orderkey AS file, l_linenumber AS start, l_linenumber + (l_partkey % 3)::INT AS "end", l_suppkey * 10 + l_linenumber AS rank FROM lineitem)
            SELECT file, start, "end", rank FROM l WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.file = l.file AND b.rank < l.rank AND b.start <= l.start AND l."end" <= b."end")""",
        "fuzzy_dictionary": f"SELECT DISTINCT term FROM (SELECT unnest(ws) AS term FROM ({_TERMS})) WHERE regexp_full_match(term, '{_near('tion')}')",
        "keyword_overlap": "SELECT doc_id, round((" + " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t}') THEN 1.0::DOUBLE ELSE 0 END" for t in ("the", "der", "los", "que")) + ") / 4, 6) AS share FROM documents",
    }


def _more_sql() -> dict[str, str]:
    fields = ",".join(_FIELD.format(f=f, c=c, boost=b) for f, c, b in ((1, "text", "1.0::DOUBLE"), (2, "source", "3.0::DOUBLE")))
    hits = f"list_filter(list_transform(string_split({_LOW}, chr(10)), lambda x, i: CASE WHEN contains(x, 'token') OR contains(x, 'ication') THEN i END), lambda x: x IS NOT NULL)"
    tokens = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'))"
    return {
        "search_lexical_options": f"""WITH q AS (SELECT unnest(['token', 'src3', 'ication']) AS term), {fields},
            bm AS (SELECT id, sum(s) AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY id),
            c AS (SELECT *, score / max(score) OVER () AS confidence FROM (SELECT * FROM bm ORDER BY bm.score DESC, id LIMIT 60)),
            r AS (SELECT c.*, source || '/' || doc_id AS file, {tokens} AS tokens, list_filter(string_split({_LOW}, chr(10)), lambda x: contains(x, 'token') OR contains(x, 'src3') OR contains(x, 'ication')) AS hit
                  FROM c JOIN documents ON doc_id = id WHERE confidence >= 0.3 AND lang = 'en' AND source <> 'src7' AND NOT (source || '/' || doc_id) LIKE '%9'),
            b AS (SELECT *, row_number() OVER w AS rn, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM r WINDOW w AS (ORDER BY score DESC, id))
            SELECT id, file, round(score, 6) AS score, round(confidence, 6) AS confidence, tokens::INT AS tokens, len(hit)::INT AS n_matched FROM b WHERE rn <= 30 AND (rn = 1 OR upto <= 4000)""",
        "search_semantic_options": f"""WITH {_KNN}, c AS (SELECT * FROM vs ORDER BY vs.score DESC, id LIMIT 24),
            r AS (SELECT c.*, text, source || '/' || doc_id AS file FROM c JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY c.score DESC, id LIMIT 12)
            SELECT id, file, round(score, 6) AS score, round(0.75::DOUBLE * score + 0.25::DOUBLE * ((CASE WHEN contains({_LOW}, 'the') THEN 1 ELSE 0 END + CASE WHEN contains({_LOW}, 'token') THEN 1 ELSE 0 END + CASE WHEN contains({_LOW}, 'ication') THEN 1 ELSE 0 END) / 3.0::DOUBLE), 6) AS confidence,
            {tokens}::INT AS tokens, len(list_filter(string_split({_LOW}, chr(10)), lambda x: contains(x, 'the') OR contains(x, 'token') OR contains(x, 'ication')))::INT AS n_matched FROM r""",
        "search_fuzzy": rf"""WITH ws AS (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '') || ' ' || source), '[^\p{{L}}\p{{N}}]+')) AS term FROM documents),
            q AS (SELECT DISTINCT term FROM ws WHERE regexp_full_match(term, '{_near('tokne')}')), {fields},
            bm AS (SELECT id, sum(s) AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY id)
            SELECT id, source || '/' || doc_id AS file, round(score, 6) AS score, round(score / max(score) OVER (), 6) AS confidence, {tokens}::INT AS tokens,
            len(list_filter(string_split({_LOW}, chr(10)), lambda x: contains(x, 'tokne')))::INT AS n_matched FROM (SELECT * FROM bm ORDER BY bm.score DESC, id LIMIT 10) JOIN documents ON doc_id = id""",
        "matched_lines": f"SELECT doc_id, len(hit)::INT AS n, coalesce(list_sum(hit), 0)::BIGINT AS places FROM (SELECT doc_id, {hits} AS hit FROM documents)",
        "diff_hunks": """SELECT l_orderkey AS source, 'line/' || l_linenumber AS file, l_partkey::INT AS start, (l_partkey + l_suppkey % 4 - 1)::INT AS "end" FROM lineitem WHERE l_suppkey % 4 > 0""",
        "diff_scope": """WITH l AS (SELECT *, l_linenumber * 10 AS f FROM lineitem) SELECT l_orderkey AS file, f AS start, f + 9 AS "end" FROM l
            WHERE EXISTS (SELECT 1 FROM l h WHERE h.l_orderkey = l.l_orderkey AND h.l_suppkey % 5 = 0 AND l.f <= h.f + 7 + h.l_partkey % 6 AND l.f + 9 >= h.f + 7)""",
        "index_ids": "SELECT file, 99 + row_number() OVER (ORDER BY file) AS chunk_id FROM (SELECT source || '/' || doc_id AS file FROM documents)",
        "index_status": "SELECT lang AS language, count(DISTINCT source || '/' || doc_id) AS files, count(*) AS chunks, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY lang",
        "index_update": f"""WITH {_SNAP}, top AS (SELECT max(doc_id) AS m FROM documents WHERE doc_id % 13 <> 0)
            SELECT b.file, substr(b.file, 5)::BIGINT AS chunk_id, b.h AS content_hash FROM b JOIN d USING (file) WHERE change_type IN ('unchanged', 'mtime_only')
            UNION ALL SELECT a.file, m + row_number() OVER (ORDER BY a.file), a.h FROM a JOIN d USING (file), top WHERE change_type IN ('added', 'changed')""",
        "vector_reuse": """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), o AS (SELECT h, max(doc_id) AS old FROM h WHERE doc_id % 2 = 1 GROUP BY h)
            SELECT doc_id AS chunk_id, vec_id IS NOT NULL AS reused FROM h LEFT JOIN o USING (h) LEFT JOIN embeddings ON vec_id = old WHERE doc_id % 2 = 0""",
    }


def _store_sql() -> dict[str, str]:
    white = r"regexp_replace({}, '[ \t\n\f\r]', '', 'g')"
    camel = r"regexp_replace(regexp_replace(regexp_replace(url, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '([\p{Lu}\p{N}]\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')"
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_OF_ENDING.items())
    binary = ", ".join(f"'{x}'" for x in T.BINARY_ENDINGS)
    more = _more_sql()
    fields = ",".join(_FIELD.format(f=f, c=c, boost=b) for f, c, b in ((1, "text", "1.0::DOUBLE"), (2, "source", "3.0::DOUBLE")))
    return {
        "search_stored_options": more["search_lexical_options"],
        "search_stored_fuzzy": more["search_fuzzy"],
        "index_build": f"""SELECT 'doc/' || doc_id AS file, strlen(t)::BIGINT AS size, sha256(t) AS content_hash, strlen({white.format("t")})::BIGINT AS bytes, true AS listed
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "index_incremental": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT 'doc/' || doc_id AS file, sha256(t) AS content_hash, CASE WHEN regexp_matches(t, '\S') THEN doc_id % 13 <> 0 AND doc_id % 14 <> 0 END AS old FROM d WHERE doc_id % 11 <> 0""",
        "search_segments": f"""WITH {_BM25} SELECT id, round(score, 6) AS score FROM (SELECT CASE WHEN id % 13 <> 0 AND id % 14 = 0 THEN id + {MOVED} ELSE id END AS id, score FROM bm) x ORDER BY x.score DESC, id LIMIT 20""",
        "fuzzy_index": rf"""SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '') || ' ' || coalesce(source, '')), '[^\p{{L}}\p{{N}}]+')) AS term FROM documents) WHERE regexp_full_match(term, '{_near('tion')}')""",
        "search_in_changes": f"""WITH q AS (SELECT unnest(['token', 'src3', 'ication']) AS term), {fields},
            bm AS (SELECT id, sum(s) AS score FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY id),
            t AS (SELECT doc_id, source || '/' || doc_id AS file FROM documents WHERE doc_id % 3 = 0 AND len(string_split(coalesce(text, ''), chr(10))) >= 2),
            c AS (SELECT id, file, score, score / max(score) OVER () AS confidence FROM bm JOIN t ON id = doc_id)
            SELECT id, file, round(score, 6) AS score, round(confidence, 6) AS confidence FROM c ORDER BY c.score DESC, id LIMIT 15""",
        "index_watch": r"""SELECT 'doc/' || doc_id AS file, strlen(t)::BIGINT AS size, sha256(t) AS content_hash, regexp_matches(t, '\S') AS listed, 1 AS version
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE doc_id % 5 <> 0""",
        "code_terms": rf"""WITH w AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: translate(substr(w, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(w, 2)), '') AS url FROM documents),
            r AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(url, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS url FROM w),
            t AS (SELECT doc_id, url AS term FROM r UNION ALL
                  SELECT doc_id, unnest(list_filter(regexp_split_to_array({camel}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) FROM r WHERE regexp_matches(url, '\p{{Ll}}\p{{Lu}}|[\p{{Lu}}\p{{N}}]\p{{Lu}}\p{{Ll}}'))
            SELECT lower(term) AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""",
        "source_symbols": """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
            c AS (SELECT o, count(*) AS m FROM l GROUP BY o)
            SELECT 'order/' || o AS file, 1 AS line, (CASE o % 4 WHEN 0 THEN 2 + 2 * m ELSE 3 + 3 * m END)::INT AS end_line, 0 AS depth, 'class' AS kind, 'Order' || o AS name FROM c WHERE o % 4 <> 2
            UNION ALL SELECT 'order/' || o, (CASE o % 4 WHEN 0 THEN 1 + 2 * n ELSE 3 * n END)::INT, (CASE o % 4 WHEN 0 THEN 2 + 2 * n ELSE 3 * n + 2 END)::INT, CASE WHEN o % 4 = 2 THEN 0 ELSE 1 END,
            CASE o % 4 WHEN 1 THEN 'function' WHEN 2 THEN 'func' ELSE 'def' END, 'part' || p || '_' || n FROM l""",
        "chunk_text": rf"""WITH RECURSIVE d AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS ls FROM documents),
            z AS (SELECT doc_id, k, line, strlen({white.format("line")}) AS n, NOT regexp_matches(line, '\S') AS blank FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d)),
            f AS (SELECT doc_id, k, CASE WHEN blank THEN 0 ELSE 1 END AS start, CASE WHEN blank THEN 0 ELSE n END AS held, n, line FROM z WHERE k = 1
                  UNION ALL SELECT z.doc_id, z.k, CASE WHEN z.blank THEN 0 WHEN f.start = 0 OR f.held + z.n > {chunking.MAX_BYTES} THEN z.k ELSE f.start END,
                  CASE WHEN z.blank THEN 0 WHEN f.start = 0 OR f.held + z.n > {chunking.MAX_BYTES} THEN z.n ELSE f.held + z.n END, z.n, z.line FROM f JOIN z ON z.doc_id = f.doc_id AND z.k = f.k + 1)
            SELECT 'doc/' || doc_id AS file, start::INT AS start, max(k)::INT AS "end", sum(n)::INT AS bytes, sha256('doc/' || doc_id || ':' || start || ':' || string_agg(line, chr(10) ORDER BY k)) AS content_hash
            FROM f WHERE start > 0 GROUP BY doc_id, start""",
        "index_prune": "SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0)",
        "changed_chunks": """WITH c AS (SELECT doc_id, source || '/' || doc_id AS file, len(string_split(coalesce(text, ''), chr(10)))::INT AS n FROM documents),
            h AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'root/' || file END AS hf, 2 AS s, 2 + doc_id % 4 AS e FROM c WHERE doc_id % 3 = 0)
            SELECT file, 1 AS start, n AS "end" FROM c WHERE EXISTS (SELECT 1 FROM h WHERE (file = hf OR suffix(file, '/' || hf) OR suffix(hf, '/' || file)) AND 1 <= e AND n >= s)""",
        "changed_ranges": """SELECT 'line/' || l_linenumber AS file, count(*)::INT AS n, min(l_partkey)::INT AS first, max(l_partkey)::INT AS last FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY l_linenumber""",
        "embedding_texts": """SELECT doc_id AS chunk_id, sha256('// File: ' || source || '/' || doc_id || chr(10) || '// Language: ' || lang || chr(10) || '// Scope: ' || source || chr(10) || chr(10) || coalesce(text, '')) AS hash FROM documents""",
        "camel_parts": rf"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS place, part FROM (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS i
            FROM (SELECT page_id, list_filter(regexp_split_to_array({camel}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS p FROM pages))""",
        "language_counts": rf"""WITH e AS (SELECT lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '\.([^.]+)$', 1)) AS e FROM pages)
            SELECT CASE WHEN e = '' THEN 'text' WHEN e IN ({binary}) THEN NULL ELSE CASE e {named} ELSE e END END AS language, count(*) AS files FROM e GROUP BY 1""",
    }
