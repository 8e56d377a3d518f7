"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import chat_collapse, cuckoo_dedup, mixing, near_dedup, packing, prefix_free, prefix_trie, quality_classifier, quality_rules, runs, secrets, toxicity, url_rules
from .common import SPACES, let


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = staged(quality_rules.features(docs).drop("text"), "quality-counts")
    found = quality_rules.judged(counted, quality_rules.fit(counted))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *(F.col(f"_qr_s.{n}").alias(n) for n in names), F.col("_qr_failed").alias("base_failed"), F.col("_qr_kept").alias("kept"), F.col("_qr_quality").alias("quality"))


#: Learn from rows of another remainder only; that of the held-out rows comes second.
QUALITY_HELD, TOXIC_HELD = (4, 2), (3, 1)


def _held_out(fold: tuple[int, int]) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold[0])) == fold[1], F.lit(False))


def _predicted() -> Column:
    return F.when(F.col("score") >= 0.7, F.lit(1)).otherwise(F.lit(0)).alias("predicted")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), ~_held_out(QUALITY_HELD))
    return quality_classifier.score(docs, machine).select("doc_id", _held_out(QUALITY_HELD).alias("held_out"), "score", _predicted())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~_held_out(TOXIC_HELD))
    return toxicity.score(docs, index).select("doc_id", _held_out(TOXIC_HELD).alias("held_out"), "score", _predicted(), "evidence")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(n, kinds), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"), (F.col("_mx_whole") * F.col("_mx_size") + F.col("_mx_part")).alias("taken"))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(_table(spark, sf_dir, "conversations"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The given list of op11.
LISTED = [url_rules.Listed(v, r) for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of URLs are the verdicts of the listed rules; what they do not decide is judged by mined rules."""
    judged = url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), LISTED)
    names = {"host": "_ur_host", "path": "_ur_path", "rule": "_ur_rule", "verdict": "_ur_verdict"}
    return judged.select("page_id", *(F.col(c).alias(n) for n, c in names.items()), F.array_join("_ur_mined.tokens", " ").alias("mined_rule"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents whose hash ends in 0 repeat from one of their words on; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", rf"[{SPACES}]+"), "")

    def rebuilt(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        at = F.pmod(g, n).cast("int")
        period = 1 + F.floor((n - at) / (3 + F.pmod(g, F.lit(8)))).cast("int")
        return let(F.struct(at.alias("at"), period.alias("p")), lambda x: F.array_join(F.transform(w, lambda _, i: w[F.when(i < x["at"], i).otherwise(x["at"] + F.pmod(i - x["at"], x["p"]))]), " "))

    text = F.when(F.pmod(h, F.lit(10)) == 0, let(words, lambda w: F.when(F.size(w) > 0, rebuilt(w)).otherwise(F.lit("")))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    named = found.withColumn("best", best).withColumns({"length": F.col("best.length"), "start": -F.col("best.start"), "period": -F.col("best.period")})
    exponent = F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli")
    return named.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", exponent, F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = staged(prefix_trie.digested(_table(spark, sf_dir, "conversations")), "trie-turns")
    group = F.col("conv_id") - F.col("conv_id") % 20
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    return prefix_trie.trie(prefix_trie.shared_beginnings(digests, group, taken, 3), digests.select("conv_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_collapse": """
            WITH c AS (SELECT *, coalesce('c' || conv_id, 'r' || row_number() OVER ()) AS own FROM conversations),
            t AS (SELECT own, conv_id, role, text, row_number() OVER (PARTITION BY own ORDER BY turn, role, text) AS r,
                              count(*) OVER (PARTITION BY own) AS n FROM c),
            p AS (SELECT own, conv_id, r, n, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '')
                         OVER (PARTITION BY own ORDER BY r ROWS UNBOUNDED PRECEDING) AS rendered FROM t),
            k AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, rendered FROM p WHERE r = n GROUP BY n, rendered)
            SELECT conv_id, n_turns, n_copies, rendered FROM k
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT r, rendered FROM p WHERE r < n) q WHERE q.r = k.n_turns AND q.rendered = k.rendered)""",
        "op11_url_rules": """
            WITH u AS (SELECT page_id, row_number() OVER () AS own, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
            a AS (SELECT page_id, own, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '') AS query FROM u),
            l(verdict, rule, host, path) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
                                                    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
            f AS (SELECT own, max_by({'rule': l.rule, 'verdict': l.verdict}, length(l.rule)) AS listed FROM a JOIN l ON (a.host = l.host OR ends_with(a.host, '.' || l.host)) AND starts_with(a.path, l.path) GROUP BY own),
            p AS (SELECT a.*, f.listed.rule AS rule, f.listed.verdict AS label,
                         list_distinct(list_transform(list_filter(string_split(a.host, '.'), lambda x: x <> ''), lambda x: 'h=' || x)
                           || list_transform(list_filter(string_split(translate(a.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/'), lambda x: x <> ''), lambda x: 's=' || x)
                           || list_transform(list_filter(list_transform(string_split(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q=' || x)) AS tokens
                  FROM a LEFT JOIN f USING (own)),
            z AS (SELECT count(*) AS total, count(*) FILTER (label = 'block') AS blocked, greatest(5, ceil(count(*) * 0.005)) AS need FROM p WHERE label IS NOT NULL),
            e AS (SELECT own, label, unnest(tokens) AS token FROM p WHERE label IS NOT NULL),
            q AS (SELECT token, abs(count(*) FILTER (label = 'block') * any_value(total) - count(*) * any_value(blocked)) AS uneven FROM e, z GROUP BY token HAVING count(*) >= any_value(need)),
            b AS (SELECT own, label, token, row_number() OVER (PARTITION BY own ORDER BY uneven DESC, token) AS r FROM e JOIN q USING (token)),
            i AS (SELECT p.own, p.label, coalesce(list(b.token ORDER BY b.token) FILTER (b.token IS NOT NULL), []) AS items FROM p LEFT JOIN b ON b.own = p.own AND b.r <= 12 WHERE p.label IS NOT NULL GROUP BY p.own, p.label),
            s AS (SELECT label, list_filter(items, lambda x, k: (m.m >> (k - 1)) & 1 = 1) AS tokens FROM i, LATERAL (SELECT unnest(range(0, 1 << len(items))) AS m) m),
            c AS (SELECT tokens, label, n, n_tokens, n / n_tokens AS confidence FROM (SELECT tokens, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY tokens) AS n_tokens FROM s GROUP BY tokens, label), z WHERE n >= need),
            d AS (SELECT tokens AS whole, label, tokens[1:k - 1] || tokens[k + 1:] AS tokens FROM c, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS k) k),
            v AS (SELECT d.whole, d.label, max(confidence) AS rival FROM d JOIN c ON c.tokens = d.tokens AND c.label = d.label GROUP BY d.whole, d.label),
            r AS (SELECT c.* FROM c LEFT JOIN v ON v.whole = c.tokens AND v.label = c.label WHERE len(c.tokens) > 0 AND confidence >= 0.9 AND confidence > coalesce(rival, 0)),
            m AS (SELECT own, r.label AS verdict, r.tokens, row_number() OVER (PARTITION BY own ORDER BY confidence DESC, n DESC, len(r.tokens), r.tokens) AS k
                  FROM p JOIN r ON list_has_all(p.tokens, r.tokens) WHERE p.rule IS NULL)
            SELECT page_id, host, path, rule, coalesce(p.label, m.verdict, 'allow') AS verdict, array_to_string(m.tokens, ' ') AS mined_rule FROM p LEFT JOIN m ON m.own = p.own AND m.k = 1""",
        "op13_prefix_trie": """
            WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
                       FROM conversations WHERE conv_id IS NOT NULL),
            s AS (SELECT DISTINCT c, c::VARCHAR AS s FROM t),
            h AS (SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
                         lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM s),
            b AS (SELECT h.c, t.r AS o, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.r <= h.h
                  UNION ALL SELECT h.c, t.r, role, text FROM h JOIN t ON t.c = h.c AND t.r > h.h),
            p AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY o) FILTER (o IS NOT NULL), []) AS path FROM h LEFT JOIN b ON b.c = h.c GROUP BY h.c),
            n AS (SELECT c, u.d, path[1:u.d] AS node FROM p, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d) u),
            g AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM n GROUP BY d, node),
            k AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.node[1:g.d] = g.node) AS n_children FROM g),
            e AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM p GROUP BY path)
            SELECT k.conv_id, k.d AS depth, (SELECT x.conv_id FROM g x WHERE x.d = k.d - 1 AND x.node = k.node[1:k.d - 1]) AS parent_conv_id, k.n_convs, k.n_children,
                   (SELECT count(*) FROM k x WHERE x.d >= k.d AND x.n_children = 0 AND x.node[1:k.d] = k.node) AS n_leaves,
                   (SELECT sum((x.n_convs - 1) * x.words)::BIGINT FROM k x WHERE x.d >= k.d AND x.node[1:k.d] = k.node) AS saved_tokens,
                   sha256(coalesce((SELECT ids FROM e WHERE len(e.path) = k.d AND e.path = k.node), '')) AS ends_sha256
            FROM k""",
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
