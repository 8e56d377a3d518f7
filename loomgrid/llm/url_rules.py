"""URL filtering by listed rules and by association rules that FP-growth mines, with DataFrame functions only.

A listed rule names a host (with all its subdomains) and a beginning of the path; the longest one that fits a URL decides it.
URLs that no listed rule fits are judged by mined rules: every URL is a set of tokens (labels of the host, segments of the
path, names of query parameters), the labelled URLs with their label as one more item are the transactions of Spark's
FP-growth, and each frequent set with a label is a rule "these tokens, so this label". Pruned are rules below the least
confidence and those that are no better than the rule with one token less (at the end, than the label's share of all).

Rules match by inverted index: each is posted under its rarest token only. Of every URL the tokens that occur in any rule
are kept (a hash set of at most as many tokens as are frequent); equal sets of them are one row from then on, so a host of a
third of all URLs is one row. Each such set meets the rules posted under its tokens, those with all their tokens in it match,
and the one with the greatest confidence decides (ties: more URLs, fewer tokens, order of the tokens). The decisions return
to the URLs by broadcast while they are few, else by a join with the hot sets spread over salts.

All frequent tokens are mined. FP-growth takes those that are among the ``ITEMS`` most uneven ones (by label) of every
labelled URL they occur in, so a transaction has at most 2 to that number of subsets. Sets with any other token grow out of
FP-growth's, one token a round, from conditional bases: rows of a set, the tokens behind it and a number of URLs, equal ones
merged. Only sets that can be part of a rule grow: frequent with the label, each token takes away URLs of other labels, and
some of those are left. Copies of URLs and tokens that come together therefore end after one or two rounds; the work is that
of the sets that pass, and many tokens that come and go independently make many. Frequent tokens are collected by the
driver; they are at most the tokens of a labelled URL on average / MIN_SHARE.

Defined results: null URLs and those without "://" have an empty host and path and no tokens; empty, very long and repeated
URLs are judged as any other; an empty table gives an empty result and, as labelled URLs, no rules; without a matching rule
the verdict is ``default``. Input columns pass through; columns named ``_ur_*`` are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, staged
from .common import refuse

#: Least share of the labelled URLs that a rule covers, and least number of them.
MIN_SHARE, LEAST = 0.005, 5
MIN_CONFIDENCE = 0.9
#: Frequent tokens of one URL that FP-growth takes; sets with others are grown from its sets.
ITEMS = 12
#: Token sets that are broadcast at most; more are joined, each copied to so many salts.
MOST_BROADCAST, SALTS = 50_000, 16
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Listed:
    """A rule of a list: host and beginning of the path in one string, as in ``example.org/en/``."""

    verdict: str
    rule: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when(at > 0, F.substring(rest, at, F.length(rest))), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: h=label of the host, s=segment of the path, q=name of a parameter; A-Z lower-cased."""
    query = F.substring_index(_rest(url), "#", 1)
    at = F.instr(query, "?")
    query = F.coalesce(F.when(at > 0, F.substring(query, at + 1, F.length(query))), F.lit(""))

    def parts(of: Column, sign: str, kind: str) -> Column:
        return F.transform(F.filter(F.split(of, sign), lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}="), x))

    names = F.transform(F.split(F.translate(query, _UPPER, _LOWER), "&"), lambda x: F.substring_index(x, "=", 1))
    named = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("q="), x))
    return F.array_distinct(F.concat(parts(host(url), r"\.", "h"), parts(F.translate(path(url), _UPPER, _LOWER), "/", "s"), named))


def listed_rule(host: Column, path: Column, rules: list[Listed]) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits; null if none does. Equally long ones: the first listed."""
    parts = [F.struct(F.lit(len(r.rule)).alias("n"), F.lit(-i).alias("order"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.rule.split("/", 1)[0].translate(str.maketrans(_UPPER, _LOWER))).alias("host"), F.lit("/" + r.rule.split("/", 1)[1] if "/" in r.rule else "").alias("path")) for i, r in enumerate(rules)]
    if not parts:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    fits = F.filter(F.array(*parts), lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _count(df: DataFrame, *by: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def mine(labelled: DataFrame, min_share: float = MIN_SHARE, least: int = LEAST, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from labelled URLs (tokens: array, label: string): tokens (sorted), label, n (URLs with both), n_tokens (with the tokens), confidence."""
    shares = [(r.label, r.n) for r in _count(labelled, "label", name="n").collect()]
    total = sum(n for _, n in shares)
    need = max(least, math.ceil(total * min_share))
    if need > total:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, label string, n long, n_tokens long, confidence double")
    blocked = dict(shares).get(BLOCK, 0)
    each = labelled.select(F.explode("tokens").alias("token"), (F.col("label") == BLOCK).cast("long").alias("bad"))
    uneven = F.abs(F.sum("bad") * total - F.count(F.lit(1)) * blocked)
    frequent = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), uneven.alias("uneven")).where(F.col("n") >= need).select("token", "uneven").collect()
    known = [r.token for r in sorted(frequent, key=lambda r: (-r.uneven, r.token))]
    beyond = _beyond(labelled, known)
    core = [t for t in known if t not in beyond]
    baskets = labelled.select(F.concat(_of("tokens", core), F.array(F.concat(F.lit("="), F.col("label")))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total, minConfidence=0.0).fit(baskets).freqItemsets
    is_label = F.filter("items", lambda x: F.startswith(x, F.lit("=")))
    split = staged(sets.select(F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("=")))).alias("tokens"), F.substring(F.get(is_label, F.lit(0)), 2, 1 << 20).alias("label"), F.col("freq").alias("n")), "url-sets")
    alone = split.where("label is null").select("tokens", F.col("n").alias("n_tokens"))
    none = labelled.sparkSession.createDataFrame([([], int(total))], "tokens array<string>, n_tokens long")
    scored = split.where("label is not null").join(alone.unionByName(none), "tokens").withColumn("confidence", F.col("n") / F.col("n_tokens"))
    rival = _with_one_less(scored.where(F.size("tokens") > 0), scored)
    ranked = scored.join(rival, ["tokens", "label"], "left").withColumn("rival", F.coalesce("rival", F.lit(0.0)))
    if beyond:
        ranked = staged(ranked, "url-scored")
    rules = ranked.where((F.size("tokens") > 0) & _is_rule(min_confidence)).select(*_RULE)
    if not beyond:
        return rules
    live = ranked.where(((F.size("tokens") == 0) | (_others() < F.col("fewest"))) & (_others() > 0)).select(*_RULE)
    return rules.unionByName(_grown(labelled, core, sorted(beyond), live, need, min_confidence))


_RULE = ("tokens", "label", "n", "n_tokens", "confidence")


def _of(tokens: str, known: list[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(known)) if known else F.array().cast("array<string>")


def _others() -> Column:
    """URLs with the tokens and another label."""
    return F.col("n_tokens") - F.col("n")


def _is_rule(min_confidence: float) -> Column:
    """A rule must be better than each of those with one token less."""
    return (F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("rival"))


def _beyond(labelled: DataFrame, known: list[str]) -> set[str]:
    """The frequent tokens (given by rank) that some URL has behind ITEMS others."""
    if len(known) <= ITEMS:
        return set()
    wide = labelled.where(F.size(_of("tokens", known)) > ITEMS).select(F.array_intersect(F.lit(known), F.col("tokens")).alias("told"))
    return {r.token for r in wide.select(F.explode(F.slice("told", F.lit(ITEMS + 1), F.size("told"))).alias("token")).distinct().collect()}


def _with_one_less(sets: DataFrame, scored: DataFrame) -> DataFrame:
    """tokens, label, rival (greatest confidence), fewest (URLs of other labels) and found (number) of the scored sets with one token less."""
    less = sets.select("tokens", "label", F.posexplode("tokens").alias("at", "token"))
    less = less.select(F.col("tokens").alias("whole"), "label", F.concat(F.slice("tokens", F.lit(1), F.col("at")), F.slice("tokens", F.col("at") + 2, F.size("tokens"))).alias("tokens"))
    met = less.join(scored.select("tokens", "label", F.col("confidence").alias("c"), _others().alias("others")), ["tokens", "label"])
    return met.groupBy(F.col("whole").alias("tokens"), "label").agg(F.max("c").alias("rival"), F.min("others").alias("fewest"), F.count(F.lit(1)).alias("found"))


def _grown(labelled: DataFrame, core: list[str], beyond: list[str], live: DataFrame, need: int, min_confidence: float) -> DataFrame:
    """Rules with a token of ``beyond``. live: the sets of ``core`` that others can grow from, the empty one included.

    A rule has fewer URLs of other labels than each set with one token less, so each of those is live, and theirs in turn.
    """
    split = labelled.select(F.array_sort(_of("tokens", core)).alias("core"), F.array_sort(_of("tokens", beyond)).alias("beyond"), "label")
    rows = _count(split.where(F.size("beyond") > 0), "core", "beyond", "label", name="urls")
    bases = staged(rows.select(F.array().cast("array<string>").alias("tokens"), F.lit(False).alias("grown"), F.concat("core", "beyond").alias("rest"), "label", "urls"), "url-bases")
    found, size, before = [], 0, live.where(F.size("tokens") == 0)
    while not bases.isEmpty():
        size += 1
        # each set with each token behind it
        more = bases.select("tokens", "grown", "rest", "label", "urls", F.posexplode("rest").alias("at", "token"))
        more = more.select(F.array_sort(F.concat("tokens", F.array("token"))).alias("tokens"), (F.col("grown") | F.col("token").isin(beyond)).alias("grown"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "label", "urls")
        by_label = more.where("grown").groupBy("tokens", "label").agg(F.sum("urls").alias("n"))
        counted = by_label.withColumn("n_tokens", F.sum("n").over(Window.partitionBy("tokens"))).where(F.col("n") >= need).withColumn("confidence", F.col("n") / F.col("n_tokens"))
        counted = staged(counted, "url-counted")
        checked = counted.join(_with_one_less(counted, before), ["tokens", "label"]).where((F.col("found") == size) & (_others() < F.col("fewest")))
        checked = staged(checked, "url-grown")
        found.append(checked.where(_is_rule(min_confidence)).select(*_RULE))
        before = checked.where(_others() > 0).select(*_RULE).unionByName(live.where(F.size("tokens") == size))
        rest = F.col("rest")
        if size == 1:
            alone = [r.token for r in before.select(F.col("tokens")[0].alias("token")).distinct().collect()]
            rest = _of("rest", alone)
        kept = more.join(before.select("tokens").distinct(), "tokens", "left_semi").withColumn("rest", rest).where(F.size("rest") > 0)
        was, bases = bases, staged(kept.groupBy("tokens", "grown", "rest", "label").agg(F.sum("urls").alias("urls")), "url-bases")
        discard(was, counted)
    discard(bases)
    return reduce(DataFrame.unionByName, found)


def _decided(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (distinct arrays of tokens) that match a rule: sets' column, verdict and the rule."""
    freq = _count(rules.select(F.explode("tokens").alias("token")), "token", name="n")
    each = rules.withColumn("id", F.monotonically_increasing_id()).select("*", F.explode("tokens").alias("token"))
    posted = each.join(freq.withColumnRenamed("n", "posts"), "token").groupBy("id").agg(F.min_by("token", F.struct("posts", "token")).alias("token"), F.first("tokens").alias("tokens"), F.first("label").alias("label"), F.first("n").alias("n"), F.first("confidence").alias("confidence"))
    met = sets.select("_ur_set", F.explode("_ur_set").alias("token")).join(posted, "token").where(F.size(F.array_except("tokens", "_ur_set")) == 0)
    ranked = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("m"), F.size("tokens").alias("s"), F.col("tokens").alias("tokens"), F.col("label").alias("label"))).alias("best")
    return met.groupBy("_ur_set").agg(ranked).select("_ur_set", F.struct(F.col("best.label").alias("verdict"), F.col("best.tokens").alias("tokens"), (-F.col("best.c")).alias("confidence")).alias("_ur_mined"))


def judge(pages: DataFrame, listed: list[Listed], url: str = "url", rules: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """Adds _ur_host, _ur_path, _ur_rule (listed), _ur_mined (verdict, tokens, confidence of the mined rule) and _ur_verdict.

    rules: as ``mine`` gives them; by default they are mined from the URLs that a listed rule decides.
    """
    refuse(pages, "_ur_")
    u = F.col(f"`{url}`")
    split = pages.withColumns({"_ur_host": host(u), "_ur_path": path(u)}).withColumn("_ur_listed", listed_rule(F.col("_ur_host"), F.col("_ur_path"), listed))
    if rules is None:
        rules = mine(split.where("_ur_listed is not null").select(tokens(u).alias("tokens"), F.col("_ur_listed.verdict").alias("label")))
    rules = staged(rules, "url-rules")
    known = [r.token for r in rules.select(F.explode("tokens").alias("token")).distinct().collect()]
    told = F.when(F.col("_ur_listed").isNull(), F.array_sort(F.filter(tokens(u), lambda t: t.isin(known)))) if known else F.lit(None).cast("array<string>")
    marked = split.withColumn("_ur_set", told)
    sets = marked.where(F.size("_ur_set") > 0).select("_ur_set").distinct()
    decided = staged(_decided(sets, rules), "url-sets")
    if decided.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        joined = marked.join(F.broadcast(decided), "_ur_set", "left")
    else:
        # URLs without such tokens find nothing and are not shuffled
        asked = marked.where(F.size("_ur_set") > 0).withColumn("_ur_salt", F.pmod(F.xxhash64(u), F.lit(SALTS)))
        copies = decided.withColumn("_ur_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = asked.join(copies, ["_ur_set", "_ur_salt"], "left").unionByName(marked.where("_ur_set is null OR size(_ur_set) = 0"), True)
    verdict = F.coalesce(F.col("_ur_listed.verdict"), F.col("_ur_mined.verdict"), F.lit(default))
    return joined.select(*(F.col(f"`{c}`") for c in pages.columns), "_ur_host", "_ur_path", F.col("_ur_listed.rule").alias("_ur_rule"), "_ur_mined", verdict.alias("_ur_verdict"))


def keep_allowed(pages: DataFrame, listed: list[Listed], url: str = "url") -> DataFrame:
    """The rows whose URL is allowed, with the input's columns."""
    return judge(pages, listed, url).where(F.col("_ur_verdict") == ALLOW).select(*(F.col(f"`{c}`") for c in pages.columns))
