"""Quality rules as weak supervision, with DataFrame functions only.

Every rule looks at one property of a text and votes good (1) well inside its usual range, bad (-1) far outside, or
abstains (0). Texts are bad in ways that have little to do with each other: a text full of symbols has normal words, lines and
capitals. Rules that look at a normal text would all vote good together, so counted as independent they drown the one that
sees the fault. So the rules are grouped by fault (``FAMILIES``, three rules each, which see one fault from three sides), and
each fault has a hidden state of its own. How far a rule can be trusted is estimated, not set: expectation-maximisation
over a family's vote patterns finds the share of texts without the fault and, for each rule, the share of its votes that are
right among texts without the fault and among those with it. A few pseudo-votes keep rules that hardly vote near their
starting values. A text's quality is the probability that it has none of the faults, the product over the families; one bad
vote is outweighed where the others of its family see nothing. Only vote patterns of a family with their counts (at most 27,
whatever the corpus's size) are gathered, into one row a family; the iterations run inside one SQL expression over it.

Words are maximal runs of other than ASCII white space. Repeated three-word windows are found by 64-bit hash within
one text. Defined results: a null text has no words; very long texts are counted whole; texts under ``min_words`` words
or with more than ``max_repeat_percent`` % of repeated words fail the base test and are never kept; repeated rows get
equal results; an empty table gives an empty result and the prior model. Input columns pass through; columns named
``_qr_*`` are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import SPACES, let, refuse

ROUNDS = 40
#: Pseudo-votes that hold each rule, and the share of good texts, near the start.
HOLD = 10.0
START = 0.8
PRIOR = 0.8


@dataclass(frozen=True)
class Model:
    """One entry a family. prior: share of texts without the fault. fine[j], faulty[j]: share of rule j's votes that are right among texts without and with it."""

    prior: tuple[float, ...]
    fine: tuple[tuple[float, ...], ...]
    faulty: tuple[tuple[float, ...], ...]


#: Words whose distinct ones are counted together.
BLOCK = 50


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    n = F.size(w)

    def windows(words: Column) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, words[i + 1], words[i + 2]))

    def marked(keys: Column) -> Column:
        by_key = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            at = F.filter(s, lambda e, j: (e["k"] == s[F.greatest(j - 1, F.lit(0))]["k"]) & (j > 0) | (e["k"] == s[F.least(j + 1, last)]["k"]) & (j < last))
            return let(F.transform(at, lambda e: e["i"]), lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2))))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(by_key, twice))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows(w), marked))


def statistics(text: Column) -> Column:
    """All of a text's counts in one struct."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, rf"[{SPACES}]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{SPACES}]"))

    def count(of: str) -> Column:
        return F.char_length(t) - F.char_length(F.regexp_replace(t, of, ""))

    return let(
        words,
        lambda w: let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                count(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                _block_distinct(w).cast("long").alias("n_block_distinct"),
                F.regexp_count(t, F.lit(rf"[#*$%&|<>][^{SPACES}]*")).cast("long").alias("n_symbol_words"),
                count(r"\p{Lu}+").cast("long").alias("n_upper"),
                count(r"!+").cast("long").alias("n_bangs"),
                F.regexp_count(t, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")).cast("long").alias("n_upper_words"),
                F.regexp_count(t, F.lit(rf"(?<![^{SPACES}])[^\p{{L}}{SPACES}]+(?![^{SPACES}])")).cast("long").alias("n_no_letter"),
                F.regexp_count(t, F.lit(rf"[^{SPACES}]{{31,}}")).cast("long").alias("n_long_words"),
            ),
        ),
    )


def _block_distinct(w: Column) -> Column:
    """Distinct words in each whole block of ``BLOCK`` words, added up."""
    blocks = F.floor(F.size(w) / BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(blocks, F.lit(1))), lambda k: F.size(F.array_distinct(F.slice(w, (k - 1) * BLOCK + 1, F.lit(BLOCK)))))
    return F.when(blocks < 1, F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda a, x: a + x))


#: Rules by the fault they look for.
FAMILIES = {
    "symbols": ("symbols_by_characters", "symbols_by_words", "words_with_symbols"),
    "repeats": ("duplicate_lines", "repeated_words", "distinct_words"),
    "shouting": ("capitals", "bangs", "upper_words"),
    "words": ("word_length", "words_without_letters", "very_long_words"),
}


def votes(s: Column) -> Column:
    """One array of votes a family, in the order of ``FAMILIES``. Texts under 50 words, or 3 lines, tell a rule of shares nothing good."""
    n, chars, lines = (F.greatest(s[c], F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    long = n >= 50
    in_blocks = F.floor(n / BLOCK) * BLOCK
    good_and_bad = (
        (
            (long & (100 * s["n_symbols"] <= chars), 20 * s["n_symbols"] > chars),
            (long & (20 * s["n_symbols"] <= n), 5 * s["n_symbols"] > n),
            (long & (20 * s["n_symbol_words"] <= n), 5 * s["n_symbol_words"] > n),
        ),
        (
            ((lines >= 3) & (10 * s["n_dup_lines"] <= lines), (lines >= 3) & (10 * s["n_dup_lines"] > 3 * lines)),
            (long & (10 * s["n_repeat_words"] <= n), 10 * s["n_repeat_words"] > 3 * n),
            (long & (2 * s["n_block_distinct"] >= in_blocks), long & (10 * s["n_block_distinct"] < 3 * in_blocks)),
        ),
        (
            (long & (100 * s["n_upper"] <= 15 * chars), 2 * s["n_upper"] > chars),
            (long & (50 * s["n_bangs"] <= n), 4 * s["n_bangs"] > n),
            (long & (10 * s["n_upper_words"] <= n), 2 * s["n_upper_words"] > n),
        ),
        (
            (long & (s["word_chars"] >= 3 * n) & (s["word_chars"] <= 12 * n), long & ((s["word_chars"] < 2 * n) | (s["word_chars"] > 20 * n))),
            (long & (5 * s["n_no_letter"] <= n), 2 * s["n_no_letter"] > n),
            (long & (50 * s["n_long_words"] <= n), 10 * s["n_long_words"] > n),
        ),
    )
    return F.array(*(F.array(*(F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)) for good, bad in f)) for f in good_and_bad))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with _qr_s (struct of counts) and _qr_votes (by family)."""
    refuse(docs, "_qr_")
    return docs.withColumn("_qr_s", statistics(F.col(f"`{text}`"))).withColumn("_qr_votes", votes(F.col("_qr_s")))


def _fine(vote: Column, m: Column) -> Column:
    """Probability that a text has not the fault of a family, from its votes and the family's estimates."""

    def weight(v: Column, j: Column) -> Column:
        good, bad = m["fine"][j] / (1 - m["faulty"][j]), (1 - m["fine"][j]) / m["faulty"][j]
        return F.when(v > 0, F.ln(good)).when(v < 0, F.ln(bad)).otherwise(F.lit(0.0))

    odds = F.aggregate(F.transform(vote, weight), F.ln(m["prior"] / (1 - m["prior"])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def fit(featured: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimates by expectation-maximisation over the vote patterns of all rows, for all families at once."""
    patterns = featured.select(F.posexplode("_qr_votes").alias("family", "v")).groupBy("family", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    families = patterns.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("ps"), F.sum("n").alias("total"))
    ps, total = F.col("ps"), F.col("total")

    def total_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def improve(state: Column, _: Column) -> Column:
        shares = F.transform(ps, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), _fine(p["v"], state).alias("q")))

        def again(pq: Column) -> Column:
            def right(j: Column, vote: int, mass) -> Column:
                hit = total_of(F.transform(pq, lambda p: F.when(p["v"][j] == vote, mass(p)).otherwise(F.lit(0.0))))
                cast = total_of(F.transform(pq, lambda p: mass(p) * F.abs(p["v"][j])))
                return (hit + HOLD * START) / (cast + HOLD)

            rules = F.transform(ps[0]["v"], lambda _, j: j)
            prior = (total_of(F.transform(pq, lambda p: p["n"] * p["q"])) + HOLD * PRIOR) / (total + HOLD)
            fine = F.transform(rules, lambda j: right(j, 1, lambda p: p["n"] * p["q"]))
            faulty = F.transform(rules, lambda j: right(j, -1, lambda p: p["n"] * (1 - p["q"])))
            return F.struct(prior.alias("prior"), fine.alias("fine"), faulty.alias("faulty"))

        return let(shares, again)

    held = F.transform(ps[0]["v"], lambda _: F.lit(START))
    start = F.struct(F.lit(PRIOR).alias("prior"), held.alias("fine"), held.alias("faulty"))
    found = {r["family"]: r["m"] for r in families.select("family", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve).alias("m")).collect()}
    names = list(FAMILIES.values())
    told = [(found[i]["prior"], tuple(found[i]["fine"]), tuple(found[i]["faulty"])) if i in found else (PRIOR, (START,) * len(rules), (START,) * len(rules)) for i, rules in enumerate(names)]
    return Model(*(tuple(x) for x in zip(*told, strict=True)))


def judged(featured: DataFrame, model: Model, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds _qr_quality (probability that the text has no fault), _qr_failed (base test) and _qr_kept."""
    quality = F.lit(1.0)
    for i, (prior, fine, faulty) in enumerate(zip(model.prior, model.fine, model.faulty, strict=True)):
        odds = F.lit(math.log(prior / (1 - prior)))
        for j, (a, b) in enumerate(zip(fine, faulty, strict=True)):
            vote = F.col("_qr_votes")[i][j]
            odds = odds + F.when(vote > 0, math.log(a / (1 - b))).when(vote < 0, math.log((1 - a) / b)).otherwise(0.0)
        quality = quality / (1 + F.exp(-odds))
    failed = (F.col("_qr_s.n_words") < min_words) | (100 * F.col("_qr_s.n_repeat_words") > max_repeat_percent * F.col("_qr_s.n_words"))
    return featured.withColumns({"_qr_quality": quality, "_qr_failed": failed}).withColumn("_qr_kept", ~F.col("_qr_failed") & (F.col("_qr_quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns. Texts are counted once: rows are written with their votes and read again."""
    counted = staged(features(docs, text), "quality-counts")
    return judged(counted, fit(counted)).where("_qr_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
