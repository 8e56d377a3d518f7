"""Scalar functions on text, as Column expressions: analysis of identifiers, hashes, counts, hunk headers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file ending, where the ending is not the name itself.
LANGUAGE_OF_ENDING = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash", "lua": "lua",
    "scala": "scala", "sc": "scala", "dart": "dart",
}
#: Endings of files that hold no text.
BINARY_ENDINGS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "exe", "dll", "so", "dylib", "bin", "zip", "tar", "gz", "xz", "7z",
    "rar", "bz2", "woff", "woff2", "ttf", "eot", "otf", "pdf", "doc", "docx", "pptx", "xlsx", "o", "obj", "a", "lib", "pyc", "pyo",
    "class", "wasm", "map", "mp3", "mp4", "wav", "avi", "mov", "mkv", "db", "sqlite", "sqlite3",
)

LETTER_OR_DIGIT = r"[^\p{L}\p{N}]+"
#: What runs of several camel-case parts hold.
SEVERAL = r"\p{Ll}\p{Lu}|[\p{Lu}\p{N}]\p{Lu}\p{Ll}"


def split_camel(word: Column) -> Column:
    """Parts of an identifier: at other than letters and digits, at lower-upper, and before the last of several capitals."""
    spaced = F.regexp_replace(F.regexp_replace(word, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"([\p{Lu}\p{N}]\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def analyse(text: Column) -> Column:
    """Index terms in order: each run of letters and digits, followed by its camel-case parts if it has several, lower-cased."""
    runs = F.array_remove(F.split(text, LETTER_OR_DIGIT), "")
    # most texts have no run of several parts, which one look tells
    return F.when(text.rlike(SEVERAL), F.transform(F.flatten(F.transform(runs, _with_parts)), F.lower)).otherwise(F.transform(runs, F.lower))


def _with_parts(run: Column) -> Column:
    return F.when(run.rlike(SEVERAL), F.concat(F.array(run), split_camel(run))).otherwise(F.array(run))


_code = analyse


def plain_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(text), LETTER_OR_DIGIT), "")


def placed(text: Column, analyse: Callable[[Column], Column]) -> Column:
    """The terms of ``analyse`` in order, each with its place: the number of the run of letters and digits that it comes from."""
    if analyse is plain_terms:
        return F.transform(plain_terms(text), lambda t, i: F.struct(t.alias("term"), i.alias("place")))
    runs = F.array_remove(F.split(text, LETTER_OR_DIGIT), "")
    if analyse is not _code:
        return F.flatten(F.transform(runs, lambda w, i: F.transform(analyse(w), lambda t: F.struct(t.alias("term"), i.alias("place")))))
    parts = F.flatten(F.transform(runs, lambda w, i: F.transform(_with_parts(w), lambda t: F.struct(F.lower(t).alias("term"), i.alias("place")))))
    return F.when(text.rlike(SEVERAL), parts).otherwise(F.transform(runs, lambda w, i: F.struct(F.lower(w).alias("term"), i.alias("place"))))


#: Other names of languages.
LANGUAGE_OF_NAME = {
    "rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "c++": "cpp", "cxx": "cpp", "c#": "csharp",
    "cs": "csharp", "rb": "ruby", "sh": "bash", "zsh": "bash",
}


def language_named(name: str) -> str:
    """The canonical name of a language; other names stand for themselves, in lower case."""
    return LANGUAGE_OF_NAME.get(name.lower(), name.lower())


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def joined_scope(parent: Column, name: Column) -> Column:
    """parent.name, without the dot where either is empty or null."""
    return F.concat_ws(".", F.nullif(parent, F.lit("")), F.nullif(name, F.lit("")))


def embedding_text(file: Column, language: Column, scope: Column, content: Column) -> Column:
    """What an embedder reads of a chunk: its place in comment lines, then its content."""
    place = F.concat(F.lit("// File: "), file, F.lit("\n// Language: "), language)
    return F.concat(place, F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit("\n// Scope: "), scope)).otherwise(F.lit("")), F.lit("\n\n"), content)


def index_name(root: Column) -> Column:
    """A folder name for the index of a tree: 16 hexadecimal digits."""
    return F.substring(F.sha2(root.cast("binary"), 256), 1, 16)


def valid_globs(globs: list[str] | tuple[str, ...]) -> list[str]:
    """The globs that can be compiled; others are ignored in searches."""

    def ok(g: str) -> bool:
        try:
            re.compile(glob_regex(g))
        except (re.error, ValueError):
            return False
        return True

    return [g for g in globs if ok(g)]


def non_white_bytes(text: Column) -> Column:
    """Bytes other than ASCII white space."""
    return F.octet_length(F.regexp_replace(text, r"[ \t\n\f\r]", ""))


def chunk_hash(file: Column, start: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", file, start.cast("string"), content).cast("binary"), 256)


def language_of(path: Column) -> Column:
    """Language by the last ending, lower-cased; 'text' without one; null for endings of binary files."""
    ending = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in LANGUAGE_OF_ENDING.items() for x in kv))
    return F.when(ending == "", F.lit("text")).when(ending.isin(*BINARY_ENDINGS), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, ending), ending))


def hunk_start(line: Column) -> Column:
    return F.regexp_extract(line, r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1).try_cast("int")


def hunk_length(line: Column) -> Column:
    n = F.regexp_extract(line, r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2)
    return F.when(n == "", F.lit(1)).otherwise(n.try_cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in doubles and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def overlap(content: Column, terms: list[str]) -> Column:
    """Share of the terms that the content holds, compared in ASCII lower case."""
    low = F.translate(content, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hits = [F.when(low.contains(t), F.lit(1.0)).otherwise(F.lit(0.0)) for t in terms]
    return sum(hits[1:], hits[0]) / len(terms) if terms else F.lit(0.0)


def n_tokens(text: Column) -> Column:
    """Runs of letters and digits: a count that needs no model."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def matched_lines(content: Column, query: str, start: Column) -> Column:
    """Numbers of the lines that hold a word of the query, or a part of such a word, in any case."""
    words = {w.lower() for w in query.split()}
    for w in list(words):
        parts = [p for p in re.split(r"[\W_]+", w) if p]
        words |= {p for p in parts if len(p.encode()) > 1} if len(parts) > 1 else set()
    if not words:
        return F.array().cast("array<int>")
    any_of = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(words))
    at = F.transform(F.split(F.lower(content), "\n"), lambda x, i: F.when(x.rlike(any_of), start + i))
    return F.filter(at, lambda x: x.isNotNull())


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: * and ? also match '/', **/ any folders or none, {a,b} either."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"glob {glob!r}: [ without ]")
            body = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}")
        out += {"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"glob {glob!r}: braces do not close")
    return f"^{out}$"
