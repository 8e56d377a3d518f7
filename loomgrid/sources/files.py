"""File trees as rows of (file, language, length, mtime, content, content_hash); lists and diffs of git work trees.

Defined results: a missing root is an error; an empty tree gives no rows; file names are relative to the root, with '/'.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex, language_of, normal_path

MAX_LENGTH = 1 << 20


def _relative(root: str) -> Column:
    """The path without root, whatever scheme Spark puts before it."""
    where = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/")
    return normal_path(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(?://[^/]*)?" + re.escape(where) + "/", ""))


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, line) of the tree's .gitignore and .ignore files, outer folders first.

    The driver lists the tree's names and reads these files alone, since Spark's readers skip hidden ones.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found = fs.makeQualified(where).toString().rstrip("/") + "/", []
    names = fs.listFiles(where, True)
    while names.hasNext():
        path = names.next().getPath()
        if path.getName() not in (".gitignore", ".ignore"):
            continue
        with_bytes = fs.open(path)
        lines = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(with_bytes)).decode("utf-8", "replace").splitlines()
        with_bytes.close()
        folder = path.toString()[len(top) : -len(path.getName())]
        found += [(folder, line.rstrip()) for line in lines if line.strip() and not line.startswith("#")]
    return sorted(found, key=lambda r: (r[0].count("/"), r[0]))


class IgnoreRules:
    """Whether the last rule that fits a file, or a folder on its way, ignores it. ``!`` takes a file back.

    Rules without wildcards are found by name or path, those of the form ``*.ending`` by ending, so a file looks at the few
    rules that may fit it; only other patterns are tried one by one, compiled once a task.
    """

    _SIGNS = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}

    def __init__(self, rules: list[tuple[str, str]]):
        self.paths: dict[str, list] = {}
        self.names: dict[str, list] = {}
        self.endings: dict[str, list] = {}
        self.others: dict[str, list] = {}
        for n, (folder, line) in enumerate(rules):
            back, body = line.startswith("!"), line.removeprefix("!")
            only_folder, body = body.endswith("/"), body.rstrip("/")
            anchored, body = "/" in body, body.lstrip("/")
            told = (n, back, only_folder, folder)
            if not re.search(r"[*?\[\\]", body):
                (self.paths if anchored else self.names).setdefault(folder + body if anchored else body, []).append(told)
            elif not anchored and re.fullmatch(r"\*\.[^*?\[\\.]+", body):
                self.endings.setdefault(body[2:], []).append(told)
            else:
                regex = "".join(self._SIGNS.get(p) or (p if p.startswith("[") else re.escape(p)) for p in re.findall(r"\*\*/|/\*\*$|\*|\?|\[[^\]]*\]|.", body))
                pattern = re.compile(re.escape(folder) + ("" if anchored else "(?:.*/)?") + regex + ("/.*" if only_folder else "(?:/.*)?"), re.S)
                self.others.setdefault(folder, []).append((n, back, pattern))

    def __call__(self, file: str) -> bool:
        parts = file.split("/")
        last = (-1, True)
        for i, part in enumerate(parts):
            way, whole = "/".join(parts[: i + 1]), i == len(parts) - 1
            for found in (self.paths.get(way, ()), self.names.get(part, ()), self.endings.get(part.rsplit(".", 1)[-1], ()) if "." in part else ()):
                for n, back, only_folder, folder in found:
                    if n > last[0] and not (only_folder and whole) and way.startswith(folder):
                        last = (n, back)
            folder = "/".join(parts[:i]) + "/" if i else ""
            for n, back, pattern in self.others.get(folder, ()):
                if n > last[0] and pattern.fullmatch(file):
                    last = (n, back)
        return not last[1]


def ignored(file: Column, rules: list[tuple[str, str]]) -> Column:
    """``IgnoreRules`` over a column of names, in Arrow batches."""

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        test = IgnoreRules(rules)
        for names in batches:
            yield names.map(test).astype(bool)

    return told(file) if rules else F.lit(False)


#: Names that are read as paths of their own; of more, the tree is scanned and the others are left out.
MOST_NAMED = 10_000


def _scan(spark: SparkSession, root: str, max_length: int, excludes: tuple[str, ...], use_ignore_files: bool, names: list[str] | None = None) -> DataFrame:
    where = [root] if names is None or len(names) > MOST_NAMED else [f"{root.rstrip('/')}/" + re.sub(r"([*?\[\]{}\\])", r"\\\1", n) for n in names]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).where(F.col("length") <= max_length).withColumn("file", _relative(root))
    if names is not None and len(names) > MOST_NAMED:
        raw = raw.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "file string")), "file", "left_semi")
    for glob in excludes:
        raw = raw.where(~F.col("file").rlike(glob_regex(glob)))
    raw = raw.where(~F.col("file").rlike(r"(^|/)\."))
    if use_ignore_files:
        raw = raw.where(~ignored(F.col("file"), ignore_rules(spark, root)))
    return raw.withColumns({"language": language_of(F.col("file")), "mtime": F.unix_timestamp("modificationTime")}).where("language is not null")


def source_files(spark: SparkSession, root: str, max_length: int = MAX_LENGTH, excludes: tuple[str, ...] = (), use_ignore_files: bool = True, names: list[str] | None = None) -> DataFrame:
    """Text files under ``root``: not over ``max_length`` bytes, no zero byte in the first 8192, of a known language.

    excludes: globs on the relative path; one that cannot be read is an error. Files that ignore files name are left out
    unless asked for. names: of these files alone, which must be there; no other is read. Spark's readers skip files whose
    name begins with '.' or '_'; those of hidden folders go too.
    """
    if names is not None and not names:
        return spark.createDataFrame([], "file string, language string, length long, mtime long, content string, content_hash string")
    raw = _scan(spark, root, max_length, excludes, use_ignore_files, names)
    binary = F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00")
    text = F.replace(F.col("content").cast("string"), F.lit("\r"), F.lit(""))
    return raw.where(~binary).select("file", "language", "length", "mtime", text.alias("content"), F.sha2("content", 256).alias("content_hash"))


def tree_names(spark: SparkSession, root: str, max_length: int = MAX_LENGTH, excludes: tuple[str, ...] = (), use_ignore_files: bool = True) -> DataFrame:
    """file, language, length, mtime of what ``source_files`` may read; contents are not read, so binary files are named, too."""
    return _scan(spark, root, max_length, excludes, use_ignore_files).select("file", "language", "length", "mtime")


def _git(root: str, *args: str) -> list[str]:
    """Lines of a git command's answer; those of names end with a zero byte."""
    out = subprocess.run(["git", "-C", root, "-c", "core.quotePath=off", *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")
    return [x for x in out.split("\0" if "-z" in args else "\n") if x]


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """file: the tracked and the untracked files of a work tree that are not ignored, without the deleted ones."""
    listed = {k: spark.createDataFrame([(x,) for x in _git(root, "ls-files", "-z", *v)], "file string") for k, v in (("tracked", ()), ("untracked", ("--others", "--exclude-standard")), ("deleted", ("--deleted",)))}
    return listed["tracked"].union(listed["untracked"]).distinct().join(listed["deleted"], "file", "left_anti")


def git_head(root: str) -> str | None:
    """The commit of a work tree; None outside of one and before the first commit."""
    try:
        return _git(root, "rev-parse", "--verify", "-q", "HEAD")[0]
    except (subprocess.CalledProcessError, IndexError, FileNotFoundError):
        return None


def git_dirty(root: str) -> list[str]:
    """Files that differ from the commit: changed, deleted, renamed (both names) and untracked ones."""
    told, out = _git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--no-renames"), []
    for entry in told:
        out.append(entry[3:])
    return sorted(set(out))


def git_changed_since(root: str, commit: str) -> list[str] | None:
    """Files that differ between a commit and the current one; None if that commit is not known any more."""
    try:
        return sorted(set(_git(root, "diff", "--name-only", "-z", "--no-renames", commit, "HEAD")))
    except subprocess.CalledProcessError:
        return None


def git_diff_lines(spark: SparkSession, root: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """source, line_no, line of a diff without context: against ``base``, or of unstaged changes, with the staged ones if asked for."""
    asked = [("unstaged", ["diff", "-U0", *([base] if base else [])])]
    if staged and not base:
        asked.append(("staged", ["diff", "-U0", "--cached"]))
    rows = [(name, i, line) for name, args in asked for i, line in enumerate(_git(root, *args))]
    return spark.createDataFrame(rows, "source string, line_no int, line string")


def tree_size(spark: SparkSession, root: str) -> DataFrame:
    """files, bytes of all files under ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
