"""Changed ranges from unified diffs, kept as rows of (source, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def unquoted(name: Column) -> Column:
    """A file name as git writes it: in double quotes with backslash escapes (octal for bytes), or plain."""
    parts = F.regexp_extract_all(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(r"(\\[0-3][0-7][0-7]|\\.|[^\\]+)"), F.lit(1))
    letters = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}

    def plain(part: Column) -> Column:
        told = F.substring(part, F.lit(2), F.length(part))
        known = F.when(told.rlike("^[0-7]{3}$"), F.unhex(F.lpad(F.conv(told, 8, 16), 2, "0")))
        for letter, code in letters.items():
            known = known.when(told == letter, F.lit(bytes([code])))
        return F.when(~F.startswith(part, F.lit("\\")), part.cast("binary")).otherwise(known.otherwise(told.cast("binary")))

    whole = F.aggregate(F.transform(parts, plain), F.lit(b""), lambda a, x: F.concat(a, x)).cast("string")
    return F.when(F.startswith(name, F.lit('"')) & F.endswith(name, F.lit('"')) & (F.length(name) > 1), whole).otherwise(name)


def parse_diff(lines: DataFrame, source: str = "source", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """source, file, start, end of each hunk's new side. A hunk belongs to the last '+++ b/' line above it in its diff;
    hunks that only delete, and those of deleted files, give no row."""
    w = Window.partitionBy(source).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    # git ends a name that holds a blank with a tab, and quotes one with other signs
    name = unquoted(F.regexp_replace(F.substring(F.col(line), F.lit(5), F.length(F.col(line))), r"\t.*$", ""))
    header = F.when(F.col(line).startswith("+++ "), F.when(F.startswith(name, F.lit("b/")), F.substring(name, F.lit(3), F.length(name))).otherwise(F.lit("")))
    marked = lines.where(F.col(line).startswith("+++ ") | F.col(line).startswith("@@ ")).withColumn("file", F.last(header, ignorenulls=True).over(w))
    hunks = marked.where(F.col(line).startswith("@@ ") & (F.col("file") != "")).select(F.col(source).alias("source"), "file", T.hunk_start(F.col(line)).alias("start"), T.hunk_length(F.col(line)).alias("n"))
    return hunks.where("start is not null and n > 0").select("source", "file", "start", (F.col("start") + F.col("n") - 1).alias("end"))
