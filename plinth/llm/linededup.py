"""Line deduplication by overlapping three-line windows.

A document's non-blank lines (stripped of ASCII white space at both ends)
form overlapping windows of three consecutive lines. A window's hash (128 bits,
so that no two of all windows of a corpus are taken for one) is looked up
over the whole corpus; every occurrence but the first, by
(doc_id, text digest, position), marks its three lines. Marked lines of
overlapping windows merge into runs, and the runs are removed.

Defined cases: null texts have no lines and stay null; blank lines are never
hashed and never removed, those between removed lines neither;
texts of fewer than three non-blank lines stay as they are; rows that repeat
both id and text count as one document, and each is returned with the same
result; null ids sort first; texts of any length are cut into lines whole; an
empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
WINDOW = 3
#: What the second half of a window's hash starts from.
CHECK_SEED = 7


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _numbered(text: Column) -> Column:
    """(line number, stripped line) of each non-blank line."""
    stripped = F.transform(_lines(text), lambda x, i: F.struct(i.cast("int").alias("no"), F.btrim(x, F.lit(WHITE)).alias("line")))
    return F.filter(stripped, lambda s: s.line != "")


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, hash, check, nos) of each window; ``hash`` and ``check`` together name its lines."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("digest"), _numbered(F.col("text")).alias("ls")).filter(F.size("ls") >= WINDOW)
    rows = kept.select("doc_id", "digest", "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - WINDOW)).alias("pos"))
    at = [F.col("ls")[F.col("pos") + k] for k in range(WINDOW)]
    return rows.select("doc_id", "digest", "pos", F.xxhash64(*(a["line"] for a in at)).alias("hash"), F.xxhash64(F.lit(CHECK_SEED), *(a["line"] for a in at)).alias("check"), F.array(*(a["no"] for a in at)).alias("nos"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, marked): the line numbers that repeat an earlier window, in order."""
    all_windows = windows(docs)
    place = F.struct("doc_id", "digest", "pos")
    repeated = all_windows.groupBy("hash", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    later = all_windows.join(repeated.select("hash", "check", "first"), ["hash", "check"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("nos")))).alias("marked"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, runs) of each row; runs are the merged [first, last] line spans removed."""
    marked = marked_lines(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    same = rows["doc_id"].eqNullSafe(marked["doc_id"]) & (rows["digest"] == marked["digest"])
    joined = rows.join(marked, same, "left").select(rows["doc_id"], rows["text"], "marked")
    gone = F.coalesce(F.col("marked"), F.array().cast("array<int>"))
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    pieces = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(F.col("runs"), lambda r: r.last + 1)),
        F.concat(F.transform(F.col("runs"), lambda r: r.first), F.array(F.size("ls"))),
        lambda a, b: F.slice(F.col("ls"), a + 1, b - a),
    )
    cleaned = F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    staged = joined.withColumn("runs", runs).withColumn("ls", _lines(F.col("text")))
    return staged.select(
        "doc_id", cleaned.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("ls")).alias("n_lines"), F.size(gone).alias("n_removed"), "runs"
    )
