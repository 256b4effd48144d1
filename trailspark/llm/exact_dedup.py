"""Exact deduplication by 128-bit content hash, smallest id kept, bytes compared inside groups.

Only hashes are shuffled for all rows. Texts travel for hashes that occur more than once, and
there as the smallest and largest text of a group, combined before the shuffle: they are equal
exactly when all texts of the group are. Groups that fail (a hash collision) are grouped again
by their texts.

Defined cases: null text counts as empty; of rows with equal id and text one is kept; rows
whose id is null come after all others; a table without rows gives one without rows; only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, sized_broadcast

#: Runs of these count as one space: blank, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"
#: Up to so many repeated hashes (16 bytes each, so 16 MB and their overhead) are broadcast.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def hash128(text: Column) -> Column:
    """MD5 as 16 bytes: a content hash, the comparison of bytes makes it safe."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = hash128
) -> DataFrame:
    """(id, keep_id, group_size long, kept boolean, text_sha256 string), a row for each input row."""
    norm = normalised(F.col(text_col))
    read = df.select(F.col(id_col).alias("id"), norm.alias("t"))
    rows = materialize(
        read.select(
            "id",
            content_hash(F.col("t")).alias("h"),
            F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "hashes",
    )
    first = F.struct(F.col("id").isNull().alias("n"), "id", "uid")
    groups = materialize(rows.groupBy("h").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    found = groups.count()

    # bytes: texts of repeated hashes only, one smallest and one largest a group and task
    texts = read.select(content_hash(F.col("t")).alias("h"), "t")
    shared = texts.join(sized_broadcast(groups.select("h"), found, BROADCAST_ROWS), "h", "left_semi")
    ends = shared.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    clashes = materialize(ends.where("low <> high").select("h"), "clashes")

    keep = groups.select("h", "first", "n")
    out = rows.join(sized_broadcast(keep, found, BROADCAST_ROWS), "h", "left")
    bad = clashes.count()
    if bad:  # equal hashes of different texts: those rows are grouped by sha-256 and text
        out = out.join(sized_broadcast(clashes, bad, BROADCAST_ROWS), "h", "left_anti")
        again = (
            read.select("id", content_hash(F.col("t")).alias("h"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "t", F.monotonically_increasing_id().alias("uid"))
            .join(sized_broadcast(clashes, bad, BROADCAST_ROWS), "h", "left_semi")
        )
        again = materialize(again, "clashing")
        own = again.groupBy("t").agg(F.min(first).alias("first"), F.count("*").alias("n"))
        out = out.unionByName(again.join(own, "t").select(*out.columns))
    best = F.coalesce(F.col("first"), first)
    return out.select(
        F.col("id").alias(id_col),
        best["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (best["uid"] == F.col("uid")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, that exact deduplication keeps.

    Dropped ids are few or many; they are broadcast only within BROADCAST_ROWS. Rows that share
    an id with a kept row and are copies of it are merged.
    """
    marks = materialize(exact_duplicates(df, id_col, text_col).select(F.col(id_col).alias("id"), "kept", "text_sha256"), "marks")
    lost = materialize(marks.where(~F.col("kept")).select("id", "text_sha256").distinct(), "lost")
    n = lost.count()
    # an id and text both kept and lost: repeated rows, of which one stays
    twice = materialize(_both(lost, marks), "twice")
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    gone = lost.select(F.col("id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha"))
    on = df[id_col].eqNullSafe(F.col("_lost_id")) & (sha == F.col("_lost_sha"))
    kept = df.join(sized_broadcast(gone, n, BROADCAST_ROWS), on, "left_anti")
    if twice.isEmpty():
        return kept
    some = twice.select(F.col("id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha"))
    back = df.join(sized_broadcast(some, twice.count(), BROADCAST_ROWS), on, "left_semi").withColumn("_sha", sha)
    return kept.unionByName(back.dropDuplicates([id_col, "_sha"]).drop("_sha"))


def _both(lost: DataFrame, marks: DataFrame) -> DataFrame:
    good = marks.where("kept").select(F.col("id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    return lost.join(good, lost["id"].eqNullSafe(F.col("k_id")) & (lost["text_sha256"] == F.col("k_sha")), "left_semi")
