"""Exact dedup [native]: a heavy-hitter split over digests of the normalised texts.

1. One scan makes a narrow table (id, row id, digest, length) in the shared folder; texts never
   shuffle. Digest: SHA-256 of the text in UTF-8 after lower-casing A-Z only.
2. A Misra-Gries summary over 64 bits of the digest names at most ``TOP`` frequent candidates.
3. The candidates' exact counts and winners are computed (partial sums only) and *verified*:
   whole digest and length decide, and only a group of ``MIN_SHARE`` of the rows or more counts
   as heavy. The verified winners, at most ``TOP`` rows, are broadcast; heavy rows are resolved
   map-side and never shuffle.
4. The other digests are grouped and joined by ordinary shuffles; no such group is larger than
   the share above, and the row side of the join may be split by adaptive execution.

Defined cases: a null text counts as empty; a null id is smaller than any id; of rows that repeat
id and text exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.heavy import frequent
from pagewright.llm.membership import split
from pagewright.llm.shared import fresh, stored, text_of

TOP = 256
MIN_SHARE = 1 / 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII texts ``lower`` does just that, and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest_of(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def row_key(id_col: str, text: Column) -> Column:
    """64 bits of a row's id and text, to find rows that may be wanted."""
    return F.xxhash64(F.col(id_col), text)


def groups_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, min_share: float = MIN_SHARE) -> DataFrame:
    """A row for each input row: id, rid, row_key, digest, group_size, keep_id, kept."""
    text = text_of(text_col)
    base = stored(
        df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), digest_of(text).alias("digest"), F.octet_length(text).alias("len"), row_key(id_col, text).alias("row_key")),
        "digests",
    )
    total = base.count()
    short = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    named = F.broadcast(frequent(base.select(short.alias("short")), "short", top=top).select("short"))
    winner = F.max(F.struct("id", "rid")).alias("win")
    heavy = stored(
        base.withColumn("short", short)
        .join(named, "short", "left_semi")
        .groupBy("digest", "len")
        .agg(F.count(F.lit(1)).alias("group_size"), winner)
        .where(F.col("group_size") >= max(2, int(total * min_share)))
        .orderBy(F.desc("group_size"))
        .limit(top),
        "winners",
    )
    winners = F.broadcast(heavy)
    key = ["digest", "len"]
    large = base.join(winners, key)
    rest = base.join(winners.select(*key), key, "left_anti")
    small = rest.join(rest.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), winner), key)
    both = large.unionByName(small)
    return both.select(
        "id", "rid", "row_key", "digest", "group_size",
        F.col("win.id").alias("keep_id"),
        (F.col("rid") == F.col("win.rid")).alias("kept"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    return groups_of(df, id_col, text_col, **options).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's columns, one row of each group of equal texts (the one with the largest id).

    Rows whose key is surely none of a dropped row stay where they are and never shuffle. The others
    meet the dropped rows' ids and digests. Rows that repeat both id and text, if there are any, are
    reduced to one."""
    text = text_of(text_col)
    groups = groups_of(df, id_col, text_col, **options).groupBy("id", "digest", "row_key").agg(F.count_if(F.col("kept")).alias("stay"), F.count(F.lit(1)).alias("n"))
    dropped = stored(groups.where(F.col("stay") < F.col("n")), "dropped")
    maybe, clean = split(df, row_key(id_col, text), dropped.select("row_key"))
    digest, gone_id, gone_digest = fresh(df, "digest", "gone_id", "gone_digest")
    keyed = maybe.withColumn(digest, digest_of(text))
    gone = dropped.select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest), "stay")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest))
    out = clean.unionByName(keyed.join(gone.hint("shuffle_hash"), same, "left_anti").drop(digest))
    again = gone.where("stay > 0").drop("stay")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates([id_col, digest]).drop(digest))
    return out
