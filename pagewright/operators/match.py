"""Fuzzy pairing of bookmark names and table names, and filling of a mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import jaccard, numeric_key, tokens, trim_blank

#: The candidate side is broadcast up to this many names, else partitioned.
BROADCAST_NAMES = 100_000


def _prepared(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """The name with its key, tokens and lower case, computed once a name and not once a pair."""
    return df.select(
        F.col(name).alias(prefix), F.lower(name).alias(f"{prefix}_low"), tokens(name).alias(f"{prefix}_tok"), numeric_key(name).alias(f"{prefix}_key")
    )


def _score(a: str, b: str) -> Column:
    overlap = jaccard(F.col(f"{a}_tok"), F.col(f"{b}_tok"))
    longer = F.greatest(F.length(f"{a}_low"), F.length(f"{b}_low"))
    edit = F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(f"{a}_low", f"{b}_low") / longer)
    same = (F.col(f"{a}_key") != "") & (F.col(f"{a}_key") == F.col(f"{b}_key"))
    return F.when(same, F.least(F.lit(1.0), 0.9 + 0.1 * overlap)).otherwise(0.6 * overlap + 0.4 * edit)


def scores(names: DataFrame, name: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """(name, candidate, score, shares_key) of each distinct name with each non-empty candidate.

    Edit distance alone can win, so no pair may be left out; names x candidates is the operator's
    own size. Both sides are names of one project's documents, not rows of its data."""
    left = _prepared(names.where(F.col(name).isNotNull()).select(name).distinct(), name, "a")
    right = _prepared(candidates.where(F.col(candidate) != "").select(candidate).distinct(), candidate, "b")
    small = right.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    pairs = left.crossJoin(F.broadcast(right) if small else right)
    shares = (F.col("a_key") != "") & (F.col("a_key") == F.col("b_key"))
    return pairs.select(F.col("a").alias("name"), F.col("b").alias("candidate"), _score("a", "b").alias("score"), shares.alias("shares_key"))


def best_match(names: DataFrame, name: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """(name, match, score): the highest score; ties go to a shared numeric key, then to the first
    name in binary order. Without candidates: a null match and score 0."""
    rank = F.struct((-F.col("score")).alias("s"), (~F.col("shares_key")).alias("k"), F.col("candidate").alias("c"))
    best = scores(names, name, candidates, candidate).groupBy("name").agg(F.min_by(F.struct("candidate", "score"), rank).alias("best"))
    every = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return every.join(best, "name", "left").select("name", F.col("best.candidate").alias("match"), F.coalesce("best.score", F.lit(0.0)).alias("score"))


def fill_suggestions(config: DataFrame, bookmarks: DataFrame, tables: DataFrame, floor: float = 0.0) -> DataFrame:
    """Fills the blank one of (bookmark, table) from the other's best match scoring ``floor`` or
    more; never overwrites. Adds ``filled``. ``bookmarks``: name; ``tables``: table_name."""
    b, t = trim_blank("bookmark"), trim_blank("table")
    rows = config.withColumns({"__b": b, "__t": t})
    no_table, no_bookmark = (F.col("__b") != "") & (F.col("__t") == ""), (F.col("__t") != "") & (F.col("__b") == "")
    for_table = best_match(rows.where(no_table), "__b", tables, "table_name").select(F.col("name").alias("__b"), F.col("match").alias("__mt"), F.col("score").alias("__st"))
    for_bookmark = best_match(rows.where(no_bookmark), "__t", bookmarks, "name").select(F.col("name").alias("__t"), F.col("match").alias("__mb"), F.col("score").alias("__sb"))
    joined = rows.join(for_table, "__b", "left").join(for_bookmark, "__t", "left")
    take_t = F.coalesce(no_table & F.col("__mt").isNotNull() & (F.col("__st") >= floor), F.lit(False))
    take_b = F.coalesce(no_bookmark & F.col("__mb").isNotNull() & (F.col("__sb") >= floor), F.lit(False))
    return joined.select(
        "row_id",
        F.when(take_b, F.col("__mb")).otherwise(F.col("bookmark")).alias("bookmark"),
        F.when(take_t, F.col("__mt")).otherwise(F.col("table")).alias("table"),
        (take_t | take_b).alias("filled"),
    )


def filled_message(filled: DataFrame) -> DataFrame:
    n = F.count_if("filled")
    text = F.when(n > 0, F.format_string("Auto-match filled %d cell%s", n, F.when(n == 1, "").otherwise("s"))).otherwise("No confident matches to fill")
    return filled.agg(n.alias("n_filled"), text.alias("message"))


def missing_bookmarks(bookmarks: DataFrame, config: DataFrame) -> DataFrame:
    """(ord, name): bookmarks that no mapping row names, each once, in document order."""
    used = config.select(trim_blank("bookmark").alias("name")).where(F.col("name") != "").distinct()
    return bookmarks.groupBy("name").agg(F.min("ord").alias("ord")).join(used, "name", "left_anti").select("ord", "name")


def add_missing_bookmarks(config: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Missing bookmarks go to rows with a blank bookmark first, in order; the others are appended."""
    place = Window.orderBy("ord")
    missing = missing_bookmarks(bookmarks, config).select(F.row_number().over(place).alias("k"), "name")
    blank = config.where(trim_blank("bookmark") == "").select("row_id", F.row_number().over(Window.orderBy("row_id")).alias("k"))
    reused = blank.join(missing, "k").select("row_id", "name")
    kept = config.join(reused, "row_id", "left").select("row_id", F.coalesce("name", "bookmark").alias("bookmark"), "table")
    sizes = config.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("last"), F.count_if(trim_blank("bookmark") == "").alias("n_blank"))
    extra = missing.crossJoin(F.broadcast(sizes)).where(F.col("k") > F.col("n_blank"))
    return kept.unionByName(extra.select((F.col("last") + F.col("k") - F.col("n_blank")).cast("int").alias("row_id"), F.col("name").alias("bookmark"), F.lit("").alias("table")))
