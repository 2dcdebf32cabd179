"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blank(c) -> Column:
    """Space, tab, CR and LF at both ends."""
    return F.btrim(col(c), F.lit(BLANK))


def is_blank(c) -> Column:
    return F.length(trim_blank(c)) == 0


def replace_all(c, *pairs: tuple[str, str]) -> Column:
    c = col(c)
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_html(c) -> Column:
    """``&``, ``<`` and ``>``; quotes stay."""
    return replace_all(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_xml(c) -> Column:
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))


def twips_to_px(c) -> Column:
    """96 pixels and 1440 twips an inch."""
    return F.bround(col(c) * 96 / 1440).cast("int")


def twips_to_emu(c) -> Column:
    return col(c).cast("long") * 635


def emu_to_twips(c) -> Column:
    return F.bround(col(c) / 635).cast("int")


def strip_extension(c) -> Column:
    """Without the last extension of letters and digits."""
    return F.regexp_replace(col(c), r"([^.]+)\.[A-Za-z0-9]+$", "$1")


def split_list(c) -> Column:
    """``a; b`` as an array; null or blank as an empty one."""
    c = col(c)
    parts = F.transform(F.split(c, ";"), trim_blank)
    # a separator at the end opens no further item
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(c.isNull() | is_blank(c), F.array().cast("array<string>")).otherwise(parts)


def join_list(c, none: str = "") -> Column:
    c = col(c)
    return F.when(c.isNull() | (F.size(c) == 0), F.lit(none)).otherwise(F.array_join(c, "; "))


def int_json(c) -> Column:
    """A list of integers as JSON; null as an empty list."""
    return F.to_json(F.coalesce(col(c), F.array().cast("array<int>")))


def tokens(c) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def numeric_key(c) -> Column:
    """The all-digit tokens joined by points; leading zeros stay."""
    return F.array_join(F.filter(tokens(c), lambda t: t.rlike("^[0-9]+$")), ".")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def edit_similarity(a, b) -> Column:
    """1 - Levenshtein distance / longer length, in lower case; 0 if both are empty."""
    a, b = F.lower(col(a)), F.lower(col(b))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def match_score(a, b) -> Column:
    """Likeness of two names in [0, 1]; an equal numeric key outweighs all else."""
    overlap = jaccard(tokens(a), tokens(b))
    key = numeric_key(a)
    return F.when((key != "") & (key == numeric_key(b)), F.least(F.lit(1.0), 0.9 + 0.1 * overlap)).otherwise(
        0.6 * overlap + 0.4 * edit_similarity(a, b)
    )


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the same names."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION escape_html(s STRING) RETURNS STRING "
        "RETURN replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION escape_xml(s STRING) RETURNS STRING RETURN replace(escape_html(s), '\"', '&quot;')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twips_to_px(t INT) RETURNS INT RETURN cast(bround(t * 96 / 1440) AS INT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION name_tokens(s STRING) RETURNS ARRAY<STRING> "
        "RETURN filter(split(lower(coalesce(s, '')), '[^a-z0-9]+'), t -> t <> '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION numeric_key(s STRING) RETURNS STRING "
        "RETURN array_join(filter(name_tokens(s), t -> t rlike '^[0-9]+$'), '.')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION edit_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN length(a) + length(b) = 0 THEN 0D "
        "ELSE 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_overlap(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN size(array_union(name_tokens(a), name_tokens(b))) = 0 THEN 0D "
        "ELSE size(array_intersect(name_tokens(a), name_tokens(b))) / size(array_union(name_tokens(a), name_tokens(b))) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION match_score(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN numeric_key(a) <> '' AND numeric_key(a) = numeric_key(b) THEN least(1D, 0.9D + 0.1D * token_overlap(a, b)) "
        "ELSE 0.6D * token_overlap(a, b) + 0.4D * edit_similarity(a, b) END"
    )
