"""Quality rules [native]: a threshold table compiled into one Spark projection.

``statistics`` gives the measures of a text as columns; ``compiled`` turns the table ``RULES``
into one boolean over them. No user function, shuffle or join takes part; a lambda variable
(``let``) holds each intermediate array, so that nothing is evaluated twice.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words: positions covered by a 5-word window that is
found twice or more in the text. Windows are first compared by 64-bit hashes, where distinct
hashes prove that no window repeats; otherwise the windows themselves are sorted and compared.

Defined cases: a null or blank text has no words and fails the base rules; an empty table gives
an empty result; rows repeat as they are; other columns pass through ``keep_quality`` untouched.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import fresh, let, text_of

SPACE = r"[ \t-\r]+"
WINDOW = 5
#: Frequent function words of the corpus's four languages.
STOP_WORDS = (
    "the be to of and that have with for is was in on are at by this from or as it an a "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "de la le les des et un une est que qui dans pour par sur avec pas du au en "
    "el los las del y por con no para se al su lo una"
).split()
#: name, measure, per what, comparison, threshold in hundredths, least words for it to apply.
RULES = (
    ("mean_word_length_low", "word_chars", "n_words", "<", 200, 10),
    ("mean_word_length_high", "word_chars", "n_words", ">", 1200, 10),
    ("symbols", "n_symbols", "n_words", ">", 20, 10),
    ("stop_words", "n_stop_words", "n_words", "<", 5, 50),
    ("duplicate_lines", "n_dup_lines", "n_lines", ">", 50, 10),
)
COMPARE = {"<": operator.lt, ">": operator.gt}


def _repeat_words(words: Column) -> Column:
    n_windows = F.size(words) - (WINDOW - 1)
    starts = F.sequence(F.lit(0), n_windows - 1)

    def at(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(WINDOW)]

    def covered(sorted_windows: Column) -> Column:
        twin = F.filter(
            sorted_windows,
            lambda x, k: F.coalesce(F.get(sorted_windows, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["w"] == x["w"], F.lit(False)),
        )
        places = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
            ),
        )

    texts = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.alias("i")))
    slow = let(F.sort_array(texts), covered)
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    checked = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow))
    return F.when(n_windows < 2, F.lit(0)).otherwise(checked)


def statistics(text: Column) -> Column:
    """A struct of the measures of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    n_symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    from_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    from_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    return F.struct(from_words.alias("w"), from_lines.alias("l"), n_symbols.cast("long").alias("n_symbols"))


def compiled(value, rules=RULES) -> Column:
    """True where no rule of the table fails. ``value``: measure name -> column."""
    fails = [
        (value("n_words") >= least) & COMPARE[sign](value(measure) * 100, value(per) * threshold) for _, measure, per, sign, threshold, least in rules
    ]
    return ~functools.reduce(operator.or_, fails, F.lit(False))


def base_failed(value) -> Column:
    return (value("n_words") < 10) | (value("n_repeat_words") * 100 > value("n_words") * 20)


def _field(s: Column):
    place = {"n_symbols": s["n_symbols"], "n_lines": s["l"]["n_lines"], "n_dup_lines": s["l"]["n_dup_lines"]}
    return lambda name: place.get(name, s["w"][name])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, the measures, base_failed and kept."""
    measured = df.select(F.col(id_col).alias(id_col), statistics(text_of(text_col)).alias("s"))
    v = _field(F.col("s"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select(
        id_col,
        *(v(n).alias(n) for n in names),
        base_failed(v).alias("base_failed"),
        (~base_failed(v) & compiled(v, rules)).alias("kept"),
        v("n_lines").alias("n_lines"),
        v("n_stop_words").alias("n_stop_words"),
    )


def keep_quality(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The input's rows and columns without those that the rules reject."""
    quality = fresh(df, "quality")[0]
    measured = df.withColumn(quality, statistics(text_of(text_col)))
    v = _field(F.col(quality))
    return measured.where(~base_failed(v) & compiled(v, rules)).drop(quality)
