"""Quality rules: base counts and distribution divergence, in built-in functions only.

Each document gets two histograms: characters by class, and the common words of its
dominant language (the listed language whose common words it has most of). Each is
compared to the reference of that language by Jensen-Shannon distance (base 2, so 0 to
1); a document that is far from its reference in either is rejected. Histograms of too
short documents are guarded: below ``min_chars`` or ``min_words`` they decide nothing.
A text with no listed word at all is compared as all mass on 'other' with its nearest
language, from ``MIN_WORDS_NONE`` words on: by chance that hardly befalls a short text.
``max_word_distance`` lies below what such a text scores (0.34 on the fixtures) and above
the sampling noise of a text of ``min_words`` words.

References are the mean histograms of all documents of the language that pass the base
rules, computed over the whole table; a document without a dominant language is compared
by characters with the mean of all. One pass reads the texts; its narrow features are
staged, reduced to one row a language (a bound of ``len(COMMON_WORDS)`` + 1 rows, the only
thing broadcast) and joined back.

Edge cases: a null or empty text has zero counts and fails the base rule on length; a
text with no listed word has no dominant language, so texts in languages that are not
listed are rejected; a histogram without any reference decides nothing; a symbol-only or very long text needs no special case; ties between languages go to
the first listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Frequent function words of each language, in lower case.
COMMON_WORDS = {
    "en": "the of and to in that is was for it with as on be at by this from or an".split(),
    "de": "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
MIN_WORDS, MIN_CHARS, MIN_WORDS_NONE = 100, 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.26
SPACE = r"[ \t-\r]"


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def listed(ws: list[str]):
    return lambda w: w.isin(ws)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        def equals(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

        same = F.filter(s, lambda x, i: equals(x, i - 1) | equals(x, i + 1))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    covered = let(
        let(F.array_sort(windows), repeated),
        lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
        ),
    )
    return F.when(F.size(words) >= 4, covered).otherwise(0).cast("long")


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, histograms and dominant language of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(id_col), text.alias("_t"))
    df = df.select(
        id_col,
        F.length("_t").alias("_n"),
        F.regexp_replace("_t", r"\p{Ll}+", "").alias("_rest"),
        F.split(F.trim(F.col("_t"), F.lit(" \t\n\x0b\f\r")), SPACE + "+").alias("_split"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"),
    )
    df = df.select(
        id_col, "_n", "_rest", "_lines",
        F.regexp_replace("_rest", SPACE + "+", "").alias("_ink"),
        F.when(F.get("_split", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("_split")).alias("_words"),
    )
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    df = df.select(
        "*",
        F.regexp_replace("_ink", r"\p{Lu}+", "").alias("_marks"),
        F.filter(F.transform("_words", F.lower), lambda w: w.isin(every)).alias("_common"),
    )
    space, upper = F.length("_rest") - F.length("_ink"), F.length("_ink") - F.length("_marks")
    digits = F.length("_marks") - F.length(F.regexp_replace("_marks", "[0-9]+", ""))
    points = F.length("_marks") - F.length(F.regexp_replace("_marks", r"[.,;:!?'\"()-]+", ""))
    hits = [F.size(F.filter("_common", listed(ws))) for ws in COMMON_WORDS.values()]
    df = df.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        (F.col("_n") - space).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_marks", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.col("_n").cast("long").alias("n_chars"),
        F.array(F.col("_n") - F.length("_rest"), upper, digits, space, points, F.length("_marks") - digits - points).cast("array<double>").alias("char_counts"),
        F.array(*hits).alias("_hits"),
        "_common",
    )
    best = F.array_position("_hits", F.array_max("_hits")).cast("int") - 1
    langs = F.array(*map(F.lit, COMMON_WORDS))
    lists = F.array(*[F.array(*map(F.lit, ws)) for ws in COMMON_WORDS.values()])
    df = df.withColumn("_lang", F.when(F.array_max("_hits") > 0, best))
    counted = F.transform(F.get(lists, F.col("_lang")), lambda c: F.size(F.filter("_common", lambda w: w == c)).cast("double"))
    return df.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "char_counts",
        F.get(langs, F.col("_lang")).alias("main_lang"), counted.alias("word_counts"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two aligned histograms that each sum to 1."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))  # greatest() would take null for 0


def distribution_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Base counts, distances to the language reference and the verdict of every row."""
    f = features(df, id_col, text_col)
    other = F.col("n_words") - F.aggregate("word_counts", F.lit(0.0), lambda s, x: s + x)
    f = f.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "char_share": F.when(F.col("n_chars") >= min_chars, F.transform("char_counts", lambda x: x / F.col("n_chars"))),
        "word_share": F.when(F.col("n_words") >= min_words, F.transform(F.concat(F.col("word_counts"), F.array(other)), lambda x: x / F.col("n_words"))),
    })
    f = staged(f.drop("char_counts", "word_counts", "n_chars"), "quality-features")
    n_char, n_word = 6, max(map(len, COMMON_WORDS.values())) + 1
    mean = [F.avg(F.get("char_share", F.lit(i))).alias(f"c{i}") for i in range(n_char)] + [F.avg(F.get("word_share", F.lit(i))).alias(f"w{i}") for i in range(n_word)]
    reference = (
        f.where(~F.col("base_failed")).rollup("main_lang").agg(*mean, F.grouping("main_lang").alias("_all"))
        .where("main_lang is not null or _all = 1")
        .select(F.col("main_lang").alias("_ref_lang"), F.array(*[f"c{i}" for i in range(n_char)]).alias("char_ref"), F.array_compact(F.array(*[f"w{i}" for i in range(n_word)])).alias("word_ref"))
    )
    # the lists of two languages don't align: a text of no language is all 'other', at the distance of the nearest language
    has_ref = F.col("_ref_lang").isNotNull() & (F.size("word_ref") > 0)
    reference = reference.withColumn("word_ref", F.when(has_ref, F.col("word_ref")))
    no_listed = F.transform("word_ref", lambda x, i: F.when(i == F.size("word_ref") - 1, 1.0).otherwise(0.0))
    reference = reference.withColumn("_none", F.min(js_distance(no_listed, F.col("word_ref"))).over(Window.partitionBy(F.lit(0))))
    f = f.join(F.broadcast(reference), F.col("main_lang").eqNullSafe(F.col("_ref_lang")), "left")
    f = f.withColumns({"char_distance": js_distance(F.col("char_share"), F.col("char_ref")), "word_distance": F.when(F.col("main_lang").isNotNull(), js_distance(F.col("word_share"), F.col("word_ref"))).when(F.col("n_words") >= min(min_words, MIN_WORDS_NONE), F.col("_none"))})
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return f.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "main_lang", "char_distance", "word_distance",
    )
