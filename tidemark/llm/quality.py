"""Quality rules: base counts of a text, and divergence from its language's reference histograms.

The references are built from all documents of a language: how often each of its most common words
occurs, and how its characters (white space aside) fall into classes. A document's own histograms are held
against them by the Jensen-Shannon distance (base 2, so 0 to 1). Texts below a minimum length, and
languages with too few words for a reference, are judged by the base rules alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import hash_grams, packed, small_side, word_hashes, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Character classes, each taken from what the former ones leave; what is left over is the last class.
CLASSES = (r"\p{Ll}+", r"\p{L}+", r"\p{Nd}+", r"""[.,;:!?'"()\-]+""", SYMBOLS + "+")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: The divergence test needs so many words in the document and in its language's reference.
    min_words_js: int = 50
    min_reference_words: int = 1000
    common_words: int = 32
    max_char_js: float = 0.30
    max_word_js: float = 0.42
    #: Languages up to which the references are broadcast; beyond, they are joined by a shuffle.
    broadcast_languages: int = 2000


def class_counts(text: Column) -> Column:
    """Array of the numbers of characters of each class, without white space."""
    rest, counts = text, []
    for pattern in CLASSES:
        shorter = F.regexp_replace(rest, pattern, "")
        counts.append(F.length(rest) - F.length(shorter))
        rest = shorter
    return F.array(*counts, F.length(rest)).cast("array<bigint>")


def references(docs: DataFrame, rules: QualityRules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language: ``words`` (most common first), ``word_p`` (with the rest last), ``char_p``, ``n``.

    Words are counted before the shuffle in each task, so a language with most of the rows costs each
    task its distinct words only; the ranking keeps the top words of each task before it shuffles.
    """
    language = F.coalesce(F.col(lang_col), F.lit(""))
    vocabulary = docs.select(language.alias("ref_lang"), F.explode_outer(words_of(F.col(text_col))).alias("word")).filter("word IS NOT NULL").groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    sums = [F.sum(F.get(F.col("classes"), F.lit(i)) * F.col("n")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    totals = vocabulary.withColumn("classes", class_counts(F.col("word"))).groupBy("ref_lang").agg(F.sum("n").alias("n_all"), *sums)
    rank = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word"))
    top = vocabulary.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words).groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    share = F.transform("top", lambda t: t["n"] / F.col("n_all"))
    classes = F.array(*(F.col(f"c{i}") for i in range(len(CLASSES) + 1)))
    chars = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    return totals.join(top, "ref_lang").select(
        "ref_lang",
        F.transform("top", lambda t: t["word"]).alias("ref_words"),
        F.concat(share, F.array(F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda a, x: a + x))).alias("ref_word_p"),
        F.transform(classes, lambda c: c / chars).alias("ref_char_p"),
        F.col("n_all").alias("ref_n"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2))


def _base(docs: DataFrame, text_col: str, rules: QualityRules) -> DataFrame:
    """Adds words and base counts; each step is a projection, so an array is made once per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumns({"q_words": words_of(F.col(text_col)), "q_lines": lines, "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")})
    d = d.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "q_solid": F.array_join("q_words", ""),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_hashes": word_hashes(F.col("q_words")),
        }
    )
    d = hash_grams(d, "q_hashes", 8, "q_grams").drop("q_hashes")
    # Only texts with a repeated window sort their windows.
    placed = F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumns({"word_chars": F.length("q_solid").cast("long"), "q_sorted": F.when(F.size(F.array_distinct("q_grams")) < F.size("q_grams"), placed).otherwise(none)})
    same = F.zip_with("q_sorted", F.slice("q_sorted", 2, F.greatest(F.size("q_sorted"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    d = d.withColumn("q_same", same)
    either = F.zip_with(
        F.zip_with("q_sorted", "q_same", lambda a, s: F.struct(a["i"].alias("i"), s.alias("s"))),
        F.concat(F.array(F.lit(False)), F.col("q_same")),
        lambda a, before: F.when(a["s"] | before, a["i"]),
    )
    d = d.withColumn("q_at", F.sort_array(F.filter(either, lambda i: i.isNotNull())))
    steps = F.zip_with("q_at", F.slice("q_at", 2, F.greatest(F.size("q_at"), F.lit(1))), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda acc, x: acc + x).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row of ``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_js, word_js, kept`` added.

    A null or empty text has no words and fails the base rules. A null language is a language of its own.
    Ties among common words go to the smaller word. Repeated rows are judged alike. Columns of ``docs``
    that bear one of the added names are replaced. An empty table gives an empty result.

    Scale: one pass counts words (pre-aggregated, one shuffle of distinct words); the judging pass is
    narrow, with the references broadcast when there are at most ``broadcast_languages`` of them.
    """
    refs, _ = small_side(references(docs, rules, text_col, lang_col), rules.broadcast_languages)
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    made = [*own, "char_js", "word_js", "kept"]
    d = _base(packed(docs, made, q_text=F.col(text_col), q_lang=F.coalesce(F.col(lang_col), F.lit(""))), "q_text", rules)
    d = d.join(refs, F.col("q_lang") == F.col("ref_lang"), "left")

    judged = ~F.col("base_failed") & (F.col("n_words") >= rules.min_words_js) & (F.coalesce("ref_n", F.lit(0)) >= rules.min_reference_words)
    # Places of the words among the language's common ones, then how often each place occurs.
    places = F.filter(F.transform("q_words", lambda w: F.array_position("ref_words", w)), lambda i: i > 0)
    d = d.withColumns({"q_judged": judged, "q_places": F.when(judged, places), "q_classes": F.when(judged, class_counts(F.col("q_solid")))})
    counts = F.transform(F.sequence(F.lit(1), F.size("ref_words")), lambda i: F.size(F.filter("q_places", lambda x: x == i)))
    d = d.withColumn("q_counts", F.when(F.col("q_judged"), counts))
    common = F.transform("q_counts", lambda c: c / F.col("n_words"))
    d = d.withColumns({"q_common": common, "q_class_p": F.transform("q_classes", lambda c: c / F.col("word_chars"))})
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate("q_common", F.lit(0.0), lambda a, x: a + x))
    d = d.withColumns({"word_js": F.when(F.col("q_judged"), js_distance(F.concat("q_common", F.array(rest)), F.col("ref_word_p"))), "char_js": F.when(F.col("q_judged"), js_distance(F.col("q_class_p"), F.col("ref_char_p")))})
    far = F.coalesce((F.col("char_js") > rules.max_char_js) | (F.col("word_js") > rules.max_word_js), F.lit(False))
    d = d.withColumn("kept", ~F.col("base_failed") & ~far)
    return d.select("row_.*", *made)
