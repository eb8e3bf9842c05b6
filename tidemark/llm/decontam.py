"""Benchmark decontamination by winnowing.

Documents and items are cut into ``k``-word grams; of every ``w`` consecutive grams the least hash is
kept as a fingerprint. With ``k + w - 1`` = ``span``, whatever document and item share over ``span`` words
leaves a common fingerprint, so joining fingerprints finds every document that may hold an item's
window. The hits are then extended over the found documents' whole texts and confirmed word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_grams, lower_ascii, sliding, small_side, word_hashes

#: ASCII letters (lower case), digits and all characters beyond ASCII make words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Winnowing:
    span: int = 13
    k: int = 6
    #: A document is contaminated if hit words are at least 1 in so many.
    share: int = 20
    #: Fingerprints and windows of the items are broadcast up to so many rows, else joined by a shuffle.
    broadcast_rows: int = 300_000

    @property
    def w(self) -> int:
        return self.span - self.k + 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def winnow(d: DataFrame, p: Winnowing) -> DataFrame:
    """Adds ``hashes`` of ``words`` and ``marks``: the least gram hash of every ``w`` consecutive grams, each value once."""
    d = hash_grams(d.withColumn("hashes", word_hashes(F.col("words"))), "hashes", p.k, "grams")
    d = sliding(d, "grams", p.w, "least", lambda x, y: F.least(x, y))
    return d.withColumn("marks", F.array_distinct("least")).drop("grams", "least")


def item_windows(benchmark: DataFrame, p: Winnowing, id_col: str, text_col: str) -> DataFrame:
    """Each different window of the items once: ``window`` (words, joined), ``len``, ``items``."""
    d = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).withColumn("len", F.least(F.size("words"), F.lit(p.span))).filter("len > 0")
    d = d.select("item", "len", F.explode_outer(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"), "words")
    return d.select("item", "len", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("window")).groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, p: Winnowing = Winnowing(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``text_hash``, ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``contaminated``.

    A window is ``span`` consecutive words of an item, or all words of a shorter item; a word of a document
    is hit if it lies in any occurrence of a window. Null and empty texts have no words; items without
    words have no window; a null item id counts as "". Repeated rows of ``docs`` get the same result each.
    Empty tables give no rows, or no hits. Other columns are ignored.

    Scale: documents without a common fingerprint leave the plan in the scan stage; words are shuffled
    for the found documents only. Items that are too many to broadcast are joined by fingerprint, with ids
    instead of words, and the found documents joined back.
    """
    key = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    base = docs.select(*key, words(F.col(text_col)).alias("words"))

    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias(item_col), F.col(item_text_col).alias(item_text_col))
    windows, _ = small_side(item_windows(bench, p, item_col, item_text_col), p.broadcast_rows)
    short = sorted(r["len"] for r in windows.select("len").filter(F.col("len") < p.span).distinct().collect())

    def prints(d: DataFrame) -> DataFrame:
        """Adds fingerprints: winnowed for windows of full length, all grams of the lengths that short items have."""
        d = winnow(d, p)
        for n in short:
            d = hash_grams(d, "hashes", n, f"of_{n}")
        return d.withColumn("prints", F.concat("marks", *(F.array_distinct(f"of_{n}") for n in short))).drop("hashes", "marks", *(f"of_{n}" for n in short))

    item_words = bench.select(words(F.col(item_text_col)).alias("words"))
    # explode_outer, here and below: for a plain explode Spark would first filter by the array's size, and make the array twice.
    found_prints = winnow(item_words.filter(F.size("words") >= p.span), p).select(F.explode_outer("marks").alias("print"))
    for n in short:
        brief = item_words.filter(F.size("words") == n).withColumn("hashes", word_hashes(F.col("words")))
        found_prints = found_prints.union(hash_grams(brief, "hashes", n, "whole").select(F.get("whole", F.lit(0)).alias("print")))
    marks, fits = small_side(found_prints.distinct(), p.broadcast_rows)
    with_prints = prints(base)
    if fits:
        found = with_prints.select("id", "text_hash", "words", F.explode_outer("prints").alias("print")).join(marks, "print", "left_semi")
        found = found.groupBy("id", "text_hash").agg(F.first("words").alias("words"))
    else:
        ids = with_prints.select("id", "text_hash", F.explode_outer("prints").alias("print")).join(marks, "print", "left_semi").select("id", "text_hash").distinct()
        found = base.join(ids.withColumnsRenamed({"id": "id_", "text_hash": "hash_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left_semi").dropDuplicates(["id", "text_hash"])

    # Every window of a found document, joined by its words.
    lengths = F.array(*(F.lit(n) for n in [*short, p.span]))
    at = found.select("id", "text_hash", "words", F.explode(lengths).alias("len")).filter(F.size("words") >= F.col("len"))
    at = at.select("id", "text_hash", "words", "len", F.explode_outer(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    at = at.select("id", "text_hash", "len", "at", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("window"))
    hits = at.join(windows, ["window", "len"]).groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    # Words under the union of the spans, which are sorted by start.
    def cover(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.aggregate("spans", zero, cover)["n"].alias("n"), F.sort_array("items").alias("found"))
    counts = docs.select(*key, F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    d = counts.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return d.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (p.share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
