"""Line dedup: repeated runs of lines, by distributed prefix doubling over sequences of line ids.

1. A document is a sequence of line ids. Documents with equal sequences are one class, of which the first alone goes
   on; the others repeat it from end to end.
2. Prefix doubling. A suffix of the leaders' sequences is a (document, place). Suffixes that begin with the same
   2^k lines form an interval with that common prefix, named by 128 bits. The names of 2^(k+1) lines come from the
   names at a place and 2^k lines further; suffixes alone in their interval leave. The rounds end when none is left.
3. An interval knows its first suffix; a suffix after it repeats it. What lies under intervals of ``min_lines`` lines, or of fewer with
   over ``long_words`` words, is deleted, except at its first place.
4. How long a document's longest repeated run is: from its deepest interval, the levels are gone down again; at each, suffixes of
   an interval that go on alike for so many lines more form intervals within it, and a document follows where it still
   repeats an earlier suffix.

Suffixes aren't sorted across intervals: names stand for ranks, and deletion needs intervals and their first suffixes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import dealt, discard, name128, packed, part_of, parts_met, removing_shuffles, written

_WORDS = r"[^\x20\x09-\x0D]+"
_PLACE = ["id", "th", "at"]


def solid_lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _same_text(x: str, y: str) -> Column:
    return F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.th") == F.col(f"{y}.th"))


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, names, sizes, first): line ids and numbers of words of each text, and the first text of its class if it has copies."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), solid_lines(F.col(text_col)).alias("lines"))
    d = d.select("id", "th", F.transform("lines", lambda x: name128(x)).alias("names"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(_WORDS))).alias("sizes"))
    d = written(d.filter(F.size("names") > 0).select("*", name128(F.col("names")).alias("whole"), part_of("id", "th").alias("part")))
    classes = d.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("first"), parts_met("part")).filter("n > 1").drop("n")
    return written(d.join(dealt(classes), ["whole", "part"], "left").drop("whole", "part"))


def _intervals(suffixes: DataFrame) -> DataFrame:
    """The suffixes (id, th, at, a, b, ...) whose name another place has too, with the ``first`` of each interval.

    A name that fills a third of the corpus costs one row per task in the count, and is dealt to parts in the join.
    """
    s = suffixes.withColumn("part", part_of(*_PLACE))
    groups = s.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first"), parts_met("part")).filter("n > 1").drop("n")
    return written(s.join(dealt(groups), ["a", "b", "part"]).drop("part"))


def _joined(level: DataFrame, step: int) -> DataFrame:
    """Suffixes named by their own prefix and that of the suffix ``step`` lines further, where that is in an interval too."""
    ahead = Window.partitionBy("id", "th").orderBy("at").rangeBetween(step, step)
    d = level.select(*_PLACE, "a", "b", "from_word", F.first(F.struct("a", "b", "to_word")).over(ahead).alias("next")).filter("next IS NOT NULL")
    name = name128(F.col("a"), F.col("b"), F.col("next.a"), F.col("next.b"))
    return d.select(*_PLACE, "from_word", F.col("next.to_word").alias("to_word"), name.alias("name")).select(*_PLACE, "name.a", "name.b", "from_word", "to_word")


def prefix_doubling(seqs: DataFrame) -> list[DataFrame]:
    """Intervals of 1, 2, 4, ... lines as (id, th, at, a, b, from_word, to_word, first), up to the last that repeats."""
    leaders = seqs.filter(F.col("first").isNull() | F.col("first").eqNullSafe(F.struct("id", "th"))).groupBy("id", "th").agg(F.first("names").alias("names"), F.first("sizes").alias("sizes"))
    lines = leaders.select("id", "th", F.posexplode(F.arrays_zip("names", "sizes")).alias("at", "line"))
    words = F.sum("line.sizes").over(Window.partitionBy("id", "th").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.select(*_PLACE, "line.names.a", "line.names.b", (words - F.col("line.sizes")).alias("from_word"), words.alias("to_word"))
    levels = [_intervals(lines)]
    while not levels[-1].isEmpty():
        levels.append(_intervals(_joined(levels[-1], 1 << (len(levels) - 1))))
    return levels


def _of_length(levels: list[DataFrame], n: int) -> DataFrame:
    """Intervals of exactly ``n`` lines, from those of the greatest power of two within."""
    k = min(n.bit_length(), len(levels)) - 1
    return levels[k] if n == 1 << k else _intervals(_joined(levels[k], n - (1 << k)))


def _later(level: DataFrame) -> DataFrame:
    return level.filter(F.struct(*_PLACE) > F.col("first"))


def longest_runs(levels: list[DataFrame]) -> DataFrame:
    """(id, th, longest): the lines of each text's longest run that an earlier place has too.

    Those that ask are the places in a text's deepest interval; they and the others of their intervals are the rows of each
    step. Intervals within an interval get names of their own, and a text whose places part goes on with the longer ones.
    """
    text = ["id", "th"]
    deep = None
    for k, d in enumerate(levels):
        found = _later(d).select(*text, F.lit(k).alias("k"))
        deep = found if deep is None else deep.unionByName(found)
    deep = written(deep.groupBy(*text).agg(F.max("k").alias("k")))
    made: list[DataFrame] = []
    state = None

    def with_any(rows: DataFrame, flag: str, by: list[str]) -> DataFrame:
        """The rows of groups in which a row is flagged; rows of a large group are dealt to parts."""
        d = rows.withColumn("part", part_of(*_PLACE))
        groups = d.groupBy(*by).agg(F.max(flag).alias("any"), parts_met("part")).filter("any").drop("any")
        return d.join(dealt(groups), [*by, "part"]).drop("part")

    done = deep.filter("k = 0").select(*text, F.lit(1).alias("longest"))
    for j in range(len(levels) - 2, -1, -1):
        x, y = levels[j + 1].alias("x"), deep.filter(F.col("k") == j + 1).alias("y")
        own = x.join(y, _same_text("x", "y"), "left").select("x.*", F.col("y.k").alias("k"))
        own = own.select("a", "b", *_PLACE, F.lit(1 << (j + 1)).alias("length"), (F.col("k").isNotNull() & (F.struct(*_PLACE) > F.col("first"))).alias("asks"))
        own = with_any(own, "asks", ["a", "b"])
        rows = own if state is None else state.unionByName(own.select(*state.columns))
        r, n = rows.alias("r"), levels[j].select(*_PLACE, "a", "b").alias("n")
        ahead = F.col("r.id").eqNullSafe(F.col("n.id")) & (F.col("r.th") == F.col("n.th")) & (F.col("r.at") + F.col("r.length") == F.col("n.at"))
        name = F.when(F.col("n.a").isNotNull(), name128(F.col("r.a"), F.col("r.b"), F.col("n.a"), F.col("n.b")))
        named = written(r.join(n, ahead, "left").select("r.*", name.alias("next")).withColumn("part", part_of(*_PLACE)))
        inner = named.filter("next IS NOT NULL").groupBy("next").agg(F.min(F.struct(*_PLACE)).alias("first"), parts_met("part"))
        rows = named.join(dealt(inner), ["next", "part"], "left").withColumn("moves", F.coalesce(F.col("asks") & (F.struct(*_PLACE) > F.col("first")), F.lit(False))).drop("first", "part")
        gone = rows.filter("moves").select(*text).distinct().withColumn("gone", F.lit(True)).alias("g")
        r = rows.alias("r")
        rows = written(r.join(gone, _same_text("r", "g"), "left").select("r.*", (F.col("r.asks") & F.col("g.gone").isNull()).alias("stays")))
        columns = ["a", "b", *_PLACE, "length", "asks"]
        longer = with_any(rows.filter("next IS NOT NULL"), "moves", ["next"]).select("next.a", "next.b", *_PLACE, (F.col("length") + (1 << j)).alias("length"), F.col("moves").alias("asks"))
        same = with_any(rows, "stays", ["a", "b"]).select("a", "b", *_PLACE, "length", F.col("stays").alias("asks"))
        state = written(longer.unionByName(same).select(*columns))
        discard(*made, named, rows)
        made = [state]
    if state is not None:
        done = done.unionByName(state.filter("asks").select(*text, F.col("length").alias("longest")))
    return done.groupBy(*text).agg(F.max("longest").alias("longest"))


def line_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, long_words: int | None = 50) -> DataFrame:
    """(id, text_hash, runs, longest): per text with repeats, what is deleted as (start, end) of lines with a word (null for nothing), and
    the lines of its longest run that repeats an earlier place, deleted or not."""
    seqs = sequences(docs, id_col, text_col)
    levels = prefix_doubling(seqs)
    found = [_later(_of_length(levels, min_lines)).select(*_PLACE, F.lit(min_lines).alias("length"))]
    for n in range(1, min_lines) if long_words is not None else ():
        found.append(_later(_of_length(levels, n)).filter(F.col("to_word") - F.col("from_word") > long_words).select(*_PLACE, F.lit(n).alias("length")))
    windows = found[0]
    for d in found[1:]:
        windows = windows.unionByName(d)

    # Windows that meet make one run: a window begins one if none before it reaches its start.
    before = Window.partitionBy("id", "th").orderBy("at", "end")
    w = windows.select("id", "th", "at", (F.col("at") + F.col("length")).alias("end"))
    begins = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)) < F.col("at"), F.lit(True))
    w = w.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(before))
    runs = w.groupBy("id", "th", "run").agg(F.struct(F.min("at").alias("start"), F.max("end").alias("end")).alias("r")).groupBy("id", "th").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    longest = longest_runs(levels)
    x, y = runs.alias("x"), longest.alias("y")
    leaders = x.join(y, _same_text("x", "y"), "full_outer").select(F.coalesce("x.id", "y.id").alias("id"), F.coalesce("x.th", "y.th").alias("th"), "x.runs", "y.longest")

    n, words = F.size("names"), F.aggregate("sizes", F.lit(0), lambda a, v: a + v)
    long = n >= min_lines if long_words is None else (n >= min_lines) | (words > long_words)
    copies = seqs.filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("id", "th")))
    copies = copies.select("id", "th", F.when(long, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).alias("runs"), n.alias("longest")).dropDuplicates(["id", "th"])
    return leaders.unionByName(copies).withColumnRenamed("th", "text_hash")


@removing_shuffles
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, long_words: int | None = 50) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its later copies, and ``n_lines``, ``n_removed``, ``n_runs``, ``longest_run`` added.

    A run is consecutive lines with a word, ``min_lines`` or more of them or with over ``long_words`` words together, down
    to a single line; None for ``long_words`` leaves only the count of lines. ``n_runs`` counts what is deleted in one
    piece; ``longest_run`` is the number of lines of the longest run, of any length, that an earlier place has as a whole. Blank
    lines between them don't count and go with the run. Order is by id (nulls first), then text hash, then line.
    Rows that repeat an id and its text count as one document. A null text stays null and has no lines. Columns of
    ``docs`` that bear one of the added names are replaced; an empty table gives an empty result.
    """
    made = ["n_lines", "n_removed", "n_runs", "longest_run"]
    runs = line_runs(docs, id_col, text_col, min_lines, long_words).withColumnsRenamed({"id": "l_id", "text_hash": "l_hash", "runs": "l_runs", "longest": "l_longest"})
    d = packed(docs, made, l_doc=F.col(id_col), l_text=F.col(text_col), l_text_hash=F.xxhash64(text_col))
    d = d.join(runs, F.col("l_doc").eqNullSafe(F.col("l_id")) & (F.col("l_text_hash") == F.col("l_hash")), "left")

    # Runs as places among all lines, for texts that lose some; what stays are the slices between them.
    lines = F.split(F.coalesce(F.col("l_text"), F.lit("")), "\n")
    solid = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    d = d.withColumns({"l_lines": F.when(F.col("l_runs").isNotNull(), lines), "l_at": F.when(F.col("l_runs").isNotNull(), solid)})
    d = d.withColumn("l_gone", F.transform("l_runs", lambda r: F.struct(F.get(F.col("l_at"), r["start"]).alias("start"), F.get(F.col("l_at"), r["end"] - 1).alias("end"))))
    d = d.withColumn("l_edges", F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), F.col("l_gone")))
    upto = lambda j: F.coalesce(F.get(F.col("l_gone"), j)["start"], F.size("l_lines"))
    pieces = F.transform("l_edges", lambda e, j: F.slice("l_lines", e["end"] + 2, upto(j) - e["end"] - 1))
    text = F.when(F.col("l_runs").isNull(), F.col("l_text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    removed = F.coalesce(F.aggregate("l_runs", F.lit(0), lambda acc, r: acc + r["end"] - r["start"]), F.lit(0))
    counts = {"n_lines": F.size(solid_lines(F.col("l_text"))), "n_removed": removed, "n_runs": F.coalesce(F.size("l_runs"), F.lit(0)), "longest_run": F.coalesce("l_longest", F.lit(0))}
    given = [c for c in docs.columns if c not in made]
    return d.select(*(text.alias(c) if c == text_col else F.col(f"row_.`{c}`") for c in given), *(c.cast("long").alias(n) for n, c in counts.items()))
