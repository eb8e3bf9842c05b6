"""Removal of repeated byte strings, by run-length indexes over the places that may repeat.

1. Anchors. Of all ``gram``-byte grams in every ``length`` bytes the one with the least hash is an anchor, so equal
   strings of ``length`` bytes have equal anchors at equal places. An anchor's context is all that strings of
   ``length`` bytes around it can cover.
2. Anchors with the same gram form a group. Contexts that occur twice are repeated throughout; they are found
   by a pre-aggregated count, and one copy of each goes on.
3. Groups that still hold different contexts are indexed: their contexts are sorted by suffix, and of the
   Burrows-Wheeler transform of each column only the ends of its runs are kept, with the match length across the
   boundary. Matching statistics are streamed from these samples alone: within a run a match is one byte shorter
   than at the place before. Strings with a match of ``length`` bytes are marked.
4. A group too large for one task is first split by the bytes that strings in either half of the context must
   share, again and again; what is alone in its part is done, what is repeated throughout its part is marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import dealt, discard, packed, part_of, parts_met, written

_KEEP = "id {id}, th long"


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 48
    #: Contexts in a group beyond which it is split, and about so many in one task's index.
    max_group: int = 10_000
    bucket: int = 10_000

    @property
    def reach(self) -> int:
        """Bytes before an anchor that a string over it can begin at."""
        return self.length - self.gram


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad) -> np.ndarray:
    """f over x[i:i + w] for each i; beyond the end stands ``pad``."""
    n = len(x)
    blocks = -(-(n + w) // w)
    padded = np.full(blocks * w, pad, x.dtype)
    padded[:n] = x
    square = padded.reshape(blocks, w)
    ahead = f.accumulate(square, axis=1).reshape(-1)
    back = f.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(data: np.ndarray, starts: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """(text number, place in the chunk, hash of the gram, hash of the context) of all anchors of many texts."""
    none = np.zeros(0, np.int64)
    n, w = len(data), p.reach + 1
    if n < p.length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = rolling.sums(data)
    at = np.arange(n - p.gram + 1)
    h = rolling.between(s, at, at + p.gram) | np.uint64(1)
    least = _sliding(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    # Strings that would reach beyond their text don't count.
    ends = np.repeat(starts[1:], np.diff(starts))[: len(at)]
    least[at + p.length > ends] = 0
    most = _sliding(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    # A minimum may come from a string of the text before: then the anchor lies outside of it.
    place = np.flatnonzero((h == most) & (most > 0))
    text = np.searchsorted(starts, place, "right") - 1
    inside = place + p.gram <= starts[text + 1]
    place, text = place[inside], text[inside]
    lo = np.maximum(starts[text], place - p.reach)
    hi = np.minimum(starts[text + 1], place + p.length)
    context = rolling.mix(rolling.between(s, lo, hi) ^ (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, place, h[place], context


def _find_anchors(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in rolling.chunks(batch.column(2)):
                text, place, gram, context = anchors_of(data, starts, p)
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((place - starts[text]).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["id", "th", "pos", "grp", "hull"],
                )

    return run


def _cut_contexts(p: Repeats):
    """Arrow function: (id, th, text, places) to one row per place, with its context and the bytes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).cast(pa.binary())
            places = batch.column(3)
            rows, pos, left, ctx, group = [], [], [], [], []
            for i in range(batch.num_rows):
                text = raw[i].as_py()
                for at in places[i].as_py():
                    lo = max(0, at["pos"] - p.reach)
                    rows.append(i)
                    pos.append(at["pos"])
                    group.append((at["grp"], at["single"], at["size"]))
                    left.append(at["pos"] - lo)
                    ctx.append(text[lo : at["pos"] + p.length])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), *(pa.array([g[k] for g in group], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64()))), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())],
                names=["id", "th", "pos", "grp", "single", "size", "left", "ctx"],
            )

    return run


def _halve(p: Repeats):
    """Arrow function: (id, th, pos, grp, low, high, left, ctx) to a row for each half of the strings [low, high].

    Strings begin ``low`` to ``high`` bytes before the anchor. The new group is named by the bytes that all strings
    of the half cover, the new hull by those that any of them covers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, grp, low, high, left = (batch.column(i).to_numpy() for i in range(2, 7))
            raw = batch.column(7)
            sizes = np.array([len(raw[i].as_py()) for i in range(batch.num_rows)], np.int64)
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            s = rolling.sums(data)
            anchor = np.cumsum(sizes) - sizes + left
            right = sizes - left
            mid = (low + high) // 2
            for a, b in ((low, mid), (mid + 1, high)):
                some = (np.maximum(a, p.length - right) <= np.minimum(b, left)) & (a <= b)
                i = np.flatnonzero(some)
                core = rolling.between(s, anchor[i] - a[i], anchor[i] - b[i] + p.length)
                h0 = np.maximum(anchor[i] - b[i], anchor[i] - left[i])
                h1 = np.minimum(anchor[i] - a[i] + p.length, anchor[i] + right[i])
                hull = rolling.mix(rolling.between(s, h0, h1) ^ (anchor[i] - h0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                new = rolling.mix(core ^ rolling.mix(grp[i].view(np.uint64) + a[i].astype(np.uint64)))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in (0, 1, 2)), pa.array(new.view(np.int64)), pa.array(a[i].astype(np.int32)), pa.array(b[i].astype(np.int32)), pa.array(left[i]), raw.take(at), pa.array(hull.view(np.int64))],
                    names=["id", "th", "pos", "grp", "low", "high", "left", "ctx", "hull"],
                )

    return run


class RunIndex:
    """Run-compressed transform of aligned contexts: matches are kept at the ends of runs alone.

    ``sym`` holds a context per row with its anchor at column ``reach``; 256 stands where there is no byte. Only rows of
    one group, and only the same columns, are held against each other. The columns' suffixes are sorted from the last
    column to the first, with the longest common prefix of neighbours carried along. The transform of a column is the
    sequence of bytes before its sorted suffixes; ``row``, ``col`` and ``match`` hold, for the first and the last place
    of each of its runs, the match across the boundary. Inside a run both neighbours go on to the same byte, so there
    the match is one more than at the next column, and nothing is kept. Memory is that of the contexts and the runs.
    """

    def __init__(self, group: np.ndarray, sym: np.ndarray, p: Repeats):
        m, width = sym.shape
        self.p, self.runs = p, 0
        rank = np.unique(group, return_inverse=True)[1].astype(np.int64) * 512
        order = np.argsort(rank, kind="stable")
        common = np.zeros(m, np.int32)  # of the suffixes at a place and the one above
        first: list[tuple[np.ndarray, ...]] = []
        last: list[tuple[np.ndarray, ...]] = []
        for col in range(width - 1, -1, -1):
            key = (rank + sym[:, col])[order]
            place = np.argsort(key, kind="stable")
            key = key[place]
            same = np.zeros(m, bool)
            same[1:] = (key[1:] == key[:-1]) & (key[1:] & 511 != 256)
            longer = np.zeros(m, np.int32)
            at = np.flatnonzero(same)
            longer[at] = 1 + _range_minima(common, place[at - 1] + 1, place[at])
            order, common = order[place], longer
            if col > p.reach:
                continue
            before = sym[order, col - 1] if col else np.arange(m) + 1000
            head = np.ones(m, bool)
            head[1:] = (rank[order[1:]] != rank[order[:-1]]) | (before[1:] != before[:-1]) | (before[1:] == 256)
            at = np.flatnonzero(head)
            self.runs += len(at)
            first.append((order[at], np.full(len(at), col, np.int32), common[at]))
            last.append((order[np.append(at[1:], m) - 1], np.full(len(at), col, np.int32), np.append(common[at[1:]], np.int32(0))))
        self.samples = [tuple(np.concatenate(x) for x in zip(*part, strict=True)) for part in (first, last)]

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first column, last column) of strings with a match of ``length`` bytes, streamed along each row from sample to sample.

        A match kept at a column shrinks by one a column until the row's next sample.
        """
        out = []
        for row, col, match in self.samples:
            order = np.lexsort((col, row))
            row, col, match = row[order], col[order], match[order]
            end = np.full(len(row), self.p.reach, np.int64)
            end[:-1] = np.where(row[1:] == row[:-1], col[1:] - 1, self.p.reach)
            long = match >= self.p.length
            out.append((row[long], col[long], np.minimum(end, col.astype(np.int64) + match - self.p.length)[long]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _range_minima(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of x[first] ... x[last] of each range, by minima of ranges of 1, 2, 4, ... places."""
    out = np.empty(len(first), x.dtype)
    level = np.frexp(last - first + 1)[1] - 1
    step, width = x, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            step = np.minimum(step[:-width], step[width:])
            width *= 2
        some = level == k
        out[some] = np.minimum(step[first[some]], step[last[some] - width + 1])
    return out


def _index(p: Repeats):
    def run(table: pa.Table) -> pa.Table:
        width = p.reach + p.length
        m = table.num_rows
        left, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("left", "low", "high"))
        sym = np.full((m, width), 256, np.int16)
        for i, ctx in enumerate(table.column("ctx")):
            x = np.frombuffer(ctx.as_py(), np.uint8)
            sym[i, p.reach - left[i] : p.reach - left[i] + len(x)] = x
        row, first, last = RunIndex(table.column("grp").to_numpy(), sym, p).marks()
        # A string that begins k bytes before its anchor stands in column reach - k; those of other halves aren't the row's own.
        first, last = np.maximum(first, p.reach - high[row]), np.minimum(last, p.reach - low[row])
        own = (first <= last) & table.column("single").to_numpy()[row]
        row, first, last = row[own], first[own], last[own]
        base = table.column("pos").to_numpy().astype(np.int64)[row] - p.reach
        at = pa.array(row)
        return pa.table({"id": table.column("id").take(at), "th": table.column("th").take(at), "start": pa.array((base + first).astype(np.int32)), "end": pa.array((base + last + p.length).astype(np.int32))})

    return run


def _judge(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (grp, hull, id, th, pos, ...): those whose hull repeats, and one row of each hull in a group with others.

    All aggregations are combined before they shuffle, so a group with a third of all rows costs a task no more. Where
    rows are joined with their group, a part of ``PARTS`` by hull is in the key, and with their hull a part by id and
    place: a group's aggregate has a bit for each part that its rows are in, and a row for each such bit goes to the join.
    """
    rows = rows.withColumn("part", part_of("hull"))
    repeated = rows.groupBy("grp").agg(F.count("*").alias("rows"), parts_met("part")).filter("rows > 1")
    live = written(rows.join(dealt(repeated).select("grp", "part"), ["grp", "part"]).drop("part"))
    copy = part_of("id", "th", "pos")
    hulls = live.withColumn("part", part_of("hull")).groupBy("grp", "hull", "part").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("place"), parts_met(copy).alias("copies"))
    sizes = hulls.groupBy("grp").agg(F.count("*").alias("size"), parts_met("part"))
    judged = written(hulls.join(dealt(sizes), ["grp", "part"]).filter("n > 1 OR size > 1"))
    several = dealt(judged.filter("n > 1").select("grp", "hull", F.col("copies").alias("parts")))
    whole = live.withColumn("part", copy).join(several, ["grp", "hull", "part"], "left_semi")
    unclear = judged.filter("size > 1").select("grp", "hull", "size", (F.col("n") == 1).alias("single"), "place.id", "place.th", "place.pos")
    return whole, unclear


def repeated_bytes(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, start, end): byte ranges of texts under a string of ``length`` bytes that starts elsewhere too."""
    id_type = dict(docs.dtypes)[id_col]
    keep = _KEEP.format(id=id_type)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= p.length)
    anchors = written(texts.mapInArrow(_find_anchors(p), f"{keep}, pos int, grp long, hull long"))
    whole, unclear = _judge(anchors)
    discard(anchors)  # what is needed of it has been written
    out = whole.select("id", "th", F.greatest(F.lit(0), F.col("pos") - p.reach).alias("start"), (F.col("pos") + p.length).alias("end"))

    places = unclear.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "grp", "single", "size")).alias("places"))
    places = places.withColumnsRenamed({"id": "id_", "th": "th_"})
    found = texts.join(places, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))).dropDuplicates(["id", "th"]).select("id", "th", "text", "places")
    cut = found.mapInArrow(_cut_contexts(p), f"{keep}, pos int, grp long, single boolean, size long, left int, ctx binary")
    state = cut.withColumns({"low": F.lit(0), "high": F.lit(p.reach)})
    columns = ["id", "th", "pos", "grp", "low", "high", "left", "ctx"]
    small = written(state.select(*columns, "single", "size"))
    large = small.filter(F.col("size") > p.max_group).select(*columns)
    ready = small.filter(F.col("size") <= p.max_group).drop("size")
    while not large.isEmpty():
        halves = written(large.mapInArrow(_halve(p), f"{keep}, pos int, grp long, low int, high int, left int, ctx binary, hull long"))
        whole, unclear = _judge(halves)
        out = out.unionByName(whole.select("id", "th", F.greatest(F.lit(0), F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + p.length).alias("end")))
        # The row that stands for a hull is found by its own place, so a large group is spread over its rows.
        mine = unclear.withColumn("copy", F.xxhash64("id", "th", "pos")).select("grp", "hull", "copy", "single", "size")
        state = halves.withColumn("copy", F.xxhash64("id", "th", "pos")).join(mine, ["grp", "hull", "copy"]).dropDuplicates(["grp", "hull"]).filter("low < high")
        state = written(state.select(*columns, "single", "size"))
        large = state.filter(F.col("size") > p.max_group).select(*columns)
        ready = ready.unionByName(state.filter(F.col("size") <= p.max_group).drop("size"))

    buckets = max(1, -(-ready.count() // p.bucket))
    dealt = ready.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    marks = dealt.groupBy("bucket").applyInArrow(_index(p), f"{keep}, start int, end int")
    return out.unionByName(marks)


def _remove(p: Repeats, text_at: int, ranges_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(batch.column(text_at).cast(pa.binary()), batch.column(ranges_at), strict=True):
                text = text.as_py() or b""
                parts, done, gone, runs, end = [], 0, 0, 0, -1
                for r in sorted((r["start"], r["end"]) for r in ranges.as_py() or ()):
                    start, stop = r[0], min(r[1], len(text))
                    if start > end:
                        runs += 1
                        parts.append(text[done:start])
                        gone += stop - start
                        done = stop
                    elif stop > done:
                        gone += stop - done
                        done = stop
                    end = max(end, stop)
                parts.append(text[done:])
                n_bytes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                kept.append(b"".join(parts))
            given = [c for i, c in enumerate(batch.columns) if i != ranges_at]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(kept, pa.binary())], names=names)

    return run


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` added.

    A byte goes if any string of ``length`` bytes over it also starts anywhere else, in the same text or
    another; all copies go. Texts are taken as UTF-8 and matches don't cross texts. A null text is empty.
    Rows that repeat an id and a text are copies of each other. Columns of ``docs`` that bear one of the
    added names are replaced; an empty table gives an empty result.

    Scale: what is shuffled are anchors (about one per 77 bytes, as hashes), the contexts of those that stay unclear, and
    the texts twice. No group is gathered beyond ``max_group`` contexts.
    """
    from pyspark.sql.types import StructType

    made = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    given = [c for c in docs.columns if c not in made]
    marks = repeated_bytes(docs, p, id_col, text_col).groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("r_ranges")).withColumnsRenamed({"id": "r_id", "th": "r_th"})
    source = packed(docs, made, r_doc=F.col(id_col), r_hash=F.xxhash64(text_col))
    joined = source.join(marks, F.col("r_doc").eqNullSafe(F.col("r_id")) & (F.col("r_hash") == F.col("r_th")), "left").select("row_.*", F.col("r_ranges").alias("r_ranges"))
    full = StructType(docs.select(*given).schema.fields + StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_bytes binary").fields)
    return joined.mapInArrow(_remove(p, given.index(text_col), len(given), [f.name for f in full.fields]), full)
