"""MinHash near-duplicate detection.

1. Every text's set of word shingles becomes one 128-bit set name and one signature: one-permutation
   hashing, whose empty bins are filled by optimal densification (each empty bin looks at bins drawn by
   a hash of its number and the attempt, until it finds a full one).
2. Texts with the same set form a class; only its representative, the first by id, goes on.
3. Signatures are cut into bands. The representatives in one bucket (band and its value) are linked to the
   bucket's first alone: a star, so pairs are bounded by documents times bands.
4. Both texts of each candidate edge are brought together and the link confirmed on full shingle sets.
5. Confirmed links give components, by alternating star contraction.
6. A star may miss a link between two of its leaves. So buckets that still hold several components are keyed anew, each by
   one more band, and each new bucket makes a star across components around another centre; round after round, with
   other bands and centres, until no bucket holds two components or the rounds end. A round makes no
   more edges than documents times bands, however many unlike texts share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import dealt, discard, part_of, parts_met, removing_shuffles, written


@dataclass(frozen=True)
class MinHash:
    shingle: int = 5
    #: Link where 100 * intersection >= percent * union.
    percent: int = 85
    #: 32 bands of 6 rows miss a pair at the threshold with probability 3e-7, and then only if no other path links it.
    bands: int = 32
    rows: int = 6
    #: Bins of the finer sketch that rules out pairs before their texts are read, seven standard deviations below the threshold.
    sketch: int = 512
    #: Rounds over buckets that hold several components, and stars that a bucket's member may be in, by other bands, in each.
    rounds: int = 2
    stars: int = 4
    max_rounds: int = 60

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def _signatures(owner: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins minimum hashes of sorted distinct shingles; rows of texts without shingles are meaningless."""
    which = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
    sig, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    sig[owner[first], which[first]] = hashes[first]
    full[owner[first], which[first]] = True
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    places = np.arange(bins, dtype=np.uint64)
    for attempt in range(1, 1 + 8 * bins):
        if not len(row):
            return sig
        look = (rolling.mix(places * np.uint64(0x9E3779B1) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        source = look[col]
        hit = full[row, source]
        sig[row[hit], col[hit]] = sig[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):  # the first full bin to the right
        sig[r, c] = sig[r, np.flatnonzero(np.roll(full[r], -c))[0] + c - bins]
    return sig


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins bytes of the least hashes in each bin, 1 to 255; 0 where a bin is empty."""
    which = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
    out = np.zeros((n, bins), np.uint8)
    out[owner[first], which[first]] = rolling.mix(hashes[first]) % np.uint64(255) + np.uint64(1)
    return out


def _describe(p: MinHash):
    """Arrow function: (id, th, text) to (id, th, n, sa, sb, bands, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in rolling.chunks(batch.column(2)):
                n = last - first
                owner, h = rolling.shingles(data, starts, p.shingle)
                count = np.bincount(owner, minlength=n)
                sa, sb = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(sa, owner, rolling.mix(h))
                np.add.at(sb, owner, rolling.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                sig = _signatures(owner, h, n, p.bins)
                power = np.arange(1, p.rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
                bands = rolling.mix((sig.reshape(n, p.bands, p.rows) * power).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64))
                low = _sketches(owner, h, n, p.sketch).view(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(count, pa.int64()),
                        pa.array(sa.view(np.int64)),
                        pa.array(sb.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1).view(np.int64)), p.bands).cast(pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(low.reshape(-1)), p.sketch).cast(pa.list_(pa.int8())),
                    ],
                    names=["id", "th", "n", "sa", "sb", "bands", "low"],
                )

    return run


def _confirm(p: MinHash):
    """Arrow function: (a, b, text_a, text_b) to the (a, b) that are similar enough."""

    def shared(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of intersection and union of the sets of each pair."""
        n = left[2]
        owner, h = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        same = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
        both = np.bincount(owner[1:][same], minlength=n)
        return both, np.bincount(owner, minlength=n) - both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sides = []
                for c in (2, 3):
                    owner, h = [], []
                    for first, _, data, starts in rolling.chunks(part.column(c)):
                        o, x = rolling.shingles(data, starts, p.shingle)
                        owner.append(o + first)
                        h.append(x)
                    sides.append((np.concatenate(owner), np.concatenate(h), part.num_rows))
                both, union = shared(*sides)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array((both > 0) & (100 * both >= p.percent * union))) for c in part.columns[:2]], names=["a", "b"])

    return run


def _confirmed(edges: DataFrame, texts: DataFrame, p: MinHash, id_type: str) -> DataFrame:
    """The edges (a, b) that hold on full sets. Texts are shuffled by id; a hub's text isn't copied in the shuffle."""
    member = edges.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = member.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(p), f"a {id_type}, b {id_type}")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its least id.

    Alternating large-star and small-star steps: each is a minimum per vertex (pre-aggregated) and a join
    back. Each round is written and the one before deleted; the loop ends when a round changes nothing, or raises.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def two(*pairs: tuple[str, str]) -> Column:
        """A row (u, v) for each pair of columns."""
        return F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs)))

    state = None
    for _ in range(max_rounds):
        both = edges.select(two(("u", "v"), ("v", "u")))
        # Equal rows may stay until the round's end: there are no more of them than edges.
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = large.join(least(large), "u").select(two(("v", "m"), ("u", "m")))
        before, edges = edges, written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    out = written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct()))
    discard(edges)
    return out


def _may_be_similar(p: MinHash, x: str, y: str) -> Column:
    """Whether sizes allow the similarity and sketches agree to within seven standard deviations of it.

    A bin that either text fills samples one shingle of their union, without replacement.
    """
    j = p.percent / 100
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    pairs = F.filter(F.arrays_zip(F.col(f"{x}.low").alias("a"), F.col(f"{y}.low").alias("b")), lambda e: (e["a"] != 0) | (e["b"] != 0))
    union = (small + large) / (1 + j)
    sampled = F.lit(float(p.sketch)) * (1 - F.exp(-union / p.sketch))
    deviation = F.sqrt(F.lit(j * (1 - j)) / sampled * F.greatest(F.lit(0.0), 1 - sampled / union))
    agree = F.size(F.filter(pairs, lambda e: e["a"] == e["b"]))
    return (small * 100 >= large * p.percent) & (agree + 2 >= F.size(pairs) * (j - 7 * deviation))


def _stars(members: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """(a, b): in each group of ``members`` (id, component, key) with several components, from its first by ``order`` to those of other components.

    A group of any size is aggregated before the shuffle, and dealt to parts where its centre is joined back.
    """
    m = members.withColumn("part", part_of("id"))
    centre = F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), "id", "component")).alias("centre")
    groups = m.groupBy(*key).agg(centre, F.min("component").alias("c0"), F.max("component").alias("c1"), parts_met("part")).filter("c0 <> c1").drop("c0", "c1")
    edges = m.join(dealt(groups), [*key, "part"]).filter(F.col("component") != F.col("centre.component"))
    return edges.select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct()


def _across(buckets: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame, p: MinHash, node: str) -> DataFrame:
    """(id, component) after links across components in buckets that hold several; ``found`` where there are none.

    Each round keys a bucket's members by one of the next bands too, for each of ``stars`` bands: similar texts share many bands, texts with a
    part in common few. Links join components, so only labels go through the contraction. Components only
    grow, so the buckets that hold several at first are all that need be looked at. Tables that the result doesn't read, ``found`` among them, are deleted.
    """
    label = lambda d, f: d.join(f, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = label(buckets.select("band", "value", "id"), found).withColumn("part", part_of("id"))
    several = labelled.groupBy("band", "value").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), parts_met("part")).filter("c0 <> c1").drop("c0", "c1")
    held = written(labelled.join(dealt(several), ["band", "value", "part"]).select("band", "value", "id"))
    if held.isEmpty():
        discard(held)
        return found
    described = written(reps.join(held.select("id").distinct(), "id", "left_semi"))
    further = F.transform(F.sequence(F.lit(1), F.lit(p.rounds * p.stars)), lambda r: F.get("bands", F.pmod(F.col("band") + r, F.lit(p.bands))))
    several = written(held.join(described.select("id", "bands"), "id").select("band", "value", "id", further.alias("further")))
    discard(held)
    sides = described.select("id", F.struct("n", "low").alias("x"))
    texts = written(texts.join(described.select("id"), "id", "left_semi"))
    for r in range(p.rounds):
        members = label(several, found)
        members = members.select("id", "component", "band", "value", F.posexplode(F.slice("further", r * p.stars + 1, p.stars)).alias("at", "other"))
        members = members.select("id", "component", F.xxhash64("band", "value", "at", "other").alias("key"))
        edges = _stars(members, ["key"], [F.xxhash64("component", "key", F.lit(r))])
        edges = edges.join(sides.withColumnRenamed("id", "a"), "a").join(sides.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").filter(_may_be_similar(p, "x", "y")).select("a", "b")
        links = written(_confirmed(edges, texts, p, node))
        if links.isEmpty():
            discard(links)
            continue
        ends = [found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b")]
        joined = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        merged = components(joined, p.max_rounds)
        # What was known moves to the merged label; ids that were alone and the old labels get theirs.
        moved = found.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        before, found = found, written(moved.union(merged.join(found.select("id"), "id", "left_anti").select("id", "component")))
        discard(before, merged, links)
    discard(described, several, texts)
    return found


@removing_shuffles
def near_duplicates(docs: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``text_hash``, ``n_shingles``, ``component_id`` (least id linked with it), ``kept`` (it is its own), ``first``.

    ``first`` tells whether the row's id and text are those that stand for the component; where no id names two
    texts, it is the same as ``kept``. Texts that are null or without words have no shingles and are linked with nothing.
    Rows with a null id are linked with nothing either: their component is null and they are kept. Rows that repeat
    an id and a text get the same result each; an id may name several texts, each with its own links. Other
    columns are ignored; an empty table gives an empty result.

    Scale: exact copies cost one row each after step 2. Buckets are never gathered in one task; star centres come
    from a pre-aggregated minimum, and hot buckets and classes are dealt to parts where they are joined back.
    Needs a checkpoint folder (``spark.checkpoint.dir``) that all machines share.
    """
    id_type = dict(docs.dtypes)[id_col]
    node = f"struct<id:{id_type},th:bigint>"
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    sets = written(rows.mapInArrow(_describe(p), f"id {id_type}, th long, n long, sa long, sb long, bands array<long>, low array<tinyint>"))

    full = sets.filter("n > 0 AND id IS NOT NULL").withColumn("part", part_of("id"))
    classes = full.groupBy("sa", "sb").agg(F.min(F.struct("id", "th")).alias("node"), parts_met("part"))
    members = written(full.select("id", "th", "sa", "sb", "part").distinct().join(dealt(classes), ["sa", "sb", "part"]).select(F.struct("id", "th").alias("doc"), "node"))
    lead = members.filter("doc = node").select(F.col("node").alias("id"))
    own = full.select(F.struct("id", "th").alias("id"), "n", "bands", "low")
    reps = own.join(lead, "id", "left_semi").dropDuplicates(["id"])

    banded = reps.select("id", F.posexplode("bands").alias("band", "value")).withColumn("part", part_of("id"))
    centres = banded.groupBy("band", "value").agg(F.min("id").alias("centre"), F.count("*").alias("n"), parts_met("part")).filter("n > 1").drop("n")
    buckets = written(banded.join(dealt(centres), ["band", "value", "part"]).drop("part"))
    stars = buckets.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    nodes = rows.filter("id IS NOT NULL").select(F.struct("id", "th").alias("id"), "text")
    texts = written(nodes.join(buckets.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))
    links = written(_confirmed(stars, texts, p, node))
    found = _across(buckets, reps, texts, components(links, p.max_rounds), p, node)
    discard(buckets, texts, links)

    groups = members.join(found.withColumnsRenamed({"id": "node"}), "node", "left").select("doc", F.coalesce("component", "node").alias("component"))
    out = sets.select(F.struct("id", "th").alias("doc"), F.col("n").alias("n_shingles")).join(groups, "doc", "left")
    component = F.coalesce("component.id", "doc.id")
    return out.select(
        F.col("doc.id").alias(id_col),
        F.col("doc.th").alias("text_hash"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc.id") == component, F.lit(True)).alias("kept"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("first"),
    )
