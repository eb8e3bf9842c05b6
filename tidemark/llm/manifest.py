"""Merkle manifest: a hash tree over the rows of each group and over the groups, with a proof for every row.

Rows are numbered in order of group and id and cut into parts of ``PART_ROWS`` consecutive rows. A fragment is a sparse
forest: the nodes, keyed by tree, level and place, that wait for siblings. Merging two fragments joins their nodes and
replaces every complete run of siblings by its parent; how many nodes a level has is known from the number of leaves, so
it is known when a run is complete. This is associative, and the fragment of a consecutive range of rows has few nodes:
those along its two edges.

1. Each part merges its own leaves, and says which nodes of others its rows' proofs need.
2. Fragments are merged by a tree reduction, ``FAN`` neighbours to one, until the root alone is left. Each round is
   written: what it made is what the proofs need. (``RDD.treeReduce`` would hand on the last fragment only.)
3. The nodes needed come back to the parts by a join, and each part climbs from its rows to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import written

#: Rows of one part, and neighbouring fragments that one step of the reduction merges.
PART_ROWS, FAN = 4096, 64
#: Number of the tree whose leaves are the roots of the groups.
TOP = -1

Node = tuple[int, int, int]
_NODE = "tree long, level int, place long, size long, digest string"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    return digest(*map(field, values))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda own, step: digest(step["before"], own, step["after"]))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Shape:
    """Sizes of the trees that a fragment meets: where a node's siblings and its parent are."""

    def __init__(self, arity: int, sizes: dict[int, int]):
        self.arity, self.sizes = arity, sizes
        self._widths: dict[tuple[int, int], int] = {}

    def width(self, tree: int, level: int) -> int:
        """Nodes of a level."""
        at = (tree, level)
        if at not in self._widths:
            self._widths[at] = self.sizes[tree] if level == 0 else -(-self.width(tree, level - 1) // self.arity)
        return self._widths[at]

    def run(self, node: Node) -> list[Node]:
        """A node and its siblings, in order."""
        tree, level, place = node
        first = place - place % self.arity
        return [(tree, level, i) for i in range(first, min(first + self.arity, self.width(tree, level)))]

    def above(self, node: Node) -> Node | None:
        """The parent; above the root of a group stands a leaf of the top tree, above its root nothing."""
        tree, level, place = node
        if self.width(tree, level) > 1:
            return tree, level + 1, place // self.arity
        return None if tree == TOP else (TOP, 0, tree)

    def parent(self, node: Node, digests: list[str]) -> str:
        """The parent's digest; a group's root is handed on as it is."""
        return _sha("".join(digests)) if self.width(node[0], node[1]) > 1 else digests[0]


def merge(waiting: dict[Node, str], shape: Shape) -> dict[Node, str]:
    """Replaces complete runs of siblings in ``waiting`` by their parents, as long as there are any; returns every node made."""
    made: dict[Node, str] = {}
    fresh = list(waiting)
    while fresh:
        found = []
        for node in fresh:
            up = shape.above(node)
            if up is None or node not in waiting:
                continue
            run = shape.run(node)
            if all(k in waiting for k in run):
                waiting[up] = made[up] = shape.parent(node, [waiting.pop(k) for k in run])
                found.append(up)
        fresh = found
    return made


def _nodes(t: pa.Table) -> dict[Node, str]:
    return dict(zip(zip(*(t[c].to_pylist() for c in ("tree", "level", "place")), strict=True), t["digest"].to_pylist(), strict=True))


def _sizes(t: pa.Table) -> dict[int, int]:
    pairs = t.select(["tree", "size"]).group_by(["tree", "size"]).aggregate([])
    return dict(zip(pairs["tree"].to_pylist(), pairs["size"].to_pylist(), strict=True))


def _table(part: int, kinds: dict[str, dict[Node, str] | set[Node]], sizes: dict[int, int]) -> pa.Table:
    """Rows (part, kind, tree, level, place, size, digest)."""
    rows = [(kind, *node, sizes[node[0]], nodes[node] if isinstance(nodes, dict) else None) for kind, nodes in kinds.items() for node in nodes]
    kind, tree, level, place, size, found = zip(*rows, strict=True) if rows else [()] * 6
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    made = [pa.array(v, t) for v, t in zip((kind, tree, level, place, size, found), types, strict=True)]
    return pa.Table.from_arrays([pa.array([part] * len(rows), pa.int64()), *made], names=["part", "kind", "tree", "level", "place", "size", "digest"])


def _leaves(t: pa.Table) -> list[Node]:
    return [(tree, 0, place) for tree, place in zip(t["tree"].to_pylist(), t["place"].to_pylist(), strict=True)]


def _fragment(arity: int) -> Callable:
    """Arrow function: the rows of one part to its waiting nodes, and the nodes of others that its proofs need."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        trees = t["n_trees"][0].as_py()
        shape = Shape(arity, _sizes(t) | {TOP: trees})
        leaves = _leaves(t)
        known = dict(zip(leaves, t["leaf"].to_pylist(), strict=True))
        waiting = dict(known)
        known |= merge(waiting, shape)
        need: set[Node] = set()
        # Siblings that others hold stand next to the paths of the first and the last row of a tree.
        edges = {}
        for node in leaves:
            low, high = edges.get(node[0], (node, node))
            edges[node[0]] = (min(low, node), max(high, node))
        for edge in {n for pair in edges.values() for n in pair}:
            node: Node | None = edge
            while node is not None:
                need.update(k for k in shape.run(node) if k not in known)
                node = shape.above(node)
        return _table(key[0].as_py(), {"open": waiting, "need": need}, shape.sizes)

    return run


def _reduce(arity: int) -> Callable:
    """Arrow function: neighbouring fragments to one, with the nodes made on the way."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shape = Shape(arity, _sizes(t) | {TOP: t["n_trees"][0].as_py()})
        waiting = _nodes(t)
        made = merge(waiting, shape)
        return _table(key[0].as_py(), {"open": waiting, "made": made}, shape.sizes)

    return run


def _prove(arity: int, kept: list[str]) -> Callable:
    """Arrow function: the rows of a part and the nodes it needs to rows with their proofs."""

    def run(t: pa.Table, given: pa.Table) -> pa.Table:
        shape = Shape(arity, _sizes(t) | {TOP: t["n_trees"][0].as_py() if t.num_rows else 0})
        leaves = _leaves(t)
        known = dict(zip(leaves, t["leaf"].to_pylist(), strict=True))
        known |= merge(dict(known), shape) | _nodes(given)
        before, after, ends, subroots, roots = [], [], [0], [], []
        steps: dict[Node, tuple[str, str]] = {}
        for node in leaves:
            subroot = ""
            while True:
                if node[0] == TOP and not subroot:
                    subroot = known[node]
                up = shape.above(node)
                if up is None:
                    break
                if shape.width(node[0], node[1]) > 1:  # else the group's root, handed on as it is
                    if node not in steps:
                        run = [known[k] for k in shape.run(node)]
                        own = node[2] % arity
                        steps[node] = "".join(run[:own]), "".join(run[own + 1 :])
                    before.append(steps[node][0])
                    after.append(steps[node][1])
                node = up
            ends.append(len(before))
            subroots.append(subroot)
            roots.append(known[node])
        siblings = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), siblings)
        return pa.Table.from_arrays([*(t[c] for c in kept), t["leaf"], pa.array(subroots, pa.string()), pa.array(roots, pa.string()), proof], names=[*kept, "leaf", "subroot", "root", "proof"])

    return run


def reduced(fragments: DataFrame, n_parts: int, n_trees: int, arity: int) -> DataFrame:
    """All nodes that parts left waiting or that the reduction made: (tree, level, place, digest)."""
    schema = f"part long, kind string, {_NODE}"
    level = fragments.filter("kind = 'open'")
    spine = level.select("tree", "level", "place", "digest")
    while n_parts > 1:
        step = level.filter("kind = 'open'").withColumns({"part": F.floor(F.col("part") / FAN), "n_trees": F.lit(n_trees).cast("long")})
        level = written(step.groupBy("part").applyInArrow(_reduce(arity), schema))
        spine = spine.union(level.filter("kind = 'made'").select("tree", "level", "place", "digest"))
        n_parts = -(-n_parts // FAN)
    return spine


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", keep: Sequence[str] = (), arity: int = 2
) -> DataFrame:
    """Per row of ``docs``: its id, the ``keep`` columns, ``leaf``, ``subroot`` (of its group), ``root`` and ``proof``.

    ``proof`` has a step for each level from the leaf to the root: the siblings ``before`` and ``after`` the node on the
    path, digests as joined hex text; ``folded`` recomputes the root from it. A leaf hashes the ``fields``, each null as
    ``-``, else by its length and value. Within a group leaves ascend by id, nulls first, then by leaf; groups ascend, null
    first. Repeated rows are leaves of their own. A lone leaf is its group's root, a lone group's root is the root. Empty
    and very long texts are values like others; other columns are ignored. An empty table gives an empty result.

    Scale: the table is read once; rows then travel as digests. A group of any size is cut into parts of ``PART_ROWS`` rows,
    and one task holds such parts, or the few waiting nodes of ``FAN`` neighbours, at a time.
    """
    kept = [id_col, *keep]
    names = [f"k{i}" for i in range(len(kept))]
    d = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(group_col).alias("grp"), F.col(id_col).alias("ord"), leaf_hash(*map(F.col, fields)).alias("leaf"))
    leaves = written(d.withColumn("uid", F.monotonically_increasing_id()))
    rows = numbered(leaves, ["grp", "ord", "leaf", "uid"], "no").withColumn("no", F.col("no") - 1).withColumn("part", F.floor(F.col("no") / PART_ROWS)).drop("ord", "uid")
    rows = written(rows)
    # Groups by part: a hot group has as many rows here as parts, and its rows are joined by part.
    spans = written(rows.groupBy("part", "grp").agg(F.min("no").alias("from"), F.count("*").alias("n")))
    groups = written(numbered(spans.groupBy("grp").agg(F.min("from").alias("from"), F.sum("n").alias("size")), ["grp"], "tree"))
    total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_trees, n_parts = total[0], -(-total[1] // PART_ROWS)
    at = spans.drop("from", "n").alias("s").join(groups.alias("g"), F.col("s.grp").eqNullSafe(F.col("g.grp"))).select("s.part", "s.grp", (F.col("g.tree") - 1).alias("tree"), "g.size", "g.from")
    placed = rows.alias("r").join(at.alias("a"), (F.col("r.part") == F.col("a.part")) & F.col("r.grp").eqNullSafe(F.col("a.grp")))
    placed = written(placed.select("r.part", *names, "r.leaf", "a.tree", "a.size", (F.col("r.no") - F.col("a.from")).alias("place"), F.lit(n_trees).cast("long").alias("n_trees")))

    schema = f"part long, kind string, {_NODE}"
    fragments = written(placed.drop(*names).groupBy("part").applyInArrow(_fragment(arity), schema))
    spine = reduced(fragments, n_parts, n_trees, arity)
    given = fragments.filter("kind = 'need'").drop("kind", "digest", "size").join(spine, ["tree", "level", "place"])
    types = dict(docs.dtypes)
    out = ", ".join(f"{n} {types[c]}" for c, n in zip(kept, names, strict=True))
    step = "array<struct<before:string,after:string>>"
    proved = placed.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(_prove(arity, names), f"{out}, leaf string, subroot string, root string, proof {step}")
    return proved.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "leaf", "subroot", "root", "proof")
