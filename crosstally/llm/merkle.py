"""Merkle manifest of a dataset: a tree of SHA-256 states that can be resumed before each child.

Each row is a leaf, the digest of its fields. Per source the leaves, by id, are folded in runs of
``ARITY`` to their subroot, and the subroots, by source, likewise to the root. A parent keeps a copy of the
hash state before each of its children (``states``), so a changed child is folded from the state at its
place, with the new child and the siblings to its right; what is to its left is never read again.

``build`` writes the manifest: the leaves with their places, and all parents. ``fold`` takes a digest that
is shown for each leaf up to the root along the kept states, and says whether the root still holds.

Defined results: a null field is told apart from an empty text; a null source is a source of its own and the
first; rows without an id come first in their source; rows of equal id are ordered by their
digest, and rows equal in both are interchangeable; a source of one row has that leaf as its subroot; an
empty table has no rows and no root; other columns are ignored.

Scale: texts are read once and never moved. Leaves (two digests and an id) are sorted by range, so a source
may hold any share of the rows. A task folds ``ARITY ** LEVELS`` consecutive nodes through ``LEVELS``
levels at once; the next round has that many times fewer nodes. Hash states and right siblings of the
levels above a block are one short row, shared by its leaves. The driver sees the greatest number of
leaves of a source, the number of sources and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions.types import quoted
from crosstally.llm import sha256
from crosstally.llm.frames import Scratch, place_in, ranged, spans_of, stored

ARITY, LEVELS = 3, 7
SPAN = ARITY**LEVELS
_HEX = sha256.BLOCK

_PARENTS = "tree long, block long, level int, pos long, digest string, states binary"
_PATHS = "tree long, pos long, steps binary, siblings string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def levels_above(n: int) -> int:
    """Levels from ``n`` nodes to their top."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * ARITY
    return levels


@dataclass(frozen=True)
class Tree:
    """Trees folded side by side. ``rounds``: the nodes that a round begins with (tree, n, pos, digest)
    and the parents it makes; ``tops``: tree, digest."""

    rounds: list[tuple[DataFrame, DataFrame]]
    tops: DataFrame


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, n, pos, digest, doc_id and what was carried along; ``sources``: tree, source, n."""

    leaves: DataFrame
    sources: DataFrame
    trees: Tree
    head: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """All parents of the sources' trees, with the hash state before each child."""
        told = _no_parents(self.leaves.sparkSession)
        for nth, (_, parents) in enumerate(self.trees.rounds):
            told = told.unionByName(parents.withColumn("level", F.col("level") + nth * LEVELS))
        return told.drop("block").join(self.sources.select("tree", "source"), "tree")


def _no_parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _PARENTS)


# Places ---------------------------------------------------------------------------------------

def _placed(
    leaves: DataFrame, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The leaves with tree, n and pos, and the sources with tree and n."""
    by_range = ranged(leaves, ["source", "doc_id", "digest"], "leaves-by-range", scratch)
    spans = scratch.stored(spans_of(by_range, ["source"]), "spans")
    sources = ranged(
        spans.groupBy("source").agg(F.sum("rows").alias("n")), ["source"], "sources-by-range", scratch
    )
    # One row per partition, so this window is no larger than the number of partitions.
    parts = spans_of(sources, [])
    numbered = sources.withColumn("part", F.shiftright("at", 33)).join(parts, "part")
    told = stored(numbered.select("source", "n", place_in().alias("tree")), "sources")
    known = spans.join(told, spans["source"].eqNullSafe(told["source"])).select(
        spans["source"].alias("its_source"), "part", "first", "before", "n", "tree"
    )
    same = by_range["source"].eqNullSafe(known["its_source"]) & (F.col("at_part") == known["part"])
    at = by_range.withColumn("at_part", F.shiftright("at", 33)).join(known, same)
    placed = stored(
        at.withColumn("pos", place_in()).drop("its_source", "part", "at_part", "first", "before", "at", "source"),
        "leaves",
    )
    return placed, told


# Upwards --------------------------------------------------------------------------------------

def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def _texts_of(digests: np.ndarray) -> list[str]:
    whole = digests.tobytes().decode()
    return [whole[i : i + _HEX] for i in range(0, len(whole), _HEX)]


def _ended(states: np.ndarray, children: int) -> np.ndarray:
    padding = np.broadcast_to(sha256.last_block(children * _HEX), (len(states), sha256.BLOCK))
    return sha256.told(sha256.resumed(states, padding))


def parents_of(digests: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Digests of the parents of consecutive nodes, and their states before child 0, 1, 2, ...

    The i-th array of states has a row for each parent that has a child i, the first parents.
    """
    n = -(-len(digests) // ARITY)
    state, before, out = sha256.begun(n), [], np.empty((n, _HEX), np.uint8)
    for slot in range(ARITY):
        children = digests[slot::ARITY]
        if len(children) < len(state):
            # The last parent has no child here.
            out[len(children) : len(state)] = _ended(state[len(children) :], slot)
            state = state[: len(children)]
        if not len(children):
            return out, before
        before.append(state)
        state = sha256.resumed(state, children)
    out[: len(state)] = _ended(state, ARITY)
    return out, before


def _grown(table: pa.Table) -> pa.Table:
    """All parents of one block of nodes."""
    table = table.sort_by("pos")
    tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
    digests = _bytes_of(table.column("digest"))
    level, pos, told, kept = [], [], [], []
    first = block * SPAN
    for up in range(1, min(LEVELS, levels_above(n)) + 1):
        digests, before = parents_of(digests)
        first //= ARITY
        level += [up] * len(digests)
        pos += range(first, first + len(digests))
        told += _texts_of(digests)
        rows = [sha256.stored_states(b) for b in before]
        kept += [b"".join(r[i].tobytes() for r in rows if i < len(r)) for i in range(len(digests))]
    return pa.table(
        {
            "tree": pa.array([tree] * len(level), pa.int64()), "block": pa.array([block] * len(level), pa.int64()),
            "level": pa.array(level, pa.int32()), "pos": pa.array(pos, pa.int64()),
            "digest": pa.array(told, pa.string()), "states": pa.array(kept, pa.binary()),
        }
    )


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {SPAN}"))


def _tops(parents: DataFrame) -> DataFrame:
    """The highest node of every block: tree, pos in the next round, digest."""
    return parents.groupBy("tree", F.col("block").alias("pos")).agg(F.max_by("digest", "level").alias("digest"))


def _tree(nodes: DataFrame, most: int, label: str) -> Tree:
    """Fold ``nodes`` (tree, n, pos, digest); ``most``: the greatest n."""
    rounds, done = [], []
    while most > 1:
        done.append(nodes.where("n = 1").select("tree", "digest"))
        nodes = nodes.where("n > 1")
        parents = stored(
            _blocked(nodes).select("tree", "block", "pos", "digest", "n")
            .groupBy("tree", "block").applyInArrow(_grown, _PARENTS),
            f"{label}-parents-{len(rounds)}",
        )
        rounds.append((nodes, parents))
        widths = nodes.select("tree", F.ceil(F.col("n") / SPAN).cast("long").alias("n")).distinct()
        nodes = stored(_tops(parents).join(widths, "tree"), f"{label}-nodes-{len(rounds)}")
        most = -(-most // SPAN)
    tops = nodes.select("tree", "digest")
    for other in done:
        tops = tops.unionByName(other)
    return Tree(rounds, stored(tops, f"{label}-tops"))


def build(
    docs: DataFrame, digest: Column, doc_id: str = "doc_id", source: str = "source",
    carried: Mapping[str, Column] | None = None,
) -> Manifest:
    """Write the manifest of ``docs``, whose leaves are ``digest`` (64 hexadecimal digits, see ``leaf_digest``).

    ``carried`` names columns that stay with the leaves, for instance a digest to be folded later.
    """
    scratch = Scratch()
    rows = docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), digest.alias("digest"),
        *[c.alias(name) for name, c in (carried or {}).items()],
    )
    leaves, sources = _placed(rows, scratch)
    scratch.drop()
    found = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    trees = _tree(leaves.select("tree", "n", "pos", "digest"), found[0], "source")
    subroots = trees.tops.select(
        F.lit(0).cast("long").alias("tree"), F.lit(found[1]).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"
    )
    head = _tree(subroots, found[1], "head")
    top = head.tops.first()
    return Manifest(leaves, sources, trees, head, top["digest"] if top else None)


# Downwards ------------------------------------------------------------------------------------

class _Block:
    """The nodes of one block by level, and for each of them its parent's kept state and siblings."""

    def __init__(self, digests: np.ndarray, parents: pa.Table):
        self.levels, self.states = [digests], []
        rows = parents.sort_by([("level", "ascending"), ("pos", "ascending")])
        level = rows.column("level").to_numpy()
        for up in range(1, (int(level[-1]) if len(level) else 0) + 1):
            own = rows.filter(pa.array(level == up))
            self.levels.append(_bytes_of(own.column("digest")))
            kept = np.zeros((len(own), ARITY, sha256.STATE), np.uint8)
            for i, states in enumerate(own.column("states").to_pylist()):
                held = np.frombuffer(states, np.uint8).reshape(-1, sha256.STATE)
                kept[i, : len(held)] = held
            self.states.append(kept)

    def paths(self, steps: bytes, siblings: str) -> tuple[list[bytes], list[str]]:
        """For each lowest node its steps to the root and its siblings on the way, left to right.

        A step: children, place among them, the state before that place, the right siblings.
        """
        all_steps, all_siblings = [steps], [siblings]
        for nodes, states in zip(reversed(self.levels[:-1]), reversed(self.states)):
            texts, own_steps, own_siblings = _texts_of(nodes), [], []
            for i, text in enumerate(texts):
                up, slot = divmod(i, ARITY)
                run = texts[up * ARITY : (up + 1) * ARITY]
                step = bytes([len(run), slot]) + states[up, slot].tobytes() + "".join(run[slot + 1 :]).encode()
                own_steps.append(step + all_steps[up])
                own_siblings.append("".join(run[:slot] + run[slot + 1 :]) + all_siblings[up])
            all_steps, all_siblings = own_steps, own_siblings
        return all_steps, all_siblings

    def proofs(self, siblings: str) -> list[str]:
        """For each lowest node its siblings on the way to the root."""
        found = [siblings]
        for nodes in reversed(self.levels[:-1]):
            texts = _texts_of(nodes)
            runs = [texts[i : i + ARITY] for i in range(0, len(texts), ARITY)]
            found = [
                "".join(run[:slot] + run[slot + 1 :]) + found[up]
                for up, run in enumerate(runs) for slot in range(len(run))
            ]
        return found

    def folded(self, shown: np.ndarray, steps: bytes) -> np.ndarray:
        """The root that each lowest node gives when ``shown`` stands in its place."""
        at = np.arange(len(shown))
        for nodes, kept in zip(self.levels, self.states):
            up, slot = at // ARITY, at % ARITY
            children = np.minimum(ARITY, len(nodes) - up * ARITY)
            state = sha256.resumed(sha256.read_states(kept[up, slot]), shown)
            for other in range(1, ARITY):
                here = np.flatnonzero((slot < other) & (other < children))
                if len(here):
                    state[here] = sha256.resumed(state[here], nodes[up[here] * ARITY + other])
            shown = np.empty_like(shown)
            for n in range(1, ARITY + 1):
                here = np.flatnonzero(children == n)
                if len(here):
                    shown[here] = _ended(state[here], n)
            at = up
        for children, slot, state, rights in read_steps(steps):
            state = sha256.resumed(np.repeat(sha256.read_states(state), len(shown), axis=0), shown)
            for right in rights:
                state = sha256.resumed(state, np.broadcast_to(right, shown.shape))
            shown = _ended(state, children)
        return shown


def read_steps(steps: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Children, place, state before that place and right siblings of each step."""
    found, at = [], 0
    while at < len(steps):
        children, slot = steps[at], steps[at + 1]
        at += 2
        state = np.frombuffer(steps[at : at + sha256.STATE], np.uint8)
        at += sha256.STATE
        size = (children - slot - 1) * _HEX
        found.append((children, slot, state, np.frombuffer(steps[at : at + size], np.uint8).reshape(-1, _HEX)))
        at += size
    return found


def _split(right: pa.Table) -> tuple[pa.Table, dict]:
    """The parents of a block, and the row of what lies above it."""
    level = right.column("level").to_numpy()
    return right.filter(pa.array(level > 0)), right.filter(pa.array(level == 0)).slice(0, 1).to_pylist()[0]


def _described(left: pa.Table, right: pa.Table) -> pa.Table:
    left = left.sort_by("pos")
    parents, above = _split(right)
    steps, siblings = _Block(_bytes_of(left.column("digest")), parents).paths(above["steps"], above["siblings"])
    return pa.table(
        {
            "tree": left.column("tree"), "pos": left.column("pos"),
            "steps": pa.array(steps, pa.binary()), "siblings": pa.array(siblings, pa.string()),
        }
    )


def _with_above(parents: DataFrame, above: DataFrame) -> DataFrame:
    """Parents of the blocks, and one row of level 0 for what lies above each block."""
    rows = above.withColumnRenamed("pos", "block").withColumn("level", F.lit(0))
    return parents.unionByName(rows, allowMissingColumns=True)


def _paths(tree: Tree, above: DataFrame, label: str) -> DataFrame:
    """What lies above each block of the lowest round: tree, pos (of the block), steps, siblings.

    ``above``: the same for the tops (tree, steps, siblings).
    """
    tops = above.select("tree", F.lit(0).cast("long").alias("pos"), "steps", "siblings")
    found = tops
    for nth in range(len(tree.rounds) - 1, 0, -1):
        nodes, parents = tree.rounds[nth]
        lower = (
            _blocked(nodes).select("tree", "block", "pos", "digest").groupBy("tree", "block")
            .cogroup(_with_above(parents, _in_round(found, nodes)).groupBy("tree", "block"))
            .applyInArrow(_described, _PATHS)
        )
        ended = tops.join(nodes.select("tree").distinct(), "tree", "left_anti")
        found = stored(lower.unionByName(ended), f"{label}-paths-{nth}")
    return found


def _in_round(above: DataFrame, nodes: DataFrame) -> DataFrame:
    return above.join(nodes.select("tree").distinct(), "tree", "left_semi")


def _beginning(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.col("id").alias("tree"), F.lit(b"").alias("steps"), F.lit("").alias("siblings")
    )


def _of_nodes(tree: Tree, above: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Paths of the lowest nodes themselves."""
    blocks = _paths(tree, above, label)
    if not tree.rounds:
        return blocks
    _, parents = tree.rounds[0]
    return (
        _blocked(nodes).select("tree", "block", "pos", "digest").groupBy("tree", "block")
        .cogroup(_with_above(parents, blocks).groupBy("tree", "block"))
        .applyInArrow(_described, _PATHS)
    )


def fold(manifest: Manifest, shown: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf.

    ``shown`` names the carried digest that is folded; null stands for the leaf itself. ``proof_sha256``
    is the digest of the siblings on the way to the root, which is what a proof would hold.
    """
    leaves, spark = manifest.leaves, manifest.leaves.sparkSession
    head_nodes = manifest.trees.tops.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"
    )
    of_sources = stored(
        _of_nodes(manifest.head, _beginning(spark), head_nodes, "head")
        .select(F.col("pos").alias("tree"), "steps", "siblings"),
        "paths-of-sources",
    )
    blocks = _paths(manifest.trees, of_sources, "source")
    named = blocks.join(manifest.trees.tops.select("tree", F.col("digest").alias("subroot")), "tree")
    parents = manifest.trees.rounds[0][1] if manifest.trees.rounds else _no_parents(spark)
    root = manifest.root
    id_type = leaves.schema["doc_id"].dataType.simpleString()

    def checked(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        parents, above = _split(right)
        digests = _bytes_of(left.column("digest"))
        block = _Block(digests, parents)
        proofs = [hashlib.sha256(p.encode()).hexdigest() for p in block.proofs(above["siblings"])]
        roots = _texts_of(block.folded(_bytes_of(left.column("shown")), above["steps"]))
        n = len(left)
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "leaf": left.column("digest"),
                "subroot": pa.array([above["subroot"]] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string()),
                "verified": pa.array([r == root for r in roots], pa.bool_()),
            }
        )

    rows = _blocked(leaves).select(
        "tree", "block", "pos", "digest", F.coalesce(quoted(shown), F.col("digest")).alias("shown"), "doc_id"
    )
    around = _with_above(parents, named)
    return rows.groupBy("tree", "block").cogroup(around.groupBy("tree", "block")).applyInArrow(
        checked,
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
