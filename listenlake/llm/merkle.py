"""Merkle manifest of a dataset, by checkpoint and recompute.

Every row is a leaf: the digest of its fields, each with its length in front. The leaves of a group (a language) form a
tree in the order of their key; the roots of the groups form one more tree, whose root stands for the dataset. Of a tree
only every LEVELS-th level is stored, cut into aligned subtrees of 2^LEVELS nodes, one row each: 1/16 of the nodes of all
levels above the leaves, and no interior node between. To extract proofs, each stored subtree regenerates its interior
nodes from the stored nodes beneath them, hands every one of these its siblings together with those of the subtree's own
top, and discards the interior again. Proofs go from the top down; a level is joined with the one above by the number of
the subtree, one row on either side, so a group that holds most rows is no hot key.

Digests are lowercase hex SHA-256; inner nodes are digests of their children's hex texts, and a last node without a partner
is the digest of its own text. Rows are ordered by key (null first), rows of one key by leaf; rows equal in both are
equal leaves. Null fields count as `-`, empty texts as `0:`. A null group is a group of its own and comes first. An empty
table has no leaves and no root. Columns that are neither key, group nor field of a leaf are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import let, staged
from listenlake.llm.numbering import numbered

LEVELS = 4  # levels of a stored subtree

STEPS = "array<string>"


def field(value: Column) -> Column:
    """A field as a leaf holds it: its UTF-8 length, a colon and its text; `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def depth(n: Column) -> Column:
    """Levels above n leaves until one node remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def _upto(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _parents(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))), 256))


def _interior(nodes: Column, levels: Column) -> Column:
    """All levels of a subtree, its nodes first."""
    return F.aggregate(
        _upto(levels), F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1))))
    )


def _siblings(inner: Column, i: Column, levels: Column) -> Column:
    """What node i of a subtree needs to get to its top: for each level `L` or `R` and the sibling on that side, or an
    empty text where the node has none."""

    def step(j: Column) -> Column:
        place = F.call_function("shiftright", i, j - 1)
        other = F.get(F.element_at(inner, j), place.bitwiseXOR(F.lit(1)))
        side = F.when(place.bitwiseAND(F.lit(1)) == 1, F.lit("L")).otherwise(F.lit("R"))
        return F.coalesce(F.concat(side, other), F.lit(""))

    return F.transform(_upto(levels), step)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node: Column, step: Column) -> Column:
        other = F.substring(step, 2, 64)
        joined = F.when(step == "", node).when(F.substring(step, 1, 1) == "L", F.concat(other, node)).otherwise(F.concat(node, other))
        return F.sha2(joined, 256)

    return F.aggregate(steps, start, up)


def proof_digest(steps: Column) -> Column:
    """The digest of the siblings, left to right as the path meets them."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.substring(s, 2, 64))), 256)


@dataclass
class Tree:
    """Stored levels of the trees of all groups. subtrees[c]: (tree, block, n, nodes) with the nodes of level c * levels,
    2^levels of them to a row; nodes of the first carry columns of their rows. roots: (tree, n, root)."""

    subtrees: list[DataFrame]
    roots: DataFrame
    levels: int

    def stored(self) -> DataFrame:
        """(tree, level, at, hash) of every stored node."""
        out = None
        for c, part in enumerate(self.subtrees):
            rows = part.select("tree", F.lit(c * self.levels).alias("level"), F.explode("nodes").alias("x"))
            rows = rows.select("tree", "level", "x.at", "x.hash")
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, x, up) of every leaf: x is its node, up what `above` (tree, up) tells of its tree, with the steps from
        the leaf in front of up.steps."""
        kids = None
        own_tree = above.select(F.col("tree").alias("_t"), "up")
        for c in reversed(range(len(self.subtrees))):
            rows, ends = self.subtrees[c], depth(F.col("n")) <= (c + 1) * self.levels
            met = rows.filter(ends).join(own_tree, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
            if kids is not None:
                over = kids.select(F.col("tree").alias("_t"), F.col("x.at").alias("_at"), "up")
                same = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_at"))
                met = met.unionByName(rows.filter(~ends).join(over, same).drop("_t", "_at"))
            levels = F.least(F.lit(self.levels), depth(F.col("n")) - c * self.levels).cast("int")
            hashes = F.transform("nodes", lambda x: x["hash"])
            steps = lambda inner, i: F.concat(_siblings(inner, i, levels), F.col("up.steps"))
            each = let(
                _interior(hashes, levels),
                lambda inner: F.transform("nodes", lambda x, i: F.struct(x.alias("x"), steps(inner, i).alias("steps"))),
            )
            kids = met.select("tree", "up", F.explode(each).alias("kid"))
            kids = kids.select("tree", F.col("kid.x").alias("x"), F.col("up").withField("steps", F.col("kid.steps")).alias("up"))
        return kids


def grow(rows: DataFrame, carried: list[str], levels: int = LEVELS) -> Tree:
    """The stored levels over rows (tree, at, n, hash and the carried columns)."""
    most = rows.agg(F.max(depth(F.col("n"))).alias("d")).first()["d"] or 0
    subtrees, roots, now = [], None, rows
    for c in range(max(1, -(-most // levels))):
        block = F.call_function("shiftright", F.col("at"), F.lit(levels)).alias("block")
        node = F.struct("at", "hash", *(carried if c == 0 else []))
        part = now.groupBy("tree", block).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(node)).alias("nodes"))
        part = staged(part)
        subtrees.append(part)
        left = F.least(F.lit(levels), depth(F.col("n")) - c * levels).cast("int")
        top = F.element_at(F.element_at(_interior(F.transform("nodes", lambda x: x["hash"]), left), -1), 1)
        tops = part.select("tree", F.col("block").alias("at"), "n", top.alias("hash"))
        done = depth(F.col("n")) <= (c + 1) * levels
        ended = tops.filter(done).select("tree", "n", F.col("hash").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        now = tops.filter(~done)
    return Tree(subtrees, staged(roots), levels)


@dataclass
class Manifest:
    """The trees of all groups and the tree over their roots."""

    groups: Tree
    top: Tree

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.top.roots.select("root")

    def proofs(self) -> DataFrame:
        """(tree, x, subroot, root, steps) of every leaf; x holds its place, its hash and the carried columns."""
        start = self.top.roots.select("tree", F.struct(F.array().cast(STEPS).alias("steps"), "root").alias("up"))
        over = self.top.proofs(start).select(
            F.col("x.group").alias("tree"),
            F.struct("up.steps", F.col("x.hash").alias("subroot"), "up.root").alias("up"),
        )
        return self.groups.proofs(over).select("tree", "x", "up.subroot", "up.root", "up.steps")


def manifest(leaves: DataFrame, order: str, carried: list[str] = (), levels: int = LEVELS) -> Manifest:
    """The manifest of leaves (tree, hash, the column that orders them, and columns to carry)."""
    keep = list(dict.fromkeys([order, *carried]))
    rows = numbered(staged(leaves.select("tree", "hash", *keep)), "tree", [order, "hash"])
    groups = grow(rows, keep, levels)
    roots = groups.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash"))
    return Manifest(groups, grow(numbered(staged(roots), "tree", ["group"]), ["group"], levels))
