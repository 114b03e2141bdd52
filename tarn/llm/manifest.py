"""Merkle manifest of a dataset: a digest for each row, each source and the whole, with proofs.

Leaves of a source stand in order; every ARITY neighbours become one node until one is left, the source's
root. The sources' roots, in order, become the root of the dataset in the same way. A row is proven by its
path: the digests to the left and right of its node in each run up to the root.

No level is a job of its own. Nodes are numbered range by range, BLOCK consecutive ones (a power of ARITY)
are gathered as one array, and the array collapses level by level inside its row, by higher-order functions.
The blocks' roots are the nodes of the next round, so the number of rounds is the logarithm of the rows to
the base BLOCK, and a hot source is only more blocks. Paths come back down in the same steps: a block's
path to the root is joined to it once, and its rows add what lies inside the block.

Everything is a built-in expression: no Python function reads a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

ARITY = 3
#: Levels that collapse inside one array, and nodes of the array.
LEVELS = 6
BLOCK = ARITY**LEVELS
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` for null, else its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*(field(v) for v in values)), "UTF-8"), 256)


def _hash(text: str) -> str:
    return f"sha2(cast({text} as binary), 256)"


def collapsed(nodes: str, depth: str) -> Column:
    """All levels of an array of nodes, the array itself first, ``depth`` times collapsed."""
    up = f"transform(sequence(0, (size(x) + {ARITY - 1}) div {ARITY} - 1), j -> {_hash(f'array_join(slice(x, j * {ARITY} + 1, {ARITY}), "")')})"
    step = f"concat(levels, transform(array(element_at(levels, -1)), x -> {up}))"
    return F.expr(f"if({depth} = 0, array({nodes}), aggregate(sequence(1, greatest({depth}, 1)), array({nodes}), (levels, k) -> {step}))")


def path_in(levels: str, at: str) -> str:
    """The path of the node at place ``at`` (from 0) of the lowest level: what lies left and right of it in its run, level by level."""
    own = f"({at} div cast(pow({ARITY}, k) as int))"
    run = f"{own} - {own} % {ARITY}"
    left = f"array_join(slice({levels}[k], {run} + 1, {own} % {ARITY}), '')"
    right = f"array_join(slice({levels}[k], {own} + 2, {ARITY - 1} - {own} % {ARITY}), '')"
    return f"if(size({levels}) = 1, cast(array() as {_PATH}), transform(sequence(0, greatest(size({levels}) - 2, 0)), k -> struct({left} as left, {right} as right)))"


def folded(digest: str, path: str) -> str:
    """The root that a digest and a path give."""
    return f"aggregate({path}, {digest}, (d, p) -> {_hash('concat(p.left, d, p.right)')})"


def proof(path: str) -> str:
    """One digest of all siblings of a path, level by level, left to right."""
    return _hash(f"array_join(transform({path}, p -> concat(p.left, p.right)), '')")


def _depth(n: Column) -> Column:
    """Levels of a block in a group of ``n`` nodes."""
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(n <= ARITY**k, k).otherwise(depth)
    return depth


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in the group's order) and ``n`` (rows of the group). Ranges of (group,
    order) are numbered side by side and start at what the ranges before them hold of the group; the last
    column of ``order`` tells all rows apart, so that equal ones are no hot range."""
    ranges = written(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(group, "part").agg(F.count("*").alias("own"))
    window = Window.partitionBy(group)  # a row a range
    starts = counts.select(group, "part", (F.sum("own").over(window.orderBy("part")) - F.col("own")).alias("start"), F.sum("own").over(window).alias("n"))
    inside = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    return ranges.withColumn("inside", inside).join(starts, ["part", group]).withColumn("place", F.col("start") + F.col("inside")).drop("part", "inside", "start")


def _blocks(nodes: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(group, block, n, nodes...): BLOCK consecutive nodes (group, place, n, digest, more...) in an array, in order."""
    rows = F.array_sort(F.collect_list(F.struct("place", "digest", *more)))
    return nodes.groupBy("group", F.expr(f"place div {BLOCK}").alias("block"), "n").agg(rows.alias("nodes"))


def _roots(blocks: DataFrame) -> DataFrame:
    """The next round's nodes: (group, place, n, digest) with n of the group's blocks."""
    levels = blocks.withColumn("digests", F.expr("nodes.digest")).withColumn("levels", collapsed("digests", "depth"))
    return levels.select("group", F.col("block").alias("place"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.expr("element_at(levels, -1)[0]").alias("digest"))


class _Tree:
    """Blocks of all rounds over groups of nodes, and the root of each group."""

    def __init__(self, nodes: DataFrame, more: Sequence[str] = ()):
        self.rounds: list[DataFrame] = []
        roots = None
        while True:
            blocks = written(_blocks(nodes, more).withColumn("depth", _depth(F.col("n"))), "blocks")
            self.rounds.append(blocks)
            nodes, more = written(_roots(blocks), "roots"), ()
            done = nodes.filter("n = 1").select("group", "digest")
            roots = done if roots is None else roots.unionByName(done)
            nodes = nodes.filter("n > 1")
            if nodes.isEmpty():
                break
        self.roots = roots

    def with_paths(self, above: DataFrame) -> DataFrame:
        """The first round's blocks with the columns of ``above``: (group, up, more...), where ``up`` is the
        path of the group's root and becomes that of the block."""
        more = [c for c in above.columns if c not in ("group", "up")]
        known = None  # paths of the blocks of the round above
        for k, blocks in reversed([*enumerate(self.rounds)]):
            own = blocks.filter(F.col("n") <= BLOCK).join(above, "group")  # one block a group
            if known is not None:
                own = own.unionByName(blocks.filter(F.col("n") > BLOCK).join(known, ["group", "block"]))
            if k == 0:
                return own
            known = written(_each(own, more, {"block": "node.place", "up": "path"}).select("group", "block", "up", *more), "paths")
        raise AssertionError("a tree has a round")


def _each(blocks: DataFrame, more: Sequence[str], values: dict[str, str]) -> DataFrame:
    """A row for each node: group, the columns ``more`` of its block, and ``values``, expressions over node and
    path. They are made inside the block, so that its levels are not copied to its nodes."""
    levels = blocks.withColumn("digests", F.expr("nodes.digest")).withColumn("levels", collapsed("digests", "depth"))
    made = ", ".join(f"{of} as {name}" for name, of in values.items())
    each = f"transform(nodes, (node, at) -> transform(array(concat({path_in('levels', 'at')}, up)), path -> struct({made}))[0])"
    return levels.select("group", *more, F.explode(F.expr(each)).alias("made")).select("group", *more, "made.*")


def merkle_manifest(documents: DataFrame, columns: Sequence[str], keep: Sequence[str], order: str = "doc_id", source: str = "source", against: Column | None = None) -> DataFrame:
    """A row for each row of ``documents``: the columns named in ``keep``, then leaf, subroot (its source's
    root), root, proof_sha256 (of the siblings on its path), folded_root and verified (folded_root = root).

    A leaf is the digest of ``columns``. ``against`` is a digest made in another way of the same row, of a
    copy that is to be checked (by default the leaf): folded_root is what it and the path give. Rows of a
    source stand by ``order``, nulls first, rows that tie by leaf; equal rows stand next to each other in any
    order. A null source is a source of its own and comes first. A source of one row has its leaf as root, one
    source its root as the whole's. An empty table gives an empty table. Kept columns may have any names.
    """
    own = leaf([F.col(f"`{c}`") for c in columns])
    of = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct()
    rows = documents.select(kept.alias("row"), of.alias("group"), F.col(f"`{order}`").alias("order"), own.alias("digest"), (F.lit(None).cast("string") if against is None else F.when(against != own, against)).alias("now"), F.monotonically_increasing_id().alias("number"))
    leaves = _Tree(numbered(written(rows, "leaves"), "group", ["order", "digest", "number"]), ["row", "now"])
    # the sources' roots are one more tree, of one group
    tree = _Tree(numbered(leaves.roots.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), "group", ["of"]), ["of"])
    top = tree.roots.select("group", F.expr(f"cast(array() as {_PATH})").alias("up"), F.col("digest").alias("root"))
    sources = _each(tree.with_paths(top), ["root"], {"of": "node.of", "subroot": "node.digest", "up": "path"}).drop("group").withColumnRenamed("of", "group")
    more = ["root", "subroot"]
    values = {"row": "node.row", "leaf": "node.digest", "proof_sha256": proof("path"), "folded_root": folded("coalesce(node.now, node.digest)", "path")}
    each = _each(leaves.with_paths(written(sources, "sources")), more, values)
    return each.select("row.*", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
