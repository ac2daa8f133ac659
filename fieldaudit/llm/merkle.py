"""Merkle manifest of a table as a persistent tree (operator 11).

Rows are the leaves of one tree per group (``tree``), in order of a key; eight consecutive nodes become their parent until one
node, the subroot, remains, and the subroots in order of their trees become the root in the same way. A change of one leaf makes
a *version*: only the leaf's ancestors are copied, every other node is shared with the tree as it was.

Trees are cut into aligned blocks of ``BLOCK`` leaves. A task builds the persistent tree of a block, and all versions of its
leaves copy their ancestors there; the roots of the blocks are the leaves of the next tables of blocks, each 4096 times smaller,
up to the root. The way from a block to the root (the siblings on it) is worked out once per block and joins the block's leaves
as one more row, so that versions go on above their block without ever meeting in one task.

Positions come from a range sort: a task counts its rows of every tree, and the counts of the tasks before it are added. The
sorted digests are written to the shared folder first, so the ranges stay as they are when executors are lost. Texts are hashed
in the scan; what is shuffled (twice) is the key and one or two digests of 32 bytes.

Defined cases: a null field is ``-`` in the leaf; a null tree comes first, null keys come first in their tree; equal keys are
ordered by their leaf, and rows that agree in both are leaves of their own with one digest; a tree of one leaf is that leaf; an
empty table has no root and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep

ARITY = 8
DEPTH = 4
BLOCK = ARITY ** DEPTH
#: Rows of results go out in parts of so many: a proof takes some 4 KB.
PART = 1024

PATH = "array<struct<before: string, after: string>>"
PATH_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


# The persistent tree of a block. A node is (digest, children); nodes are never changed.

def parent(children: tuple) -> tuple:
    return sha256("".join([c[0] for c in children]).encode()).hexdigest(), children


def build(leaves: list[str], height: int) -> tuple:
    nodes = [(digest, ()) for digest in leaves]
    for _ in range(height):
        nodes = [parent(tuple(nodes[k:k + ARITY])) for k in range(0, len(nodes), ARITY)]
    return nodes[0]


def replaced(node: tuple, place: int, height: int, digest: str) -> tuple:
    """The version of a tree in which one leaf has another digest: copies its ancestors, shares the rest."""
    if not height:
        return digest, ()
    step = ARITY ** (height - 1)
    k, rest = divmod(place, step)
    children = node[1]
    return parent((*children[:k], replaced(children[k], rest, height - 1, digest), *children[k + 1:]))


def digests(node: tuple, place: int, height: int) -> list[str]:
    """The nodes from a leaf to the top."""
    out = [node[0]]
    while height:
        height -= 1
        k, place = divmod(place, ARITY ** height)
        node = node[1][k]
        out.append(node[0])
    return out[::-1]


def siblings(node: tuple, place: int, height: int) -> list[tuple[str, str]]:
    """From a leaf to the top: the digests before and after the own one in each run."""
    out = []
    while height:
        height -= 1
        k, place = divmod(place, ARITY ** height)
        run = [c[0] for c in node[1]]
        out.append(("".join(run[:k]), "".join(run[k + 1:])))
        node = node[1][k]
    return out[::-1]


def height_of(n: int) -> int:
    """Levels of a block in a tree of n leaves."""
    height = 0
    while height < DEPTH and n > ARITY ** height:
        height += 1
    return height


def fold(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """The copies of a changed node's ancestors, by the siblings on the way."""
    out = []
    for before, after in path:
        digest = sha256((before + digest + after).encode()).hexdigest()
        out.append(digest)
    return out


# Positions and blocks.

def positions(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``pos`` (place in the tree, by key and leaf) and ``n`` (leaves of the tree) to rows with (tree, key, leaf, ...)."""
    order = [F.col("tree").asc(), F.col("key").asc_nulls_first(), F.col("leaf").asc()]
    # The last key deals rows that agree in all others; which of them is first makes no difference.
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("tie"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for value in batch.column(0).to_pylist():
                if value != tree:
                    tree, place = value, 0
                places.append(place)
                place += 1
            parts = pa.array([part] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])

    columns = ["tree", *(c for c in rows.columns if c != "tree")]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", part int, place long"
    kept = keep(dealt.sortWithinPartitions(*order).select(*columns).mapInArrow(number, schema), name)
    whole = Window.partitionBy("tree")
    counts = kept.groupBy("tree", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = counts.select("tree", "part", before.alias("first"), F.sum("c").over(whole).alias("n"))
    joined = kept.join(offsets, ["tree", "part"])
    return joined.withColumn("pos", F.col("first") + F.col("place")).drop("part", "place", "first")


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(tree, block, rows) of rows sorted by tree, block (the first two columns): a block is all that is held."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(width))):
            if row[:2] != key:
                if held:
                    yield *key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield *key, held


def dealt_by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def parts(rows: Iterator[tuple], schema: pa.Schema, size: int = PART) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the blocks over leaves (tree, pos, n, leaf)."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for tree, block, held in blocks_of(batches, 5):
                n = held[0][1]
                yield tree, block, -(-n // BLOCK), build([bytes(r[2]).hex() for r in held], height_of(n))[0]

        yield from parts(rows(), schema)

    dealt = dealt_by_block(nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "leaf"))
    return dealt.mapInArrow(roots, "tree string, pos long, n long, digest string")


def ways_up(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, top) of nodes (tree, pos, n, digest): the siblings on the way to the top of the tree, and the top."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("path", PATH_ARROW),
                        ("top", pa.string())])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for tree, block, held in blocks_of(batches, 5):
                n = held[0][1]
                height = height_of(n)
                root = build([r[2] for r in held], height)
                for place, row in enumerate(held):
                    yield tree, block, row[0], n, [{"before": b, "after": a} for b, a in siblings(root, place, height)], root[0]

        yield from parts(rows(), schema)

    dealt = dealt_by_block(nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest"))
    found = keep(dealt.mapInArrow(climb, f"tree string, block long, pos long, n long, path {PATH}, top string"), "merkle-ways")
    if found.where(F.col("n") > BLOCK).isEmpty():
        return found.select("tree", "pos", "path", "top")
    above = ways_up(found.where(F.col("pos") == F.col("block") * BLOCK)
                    .select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("digest")))
    above = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("top").alias("last"))
    return found.join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "rest").alias("path"), F.col("last").alias("top"))


def versions(rows: DataFrame) -> DataFrame:
    """The proofs and versions of rows (tree, key, leaf, changed), tree not null; leaf and changed are digests as binary.

    ``changed`` is null where a leaf stays as it is. Per row: tree, key, leaf, subroot, root, ``path`` (siblings before and after
    on every level, from the leaf to the root) and ``nodes`` (the digests of the version's own nodes, from its leaf to its root).
    """
    leaves = positions(rows.select("tree", "key", "leaf", "changed"), "merkle-leaves")
    ways = ways_up(keep(block_roots(leaves.select("tree", "pos", "n", "leaf")), "merkle-blocks"))
    trees = ways.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("leaf"))
    trees = keep(positions(trees, "merkle-trees").select("tree", "pos", "n", "key", F.col("leaf").alias("digest")), "merkle-subroots")
    top = ways_up(trees.select("tree", "pos", "n", "digest")).select("pos", F.col("path").alias("rest"), F.col("top").alias("root"))
    top = trees.select("pos", F.col("key").alias("tree")).join(top, "pos").drop("pos")
    key = rows.schema["key"].dataType.simpleString()
    heads = ways.join(top, "tree").select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(key).alias("key"),
        F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("changed"), F.concat("path", "rest").alias("path"),
        F.col("top").alias("subroot"), "root")
    body = leaves.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "key", "leaf", "changed", F.lit(None).cast(PATH).alias("path"),
                         F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def results(batches):
            for tree, _, held in blocks_of(batches, 10):
                (*_, path, subroot, root), *held = held
                above = [(step["before"], step["after"]) for step in path]
                height = height_of(held[0][1])
                base = build([bytes(r[3]).hex() for r in held], height)
                for place, (_, _, key, own, changed, *_) in enumerate(held):
                    own = bytes(own).hex()
                    version = replaced(base, place, height, own if changed is None else bytes(changed).hex())
                    nodes = digests(version, place, height)
                    way = siblings(base, place, height) + above
                    yield tree, key, own, subroot, root, [{"before": b, "after": a} for b, a in way], nodes + fold(nodes[-1], above)

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("tree", pa.string()), ("key", first.schema.field(4).type), ("leaf", pa.string()), ("subroot", pa.string()),
                            ("root", pa.string()), ("path", PATH_ARROW), ("nodes", pa.list_(pa.string()))])
        yield from parts(results(_chain(first, batches)), schema)

    return dealt_by_block(body.unionByName(heads)).mapInArrow(
        make, f"tree string, key {key}, leaf string, subroot string, root string, path {PATH}, nodes array<string>")


def _chain(first, rest):
    yield first
    yield from rest


def manifest(df: DataFrame, columns: list[str], tree: str, key: str, changed: dict[str, Column] | None = None,
             where: Column | None = None) -> DataFrame:
    """versions() of a table: leaves of ``columns``; rows that ``where`` names get the values of ``changed`` in their version."""
    own = [F.col(c) for c in columns]
    other = [changed.get(c, F.col(c)) for c in columns] if changed else own
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(tree).cast("string")))
    altered = F.when(where, F.unhex(leaf(*other))) if where is not None else F.lit(None).cast("binary")
    return versions(df.select(name.alias("tree"), F.col(key).alias("key"), F.unhex(leaf(*own)).alias("leaf"), altered.alias("changed")))


def proof(path: Column) -> Column:
    """The digest over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)
