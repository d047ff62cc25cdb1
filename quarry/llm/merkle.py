"""Merkle manifest of a table: a leaf for each row, a tree for each group, one root, and every leaf's proof.

A leaf is the SHA-256 of a row's fields, computed by DataFrame functions where the text is read; only
digests travel. Leaves of a group (``lang``) ascend by (doc_id, leaf); nodes pair off level by level,
and a last node without a partner is hashed alone. The groups' roots form one more tree of that kind.

A tree is cut into aligned blocks of ``2 ** BLOCK_BITS`` leaves, whose roots are the leaves of the next
layer, and so on up to one root. From the top layer down, each block then gets the path of its own root
as a header row, and a Merkle traversal walks its leaves: one treehash stack for each height prepares
the next authentication node of that height, the stack with the lowest tail is served first, and two
steps a height and leaf suffice, so beside the block's leaves (at most 256) only a logarithmic number of
nodes is held. The block's path and the shared upper path together are a leaf's proof.

Null fields hash as ``-``. A null group comes first, a null doc_id comes first in its group. Rows equal
in all fields have equal leaves and stand next to each other. Long and empty texts are like others. An
empty table gives no rows. Other columns pass through; the operator's own replace those of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BLOCK_BITS = 8
PART_BITS = 33  # of monotonically_increasing_id(), below the partition's number
OWN = ("leaf", "proof", "subroot", "root")
PROOF = T.ArrayType(T.StructType([T.StructField("sibling", T.StringType()), T.StructField("left", T.BooleanType())]))
Node = bytes | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as hashed: its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column | None = None) -> Column:
    """A document's leaf, or that of the same document with another ``n_chars``."""
    n_chars = F.col("n_chars") if n_chars is None else n_chars
    return digest(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))


def joined(a: Node, b: Node) -> Node:
    """The parent of two nodes; of one, where the right one is absent; none, where both are."""
    return None if a is None else hashlib.sha256(a if b is None else a + b).hexdigest().encode()


class Treehash:
    """Builds the node of one height over the leaves from ``start`` on, a step at a time, on a stack."""

    def __init__(self, leaves: list[bytes], height: int, start: int):
        self.leaves, self.height, self.next = leaves, height, start
        self.stack: list[tuple[int, Node]] = []

    @property
    def done(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] == self.height

    @property
    def low(self) -> int:
        """The height of the lowest node held; the tree's own while none is."""
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        """Joins the two topmost nodes if they are of one height, or takes the next leaf."""
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (height, right), (_, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((height + 1, joined(left, right)))
        else:
            self.stack.append((0, self.leaves[self.next] if self.next < len(self.leaves) else None))
            self.next += 1


def block_levels(count: int, bits: int) -> int:
    """Levels of a block of ``2 ** bits`` leaves in a tree with ``count`` nodes in this layer."""
    return min(bits, (count - 1).bit_length())


def block_root(leaves: list[bytes], levels: int) -> bytes:
    top = Treehash(leaves, levels, 0)
    while not top.done:
        top.step()
    return top.stack[-1][1]


def traversal(leaves: list[bytes], levels: int) -> Iterator[list[Node]]:
    """Each leaf's siblings, from its own level up to below the block's root."""
    auth: list[Node] = []
    stacks: list[Treehash] = []
    for h in range(levels):  # leaf 0 needs the second node of each height, later leaves the first
        for at, found in ((0, stacks), (1, None)):
            tree = Treehash(leaves, h, at << h)
            while not tree.done:
                tree.step()
            if found is None:
                auth.append(tree.stack[-1][1])
            else:
                found.append(tree)
    for leaf in range(len(leaves)):
        yield list(auth)
        for h in range(levels):
            if (leaf + 1) % (1 << h) == 0:
                auth[h] = stacks[h].stack[-1][1]
                stacks[h] = Treehash(leaves, h, (leaf + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * levels - 1):
            open_ = [s for s in stacks if not s.done]
            if not open_:
                break
            min(open_, key=lambda s: s.low).step()  # of equal ones the lowest tree


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Whole runs of rows that agree in ``keys``, several at a time; rows arrive sorted by them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        cuts = np.flatnonzero(new)
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            bounds = [0, *map(int, cuts)]
            yield [batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
        rest = batch.slice(last)
    if rest is not None:
        yield [rest]


def _roots(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _runs(batches, ("k_tree", "k_block")):
            tree, at, count, top = [], [], [], []
            for block in runs:
                n = block.column("k_n")[0].as_py()
                tree.append(block.column("k_tree")[0].as_py())
                at.append(block.column("k_block")[0].as_py())
                count.append(-(-n >> bits))
                top.append(block_root([x.encode() for x in block.column("k_hash").to_pylist()], block_levels(n, bits)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(at, pa.int64()), pa.array(count, pa.int64()), pa.array(top)], names=["k_tree", "k_at", "k_n", "k_hash"])

    return run


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("k_block", F.shiftright("k_at", BLOCK_BITS))


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("k_tree", "k_block").sortWithinPartitions("k_tree", "k_block", "k_at")


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (k_tree, k_at, k_n, k_hash), then their blocks' roots, and so on until every tree has one node."""
    layers = [nodes]
    while (layers[-1].agg(F.max("k_n")).first()[0] or 0) > 1:
        cut = _dealt(_blocks(layers[-1].select("k_tree", "k_at", "k_n", "k_hash")))
        layers.append(written(cut.mapInArrow(_roots(BLOCK_BITS), "k_tree string, k_at long, k_n long, k_hash string"), "roots"))
    return layers


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with k_path and k_roots; ``above``: the next layer (k_tree, k_at) with its own."""
    names, bits = nodes.columns, BLOCK_BITS
    heads = above.select("k_tree", F.col("k_at").alias("k_block"), F.lit(-1).cast("long").alias("k_at"), "k_path", "k_roots")
    schema = T.StructType([*nodes.schema.fields, T.StructField("k_path", PROOF), T.StructField("k_roots", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for runs in _runs(batches, ("k_tree", "k_block")):
            for block in runs:
                upper = block.column("k_path")[0].as_py()
                upper_sibling, upper_left = [x["sibling"] for x in upper], [x["left"] for x in upper]
                roots, rows = block.column("k_roots")[0].as_py(), block.slice(1)
                levels = block_levels(rows.column("k_n")[0].as_py(), bits)
                sibling, left = [], []
                for i, own in enumerate(traversal([x.encode() for x in rows.column("k_hash").to_pylist()], levels)):
                    sibling += [x if x is None else x.decode() for x in own]
                    sibling += upper_sibling
                    left += [bool(i >> h & 1) for h in range(levels)]
                    left += upper_left
                n, each = rows.num_rows, levels + len(upper)
                path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.StructArray.from_arrays([pa.array(sibling, pa.string()), pa.array(left, pa.bool_())], ["sibling", "left"]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), path.cast(to_arrow_type(PROOF)), pa.array([roots] * n, pa.list_(pa.string()))], names=[*names, "k_path", "k_roots"])

    both = _blocks(nodes).unionByName(heads, allowMissingColumns=True)
    return _dealt(both).mapInArrow(run, schema)


def _proved(layers: list[DataFrame], outer: DataFrame | None = None) -> DataFrame:
    """The lowest layer with k_path and k_roots (own tree's root, then the outer ones); ``outer``: k_tree, k_path, k_roots."""
    top = layers[-1]
    if outer is None:
        top = top.withColumns({"k_path": F.array().cast(PROOF), "k_roots": F.array("k_hash")})
    else:
        top = top.join(outer, "k_tree").withColumn("k_roots", F.concat(F.array("k_hash"), "k_roots"))
    for nodes in reversed(layers[:-1]):
        top = _with_paths(nodes, top)
    return top


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with k_at, their place in their tree by ``order``, and k_n, the tree's rows.

    Rows are sorted over all partitions at once; a place is that in the partition plus what the tree has
    in the partitions before, so no task sees a whole tree.
    """
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = written(ranged.withColumn("k_row", F.monotonically_increasing_id()), "leaves").withColumn("k_part", F.shiftright("k_row", PART_BITS))
    parts = placed.groupBy(tree, "k_part").agg(F.count("*").alias("k_count"), F.min("k_row").alias("k_first"))
    whole = W.partitionBy(tree)
    parts = parts.select(tree, "k_part", (F.sum("k_count").over(whole.orderBy("k_part")) - F.col("k_count") - F.col("k_first")).alias("k_shift"), F.sum("k_count").over(whole).alias("k_n"))
    return placed.join(parts, [tree, "k_part"]).withColumn("k_at", F.col("k_row") + F.col("k_shift")).drop("k_row", "k_part", "k_shift")


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``rows``, or their columns ``keep``, with leaf, proof, subroot and root.

    A proof has the siblings from the leaf's level up to below the root, and whether they stand left; a
    sibling is null where a node is hashed alone. ``leaf`` is computed once and written with the rows.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c not in OWN]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = written(rows.select(*(F.col(f"`{c}`") for c in keep), tree.alias("k_tree"), F.col(order).alias("k_order"), leaf.alias("k_hash")), "leaf-digests")
    layers = _layers(written(_numbered(leaves, "k_tree", ["k_order", "k_hash"]), "numbered"))
    tops = layers[-1].select(F.lit("").alias("k_tree"), F.col("k_tree").alias("k_order"), "k_hash")
    outer = _proved(_layers(written(_numbered(tops, "k_tree", ["k_order"]), "subroots")))
    outer = outer.select(F.col("k_order").alias("k_tree"), "k_path", "k_roots")
    found = _proved(layers, outer)
    return found.select(
        *(F.col(f"`{c}`") for c in keep), F.col("k_hash").alias("leaf"), F.col("k_path").alias("proof"),
        F.col("k_roots")[0].alias("subroot"), F.col("k_roots")[1].alias("root"),
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.when(x["sibling"].isNull(), h).when(x["left"], F.concat(x["sibling"], h)).otherwise(F.concat(h, x["sibling"])), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: x["sibling"]), ""), 256)


def tampered_proofs(docs: DataFrame, modulus: int = 7, keep: list[str] | None = None) -> DataFrame:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text), with folded_root and verified after tampering.

    Tampering adds 1 to n_chars where ``modulus`` divides the CRC-32 of doc_id in decimal; rows with a null
    id stay as they are, and null n_chars stay null. A tampered row's leaf is computed anew and folded
    with the siblings of the original one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*OWN, "folded_root", "verified")]
    changed = F.crc32(F.col("doc_id").cast("string")) % modulus == 0
    second = F.when(changed, leaf_of(F.col("n_chars").cast("decimal(38,0)") + 1))
    found = manifest(docs.withColumn("k_second", second), leaf_of(), keep=[*keep, "k_second"])
    found = found.withColumn("folded_root", folded(F.coalesce("k_second", "leaf"), F.col("proof"))).drop("k_second")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
