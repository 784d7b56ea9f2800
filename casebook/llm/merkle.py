"""Merkle manifest of a dataset: a tree for each group of rows, one tree over the groups, and a proof for every row.

Trees have ``ARITY`` children a node.  While several nodes remain, each run of consecutive ones (the last may be shorter, even one)
becomes the hash of its concatenated hex digests.  A proof lists, level by level up to the root of all, the siblings left and right of the path.

A tree is cut into aligned blocks of ``BLOCK`` nodes.  The first pass hashes each block to its root;
the roots are the nodes of the next, smaller table, until one node is left of every tree, and
the trees' roots are the nodes of one more tree.  Proofs come from the top down: a block gets the proof of its root
as one row in front of its nodes, ``Traversal`` emits the path of each node within the block, and both are joined.

Positions are counted over a range-partitioned sort, so that no group, however large, is sorted in one task;
nothing but the root of all reaches the driver.

Cases: null columns are hashed as ``-``; rows of a null group form a tree of their own, the first; rows that
repeat an id are leaves each, ordered by their digests; null ids come first; a group of one row is its leaf;
no rows give no proofs; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

ARITY = 16
#: Levels within a block, and nodes that make a block.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Rows that a task sorts, some 100 bytes each.
PART_ROWS = 1 << 19
#: Bytes of proofs in a batch.
BATCH_BYTES = 4 << 20
_PATH = "array<struct<left:string,right:string>>"
_IN_TASK = (1 << 33) - 1


def digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Run:
    """Siblings of one level, grown from leaves one at a time; of each lower level only the unfinished run is held."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def _up(self, k: int) -> None:
        self.open[k + 1].append(digest(self.open[k]))
        self.open[k] = []

    def add(self, leaf: str) -> None:
        self.open[0].append(leaf)
        for k in range(len(self.open) - 1):
            if len(self.open[k]) < ARITY:
                break
            self._up(k)

    def close(self) -> list[str]:
        """The siblings, once no leaf is left for them."""
        for k in range(len(self.open) - 1):
            if self.open[k]:
                self._up(k)
        return self.open[-1]


class Traversal:
    """Paths of the leaves of one block, in order.

    Of every level one subtree exists, the run that holds the current path, and another is desired, the run after it.
    A step adds one leaf to each desired run, which so is finished just when the path enters it.  Runs are
    all that is held besides the leaves: two for each level.
    """

    def __init__(self, leaves: Sequence[str], levels: int):
        self.leaves, self.levels = leaves, levels
        whole = [Run(k) for k in range(levels)]
        for k, run in enumerate(whole):
            for leaf in leaves[: ARITY ** (k + 1)]:
                run.add(leaf)
        self.existing = [run.close() for run in whole]
        self.desired = [Run(k) for k in range(levels)]

    def root(self) -> str:
        return digest(self.existing[-1]) if self.levels else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf, from the lowest level up, the digests left and right of the path."""
        joined = ["".join(run) for run in self.existing]
        for i in range(len(self.leaves)):
            path = []
            for k in range(self.levels):
                at = (i // ARITY**k) % ARITY * 64
                path.append((joined[k][:at], joined[k][at + 64 :]))
            yield path
            for k in range(self.levels):
                ahead = i + ARITY ** (k + 1)
                if ahead < len(self.leaves):
                    self.desired[k].add(self.leaves[ahead])
                if (i + 1) % ARITY ** (k + 1) == 0:
                    self.existing[k], self.desired[k] = self.desired[k].close(), Run(k)
                    joined[k] = "".join(self.existing[k])


def hashed(columns: Sequence[Column]) -> Column:
    """Hex digest of values as text: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _parts(spark: SparkSession, size: int) -> int:
    return max(store.partitions(spark), store.parts(size, PART_ROWS))


def _placed(rows: DataFrame, size: int, order: list[str], scratch: store.Scratch) -> DataFrame:
    """``rows``, ``size`` of them, with ``pos``, their place in their tree by ``order``, and ``n``, the tree's rows.  Equal rows keep any order."""
    keys = ["tree", *order, "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(_parts(rows.sparkSession, size), *keys).sortWithinPartitions(*keys).drop("row")
    cut = scratch.store(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))}), "sorted")
    counts = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    shift = counts.select("tree", "part", (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return cut.join(shift, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.Table]]:
    """Rows of each (tree, block), which come one after another, with the names of their columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        tree, block = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        a = 0
        for i, key in enumerate(zip(tree, block, strict=True)):
            if key != last:
                if last is not None and (held or i > a):
                    yield batch.schema.names, pa.Table.from_batches([*held, batch.slice(a, i - a)])
                held, a, last = [], i, key
        held.append(batch.slice(a))
    if last is not None:
        yield held[0].schema.names, pa.Table.from_batches(held)


def _levels(n: int) -> int:
    """Levels within a block of a tree of ``n`` nodes."""
    return min(LEVELS, height(n))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root of each block, as a node of the next table."""
    for _, rows in _blocks(batches):
        n = rows.column("n")[0].as_py()
        top = Run(_levels(n))
        for leaf in rows.column("node").to_pylist():
            top.add(leaf.hex())
        yield pa.RecordBatch.from_pydict({"tree": rows.column("tree")[:1].combine_chunks(), "pos": rows.column("block")[:1].combine_chunks(), "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": pa.array([bytes.fromhex(top.close()[0])], pa.binary())})


def _path_array(paths: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [side for path in paths for side in path]
    ends = [0]
    for path in paths:
        ends.append(ends[-1] + len(path))
    sides = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)


def _proved(carried: list[str]):
    """Proof of each node: its path within the block, then the upper proof that leads the block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, rows in _blocks(batches):
            upper = [(s["left"], s["right"]) for s in rows.column("path")[0].as_py()]
            subroot = rows.column("subroot")[0].as_py()
            rows = rows.slice(1).combine_chunks()
            leaves = [leaf.hex() for leaf in rows.column("node").to_pylist()]
            if not leaves:
                continue
            kept = [c for c in names if c in carried]
            each = max(1, BATCH_BYTES // (64 * ARITY * (LEVELS + 1) + sum(len(a) + len(b) for a, b in upper)))
            a, paths = 0, []
            for path in Traversal(leaves, _levels(rows.column("n")[0].as_py())).paths():
                paths.append(path + upper)
                if len(paths) == each or a + len(paths) == len(leaves):
                    part = rows.slice(a, len(paths))
                    out = {c: part.column(c).combine_chunks() for c in kept}
                    out |= {"node": pa.array(leaves[a : a + len(paths)], pa.string()), "path": _path_array(paths), "subroot": pa.array([subroot] * len(paths), pa.string())}
                    yield pa.RecordBatch.from_pydict(out)
                    a, paths = a + len(paths), []

    return run


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(BLOCK)).cast("long"))


def _climbed(nodes: DataFrame, size: int, scratch: store.Scratch) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Tables of nodes, with their sizes, from ``nodes`` (tree, pos, n, node) up, and the root of every tree (tree, subroot)."""
    tables, done = [(nodes, size)], []
    while size:
        below = _in_blocks(tables[-1][0]).select("tree", "block", "pos", "n", "node")
        grouped = below.repartition(_parts(nodes.sparkSession, size), "tree", "block").sortWithinPartitions("tree", "block", "pos")
        roots = scratch.store(grouped.mapInArrow(_roots, "tree string, pos long, n long, node binary"), "roots")
        done.append(roots.where("n = 1").select("tree", F.lower(F.hex("node")).alias("subroot")))
        rest = roots.where("n > 1")
        size = rest.count()
        if size:
            tables.append((rest, size))
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return tables, roots


def _descended(tables: list[tuple[DataFrame, int]], tops: DataFrame, carried: list[str], scratch: store.Scratch) -> DataFrame:
    """Proofs (node as hex, path, subroot and the ``carried`` columns) of the nodes of the lowest table.

    ``tops`` (tree, path, subroot) has the proof of each tree's root.
    """
    above: DataFrame | None = None
    for k in reversed(range(len(tables))):
        keep = carried if k == 0 else ["tree", "pos"]
        nodes = _in_blocks(tables[k][0])
        lead = tops.join(nodes.where(f"pos = 0 and n <= {BLOCK}").select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if above is not None:
            lead = lead.union(above.select("tree", F.col("pos").alias("block"), "path", "subroot"))
        rows = nodes.select("*", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot")).unionByName(lead.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
        grouped = rows.repartition(_parts(nodes.sparkSession, tables[k][1]), "tree", "block").sortWithinPartitions("tree", "block", "pos")
        above = grouped.mapInArrow(_proved(keep), ", ".join([*fields, "node string", f"path {_PATH}", "subroot string"]))
        if k:
            above = scratch.store(above, "proofs")
    return above


def prove(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", claimed: Column | None = None) -> DataFrame:
    """One row for each of ``docs``: ``id`` (its ``order``), ``leaf``, ``claimed`` (digest of the row's columns as
    ``claimed`` has them, null where it is null), ``path`` (left and right siblings, lowest level first), ``subroot`` of its group, and ``root``.
    """
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "merkle")
    group_key = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))  # null is first, other texts in order of bytes
    rows = docs.select(group_key.alias("tree"), F.col(order).alias("id"), F.unhex(hashed([F.col(c) for c in columns])).alias("node"), F.unhex(claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed"))
    rows = scratch.store(rows, "leaves")
    size = rows.count()
    if not size:
        empty = f"id {rows.schema['id'].dataType.simpleString()}, leaf string, claimed string, path {_PATH}, subroot string, root string"
        return spark.createDataFrame([], empty)
    tables, subroots = _climbed(_placed(rows, size, ["id", "node"], scratch), size, scratch)
    # the trees' roots are the leaves of one tree
    subroots = scratch.store(subroots, "subroots")
    size = subroots.count()
    groups = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.unhex("subroot").alias("node")), size, ["member"], scratch)
    upper, top = _climbed(groups, size, scratch)
    root = top.first()["subroot"]
    summit = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"), F.lit(root).alias("subroot"))
    of_groups = scratch.store(_descended(upper, summit, ["member"], scratch).select(F.col("member").alias("tree"), "path", F.col("node").alias("subroot")), "groups")
    proofs = _descended(tables, of_groups, ["id", "claimed"], scratch)
    return proofs.select("id", F.col("node").alias("leaf"), F.lower(F.hex("claimed")).alias("claimed"), "path", "subroot", F.lit(root).alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """Root that ``leaf`` leads to over the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, lowest level first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_leaf(columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Digest of a row whose text has its A-Z lower-cased, for one row in five by its id; null for all others."""
    lowered = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, hashed([lowered if c == text_col else F.col(c) for c in columns]))


def verified(proofs: DataFrame) -> DataFrame:
    """doc_id, digests of the proof, and whether the claimed row, or the row itself, leads to the root."""
    again = proofs.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return again.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
