"""Merkle dataset manifest by time-forward processing.

Every node of the tree has a label (level, place) that grows towards the root. A
sweep in label order keeps digests under way in a priority queue keyed by the
label of the node that needs them: a node takes its children's digests from the
head of the queue and puts its own in for its parent. The reversed sweep sends
each node its proof suffix, from the root down to the leaves.

The queue is external: labels are cut into blocks of ``2**BLOCK_BITS`` places, a
task sweeps one block with a heap of that size, and what crosses blocks (one
digest up, one suffix down per block) is a written table that Spark's sort hands
to the blocks of the next round. No task holds more than one block, whatever the
size of a group."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from articlelab.llm.common import materialize, small_lookup

#: Places of a block, as a power of two (a heap and a task's rows are bounded by it).
BLOCK_BITS = 12


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# --- sweeps over one block -------------------------------------------------

def levels_of(total: int, bits: int) -> int:
    """Levels that a block's sweep climbs: to its root, or to the only node left."""
    return min(bits, max(total - 1, 0).bit_length())


def sweep_up(digests: list[str], climb: int) -> dict[tuple[int, int], str]:
    """Digests of a block's nodes by label. Messages travel in a heap ordered by
    the receiver's label, then by the child's place."""
    known = {(0, i): d for i, d in enumerate(digests)}
    queue = [((1, i // 2), i, d) for i, d in enumerate(digests)] if climb else []
    heapq.heapify(queue)
    while queue:
        label = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        level, place = label
        known[label] = digest = _hash(children)
        if level < climb:
            heapq.heappush(queue, ((level + 1, place // 2), place, digest))
    return known


def sweep_down(known: dict[tuple[int, int], str], width: int, climb: int, suffix: list[str]) -> list[list[str]]:
    """Proof of each of a block's ``width`` first nodes as steps (`L` or `R` with
    the sibling on that side, or `-` without one), nearest first; ``suffix`` is
    that of the block's root. Labels leave the heap from the root down."""
    proofs: list[list[str]] = [[]] * width
    queue = [(-climb, 0, suffix)]
    while queue:
        level, place, below = heapq.heappop(queue)
        if not level:
            proofs[place] = below
            continue
        for child in (2 * place, 2 * place + 1):
            if (-level - 1, child) in known:
                beside = known.get((-level - 1, child ^ 1))
                step = "-" if beside is None else ("L" if child & 1 else "R") + beside
                heapq.heappush(queue, (level + 1, child, [step, *below]))
    return proofs


def fold(digest: str, steps: list[str]) -> str:
    """The root that a node's digest and its proof lead to."""
    for s in steps:
        digest = _hash([s[1:], digest] if s[0] == "L" else [digest, s[1:]] if s[0] == "R" else [digest])
    return digest


# --- rounds ----------------------------------------------------------------

def ranked(nodes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` (place in its group of ``by`` by ``order``, from 0) and
    ``total``. Rows are sorted over ranges of (group, order, salt), so equal
    rows of any number are spread, and written; a place is the row's place in its
    range plus the group's rows in earlier ranges."""
    salted = nodes.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [*by, *order, "_salt"]
    laid = materialize(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn(
        "_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "manifest-order")
    group = Window.partitionBy(*by)
    spans = laid.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*by, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("total"))
    return small_lookup(laid, spans, [*by, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


NODE = "g string, pos long, total long, digest string"
SUFFIX = "g string, pos long, steps array<string>, subroot string"


def _by_block(df: DataFrame, bits: int) -> DataFrame:
    """Rows of a block (g, pos >> bits) together, in order; Spark's sort is the queue between blocks."""
    return df.withColumn("b", F.shiftright("pos", bits)).repartition("g", "b").sortWithinPartitions("g", "b", "pos")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows with equal (g, b), over the borders of batches."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and (row["g"], row["b"]) != (run[0]["g"], run[0]["b"]):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def climb_blocks(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Roots of the blocks of ``nodes``: the nodes of the next round. A group of
    one node stays as it is."""
    def run(batches):
        for block in _runs(batches):
            total = block[0]["total"]
            climb = levels_of(total, bits)
            known = sweep_up([r["digest"] for r in block], climb)
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([block[0]["g"]], pa.string()), "pos": pa.array([block[0]["b"]], pa.int64()),
                "total": pa.array([-(-total >> bits)], pa.int64()), "digest": pa.array([known[climb, 0]], pa.string())})

    return _by_block(nodes.select("g", "pos", "total", "digest"), bits).mapInArrow(run, NODE)


def rounds(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """``nodes`` and the nodes of each further round, up to one per group (written tables)."""
    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0]
    while most and most > 1:
        out.append(materialize(climb_blocks(out[-1], bits), "manifest-round"))
        most = -(-most >> bits)
    return out


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, bits: int) -> DataFrame:
    """A round's nodes and, before the nodes of each block, its root's suffix."""
    up = suffixes.select("g", F.col("pos").alias("b"), F.lit(-1).cast("long").alias("pos"), "steps", "subroot")
    both = nodes.withColumn("b", F.shiftright("pos", bits)).unionByName(up, allowMissingColumns=True)
    return both.repartition("g", "b").sortWithinPartitions("g", "b", "pos")


def _proofs(block: list[dict], bits: int) -> tuple[list[dict], list[list[str]]]:
    """A block's nodes (its first row is the suffix of its root) and their proofs."""
    head, nodes = block[0], block[1:]
    climb = levels_of(nodes[0]["total"], bits)
    known = sweep_up([r["digest"] for r in nodes], climb)
    return nodes, sweep_down(known, len(nodes), climb, head["steps"])


def descend(nodes: DataFrame, suffixes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Suffixes (``SUFFIX``) of a round's ``nodes`` from those of their blocks' roots."""
    def run(batches):
        for block in _runs(batches):
            rows, proofs = _proofs(block, bits)
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([r["g"] for r in rows], pa.string()), "pos": pa.array([r["pos"] for r in rows], pa.int64()),
                "steps": pa.array(proofs, pa.list_(pa.string())), "subroot": pa.array([block[0]["subroot"]] * len(rows), pa.string())})

    return _with_suffixes(nodes.select("g", "pos", "total", "digest"), suffixes, bits).mapInArrow(run, SUFFIX)


def all_suffixes(tables: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """Suffixes of the blocks of the first round, ``top`` being those of the last round's roots."""
    for nodes in reversed(tables[1:]):
        top = materialize(descend(nodes, top, bits), "manifest-suffix")
    return top


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
             changed: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """Merkle manifest of ``docs`` and a check of every row against it:
    ``<id>, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of ``columns`` in that order; leaves of a group ascend
    by id (null first; equal ids by digest; equal rows are leaves of their own),
    groups by their text bytewise (null first, a group of its own).
    ``changed`` holds, by column, what is found when the manifest is verified
    (default: nothing changed): ``folded_root`` is what the row as found and the
    original siblings lead to, ``verified`` whether that is the root. An empty
    table gives no rows; any column may hold nulls, further columns are not read.

    The leaves are shuffled three times (digests and ids only, never texts):
    sorted, swept up and swept down; all other tables are smaller by the block size."""
    spark = docs.sparkSession
    changed = changed or {}
    kind = docs.schema[id_col].dataType.simpleString()
    found = [changed.get(c, F.col(c)) for c in columns]
    leaf = leaf_digest([F.col(c) for c in columns])
    leaves = materialize(docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"), leaf.alias("digest"),
                         (F.when(leaf != (again := leaf_digest(found)), again) if changed else F.lit(None).cast("string")).alias("found")), "manifest-digests")
    own = rounds(materialize(ranked(leaves, ["g"], ["id", "digest"]), "manifest-leaves"), bits)
    out = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    subroots = own[-1].select("g", F.col("digest").alias("subroot"))
    top = rounds(materialize(ranked(subroots.select("g", F.col("subroot").alias("digest")), [], ["g"]).select(
        F.col("g").alias("group"), F.lit("").alias("g"), "pos", "total", "digest"), "manifest-groups"), bits)
    root = top[-1].select("digest").first()
    if root is None:
        return spark.createDataFrame([], out)
    root = root[0]
    start = spark.createDataFrame([("", 0, [], None)], SUFFIX)
    by_group = descend(top[0], all_suffixes(top, start, bits), bits).select("pos", "steps")
    group_tops = materialize(top[0].select("group", "pos", "digest").join(by_group, "pos").select(
        F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot")), "manifest-tops")

    def verify(batches):
        for block in _runs(batches):
            rows, proofs = _proofs(block, bits)
            folded = [fold(r["found"] or r["digest"], p) for r, p in zip(rows, proofs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["id"] for r in rows], schema.field("id").type), pa.array([r["digest"] for r in rows], pa.string()),
                pa.array([block[0]["subroot"]] * len(rows), pa.string()), pa.array([root] * len(rows), pa.string()),
                pa.array([_hash([s[1:] for s in p]) for p in proofs], pa.string()), pa.array(folded, pa.string()),
                pa.array([f == root for f in folded], pa.bool_())],
                names=[id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    last = _with_suffixes(own[0], all_suffixes(own, group_tops, bits), bits)
    schema = to_arrow_schema(last.schema)
    return last.mapInArrow(verify, out)
