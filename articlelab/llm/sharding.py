"""K-d tree sharding by distributed weighted medians (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.llm.common import materialize, text_or_empty

#: A dimension is laid on this many steps, the rest of a key is a hash.
STEPS_BITS, TIE_BITS = 20, 30
#: Bits of a key that one histogram pass settles.
PASS_BITS = 10
#: Rows of a shard numbered by one task.
SLOT_ROWS = 50_000


def _category(c: Column) -> Column:
    """A place in [0, 1) for a category: the upper bits of its hash."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(
        F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("double") / float(1 << 20))


def default_dimensions(columns: list[str]) -> dict[str, Column]:
    """Metadata dimensions: log2 of the size, language and source. Null counts as 0."""
    dims = {"size": F.log2(F.col("_size").cast("double"))}
    for name in ("lang", "source"):
        if name in columns:
            dims[name] = _category(F.col(name))
    return dims


def _cuts(points: DataFrame, chosen: DataFrame) -> list:
    """Weighted medians of all nodes at once: histograms of key prefixes,
    ``PASS_BITS`` at a time, until a cut is one key. ``points``: node, key (of the
    node's dimension), bytes. ``chosen``: node, share that goes left, total.
    Returns (node, cut key, bytes at or below it, bytes below it)."""
    spark = points.sparkSession
    bits = STEPS_BITS + TIE_BITS
    state = {r["_node"]: {"want": r["_share"] * r["_total"], "low": 0, "below": 0, "at": 0} for r in chosen.collect()}
    shift = bits
    while shift > 0:
        shift -= min(PASS_BITS, shift)
        at = spark.createDataFrame([(n, s["low"]) for n, s in state.items()], "_cn long, _prefix long")
        part = points.join(F.broadcast(at), F.col("_node") == F.col("_cn")).filter(
            F.shiftrightunsigned("_key", min(shift + PASS_BITS, bits)) == F.col("_prefix"))
        seen = part.groupBy("_node", F.shiftrightunsigned("_key", shift).alias("_b")).agg(
            F.sum("_bytes").alias("_sum")).orderBy("_node", "_b").collect()
        for n, s in state.items():
            mine = [(r["_b"], r["_sum"]) for r in seen if r["_node"] == n]
            run = s["below"]
            for i, (b, w) in enumerate(mine):
                if run + w >= s["want"] or i == len(mine) - 1:
                    s |= {"low": b, "below": run, "at": w}
                    break
                run += w
    return [(n, s["low"], s["below"] + s["at"], s["below"]) for n, s in state.items()]


def kd_leaves(points: DataFrame, dims: list[str], n_leaves: int) -> DataFrame:
    """``points`` (any columns, ``_bytes``, one double column per dimension and
    ``_tie``, a hash) with ``_leaf`` in 0..n_leaves-1.

    Every node is split at the weighted median (or at the share of its leaves
    that go left) along its widest dimension, width relative to the whole
    table's. A point is never cut: it goes to the side that it overfills less;
    if that misses the share by more than 1% of a leaf, the next wider
    dimension is tried and the closest is taken. One level of the tree is a
    few aggregations over all its nodes at once; what returns to the driver is
    the tree and, per node, histograms of at most 2**PASS_BITS sums."""
    spark = points.sparkSession
    whole = points.agg(F.sum("_bytes").alias("_total"), *[F.min(d).alias(f"_lo_{d}") for d in dims],
                       *[F.max(d).alias(f"_hi_{d}") for d in dims]).first()
    if whole["_total"] is None:
        return points.withColumn("_leaf", F.lit(0))
    span = {d: (whole[f"_hi_{d}"] - whole[f"_lo_{d}"]) or 1.0 for d in dims}
    top = (1 << STEPS_BITS) - 1

    def key(d: str) -> Column:
        step = F.floor((F.col(d) - F.lit(whole[f"_lo_{d}"])) / F.lit(span[d]) * F.lit(top)).cast("long")
        return F.shiftleft(step, TIE_BITS) + F.pmod(F.xxhash64(F.lit(d), "_tie"), F.lit(1 << TIE_BITS))

    keyed = points.select("*", *[key(d).alias(f"_key_{d}") for d in dims])
    # node id -> (first leaf, number of leaves)
    open_nodes, done = {1: (0, n_leaves)}, {}
    keyed = materialize(keyed.withColumn("_node", F.lit(1).cast("long")), "kd-level")
    while any(k > 1 for _, k in open_nodes.values()):
        for n in [n for n, (_, k) in open_nodes.items() if k == 1]:
            done[n] = open_nodes.pop(n)
        live = keyed.filter(F.col("_node").isin(list(open_nodes)))
        facts = {r["_node"]: r for r in live.groupBy("_node").agg(
            F.sum("_bytes").alias("_total"), *[F.min(d).alias(f"_lo_{d}") for d in dims],
            *[F.max(d).alias(f"_hi_{d}") for d in dims]).collect()}
        ranked = {n: sorted(dims, key=lambda d: (-(facts[n][f"_hi_{d}"] - facts[n][f"_lo_{d}"]) / span[d], dims.index(d)))
                  for n in facts}
        best: dict = {}
        for attempt in range(len(dims)):
            todo = [n for n in facts if n not in best or best[n][0] > 0.01 * facts[n]["_total"] / open_nodes[n][1]]
            if not todo:
                break
            pick = F.coalesce(*[F.when(F.col("_node") == n, F.col(f"_key_{ranked[n][attempt]}")) for n in todo])
            part = live.filter(F.col("_node").isin(todo)).select("_node", pick.alias("_key"), "_bytes")
            asked = spark.createDataFrame(
                [(n, (open_nodes[n][1] // 2) / open_nodes[n][1], facts[n]["_total"]) for n in todo],
                "_node long, _share double, _total long")
            for n, cut, upto, below in _cuts(part, asked):
                want = (open_nodes[n][1] // 2) / open_nodes[n][1] * facts[n]["_total"]
                miss, cut = min((abs(upto - want), cut), (abs(below - want), cut - 1))
                if n not in best or miss < best[n][0]:
                    best[n] = (miss, ranked[n][attempt], cut)
        right = F.coalesce(*[F.when(F.col("_node") == n, F.col(f"_key_{d}") > F.lit(cut)) for n, (_, d, cut) in best.items()],
                           F.lit(None).cast("boolean"))
        keyed = keyed.withColumn("_node", F.when(right.isNull(), F.col("_node")).otherwise(
            F.col("_node") * 2 + right.cast("long")))
        keyed = materialize(keyed, "kd-level")
        nxt = {}
        for n, (first, k) in open_nodes.items():
            nxt[2 * n], nxt[2 * n + 1] = (first, k // 2), (first + k // 2, k - k // 2)
        open_nodes = nxt
    done |= open_nodes
    leaf = F.coalesce(*[F.when(F.col("_node") == n, F.lit(first)) for n, (first, _) in done.items()])
    return keyed.withColumn("_leaf", leaf.cast("int")).drop("_node", *[f"_key_{d}" for d in dims])


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None,
              target_bytes: int | None = None, dims: dict[str, Column] | None = None,
              whole_group_share: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    Leaves of the tree are the shards: ``n_shards``, or as many as bring the
    mean to ``target_bytes``. A point of the tree is a group of equal texts
    with its summed bytes (pre-aggregated, so copies of a text are one row), and
    equal texts share a shard. Only a group over ``whole_group_share`` of a leaf
    is cut, into points of a sixteenth of that, by its ids: whole it would break
    the law of near-equal bytes. Slots number a shard's documents from 0 by
    buckets of about ``SLOT_ROWS`` rows, so no task sees a whole shard.

    Size: UTF-8 bytes plus 1; null text has size 1 and counts as empty. Null
    metadata sits at 0 of its dimension. Repeated rows are rows of their own.
    An empty table gives no rows; extra columns are not read."""
    dims = default_dimensions(docs.columns) if dims is None else dims
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).cast("long").alias("_crc"), F.md5(text.cast("binary")).alias("_group"),
        *[F.col(c) for c in ("lang", "source") if c in docs.columns])
    rows = rows.select("_id", "_size", "_crc", "_group", *[F.coalesce(d, F.lit(0.0)).alias(f"d_{k}") for k, d in dims.items()])
    rows = materialize(rows, "kd-rows")
    total = rows.agg(F.sum("_size"), F.count(F.lit(1))).first()
    if n_shards is None:
        n_shards = max(1, math.ceil((total[0] or 0) / (target_bytes or 1 << 28)))
    names = [f"d_{k}" for k in dims]
    leaf_bytes = (total[0] or 0) / n_shards
    groups = rows.groupBy("_group").agg(F.sum("_size").alias("_all"), *[F.min(d).alias(d) for d in names])
    pieces = F.when(F.col("_all") > F.lit(whole_group_share * leaf_bytes),
                    F.ceil(F.col("_all") / F.lit(max(1.0, whole_group_share * leaf_bytes / 16)))).otherwise(F.lit(1)).cast("long")
    groups = materialize(groups.withColumn("_pieces", pieces), "kd-groups")
    cut = groups.filter("_pieces > 1").select(F.col("_group").alias("_cg"), F.col("_pieces").alias("_cp"))
    # fewer than 16 * n_shards / whole_group_share groups can be that large
    rows = rows.join(F.broadcast(cut), F.col("_group") == F.col("_cg"), "left").withColumn(
        "_piece", F.when(F.col("_cp").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("_id"), F.col("_cp")))).drop("_cg", "_cp")
    points = rows.groupBy("_group", "_piece").agg(F.sum("_size").alias("_bytes"), *[F.min(d).alias(d) for d in names]).withColumn(
        "_tie", F.concat_ws(":", "_group", "_piece"))
    leaves = kd_leaves(points, names, n_shards).select(F.col("_group").alias("_g"), F.col("_piece").alias("_p"), "_leaf")
    placed = rows.join(leaves, (F.col("_group") == F.col("_g")) & (F.col("_piece") == F.col("_p"))).select(
        "_id", "_size", "_crc", F.col("_leaf").alias("_shard"))
    buckets = max(32, math.ceil((total[1] or 0) / n_shards / SLOT_ROWS))
    placed = materialize(placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_crc"), F.lit(buckets))), "kd-placed")
    before = Window.partitionBy("_bs").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(F.col("_shard").alias("_bs"), F.col("_bucket").alias("_bb")).agg(
        F.count(F.lit(1)).alias("_n")).select("_bs", "_bb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy(F.col("_id").asc_nulls_last(), "_crc", "_size")
    numbered = placed.withColumn("_rank", F.row_number().over(inside))
    out = numbered.join(offsets, (F.col("_shard") == F.col("_bs")) & (F.col("_bucket") == F.col("_bb")))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                      F.col("_shard").cast("int").alias("shard"),
                      (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"))
