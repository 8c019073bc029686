"""Drainage networks as tables ``(node, next)`` where each node flows to one other.

All reach questions use pointer doubling: after round k every node knows the
node 2^k steps downstream, so a path of length L needs log2(L) joins instead of
L. The state of every round goes to the checkpoint folder, which keeps plans
short and lets a lost executor restart from the last round. Nodes that have
arrived leave the joins, so an outlet that drains a third of the network is not
a hot join key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.operators.polygons import FANOUT, aligned_blocks, nearest_polygons, polygons_within
from pluvion.session import cut_lineage

# Row and column step of each drainage code; 5 is a pit.
LDD_OFFSETS = {
    1: (1, -1), 2: (1, 0), 3: (1, 1), 4: (0, -1), 6: (0, 1), 7: (-1, -1), 8: (-1, 0), 9: (-1, 1),
}
# Power-of-two flow directions (east first, clockwise) and their drainage codes.
D8_TO_LDD = {1: 6, 2: 3, 4: 2, 8: 1, 16: 4, 32: 7, 64: 8, 128: 9, 0: 5, 255: 5}

MAX_ROUNDS = 64


def within_set(edges: DataFrame) -> DataFrame:
    """Targets that are no node of the table count as leaving the network."""
    known = edges.select(F.col("node").alias("next"), F.lit(True).alias("_known"))
    return edges.join(known, "next", "left").select(
        "node", F.when(F.col("_known"), F.col("next")).alias("next"),
        *[c for c in edges.columns if c not in ("node", "next")],
    )


def headwaters(edges: DataFrame) -> DataFrame:
    """Nodes that nothing flows into."""
    return edges.join(edges.select(F.col("next").alias("node")).where("node IS NOT NULL"), "node", "left_anti")


def follow_downstream(edges: DataFrame, stop: Column | None = None) -> DataFrame:
    """``(node, last, hops)``: the end of each node's path.

    A path ends at a node without next or at one where ``stop`` holds. Nodes
    that run into a cycle have no end and get NULL.
    """
    halt = F.col("next").isNull()
    if stop is not None:
        halt = halt | F.coalesce(stop, F.lit(False))
    start = edges.select(
        "node",
        F.when(halt, F.col("node")).otherwise(F.col("next")).alias("last"),
        F.when(halt, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("hops"),
        (~halt).alias("open"),
    )
    state = cut_lineage(start)
    before = None
    for _ in range(MAX_ROUNDS):
        left = state.where("open").count()
        if left == 0 or left == before:
            break
        before = left
        ahead = state.select(
            F.col("node").alias("last"), F.col("last").alias("_last"), F.col("hops").alias("_hops"), F.col("open").alias("_open")
        )
        moved = (
            state.where("open")
            .join(ahead, "last")
            .select("node", F.col("_last").alias("last"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_open").alias("open"))
        )
        state = cut_lineage(state.where(~F.col("open")).unionByName(moved))
    else:
        raise RuntimeError("paths go on after 2^64 steps")
    return state.select(
        "node",
        F.when(~F.col("open"), F.col("last")).alias("last"),
        F.when(~F.col("open"), F.col("hops")).alias("hops"),
    )


_FOLDS = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def fold_upstream(edges: DataFrame, values: dict[str, str], how: str) -> DataFrame:
    """``(node, *names)``: fold of ``values`` (name -> column) over a node and all nodes upstream.

    Sums need a network without cycles and fail otherwise. Minimum and maximum
    also work around cycles and stop as soon as a round changes nothing, which
    is then the fixed point.
    """
    agg, combine = _FOLDS[how]
    names = list(values)
    state = cut_lineage(
        edges.select(
            "node", F.col("next").alias("_p"),
            *[F.coalesce(c, F.lit(0)).alias(n) if how == "sum" else F.col(c).alias(n) for n, c in values.items()],
            F.lit(True).alias("_changed"),
        )
    )
    for _ in range(MAX_ROUNDS):
        open_ = state.where("_p IS NOT NULL")
        done = open_.isEmpty() or (how != "sum" and state.where("_changed").isEmpty())
        if done:
            break
        given = open_.groupBy(F.col("_p").alias("node")).agg(*[agg(n).alias(f"_g_{n}") for n in names])
        hop = open_.select("node", "_p").join(
            open_.select(F.col("node").alias("_p"), F.col("_p").alias("_q")), "_p", "left"
        ).select("node", "_q")
        folded = {n: combine(F.col(n), F.col(f"_g_{n}")) for n in names}
        changed = F.lit(False)
        for n in names:
            changed = changed | ~F.col(n).eqNullSafe(folded[n])
        state = cut_lineage(
            state.select("node", *names)
            .join(given, "node", "left")
            .join(hop, "node", "left")
            .select("node", F.col("_q").alias("_p"), *[f.alias(n) for n, f in folded.items()], changed.alias("_changed"))
        )
    else:
        raise ValueError("the network has a cycle; repair it before summing")
    return state.select("node", *names)


def forest_intervals(edges: DataFrame) -> DataFrame:
    """``(node, enter, leave)``: places of a walk over the network that meets every node before what lies upstream of it.

    The nodes upstream of a node, itself included, are those with ``enter``
    between its ``enter`` and ``leave``, so whether one lies above another is a
    range test and no pair of them is ever listed. Confluences are walked in
    order of their nodes. Three steps: subtree sizes; for each node the sizes of
    those before it at its confluence, as a running sum over the nodes in order;
    and the sum of these along its path by pointer doubling. The network must
    have no cycles.
    """
    sizes = fold_upstream(edges.select("node", "next", F.lit(1).cast("bigint").alias("_one")), {"size": "_one"}, "sum")
    rows = edges.select("node", "next").join(sizes, "node")
    before = running_sum(rows, [F.col("next").asc_nulls_first(), F.col("node")], "size", "_before")
    first = cut_lineage(before.groupBy(F.col("next").alias("_next")).agg(F.min("_before").alias("_first")))
    ahead = before.join(first, F.col("next").eqNullSafe(F.col("_next"))).select(
        "node", "size", F.col("next").alias("_p"), (F.col("_before") - F.col("_first") + F.col("next").isNotNull().cast("bigint")).alias("enter")
    )
    state = cut_lineage(ahead)
    for _ in range(MAX_ROUNDS):
        open_ = state.where("_p IS NOT NULL")
        if open_.isEmpty():
            break
        hop = state.select(F.col("node").alias("_p"), F.col("_p").alias("_q"), F.col("enter").alias("_e"))
        moved = open_.join(hop, "_p", "left").select("node", "size", F.col("_q").alias("_p"), (F.col("enter") + F.coalesce("_e", F.lit(0))).alias("enter"))
        state = cut_lineage(state.where("_p IS NULL").unionByName(moved))
    else:
        raise ValueError("the network has a cycle; repair it before numbering")
    return state.select("node", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def is_upstream(enter: Column, of_enter: Column, of_leave: Column) -> Column:
    """Whether a node lies upstream of another or is it, from the numbers of :func:`forest_intervals`."""
    return enter.between(of_enter, of_leave)


def upstream_members(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """``(outlet, node)``: all nodes that reach each outlet, the outlet included.

    Outlets may lie upstream of one another. The interval of an outlet is cut
    into its largest aligned blocks, and a node meets the blocks above its own
    number by equality, so the rows made are the members themselves.
    """
    places = cut_lineage(forest_intervals(edges))
    wanted = places.join(outlets.select("node").distinct(), "node", "left_semi").select(
        F.col("node").alias("outlet"), F.inline(aligned_blocks(F.col("enter"), F.col("leave"))).alias("level", "bx")
    )
    top = places.agg(F.coalesce(F.floor(F.log(float(FANOUT), F.max(F.col("leave") - F.col("enter") + 1).cast("double")) + 1e-9), F.lit(0)).cast("int").alias("v")).scalar()
    spread = places.select("node", "enter", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    size = F.pow(F.lit(float(FANOUT)), "level").cast("bigint")
    return spread.withColumn("bx", F.floor(F.col("enter") / size)).join(wanted, ["level", "bx"]).select("outlet", "node")


def cycle_members(edges: DataFrame) -> DataFrame:
    """``(node, cycle)``: nodes on cycles with the smallest node of their cycle."""
    ends = follow_downstream(edges)
    caught = cut_lineage(
        edges.join(ends.where("last IS NULL").select("node"), "node", "left_semi").select("node", "next")
    )
    n = caught.count()
    if n == 0:
        return caught.select("node", F.col("node").alias("cycle"))
    far = caught.select("node", F.col("next").alias("_p"))
    for _ in range(math.ceil(math.log2(n)) + 1):
        far = cut_lineage(
            far.join(far.select(F.col("node").alias("_p"), F.col("_p").alias("_q")), "_p").select(
                "node", F.col("_q").alias("_p")
            )
        )
    ring = caught.join(far.select(F.col("_p").alias("node")).distinct(), "node", "left_semi")
    return fold_upstream(ring, {"cycle": "node"}, "min")


def break_cycles(edges: DataFrame, height: str) -> DataFrame:
    """The highest node of each cycle becomes a pit; the lower id wins a tie.

    Cycles of such a network share no node, so one pass clears them all.
    """
    worst = (
        cycle_members(edges)
        .join(edges.select("node", height), "node")
        .groupBy("cycle")
        .agg(F.max_by("node", F.struct(F.col(height), -F.col("node"))).alias("node"))
        .select("node", F.lit(True).alias("_pit"))
    )
    return edges.join(worst, "node", "left").select(
        "node", F.when(F.col("_pit"), None).otherwise(F.col("next")).alias("next"),
        *[c for c in edges.columns if c not in ("node", "next")],
        F.coalesce("_pit", F.lit(False)).alias("new_pit"),
    )


def close_downstream(edges: DataFrame, flag: str, name: str = "closed") -> DataFrame:
    """Flagged nodes plus every node downstream of one."""
    marked = edges.withColumn(flag, F.coalesce(flag, F.lit(False)).cast("int"))
    return fold_upstream(marked, {name: flag}, "max").withColumn(name, F.col(name) == 1)


def flow_violations(edges: DataFrame, flag: str) -> DataFrame:
    """Flagged nodes whose next node is not flagged."""
    nxt = edges.select(F.col("node").alias("next"), F.col(flag).alias("_f"))
    return edges.where(F.col(flag)).join(nxt, "next").where(~F.col("_f")).select("node", "next")


def upstream_area(edges: DataFrame, area: str, threshold: float = 10.0) -> DataFrame:
    """Accumulated area with the river flag from ``threshold`` on."""
    return fold_upstream(edges, {"upstream_area": area}, "sum").withColumn(
        "river", F.col("upstream_area") >= threshold
    )


def height_above_drainage(edges: DataFrame, height: str, drain: str) -> DataFrame:
    """Height over the first drainage node downstream; NULL where none is reached."""
    ends = follow_downstream(edges, stop=F.col(drain))
    foot = edges.where(F.col(drain)).select(F.col("node").alias("last"), F.col(height).alias("_foot"))
    return (
        edges.select("node", height)
        .join(ends, "node")
        .join(foot, "last", "left")
        .select("node", (F.col(height) - F.col("_foot")).alias("hand"), F.when(F.col("_foot").isNotNull(), F.col("last")).alias("drain_node"))
    )


# ---------------------------------------------------------------- grids

def d8_to_ldd(code: Column, row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """Drainage code of a flow direction; border cells and unknown codes are pits."""
    table = F.create_map(*[F.lit(x) for kv in D8_TO_LDD.items() for x in kv])
    edge = (row == 0) | (col == 0) | (row == rows - 1) | (col == cols - 1)
    return F.when(edge, 5).otherwise(F.coalesce(F.element_at(table, code), F.lit(5)))


def ldd_successor(code: Column, row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """Number of the next cell (row * columns + col); NULL for pits and off the grid."""
    down = F.create_map(*[F.lit(x) for k, (r, _) in LDD_OFFSETS.items() for x in (k, r)])
    right = F.create_map(*[F.lit(x) for k, (_, c) in LDD_OFFSETS.items() for x in (k, c)])
    r, c = row + F.element_at(down, code), col + F.element_at(right, code)
    ok = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    return F.when(ok, (r * cols + c).cast("bigint"))


def steepest_successor(grid: DataFrame, height: str, row: str = "row", col: str = "col") -> DataFrame:
    """Adds ``next_row, next_col``: the lowest of the four neighbours if it is lower."""
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    offered = (
        grid.where(F.col(height).isNotNull())
        .withColumn("_o", F.explode(around))
        .select(
            (F.col(row) + F.col("_o.dr")).alias(row),
            (F.col(col) + F.col("_o.dc")).alias(col),
            F.struct(F.col(height).alias("h"), F.col(row).alias("r"), F.col(col).alias("c")).alias("_n"),
        )
    )
    lowest = offered.groupBy(row, col).agg(F.min("_n").alias("_n"))
    lower = F.col("_n.h") < F.col(height)
    return grid.join(lowest, [row, col], "left").select(
        *grid.columns, F.when(lower, F.col("_n.r")).alias("next_row"), F.when(lower, F.col("_n.c")).alias("next_col")
    )


def edge_inflows(grid: DataFrame, acc: str, channel: str, rows: Column, cols: Column, threshold: float) -> DataFrame:
    """Border cells with enough accumulation that are no channel, one row per edge they lie on."""
    r, c = F.col("row"), F.col("col")
    edges = F.array_compact(
        F.array(
            F.when(r == rows - 1, "north"), F.when(r == 0, "south"), F.when(c == 0, "west"), F.when(c == cols - 1, "east")
        )
    )
    return (
        grid.where((F.col(acc) >= threshold) & ~(F.coalesce(F.col(channel), F.lit(0)) > 0))
        .withColumn("edge", F.explode(edges))
        .select("edge", "row", "col", F.col(acc).alias("acc"))
    )


def name_entries(entries: DataFrame, channel_top: Column) -> DataFrame:
    """N1, S1, W1, E1 .. by falling accumulation inside each side.

    Entries of the north edge at or under the channel count as south.
    """
    side = (
        F.when((F.col("edge") == "north") & (F.col("row") > channel_top), "N")
        .when(F.col("edge").isin("south", "north"), "S")
        .when(F.col("edge") == "west", "W")
        .otherwise("E")
    )
    order = W.partitionBy("_side").orderBy(F.col("acc").desc(), "row", "col", "edge")
    return entries.withColumn("_side", side).select(
        "edge", "row", "col", "acc", F.concat("_side", F.row_number().over(order).cast("string")).alias("name")
    )


def suppress_neighbours(points: DataFrame, value: str, distance: int = 5, keep: int | None = None) -> DataFrame:
    """Keep points with no kept higher point within ``distance`` rows and columns.

    Equal to going through the points from the highest down. A round keeps the
    points that are the highest of the open ones around them and takes them and
    their neighbours out; the points left are the next round's. Pairs of
    neighbours are compared tile by tile and never written.
    """
    size = distance + 1
    rank = lambda p: F.struct(F.col(f"{p}{value}"), -F.col(f"{p}row"), -F.col(f"{p}col"))
    step = F.sequence(F.lit(-1), F.lit(1))
    close = (F.abs(F.col("row") - F.col("h_row")) <= distance) & (F.abs(F.col("col") - F.col("h_col")) <= distance)

    def spread(tiled: DataFrame) -> DataFrame:
        return tiled.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).select(
            F.col("row").alias("h_row"), F.col("col").alias("h_col"), F.col(value).alias(f"h_{value}"),
            (F.col("tr") + F.col("i")).alias("tr"), (F.col("tc") + F.col("j")).alias("tc"),
        )

    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    rows = points.select("row", "col", value)
    open_ = cut_lineage(
        rows.where(placed).withColumns({"tr": F.floor(F.col("row") / size), "tc": F.floor(F.col("col") / size)})
    )
    kept = rows.where(~placed)  # a point without a place has no neighbours
    while not open_.isEmpty():
        lower = open_.join(spread(open_), ["tr", "tc"]).where(close & (rank("h_") > rank(""))).select("row", "col").distinct()
        tops = cut_lineage(open_.join(lower, ["row", "col"], "left_anti").select(*open_.columns))
        if tops.isEmpty():
            raise RuntimeError("a round settled no point; two points share row and column")
        near = open_.join(spread(tops), ["tr", "tc"]).where(close).select("row", "col").distinct()
        open_ = cut_lineage(open_.join(near, ["row", "col"], "left_anti").select(*open_.columns))
        kept = kept.unionByName(tops.select("row", "col", value))
    return kept if keep is None else kept.orderBy(F.col(value).desc(), "row", "col").limit(keep)


# ---------------------------------------------------------------- river segments

def running_sum(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one in ``order``.

    Rows are dealt out by ranges of the order and summed in each; the ranges'
    totals, one row each, give what lies before them. ``order`` must tell all
    rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranged = cut_lineage(ranged)
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.drop("_part", "_at", "_start")


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in sort order without sorting everything in one task."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_off") + start)
        .drop("_part", "_off")
    )


def trace_chains(edges: DataFrame, position: str) -> DataFrame:
    """``(node, river_id)``: each node belongs to the first headwater that reaches it.

    Headwaters count in the order of ``position``; nodes that no headwater
    reaches (pure cycles) get ids of their own after them.
    """
    heads = headwaters(edges.select("node", "next")).select("node", F.lit(True).alias("_head"))
    marked = edges.join(heads, "node", "left").withColumn("_rank", F.when(F.col("_head"), F.col(position)))
    first = fold_upstream(marked, {"_first": "_rank"}, "min").join(edges.select("node", F.col(position).alias("_pos")), "node")
    chain = F.coalesce(F.col("_first"), F.col("_pos"))
    keyed = first.select("node", F.col("_first").isNull().cast("int").alias("_late"), chain.alias("_key"))
    ids = number_rows(keyed.select("_late", "_key").distinct(), [F.col("_late"), F.col("_key")], "river_id")
    return keyed.join(ids, ["_late", "_key"]).select("node", "river_id")


def connect_segments(segments: DataFrame, tolerance: float) -> DataFrame:
    """``(node, next)`` from segment ends to segment starts.

    An end takes the start with the same four-decimal position (the last loaded
    one), else the nearest start closer than the tolerance.
    """
    key = lambda c: F.struct(F.round(c["lon"], 4).alias("x"), F.round(c["lat"], 4).alias("y"))
    ends = segments.select("linkno", "seq", F.element_at("coords", 1).alias("s"), F.element_at("coords", -1).alias("e"))
    starts = ends.groupBy(key(F.col("s")).alias("k")).agg(F.max_by("linkno", "seq").alias("hit"))
    exact = ends.select("linkno", "e", key(F.col("e")).alias("k")).join(starts, "k", "left")
    loose = exact.where("hit IS NULL").select("linkno", "e")
    cell = lambda v: F.floor(v / tolerance)
    step = F.sequence(F.lit(-1), F.lit(1))
    wanted = (
        loose.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
        .select("linkno", "e", (cell(F.col("e.lon")) + F.col("i")).alias("cx"), (cell(F.col("e.lat")) + F.col("j")).alias("cy"))
    )
    offered = ends.select(
        F.col("linkno").alias("other"), "seq", "s", cell(F.col("s.lon")).alias("cx"), cell(F.col("s.lat")).alias("cy")
    )
    dist = F.sqrt(F.pow(F.col("s.lon") - F.col("e.lon"), 2) + F.pow(F.col("s.lat") - F.col("e.lat"), 2))
    near = (
        wanted.join(offered, ["cx", "cy"])
        .where(F.col("other") != F.col("linkno"))
        .withColumn("d", dist)
        .where(F.col("d") < tolerance)
        .groupBy("linkno")
        .agg(F.min_by("other", F.struct("d", "seq")).alias("near"))
    )
    return exact.join(near, "linkno", "left").select(
        F.col("linkno").alias("node"), F.coalesce("hit", "near").alias("next")
    )


def segment_length_km(coords: str, latitude: float = -1.25) -> Column:
    """Flat-earth length with the cosine of one fixed latitude."""
    k = math.cos(math.radians(latitude))
    pairs = F.zip_with(
        F.slice(coords, F.lit(1), F.size(coords) - 1), F.slice(coords, F.lit(2), F.size(coords) - 1),
        lambda a, b: F.sqrt(F.pow((b["lon"] - a["lon"]) * 111.0 * k, 2) + F.pow((b["lat"] - a["lat"]) * 111.0, 2)),
    )
    return F.when(F.size(coords) >= 2, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def river_positions(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """``(river_id, node, place)``: the place of each segment in its river, 0 at the headwater; one row a segment, whatever a river's length."""
    rows = chains.select("node", "river_id").join(follow_downstream(edges).select("node", "hops"), "node")
    start = cut_lineage(rows.groupBy("river_id").agg(F.max("hops").alias("_most")))
    return rows.join(start, "river_id").select("river_id", "node", (F.col("_most") - F.col("hops")).alias("place"))


def river_summary(segments: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Orders, segment count, length, outlet and member list of each river chain; :func:`river_positions` tells the members as rows."""
    ends = follow_downstream(edges)
    rows = (
        segments.withColumnRenamed("linkno", "node")
        .join(chains, "node")
        .join(ends.select("node", "hops"), "node")
        .select("river_id", "node", "stream_order", "hops", segment_length_km("coords").alias("km"), F.element_at("coords", -1).alias("e"))
    )
    path = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("hops", "node")))), lambda x: x["node"].cast("string"))
    return rows.groupBy("river_id").agg(
        F.min_by("node", "hops").alias("outlet_linkno"),
        F.max("stream_order").alias("max_order"),
        F.min("stream_order").alias("min_order"),
        F.count("*").alias("n_segments"),
        F.sum("km").alias("length_km"),
        F.min_by("e", "hops").alias("_e"),
        F.concat_ws(";", path).alias("all_linknos"),
    ).select(
        "river_id", "outlet_linkno", "max_order", "min_order", "n_segments", "length_km",
        F.col("_e.lon").alias("outlet_lon"), F.col("_e.lat").alias("outlet_lat"), "all_linknos",
    )


def classify_segments(segments: DataFrame, west: float, south: float, east: float, north: float, min_order: int = 1) -> DataFrame:
    """Crossing, headwater or interior segments of a box with one entry point each."""
    inside = lambda p: p["lon"].between(west, east) & p["lat"].between(south, north)
    key = lambda c: F.struct(F.round(c["lon"], 4).alias("x"), F.round(c["lat"], 4).alias("y"))
    ends = segments.select(key(F.element_at("coords", -1)).alias("k")).distinct().withColumn("_fed", F.lit(True))
    pts = F.filter("coords", inside)
    first = F.element_at("_in", 1)
    mean = lambda axis: F.aggregate("_in", F.lit(0.0), lambda a, p: a + p[axis]) / F.size("_in")
    crossing = F.size("_in") < F.size("coords")
    return (
        segments.where(F.col("stream_order") >= min_order)
        .withColumn("_in", pts)
        .where(F.size("_in") > 0)
        .withColumn("k", key(F.element_at("coords", 1)))
        .join(ends, "k", "left")
        .select(
            "linkno",
            "stream_order",
            F.round(F.when(crossing, first["lon"]).otherwise(mean("lon")), 6).alias("lon"),
            F.round(F.when(crossing, first["lat"]).otherwise(mean("lat")), 6).alias("lat"),
            F.when(crossing, "crossing").when(F.col("_fed"), "interior").otherwise("headwater").alias("category"),
        )
    )


# ---------------------------------------------------------------- basins

def select_basin(
    edges: DataFrame, seed: Column, area: str, target: float | None = None, low: float = 1 / 3, high: float = 3.0
) -> DataFrame:
    """Member count, area, ratio to the target and warning of the basin above each seed node.

    Both sums come from one fold over the network, so overlapping basins cost
    no member lists; ``upstream_members`` gives the lists.
    """
    sums = fold_upstream(
        edges.withColumn("_one", F.lit(1).cast("bigint")), {"n_polygons": "_one", "area_km2": area}, "sum"
    )
    stats = sums.join(edges.where(seed).select("node"), "node", "left_semi").withColumnRenamed("node", "outlet")
    ratio = F.col("area_km2") / F.lit(target) if target else F.lit(None).cast("double")
    return stats.withColumn("ratio", ratio).withColumn(
        "warning", F.when(F.col("ratio") < low, "under").when(F.col("ratio") > high, "over")
    )


def best_outlet(candidates: DataFrame, areas: DataFrame, group: str, target: Column | None = None) -> DataFrame:
    """Candidate whose upstream area fits the target best, or is largest without one."""
    scored = candidates.join(areas, "node")
    area = F.col("upstream_area")
    if target is None:
        score = -area
    else:
        score = F.when(target.isNull(), -area).otherwise(
            F.when(area > 0, F.abs(F.log(area / target))).otherwise(F.lit(float("inf")))
        )
    return scored.withColumn("_score", score).groupBy(group).agg(
        F.min_by("node", F.struct("_score", "node")).alias("node")
    )


def smart_snap(
    points: DataFrame, polygons: DataFrame, edges: DataFrame, point: str, key: str, ring: str, area: str, target: str, radius: float = 0.5
) -> DataFrame:
    """``(point, node, n_candidates)``: the polygon within ``radius`` of each point whose upstream area fits the point's ``target`` best.

    Candidates of all points are found at once (distance 0 inside a polygon);
    a point without any takes the nearest polygon. The areas come from one fold
    over the network, so no basin is walked per candidate. Points with a NULL
    target take the largest area; the lower node wins a tie. ``key`` names the
    polygons and is the node of ``edges``.
    """
    near = cut_lineage(polygons_within(points, polygons, point, key, ring, radius).select(point, F.col(key).alias("node")))
    lonely = points.join(near.select(point).distinct(), point, "left_anti")
    nearest = nearest_polygons(lonely, polygons, point, key, ring, radius).select(point, F.col(key).alias("node"))
    candidates = near.unionByName(nearest).join(points.select(point, F.col(target).alias("_target")), point)
    areas = fold_upstream(edges, {"upstream_area": area}, "sum").select("node", "upstream_area")
    counts = near.groupBy(point).agg(F.count("*").alias("n_candidates"))
    best = best_outlet(candidates, areas, point, F.col("_target"))
    return best.join(counts, point, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("bigint")))
