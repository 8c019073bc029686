"""Drainage and river network operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.operators import graph

QUERIES, ORACLES, query = bind.area()

# ---- parts as basins: node n flows to n div 2, node 1 is the outlet

NET_SQL = """
net AS (SELECT p_partkey + 1 AS node, nullif((p_partkey + 1) // 2, 0) AS nxt, p_size * 1.0::DOUBLE AS area FROM part)
"""


def net(spark, d):
    node = F.col("p_partkey") + 1
    down = F.floor(node / 2)
    return bind.table(spark, d, "part").select(
        node.alias("node"),
        F.when(down > 0, down).alias("next"),
        F.col("p_size").cast("double").alias("area"),
    )


@query(
    "upstream_members",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, up(outlet, node) AS (SELECT node, node FROM net WHERE node IN (3, 5, 11, 22)
         UNION ALL SELECT up.outlet, net.node FROM up JOIN net ON net.nxt = up.node) SELECT outlet, node FROM up""",
)
def upstream_members(spark, d):
    edges = net(spark, d)
    return graph.upstream_members(edges, edges.where("node IN (3, 5, 11, 22)"))


@query(
    "upstream_intervals",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, walk(node, path) AS (SELECT node, [node] FROM net WHERE nxt IS NULL UNION ALL SELECT net.node, list_append(path, net.node) FROM walk JOIN net ON net.nxt = walk.node),
    place AS (SELECT node, path, row_number() OVER (ORDER BY path) - 1 AS enter FROM walk),
    size AS (SELECT up AS node, count(*) AS n FROM (SELECT unnest(path) AS up FROM walk) GROUP BY up)
    SELECT node, enter, enter + n - 1 AS leave FROM place JOIN size USING (node)""",
)
def upstream_intervals(spark, d):
    return graph.forest_intervals(net(spark, d))


@query(
    "upstream_area",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, down(node, cur) AS (SELECT node, node FROM net UNION ALL SELECT down.node, net.nxt FROM down JOIN net ON net.node = down.cur WHERE net.nxt IS NOT NULL)
    SELECT cur AS node, sum(area) AS upstream_area, sum(area) >= 100 AS river FROM down JOIN net USING (node) GROUP BY cur""",
)
def upstream_area(spark, d):
    return graph.upstream_area(net(spark, d), "area", 100.0)


@query(
    "basin_select",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, up(outlet, node) AS (SELECT node, node FROM net WHERE node BETWEEN 2 AND 40
         UNION ALL SELECT up.outlet, net.node FROM up JOIN net ON net.nxt = up.node)
    SELECT outlet, count(*) AS n_polygons, sum(area) AS area_km2, round(sum(area) / 3000, 9) AS ratio,
      CASE WHEN sum(area) / 3000 < 1.0 / 3 THEN 'under' WHEN sum(area) / 3000 > 3 THEN 'over' END AS warning
    FROM up JOIN net USING (node) GROUP BY outlet""",
)
def basin_select(spark, d):
    out = graph.select_basin(net(spark, d), F.col("node").between(2, 40), "area", 3000.0)
    return out.withColumn("ratio", F.round("ratio", 9))


@query(
    "smart_outlet",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, down(node, cur) AS (SELECT node, node FROM net UNION ALL SELECT down.node, net.nxt FROM down JOIN net ON net.node = down.cur WHERE net.nxt IS NOT NULL),
    acc AS (SELECT cur AS node, sum(area) AS a FROM down JOIN net USING (node) GROUP BY cur),
    s AS (SELECT acc.node, acc.node % 25 AS site, CASE WHEN acc.node % 25 % 2 = 0 THEN abs(ln(a / 500)) ELSE -a END AS score FROM acc)
    SELECT site, arg_min(node, (score, node)) AS node FROM s GROUP BY site""",
)
def smart_outlet(spark, d):
    edges = net(spark, d)
    areas = graph.upstream_area(edges, "area").select("node", "upstream_area")
    candidates = edges.select("node", (F.col("node") % 25).alias("site"))
    return graph.best_outlet(candidates, areas, "site", F.when(F.col("site") % 2 == 0, 500.0))


@query(
    "network_ends",
    """WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 7 THEN p_partkey - 7 END AS nxt FROM part),
    e AS (SELECT p.node, CASE WHEN q.node IS NOT NULL THEN p.nxt END AS nxt FROM p LEFT JOIN p q ON q.node = p.nxt),
    w(node, cur, hops) AS (SELECT node, node, 0::BIGINT FROM e UNION ALL SELECT w.node, e.nxt, hops + 1 FROM w JOIN e ON e.node = w.cur WHERE e.nxt IS NOT NULL)
    SELECT node, arg_max(cur, hops) AS last, max(hops) AS hops FROM w GROUP BY node""",
)
def network_ends(spark, d):
    k = F.col("p_partkey")
    parts = bind.table(spark, d, "part").select(k.alias("node"), F.when(k >= 7, k - 7).alias("next"))
    return graph.follow_downstream(graph.within_set(parts))


@query(
    "headwaters",
    bind.with_sql("SELECT node FROM net n WHERE NOT EXISTS (SELECT 1 FROM net m WHERE m.nxt = n.node)", NET_SQL),
)
def headwaters(spark, d):
    return graph.headwaters(net(spark, d)).select("node")


# ---- parts as a grid of 50 columns with drainage codes, heights and river cells

LDD_SQL = """
dims AS (SELECT max(p_partkey) // 50 + 1 AS nr, 50 AS nc FROM part),
g AS (SELECT p_partkey AS node, p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(1 + p_size % 9 AS INTEGER) AS code,
             p_retailprice + p_partkey * 37 % 101 AS dem, p_size % 7 = 0 AS river FROM part),
off(code, dr, dc) AS (VALUES (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, -1), (6, 0, 1), (7, -1, -1), (8, -1, 0), (9, -1, 1)),
e AS (SELECT g.*, CASE WHEN r + dr BETWEEN 0 AND nr - 1 AND c + dc BETWEEN 0 AND nc - 1 THEN (r + dr) * nc + c + dc END AS nxt
      FROM g LEFT JOIN off USING (code), dims)
"""


def ldd(spark, d):
    part = bind.table(spark, d, "part")
    k = F.col("p_partkey")
    rows = part.agg((F.floor(F.max("p_partkey") / 50) + 1).alias("v")).scalar()
    return part.select(
        k.alias("node"),
        F.floor(k / 50).alias("row"),
        (k % 50).alias("col"),
        (F.lit(1) + F.col("p_size") % 9).alias("code"),
        (F.col("p_retailprice") + k * 37 % 101).alias("dem"),
        (F.col("p_size") % 7 == 0).alias("river"),
    ).withColumn("next", graph.ldd_successor(F.col("code"), F.col("row"), F.col("col"), rows, F.lit(50)))


@query("ldd_successor", "WITH " + LDD_SQL.strip() + " SELECT node, nxt AS \"next\" FROM e")
def ldd_successor(spark, d):
    return ldd(spark, d).select("node", "next")


_CYCLE = (
    "WITH RECURSIVE "
    + LDD_SQL.strip()
    + """, w(node, cur, low, n) AS (SELECT node, nxt, least(node, nxt), 1 FROM e WHERE nxt IS NOT NULL
      UNION ALL SELECT w.node, e.nxt, least(w.low, e.nxt), n + 1 FROM w JOIN e ON e.node = w.cur WHERE w.cur <> w.node AND e.nxt IS NOT NULL AND n < 400),
    cyc AS (SELECT node, low AS cycle FROM w WHERE cur = node)
    """
)


@query("cycle_check", _CYCLE + "SELECT node, cycle FROM cyc")
def cycle_check(spark, d):
    return graph.cycle_members(ldd(spark, d))


@query(
    "cycle_repair",
    _CYCLE
    + """, pits AS (SELECT cycle, arg_max(cyc.node, (dem, -cyc.node)) AS node FROM cyc JOIN e ON e.node = cyc.node GROUP BY cycle)
    SELECT e.node, CASE WHEN p.node IS NULL THEN nxt END AS "next", p.node IS NOT NULL AS new_pit FROM e LEFT JOIN pits p ON p.node = e.node""",
)
def cycle_repair(spark, d):
    return graph.break_cycles(ldd(spark, d), "dem").select("node", "next", "new_pit")


@query(
    "river_closure",
    "WITH RECURSIVE "
    + LDD_SQL.strip()
    + """, reach(node) AS (SELECT node FROM e WHERE river UNION SELECT e.nxt FROM reach JOIN e USING (node) WHERE e.nxt IS NOT NULL)
    SELECT e.node, e.node IN (SELECT node FROM reach) AS closed FROM e""",
)
def river_closure(spark, d):
    return graph.close_downstream(ldd(spark, d), "river")


@query(
    "river_violations",
    "WITH " + LDD_SQL.strip() + " SELECT a.node, a.nxt AS \"next\" FROM e a JOIN e b ON b.node = a.nxt WHERE a.river AND NOT b.river",
)
def river_violations(spark, d):
    return graph.flow_violations(ldd(spark, d), "river")


@query(
    "height_above_drainage",
    """WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 9 THEN p_partkey - 9 END AS nxt, p_retailprice AS dem, p_size = 17 AS drain FROM part),
    w(node, cur) AS (SELECT node, node FROM e UNION ALL SELECT w.node, e.nxt FROM w JOIN e ON e.node = w.cur WHERE NOT e.drain AND e.nxt IS NOT NULL)
    SELECT e.node, round(e.dem - z.dem, 6) AS hand, z.node AS drain_node
    FROM e LEFT JOIN (SELECT w.node AS k, f.node, f.dem FROM w JOIN e f ON f.node = w.cur AND f.drain) z ON z.k = e.node""",
)
def height_above_drainage(spark, d):
    k = F.col("p_partkey")
    edges = bind.table(spark, d, "part").select(
        k.alias("node"), F.when(k >= 9, k - 9).alias("next"), F.col("p_retailprice").alias("dem"), (F.col("p_size") == 17).alias("drain")
    )
    return graph.height_above_drainage(edges, "dem", "drain").withColumn("hand", F.round("hand", 6))


@query(
    "descent_trace",
    "WITH RECURSIVE "
    + LDD_SQL.strip()
    + """, nb AS (SELECT g.node, g.dem, h.node AS other, h.dem AS od, h.r, h.c FROM g JOIN g h ON abs(g.r - h.r) + abs(g.c - h.c) = 1),
    s AS (SELECT node, arg_min(other, (od, r, c)) AS nxt FROM nb GROUP BY node, dem HAVING min(od) < dem),
    w(node, cur, hops) AS (SELECT node, node, 0::BIGINT FROM g UNION ALL SELECT w.node, s.nxt, hops + 1 FROM w JOIN s ON s.node = w.cur)
    SELECT z.node, z.hops + 1 AS path_len, g.dem AS end_elev, g.dem <= 960 + 2.0 AS reached
    FROM (SELECT node, arg_max(cur, hops) AS last, max(hops) AS hops FROM w GROUP BY node) z JOIN g ON g.node = z.last""",
)
def descent_trace(spark, d):
    cells = ldd(spark, d).select("node", "row", "col", "dem")
    stepped = graph.steepest_successor(cells, "dem")
    edges = stepped.select("node", (F.col("next_row") * 50 + F.col("next_col")).alias("next"))
    ends = graph.follow_downstream(edges)
    last = cells.select(F.col("node").alias("last"), F.col("dem").alias("end_elev"))
    return ends.join(last, "last").select(
        "node", (F.col("hops") + 1).alias("path_len"), "end_elev", (F.col("end_elev") <= 960 + 2.0).alias("reached")
    )


@query(
    "edge_entries",
    "WITH "
    + LDD_SQL.strip()
    + """, x AS (SELECT 'north' AS edge, r, c, dem FROM g, dims WHERE r = nr - 1 UNION ALL SELECT 'south', r, c, dem FROM g WHERE r = 0
          UNION ALL SELECT 'west', r, c, dem FROM g WHERE c = 0 UNION ALL SELECT 'east', r, c, dem FROM g, dims WHERE c = nc - 1),
    k AS (SELECT x.edge, x.r AS "row", x.c AS col, x.dem AS acc, CASE WHEN x.edge = 'north' AND x.r > 3 THEN 'N' WHEN x.edge IN ('north', 'south') THEN 'S' WHEN x.edge = 'west' THEN 'W' ELSE 'E' END AS side
          FROM x JOIN g ON g.r = x.r AND g.c = x.c WHERE x.dem >= 1000 AND NOT g.river)
    SELECT edge, "row", col, acc, side || CAST(row_number() OVER (PARTITION BY side ORDER BY acc DESC, "row", col, edge) AS VARCHAR) AS name FROM k""",
)
def edge_entries(spark, d):
    cells = ldd(spark, d).withColumn("channel", F.col("river").cast("int"))
    rows = cells.agg((F.max("row") + 1).alias("v")).scalar()
    found = graph.edge_inflows(cells, "dem", "channel", rows, F.lit(50), 1000.0)
    return graph.name_entries(found, F.lit(3))


@query(
    "peak_suppression",
    "WITH RECURSIVE "
    + LDD_SQL.strip()
    + """, pk AS (SELECT r, c, dem, row_number() OVER (ORDER BY dem DESC, r, c) AS k FROM g WHERE dem >= 950),
    pass(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(r BIGINT, c BIGINT, dem DOUBLE)[] UNION ALL
      SELECT pk.k, CASE WHEN len(list_filter(kept, lambda x: abs(x.r - pk.r) <= 5 AND abs(x.c - pk.c) <= 5)) = 0 THEN list_append(kept, {'r': pk.r, 'c': pk.c, 'dem': pk.dem}) ELSE kept END
      FROM pass JOIN pk ON pk.k = pass.k + 1)
    SELECT x.r AS "row", x.c AS col, x.dem AS acc FROM (SELECT unnest(kept) AS x FROM pass WHERE k = (SELECT max(k) FROM pk))""",
)
def peak_suppression(spark, d):
    cells = ldd(spark, d).select("row", "col", F.col("dem").alias("acc")).where("acc >= 950")
    return graph.suppress_neighbours(cells, "acc", 5)


@query(
    "river_chains",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, heads AS (SELECT node, row_number() OVER (ORDER BY node * 7919 % 10007, node) - 1 AS rk FROM net n WHERE NOT EXISTS (SELECT 1 FROM net m WHERE m.nxt = n.node)),
    down(rk, cur) AS (SELECT rk, node FROM heads UNION ALL SELECT down.rk, net.nxt FROM down JOIN net ON net.node = down.cur WHERE net.nxt IS NOT NULL)
    SELECT cur AS node, min(rk) AS river_id FROM down GROUP BY cur""",
)
def river_chains(spark, d):
    edges = net(spark, d).withColumn("pos", (F.col("node") * 7919 % 10007) * 100000000 + F.col("node"))
    return graph.trace_chains(edges, "pos")


_SEG_SQL = """
seg AS (SELECT p_partkey AS linkno, CAST(p_size % 9 + 1 AS INTEGER) AS so, (p_partkey % 40) * 0.01::DOUBLE AS x0, (p_partkey // 40) * 0.01::DOUBLE AS y0,
               (p_partkey % 40) * 0.01::DOUBLE + CASE WHEN p_size % 3 = 0 THEN 0.0101 ELSE 0.01 END::DOUBLE AS x2, (p_partkey // 40) * 0.01::DOUBLE AS y2 FROM part)
"""


def segments(spark, d):
    """Parts as short river segments heading east; some ends miss the next start a little."""
    k = F.col("p_partkey")
    x0, y0 = (k % 40) * F.lit(0.01), F.floor(k / 40) * F.lit(0.01)
    x2 = x0 + F.when(F.col("p_size") % 3 == 0, 0.0101).otherwise(0.01)
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return bind.table(spark, d, "part").select(
        k.alias("linkno"),
        k.alias("seq"),
        (F.col("p_size") % 9 + 1).cast("int").alias("stream_order"),
        F.array(pt(x0, y0), pt((x0 + x2) / 2, y0 + 0.002), pt(x2, y0)).alias("coords"),
    )


@query(
    "segment_links",
    bind.with_sql(
        """, m AS (SELECT a.linkno, b.linkno AS other, round(a.x2, 4) = round(b.x0, 4) AND round(a.y2, 4) = round(b.y0, 4) AS hit,
              sqrt(power(b.x0 - a.x2, 2) + power(b.y0 - a.y2, 2)) AS d
              FROM seg a JOIN seg b ON abs(b.x0 - a.x2) < 0.001 AND abs(b.y0 - a.y2) < 0.001)
        SELECT seg.linkno AS node, coalesce(max(other) FILTER (hit), arg_min(other, (d, other)) FILTER (d < 0.0005 AND other <> seg.linkno)) AS "next"
        FROM seg LEFT JOIN m ON m.linkno = seg.linkno GROUP BY seg.linkno""",
        _SEG_SQL,
    ),
)
def segment_links(spark, d):
    return graph.connect_segments(segments(spark, d), 0.0005)


@query(
    "segment_classes",
    bind.with_sql(
        """, p AS (SELECT *, (x0 + x2) / 2 AS x1, y0 + 0.002 AS y1 FROM seg WHERE so >= 2),
        i AS (SELECT *, x0 BETWEEN 0.055 AND 0.305 AND y0 BETWEEN 0.031 AND 0.251 AS a, x1 BETWEEN 0.055 AND 0.305 AND y1 BETWEEN 0.031 AND 0.251 AS b,
                 x2 BETWEEN 0.055 AND 0.305 AND y2 BETWEEN 0.031 AND 0.251 AS c FROM p)
        SELECT linkno, so AS stream_order, CASE WHEN NOT (a AND b AND c) THEN 'crossing'
             WHEN EXISTS (SELECT 1 FROM seg e WHERE round(e.x2, 4) = round(i.x0, 4) AND round(e.y2, 4) = round(i.y0, 4)) THEN 'interior' ELSE 'headwater' END AS category,
          round(CASE WHEN a AND b AND c THEN (x0 + x1 + x2) / 3 WHEN a THEN x0 WHEN b THEN x1 ELSE x2 END, 6) AS lon,
          round(CASE WHEN a AND b AND c THEN (y0 + y1 + y2) / 3 WHEN a THEN y0 WHEN b THEN y1 ELSE y2 END, 6) AS lat
        FROM i WHERE a OR b OR c""",
        _SEG_SQL,
    ),
)
def segment_classes(spark, d):
    return graph.classify_segments(segments(spark, d), 0.055, 0.031, 0.305, 0.251, 2)


@query(
    "entry_numbers",
    bind.with_sql(
        "SELECT linkno, so AS stream_order, row_number() OVER (ORDER BY so DESC, x0, linkno) AS entry_id FROM seg", _SEG_SQL
    ),
)
def entry_numbers(spark, d):
    seg = segments(spark, d).select("linkno", "stream_order", F.element_at("coords", 1)["lon"].alias("lon"))
    out = graph.number_rows(seg, [F.col("stream_order").desc(), F.col("lon"), F.col("linkno")], "entry_id", 1)
    return out.select("linkno", "stream_order", "entry_id")


@query(
    "river_summary",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + ", "
    + _SEG_SQL.strip()
    + """, heads AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rk FROM net n WHERE NOT EXISTS (SELECT 1 FROM net m WHERE m.nxt = n.node)),
    down(rk, cur) AS (SELECT rk, node FROM heads UNION ALL SELECT down.rk, net.nxt FROM down JOIN net ON net.node = down.cur WHERE net.nxt IS NOT NULL),
    ch AS (SELECT cur AS node, min(rk) AS river_id FROM down GROUP BY cur),
    w AS (SELECT ch.river_id, ch.node, s.so, s.x2, s.y2, CAST(floor(log2(ch.node)) AS BIGINT) AS hops,
             2 * sqrt(power((x2 - x0) / 2 * 111.0 * cos(radians(-1.25)), 2) + power(0.222, 2)) AS km FROM ch JOIN seg s ON s.linkno + 1 = ch.node)
    SELECT river_id, arg_min(node, hops) AS outlet_linkno, max(so) AS max_order, min(so) AS min_order, count(*) AS n_segments, round(sum(km), 6) AS length_km,
      round(arg_min(x2, hops), 6) AS outlet_lon, round(arg_min(y2, hops), 6) AS outlet_lat, string_agg(CAST(node AS VARCHAR), ';' ORDER BY hops DESC) AS all_linknos
    FROM w GROUP BY river_id""",
)
def river_summary(spark, d):
    edges = net(spark, d)
    seg = segments(spark, d).withColumn("linkno", F.col("linkno") + 1)
    chains = graph.trace_chains(edges.withColumn("pos", F.col("node")), "pos")
    out = graph.river_summary(seg, edges.select("node", "next"), chains)
    return out.withColumns({c: F.round(c, 6) for c in ("length_km", "outlet_lon", "outlet_lat")})


@query(
    "river_positions",
    "WITH RECURSIVE "
    + NET_SQL.strip()
    + """, heads AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rk FROM net n WHERE NOT EXISTS (SELECT 1 FROM net m WHERE m.nxt = n.node)),
    down(rk, cur) AS (SELECT rk, node FROM heads UNION ALL SELECT down.rk, net.nxt FROM down JOIN net ON net.node = down.cur WHERE net.nxt IS NOT NULL),
    ch AS (SELECT cur AS node, min(rk) AS river_id FROM down GROUP BY cur)
    SELECT river_id, node, row_number() OVER (PARTITION BY river_id ORDER BY floor(log2(node)) DESC) - 1 AS place FROM ch""",
)
def river_positions(spark, d):
    edges = net(spark, d)
    chains = graph.trace_chains(edges.withColumn("pos", F.col("node")), "pos")
    return graph.river_positions(edges.select("node", "next"), chains)
