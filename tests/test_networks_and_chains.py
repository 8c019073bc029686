"""Walk numbers of a drainage forest, chains of months, and feature files that are split."""

import json
import random

import pytest

from pluvion.operators import graph
from pluvion.plans import risk
from pluvion.sources import vector

EDGES = "node long, next long"


def forest(n, seed, star=False):
    draw = random.Random(seed)
    names = draw.sample(range(10 * n), n)
    return [(names[i], None if i == 0 or draw.random() < 0.03 else names[0 if star else draw.randrange(max(0, i - 4), i)]) for i in range(n)]


def above(rows, node):
    ups = {}
    for a, b in rows:
        ups.setdefault(b, []).append(a)
    found, open_ = set(), [node]
    while open_:
        x = open_.pop()
        found.add(x)
        open_ += ups.get(x, [])
    return found


@pytest.mark.parametrize("star", [False, True])
def test_intervals_hold_what_lies_upstream(spark, star):
    rows = forest(50, 4, star)
    got = {r.node: (r.enter, r.leave) for r in graph.forest_intervals(spark.createDataFrame(rows, EDGES)).collect()}
    assert sorted(e for e, _ in got.values()) == list(range(50))
    for node, (enter, leave) in got.items():
        assert {x for x, (e, _) in got.items() if enter <= e <= leave} == above(rows, node)
    assert graph.forest_intervals(spark.createDataFrame([], EDGES)).count() == 0


def test_nested_outlets(spark):
    """Outlets upstream of one another, in a chain and in a forest: members by brute force."""
    chain = [(i, i - 1 if i else None) for i in range(30)]
    rows = chain + [(a + 1000, None if b is None else b + 1000) for a, b in forest(40, 7)]
    edges = spark.createDataFrame(rows, EDGES)
    outlets = list(range(0, 30, 4)) + [a for a, _ in rows[30::9]]
    found = graph.upstream_members(edges, edges.where(edges.node.isin(outlets))).collect()
    assert sorted(tuple(r) for r in found) == sorted((o, x) for o in outlets for x in above(rows, o))


def fold(months, decay, lookback, reset):
    """One month after the other, as the rule says."""
    out, prev, length = [], None, 0
    for lik in months:
        use = prev is not None and length < lookback
        if use:
            blended = [decay * p + (1 - decay) * 0.2 for p in prev]
            total = sum(blended)
            joint = None if lik is None else [a * b / total for a, b in zip(lik, blended)]
            post = None if joint is None else [x / sum(joint) for x in joint] if sum(joint) else joint
        else:
            post = lik
        length = 1 if prev is None or (reset and not use) else length + 1
        out.append((post, use))
        prev = post
    return out


@pytest.mark.parametrize("lookback, reset", [(6, False), (6, True), (3, True), (1, False)])
def test_monthly_chains(spark, lookback, reset):
    draw = random.Random(lookback)
    rows, want = [], {}
    for key in range(6):
        months = []
        for m in range(23):
            lik = [draw.random() for _ in range(5)]
            lik = None if key == 3 and m % 8 == 5 else [x / sum(lik) for x in lik]
            months.append(lik)
            rows.append((key, f"{2000 + m // 12}-{m % 12 + 1:02d}", lik))
        want[key] = fold(months, 0.6, lookback, reset)
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "key int, month string, lik array<double>")
    got = risk.monthly_sequence(frame, "key", "month", "lik", lookback=lookback, reset=reset).collect()
    assert len(got) == len(rows)
    for key in want:
        mine = sorted((r for r in got if r.key == key), key=lambda r: r.month)
        for r, (post, use) in zip(mine, want[key]):
            assert r.temporal_prior == use and (r.posterior is None) == (post is None)
            assert post is None or r.posterior == pytest.approx(post)


def test_feature_files_are_split(spark, tmp_path):
    draw = random.Random(3)
    feats = []
    for i in range(4000):
        line = [[draw.random(), draw.random()] for _ in range(draw.randint(2, 9))]
        props = {"linkno": i, "stream_order": i % 5, "name": '} "Feature\\", {[', "kind": "reach"}
        feats.append({"type": "Feature", "properties": props, "geometry": {"type": "LineString", "coordinates": line}})
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": feats}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        seg = vector.read_feature_collections(spark, str(tmp_path))
        assert seg.rdd.getNumPartitions() > 5
        got = {r.linkno: (r.stream_order, [list(p) for p in r.coords]) for r in seg.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f["properties"]["linkno"]: (f["properties"]["stream_order"], f["geometry"]["coordinates"]) for f in feats}
