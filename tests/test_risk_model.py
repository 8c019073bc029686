"""Properties the risk model must keep."""

import math

import pytest
from pyspark.sql import functions as F

from pluvion.functions import categories as C
from pluvion.functions import decision
from pluvion.plans import cdi, risk


def probs(spark, cur, de, spa, trn, agr, tail=1, cd=1, shared=risk.SHARED_SIGNAL):
    v = risk.risk_probabilities(*[F.lit(x) for x in (cur, de, spa, trn, agr, tail, cd)], shared)
    return spark.range(1).select(v.alias("p")).head().p


def entropy(p):
    return -sum(x * math.log(max(x, 1e-12)) for x in p)


def state(spark, p):
    a = decision.attention(F.array(*[F.lit(x) for x in p]))
    return spark.range(1).select(a["state"].alias("s")).head().s


def top(p):
    return C.RISK_STATES[p.index(max(p))]


def he(p):
    return p[3] + p[4]


def crop(spark, w, f, ph):
    one = lambda i, k: risk.one_hot(F.lit(i), k)
    return spark.range(1).select(risk.infer_crop(one(w, 4), one(f, 5), one(ph, 3)).alias("p")).head().p


def agri(spark, met, crop_probs):
    a = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return spark.range(1).select(risk.agricultural_risk(a(met), a(crop_probs)).alias("p")).head().p


def mean_index(v):
    return sum((i + 1) * x for i, x in enumerate(v))


def test_worst_and_best_case(spark):
    worst, best = probs(spark, 5, 5, 3, 3, 3), probs(spark, 1, 1, 1, 1, 3)
    assert (top(worst), state(spark, worst)) == ("Extreme", "Review")
    assert (top(best), state(spark, best)) == ("Minimal", "Monitor")


def test_low_agreement_widens_and_never_escalates(spark):
    high, low = probs(spark, 3, 3, 2, 2, 3), probs(spark, 3, 3, 2, 2, 1)
    assert entropy(low) > entropy(high)
    benign = probs(spark, 1, 1, 1, 1, 1)
    assert he(benign) < 0.2 and state(spark, benign) == "Monitor"
    sure, unsure = probs(spark, 3, 5, 3, 2, 3, 3), probs(spark, 3, 5, 3, 2, 1, 3)
    assert he(unsure) < he(sure) and entropy(unsure) > entropy(sure)


def test_indicator_levels(spark):
    assert probs(spark, 3, 3, 2, 2, 3, 2) == probs(spark, 3, 3, 2, 2, 3, 2, 1)
    assert he(probs(spark, 3, 3, 2, 2, 3, 1, 6)) > he(probs(spark, 3, 3, 2, 2, 3, 1, 1))
    recovered, plain = probs(spark, 2, 2, 1, 1, 3, 1, 2), probs(spark, 2, 2, 1, 1, 3, 1, 1)
    assert sum(recovered[:2]) >= sum(plain[:2])
    assert top(probs(spark, 3, 5, 2, 2, 3, 1, 6)) == "Extreme"


def test_shared_signal_discount(spark):
    table = lambda k: risk.risk_table(spark, k).where("cdi = 1")
    extreme = lambda k: table(k).where(decision.top_state(F.col("risk")) == "Extreme").count()
    assert extreme(0.5) < extreme(0.0)
    assert he(probs(spark, 3, 2, 1, 2, 3, 4)) > he(probs(spark, 3, 2, 1, 2, 3, 1))


def test_table_is_complete_and_normalised(spark):
    t = risk.risk_table(spark)
    assert t.count() == 16200
    assert t.where(F.abs(decision.array_sum(F.col("risk")) - 1) > 1e-12).count() == 0


def test_soft_equals_hard_on_one_hot(spark):
    rows = risk.risk_table(spark).where("(cur * 7 + def * 5 + spa * 3 + trn + tail + cdi) % 11 = 0")
    vectors = risk.evidence_vectors(rows.withColumn("id", F.monotonically_increasing_id()))
    for out in (
        risk.infer_soft(vectors, F.col("agr")).select("id", "posterior"),
        risk.infer_soft_long(vectors, ["id"], F.col("agr")),
    ):
        both = out.join(vectors.select("id", "risk"), "id")
        worst = both.select(F.array_max(F.zip_with("posterior", "risk", lambda a, b: F.abs(a - b))).alias("d"))
        assert worst.agg(F.max("d")).head()[0] < 1e-10


def test_crop_branch_identity_and_bounds(spark):
    met = [0.05, 0.15, 0.45, 0.25, 0.10]
    same = agri(spark, met, [1, 0, 0, 0])
    assert max(abs(a - b) for a, b in zip(met, same)) < 1e-12
    severe = crop(spark, 4, 1, 1)
    assert severe.index(max(severe)) == 3 and he(agri(spark, met, severe)) > he(met)
    alone = agri(spark, [0.85, 0.15, 0, 0, 0], [0, 0, 0, 1])
    assert alone.index(max(alone)) < 3 and alone[4] < 0.05
    steps = [mean_index(agri(spark, [float(i == m) for i in range(5)], [0, 0, 0, 1])) - (m + 1) for m in range(4)]
    assert steps == sorted(steps, reverse=True) and steps[0] > 1.4


def test_crop_ladder_and_phase(spark):
    for w in range(1, 5):
        p = crop(spark, w, 1, 1)
        assert p.index(max(p)) == w - 1
    water, leaf, both = (mean_index(crop(spark, *s)) for s in ((4, 2, 1), (1, 5, 1), (4, 5, 1)))
    assert water < leaf < both and water < mean_index(crop(spark, 4, 1, 1))
    plain, flower, mature = (mean_index(crop(spark, 3, 1, ph)) for ph in (1, 2, 3))
    assert mature < plain < flower
    healthy = crop(spark, 1, 1, 2)
    assert healthy.index(max(healthy)) == 0


def test_crop_expression_equals_folded_constants(spark):
    rows = risk.crop_table(spark).collect()
    assert len(rows) == 60
    for r in rows:
        assert r.crop == pytest.approx(risk._crop_constant(r.w10, r.fpar, r.phase), abs=1e-12)


def test_crop_shift_equals_table(spark):
    i = F.col("id")
    rows = spark.range(20).select((i % 5 + 1).alias("m"), (F.floor(i / 5) + 1).alias("c"))
    for r in rows.withColumn("p", risk.crop_shift(F.col("m"), F.col("c"))).collect():
        met = [float(k == r.m - 1) for k in range(5)]
        stress = [float(k == r.c - 1) for k in range(4)]
        assert r.p == pytest.approx(agri(spark, met, stress), abs=1e-12)


def test_confidence_bounds(spark):
    c = lambda v: spark.range(1).select(decision.confidence(F.array(*[F.lit(float(x)) for x in v])).alias("c")).head().c
    assert c([0.2] * 5) < 1e-9
    assert c([0, 0, 1, 0, 0]) > 1 - 1e-9
    assert 0 < c([0, 0, 0.1, 0.1, 0.8]) < 1


def test_missing_evidence_states(spark):
    nan = float("nan")
    for bad in (nan, None):
        v = F.lit(bad).cast("double")
        row = spark.range(1).select(
            C.current_index(v).alias("cur"), C.deficit_index(v).alias("de"), C.spatial_index(v).alias("spa"), C.trend_index(v).alias("trn"),
            C.tail_index(v).alias("tail"), C.wrsi_index(v).alias("w"), C.fpar_index(v).alias("f"), C.cdi_index(v).alias("k"), C.spi_label(v).alias("l"),
        ).head()
        assert tuple(row) == (2, 1, 1, 2, 1, 1, 1, 1, "Unknown")
    edges = [(0.3, 2), (-0.7, 3), (-1.2, 4), (-2.0, 5), (-0.5, 2), (-1.0, 3), (-1.5, 4)]
    got = spark.createDataFrame(edges, "z double, k int").withColumn("i", C.fpar_index(F.col("z")))
    assert got.where("i <> k").count() == 0


def test_indicator_truth_table(spark):
    """All 2^7 condition combinations against a direct reading of the rules."""
    names = ["v", "s", "l", "q", "m", "pq", "pm"]
    cols = {"v": ("fapar", -1.0), "s": ("sma", -1.0), "l": ("spi9_12", -1.0), "q": ("spi3", -1.0), "m": ("spi1", -2.0), "pq": ("spi3_prev", -1.0), "pm": ("spi1_prev", -2.0)}
    data = []
    for n in range(128):
        on = {c: bool(n >> i & 1) for i, c in enumerate(names)}
        data.append((n, *[cols[c][1] - 0.5 if on[c] else (None if n % 3 == 0 else float("nan") if n % 3 == 1 else 0.0) for c in names]))
    schema = "n int, " + ", ".join(f"{cols[c][0]} double" for c in names)
    got = {r.n: (r.cdi_class, r.cdi_level_idx) for r in cdi.classify_cells(spark.createDataFrame(data, schema)).collect()}
    level = {0: 1, 1: 4, 2: 4, 3: 4, 4: 5, 5: 5, 6: 5, 7: 6, 8: 6, 9: 6, 10: 6, 11: 3, 12: 3, 13: 2, 14: 2}
    for n in range(128):
        v, s, l, q, m, pq, pm = (bool(n >> i & 1) for i in range(7))
        if v and q:
            want = 10 if s and l else 9 if s else 8
        elif v and m:
            want = 7
        elif s and q:
            want = 6 if l else 5
        elif s and m:
            want = 4
        elif q:
            want = 3 if l else 2
        elif m:
            want = 1
        elif v and (pq or pm):
            want = 12 if pq else 11
        else:
            want = 14 if pq else 13 if pm else 0
        assert got[n] == (want, level[want]), n


def test_no_vegetation_caps_at_warning(spark):
    rows = spark.createDataFrame([(-2.0, -2.0, -3.0, -2.0, -3.0, -2.0)], "spi9_12 double, spi3 double, spi1 double, spi3_prev double, spi1_prev double, sma double")
    assert cdi.classify_cells(rows).head().cdi_class == 6
    assert [cdi.vegetation_source(t) for t in ("2012-02-01", "2012-01-31", "2000-12-31")] == ["gdo", "modis", "none"]
    with pytest.raises(ValueError):
        cdi.vegetation_source("2016-01-01", "modis")


def test_sequence_prior_stops_after_lookback(spark):
    lik = [0.1, 0.2, 0.4, 0.2, 0.1]
    rows = spark.createDataFrame([(1, f"2020-{m:02d}", lik) for m in range(1, 11)], "id int, month string, lik array<double>")
    plain = risk.monthly_sequence(rows, "id", "month", "lik").orderBy("month").collect()
    assert [r.temporal_prior for r in plain] == [False] + [True] * 5 + [False] * 4
    again = risk.monthly_sequence(rows, "id", "month", "lik", reset=True).orderBy("month").collect()
    assert [r.temporal_prior for r in again].count(True) > 5
    for r in plain:
        assert sum(r.posterior) == pytest.approx(1.0)


def test_full_assessment_switches(spark):
    row = [("a", -2.0, "Deteriorating", 0.9, 0.9, "High", -2.0, 6, 40.0, -2.0)]
    schema = "id string, current_spi3 double, spi3_trend string, forecast_deficit_prob double, spatial_coverage double, forecast_agreement string, ens_min_spi double, cdi_level_idx int, wrsi10_value double, fpar_value double"
    df = spark.createDataFrame(row, schema)
    plain = risk.assess(df).head()
    assert plain.risk_level == "Extreme" and "agri" not in plain.asDict()
    full = risk.assess(df, include_tail=True, include_cdi=True, include_crop=True, include_fpar=True).head()
    assert full.crop_stress == "Severe" and full.attention_state == "Review" and full.explanation.startswith("agri: ")
    off = risk.assess(df.drop("wrsi10_value"), include_crop=True).head()
    assert "agri" not in off.asDict()
    soft = risk.assess(df.drop("cdi_level_idx"), include_agreement=False).head()
    assert soft.posterior == pytest.approx(plain.posterior, abs=1e-12)


def test_tensor_is_the_table(spark):
    rows = risk.risk_table(spark).orderBy("agr", "cur", "def", "spa", "trn", "tail", "cdi").select("risk").collect()
    tensor = risk.risk_tensor()
    assert tensor.shape == (3, 5, 5, 3, 3, 4, 6, 5)
    assert [list(r.risk) for r in rows] == tensor.reshape(-1, 5).tolist()
