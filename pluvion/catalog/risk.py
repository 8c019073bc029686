"""Drought indicator and risk model on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.functions import categories as C
from pluvion.functions import decision, soft
from pluvion.plans import cdi, risk
from pluvion.session import spread

QUERIES, ORACLES, query = bind.area()

# ---- customers as districts with evidence

EVIDENCE_SQL = """
ev AS (SELECT c_custkey AS id, c_nationkey AS zone_id,
        CASE WHEN c_custkey % 29 <> 0 THEN (c_acctbal - 4500) / 2500 END AS current_spi3,
        CASE WHEN c_custkey % 31 <> 0 THEN (c_custkey * 37 % 101) / 100.0::DOUBLE END AS forecast_deficit_prob,
        (c_custkey * 53 % 101) / 100.0::DOUBLE AS spatial_coverage,
        CASE c_custkey % 4 WHEN 0 THEN 'improving ' WHEN 1 THEN 'Deteriorating' WHEN 2 THEN 'Stable' END AS spi3_trend,
        CASE c_custkey * 7 % 11 % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'high' END AS forecast_agreement,
        (c_custkey * 17 % 400) / 100.0::DOUBLE - 3 AS ens_min_spi,
        c_custkey * 13 % 8 AS cdi_level_idx, (c_custkey * 29 % 1000) / 9.0::DOUBLE AS wrsi10_value,
        CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey * 41 % 400) / 100.0::DOUBLE - 2.5 END AS fpar_value FROM customer),
idx AS (SELECT *, CASE WHEN current_spi3 IS NULL THEN 2 WHEN current_spi3 < -1.5 THEN 5 WHEN current_spi3 < -1 THEN 4
            WHEN current_spi3 < -0.5 THEN 3 WHEN current_spi3 < 0.5 THEN 2 ELSE 1 END AS cur,
        CASE WHEN forecast_deficit_prob IS NULL OR forecast_deficit_prob < 0.2e0 THEN 1 WHEN forecast_deficit_prob < 0.4e0 THEN 2
            WHEN forecast_deficit_prob < 0.6e0 THEN 3 WHEN forecast_deficit_prob < 0.8e0 THEN 4 ELSE 5 END AS def,
        CASE WHEN spatial_coverage < 0.3e0 THEN 1 WHEN spatial_coverage < 0.6e0 THEN 2 ELSE 3 END AS spa,
        CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS trn,
        CASE id * 7 % 11 % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS agr,
        CASE WHEN ens_min_spi < -1.5 THEN 4 WHEN ens_min_spi < -1 THEN 3 WHEN ens_min_spi < -0.5 THEN 2 ELSE 1 END AS tail,
        CAST(CASE WHEN cdi_level_idx BETWEEN 1 AND 6 THEN cdi_level_idx ELSE 1 END AS INTEGER) AS cdi FROM ev)
"""


def evidence(spark, d):
    k = F.col("c_custkey")
    m4, m11 = k % 4, k * 7 % 11 % 4
    return bind.table(spark, d, "customer").select(
        k.alias("id"),
        F.col("c_nationkey").alias("zone_id"),
        F.when(k % 29 != 0, (F.col("c_acctbal") - 4500) / 2500).alias("current_spi3"),
        F.when(k % 31 != 0, (k * 37 % 101) / F.lit(100.0)).alias("forecast_deficit_prob"),
        ((k * 53 % 101) / F.lit(100.0)).alias("spatial_coverage"),
        F.when(m4 == 0, "improving ").when(m4 == 1, "Deteriorating").when(m4 == 2, "Stable").alias("spi3_trend"),
        F.when(m11 == 0, "Low").when(m11 == 1, "Medium").when(m11 == 2, "high").alias("forecast_agreement"),
        ((k * 17 % 400) / F.lit(100.0) - 3).alias("ens_min_spi"),
        (k * 13 % 8).alias("cdi_level_idx"),
        ((k * 29 % 1000) / F.lit(9.0)).alias("wrsi10_value"),
        F.when(k % 6 != 0, (k * 41 % 400) / F.lit(100.0) - 2.5).alias("fpar_value"),
    )


def risk_cte(name: str, source: str, tail: str = "tail", cdi: str = "cdi", agr: str = "agr") -> str:
    """Risk vector ``p`` of the state columns of ``source`` as a table expression."""
    return f"""
{name}_s AS (SELECT *, {tail} - 1 AS _r, {cdi} - 1 AS _k, {agr} AS _a FROM {source}),
{name}_v AS (SELECT *, (cur - 1) * 0.3e0 + CASE _a WHEN 1 THEN 0.65e0 WHEN 2 THEN 0.85e0 ELSE 1e0 END
      * ((def - 1) * 0.55e0 + (CASE spa WHEN 3 THEN 0.5e0 WHEN 2 THEN 0.25e0 ELSE 0e0 END + CASE _r WHEN 3 THEN 0.6e0 WHEN 2 THEN 0.35e0 WHEN 1 THEN 0.1e0 ELSE 0e0 END)
         * (1e0 - 0.5e0 * (def - 1) / 4e0))
      + CASE trn WHEN 3 THEN 0.35e0 WHEN 1 THEN -0.3e0 ELSE 0e0 END
      + CASE _k WHEN 5 THEN 0.55e0 WHEN 4 THEN 0.3e0 WHEN 3 THEN 0.1e0 WHEN 1 THEN -0.15e0 ELSE 0e0 END AS score FROM {name}_s),
{name}_p AS (SELECT *, CASE
    WHEN _k = 5 AND def = 5 THEN [0, 0, 0, 0.2e0, 0.8e0]
    WHEN _k = 1 AND trn = 1 AND cur = 1 THEN [0.85e0, 0.15e0, 0, 0, 0]
    WHEN cur = 5 AND def >= 4 AND trn = 3 THEN CASE WHEN spa >= 2 THEN [0, 0, 0.05e0, 0.2e0, 0.75e0] ELSE [0, 0, 0.1e0, 0.4e0, 0.5e0] END
    WHEN cur >= 4 AND def >= 4 AND trn = 3 THEN [0, 0, 0.1e0, 0.5e0, 0.4e0]
    WHEN _r >= 2 AND cur >= 4 AND def <= 3 THEN CASE WHEN _r = 3 THEN [0, 0.1e0, 0.3e0, 0.45e0, 0.15e0] ELSE [0.05e0, 0.2e0, 0.45e0, 0.25e0, 0.05e0] END
    WHEN _r = 3 AND def <= 2 THEN [0.05e0, 0.2e0, 0.4e0, 0.3e0, 0.05e0]
    WHEN _r >= 2 AND trn = 3 AND def <= 3 THEN [0.05e0, 0.15e0, 0.45e0, 0.3e0, 0.05e0]
    WHEN cur = 1 AND def <= 3 AND _r <= 1 THEN [0.55e0, 0.35e0, 0.1e0, 0, 0]
    WHEN trn = 1 AND cur <= 2 AND def <= 2 AND _r <= 1 THEN [0.65e0, 0.3e0, 0.05e0, 0, 0]
    WHEN cur <= 2 AND def >= 4 THEN [0.1e0, 0.25e0, 0.45e0, 0.15e0, 0.05e0]
    WHEN score < 1 THEN [0.5e0, 0.4e0, 0.1e0, 0, 0] WHEN score < 2 THEN [0.1e0, 0.35e0, 0.4e0, 0.15e0, 0]
    WHEN score < 3 THEN [0.05e0, 0.15e0, 0.45e0, 0.3e0, 0.05e0] WHEN score < 4 THEN [0, 0.05e0, 0.25e0, 0.5e0, 0.2e0]
    ELSE [0, 0, 0.1e0, 0.4e0, 0.5e0] END AS _b, CASE _a WHEN 1 THEN 0.12e0 WHEN 2 THEN 0.05e0 ELSE 0e0 END AS _u FROM {name}_v),
{name} AS (SELECT *, list_transform(_b, lambda x: (1 - _u) * x + _u * 0.2e0) AS p FROM {name}_p)
"""


def _probs(alias="p"):
    names = ["risk_minimal", "risk_low", "risk_moderate", "risk_high", "risk_extreme"]
    return ", ".join(f"round({alias}[{i + 1}], 12) AS {n}" for i, n in enumerate(names))


# A cost-loss ratio whose thresholds no sum of the table values meets exactly.
RATIO = 0.2137


def decided(p: str, q: float = RATIO) -> str:
    """State of a list column ``p`` as SQL."""
    return (
        f"CASE WHEN {p}[4] + {p}[5] >= {q}e0 THEN 'Review' WHEN {p}[3] + {p}[4] + {p}[5] >= {max(2 * q, 0.4)}e0 THEN 'Assess' "
        f"WHEN {p}[2] + {p}[3] + {p}[4] + {p}[5] >= {max(3 * q, 0.3)}e0 THEN 'Evaluate' ELSE 'Monitor' END"
    )


_LEVEL = "['Minimal', 'Low', 'Moderate', 'High', 'Extreme'][list_position(p, list_max(p))]"


def rounded(posterior="posterior", prefix="risk_"):
    return [F.round(F.col(posterior)[i], 12).alias(prefix + s.lower()) for i, s in enumerate(C.RISK_STATES)]


@query(
    "evidence_states",
    bind.with_sql(
        """SELECT id, CAST(cur AS INTEGER) AS cur, CAST(def AS INTEGER) AS def, CAST(spa AS INTEGER) AS spa, CAST(trn AS INTEGER) AS trn, CAST(agr AS INTEGER) AS agr,
          CAST(tail AS INTEGER) AS tail, cdi, CASE WHEN current_spi3 IS NULL THEN 'Unknown' ELSE ['Above_Normal', 'Normal', 'Mild_Drought', 'Moderate_Drought', 'Severe_Drought'][cur] END AS spi_label,
          CASE WHEN fpar_value IS NULL THEN 'Unknown' WHEN fpar_value >= -0.5 THEN 'Healthy' WHEN fpar_value >= -1 THEN 'Mild' WHEN fpar_value >= -1.5 THEN 'Moderate' ELSE 'Severe_Decline' END AS fpar_class,
          CASE WHEN wrsi10_value >= 80 THEN 'No_Stress' WHEN wrsi10_value >= 65 THEN 'Mild' WHEN wrsi10_value >= 50 THEN 'Moderate' ELSE 'Severe' END AS wrsi_class FROM idx""",
        EVIDENCE_SQL,
    ),
)
def evidence_states(spark, d):
    rows = risk.with_indices(evidence(spark, d))
    return rows.select(
        "id", *[F.col(c).cast("int").alias(c) for c in ("cur", "def", "spa", "trn", "agr", "tail", "cdi")],
        C.spi_label(F.col("current_spi3")).alias("spi_label"),
        C.state_label(C.fpar_index(F.col("fpar_value")), C.FPAR_STATES).alias("fpar_class"),
        C.state_label(C.wrsi_index(F.col("wrsi10_value")), C.WRSI_STATES).alias("wrsi_class"),
    )


@query(
    "trend_labels",
    """SELECT o_orderkey, CASE WHEN s > 0.1e0 THEN 'Improving' WHEN s < -0.1e0 THEN 'Deteriorating' ELSE 'Stable' END AS trend
       FROM (SELECT o_orderkey, (o_totalprice - 250000) / 1e6 AS s FROM orders)""",
)
def trend_labels(spark, d):
    slope = (F.col("o_totalprice") - 250000) / 1e6
    return bind.table(spark, d, "orders").select(
        "o_orderkey", C.state_label(C.trend_index(slope), C.TREND_STATES).alias("trend")
    )


_BIN_SQL = """
nodes AS (SELECT id, 'cur' AS node, current_spi3 AS x, 0.3e0 AS s, [-1.5e0, -1e0, -0.5e0, 0.5e0] AS e, true AS rev FROM ev
  UNION ALL SELECT id, 'def', forecast_deficit_prob, 0.05e0, [0.2e0, 0.4e0, 0.6e0, 0.8e0], false FROM ev
  UNION ALL SELECT id, 'spa', spatial_coverage, 0.05e0, [0.3e0, 0.6e0], false FROM ev
  UNION ALL SELECT id, 'trn', fpar_value / 4, 0.1e0, [-0.3e0, 0.3e0], true FROM ev
  UNION ALL SELECT id, 'tail', ens_min_spi, 0.2e0, [-1.5e0, -1e0, -0.5e0], true FROM ev),
zs AS (SELECT id, node, x, rev, len(e) + 1 AS k, i, (e[i] - x) / s AS z, abs((e[i] - x) / s) AS a FROM nodes, generate_series(0, 5) t(i) WHERE i <= len(e) + 1),
tails AS (SELECT *, CASE WHEN a > 37 THEN 0e0 WHEN a < 7.07106781186547e0 THEN exp(-a * a / 2)
    * ((((((3.52624965998911e-2 * a + 0.700383064443688e0) * a + 6.37396220353165e0) * a + 33.912866078383e0) * a + 112.079291497871e0) * a + 221.213596169931e0) * a + 220.206867912376e0)
    / (((((((8.83883476483184e-2 * a + 1.75566716318264e0) * a + 16.064177579207e0) * a + 86.7807322029461e0) * a + 296.564248779674e0) * a + 637.333633378831e0) * a + 793.826512519948e0) * a + 440.413735824752e0)
    ELSE exp(-a * a / 2) / (a + 1e0 / (a + 2e0 / (a + 3e0 / (a + 4e0 / (a + 0.65e0))))) / 2.506628274631e0 END AS q FROM zs),
cdf AS (SELECT *, CASE WHEN i = 0 THEN 0e0 WHEN i = k THEN 1e0 WHEN z > 0 THEN 1 - q ELSE q END AS c FROM tails),
mass AS (SELECT id, node, CASE WHEN rev THEN k - i + 1 ELSE i END AS b,
    CASE WHEN x IS NULL THEN 1e0 / k ELSE c - lag(c) OVER (PARTITION BY id, node ORDER BY i) END AS m, i FROM cdf)
"""
_BIN_COLUMNS = ", ".join(
    f"max(round_even(m, 4)) FILTER (node = '{n}' AND b = {i} AND i > 0) AS {n}_p{i}"
    for n, k in [("cur", 5), ("def", 5), ("spa", 3), ("trn", 3), ("tail", 4)]
    for i in range(1, k + 1)
)


@query("soft_evidence", bind.with_sql(f"SELECT id, {_BIN_COLUMNS} FROM mass GROUP BY id", EVIDENCE_SQL, _BIN_SQL))
def soft_evidence(spark, d):
    nodes = {
        "cur": F.col("current_spi3"), "def": F.col("forecast_deficit_prob"), "spa": F.col("spatial_coverage"),
        "trn": F.col("fpar_value") / 4, "tail": F.col("ens_min_spi"),
    }
    return soft.add_soft_columns(evidence(spark, d), nodes).select(
        "id", *[f"{n}_p{i + 1}" for n in nodes for i in range(len(soft.SOFT_NODES[n][0]) + 1)]
    )


@query(
    "phase_soft",
    bind.with_sql(
        """, s AS (SELECT id, CASE WHEN id % 6 <> 0 THEN wrsi10_value / 111 END AS x FROM ev),
        r AS (SELECT id, x, least(greatest((x - (0.55e0 - 0.07e0)) / (2 * 0.07e0), 0), 1) AS a, least(greatest((x - (0.7e0 - 0.07e0)) / (2 * 0.07e0), 0), 1) AS b FROM s)
        SELECT id, round(CASE WHEN x IS NULL THEN 1.0 ELSE 1 - a END, 6) AS p1, round(CASE WHEN x IS NULL THEN 0.0 ELSE a - b END, 6) AS p2, round(CASE WHEN x IS NULL THEN 0.0 ELSE b END, 6) AS p3 FROM r""",
        EVIDENCE_SQL,
    ),
)
def phase_soft(spark, d):
    stage = F.when(F.col("id") % 6 != 0, F.col("wrsi10_value") / 111)
    out = evidence(spark, d).select("id", soft.phase_soft(stage).alias("p"))
    return out.select("id", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)])


@query(
    "cpt_lookup",
    bind.with_sql(f"SELECT id, {_probs()}, {_LEVEL} AS risk_level FROM r", EVIDENCE_SQL, risk_cte("r", "idx")),
)
def cpt_lookup(spark, d):
    rows = risk.infer_hard(risk.with_indices(evidence(spark, d)), include_tail=True, include_cdi=True)
    return rows.select("id", *rounded(), decision.top_state(F.col("posterior")).alias("risk_level"))


def _blurred(spark, d):
    """Evidence whose current state leaks into the next wetter one and whose trend is unsure."""
    rows = risk.evidence_vectors(risk.with_indices(evidence(spark, d)))
    lean = F.array(*[F.when(F.col("cur") == i, 0.75).when(F.greatest(F.col("cur") - 1, F.lit(1)) == i, 0.25).otherwise(0.0) for i in range(1, 6)])
    lean = F.when(F.col("cur") == 1, risk.one_hot(F.lit(1), 5)).otherwise(lean)
    return rows.withColumn("ev_cur", lean).withColumn("ev_trn", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)))


_BLUR = """
blur AS (SELECT id, c.cur, def, spa, t.trn, agr, tail, cdi, c.w * t.w AS w
  FROM (SELECT id, def, spa, agr, tail, cdi, unnest([cur, greatest(cur - 1, 1)]) AS cur, unnest([0.75e0, 0.25e0]) AS w FROM idx) c,
       (VALUES (1, 0.25e0), (2, 0.5e0), (3, 0.25e0)) t(trn, w))
"""
_BLUR_SUM = """
m AS (SELECT id, [sum(w * p[1]), sum(w * p[2]), sum(w * p[3]), sum(w * p[4]), sum(w * p[5])] AS p FROM r GROUP BY id)
"""


@query(
    "soft_inference",
    bind.with_sql(f"SELECT id, {_probs()} FROM m", EVIDENCE_SQL, _BLUR, risk_cte("r", "blur"), _BLUR_SUM),
)
def soft_inference(spark, d):
    return risk.infer_soft_long(_blurred(spark, d), ["id"], F.col("agr")).select("id", *rounded())


@query(
    "soft_inference_batch",
    bind.with_sql(f"SELECT id, {_probs()} FROM m", EVIDENCE_SQL, _BLUR, risk_cte("r", "blur"), _BLUR_SUM),
)
def soft_inference_batch(spark, d):
    return risk.infer_soft(_blurred(spark, d), F.col("agr")).select("id", *rounded())


@query(
    "agreement_blend",
    bind.with_sql(
        f""", b AS (SELECT id, list_transform(p, lambda x: CASE agr WHEN 1 THEN 0.5e0 * x + 0.1e0 WHEN 2 THEN 0.8e0 * x + 0.2e0 * 0.2e0 ELSE x END) AS p FROM r) SELECT id, {_probs()} FROM b""",
        EVIDENCE_SQL,
        risk_cte("r", "idx", agr="3"),
    ),
)
def agreement_blend(spark, d):
    rows = risk.infer_hard(risk.with_indices(evidence(spark, d)), include_agreement=False, include_tail=True, include_cdi=True)
    return rows.withColumn("posterior", risk.agreement_blend(F.col("posterior"), F.col("agr"))).select("id", *rounded())


@query(
    "attention_decision",
    bind.with_sql(
        f"""SELECT id, {_LEVEL} AS risk_level, {decided('p')} AS attention_state,
          round(greatest(least(1 + list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(5), 1), 0), 6) AS confidence FROM r""",
        EVIDENCE_SQL,
        risk_cte("r", "idx"),
    ),
)
def attention_decision(spark, d):
    rows = risk.infer_hard(risk.with_indices(evidence(spark, d)), include_tail=True, include_cdi=True)
    out = risk.decide(rows, RATIO)
    return out.select("id", "risk_level", "attention_state", F.round("confidence", 6).alias("confidence"))


_TWENTIETHS = """
p20 AS (SELECT p_partkey AS id, [(20 - k % 5 - k // 5 % 5 - k // 25 % 5 - k // 125 % 5) / 20e0, (k // 125 % 5) / 20e0, (k // 25 % 5) / 20e0, (k // 5 % 5) / 20e0, (k % 5) / 20e0] AS p FROM (SELECT p_partkey, p_partkey AS k FROM part))
"""


@query("attention_default", bind.with_sql(f"SELECT id, {decided('p', 0.2)} AS attention_state FROM p20", _TWENTIETHS))
def attention_default(spark, d):
    """Exact twentieths, so that many masses lie on a limit, under the default ratio."""
    k = F.col("p_partkey")
    digit = lambda n: F.floor(k / n) % 5
    parts = [F.lit(20) - digit(1) - digit(5) - digit(25) - digit(125), digit(125), digit(25), digit(5), digit(1)]
    p = F.array(*[x / F.lit(20.0) for x in parts])
    return bind.table(spark, d, "part").select(k.alias("id"), decision.attention(p)["state"].alias("attention_state"))


@query(
    "risk_distribution",
    bind.with_sql(f"SELECT {_LEVEL} AS risk_level, count(*) AS n FROM r GROUP BY 1", EVIDENCE_SQL, risk_cte("r", "idx")),
)
def risk_distribution(spark, d):
    return risk.state_counts(cpt_lookup(spark, d), "risk_level")


_CROP_SQL = """
crop_s AS (SELECT *, CASE WHEN wrsi10_value >= 80 THEN 0 WHEN wrsi10_value >= 65 THEN 1 WHEN wrsi10_value >= 50 THEN 2 ELSE 3 END AS w,
   CASE WHEN fpar_value IS NULL THEN NULL WHEN fpar_value >= -0.5 THEN 0 WHEN fpar_value >= -1 THEN 1 WHEN fpar_value >= -1.5 THEN 2 ELSE 3 END AS f, 1 + id % 3 AS ph FROM r),
crop_t AS (SELECT *, 1 + least(greatest(CASE WHEN f IS NULL THEN w ELSE (0.7e0 * w + 0.8e0 * f + 0.25e0 * least(w, f)) * CASE WHEN f = 0 AND w > 0 THEN 0.75e0 ELSE 1e0 END END
     * CASE ph WHEN 2 THEN 1.25e0 WHEN 3 THEN 0.75e0 ELSE 1e0 END, 0), 3) AS t FROM crop_s),
crop AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = floor(t) THEN 1 - (t - floor(t)) WHEN i = floor(t) + 1 THEN t - floor(t) ELSE 0e0 END) AS q FROM crop_t)
"""


def _crop_rows(spark, d):
    rows = risk.infer_hard(risk.with_indices(spread(evidence(spark, d))), include_tail=True, include_cdi=True)
    phase = (F.col("id") % 3 + 1).cast("int")
    crop = risk.infer_crop(
        risk.one_hot(C.wrsi_index(F.col("wrsi10_value")), 4),
        risk.one_hot(C.fpar_index(F.col("fpar_value")), 5),
        risk.one_hot(phase, 3),
    )
    return rows.withColumn("crop", crop)


@query(
    "crop_stress",
    bind.with_sql(
        "SELECT id, round(q[1], 12) AS crop_none, round(q[2], 12) AS crop_mild, round(q[3], 12) AS crop_moderate, round(q[4], 12) AS crop_severe FROM crop",
        EVIDENCE_SQL, risk_cte("r", "idx"), _CROP_SQL,
    ),
)
def crop_stress(spark, d):
    names = ["crop_none", "crop_mild", "crop_moderate", "crop_severe"]
    return _crop_rows(spark, d).select("id", *[F.round(F.col("crop")[i], 12).alias(n) for i, n in enumerate(names)])


@query(
    "agri_risk",
    bind.with_sql(
        f""", mc AS (SELECT id, m, p[m] * q[c] AS wt, m + [0e0, 0.4e0, 0.9e0, 1.5e0][c] * (1 - 0.5e0 * (m - 1) / 4e0) AS t0
             FROM crop, (VALUES (1), (2), (3), (4), (5)) a(m), (VALUES (1), (2), (3), (4)) b(c)),
        tt AS (SELECT id, wt, least(t0, 5) AS t FROM mc),
        ag AS (SELECT id, [{", ".join(f"sum(wt * CASE WHEN floor(t) = {i} THEN 1 - (t - floor(t)) WHEN floor(t) + 1 = {i} THEN t - floor(t) ELSE 0 END)" for i in range(1, 6))}] AS p FROM tt GROUP BY id)
        SELECT id, {_probs("list_transform(p, lambda x: x + 1e-13)")} FROM ag""",
        EVIDENCE_SQL, risk_cte("r", "idx"), _CROP_SQL,
    ),
)
def agri_risk(spark, d):
    rows = _crop_rows(spark, d).withColumn("posterior", risk.agricultural_risk(F.col("posterior"), F.col("crop")))
    # Many results end exactly on a half of the last shown digit; a nudge settles those in both engines.
    rows = rows.withColumn("posterior", F.transform("posterior", lambda p: p + 1e-13))
    return rows.select("id", *rounded())


_AGRI_SQL = f"""
mc AS (SELECT id, m, p[m] * q[c] AS wt, m + [0e0, 0.4e0, 0.9e0, 1.5e0][c] * (1 - 0.5e0 * (m - 1) / 4e0) AS t0
       FROM crop, (VALUES (1), (2), (3), (4), (5)) a(m), (VALUES (1), (2), (3), (4)) b(c)),
tt AS (SELECT id, wt, least(t0, 5) AS t FROM mc),
ag AS (SELECT id, [{", ".join(f"sum(wt * CASE WHEN floor(t) = {i} THEN 1 - (t - floor(t)) WHEN floor(t) + 1 = {i} THEN t - floor(t) ELSE 0 END)" for i in range(1, 6))}] AS g FROM tt GROUP BY id)
"""


@query(
    "full_assessment",
    bind.with_sql(
        f"""SELECT id, {_LEVEL} AS risk_level, {decided('p')} AS attention_state_met, ['No_Stress', 'Mild', 'Moderate', 'Severe'][list_position(q, list_max(q))] AS crop_stress,
          {decided('g')} AS attention_state, round(greatest(least(1 + list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(5), 1), 0), 6) AS confidence_met,
          {_probs()}, round(g[1] + 1e-13, 9) AS agri_minimal, round(g[5] + 1e-13, 9) AS agri_extreme FROM crop JOIN ag USING (id)""",
        EVIDENCE_SQL, risk_cte("r", "idx"), _CROP_SQL.replace("1 + id % 3 AS ph", "1 AS ph"), _AGRI_SQL,
    ),
)
def full_assessment(spark, d):
    out = risk.assess(spread(evidence(spark, d)), include_tail=True, include_cdi=True, include_crop=True, include_fpar=True, ratio=RATIO)
    agri = F.col("agri")
    return out.select(
        "id", "risk_level", "attention_state_met", "crop_stress", "attention_state", F.round("confidence_met", 6).alias("confidence_met"),
        *rounded(), F.round(agri[0] + 1e-13, 9).alias("agri_minimal"), F.round(agri[4] + 1e-13, 9).alias("agri_extreme"),
    )


# ---- monthly sequences: orders give one evidence row per customer and month

_SEQ_SQL = """
mm AS (SELECT o_custkey % 500 AS id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS v, min(o_orderkey % 4) AS k FROM orders GROUP BY 1, 2),
sx AS (SELECT id, month, CAST(1 + floor(v / 60000) % 5 AS INTEGER) AS cur, CAST(1 + (n * 7 + id) % 5 AS INTEGER) AS def, CAST(1 + id % 3 AS INTEGER) AS spa,
          CAST(1 + k % 3 AS INTEGER) AS trn, CAST(1 + (id + n) % 4 AS INTEGER) AS tail FROM mm)
"""


def _sequence_states(spark, d):
    m = (
        bind.table(spark, d, "orders")
        .groupBy((F.col("o_custkey") % 500).alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"), F.min(F.col("o_orderkey") % 4).alias("k"))
    )
    return m.select(
        "id", "month",
        (F.floor(F.col("v") / 60000) % 5 + 1).cast("int").alias("cur"),
        ((F.col("n") * 7 + F.col("id")) % 5 + 1).cast("int").alias("def"),
        (F.col("id") % 3 + 1).cast("int").alias("spa"),
        (F.col("k") % 3 + 1).cast("int").alias("trn"),
        ((F.col("id") + F.col("n")) % 4 + 1).cast("int").alias("tail"),
        F.lit(3).alias("agr"), F.lit(1).alias("cdi"),
    )


@query(
    "dbn_sequence",
    "WITH RECURSIVE "
    + _SEQ_SQL.strip()
    + ", "
    + risk_cte("r", "sx", cdi="1", agr="3").strip()
    + f""", o AS (SELECT id, month, p, row_number() OVER (PARTITION BY id ORDER BY month) AS i FROM r),
    f(id, month, i, p, cl, prior) AS (SELECT id, month, i, p, 1, false FROM o WHERE i = 1
      UNION ALL SELECT o.id, o.month, o.i,
        CASE WHEN f.cl < 6 THEN list_transform(list_zip(o.p, f.p), lambda z: z[1] * (0.6e0 * z[2] + 0.4e0 * 0.2e0)
              / list_sum(list_transform(list_zip(o.p, f.p), lambda y: y[1] * (0.6e0 * y[2] + 0.4e0 * 0.2e0)))) ELSE o.p END,
        f.cl + 1, f.cl < 6 FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1)
    SELECT id, month, prior AS temporal_prior, {_probs()} FROM f""",
)
def dbn_sequence(spark, d):
    lik = risk.infer_hard(_sequence_states(spark, d), include_agreement=False, include_tail=True)
    out = risk.monthly_sequence(lik, "id", "month", "posterior")
    return out.select("id", "month", "temporal_prior", *rounded())


@query("storylines")
def storylines(spark, d):
    return _storyline_rows(spark, d)


_ENS_RISK = """
ens AS (SELECT label AS zone_id, CAST((i - 1) // 8 AS INTEGER) AS member, vec_id AS cell, min(CAST(embedding[i] AS DOUBLE) * 10) AS m
        FROM embeddings, unnest(generate_series(1, len(embedding))) t(i) GROUP BY ALL),
ms AS (SELECT zone_id, member, avg(CASE WHEN m <= -1 THEN 1.0 ELSE 0.0 END) AS share, avg(m) AS mean FROM ens GROUP BY ALL),
sx AS (SELECT zone_id, member, CAST(1 + zone_id % 5 AS INTEGER) AS cur, CASE WHEN round(share, 9) < 0.2e0 THEN 1 WHEN round(share, 9) < 0.4e0 THEN 2 WHEN round(share, 9) < 0.6e0 THEN 3 WHEN round(share, 9) < 0.8e0 THEN 4 ELSE 5 END AS def,
         CASE WHEN round(share, 9) < 0.3e0 THEN 1 WHEN round(share, 9) < 0.6e0 THEN 2 ELSE 3 END AS spa, CAST(1 + member % 3 AS INTEGER) AS trn,
         CASE WHEN round(mean, 9) < -1.5 THEN 4 WHEN round(mean, 9) < -1 THEN 3 WHEN round(mean, 9) < -0.5 THEN 2 ELSE 1 END AS tail FROM ms)
"""


def _storyline_rows(spark, d):
    pos = F.col("pos")
    cells = (
        bind.table(spark, d, "embeddings")
        .select(F.col("vec_id").alias("cell"), F.col("label").alias("zone_id"), F.posexplode("embedding").alias("pos", "raw"))
        .groupBy("zone_id", F.floor(pos / 8).cast("int").alias("member"), "cell")
        .agg(F.min(F.col("raw").cast("double") * 10).alias("m"))
    )
    stats = cells.groupBy("zone_id", "member").agg(
        F.round(F.avg((F.col("m") <= -1).cast("double")), 9).alias("member_def_frac"), F.round(F.avg("m"), 9).alias("member_min_spi")
    )
    spi = F.element_at(F.array(*[F.lit(v) for v in (1.0, 0.0, -0.7, -1.2, -2.0)]), (F.col("zone_id") % 5 + 1).cast("int"))
    rows = stats.select(
        "zone_id", "member", spi.alias("current_spi3"),
        C.state_label(F.col("member") % 3 + 1, C.TREND_STATES).alias("spi3_trend"),
        "member_def_frac", F.col("member_def_frac").alias("member_spa_cov"), "member_min_spi",
    )
    post = risk.member_posteriors(rows, ["zone_id", "member"]).withColumn("p_high_extreme", F.round("p_high_extreme", 9))
    out = risk.storylines(post, ["zone_id"], "member")
    return out.select("storyline", "zone_id", "member", "n_members", "probability", "p_high_extreme", "risk_level")


ORACLES["storylines"] = bind.with_sql(
    f""", x AS (SELECT *, round(p[4] + p[5], 9) AS v, {_LEVEL} AS risk_level FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY v DESC, member) AS i, count(*) OVER (PARTITION BY zone_id) AS n,
             count(*) OVER (PARTITION BY zone_id ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge FROM x)
    SELECT s.storyline, zone_id, member, n AS n_members, round_even(ge / n, 3) AS probability, v AS p_high_extreme, risk_level
    FROM k JOIN (VALUES ('worst'), ('median'), ('best')) s(storyline)
      ON i = CASE s.storyline WHEN 'worst' THEN 1 WHEN 'median' THEN n // 2 + 1 ELSE n END""",
    _ENS_RISK,
    risk_cte("r", "sx", cdi="1", agr="3"),
)


# ---- combined drought indicator: line items as cells with seven inputs

CDI_SQL = """
cells AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_suppkey % 25 AS zone_id,
   CASE WHEN l_tax <= 0.07 THEN -l_quantity / 20 END AS spi9_12, -l_quantity / 25 AS spi3, CAST(l_partkey % 100 AS DOUBLE) / -40 AS spi1,
   CAST(l_suppkey % 10 AS DOUBLE) / -5 AS spi3_prev, CAST(l_orderkey % 13 AS DOUBLE) / -5 AS spi1_prev,
   -l_discount * 20 AS sma, CASE WHEN l_linenumber <> 4 THEN CAST(l_orderkey % 7 AS DOUBLE) / -4 END AS fapar, l_orderkey % 17 AS pub FROM lineitem),
cls AS (SELECT *, CASE WHEN v AND s AND l AND q THEN 10 WHEN v AND s AND q THEN 9 WHEN v AND q THEN 8 WHEN v AND m THEN 7 WHEN s AND l AND q THEN 6 WHEN s AND q THEN 5
    WHEN s AND m THEN 4 WHEN l AND q THEN 3 WHEN q THEN 2 WHEN m THEN 1 WHEN v AND pq THEN 12 WHEN v AND pm THEN 11 WHEN pq THEN 14 WHEN pm THEN 13 ELSE 0 END AS klass
  FROM (SELECT *, coalesce(spi9_12 < -1, false) AS l, coalesce(spi3 < -1, false) AS q, coalesce(spi1 < -2, false) AS m, coalesce(spi3_prev < -1, false) AS pq,
           coalesce(spi1_prev < -2, false) AS pm, coalesce(sma < -1, false) AS s, coalesce(fapar < -1, false) AS v FROM cells)),
lvl AS (SELECT *, [1, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 3, 3, 2, 2][klass + 1] AS level FROM cls)
"""


def cdi_cells(spark, d):
    k = F.col
    neg = lambda c, by: c.cast("double") / F.lit(-float(by))
    return bind.table(spark, d, "lineitem").select(
        k("l_orderkey").alias("ok"), k("l_linenumber").alias("ln"), (k("l_suppkey") % 25).alias("zone_id"),
        F.when(k("l_tax") <= 0.07, -k("l_quantity") / 20).alias("spi9_12"),
        (-k("l_quantity") / 25).alias("spi3"),
        neg(k("l_partkey") % 100, 40).alias("spi1"),
        neg(k("l_suppkey") % 10, 5).alias("spi3_prev"),
        neg(k("l_orderkey") % 13, 5).alias("spi1_prev"),
        (-k("l_discount") * 20).alias("sma"),
        F.when(k("l_linenumber") != 4, neg(k("l_orderkey") % 7, 4)).alias("fapar"),
        (k("l_orderkey") % 17).cast("double").alias("pub"),
    )


@query(
    "cdi_cascade",
    bind.with_sql("SELECT ok, ln, klass AS cdi_class, level AS cdi_level_idx, zone_id FROM lvl", CDI_SQL),
)
def cdi_cascade(spark, d):
    return cdi.classify_cells(cdi_cells(spark, d)).select("ok", "ln", "cdi_class", "cdi_level_idx", "zone_id")


def _district_sql(level, klass, suffix, source):
    return f"""
d{suffix} AS (SELECT zone_id, max({level}) AS ml FROM {source} GROUP BY zone_id),
n{suffix} AS (SELECT zone_id, {klass} AS k, count(*) AS n FROM {source} GROUP BY ALL),
o{suffix} AS (SELECT s.zone_id, ml, max({klass}) FILTER ({level} = ml) AS mk, avg(CASE WHEN {level} = ml THEN 1.0 ELSE 0.0 END) AS fr,
   (SELECT arg_min(k, (-n, k)) FROM n{suffix} n WHERE n.zone_id = s.zone_id) AS mode FROM {source} s JOIN d{suffix} USING (zone_id) GROUP BY s.zone_id, ml)
"""


_NAMES = "['No_drought', 'Full_recovery', 'Partial_recovery', 'Watch', 'Warning', 'Alert']"


@query(
    "cdi_districts",
    bind.with_sql(
        f"""SELECT zone_id, a.mk AS cdi_class_recomp, a.ml AS cdi_level_idx_recomp, {_NAMES}[a.ml] AS cdi_level_recomp, round_even(a.fr, 4) AS cdi_level_fraction_recomp, a.mode AS cdi_modal_class_recomp,
             b.mk AS cdi_class_published, b.ml AS cdi_level_idx_published, {_NAMES}[b.ml] AS cdi_level_published, round_even(b.fr, 4) AS cdi_level_fraction_published, b.mode AS cdi_modal_class_published, a.ml = b.ml AS cdi_agreement
        FROM oa a JOIN ob b USING (zone_id)""",
        CDI_SQL,
        _district_sql("level", "klass", "a", "lvl"),
        "pubs AS (SELECT zone_id, CAST(least(pub, 14) AS INTEGER) AS pk, [1, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 3, 3, 2, 2][least(pub, 14) + 1] AS pl FROM cells)",
        _district_sql("pl", "pk", "b", "pubs"),
    ),
)
def cdi_districts(spark, d):
    cells = cdi_cells(spark, d)
    recomputed = cdi.classify_cells(cells)
    published = cdi.published_cells(cells, "pub")
    return cdi.compare_sources(recomputed, published, ["zone_id"])


_LIK = """
lk(lv, v) AS (VALUES (1, [0.50e0, 0.30e0, 0.10e0, 0.05e0, 0.02e0]), (2, [0.25e0, 0.25e0, 0.15e0, 0.05e0, 0.03e0]), (3, [0.10e0, 0.20e0, 0.20e0, 0.10e0, 0.05e0]),
   (4, [0.10e0, 0.15e0, 0.25e0, 0.20e0, 0.15e0]), (5, [0.04e0, 0.08e0, 0.20e0, 0.30e0, 0.25e0]), (6, [0.01e0, 0.02e0, 0.10e0, 0.30e0, 0.50e0])),
u0 AS (SELECT r.id, r.p AS prior, a.v AS va, b.v AS vb, (a.lv IS NOT NULL OR b.lv IS NOT NULL) AS usable FROM r
   LEFT JOIN lk a ON a.lv = r.cdi_level_idx AND r.id % 10 <> 9 LEFT JOIN lk b ON b.lv = r.id % 9 AND r.id % 10 <> 9),
u1 AS (SELECT *, list_transform([1, 2, 3, 4, 5], lambda i: prior[i] * coalesce(va[i], 1) * coalesce(vb[i], 1)) AS q FROM u0),
u AS (SELECT id, prior, usable, CASE WHEN usable THEN list_transform(q, lambda x: x / list_sum(q)) ELSE prior END AS p FROM u1)
"""


@query(
    "bayes_update",
    bind.with_sql(
        f"""SELECT id, usable AS updated, round(p[1], 6) AS risk_minimal, round(p[5], 6) AS risk_extreme, CASE WHEN usable THEN {_LEVEL} END AS risk_level,
          {decided('p')} AS attention_state, {decided('prior')} AS attention_state_pre FROM u""",
        EVIDENCE_SQL, risk_cte("r", "idx", cdi="1"), _LIK,
    ),
)
def bayes_update(spark, d):
    out = _updated(spark, d)
    return out.select(
        "id", "updated", F.round(F.col("posterior")[0], 6).alias("risk_minimal"), F.round(F.col("posterior")[4], 6).alias("risk_extreme"),
        "risk_level", "attention_state", "attention_state_pre",
    )


def _updated(spark, d):
    ev = evidence(spark, d)
    rows = risk.decide(risk.infer_hard(risk.with_indices(ev), include_tail=True), RATIO).select("id", "posterior", "attention_state")
    levels = ev.where("id % 10 <> 9").select("id", F.col("cdi_level_idx").alias("level_a"), (F.col("id") % 9).alias("level_b"))
    return cdi.update_posterior(rows, levels, "id", ["level_a", "level_b"], RATIO)


@query(
    "bayes_update_counts",
    bind.with_sql(
        f"""SELECT count(*) AS n_rows, count(*) FILTER (usable) AS n_updated, count(*) FILTER (usable AND {decided('p')} <> {decided('prior')}) AS n_changed FROM u""",
        EVIDENCE_SQL, risk_cte("r", "idx", cdi="1"), _LIK,
    ),
)
def bayes_update_counts(spark, d):
    return cdi.change_counts(_updated(spark, d))
