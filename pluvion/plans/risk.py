"""Discrete drought risk model: evidence to posterior, crop branch, sequences, storylines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.functions import categories as C
from pluvion.functions.decision import array_sum, attention, bound, confidence, normalise, top_state
from pluvion.operators.filters import soft_columns

# Weights of the additive risk score.
CURRENT_WEIGHT, DEFICIT_WEIGHT = 0.30, 0.55
FORECAST_TRUST = (0.65, 0.85, 1.00)
SPATIAL_ADD = (0.0, 0.25, 0.5)
TAIL_ADD = (0.0, 0.10, 0.35, 0.60)
TREND_ADD = (-0.30, 0.0, 0.35)
CDI_ADD = (0.0, -0.15, 0.0, 0.10, 0.30, 0.55)
EVEN_MIX = (0.12, 0.05, 0.0)
SHARED_SIGNAL = 0.5

# Probabilities by score, each up to its limit.
SCORE_BANDS = [
    (1.0, (0.50, 0.40, 0.10, 0.0, 0.0)),
    (2.0, (0.10, 0.35, 0.40, 0.15, 0.0)),
    (3.0, (0.05, 0.15, 0.45, 0.30, 0.05)),
    (4.0, (0.0, 0.05, 0.25, 0.50, 0.20)),
    (None, (0.0, 0.0, 0.10, 0.40, 0.50)),
]
# Crop stress score, phase factors, upward shift per crop state and its discount.
WATER_WEIGHT, LEAF_WEIGHT, BOTH_BONUS, HEALTHY_FACTOR = 0.70, 0.80, 0.25, 0.75
PHASE_FACTOR = (1.0, 1.25, 0.75)
CROP_SHIFT = (0.0, 0.4, 0.9, 1.5)
CROP_SHARED_SIGNAL = 0.5
# Blend of the optional agreement helper.
AGREEMENT_BLEND = (0.5, 0.8, 1.0)

PARENTS = {"cur": 5, "def": 5, "spa": 3, "trn": 3, "tail": 4, "cdi": 6}


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _pick(values: Sequence[float], index: Column) -> Column:
    return F.element_at(_vector(values), index.cast("int"))


def risk_probabilities(
    current: Column, deficit: Column, spatial: Column, trend: Column, agreement: Column,
    tail: Column | None = None, cdi: Column | None = None, shared_signal: float = SHARED_SIGNAL,
) -> Column:
    """Risk vector of one combination of parent states (all indices from 1).

    A row-local expression: hard evidence needs neither a table nor a join.
    """
    tail = F.lit(1) if tail is None else tail
    cdi = F.lit(1) if cdi is None else cdi
    d = deficit - 1
    fresh = 1.0 - F.lit(float(shared_signal)) * d / 4.0
    score = (current - 1) * F.lit(CURRENT_WEIGHT) + _pick(FORECAST_TRUST, agreement) * (
        d * F.lit(DEFICIT_WEIGHT) + (_pick(SPATIAL_ADD, spatial) + _pick(TAIL_ADD, tail)) * fresh
    )
    score = score + _pick(TREND_ADD, trend)
    score = score + _pick(CDI_ADD, cdi)
    probs = _widened(SCORE_BANDS[-1][1], agreement)
    for limit, values in reversed(SCORE_BANDS[:-1]):
        probs = F.when(score < limit, _widened(values, agreement)).otherwise(probs)
    for met, values in reversed(special_cases(current, deficit, spatial, trend, tail, cdi)):
        probs = F.when(met, _widened(values, agreement)).otherwise(probs)
    return probs


def special_cases(current: Column, deficit: Column, spatial: Column, trend: Column, tail: Column, cdi: Column) -> list[tuple[Column, tuple]]:
    """Conditions that stand before the score, with their vectors; the first that is met counts.

    Conditions and vectors are fixed values.
    """
    alert_level, mild_level = cdi == 6, cdi == 2
    no_drought, dry_at_most, dry_now, very_dry_now = current == 1, current <= 2, current >= 4, current == 5
    deficit_low, deficit_medium, deficit_high, deficit_top = deficit <= 2, deficit <= 3, deficit >= 4, deficit >= 5
    improving, worsening = trend == 1, trend == 3
    tail_mild, tail_strong, tail_second, tail_worst = tail <= 2, tail >= 3, tail == 3, tail == 4
    return [
        (alert_level & deficit_top, (0.0, 0.0, 0.0, 0.20, 0.80)),
        (mild_level & improving & no_drought, (0.85, 0.15, 0.0, 0.0, 0.0)),
        (very_dry_now & deficit_high & worsening & (spatial >= 2), (0.0, 0.0, 0.05, 0.20, 0.75)),
        (very_dry_now & deficit_high & worsening, (0.0, 0.0, 0.10, 0.40, 0.50)),
        (dry_now & deficit_high & worsening, (0.0, 0.0, 0.10, 0.50, 0.40)),
        (tail_worst & dry_now & deficit_medium, (0.0, 0.10, 0.30, 0.45, 0.15)),
        (tail_second & dry_now & deficit_medium, (0.05, 0.20, 0.45, 0.25, 0.05)),
        (tail_worst & deficit_low, (0.05, 0.20, 0.40, 0.30, 0.05)),
        (tail_strong & worsening & deficit_medium, (0.05, 0.15, 0.45, 0.30, 0.05)),
        (no_drought & deficit_medium & tail_mild, (0.55, 0.35, 0.10, 0.0, 0.0)),
        (improving & dry_at_most & deficit_low & tail_mild, (0.65, 0.30, 0.05, 0.0, 0.0)),
        (dry_at_most & deficit_high, (0.10, 0.25, 0.45, 0.15, 0.05)),
    ]


def widened(values: Sequence[float]) -> list[list[float]]:
    """A rule's vector mixed with an even one by agreement and normalised; three constant vectors."""
    rows = []
    for mix in EVEN_MIX:
        mixed = [(1.0 - mix) * v + mix * 0.2 for v in values]
        rows.append([m / sum(mixed) for m in mixed])
    return rows


def _widened(values: Sequence[float], agreement: Column) -> Column:
    return F.element_at(F.array(*map(_vector, widened(values))), agreement.cast("int"))


def risk_tensor(shared_signal: float = SHARED_SIGNAL) -> np.ndarray:
    """The risk vectors of all combinations as an array (agreement, current, deficit, spatial, trend, tail, indicator, risk).

    The same rules as :func:`risk_probabilities`, worked out when a plan is built; no Spark job.
    """
    agr, cur, deficit, spa, trn, tail, cdi = np.meshgrid(*(np.arange(1, k + 1) for k in (3, 5, 5, 3, 3, 4, 6)), indexing="ij")
    of = lambda values, index: np.array(values)[index - 1]
    d = deficit - 1
    fresh = 1.0 - shared_signal * d / 4.0
    score = (cur - 1) * CURRENT_WEIGHT + of(FORECAST_TRUST, agr) * (d * DEFICIT_WEIGHT + (of(SPATIAL_ADD, spa) + of(TAIL_ADD, tail)) * fresh)
    score = score + of(TREND_ADD, trn)
    score = score + of(CDI_ADD, cdi)
    rules = special_cases(cur, deficit, spa, trn, tail, cdi) + [(score < limit if limit is not None else score == score, values) for limit, values in SCORE_BANDS]
    chosen = np.argmax(np.stack([met for met, _ in rules]), axis=0)
    return np.array([widened(values) for _, values in rules])[chosen, agr - 1]


def risk_table(spark: SparkSession, shared_signal: float = SHARED_SIGNAL) -> DataFrame:
    """All 16,200 parent combinations with their risk vectors; a table of fixed size."""
    ids = spark.range(5 * 5 * 3 * 3 * 3 * 4 * 6)
    rest = F.col("id")
    columns = []
    for name, k in [("cur", 5), ("def", 5), ("spa", 3), ("trn", 3), ("agr", 3), ("tail", 4), ("cdi", 6)]:
        columns.append((F.floor(rest) % k + 1).cast("int").alias(name))
        rest = F.floor(rest / k)
    t = ids.select(*columns)
    c = F.col
    return t.withColumn(
        "risk", risk_probabilities(c("cur"), c("def"), c("spa"), c("trn"), c("agr"), c("tail"), c("cdi"), shared_signal)
    )


def one_hot(index: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def agreement_blend(probs: Column, agreement: Column) -> Column:
    """Mix toward an even vector at Low and Medium agreement (an optional helper)."""
    keep = _pick(AGREEMENT_BLEND, agreement)
    mixed = F.transform(probs, lambda p: keep * p + (1.0 - keep) * 0.2)
    return F.when(agreement >= 3, probs).otherwise(normalise(mixed))


# ---------------------------------------------------------------- evidence

def with_indices(df: DataFrame) -> DataFrame:
    """Adds ``cur, def, spa, trn, agr, tail, cdi`` state indices of an evidence table."""
    has = lambda name: name in df.columns
    level = (
        C.cdi_index(F.col("cdi_level_idx").cast("double")) if has("cdi_level_idx")
        else C.label_index(F.col("cdi_level"), C.CDI_STATES, 1) if has("cdi_level") else F.lit(1)
    )
    return df.withColumns(
        {
            "cur": C.current_index(F.col("current_spi3")),
            "def": C.deficit_index(F.col("forecast_deficit_prob")),
            "spa": C.spatial_index(F.col("spatial_coverage")),
            "trn": C.label_index(F.col("spi3_trend"), C.TREND_STATES, 2),
            "agr": C.label_index(F.col("forecast_agreement"), C.AGREEMENT_STATES, 2) if has("forecast_agreement") else F.lit(3),
            "tail": C.tail_index(F.col("ens_min_spi")) if has("ens_min_spi") else F.lit(1),
            "cdi": level,
        }
    )


def evidence_vectors(df: DataFrame) -> DataFrame:
    """Adds ``ev_*`` arrays: the soft columns where the table has them, else one-hot."""
    out = {}
    for name, k in PARENTS.items():
        soft = soft_columns(df, name, k)
        hard = one_hot(F.col(name), k)
        out[f"ev_{name}"] = hard if soft is None else F.coalesce(soft, hard)
    return df.withColumns(out)


def infer_hard(df: DataFrame, include_agreement: bool = True, include_tail: bool = False, include_cdi: bool = False) -> DataFrame:
    """Posterior from state indices; parents that are left out take their neutral state."""
    c = F.col
    return df.withColumn(
        "posterior",
        risk_probabilities(
            c("cur"), c("def"), c("spa"), c("trn"), c("agr") if include_agreement else F.lit(3),
            c("tail") if include_tail else F.lit(1), c("cdi") if include_cdi else F.lit(1),
        ),
    )


def infer_soft_long(df: DataFrame, key: Sequence[str], agreement: Column, include_cdi: bool = True) -> DataFrame:
    """Posterior from evidence vectors as a join with the risk table.

    Zero weights are dropped before each next parent, so a row expands only to
    the combinations it believes in; the sums collapse them before the shuffle.
    """
    long = df.select(*key, agreement.cast("int").alias("agr"), F.lit(1.0).alias("w"), *[f"ev_{p}" for p in PARENTS])
    for name in PARENTS:
        if name == "cdi" and not include_cdi:
            long = long.drop("ev_cdi").withColumn("cdi", F.lit(1))
            continue
        carried = [c for c in long.columns if c not in ("w", f"ev_{name}")]
        long = (
            long.select(*carried, "w", F.posexplode(f"ev_{name}").alias("_i", "_p"))
            .where(F.col("_p") > 0)
            .select(*carried, (F.col("w") * F.col("_p")).alias("w"), (F.col("_i") + 1).alias(name))
        )
    table = F.broadcast(risk_table(df.sparkSession))
    joined = long.join(table, [*PARENTS, "agr"])
    sums = joined.groupBy(*key).agg(*[F.sum(F.col("w") * F.col("risk")[i]).alias(f"_r{i}") for i in range(5)])
    parts = [F.coalesce(f"_r{i}", F.lit(0.0)) for i in range(5)]  # rows whose evidence is all zero or missing keep a vector of zeros
    return df.select(*key).distinct().join(sums, list(key), "left").select(*key, normalise(F.array(*parts)).alias("posterior"))


def infer_soft(df: DataFrame, agreement: Column, include_cdi: bool = True) -> DataFrame:
    """The same posterior without expanding rows: a vectorised contraction per batch.

    The risk table has a fixed size and travels with the function. Use it when
    rows carry wide evidence.
    """
    tensor = risk_tensor()
    flat = tensor if include_cdi else tensor[..., :1, :]

    @F.pandas_udf("array<double>")
    def contract(cur: pd.Series, deficit: pd.Series, spa: pd.Series, trn: pd.Series, tail: pd.Series, cdi: pd.Series, agr: pd.Series) -> pd.Series:
        parts = [np.stack(s.to_list()) if len(s) else np.zeros((0, 1)) for s in (cur, deficit, spa, trn, tail, cdi)]
        if not include_cdi:
            parts[-1] = np.ones((len(cur), 1))
        out = np.zeros((len(cur), 5))
        level = agr.to_numpy(int)
        for a in (1, 2, 3):
            at = np.flatnonzero(level == a)
            for chunk in np.array_split(at, max(1, len(at) // 512)):
                if len(chunk):
                    work = np.tensordot(parts[0][chunk], flat[a - 1], axes=(1, 0))
                    for p in parts[1:]:
                        work = np.einsum("bi,bi...->b...", p[chunk], work)
                    out[chunk] = work
        total = out.sum(axis=1, keepdims=True)
        return pd.Series(list(np.where(total > 0, out / np.where(total > 0, total, 1), out)))

    return df.withColumn("posterior", contract(*[F.col(f"ev_{p}") for p in PARENTS], agreement.cast("int")))


def decide(df: DataFrame, ratio: float = 0.2, posterior: str = "posterior") -> DataFrame:
    """Adds risk level, confidence, attention state, colour and explanation."""
    p = F.col(posterior)
    return df.withColumn("_a", attention(p, ratio)).withColumns(
        {
            "risk_level": top_state(p),
            "confidence": confidence(p),
            "attention_state": F.col("_a.state"),
            "traffic_light": F.col("_a.colour"),
            "explanation": F.col("_a.explanation"),
        }
    ).drop("_a")


def probability_columns(posterior: str = "posterior", prefix: str = "risk_") -> list[Column]:
    return [F.col(posterior)[i].alias(prefix + s.lower()) for i, s in enumerate(C.RISK_STATES)]


# ---------------------------------------------------------------- crop branch

def crop_stress(water: Column, leaf: Column, phase: Column) -> Column:
    """Vector over the four crop states for one combination of parent states."""
    w = (water - 1).cast("double")
    f = (leaf - 2).cast("double")
    both = F.lit(WATER_WEIGHT) * w + F.lit(LEAF_WEIGHT) * f + F.lit(BOTH_BONUS) * F.least(w, f)
    both = F.when((f == 0) & (w > 0), both * HEALTHY_FACTOR).otherwise(both)
    score = F.when(leaf == 1, w).otherwise(both) * _pick(PHASE_FACTOR, phase)
    return _between(F.least(F.greatest(score, F.lit(0.0)), F.lit(3.0)) + 1.0, 4)


def _between(target: Column, states: int) -> Column:
    """Mass split linearly over the two whole states around the target."""
    low = F.floor(target)
    part = target - low
    high = F.least(low + 1, F.lit(states))
    return F.transform(
        F.sequence(F.lit(1), F.lit(states)),
        lambda i: F.when(i == low, 1.0 - part).otherwise(0.0) + F.when(i == high, part).otherwise(0.0),
    )


def crop_table(spark: SparkSession) -> DataFrame:
    """All 60 combinations of water, vegetation and phase."""
    i = F.col("id")
    t = spark.range(60).select(
        (i % 4 + 1).cast("int").alias("w10"), (F.floor(i / 4) % 5 + 1).cast("int").alias("fpar"), (F.floor(i / 20) + 1).cast("int").alias("phase")
    )
    return t.withColumn("crop", crop_stress(F.col("w10"), F.col("fpar"), F.col("phase")))


def infer_crop(water: Column, leaf: Column, phase: Column) -> Column:
    """Crop posterior from the three evidence vectors; the 60 terms stay in one row."""
    terms = lambda a, b, c: F.flatten(F.flatten(F.transform(a, lambda w: F.transform(b, lambda f: F.transform(c, lambda p: w * f * p)))))
    weights = bound(F.struct(water.alias("w"), leaf.alias("f"), phase.alias("p")), lambda e: terms(e["w"], e["f"], e["p"]))
    combos = [(w, f, p) for w in range(1, 5) for f in range(1, 6) for p in range(1, 4)]
    shares = [_vector([_crop_constant(*c)[k] for c in combos]) for k in range(4)]
    return normalise(bound(weights, lambda w: F.array(*[_dot(w, s) for s in shares])))


def _dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def _crop_constant(w10: int, fpar: int, phase: int) -> list[float]:
    """The same rule as ``crop_stress`` for literal states, folded when the plan is built."""
    w, f = float(w10 - 1), float(fpar - 2)
    if fpar == 1:
        score = w
    else:
        score = WATER_WEIGHT * w + LEAF_WEIGHT * f + BOTH_BONUS * min(w, f)
        score *= HEALTHY_FACTOR if f == 0 and w > 0 else 1.0
    return _split(1.0 + min(max(score * PHASE_FACTOR[phase - 1], 0.0), 3.0), 4)


def _split(target: float, states: int) -> list[float]:
    low = int(target)
    out = [0.0] * states
    out[low - 1] += 1.0 - (target - low)
    out[min(low + 1, states) - 1] += target - low
    return out


def crop_shift(met: Column, crop: Column) -> Column:
    """Risk vector for one met state and one crop state, the shift discounted as risk rises."""
    fresh = 1.0 - CROP_SHARED_SIGNAL * (met - 1) / 4.0
    return _between(F.least(met + _pick(CROP_SHIFT, crop) * fresh, F.lit(5.0)), 5)


def agricultural_risk(met: Column, crop: Column) -> Column:
    """Sum over the 20 combinations of met state and crop state."""
    weights = bound(crop, lambda q: F.flatten(F.transform(met, lambda m: F.transform(q, lambda c: m * c))))
    targets = [
        min(m + CROP_SHIFT[c - 1] * (1.0 - CROP_SHARED_SIGNAL * (m - 1) / 4.0), 5.0)
        for m in range(1, 6)
        for c in range(1, 5)
    ]
    shares = [_vector([_split(t, 5)[k] for t in targets]) for k in range(5)]
    return normalise(bound(weights, lambda w: F.array(*[_dot(w, s) for s in shares])))


def assess(
    df: DataFrame,
    include_agreement: bool = True,
    include_tail: bool = False,
    include_cdi: bool = False,
    include_crop: bool = False,
    include_fpar: bool = False,
    ratio: float = 0.2,
    soft: bool = True,
) -> DataFrame:
    """Whole evidence table to decisions, with the switches of the batch job.

    A switch whose columns are missing is turned off. Soft vectors count with
    the indicator on, or with agreement left out; otherwise states are read.
    """
    include_tail = include_tail and "ens_min_spi" in df.columns
    has_soft_cdi = soft_columns(df, "cdi", 6) is not None
    include_cdi = include_cdi and ("cdi_level_idx" in df.columns or "cdi_level" in df.columns or has_soft_cdi)
    water = [n for n in ("wrsi10_value", "wrsi10_class") if n in df.columns]
    include_crop = include_crop and (bool(water) or soft_columns(df, "w10", 4) is not None)
    rows = with_indices(df)
    if include_cdi:
        rows = infer_soft(evidence_vectors(rows), F.col("agr"))
    elif soft and not include_agreement:
        vectors = evidence_vectors(rows)
        if not include_tail:
            vectors = vectors.withColumn("ev_tail", one_hot(F.lit(1), 4))
        rows = infer_soft(vectors, F.lit(3), include_cdi=False)
    else:
        rows = infer_hard(rows, include_agreement, include_tail)
    out = decide(rows, ratio)
    if not include_crop:
        return out
    w = (
        C.wrsi_index(F.col("wrsi10_value")) if "wrsi10_value" in df.columns
        else C.label_index(F.col("wrsi10_class"), C.WRSI_STATES, 1) if "wrsi10_class" in df.columns else F.lit(1)
    )
    leaf = (
        C.fpar_index(F.col("fpar_value")) if "fpar_value" in df.columns
        else C.label_index(F.col("fpar_class"), C.FPAR_STATES, 1) if "fpar_class" in df.columns else F.lit(1)
    )
    leaf = leaf if include_fpar else F.lit(1)
    ev = lambda soft, hard: hard if soft is None else F.coalesce(soft, hard)
    crop = infer_crop(
        ev(soft_columns(df, "w10", 4), one_hot(w, 4)),
        ev(soft_columns(df, "fpar", 5) if include_fpar else None, one_hot(leaf, 5)),
        ev(soft_columns(df, "phase", 3), one_hot(F.lit(1), 3)),
    )
    met = {c: F.col(c) for c in ("confidence", "attention_state", "traffic_light")}
    out = out.withColumns({f"{c}_met": v for c, v in met.items()}).withColumnRenamed("risk_level", "risk_level_met")
    out = out.withColumn("crop", crop).withColumn("agri", agricultural_risk(F.col("posterior"), F.col("crop")))
    out = decide(out.drop("confidence", "attention_state", "traffic_light", "explanation"), ratio, "agri")
    return out.withColumnRenamed("risk_level", "agri_risk_level").withColumnRenamed("risk_level_met", "risk_level").withColumns(
        {
            "crop_stress": C.state_label(F.array_position("crop", F.array_max("crop")), C.WRSI_STATES),
            "explanation": F.concat(F.lit("agri: "), F.col("explanation")),
        }
    )


# ---------------------------------------------------------------- sequences and members

def monthly_sequence(
    df: DataFrame, key: str, month: str, likelihood: str, decay: float = 0.6, lookback: int = 6, reset: bool = False
) -> DataFrame:
    """Posterior per key and month with the previous posterior as prior.

    The chain length keeps growing, which turns the prior off for good after
    ``lookback`` months; ``reset=True`` starts a new chain instead. A missing
    likelihood ends a chain either way. So a month depends on at most
    ``lookback`` others: months are numbered within their key, cut into chains,
    and a month folds over its own chain only. No list of a key's months is
    made.
    """
    calendar = W.partitionBy(key).orderBy(month, likelihood)
    broken = F.sum(F.col(likelihood).isNull().cast("int")).over(calendar.rowsBetween(W.unboundedPreceding, -1))
    rows = df.select(key, F.col(month), F.col(likelihood)).withColumn("_run", F.coalesce(broken, F.lit(0)))
    place = (F.row_number().over(W.partitionBy(key, "_run").orderBy(month, likelihood)) - 1).alias("_at")
    length = max(1, lookback)
    at = F.col("_at")
    chain = F.floor(at / length) if reset else F.when(at < length, F.lit(0).cast("bigint")).otherwise(at)
    rows = rows.select("*", place).withColumn("_chain", chain)
    far = W.partitionBy(key, "_run", "_chain").orderBy(month, likelihood).rowsBetween(1 - length, 0)
    linked = rows.withColumn("_seq", F.collect_list(F.struct(F.col(likelihood).alias("lik"))).over(far))

    def step(prior, x):
        blended = normalise(F.transform(prior, lambda p: decay * p + (1.0 - decay) * 0.2))
        return F.when(prior.isNull(), x["lik"]).otherwise(normalise(F.zip_with(x["lik"], blended, lambda a, b: a * b)))

    folded = F.aggregate("_seq", F.lit(None).cast("array<double>"), step)
    return linked.select(key, F.col(month).cast("string").alias(month), folded.alias("posterior"), (F.size("_seq") > 1).alias("temporal_prior"))


def member_posteriors(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Posterior of every member row, all members at High agreement and without indicator."""
    renamed = df.withColumnsRenamed(
        {"member_def_frac": "forecast_deficit_prob", "member_spa_cov": "spatial_coverage", "member_min_spi": "ens_min_spi"}
    )
    rows = evidence_vectors(with_indices(renamed))
    return decide(infer_soft(rows, F.lit(3), include_cdi=False)).withColumn(
        "p_high_extreme", F.col("posterior")[3] + F.col("posterior")[4]
    )


def storylines(df: DataFrame, keys: Sequence[str], member: str, value: str = "p_high_extreme") -> DataFrame:
    """Worst, median and best member per key with the share of members at or over it.

    An ensemble has a few dozen members, so the window of a key is short. Equal
    values keep the member order; the median is place ``n div 2 + 1``.
    """
    order = W.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(member))
    peers = W.partitionBy(*keys).orderBy(F.col(value).desc()).rangeBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    ranked = df.withColumns(
        {"_i": F.row_number().over(order), "n_members": F.count("*").over(whole), "_ge": F.count("*").over(peers)}
    )
    place = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("_i") == 1, "worst"),
                F.when(F.col("_i") == F.floor(F.col("n_members") / 2) + 1, "median"),
                F.when(F.col("_i") == F.col("n_members"), "best"),
            )
        )
    )
    return ranked.withColumn("storyline", place).withColumn(
        "probability", F.bround(F.col("_ge") / F.col("n_members"), 3)
    ).drop("_i", "_ge")


def state_counts(df: DataFrame, column: str) -> DataFrame:
    """Number of rows per state."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
