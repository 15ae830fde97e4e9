"""Dosing and exposure: dose plans, superposed concentrations, metrics, targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotally.reference_tables import DOSE_COLUMNS, DOSE_NOTES, DOSE_RATES, PK_COLUMNS, PK_PROFILES, fixed_table
from biotally.session import cut_lineage


def dose_table(spark: SparkSession) -> DataFrame:
    """The rates with their notes; no rate has contraindications, the column is there for tables that do."""
    rates = fixed_table(spark, ("rate_id", *DOSE_COLUMNS, "notes"), [(i, *r, n) for i, (r, n) in enumerate(zip(DOSE_RATES, DOSE_NOTES, strict=True))])
    return rates.withColumn("contraindications", F.lit(None).cast("string"))


def profile_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, PK_COLUMNS, PK_PROFILES)


def dose_rates(rates: DataFrame, drug: str, species: str) -> DataFrame:
    return rates.filter((F.col("drug") == drug) & (F.col("species") == species))


def dose_join(patients: DataFrame, rates: DataFrame, on: list[str]) -> DataFrame:
    return patients.join(F.broadcast(rates), on)


def dose_plan(rows: DataFrame) -> DataFrame:
    """Amounts, volume, cost and warning of a treatment, and what its rate notes; an interval of 0 means one administration per day."""
    c = F.col
    factor = F.when(c("age_group") == "neonate", 0.7).when(c("age_group") == "young", 0.85).otherwise(1.0)
    per_day = F.when(c("interval_hours") > 0, F.lit(24.0) / F.nullif(c("interval_hours"), F.lit(0))).otherwise(1.0)
    rows = rows.withColumn("dose_mg", F.round(c("dose_mg_kg") * factor * c("weight"), 9)).withColumn("per_day", per_day)
    times = c("per_day") * c("duration_days")
    volume = F.when(c("concentration") > 0, c("dose_mg") / c("concentration")).otherwise(0.0)
    heavy_im = (c("weight") > 500) & (c("route") == "IM")
    cost = F.when((c("price") > 0) & (volume > 0), volume * times * c("price"))
    warning = F.when(heavy_im, "IM in large animal").when(c("dose_mg") > 5000, "split dose")
    return rows.select(
        "patient_id", "drug", "species", "route", "dose_mg", (c("dose_mg") * c("per_day")).alias("daily_mg"), (c("dose_mg") * times).alias("course_mg"),
        F.ceil(times).cast("int").alias("administrations"), volume.alias("volume_ml"), cost.alias("cost"), warning.alias("warning"),
        *[(c(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in ("notes", "contraindications")],
    )


def steady_state(dose: Column, interval: Column) -> dict[str, Column]:
    """Closed forms over a profile row: half-life, clearance, and average, peak and trough at steady state."""
    c = F.col
    ke, ka, f_over_v = c("ke"), c("ka"), c("bioavailability") * dose / c("volume")
    clearance = ke * c("volume")
    gain = 1 / (1 - F.exp(-ke * interval))
    gap = F.nullif(ka - ke, F.lit(0.0))
    t_peak = F.when(ka == ke, 1 / F.nullif(ka, F.lit(0.0))).when(ka > 0, F.ln(F.nullif(ka, F.lit(0.0)) / ke) / gap)
    oral = f_over_v * (ka / gap) * gain
    # Equal rates: the limit of the difference of exponentials, summed over all earlier doses.
    equal = lambda t: f_over_v * ka * F.exp(-ke * t) * (t * gain + interval * F.exp(-ke * interval) * gain * gain)
    taken = lambda t: F.when(ka == ke, equal(t)).otherwise(oral * (F.exp(-ke * t) - F.exp(-ka * t)))
    peak = F.when(c("route") == "IV", f_over_v * gain).otherwise(taken(t_peak))
    trough = F.when(c("route") == "IV", f_over_v * gain * F.exp(-ke * interval)).otherwise(taken(interval))
    return {
        "half_life": math.log(2) / ke, "clearance": clearance, "css_avg": c("bioavailability") * dose / (clearance * interval),
        "css_max": peak, "css_min": F.greatest(F.lit(0.0), trough),
    }


def emax_curve(rows: DataFrame, key: str, top: str, emax: float = 100.0, ec50: str = "mic", hill: float = 1.5) -> DataFrame:
    """51 points from 0 to 1.5 times the peak (at least 10)."""
    c = F.greatest(F.lit(10.0), F.col(top) * 1.5)
    pts = rows.select(key, F.col(ec50).alias("ec50"), c.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("point"))
    conc = F.col("top") * F.col("point") / 50
    h = F.pow(conc, F.lit(hill))
    return pts.select(key, "point", conc.alias("conc"), (h * emax / (F.pow("ec50", F.lit(hill)) + h)).alias("effect"))


def decayed_sums(doses: DataFrame, samples: DataFrame, rate: float, key: str = "subject") -> DataFrame:
    """For each sample: sum over earlier doses of dose * exp(-rate * (t - dose time)), exact in double arithmetic.

    Time is cut into spans of 300 / rate. Inside a span the sum is a running total of dose * exp(rate * offset), whose
    exponent stays below 300. Doses of the three spans before count through their span totals; anything older has
    decayed below the smallest double. A subject is spread over its spans, and no dose meets a sample pairwise.
    """
    span = 300.0 / rate
    # Samples sort after doses of the same time: a dose given at t counts at t.
    events = doses.select(key, "t", F.col("dose"), F.lit(None).cast("bigint").alias("sample_id"), F.lit(0).alias("is_sample")).unionByName(
        samples.select(key, "t", F.lit(0.0).alias("dose"), F.col("sample_id"), F.lit(1).alias("is_sample"))
    )
    e = events.withColumn("span", F.floor(F.col("t") / span)).withColumn("offset", F.col("t") - F.col("span") * span)
    run = Window.partitionBy(key, "span").orderBy("t", "is_sample").rowsBetween(Window.unboundedPreceding, 0)
    inside = e.withColumn("run", F.sum(F.col("dose") * F.exp(F.col("offset") * rate)).over(run)).filter("is_sample = 1")
    totals = e.filter("is_sample = 0").groupBy(key, "span").agg(F.sum(F.col("dose") * F.exp((F.col("offset") - span) * rate)).alias("total"))
    # Each span total serves the three spans after it, decayed to the start of the span it serves.
    carried = (
        totals.select(key, "total", "span", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("ahead"))
        .groupBy(key, (F.col("span") + F.col("ahead")).alias("span"))
        .agg(F.sum(F.col("total") * F.exp((F.col("ahead") - 1) * (-300.0))).alias("carry"))
    )
    joined = inside.join(carried, [key, "span"], "left")
    decay = F.exp(F.col("offset") * -rate)
    return joined.select(key, "sample_id", "t", (decay * (F.col("run") + F.coalesce("carry", F.lit(0.0)))).alias("amount"))


def dose_superposition(doses: DataFrame, samples: DataFrame, profile: dict, key: str = "subject") -> DataFrame:
    """Concentration at each sample from all earlier doses; one compartment, IV bolus or first-order absorption."""
    scale = profile["bioavailability"] / profile["volume"]
    slow = decayed_sums(doses, samples, profile["ke"], key)
    if profile["route"] == "IV":
        return slow.select(key, "sample_id", "t", (F.col("amount") * scale).alias("conc"))
    if profile["ka"] == profile["ke"]:
        # The limit dose * ka * age * exp(-ke * age): the age of a dose is the sample's time less the dose's.
        whole = decayed_sums(doses, samples, profile["ke"], key)
        timed = decayed_sums(doses.withColumn("dose", F.col("dose") * F.col("t")), samples, profile["ke"], key).select(key, "sample_id", F.col("amount").alias("timed"))
        return whole.join(timed, [key, "sample_id"]).select(key, "sample_id", "t", ((F.col("amount") * F.col("t") - F.col("timed")) * (scale * profile["ka"])).alias("conc"))
    fast = decayed_sums(doses, samples, profile["ka"], key).select(key, "sample_id", F.col("amount").alias("fast"))
    k = scale * profile["ka"] / (profile["ka"] - profile["ke"])
    return slow.join(fast, [key, "sample_id"]).select(key, "sample_id", "t", ((F.col("amount") - F.col("fast")) * k).alias("conc"))


def _terms() -> Column:
    """The exponentials of a profile's concentration: rate, its share of the plain sum and of the sum weighted by age."""
    c = F.col
    scale = c("bioavailability") / c("volume")
    gain = scale * c("ka") / F.nullif(c("ka") - c("ke"), F.lit(0.0))
    term = lambda rate, plain, aged: F.struct(rate.cast("double").alias("rate"), plain.cast("double").alias("plain"), aged.cast("double").alias("aged"))
    zero = F.lit(0.0)
    bolus = F.array(term(c("ke"), scale, zero))
    equal = F.array(term(c("ke"), zero, scale * c("ka")))
    return F.when(c("route") == "IV", bolus).when(c("ka") == c("ke"), equal).otherwise(F.array(term(c("ke"), gain, zero), term(c("ka"), -gain, zero)))


def own_superposition(doses: DataFrame, samples: DataFrame, profiles: DataFrame, key: str = "subject") -> DataFrame:
    """Concentration at each sample from all earlier doses, each subject by its own profile, a row a subject of ``profiles``.

    As `decayed_sums`, with rates and so spans that come from the row: a subject's time is cut into spans of 300 / rate,
    one cut for each exponential of its profile. Equal rates need the sum of dose * age * exp(-rate * age) too, which is
    carried over the spans beside the plain one. Subjects without a profile or with rates of zero or less are left out.
    """
    terms = profiles.select(key, F.posexplode(_terms()).alias("term", "x")).select(key, "term", "x.*").filter("rate > 0")
    events = doses.select(key, "t", "dose", F.lit(None).cast("bigint").alias("sample_id"), F.lit(0).alias("is_sample")).unionByName(
        samples.select(key, "t", F.lit(0.0).alias("dose"), F.col("sample_id").cast("bigint").alias("sample_id"), F.lit(1).alias("is_sample"))
    )
    wide = F.lit(300.0) / F.col("rate")
    e = events.join(terms, key).withColumn("span", F.floor(F.col("t") / wide)).withColumn("offset", F.col("t") - F.col("span") * wide)
    run = Window.partitionBy(key, "term", "span").orderBy("t", "is_sample").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.col("dose") * F.exp(F.col("offset") * F.col("rate"))
    inside = e.withColumn("run", F.sum(grown).over(run)).withColumn("run_aged", F.sum(grown * F.col("offset")).over(run)).filter("is_sample = 1")
    left = wide - F.col("offset")
    faded = F.col("dose") * F.exp(-left * F.col("rate"))
    totals = e.filter("is_sample = 0").groupBy(key, "term", "span").agg(F.sum(faded).alias("total"), F.sum(faded * left).alias("total_aged"), F.first("rate").alias("rate"))
    ahead = totals.select(key, "term", "span", "total", "total_aged", wide.alias("wide"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("ahead"))
    decay = F.exp((F.col("ahead") - 1) * (-300.0))
    carried = ahead.groupBy(key, "term", (F.col("span") + F.col("ahead")).alias("span")).agg(
        F.sum(F.col("total") * decay).alias("carry"), F.sum((F.col("total_aged") + (F.col("ahead") - 1) * F.col("wide") * F.col("total")) * decay).alias("carry_aged")
    )
    held = inside.join(carried, [key, "term", "span"], "left").na.fill(0.0, ["carry", "carry_aged"])
    now = F.exp(F.col("offset") * -F.col("rate"))
    plain = now * (F.col("run") + F.col("carry"))
    aged = now * (F.col("offset") * (F.col("run") + F.col("carry")) - F.col("run_aged") + F.col("carry_aged"))
    return held.groupBy(key, "sample_id", "t").agg(F.sum(F.col("plain") * plain + F.col("aged") * aged).alias("conc"))


def trapezoid_steps(series: DataFrame, key: str = "subject", order: str = "sample_id", slices: float = 24.0) -> DataFrame:
    """(y_i + y_{i-1}) / 2 * dx per step. Steps inside a time slice come from a window per (key, slice); one more row
    per slice joins the last reading of the slice before, so a hot key is spread over its slices."""
    s = series.withColumn("slice", F.floor(F.col("t") / slices))
    w = Window.partitionBy(key, "slice").orderBy("t", order)
    dx, y = F.col("t") - F.lag("t").over(w), F.col("conc") + F.lag("conc").over(w)
    inside = s.withColumn("step", dx * y / 2)
    ends = s.groupBy(key, "slice").agg(F.min_by(F.struct("t", "conc"), F.struct("t", order)).alias("first"), F.max_by(F.struct("t", "conc"), F.struct("t", order)).alias("last"))
    across = Window.partitionBy(key).orderBy("slice")
    joints = ends.select(
        key, ((F.col("first.t") - F.lag("last.t").over(across)) * (F.col("first.conc") + F.lag("last.conc").over(across)) / 2).alias("step")
    )
    return inside.select(key, "step").unionByName(joints).filter("step is not null")


def nca_metrics(series: DataFrame, key: str = "subject", order: str = "sample_id") -> DataFrame:
    """Peak, first time of the peak, area under the curve, last concentration."""
    area = trapezoid_steps(series, key, order).groupBy(key).agg(F.sum("step").alias("auc"))
    m = series.groupBy(key).agg(
        F.count("*").alias("readings"), F.max("conc").alias("cmax"), F.min_by("t", F.struct(-F.col("conc"), "t")).alias("tmax"),
        F.max_by("conc", F.struct("t", order)).alias("clast"),
    )
    return m.join(area, key, "left").na.fill(0.0, ["auc"])


def pd_index(series: DataFrame, metrics: DataFrame, mic: float | None, key: str = "subject") -> DataFrame:
    """AUC/MIC, peak/MIC and percent of readings at or above the MIC; ``mic`` is one value or, if None, a column of both."""
    limit = F.col("mic") if mic is None else F.lit(mic)
    above = series.groupBy(key).agg((F.avg((F.col("conc") >= limit).cast("int")) * 100).alias("t_above_mic"))
    return metrics.join(above, key).withColumn("auc_mic", F.col("auc") / limit).withColumn("cmax_mic", F.col("cmax") / limit)


def bin_pd_target(index: Column, kind: Column) -> Column:
    cut = lambda high, low: F.when(index >= high, "excellent").when(index >= low, "moderate").otherwise("insufficient")
    return F.when(kind == "auc_mic", cut(125, 40)).when(kind == "cmax_mic", cut(10, 4)).when(kind == "t_above_mic", cut(80, 40))


def own_exposure_report(doses: DataFrame, samples: DataFrame, profiles: DataFrame, key: str = "subject") -> DataFrame:
    """Exposure metrics, index and response of each subject by its own profile (a row a subject: key and PK columns)."""
    profiles = profiles.select(key, *PK_COLUMNS)
    series = cut_lineage(own_superposition(doses, samples, profiles, key).join(profiles.select(key, "mic"), key))
    metrics = nca_metrics(series, key).join(profiles.select(key, "drug", "species", "mic", "target_type", "target"), key)
    out = pd_index(series, metrics, None, key)
    kind = F.col("target_type")
    index = F.when(kind == "auc_mic", F.col("auc_mic")).when(kind == "cmax_mic", F.col("cmax_mic")).when(kind == "t_above_mic", F.col("t_above_mic"))
    return out.withColumn("pd_index", index).withColumn("attained", index >= F.col("target")).withColumn("response", bin_pd_target(index, kind))


def exposure_report(doses: DataFrame, samples: DataFrame, profile: dict, key: str = "subject") -> DataFrame:
    series = dose_superposition(doses, samples, profile, key)
    out = pd_index(series, nca_metrics(series, key), profile["mic"], key)
    index = F.col(profile["target_type"])
    return out.withColumn("pd_index", index).withColumn("attained", index >= profile["target"]).withColumn("response", bin_pd_target(index, F.lit(profile["target_type"])))
