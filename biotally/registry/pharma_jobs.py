"""Registered jobs: dosing and exposure."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from biotally.operators import exposure as x
from biotally.reference_tables import DOSE_COLUMNS, DOSE_NOTES, DOSE_RATES, PK_COLUMNS, PK_PROFILES, sql_values
from biotally.registry.core import job
from biotally.sources import tables as t

_RATES = "rates as (select * from " + sql_values("r", ("rate_id", *DOSE_COLUMNS, "notes"), [(i, *r, n) for i, (r, n) in enumerate(zip(DOSE_RATES, DOSE_NOTES, strict=True))]) + ")"
_PLAN = f"""{_RATES}, p1 as (select *, round(dose_mg_kg * case age_group when 'neonate' then 0.7::double when 'young' then 0.85::double else 1.0::double end * weight, 9) as dose_mg,
  case when interval_hours > 0 then 24.0::double / interval_hours else 1.0::double end as per_day from patients join rates using (rate_id)),
p2 as (select *, per_day * duration_days as times, case when concentration > 0 then dose_mg / concentration else 0.0::double end as volume_ml from p1),
plan as (select patient_id, drug, species, route, dose_mg, dose_mg * per_day as daily_mg, dose_mg * times as course_mg, cast(ceil(times) as int) as administrations, volume_ml,
  case when price > 0 and volume_ml > 0 then volume_ml * times * price end as cost,
  case when weight > 500 and route = 'IM' then 'IM in large animal' when dose_mg > 5000 then 'split dose' end as warning, notes, cast(null as varchar) as contraindications from p2)"""


@job("dose_report", f"with {_PLAN} select * from plan", "patients")
def dose_report(spark, sf):
    return x.dose_plan(x.dose_join(t.patients(spark, sf), x.dose_table(spark), ["rate_id"]))


@job("dose_join", f"with {_PLAN} select species, drug, count(*) as animals, sum(course_mg) as course_mg from plan group by 1, 2", "patients")
def dose_join(spark, sf):
    plan = x.dose_plan(x.dose_join(t.patients(spark, sf), x.dose_table(spark), ["rate_id"]))
    return plan.groupBy("species", "drug").agg(F.count("*").alias("animals"), F.sum("course_mg").alias("course_mg"))


@job("dose_rates", f"with {_RATES} select patient_id, dose_mg_kg, route, interval_hours from patients join rates using (rate_id) where drug = 'enrofloxacin' and species = 'КРС'", "patients")
def dose_rates(spark, sf):
    rates = x.dose_rates(x.dose_table(spark), "enrofloxacin", "КРС")
    return x.dose_join(t.patients(spark, sf), rates, ["rate_id"]).select("patient_id", "dose_mg_kg", "route", "interval_hours")


@job("distinct_list", f"with {_RATES} select distinct species, drug from patients join rates using (rate_id)", "patients")
def distinct_list(spark, sf):
    return x.dose_join(t.patients(spark, sf), x.dose_table(spark), ["rate_id"]).select("species", "drug").distinct()


_PK = "pk as (select *, row_number() over () - 1 as profile_id from " + sql_values("q", PK_COLUMNS, PK_PROFILES) + ")"
_GRP = f"g as (select cast(patient_id % {len(PK_PROFILES)} as int) as profile_id, weight from patients)"
_PKJ = "pk as (select * from " + sql_values("q", ("profile_id", *PK_COLUMNS), [(i, *r) for i, r in enumerate(PK_PROFILES)]) + ")"


def _profiles(spark):
    from biotally.reference_tables import fixed_table

    return fixed_table(spark, ("profile_id", *PK_COLUMNS), [(i, *r) for i, r in enumerate(PK_PROFILES)])


def _treated(spark, sf):
    return t.patients(spark, sf).select("patient_id", "weight", (F.col("patient_id") % len(PK_PROFILES)).cast("int").alias("profile_id")).join(F.broadcast(_profiles(spark)), "profile_id")


@job(
    "pk_profile_join",
    f"with {_PKJ} select patient_id, drug, species, mic, target_type, weight * 5 as dose, 24 as interval_hours from patients join pk on pk.profile_id = patient_id % {len(PK_PROFILES)}",
    "patients",
)
def pk_profile_join(spark, sf):
    return _treated(spark, sf).select("patient_id", "drug", "species", "mic", "target_type", (F.col("weight") * 5).alias("dose"), F.lit(24).alias("interval_hours"))


_SS = f"""{_PKJ}, s0 as (select patient_id, pk.*, weight / 10 as dose, 24.0::double as tau, bioavailability * weight / 10 / volume as fv from patients join pk on pk.profile_id = patient_id % {len(PK_PROFILES)}),
s1 as (select *, 1 / (1 - exp(-ke * tau)) as gain, case when route = 'oral' then ln(ka / ke) / (ka - ke) end as tp from s0),
ss as (select patient_id, {math.log(2)!r}::double / ke as half_life, ke * volume as clearance, bioavailability * dose / (ke * volume * tau) as css_avg,
  case when route = 'IV' then fv * gain else fv * ka / (ka - ke) * gain * (exp(-ke * tp) - exp(-ka * tp)) end as css_max,
  greatest(0.0::double, case when route = 'IV' then fv * gain * exp(-ke * tau) else fv * ka / (ka - ke) * gain * (exp(-ke * tau) - exp(-ka * tau)) end) as css_min, mic from s1)"""


def _steady(spark, sf):
    cols = x.steady_state(F.col("weight") / 10, F.lit(24.0))
    return _treated(spark, sf).select("patient_id", *[c.alias(n) for n, c in cols.items()], "mic")


@job("steady_state", f"with {_SS} select patient_id, half_life, clearance, css_avg, css_max, css_min from ss", "patients")
def steady_state(spark, sf):
    return _steady(spark, sf).drop("mic")


@job(
    "emax_curve",
    f"""with {_SS}, c as (select patient_id, mic, greatest(10.0::double, css_max * 1.5::double) as top, unnest(range(0, 51)) as i from ss), e as (select *, cast(i as int) as point, top * i / 50 as conc from c),
    f as (select patient_id, point, conc, pow(conc, 1.5) * 100.0::double / (pow(mic, 1.5) + pow(conc, 1.5)) as effect from e)
    select patient_id, count(*) as points, max(conc) as top, avg(effect) as mean_effect, min(effect) as first_effect, min(case when round(effect, 9) >= 50 then point end) as half_point from f group by 1""",
    "patients",
)
def emax_curve(spark, sf):
    c = x.emax_curve(_steady(spark, sf), "patient_id", "css_max")
    return c.groupBy("patient_id").agg(
        F.count("*").alias("points"), F.max("conc").alias("top"), F.avg("effect").alias("mean_effect"), F.min("effect").alias("first_effect"),
        F.min(F.when(F.round("effect", 9) >= 50, F.col("point"))).alias("half_point"),
    )


ORAL = dict(zip(PK_COLUMNS, PK_PROFILES[0]))
IV = dict(zip(PK_COLUMNS, PK_PROFILES[2]))


def _series_sql(p: dict, name: str) -> str:
    f, v, ka, ke = (p[k] for k in ("bioavailability", "volume", "ka", "ke"))
    if p["route"] == "IV":
        kern = f"d.dose * exp(-{ke}::double * (s.t - d.t))"
        scale = f / v
    else:
        kern = f"d.dose * (exp(-{ke}::double * (s.t - d.t)) - exp(-{ka}::double * (s.t - d.t)))"
        scale = f / v * ka / (ka - ke)
    return f"{name} as materialized (select s.subject, s.event_id as sample_id, s.t, coalesce(sum({kern}), 0) * {scale!r}::double as conc from samples s left join doses d on d.subject = s.subject and d.t <= s.t group by 1, 2, 3)"


def _logs(spark, sf):
    return t.doses(spark, sf).select("subject", "t", "dose"), t.samples(spark, sf).select("subject", "t", F.col("event_id").alias("sample_id"))


@job("dose_superposition_iv", f"with {_series_sql(IV, 'se')} select * from se", "doses samples")
def dose_superposition_iv(spark, sf):
    return x.dose_superposition(*_logs(spark, sf), IV)


@job("dose_superposition_oral", f"with {_series_sql(ORAL, 'se')} select * from se", "doses samples")
def dose_superposition_oral(spark, sf):
    return x.dose_superposition(*_logs(spark, sf), ORAL)


def _nca(series: str) -> str:
    return f"""nca as (select m.*, coalesce(a.auc, 0.0::double) as auc from (select subject, count(*) as readings, max(conc) as cmax, first(t order by conc desc, t) as tmax, last(conc order by t, sample_id) as clast from {series} group by 1) m
  left join (select subject, sum(step) as auc from (select subject, (t - lag(t) over w) * (conc + lag(conc) over w) / 2 as step from {series} window w as (partition by subject order by t, sample_id)) group by 1) a using (subject))"""


_OBS = "ob as (select subject, event_id as sample_id, t, conc from samples)"


@job("nca_metrics", f"with {_OBS}, {_nca('ob')} select subject, readings, cmax, tmax, clast, auc from nca", "samples")
def nca_metrics(spark, sf):
    """Metrics of the measured concentrations."""
    return x.nca_metrics(t.samples(spark, sf).select("subject", F.col("event_id").alias("sample_id"), "t", "conc"))


@job("trapezoid", f"with {_OBS} select subject, count(step) as steps, sum(step) as auc from (select subject, (t - lag(t) over w) * (conc + lag(conc) over w) / 2 as step from ob window w as (partition by subject order by t, sample_id)) where step is not null group by 1", "samples")
def trapezoid(spark, sf):
    s = t.samples(spark, sf).select("subject", F.col("event_id").alias("sample_id"), "t", "conc")
    return x.trapezoid_steps(s).groupBy("subject").agg(F.count("*").alias("steps"), F.sum("step").alias("auc"))


def _bin(i, kind):
    cut = lambda hi, lo: f"case when {i} >= {hi} then 'excellent' when {i} >= {lo} then 'moderate' else 'insufficient' end"
    return {"auc_mic": cut(125, 40), "cmax_mic": cut(10, 4), "t_above_mic": cut(80, 40)}[kind]


_PD = f"pd as (select nca.*, auc / 5.0::double as auc_mic, cmax / 5.0::double as cmax_mic, tm as t_above_mic from nca join (select subject, avg((conc >= 5)::int) * 100 as tm from ob group by 1) using (subject))"


@job("pd_index", f"with {_OBS}, {_nca('ob')}, {_PD} select subject, auc_mic, cmax_mic, t_above_mic, {_bin('auc_mic', 'auc_mic')} as auc_response, {_bin('cmax_mic', 'cmax_mic')} as cmax_response, {_bin('t_above_mic', 't_above_mic')} as time_response from pd", "samples")
def pd_index(spark, sf):
    s = t.samples(spark, sf).select("subject", F.col("event_id").alias("sample_id"), "t", "conc")
    p = x.pd_index(s, x.nca_metrics(s), 5.0)
    r = lambda n: x.bin_pd_target(F.col(n), F.lit(n))
    return p.select("subject", "auc_mic", "cmax_mic", "t_above_mic", r("auc_mic").alias("auc_response"), r("cmax_mic").alias("cmax_response"), r("t_above_mic").alias("time_response"))


# Subjects take the profiles in turn, and a last one whose absorption is as fast as its elimination.
_OWN = [(i, *r) for i, r in enumerate(PK_PROFILES)] + [(len(PK_PROFILES), *PK_PROFILES[3][:4], PK_PROFILES[3][5], *PK_PROFILES[3][5:])]
_OWN_PK = "pk as (select * from " + sql_values("q", ("profile_id", *PK_COLUMNS), _OWN) + ")"
_OWN_SERIES = f"""{_OWN_PK}, of as (select distinct subject, pk.* from samples join pk on pk.profile_id = subject % {len(_OWN)}),
se as materialized (select s.subject, s.event_id as sample_id, s.t, any_value(mic) as mic, coalesce(sum(d.dose * bioavailability / volume * case when route = 'IV' then exp(-ke * (s.t - d.t))
    when ka = ke then ka * (s.t - d.t) * exp(-ke * (s.t - d.t)) else ka / (ka - ke) * (exp(-ke * (s.t - d.t)) - exp(-ka * (s.t - d.t))) end), 0) as conc
  from samples s join of on s.subject = of.subject left join doses d on d.subject = s.subject and d.t <= s.t group by 1, 2, 3)"""


def _own_profiles(samples):
    """The profile of every subject that has samples."""
    subjects = samples.select("subject").distinct().withColumn("profile_id", (F.col("subject") % len(_OWN)).cast("int"))
    return subjects.join(F.broadcast(_fixed_profiles(samples.sparkSession)), "profile_id")  # seven rows


def _fixed_profiles(spark):
    from biotally.reference_tables import fixed_table

    return fixed_table(spark, ("profile_id", *PK_COLUMNS), _OWN)


@job("own_superposition", f"with {_OWN_SERIES} select subject, sample_id, t, conc from se", "doses samples")
def own_superposition(spark, sf):
    doses, samples = _logs(spark, sf)
    return x.own_superposition(doses, samples, _own_profiles(samples))


@job(
    "exposure_report",
    f"""with {_OWN_SERIES}, {_nca('se')}, ab as (select subject, avg((conc >= mic)::int) * 100 as t_above_mic from se group by 1),
    pd as (select nca.*, drug, species, of.mic, target_type, target, t_above_mic, auc / of.mic as auc_mic, cmax / of.mic as cmax_mic from nca join of using (subject) join ab using (subject)),
    ix as (select *, case target_type when 'auc_mic' then auc_mic when 'cmax_mic' then cmax_mic else t_above_mic end as pd_index from pd)
    select *, pd_index >= target as attained, case target_type when 'auc_mic' then {_bin('pd_index', 'auc_mic')} when 'cmax_mic' then {_bin('pd_index', 'cmax_mic')} else {_bin('pd_index', 't_above_mic')} end as response from ix""",
    "doses samples",
)
def exposure_report(spark, sf):
    """Every subject by its own profile."""
    doses, samples = _logs(spark, sf)
    return x.own_exposure_report(doses, samples, _own_profiles(samples))


@job(
    "exposure_report_one_drug",
    f"""with {_series_sql(IV, 'se')}, {_nca('se')} select subject, readings, cmax, tmax, clast, auc, tm as t_above_mic, auc / 2.0::double as auc_mic, cmax / 2.0::double as cmax_mic, cmax / 2.0::double as pd_index, cmax / 2.0::double >= 10 as attained,
    {_bin('cmax / 2.0::double', 'cmax_mic')} as response from nca join (select subject, avg((conc >= 2)::int) * 100 as tm from se group by 1) using (subject)""",
    "doses samples",
)
def exposure_report_one_drug(spark, sf):
    return x.exposure_report(*_logs(spark, sf), IV)
