"""Registered jobs: plates and ROC."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import plates
from biotally.registry.core import job
from biotally.sources import tables as t

_STATS = """stats as (select plate, mean_neg, sd_neg, case when mean_neg > 0 then sd_neg / mean_neg * 100 else 0.0::double end as cv_percent,
  mean_neg + sd_neg * 2 as cutoff_2sd, mean_neg + sd_neg * 3 as cutoff_3sd, mean_neg + sd_neg * 2 as cutoff
  from (select plate, avg(od) as mean_neg, coalesce(stddev_samp(od), 0) as sd_neg from od_readings where control = 'neg' group by 1))"""
_CLS = """cls as (select plate, count_if(od >= cutoff) as positive, count_if(od < cutoff) as negative,
  count_if(control = 'pos' and od >= cutoff) * 100.0::double / nullif(count_if(control = 'pos'), 0) as sensitivity,
  count_if(control = 'neg' and od < cutoff) * 100.0::double / nullif(count_if(control = 'neg'), 0) as specificity
  from od_readings join stats using (plate) where control in ('neg', 'pos') group by 1)"""


def _roc(view: str, key: str, value: str, label: str) -> str:
    return f"""c as (select {key}, {value} as cutoff, count_if({label} = 'pos') as p, count_if({label} = 'neg') as n from {view} where {label} in ('pos', 'neg') group by 1, 2),
roc as materialized (select {key}, cutoff, sum(p) over w / nullif(sum(p) over (partition by {key}), 0) as tpr, sum(n) over w / nullif(sum(n) over (partition by {key}), 0) as fpr
  from c window w as (partition by {key} order by cutoff desc rows between unbounded preceding and current row)),
auc as (select {key}, sum((fpr - pf) * (tpr + pt) / 2) as auc from (select *, lag(fpr, 1, 0) over o as pf, lag(tpr, 1, 0) over o as pt from roc window o as (partition by {key} order by fpr, tpr)) group by 1)"""


@job("plate_stats", f"with {_STATS} select plate, mean_neg, sd_neg, cv_percent from stats", "od_readings")
def plate_stats(spark, sf):
    return plates.plate_stats(t.od_readings(spark, sf))


@job("plate_cutoffs", f"with {_STATS} select plate, cutoff_2sd, cutoff_3sd, cutoff from stats", "od_readings")
def plate_cutoffs(spark, sf):
    return plates.plate_cutoffs(plates.plate_stats(t.od_readings(spark, sf))).select("plate", "cutoff_2sd", "cutoff_3sd", "cutoff")


@job("classify_wells", f"with {_STATS}, {_CLS} select plate, positive::bigint as positive, negative::bigint as negative, sensitivity, specificity from cls", "od_readings")
def classify_wells(spark, sf):
    w = t.od_readings(spark, sf)
    return plates.classify_wells(w, plates.plate_cutoffs(plates.plate_stats(w)))


@job("all_wells", "select plate, control, count(*) as wells, min(od) as low, max(od) as high from od_readings where control in ('neg', 'pos') group by 1, 2", "od_readings")
def all_wells(spark, sf):
    w = t.od_readings(spark, sf)
    part = lambda k: w.filter(F.col("control") == k).select("plate", "od")
    return plates.all_wells(part("neg"), part("pos")).groupBy("plate", "control").agg(F.count("*").alias("wells"), F.min("od").alias("low"), F.max("od").alias("high"))


@job("roc_points", f"with {_roc('od_readings', 'plate', 'od', 'control')} select plate, cutoff, tpr, fpr from roc", "od_readings")
def roc_points(spark, sf):
    return plates.roc_points(t.od_readings(spark, sf)).drop("slice")


@job("roc_auc", f"with {_roc('od_readings', 'plate', 'od', 'control')} select * from auc", "od_readings")
def roc_auc(spark, sf):
    return plates.roc_auc(plates.roc_points(t.od_readings(spark, sf)))


@job("plate_report", f"with {_STATS}, {_CLS}, {_roc('od_readings', 'plate', 'od', 'control')} select plate, mean_neg, sd_neg, cv_percent, cutoff_2sd, cutoff_3sd, cutoff, positive::bigint as positive, negative::bigint as negative, sensitivity, specificity, auc from stats join cls using (plate) left join auc using (plate)", "od_readings")
def plate_report(spark, sf):
    return plates.plate_report(t.od_readings(spark, sf))


@job(
    "roc_document_quality",
    f"with v as (select 'quality' as curve, n_chars::double as score, case when quality = 1 then 'pos' else 'neg' end as control from documents join labels using (doc_id)), {_roc('v', 'curve', 'score', 'control')} select * from auc",
)
def roc_document_quality(spark, sf):
    """ROC of text length against the quality label: one curve over all labelled documents."""
    d = t.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    lab = t.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("control"))
    rows = d.join(lab, "doc_id").withColumn("curve", F.lit("quality"))
    return plates.roc_auc(plates.roc_points(rows, "curve", "score"), "curve")


@job(
    "read_readings",
    """with x as (select user_id % 10 as plate, unnest(regexp_split_to_array(event_id || ', ' || event_type || ' ' || cast(round(value, 2) as decimal(18, 2)), '[\\n,\\s]+')) as tok from events)
    select plate, count(*) as readings, sum(try_cast(tok as double)) as total from x where try_cast(tok as double) is not null group by 1""",
)
def read_readings(spark, sf):
    """Free text of identifiers, words and readings per event: the numeric tokens are kept."""
    text = F.concat(F.col("event_id").cast("string"), F.lit(", "), "event_type", F.lit(" "), F.round("value", 2).cast("decimal(18,2)").cast("string"))
    tokens = t.table(spark, sf, "events").select((F.col("user_id") % 10).alias("plate"), F.explode(plates.read_readings(text)).alias("v"))
    return tokens.groupBy("plate").agg(F.count("*").alias("readings"), F.sum("v").alias("total"))
