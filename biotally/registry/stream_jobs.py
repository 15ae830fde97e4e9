"""Registered jobs: streams run over the event files, with batch twins as oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.reference_tables import PK_COLUMNS, PK_PROFILES
from biotally.registry.core import job
from biotally.streaming import jobs

IV = dict(zip(PK_COLUMNS, PK_PROFILES[2]))


def _events(spark, sf):
    return jobs.event_stream(spark, f"{sf.rstrip('/')}/event[s].parquet")


@job(
    "outbreak_stream",
    """with e as (select 'herd-' || user_id % 20 as cluster, epoch_us(ts) // (7 * 86400 * 1000000::bigint) as w, case when event_type = 'error' then 2 when event_type = 'click' then 1 else 0 end as hits, ts from events),
    last as (select max(epoch_us(ts)) as m from events)
    select cluster, make_timestamp(w * 7 * 86400 * 1000000::bigint) as start, count(*) as isolates, count_if(hits > 0)::bigint as with_hits, sum(hits)::bigint as hits from e, last
    where (w + 1) * 7 * 86400 * 1000000::bigint <= m - 86400 * 1000000::bigint group by 1, 2""",
)
def outbreak_stream(spark, sf):
    """Windows closed by the watermark, per herd and week."""
    e = _events(spark, sf).select(
        F.concat(F.lit("herd-"), (F.col("user_id") % 20).cast("string")).alias("cluster"), "ts",
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("hits"),
    )
    return jobs.run_available(jobs.outbreak_stream(e), "append", ["cluster", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@job(
    "plate_stream",
    "select plate, date_trunc('day', ts) as start, count(*) as wells, avg(od) as mean_neg, coalesce(stddev_samp(od), 0) as sd_neg from (select user_id % 10 as plate, ts, value / 100.0::double as od from events where event_type = 'view') group by 1, 2",
)
def plate_stream(spark, sf):
    e = _events(spark, sf).select(
        (F.col("user_id") % 10).alias("plate"), "ts", F.expr("case event_type when 'view' then 'neg' when 'purchase' then 'pos' else 'sample' end").alias("control"), (F.col("value") / 100.0).alias("od")
    )
    out = jobs.run_available(jobs.plate_stream(e), "update", ["plate", "start"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@job(
    "exposure_stream",
    # Samples that the watermark, a day behind the latest row, has passed (in milliseconds).
    f"""select s.subject, s.event_id as sample_id, s.t, coalesce(sum(d.dose * exp(-{IV['ke']}::double * (s.t - d.t))), 0) as amount from samples s left join doses d on d.subject = s.subject and d.t <= s.t
    where s.event_id in (select event_id from events where epoch_us(ts) // 1000 <= (select max(epoch_us(ts)) // 1000 - 86400000 from events where event_type in ('purchase', 'click'))) group by 1, 2, 3""",
    "samples doses",
)
def exposure_stream(spark, sf):
    e = _events(spark, sf).filter("event_type in ('purchase', 'click')")
    hours = F.expr("(unix_micros(ts) - unix_micros(timestamp '2024-01-01 00:00:00')) / 3600000000D")
    is_sample = F.col("event_type") == "click"
    log = e.select(F.col("user_id").alias("subject"), "ts", hours.alias("t"), "event_id", F.when(is_sample, 0.0).otherwise(F.col("value")).alias("dose"), is_sample.alias("is_sample"))
    return jobs.run_available(jobs.exposure_stream(log, IV["ke"]), "append", ["subject", "sample_id"])
