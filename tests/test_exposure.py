"""Own profiles against sums over all pairs of dose and sample; late doses of a stream against the batch result."""

import datetime
import math
import random
import uuid

import pytest

from biotally.operators import exposure
from biotally.reference_tables import PK_COLUMNS
from biotally.streaming import jobs

PROFILES = {
    1: ("iv", "dog", 1.0, 0.25, 0.0, 0.23, "IV", 2.0, "cmax_mic", 10.0),
    2: ("oral", "dog", 0.9, 1.5, 0.8, 0.05, "oral", 1.0, "auc_mic", 40.0),
    3: ("equal", "cat", 0.8, 0.7, 0.3, 0.3, "oral", 0.5, "t_above_mic", 40.0),
    4: ("slow", "cow", 1.0, 2.0, 0.9, 0.001, "oral", 0.5, "auc_mic", 40.0),
}


def concentration(doses, t, p):
    _, _, f, v, ka, ke, route, *_ = p
    total = 0.0
    for at, dose in doses:
        age = t - at
        if age >= 0:
            part = math.exp(-ke * age) if route == "IV" else ka * age * math.exp(-ke * age) if ka == ke else ka / (ka - ke) * (math.exp(-ke * age) - math.exp(-ka * age))
            total += f * dose / v * part
    return total


def test_each_subject_by_its_own_profile(spark):
    r = random.Random(3)
    doses = {s: sorted((r.uniform(0, 9000), r.uniform(1, 50)) for _ in range(60)) for s in (1, 2, 3, 4, 5)}
    doses[3] += [(400.0, 7.0), (400.0, 7.0)]
    samples = {s: [r.uniform(-10, 9500) for _ in range(50)] + [400.0] for s in (1, 2, 3, 4, 5, 6)}
    d = spark.createDataFrame([(s, t, x) for s, rows in doses.items() for t, x in rows], "subject long, t double, dose double")
    m = spark.createDataFrame([(s, t, s * 1000 + k) for s, rows in samples.items() for k, t in enumerate(rows)], "subject long, t double, sample_id long")
    p = spark.createDataFrame([(s, *v) for s, v in {**PROFILES, 6: PROFILES[2]}.items()], "subject long, " + ", ".join(f"{c} {'string' if c in ('drug', 'species', 'route', 'target_type') else 'double'}" for c in PK_COLUMNS))
    got = {x.sample_id: x.conc for x in exposure.own_superposition(d, m, p).collect()}
    assert len(got) == 51 * 5  # the subject without a profile is left out, the one without a dose is not
    for s in (1, 2, 3, 4, 6):
        for k, t in enumerate(samples[s]):
            assert got[s * 1000 + k] == pytest.approx(concentration(doses.get(s, []), t, PROFILES[2 if s == 6 else s]), rel=1e-9, abs=1e-12)
    report = {x.subject: x for x in exposure.own_exposure_report(d, m, p).collect()}
    for s, profile in PROFILES.items():
        curve = [(t, concentration(doses[s], t, profile)) for t in samples[s]]
        above = 100 * sum(c >= profile[7] for _, c in curve) / len(curve)
        assert report[s].t_above_mic == pytest.approx(above) and report[s].cmax_mic == pytest.approx(max(c for _, c in curve) / profile[7])
        assert report[s].pd_index == pytest.approx(getattr(report[s], profile[8])) and report[s].attained == (report[s].pd_index >= profile[9])
    assert exposure.own_superposition(d.limit(0), m.limit(0), p).collect() == []


SCHEMA = "subject long, ts timestamp, t double, event_id long, dose double, is_sample boolean"
START = datetime.datetime(2024, 1, 1)


def streamed(spark, folder, files):
    """Rows that the stream gives for the files in turn, and how many it dropped as too late."""
    for rows in files:
        spark.createDataFrame([(s, START + datetime.timedelta(hours=h), h, e, d, m) for s, h, e, d, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"out_{uuid.uuid4().hex}"
    query = jobs.exposure_stream(source, 0.1, "6 hours", idle_hours=24.0 * 365).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    return {x.sample_id: x.amount for x in spark.table(name).collect()}, dropped


def plain_amount(rows, subject, t):
    return sum(d * math.exp(-0.1 * (t - h)) for s, h, _, d, m in rows if s == subject and not m and h <= t)


def test_shuffled_arrival_equals_the_batch_result(spark, tmp_path):
    r = random.Random(5)
    rows = [(s, round(r.uniform(0, 60), 2), 100 * s + k, 0.0 if k % 2 else r.uniform(1, 9), bool(k % 2)) for s in (1, 2) for k in range(24)]
    rows.append((1, 70.0, 999, 1.0, False))
    rows.sort(key=lambda x: x[1] + r.uniform(0, 5.9))  # each at most 5.9 hours late
    got, dropped = streamed(spark, str(tmp_path / "in"), [rows[k : k + 12] for k in range(0, len(rows), 12)])
    assert dropped == 0
    assert set(got) == {e for _, h, e, _, m in rows if m and h <= 64}
    for s, h, e, _, m in rows:
        if e in got:
            assert got[e] == pytest.approx(plain_amount(rows, s, h))


def test_rows_beyond_the_delay_are_counted_as_dropped(spark, tmp_path):
    files = [[(1, 0.0, 1, 8.0, False), (1, 10.0, 2, 0.0, True)], [(1, 30.0, 3, 0.0, True)], [(1, 26.0, 4, 4.0, False)], [(1, 1.0, 5, 100.0, False), (1, 60.0, 6, 0.0, True)], [(1, 70.0, 7, 0.0, True)]]
    got, dropped = streamed(spark, str(tmp_path / "in"), files)
    assert dropped == 1  # the dose of hour 1, which came after hour 30
    kept = [x for f in files for x in f if x[2] != 5]
    assert set(got) == {2, 3, 6} and all(got[e] == pytest.approx(plain_amount(kept, 1, h)) for _, h, e, _, m in kept if e in got)


def test_state_is_called_a_few_times_a_subject(spark, tmp_path, monkeypatch):
    import pandas as pd

    calls = []

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Rows(dict):
        def __getattr__(self, name):
            held = {"updateValue": self.__setitem__, "getValue": self.__getitem__, "containsKey": self.__contains__, "removeKey": self.pop, "keys": None}[name]
            return lambda *given: calls.append(name) or held(*given)

        def keys(self):
            calls.append("keys")
            return iter(list(dict.keys(self)))

    class Handle:
        timers: set = set()
        getValueState = lambda self, *_: Value()
        getMapState = lambda self, *_: Rows()

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.add(at)

    class At:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    r = random.Random(9)
    rows = [(1, r.uniform(0, 90), k, 0.0 if k % 2 else r.uniform(1, 9), bool(k % 2)) for k in range(2000)]
    machine = jobs._Exposure(0.1, 10**9)
    machine.init(Handle())
    log = pd.DataFrame([(START + datetime.timedelta(hours=h), h, e, d, m) for _, h, e, d, m in rows], columns=["ts", "t", "event_id", "dose", "is_sample"])
    list(machine.handleInputRows((1,), iter([log[:900], log[900:]]), None))
    got = {}
    start = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    for hour in (30, 60, 100):  # the watermark goes on in steps
        for out in machine.handleExpiredTimer((1,), At(start + hour * 3600000), At(start + hour * 3600000)):
            got.update(zip(out["sample_id"], out["amount"], strict=True))
    assert len(got) == 1000 and all(got[e] == pytest.approx(plain_amount(rows, 1, h)) for _, h, e, _, m in rows if m)
    assert len(calls) < 100  # a timer and some calls for every row before
