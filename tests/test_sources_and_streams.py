"""File sources, sinks and late rows in streams."""

import datetime

from pyspark.sql import functions as F

from biotally.sources import records, reports
from biotally.streaming import jobs


def test_fasta_and_named(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nacgt\nAC\n>s2\nGGG\n")
    assert sorted(tuple(r) for r in records.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("s1", "ACGTAC"), ("s2", "GGG")]
    (tmp_path / "n.txt").write_text("x\tAC GT\ny  TTT\nbroken\n\n")
    good, bad = records.read_named_sequences(spark, str(tmp_path / "n.txt"))
    assert sorted(tuple(r) for r in good.collect()) == [("x", "ACGT"), ("y", "TTT")] and [r.value for r in bad.collect()] == ["broken"]


def test_structure_confidence(spark, tmp_path):
    line = "ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f"
    (tmp_path / "p.pdb").write_text("HEADER\n" + "\n".join(line % (i, r, 1, 2, 3, 1, b) for i, r, b in ((1, 1, 91.5), (2, 1, 10.0), (3, 2, 55.0))) + "\nTER\n")
    assert sorted((r.residue_no, r.plddt) for r in records.read_pdb_confidence(spark, str(tmp_path / "p.pdb")).collect()) == [(1, 91.5), (2, 55.0)]


def test_hit_xml(spark, tmp_path):
    hsp = "<Hsp><Hsp_identity>45</Hsp_identity><Hsp_align-len>50</Hsp_align-len><Hsp_evalue>1e-9</Hsp_evalue><Hsp_bit-score>80.5</Hsp_bit-score><Hsp_query-from>11</Hsp_query-from><Hsp_query-to>60</Hsp_query-to></Hsp>"
    (tmp_path / "h.xml").write_text(f"<R><Hit><Hit_accession>A1</Hit_accession><Hit_def>p &amp; q [Sus scrofa]</Hit_def><Hit_hsps>{hsp}</Hit_hsps></Hit></R>")
    r = records.read_hit_xml(spark, str(tmp_path / "h.xml"), 100).first()
    assert (r.accession, r.organism, r.identity, r.coverage, r.align_length) == ("A1", "Sus scrofa", 90.0, 50.0, 50)


def test_catalog_json(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"primaryAccession":"P1","proteinDescription":{"submissionNames":[{"fullName":{"value":"sub"}}]},"organism":{"scientificName":"X"},"sequence":{"value":"ACD"}}\n')
    r = records.read_records_json(spark, str(tmp_path / "u.json"), "UniProt").first()
    assert tuple(r) == ("UniProt", "P1", "sub", "X", 3)


def test_csv_and_text(spark, tmp_path):
    f = spark.createDataFrame([('a,b "c"',), ("plain",)], "s string").select(reports.csv_field(F.col("s")).alias("f"))
    assert [r.f for r in f.collect()] == ['"a,b ""c"""', "plain"]
    out = str(tmp_path / "rep")
    reports.write_text_report(spark.createDataFrame([("k1", "line")], "k string, value string"), out, "k")
    assert [(r.value, r.k) for r in spark.read.text(out).collect()] == [("line", "k1")]


def test_validators(spark):
    rows = ['{"differentialDiagnoses":[{"probability":0.5}],"recommendedTests":["a"],"urgency":"??","recommendation":"r"}', '{"urgency":"low"}', "nonsense"]
    got = [r.d for r in spark.createDataFrame([(x,) for x in rows], "j string").select(records.validate_diagnosis(F.col("j")).alias("d")).collect()]
    assert got[0].urgency == "moderate" and got[0].diagnoses[0].name == "?" and got[1] is None and got[2] is None


def test_late_rows_are_dropped(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    schema = "cluster string, ts timestamp, hits int"
    src = str(tmp_path / "in")
    for rows in ([("c", day(0), 1), ("c", day(1), 0)], [("c", day(20), 1)], [("c", day(21), 0)], [("c", day(2), 5), ("c", day(40), 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    # A trigger drops by the watermark of the trigger before it, so one more file lies between.
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.run_available(jobs.outbreak_stream(files), "append", ["cluster", "start"])
    assert sum(r.hits for r in out.collect()) == 2  # the late row's five hits are gone


def test_exposure_state_spans_triggers(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    schema = "subject long, ts timestamp, t double, event_id long, dose double, is_sample boolean"
    row = lambda h, e, d, s: (1, t0 + datetime.timedelta(hours=h), float(h), e, d, s)
    src = str(tmp_path / "in")
    # The last row lets the watermark, a day behind, pass the others.
    for rows in ([row(0, 1, 10.0, False), row(2, 2, 0.0, True)], [row(5, 3, 4.0, False), row(6, 4, 0.0, True)], [row(40, 5, 0.0, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.sample_id: r.amount for r in jobs.run_available(jobs.exposure_stream(files, 0.1), "append", ["subject", "sample_id"]).collect()}
    import math

    assert abs(got[2] - 10 * math.exp(-0.2)) < 1e-9 and abs(got[4] - (10 * math.exp(-0.6) + 4 * math.exp(-0.1))) < 1e-9
