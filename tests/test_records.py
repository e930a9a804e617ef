"""Record files and their normal forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.sources import files


def values(spark, rule, texts):
    return [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_phones(spark):
    assert values(spark, N.phone, ["+91 98765 43210", "9876543210", "919876543210", "(+91) 98765-43210", "+9876543210", "12345", "abc", None]) == ["+919876543210"] * 5 + [None, None, None]


def test_vehicles_and_accounts(spark):
    assert values(spark, N.vehicle, ["dl-01 ab 1234", "DL1A1"]) == ["DL01AB1234", None]
    assert values(spark, N.account, ["acc-001", "a!"]) == ["ACC001", None]


def test_timestamps(spark):
    def want(text):
        text = text.strip().removesuffix("Z").strip()
        for form in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
            try:
                return dt.datetime.strptime(text, form).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                pass
        try:
            t = dt.datetime.fromisoformat(text)
        except ValueError:
            return None
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        return t.strftime("%Y-%m-%dT%H:%M:%SZ")

    texts = ["2026-07-03T22:26:00Z", "2026-07-03 01:00:00+05:30", "2026-07-03T01:00:00-0330", "yesterday", "2026", "03/07/2026 10:00", "2026-7-3", "2026-07-03T9:05:00", "2026-07-03 10:00", "2026-07-03T10", " 2026-07-03 ", "2026-02-30", "2026-07-03T25:00:00", "2026-07-03T10:00:00.987", "2026-07-03T10:00:00,5+02", "2026-07-03T10:61", "2026-13-01", "", "20260102", "20260102T103000", "20260102T10:30+0530", "2026-01-02T103000Z", "2026-01-02T10:30:00+05:30:30", "20260102T1030", "20260102T10+05", "202601", "2026-0102", "\t2026-01-02\n", "\u00a02026-01-02T05:00:00 Z"]
    assert values(spark, N.timestamp, texts) == [want(t) for t in texts]
    assert values(spark, N.date, ["2026-07-03 01:00:00+05:30"]) == ["2026-07-02"]


def test_numbers_and_names(spark):
    assert values(spark, N.amount, ["1,200.5", "-1", "nan", "1_000"]) == [1200.5, None, None, None]
    assert values(spark, N.integer, ["60", "60.0", "-2", "7\n"]) == [60, None, None, 7]
    assert values(spark, N.amount, ["5\t", "\u00a05", ", 5", "1.e3", "."]) == [5.0, 5.0, 5.0, 1000.0, None]
    assert values(spark, N.latitude, ["5\t", "90.1", "\x1c-90"]) == [5.0, None, -90.0]
    assert values(spark, N.blank, ["", " ", "\t", "\n\r", "\u00a0", "\u2003\x1f", "x", " x", None]) == [True] * 6 + [False, False, True]
    assert values(spark, N.whitespace, ["\u00a0a \u2003\t b\x1c"]) == ["a b"]
    assert values(spark, N.phone, ["98765\u00a043210\t"]) == ["+919876543210"]
    assert values(spark, N.clean_person, ["Complainant Rahul Sharma,", "witnesses  Anil", "Suspects A", " Rita. ", "x" * 257, "accused"]) == ["Rahul Sharma", "witnesses  Anil", None, "Rita", None, "accused"]
    assert values(spark, lambda c: N.shown_score(c.cast("double")), ["0.126", None]) == ["0.13", "—"]
    assert values(spark, lambda c: N.shown_percent(c.cast("double")), ["0.126", None]) == ["13%", "—"]
    assert values(spark, lambda c: N.shown_integer(c.cast("long")), ["1234567", None]) == ["1,234,567", "—"]


CALL = "cdr_id string, caller string, receiver string, timestamp string, duration string"


def test_structural_errors_end_a_record(spark):
    rows = [("C1", "9876543210", "9876543211", "2026-01-01T00:00:00Z", "5"), ("bad id!", "1", "9876543211", None, "5"), ("C3", "1", "9876543211", "03/07/2026", "-5"), (" ", "1", "2", "3", "4")]
    standard = files.standardize(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], CALL + ", record long"), "CDR")
    valid, errors = files.split_records(standard)
    assert [r.source_id for r in valid.collect()] == ["C1"]
    assert {(e.record, e.field, e.code) for e in errors.collect()} == {
        (1, "timestamp", "MISSING_REQUIRED_FIELD"), (1, "cdr_id", "INVALID_RECORD_STRUCTURE"),
        (2, "caller", "INVALID_PHONE_NUMBER"), (2, "timestamp", "INVALID_TIMESTAMP"), (2, "duration", "INVALID_NUMERIC_VALUE"),
        (3, "cdr_id", "MISSING_REQUIRED_FIELD"), (3, "cdr_id", "INVALID_RECORD_STRUCTURE"),
    }
    assert tuple(files.run_status(standard).first()) == (1, 7, 0, "PARTIAL")
    assert [e.record for e in files.first_errors(errors, 3).collect()] == [1, 1, 2]
    assert files.run_status(standard.filter("record > 0")).first().status == "FAILED" and files.run_status(standard.filter("record = 0")).first().status == "SUCCEEDED"


@pytest.mark.parametrize("empty", ["\t", "\n", "\u00a0", " \u2003 "])
def test_required_fields_of_white_space_are_missing(spark, empty):
    rows = [("C1", "9876543210", "9876543211", "2026-01-01T00:00:00Z", empty), ("C2", "9876543210\t", "9876543211", "2026-01-01", "5\n"), (empty, "9876543210", "9876543211", "2026-01-01", "5")]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], CALL + ", record long")
    names = [c for c in frame.columns if c != "record"]
    mapped = frame.select("record", F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*names)).alias("fields"))
    for records in (frame, mapped):
        standard = files.standardize(records, "CDR")
        valid, errors = files.split_records(standard)
        assert [(r.source_id, r.normalized.duration, r.original["duration"]) for r in valid.collect()] == [("C2", 5, "5\n")]
        assert {(e.record, e.field, e.code) for e in errors.collect()} == {(0, "duration", "MISSING_REQUIRED_FIELD"), (2, "cdr_id", "MISSING_REQUIRED_FIELD"), (2, "cdr_id", "INVALID_RECORD_STRUCTURE")}
        assert standard.filter("record = 2").first().source_id == "upload#L3"


def test_every_field_is_computed_once(spark):
    """The texts of a record are stripped once each, whatever uses them."""
    frame = spark.createDataFrame([("C1", "9876543210", "9876543211", "2026-01-01T00:00:00Z", "5", 0)], CALL + ", record long")
    plan = files.standardize(frame, "CDR")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("]+|[") <= 5 + 2 * 2  # five fields; the two phones' and the time's own inner strips


def test_optional_fields_and_derived_keys(spark):
    rows = [("L1", " New  Delhi ", "28.6", ""), ("L2", "x", "91", "77")]
    got = {r.source_id: r for r in files.standardize(spark.createDataFrame(rows, "location_id string, name string, latitude string, longitude string"), "LOCATION").collect()}
    assert got["L1"].normalized.name_normalized == "new delhi" and got["L1"].normalized.longitude is None and not got["L1"].errors
    assert [e.code for e in got["L2"].errors] == ["INVALID_NUMERIC_VALUE"]
    car = files.standardize(spark.createDataFrame([("V1", "dl01ab1234", "Ann  LEE")], "vehicle_id string, registration_number string, owner_name string"), "VEHICLE").first()
    assert car.normalized.owner_normalized == "ann lee" and car.normalized.source is None


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    return d


def test_files_are_parsed_or_refused(spark, folder):
    made = {
        "a.csv": 'fir_id,date,text\nF1,2026-01-01,"said ""no""\nand left"\nF2,2026-01-02\nF3,2026-01-03,t,more\n', "b.json": '{"records": [{"fir_id": "F1", "n": 5, "x": null}, 7]}', "c.json": "[]",
        "d.json": "{bad", "e.csv": "fir_id,date\n", "f.txt": "one\n\n two \n", "g.pdf": "x", "i.doc": "x", "j.txt": " \n ", "k.json": '{"records": 5}',
    }
    for name, text in made.items():
        (folder / name).write_text(text)
    (folder / "l.csv").write_bytes(b"fir_id\n\xff\n")
    (folder / "m.txt").write_text("x\n" * (files.MAX_RECORDS + 1))
    rows = files.parse_files(spark, str(folder), "FIR").collect()
    short = lambda p: p.rsplit("/", 1)[1]
    refused = {short(r.path): r.code for r in rows if r.record is None}
    assert refused == {"c.json": "INVALID_JSON", "d.json": "INVALID_JSON", "e.csv": "INVALID_CSV", "g.pdf": "PDF_EXTRACTION_NOT_SUPPORTED", "i.doc": "UNSUPPORTED_FILE_TYPE", "j.txt": "INVALID_RECORD_STRUCTURE", "k.json": "INVALID_JSON", "l.csv": "INVALID_ENCODING", "m.txt": "TOO_MANY_RECORDS"}
    kept = {(short(r.path), r.record): r.fields for r in rows if r.record is not None}
    assert kept["a.csv", 0]["text"] == 'said "no"\nand left' and kept["a.csv", 1]["text"] is None and kept["a.csv", 2][""] == "more"
    assert kept["b.json", 0] == {"fir_id": "F1", "n": "5", "x": None} and kept["b.json", 1] is None and kept["f.txt", 1] == {"text": " two "}
    part = files.parse_files(spark, str(folder / "b.json"), "FIR")
    assert [e.code for e in files.split_records(files.standardize(part, "FIR"))[1].filter("record = 1").collect()] == ["INVALID_RECORD_STRUCTURE"]
    lines = files.standardize(files.parse_files(spark, str(folder / "f.txt"), "FIR"), "FIR", upload="up", txt=True).orderBy("record").collect()
    assert [(r.source_id, r.normalized.text) for r in lines] == [("up#L1", "one"), ("up#L2", "two")]
    assert files.parse_files(spark, str(folder / "f.txt"), "CDR").first().code == "INVALID_RECORD_STRUCTURE"


def test_file_report(spark, folder):
    for name, text in {"a.csv": "x", "b.csv": "x", "e.exe": "z"}.items():
        (folder / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in files.file_report(spark, str(folder)).collect()}
    assert got == {"a.csv": None, "b.csv": "DUPLICATE_FILE", "e.exe": "UNSUPPORTED_FILE_TYPE"}
    sizes = spark.createDataFrame([("d.csv", 0), ("f.csv", files.MAX_BYTES + 1), ("g", 1), ("h.CSV", 1)], "n string, b long")
    assert [r.p for r in sizes.select(files.file_problem(F.col("n"), F.col("b"), "CDR").alias("p")).collect()] == ["INVALID_CSV", "FILE_TOO_LARGE", "UNSUPPORTED_FILE_TYPE", None]
    names = spark.createDataFrame([("a/b.csv",), (None,), (" ",), ("x" * 256,), ("ok.csv",)], "n string")
    assert [r.p for r in names.select(files.name_problem(F.col("n")).alias("p")).collect()] == ["INVALID_FILE_NAME"] * 4 + [None]


def test_processed_store(spark, tmp_path):
    rows = files.split_records(files.standardize(spark.createDataFrame([("C1", "9876543210", "9876543211", "2026-01-01", "5", 0), ("C2", "9876543210", "9876543211", "2026-01-01", "5", 1)], CALL + ", record long"), "CDR"))[0]
    for upload in ("up2", "up1"):
        files.write_processed(rows, f"{tmp_path}/p", "CDR", upload, "calls.csv")
    got = files.read_processed(spark, f"{tmp_path}/p", "CDR").collect()
    assert [(r.upload_id, r.source_id) for r in got] == [("up1", "C1"), ("up1", "C2"), ("up2", "C1"), ("up2", "C2")] and got[0].provenance.source_file == "calls.csv"
    with pytest.raises(files.IngestError) as e:
        files.read_processed(spark, f"{tmp_path}/p", "CDR", "up9")
    assert e.value.code == "NO_PROCESSED_DATA"
    (tmp_path / "t.csv").write_text(json.dumps("x"))
    with pytest.raises(files.IngestError):
        files.read_csv(spark, f"{tmp_path}/t.csv", "CDR")
