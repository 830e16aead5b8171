import io
import zipfile
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.functions import scalars as S
from brewlens.sources import delimited, ingest, workbook

ABSOLUTE = """timestamp,pH,DO_%,temp_C,OD600,glucose_g_L
2026-04-20 08:00:00,7.0,95.0,37.0,0.5,20.0
2026-04-20 08:15:00,7.1,94.0,37.1,0.8,18.2
2026-04-20 08:30:00,7.0,92.5,37.0,1.2,15.9
2026-04-20 08:45:00,6.9,91.0,36.9,1.8,13.0
2026-04-20 09:00:00,6.9,90.2,37.0,2.5,10.1
"""
ELAPSED = """time_h,pH,DO_%,temp_K,biomass_mg_L
0.0,7.0,95.0,310.15,500
0.25,7.0,94.1,310.15,620
0.5,7.1,93.0,310.25,800
0.75,7.0,92.0,310.15,1020
1.0,6.9,91.0,310.05,1300
"""


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            data = text if isinstance(text, bytes) else text.encode()
            (tmp_path / f"{name}.csv").write_bytes(data)
        return str(tmp_path)

    return write


def values(load, **where):
    rows = load.records.orderBy("ts")
    for k, v in where.items():
        rows = rows.where(F.col(k) == v)
    return [r["value"] for r in rows.collect()]


def test_absolute_times(spark, folder):
    load = ingest.load_delimited(spark, folder(run=ABSOLUTE))
    assert load.records.count() == 25 and load.problems.isEmpty() and load.rejects.isEmpty()
    assert load.batches.first()["name"] == "run"
    assert values(load, variable="biomass") == [0.5, 0.8, 1.2, 1.8, 2.5]
    assert values(load, variable="glucose") == [20.0, 18.2, 15.9, 13.0, 10.1]
    first = load.records.orderBy("ts").first()
    assert first["ts"] == datetime(2026, 4, 20, 8, 0)
    plan = {r["header"]: r for r in load.plan.collect()}
    assert plan["timestamp"]["is_ts"] and not plan["timestamp"]["is_elapsed"]
    assert plan["DO_%"]["variable"] == "dissolved_oxygen" and plan["DO_%"]["confidence"] == 1.0
    original = load.original.collect()
    assert len(original) == 5 and original[0]["headers"][0] == "timestamp"
    summary = load.summary().first()
    assert (summary["rows_imported"], summary["time_points"], summary["columns_mapped"]) == (25, 5, 5)


def test_elapsed_times_and_units(spark, folder):
    path = folder(run=ELAPSED)
    load = ingest.load_delimited(spark, path, inoculation="2026-04-20 08:00:00")
    assert load.records.count() == 20
    assert values(load, variable="temperature")[0] == pytest.approx(37.0)
    assert values(load, variable="biomass") == [0.5, 0.62, 0.8, 1.02, 1.3]
    assert {r["unit"] for r in load.records.where("variable = 'temperature'").collect()} == {"C"}
    assert load.records.agg(F.max("ts")).first()[0] == datetime(2026, 4, 20, 9, 0)
    without = ingest.load_delimited(spark, path)
    assert "inoculation" in without.problems.first()["problem"] and without.records.isEmpty()


def test_differing_files_in_one_load(spark, folder):
    path = folder(
        a=ABSOLUTE.replace(",", ";"),
        b="time;temp_F;note;glucose\n;F;;g/L\n2026-01-01T00:00:00Z;212;\"x; y\";1,5\n2026-01-01T01:00:00Z;32;z;2\n",
        c="Datum,OD\n".encode("latin-1") + "21.04.2026 10:00,0.7\n21.04.2026 11:00,0.9\n21.04.2026 12:00,1.1\nkaputt,1.0\n".encode("latin-1"),
        d="﻿timestamp\tpH\ttemperature\n2026-01-01 00:00:00\t15.0\tabc\n2026-01-01 00:01:00\t-0.5\t\n",
        e="x,y\nfoo,bar\n",
        f="time,Zähler,pH\n2026-01-01,1,7\n".encode("latin-1"),
    )
    load = ingest.load_delimited(spark, path)
    names = {r["name"]: r["batch_id"] for r in load.batches.collect()}
    assert len(names) == 6

    def of(name):
        return load.records.where(F.col("batch_id") == names[name])

    assert of("a").count() == 25
    b = {(r["variable"], r["ts"].hour): r["value"] for r in of("b").collect()}
    assert b[("temperature", 0)] == pytest.approx(100.0) and b[("temperature", 1)] == pytest.approx(0.0)
    assert b[("glucose", 1)] == 2.0 and ("glucose", 0) not in b
    assert sorted(r["value"] for r in of("c").collect()) == [0.7, 0.9, 1.1]
    assert [r["fields"][0] for r in load.rejects.collect()] == ["kaputt"]
    flags = {r["value"]: r["quality_flag"] for r in of("d").collect()}
    assert flags == {15.0: "above_maximum", -0.5: "below_minimum"}
    assert load.warnings().count() == 2
    assert [r["problem"] for r in load.problems.collect()] == ["no timestamp column"]
    headers = [r["header"] for r in load.plan.where(F.col("source").endswith("f.csv")).collect()]
    assert "Zähler" in headers


def test_confirmed_mapping_and_custom_words(spark, folder):
    path = folder(run="time,foo,bar\n2026-01-01 00:00:00,1,2\n")
    custom = ingest.load_delimited(spark, path, custom_vocab={"lactate": ["foo"]})
    assert values(custom, variable="lactate") == [1.0]
    confirmed = spark.createDataFrame([("bar", "glucose")], "header string, variable string")
    load = ingest.load_delimited(spark, path, confirmed=confirmed)
    assert values(load, variable="glucose") == [2.0]


def test_impossible_conversions_keep_the_source_unit(spark, folder):
    load = ingest.load_delimited(spark, folder(run="time,glucose\n,mol/L\n2026-01-01 00:00:00,1\n2026-01-01 01:00:00,2\n"))
    row = load.records.orderBy("ts").first()
    assert row["unit"] == "mol/L" and row["value"] == 1.0 and "additional parameters" in row["warning"]


def test_quoted_fields(spark):
    rows = spark.createDataFrame([('a,"b, ""c""",d',), ("x,,z,",)], "line string")
    got = [r[0] for r in rows.select(delimited.split_line(F.col("line"), F.lit(","))).collect()]
    assert got == [["a", 'b, "c"', "d"], ["x", "", "z", ""]]


def test_header_matching(spark):
    names = ["OD600", " _temp_ ", "Glucose Conc", "lactate conc", "qwertz", "", "T"]
    got = {r["header"]: (r["variable"], r["confidence"]) for r in ingest.match_headers(
        spark.createDataFrame([(n,) for n in names], "header string")).collect()}
    assert got["OD600"] == ("biomass", 1.0) and got[" _temp_ "] == ("temperature", 1.0)
    assert got["Glucose Conc"][0] == "glucose" and got["Glucose Conc"][1] < 1.0
    assert got["lactate conc"] == ("lactate", 0.74)
    assert got["qwertz"] == (None, 0.0) and got[""] == (None, 0.0) and got["T"] == ("temperature", 1.0)
    table = ingest.vocabulary_table(spark, ingest.vocabulary({"new": ["n1"], "ph": ["acid"]}))
    assert table.select("variable").distinct().count() == 16


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_units(spark):
    pairs = [("mg/mL", "g/L", 5.0), ("mg/L", "g/L", 5000.0), ("g/mL", "g/L", 0.005), ("ug/mL", "g/L", 5000.0), ("K", "C", 278.15),
             ("F", "C", 41.0), ("min", "h", 300.0), ("s", "h", 18000.0), ("mL", "L", 5000.0), ("C", "C", 5.0)]
    got = one(spark, *[S.convert_unit(F.lit(v), F.lit(a), F.lit(b)) for a, b, v in pairs])
    assert got == pytest.approx([5.0] * len(pairs))
    assert one(spark, S.convert_unit(F.lit(1.0), F.lit("K"), F.lit("g/L")), S.convert_unit(
        F.lit(float("nan")), F.lit("K"), F.lit("C")), S.convert_unit(F.lit(1.0), F.lit("mol/L"), F.lit("g/L"))) == (None,) * 3
    heads = ["glucose_g_L", "temp_K", "x_mg_mL", "g_L", "vol_mL", "pH", "DO_pct", "a_b"]
    assert one(spark, *[S.header_unit(F.lit(h)) for h in heads]) == ("g/L", "K", "mg/mL", "L", "mL", None, "%", None)
    ranges = [("temperature", 310.0), ("temperature", 37.0), ("glucose", 900.0), ("glucose", 10.0), ("glucose", 0.01), ("ph", 7.0)]
    assert one(spark, *[S.range_unit(F.lit(v), F.lit(m)) for v, m in ranges]) == ("K", "C", "mg/L", "g/L", None, None)
    assert one(spark, *[S.elapsed_unit(F.lit(h)) for h in ("time_min", "t_s", "elapsed_hours", "minutes", "sec", "x")]) == (
        "min", "s", "h", "min", "s", "h")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=20))
def test_conversions_of_finite_values_are_finite(spark, numbers):
    rows = spark.createDataFrame([(float(n),) for n in numbers], "x double")
    cols = [S.convert_unit(F.col("x"), F.lit(a), F.lit(b)) for a, b, sub, *_ in K.UNIT_CONVERSIONS if sub is not None]
    for row in rows.select(*cols).collect():
        assert all(v is not None and abs(v) < float("inf") for v in row)


def test_timestamps(spark):
    texts = ["2026-04-20 08:00:00", "2026-04-20T10:00:00+02:00", "04/20/2026 08:00", "20.04.2026 08:00:00", "20260420 080000"]
    got = one(spark, *[F.unix_micros(S.parse_timestamp(F.lit(t))) for t in texts])
    assert len(set(got)) == 1 and got[0] is not None
    assert one(spark, *[S.parse_timestamp(F.lit(t)) for t in ("12", "7.5", "soon", "")]) == (None,) * 4


# --- workbooks


def make_workbook(sheets, dates=()):
    """Bytes of a small .xlsx file; numbers become numeric cells, text inline strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(
            f"<sheet name='{n}' sheetId='{i}' r:id='rId{i}'/>" for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f"<Relationship Id='rId{i}' Target='worksheets/s{i}.xml'/>" for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/styles.xml", "<styleSheet><cellXfs><xf numFmtId='0'/><xf numFmtId='22'/></cellXfs></styleSheet>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>shared</t></si></sst>")
        for i, n in enumerate(names):
            body = ""
            for r, row in enumerate(sheets[n], 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, datetime):
                        days = (v - datetime(1899, 12, 30)).total_seconds() / 86400
                        cells += f"<c r='{ref}' s='1'><v>{days!r}</v></c>"
                    elif isinstance(v, (int, float)):
                        cells += f"<c r='{ref}'><v>{v!r}</v></c>"
                    elif v == "shared":
                        cells += f"<c r='{ref}' t='s'><v>0</v></c>"
                    else:
                        cells += f"<c r='{ref}' t='inlineStr'><is><t>{v}</t></is></c>"
                body += f"<row r='{r}'>{cells}</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    t0, t1 = datetime(2026, 4, 20, 8, 0), datetime(2026, 4, 20, 8, 30)
    (tmp_path / "multi.xlsx").write_bytes(make_workbook({
        "Info": [["Strain", "CHO-K1"], ["scale_liters", 5], ["pump", "P7"]],
        "Sensors": [["timestamp", "pH", "temp_K"], [t0, 7.0, 310.15], [t1, 7.1, None]],
        "Lab": [["timestamp", "glucose", "method"], [t0, 20.5, "HPLC"]],
        "Notes": [["a", "shared"]],
    }))
    runs = [["time", "OD"], [t0, 0.5], [t1, 0.75]]
    (tmp_path / "runs.xlsx").write_bytes(make_workbook({"R1": runs, "R2": [["Time ", "od"], *runs[1:]]}))
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    path = str(tmp_path)
    rows = workbook.read_workbooks(spark, path)
    assert rows.where("error is not null").count() == 1
    assert [r["fields"] for r in rows.where("sheet = 'Notes'").collect()] == [["a", "shared"]]
    kinds = {r["sheet"]: (r["type"], r["batch_per_sheet"]) for r in workbook.sheet_headers(rows.where("error is null")).collect()}
    assert kinds == {"Info": ("metadata", False), "Sensors": ("telemetry", False), "Lab": ("assay", False),
                     "Notes": ("unknown", False), "R1": ("telemetry", True), "R2": ("telemetry", True)}
    telemetry, assay, metadata = ingest.load_workbooks(spark, path)
    assert sorted(r["name"] for r in telemetry.batches.collect()) == ["multi", "runs-R1", "runs-R2"]
    temp = telemetry.records.where("variable = 'temperature'").collect()
    assert [(r["ts"], round(r["value"], 6)) for r in temp] == [(t0, 37.0)]
    assert telemetry.records.where("variable = 'biomass'").count() == 4
    assert [r["value"] for r in assay.records.collect()] == [20.5]
    m = metadata.first()
    assert m["metadata"] == {"strain": "CHO-K1", "scale_liters": "5", "pump": "P7"}
    assert m["batch_id"] == assay.batches.first()["batch_id"]


def test_broken_workbook_is_a_problem(spark, tmp_path):
    from brewlens.sources.ingest import load_workbooks

    (tmp_path / "broken.XLSX").write_bytes(b"not a workbook")
    telemetry, _, _ = load_workbooks(spark, str(tmp_path))
    found = telemetry.problems.collect()
    assert len(found) == 1 and found[0]["source"].endswith("broken.XLSX") and "unreadable" in found[0]["problem"]


def test_units_are_decided_by_the_whole_column(spark, folder):
    rows = [f"2026-04-20 {8 + i // 60:02d}:{i % 60:02d}:00,{0 if i < 10 else 5000}" for i in range(300)]
    load = ingest.load_delimited(spark, folder(run="timestamp,glucose\n" + "\n".join(rows) + "\n"))
    got = values(load, variable="glucose")
    assert len(got) == 300 and got[-1] == 5.0
    assert load.plan.where("variable = 'glucose'").first()["from_unit"] == "mg/L"


def test_separator_is_decided_by_all_lines(spark, folder):
    rows = [f"2026-01-01 0{i % 10}:00:00;{i},5" for i in range(100)]
    path = folder(semicolon="time;pH\n" + "\n".join(rows) + "\n", comma='time,pH\n2026-01-01 00:00:00,"7;1;2"\n', single="time\n1\n")
    lines = delimited.read_lines(spark, path)
    got = {r["source"].split("/")[-1]: r["sep"] for r in delimited.dialects(lines).collect()}
    assert got == {"semicolon.csv": ";", "comma.csv": ",", "single.csv": ","}


@pytest.mark.parametrize("text", [
    "April 20, 2026 08:00", "20/04/2026 08:00", "4/20/2026 8:00", "2026-04-20 8:00 AM", "20-Apr-26 08:00", "Apr 20 2026 08:00:00",
    "20.04.2026 08:00", "20-Apr-2026 08:00:00", "2026/04/20 08:00", "20260420T080000", "04/20/2026 08:00:00 am", "20 April 2026 8:00",
])
def test_everyday_time_texts(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.unix_micros(S.parse_timestamp(F.col("t"))).alias("us"), S.looks_dated(F.col("t")).alias("dated")).first()
    assert row["us"] == 1_776_672_000_000_000 and row["dated"]


def test_day_order_is_decided_over_the_column(spark, folder):
    load = ingest.load_delimited(spark, folder(
        day="time,pH\n03/04/2026 08:00,7\n20/04/2026 08:00,7.1\n", month="time,pH\n03/04/2026 08:00,7\n04/20/2026 08:00 PM,7.1\n"))
    got = sorted((r["source"].split("/")[-1], r["ts"].month, r["ts"].day, r["ts"].hour) for r in load.records.collect())
    assert got == [("day.csv", 4, 3, 8), ("day.csv", 4, 20, 8), ("month.csv", 3, 4, 8), ("month.csv", 4, 20, 20)]


# --- records ---------------------------------------------------------------------------------------------------------


def plain_records(text, sep):
    import csv
    import io

    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(f.strip() for f in r)]


def read_fields(spark, path):
    records, problems = delimited.read_records(delimited.read_lines(spark, path))
    rows = records.select("source", "block", "pos", delimited.split_line(F.col("line"), F.col("sep")).alias("fields")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["block"], r["pos"])):
        out.setdefault(r["source"].split("/")[-1], []).append(r["fields"])
    return out, {r["source"].split("/")[-1]: r["problem"] for r in problems.collect()}


def messy(seed, n, sep, end):
    r = np.random.default_rng(seed)
    cells = ["plain", "1.5", '5" tube', f'"with{sep} separator"', '"two ""quotes"" in"', '"line' + end + 'break"', '""',
             '"' + end + end + 'several' + end + '"', "", "x" * 30, f'"{sep}"', '"a""' + end + '""b"', "Ċ ਊ ā"]
    lines = [sep.join(["time", "note", "pH", "text"])]
    lines += [sep.join(["2026-01-01 00:00:00", cells[r.integers(0, len(cells))], "7", cells[r.integers(0, len(cells))]]) for _ in range(n)]
    return end.join(lines) + end


@pytest.mark.parametrize("split", [None, 700])
def test_records_across_line_breaks(spark, tmp_path, split):
    kinds = {"comma": (",", "\n"), "semicolon": (";", "\n"), "tab": ("\t", "\r\n")}
    texts = {name: messy(i, 300, *kind) for i, (name, kind) in enumerate(kinds.items())}
    for name, text in texts.items():
        for encoding in ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"):
            mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(encoding, b"")
            (tmp_path / f"{name}{encoding}").write_bytes(mark + text.encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:  # dozens of splits a file; most begin inside a record, many inside a quoted field
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got, problems = read_fields(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert problems == {} and len(got) == 12
    for name, rows in got.items():
        kind = next(k for k in kinds if name.startswith(k))
        assert rows == plain_records(texts[kind], kinds[kind][0]), name


def test_encoding_is_decided_once_per_file(spark, tmp_path):
    (tmp_path / "latin").write_bytes("time,note\n2026-01-01,plain\n2026-01-02,caf\xe9\n2026-01-03,Ã©\n".encode("iso-8859-1"))
    (tmp_path / "utf").write_bytes("time,note\n2026-01-03,Ã©\n".encode())
    (tmp_path / "mac").write_bytes(b"time,note\r2026-01-01,a\r2026-01-02,b\r")
    got, _ = read_fields(spark, str(tmp_path))
    assert [r[1] for r in got["latin"]] == ["note", "plain", "caf\xe9", "Ã©"]
    assert [r[1] for r in got["utf"]] == ["note", "Ã©"]
    assert got["mac"] == [["time", "note"], ["2026-01-01", "a"], ["2026-01-02", "b"]]


def test_a_quote_that_nothing_closes(spark, tmp_path):
    (tmp_path / "open").write_text('time,note\n2026-01-01,"a\nb"\n2026-01-02,"never\n2026-01-03,c\n')
    (tmp_path / "fine").write_text('time,note\n2026-01-01,5" disk\n2026-01-02,c"\n')
    got, problems = read_fields(spark, str(tmp_path))
    assert problems == {"open": "a quote is not closed"}
    assert got["open"][1] == ["2026-01-01", "a\nb"] and got["open"][-1] == ["2026-01-03", "c"] and len(got["open"]) == 4
    assert [r[1] for r in got["fine"]] == ["note", '5" disk', 'c"']


def test_column_sums_are_hashed_and_rows_stay(spark):
    """Cells are not sorted for their sums, and rows meet the plan of a few files without an exchange of their own."""
    long = "block bigint, at bigint, a string, b string"
    rows = spark.createDataFrame([(1, 0, "0.5", "7"), (0, 1 << 40, "x", "8"), (0, 1 << 41, "3", "9"), (None, 5, "", "6")], long).select(
        F.lit("f").alias("source"), ingest.position(F.col("block"), F.col("at")).alias("pos"), F.array("a", "b").alias("fields"))
    found = ingest.column_statistics(rows)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {r["col_no"]: r["first_number"] for r in found.collect()} == {0: 3.0, 1: 6.0}

    heads = spark.createDataFrame([("f", 0, ["time", "pH"])], "source string, rn int, fields array<string>")
    data = spark.range(20).select(
        F.lit("f").alias("source"), F.col("id").alias("pos"),
        F.array(F.concat(F.lit("2026-01-01 00:00:"), F.lpad(F.col("id").cast("string"), 2, "0")), F.lit("7.0")).alias("fields"))
    records, _ = ingest.melt(data.select("source", "fields"), ingest.plan_columns(heads, data), F.lit(None).cast("timestamp"))
    assert "Exchange hashpartitioning" not in records._jdf.queryExecution().executedPlan().toString()
    assert records.agg(F.count("ts"), F.sum("value")).first() == (20, 140.0)


def test_plain_lines_do_not_move(spark, tmp_path):
    """Lines of files in UTF-8 without quotes across lines are neither shuffled nor sorted on their way to records."""
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f'time;note\n1;"x;{name}"\n\n2;y\r\n')
    (tmp_path / "c.csv").write_bytes("time;café\n1;2\n".encode("latin-1"))
    records, problems = delimited.read_records(delimited.read_lines(spark, str(tmp_path)))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    found = sorted((r["source"][-5], r["line"]) for r in records.collect())
    assert found == [
        ("a", '1;"x;a"'), ("a", "2;y"), ("a", "time;note"), ("b", '1;"x;b"'), ("b", "2;y"), ("b", "time;note"),
        ("c", "1;2"), ("c", "time;café"),
    ]
    assert problems.isEmpty() and {r["sep"] for r in records.collect()} == {";"}


def test_lines_of_records_with_breaks_do_not_move(spark, tmp_path):
    """Lines of files in UTF-16 or with quotes across lines are neither shuffled nor sorted on their way to records."""
    text = "time,note,pH\n" + "".join(f'2026-01-01 00:00:{i:02d},"order {i}\n\nsaid ""ok"", {i}\n",7.{i}\n' for i in range(60))
    (tmp_path / "narrow").write_text(text)
    (tmp_path / "little").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    (tmp_path / "big").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    (tmp_path / "long").write_text('time,note\n1,"' + "a,b\n" * 300 + '"\n2,c\n')
    (tmp_path / "open").write_text('time,note\n1,"a\nb"\n2,"never\n' + "3,c\n" * 300)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        records, problems = delimited.read_records(delimited.read_lines(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().executedPlan().toString()
        rows = records.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    found = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["block"], r["pos"])):
        found.setdefault(r["source"].split("/")[-1], []).append(r["line"])
    expected = ["time,note,pH", *(f'2026-01-01 00:00:{i:02d},"order {i}\n\nsaid ""ok"", {i}\n",7.{i}' for i in range(60))]
    assert found["narrow"] == found["little"] == found["big"] == expected
    assert found["long"] == ["time,note", '1,"' + "a,b\n" * 300 + '"', "2,c"]
    assert found["open"] == ["time,note", '1,"a\nb"', '2,"never', *["3,c"] * 300]
    assert [(r["source"].split("/")[-1], r["problem"]) for r in problems.collect()] == [("open", "a quote is not closed")]
    assert len({(r["source"], r["block"], r["pos"]) for r in rows}) == len(rows)
