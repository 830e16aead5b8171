"""Spreadsheet workbooks (.xlsx) as rows of text, many files at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens import constants as K

ROWS = "file string, sheet string, sheet_no int, rn int, fields array<string>, error string"
_BUILTIN_DATES = set(range(14, 23)) | set(range(45, 48))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str):
    return (c for c in node.iter() if _local(c.tag) == name)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        for f in _children(root, "numFmt")
    }
    dated = {i for i, code in custom.items() if re.search(r"[ymdhs]", code, re.IGNORECASE)}
    styles = set()
    for block in _children(root, "cellXfs"):
        for n, xf in enumerate(block):
            number = int(xf.get("numFmtId", "0"))
            if number in dated or (number in _BUILTIN_DATES and number not in custom):
                styles.add(n)
    return styles


def _text(cell, shared: list[str], dates: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _children(cell, "t"))
    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind != "n":
        return value
    number = float(value) if re.search(r"[.eE]", value) else int(value)
    if int(cell.get("s", "0")) in dates:
        # serial days since 1899-12-30; rounded to whole microseconds
        moment = datetime(1899, 12, 30) + timedelta(microseconds=round(float(number) * 86_400) * 1_000_000)
        return str(moment)
    return str(number)


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, sheet number, row number, texts) of one workbook; empty cells are empty text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in _children(si, "t")) for si in _children(root, "si")]
        dates = _date_styles(archive)
        links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in links}
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        for number, sheet in enumerate(_children(book, "sheet")):
            rel = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = targets[rel].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            rn = 0
            for _, node in ElementTree.iterparse(io.BytesIO(archive.read(part))):
                if _local(node.tag) != "row":
                    continue
                texts: list[str] = []
                for at, cell in enumerate(c for c in node if _local(c.tag) == "c"):
                    col = _column(cell.get("r")) if cell.get("r") else at
                    texts += [""] * (col - len(texts))
                    texts.append(_text(cell, shared, dates))
                yield sheet.get("name"), number, rn, texts
                rn += 1
                node.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every sheet below ``path``; a broken file gives one error row and nothing else.

    A file is parsed once to its end before any of its rows is given out, so none is read by half.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.[xX][lL][sS][xXmM]"
    ).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "sheet", "sheet_no", "rn", "fields", "error"]
        for rows in batches:
            for file, content in zip(rows["path"], rows["content"], strict=True):
                out: list[tuple] = []
                try:
                    for _ in sheet_rows(bytes(content)):
                        pass
                    for sheet, number, rn, texts in sheet_rows(bytes(content)):
                        out.append((file, sheet, number, rn, texts, None))
                        if len(out) == 5_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration) as exc:
                    out = [(file, None, None, None, None, f"unreadable workbook: {exc}")]
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return files.select("path", "content").mapInPandas(parse, ROWS)


# --- sheet classification ------------------------------------------------------------------------------------


def normalised(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(F.trim(h)))


def sheet_type(name: Column, headers: Column) -> Column:
    """metadata > assay > telemetry > unknown."""
    lower = normalised(headers)
    timed = F.arrays_overlap(lower, F.array(*[F.lit(n) for n in K.TIMESTAMP_NAMES]))
    assayed = F.arrays_overlap(lower, F.array(*[F.lit(n) for n in K.ASSAY_HEADERS]))
    return (
        F.when(F.lower(F.trim(name)).isin(*K.METADATA_SHEETS), "metadata")
        .when(assayed & timed, "assay")
        .when(timed, "telemetry")
        .when(F.contains(F.lower(name), F.lit("assay")), "assay")
        .otherwise("unknown")
    )


def sheet_headers(rows: DataFrame) -> DataFrame:
    """(file, sheet, sheet_no, headers, type, batch_per_sheet) per sheet that has rows.

    A workbook with two or more sheets whose normalised headers are all equal holds one run per sheet.
    """
    first = rows.where("rn = 0").select("file", "sheet", "sheet_no", F.col("fields").alias("headers"))
    per_file = first.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.array_join(normalised(F.col("headers")), "\u001f")).alias("k")
    )
    return first.join(per_file, "file").select(
        "file", "sheet", "sheet_no", "headers", sheet_type(F.col("sheet"), F.col("headers")).alias("type"),
        ((F.col("n") >= 2) & (F.col("k") == 1)).alias("batch_per_sheet"),
    )


def metadata_maps(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(file, metadata map) from the key/value rows of metadata sheets."""
    chosen = rows.join(sheets.where("type = 'metadata'").select("file", "sheet"), ["file", "sheet"])
    key = F.lower(F.trim(F.get("fields", F.lit(0))))
    value = F.trim(F.get("fields", F.lit(1)))
    pairs = chosen.where(F.size("fields") >= 2).select("file", "sheet_no", "rn", key.alias("k"), value.alias("v"))
    last = pairs.where("k <> ''").groupBy("file", "k").agg(F.max_by("v", F.struct("sheet_no", "rn")).alias("v"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
