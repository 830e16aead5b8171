"""Folders of delimited text files with differing headers, separators and encodings.

Files are cut once into pieces of many whole lines, and what follows works on pieces: what a piece does to "inside a
quoted field" is a few numbers, which are carried along each file; only records that cross pieces are exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brewlens.session import kept, ship_package

SEPARATORS = ",;\t|"


ORDER = ["block", "pos"]
#: Bytes from which on a piece of a file is cut.
PIECE = 1 << 20
#: First bytes of a file by which its encoding is known, in hex.
MARKS = {"FFFE": "utf-16le", "FEFF": "utf-16be", "EFBBBF": "utf-8"}
PIECES = "file bigint, block bigint, pos bigint, at bigint, bytes binary, size bigint, lines bigint, valid boolean, head binary, last binary"


# --- lines ------------------------------------------------------------------------------------------------------


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows are of one split of a file; rows of a split follow each other."""
    n, file, block = len(batch), batch.column("file").to_numpy(), batch.column("block").to_numpy()
    if n and file[0] == file[-1] and block[0] == block[-1]:
        yield batch
    elif n:
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), n]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def _joined(lines: pa.Array) -> bytes:
    whole = type(pa.nulls(0, pa.list_(lines.type))).from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
    return pc.binary_join(whole, pa.scalar(b"\n", lines.type))[0].as_py()


def _cut(lines: pa.Array, data: bytes) -> int:
    """Lines after which a piece may end (0: none): if bytes 00 occur, where a line of UTF-16 seems to end."""
    if b"\0" not in data:
        return len(lines)
    return next((i for i in range(len(lines) - 1, 0, -1)
                 if lines[i].as_py().startswith(b"\0") or lines[i - 1].as_py().endswith(b"\0")), 0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES from (file, block, bytes) lines cut at each byte 0A, in the order of the files.

    ``pos`` differs for all pieces. ``at`` grows along a file: it is the first byte of the split and what came since then.
    A split's first line begins behind the split's first byte (but for a file's first), and its last within it or with the next.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, PIECES.split(", "))])
    rows: list[tuple] = []
    key, parts, lines, at, pos = None, [], 0, 0, TaskContext.get().partitionId() << 33

    def put() -> None:
        nonlocal parts, lines, at, pos
        data = b"\n".join(parts)
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        rows.append((*key, pos, at, data, len(data), lines, valid, data[:3], data[-1:]))
        pos, at, parts, lines = pos + lines, at + len(data) + 1, [], 0

    def put_out() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for run in _runs(batch):
            own, texts = (run.column("file")[0].as_py(), run.column("block")[0].as_py()), run.column("bytes")
            if own != key:
                if parts:
                    put()
                key, at = own, own[1] + (own[1] > 0)
            parts.append(_joined(texts))
            lines += len(texts)
            if sum(map(len, parts)) >= PIECE and (cut := _cut(texts, parts[-1])):
                rest = len(texts) - cut
                if rest:
                    parts[-1] = _joined(texts[:cut])
                lines -= rest
                put()
                if rest:
                    parts, lines = [_joined(texts[cut:])], rest
        if rows:
            yield put_out()
    if parts:
        put()
        yield put_out()


def _encodings(pieces: DataFrame) -> DataFrame:
    """(source, encoding, lines) decided once per file: by its mark, else UTF-8 if all its lines are, else ISO 8859-1."""
    first = F.hex("head")
    mark = F.coalesce(*[F.when(F.startswith(first, F.lit(m)), F.lit(i)) for i, m in enumerate(MARKS)], F.lit(len(MARKS)))
    # A file's first piece is the first of its first split; numbers only, so that pieces are hashed and not sorted.
    found = pieces.groupBy("source").agg(
        F.min_by(mark, F.when(F.col("block") == 0, F.col("pos"))).alias("mark"), F.bool_and("valid").alias("valid"), F.sum("lines").alias("lines")
    )
    marked = F.coalesce(*[F.when(F.col("mark") == i, F.lit(e)) for i, e in enumerate(MARKS.values())])
    return found.select(
        "source", F.coalesce(marked, F.when(F.col("valid"), "utf-8").otherwise("iso-8859-1")).alias("encoding"), "lines"
    )


def _whole_lines(pieces: DataFrame) -> DataFrame:
    """Pieces of UTF-16 files that begin within a letter or line are put behind the piece before them.

    A byte 0A ends a line if it is the whole of a two-byte unit with 00 for its other byte. Whether it comes first in its
    unit follows from the lengths of all pieces before it.
    """
    wide = F.startswith("encoding", F.lit("utf-16"))
    along = Window.partitionBy("source").orderBy(*ORDER)
    at = F.sum(F.col("size") + 1).over(along) - F.col("size") - 2  # offset of the byte 0A in front of this piece
    before = F.lag("last").over(along)
    ends = F.when(F.col("encoding") == "utf-16le", (at % 2 == 0) & (F.hex(F.substring("head", 1, 1)) == "00")).otherwise(
        (at % 2 == 1) & (F.hex(before) == "00")
    )
    opens = before.isNull() | F.coalesce(ends, F.lit(False))
    numbers = pieces.where(wide).select("source", *ORDER, "size", "encoding", "head", "last").withColumn("opens", opens)
    owned = numbers.withColumn("owner", F.last(F.when(F.col("opens"), F.col("pos")), True).over(along))
    members = kept(owned.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source", "owner"))).where("n > 1").select(
        "pos", "owner"), "members")
    if members.isEmpty():
        return pieces
    marked = pieces.join(members, "pos", "left")
    parts = F.sort_array(F.collect_list(F.struct(*ORDER, "bytes")))
    glued = marked.where("owner IS NOT NULL").groupBy("source", "encoding", "owner").agg(
        parts.alias("parts"), F.min("at").alias("at"), F.sum("lines").alias("lines"))
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "0A"))
    glued = glued.withColumns({"block": F.col("parts")[0]["block"], "pos": F.col("owner"), "bytes": data, "valid": F.lit(False)})
    names = ["source", *ORDER, "at", "bytes", "lines", "valid", "encoding", "single"]
    return _kept_pieces(marked.where("owner IS NULL").select(*names).unionByName(glued.withColumn("single", F.lit(False)).select(*names)), "whole")


def _kept_pieces(pieces: DataFrame, name: str) -> DataFrame:
    """Rows are long: little is read at a time where a file has small groups of rows."""
    return kept(pieces, name, **{"compression": "zstd", "parquet.block.size": 1 << 24})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, pos, bytes, encoding, ...): the lines of every file below ``path``, many in a row.

    Rows are in the order of block and pos; each holds whole lines, and ``_text`` gives them. Encodings are UTF-8,
    UTF-16 (with its mark) and ISO 8859-1. Files are split like any text input, so one very large file is read by many
    tasks; ``block`` is a split's first byte. The pieces are kept below the checkpoint folder, so that all that follows
    sees one state of the files.
    """
    ship_package(spark)
    read = spark.read.option("recursiveFileLookup", "true")
    # A line carries a number for the name of its file; names are looked up for pieces.
    file = F.xxhash64(F.input_file_name()).alias("file")
    text = read.option("lineSep", "\n").text(path)
    raw = text.select(file, F.input_file_block_start().alias("block"), F.col("value").cast("binary").alias("bytes"))
    cut = _kept_pieces(raw.mapInArrow(_pieces, PIECES), "lines")
    names = read.format("binaryFile").load(path).select(file, F.col("_metadata.file_path").alias("source"))
    pieces = cut.join(kept(names, "names"), "file").drop("file")
    # Only files that are not plain UTF-8 of several lines are looked up; where these are few, no piece moves.
    encodings = kept(_encodings(pieces).where("encoding <> 'utf-8' OR lines = 1"), "encodings")
    looked = encodings.select("source", "encoding", (F.col("lines") == 1).alias("single"))
    known = pieces.join(looked, "source", "left").withColumns({
        "encoding": F.coalesce("encoding", F.lit("utf-8")), "single": F.coalesce("single", F.lit(False))})
    if encodings.where(F.startswith("encoding", F.lit("utf-16"))).isEmpty():
        return known
    return _whole_lines(known)


def _text(data: bytes, encoding: str, single: bool, valid: bool) -> bytes:
    """The lines of a piece in UTF-8, a line feed between them; marks are removed."""
    if encoding == "utf-16le":
        # The other half of the line feed in front of the piece lies behind it.
        data = data[2:] if data.startswith(b"\xff\xfe") else data[1:] if len(data) % 2 and data.startswith(b"\0") else data
        return data.decode("utf-16-le").encode()
    if encoding == "utf-16be":
        data = (data[:-1] if len(data) % 2 else data).decode("utf-16-be").encode()
    elif encoding == "iso-8859-1":
        data = data.decode("iso-8859-1").encode()
    elif not valid:
        data = data.decode("utf-8", "replace").encode()
    if b"\xef\xbb\xbf" in data:
        data = re.sub(rb"(?m)^\xef\xbb\xbf", b"", data)
    if single and b"\r" in data and encoding != "utf-16be":  # a file in one line may have carriage returns for line ends
        text = re.sub("\r(?!(?:\r|\u0085|\u2028|\u2029)?\\Z)", "\n", data.decode())
        data = text.encode()
    return data


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The lines of each row of a batch, one after the other."""
    columns = [batch.column(n) for n in ("bytes", "encoding", "single", "valid")]
    for i in range(len(batch)):
        yield _text(*(c[i].as_py() for c in columns))


# --- records ----------------------------------------------------------------------------------------------------


@cache
def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What ends a quoted field, one record with its line feed, and as many as there are.

    A field is quoted if its first letter is a quote; a doubled quote stands for one; quotes within other fields are
    letters.
    """
    body, s = rb'[^"]*+(?:""[^"]*+)*+"', re.escape(sep.encode())
    fields = rb'(?:[^"\n]*+(?:(?<![^' + s + rb'\n])"' + body + rb"|(?<=[^" + s + rb'\n])"))*+[^"\n]*+'
    return re.compile(body), re.compile(rb"(" + fields + rb")\n"), re.compile(rb"(?:" + fields + rb"\n)*+")


def _borders(text: bytes, sep: str) -> tuple[int, int | None, int | None]:
    """(tail, head, tail after head) of lines that each end with a line feed.

    ``tail`` is where the record begins that the text leaves open if it begins outside a quoted field, and its length if
    it leaves none open. If it begins inside one, the record ends at ``head``, null where it does not end.
    """
    if b'"' not in text:
        return len(text), None, None
    body, record, records = _patterns(sep)
    tail = records.match(text).end()
    closed = body.match(text)
    first = record.match(text, closed.end()) if closed else None
    return (tail, first.end(), records.match(text, first.end()).end()) if first else (tail, None, None)


def _opened(known: DataFrame) -> DataFrame:
    """(source, block, pos, size, tail, head, after): where records begin and end in each piece, see ``_borders``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sep, text in zip(batch.column("sep").to_pylist(), _texts(batch)):
                found.append((len(text) + 1, *_borders(text + b"\n", sep)))
            numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("source", *ORDER)), *numbers], names=["source", *ORDER, "size", "tail", "head", "after"])

    schema = "source string, block bigint, pos bigint, size bigint, tail bigint, head bigint, after bigint"
    return known.mapInArrow(look, schema)


def _states(opened: DataFrame) -> DataFrame:
    """Each piece with whether it begins ``inside`` a quoted field, where what it holds of records ``begin`` and ``close``,
    the ``owner`` of what it begins with, and whether its lines are ``loose`` from there on as nothing closes the quote.

    A piece that ends the same way from both states settles what came before; between two such pieces only the
    number of pieces that swap the states matters. Both are carried along each file.
    """
    along = Window.partitionBy("source").orderBy(*ORDER)
    upto, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    acts = opened.withColumns({
        "from_out": F.col("tail") < F.col("size"), "from_in": F.col("head").isNull() | (F.col("after") < F.col("size"))})
    swap = (F.col("from_out") & ~F.col("from_in")).cast("long")
    counted = acts.withColumn("swaps", F.sum(swap).over(along))
    settled = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "swaps")), True).over(upto)
    before = F.col("swaps") - swap - F.coalesce(F.col("settled.swaps"), F.lit(0))
    states = counted.withColumn("settled", settled).withColumn(
        "inside", F.coalesce(F.col("settled.from_out"), F.lit(False)) != (before % 2 == 1))
    states = states.withColumns({
        "begin": F.when(F.col("inside"), F.col("head")).otherwise(F.lit(0)),
        "close": F.when(F.col("inside"), F.col("after")).otherwise(F.col("tail")),
        "open": F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")),
    })
    # The record left open begins in the last piece that does not lie within one record.
    begins = F.when(F.col("begin").isNotNull(), F.col("pos"))
    states = states.withColumns({
        "owner": F.when(F.col("inside"), F.last(begins, True).over(upto)), "final": F.last(begins, True).over(whole),
        "lasting": F.last("open").over(whole),
    })
    at_last = (F.col("pos") == F.col("final")) | (F.col("begin").isNull() & (F.col("owner") == F.col("final")))
    return states.withColumn("loose", F.col("lasting") & at_last).select(
        "source", *ORDER, "size", "inside", "begin", "close", "open", "owner", "loose")


def _crossing(known: DataFrame, states: DataFrame) -> DataFrame:
    """(pos, ending): the records that cross pieces, at the piece in which each begins."""
    tail = F.struct(F.col("pos").alias("owner"), F.col("close").alias("low"), F.col("size").alias("high"))
    head = F.struct(F.col("owner").alias("owner"), F.lit(0).cast("long").alias("low"), F.coalesce("begin", "size").alias("high"))
    has_tail = F.col("open") & F.col("begin").isNotNull() & ~F.col("loose")
    has_head = F.col("inside") & ~(F.col("loose") & F.col("begin").isNull())
    spans = F.filter(F.array(F.when(has_head, head), F.when(has_tail, tail)), lambda x: x.isNotNull())
    wanted = kept(states.select("pos", spans.alias("spans")).where(F.size("spans") > 0), "spans")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys = zip(*(batch.column(n).to_pylist() for n in ("block", "pos", "spans")))
            for (block, pos, spans), text in zip(keys, _texts(batch)):
                rows += [(x["owner"], block, pos, (text + b"\n")[x["low"]:x["high"]]) for x in spans]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", *ORDER, "part"])

    cut = known.join(wanted, "pos").mapInArrow(slices, "owner bigint, block bigint, pos bigint, part binary")
    parts = F.sort_array(F.collect_list(F.struct(*ORDER, F.col("part").cast("string").alias("part"))))
    whole = F.array_join(F.transform(parts, lambda p: p["part"]), "")
    return cut.groupBy("owner").agg(whole.alias("whole")).select(
        F.col("owner").alias("pos"), F.expr("left(whole, length(whole) - 1)").alias("ending"))


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, pos, line, sep) records of pieces; ``pos`` grows along a file."""
    names = ("source", "block", "at", "sep", "inside", "begin", "close", "loose", "ending")
    for batch in batches:
        keys = zip(*(batch.column(n).to_pylist() for n in names))
        for (source, block, at, sep, inside, begin, close, loose, ending), text in zip(keys, _texts(batch)):
            if b'"' not in text and not inside:
                found = text.split(b"\n")
            else:
                text += b"\n"
                begin, close = (begin, close) if inside else (0, len(text) if close is None else close)
                found = [] if begin is None else _patterns(sep)[1].findall(text, begin, close)
                if loose:
                    found += text[close if begin is not None else 0:-1].split(b"\n")
            if ending is not None:
                found.append(ending.encode())
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(source, n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(np.arange(at, at + n)),
                 pa.array(found, pa.binary()).cast(pa.string()), pa.repeat(sep, n)], names=["source", *ORDER, "line", "sep"])


def read_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, block, pos, line, sep) records, (source, problem)) from lines: a record goes on while a quote is open.

    Only what a record holds of further pieces is exchanged. A quote that nothing closes is a problem; its line and
    those behind it stay alone.
    """
    known = lines.join(kept(dialects(lines), "dialects"), "source")
    opened = kept(_opened(known), "opened")
    if opened.where("tail < size").isEmpty():
        states = "false AS inside", "0L AS begin", "CAST(NULL AS BIGINT) AS close", "false AS loose", "CAST(NULL AS STRING) AS ending"
        problems = opened.where("false").select("source", F.lit("a quote is not closed").alias("problem"))
        marked = known.selectExpr("*", *states)
    else:
        states = kept(_states(opened), "states")
        problems = states.where("loose").select("source", F.lit("a quote is not closed").alias("problem")).distinct()
        ending = _crossing(known, states)
        # Most pieces lie between others of their file; their rows are short.
        small = kept(states.select("pos", "inside", "begin", "close", "loose").join(ending, "pos", "left"), "borders")
        marked = known.join(small, "pos")
    return _records(marked.mapInArrow(_cut_records, "source string, block bigint, pos bigint, line string, sep string")), problems


def _records(whole: DataFrame) -> DataFrame:
    """Records without the carriage return at their ends; blank ones are left out."""
    line = F.col("line")
    clean = F.when(F.contains(line, F.lit("\r")), F.regexp_replace(line, "\r$", "")).otherwise(line)
    return whole.withColumn("line", clean).where(F.trim("line") != "")


def head_lines(records: DataFrame, n: int) -> DataFrame:
    """(source, rn, ...): the first ``n`` records per file; the rank limit also applies before the shuffle."""
    order = Window.partitionBy("source").orderBy(*ORDER)
    ranked = records.where("block = 0").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    rest = [c for c in records.columns if c not in ("source", *ORDER)]
    return ranked.select("source", (F.col("rn") - 1).alias("rn"), *rest)


def _separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the lines of pieces: lines, and for each separator the lines that hold it, its number and its squares."""
    for batch in batches:
        found = []
        for text in _texts(batch):
            letters = np.frombuffer(re.sub(rb'"[^"\n]*"', b"", text) if b'"' in text else text, np.uint8)
            ends = np.flatnonzero(letters == 10)
            sums = [len(ends) + 1]
            for sep in SEPARATORS:
                at = np.flatnonzero(letters == ord(sep))
                times = np.bincount(np.searchsorted(ends, at), minlength=1) if len(at) else np.zeros(1, np.int64)
                sums += [int(np.count_nonzero(times)), len(at), int((times * times).sum())]
            found.append(sums)
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(1 + 3 * len(SEPARATORS))]
        yield pa.RecordBatch.from_arrays([batch.column("source"), *columns], names=["source", *_SUMS])


_SUMS = ["lines", *(f"{what}{i}" for i in range(len(SEPARATORS)) for what in ("held", "total", "squares"))]


def dialects(lines: DataFrame) -> DataFrame:
    """(source, sep): the separator of each file from all its lines (comma when it has none).

    Counted outside quotes. The one most lines hold wins, then the one whose number per line varies least, then
    the most frequent.
    """
    counted = lines.mapInArrow(_separators, "source string, " + ", ".join(f"{n} bigint" for n in _SUMS))
    sums = counted.groupBy("source").agg(*[F.sum(n).alias(n) for n in _SUMS])
    n = F.col("lines").cast("double")

    def rated(i: int, sep: str) -> Column:
        total = F.col(f"total{i}").cast("double")
        varies = (n * F.col(f"squares{i}") - total * total) / F.nullif(n * total, F.lit(0.0))  # variance by mean
        return F.struct(
            F.col(f"held{i}").alias("lines"), (-F.coalesce(varies, F.lit(0.0))).alias("steady"), F.col(f"total{i}").alias("total"),
            F.lit(-i).alias("rank"), F.lit(sep).alias("sep"))

    return sums.select("source", F.greatest(*[rated(i, sep) for i, sep in enumerate(SEPARATORS)])["sep"].alias("sep"))


def split_line(line: Column, sep: Column) -> Column:
    """Fields of one record; a quoted field may hold the separator, line breaks and doubled quotes.

    A field is quoted if it begins with a quote (blanks before it do not count); quotes within other fields are letters.
    """
    literal = F.concat(F.lit("\\"), sep)
    body = '[^"]*+(?:""[^"]*+)*+'
    quote = F.lit('"')

    def fields(literal: Column) -> Column:
        field = F.concat(literal, F.lit(f'( *+"{body}"[^'), literal, F.lit("]*+|[^"), literal, F.lit("]*+)"))
        return F.regexp_extract_all(F.concat(sep, line), field, F.lit(1))


    def unquoted(f: Column) -> Column:
        # Mostly a field is quoted as a whole, and all quotes within are doubled; only others are matched.
        inner = F.substr(f, F.lit(2), F.length(f) - 2)
        whole = F.startswith(f, quote) & F.endswith(f, quote) & (F.length(f) > 1)
        doubled = F.replace(inner, F.lit('""'), F.lit(""))
        matched = F.when(
            F.startswith(F.ltrim(f), quote) & f.rlike(f'(?s)^ *+"{body}"'),
            F.concat(
                F.replace(F.regexp_extract(f, f'(?s)^ *+"({body})"', 1), F.lit('""'), quote),
                F.regexp_extract(f, f'(?s)^ *+"{body}"\\s*+(.*)$', 1),
            ),
        ).otherwise(f)
        return F.when(~F.contains(f, quote), f).when(
            whole & ~F.contains(doubled, quote), F.replace(inner, F.lit('""'), quote)).otherwise(matched)

    # A pattern that is known beforehand is not put together for each line.
    found = reduce(lambda rest, s: F.when(sep == s, fields(F.lit("\\" + s))).otherwise(rest), reversed(SEPARATORS), fields(literal))
    quoted = F.transform(found, unquoted)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, literal, -1))
