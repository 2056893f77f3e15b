"""Summary CSV lines and files, parsed by a recursive-descent grammar that recovers from errors.

    record   := field ("," field)* end
    field    := quoted | bare
    quoted   := '"' ([^"] | '""')* '"'  before "," or the end
    geometry := ("POLYGON" | "MULTIPOLYGON") ["Z"] ("EMPTY" | polygon | "(" polygon ("," polygon)* ")")
    polygon  := "(" ring ("," ring)* ")"
    ring     := "(" position ("," position)* ")"   four or more, the last equal to the first
    position := number number [number]             finite

A line's first failing rule gives its reason: quoting, column_count or value. In whole files a
broken quote ends at the next validated record start: a line that begins like a record and
parses as one with the header's number of columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch
from functools import lru_cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrasieve.sources.files import filesystem

GEOMETRY_COLUMNS = ("PolygonWKT_Geo", "PolygonWKT_Pix", "PolygonWKT")

_NUM = r"[+-]?(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"
_POS = rf"{_NUM}\s++{_NUM}(?:\s++{_NUM})?"
_RING = re.compile(rf"\s*+\(\s*+({_POS}(?:\s*+,\s*+{_POS})*+)\s*+\)\s*+", re.ASCII)
_HEAD = re.compile(r"\s*(MULTIPOLYGON|POLYGON)(?:\s*Z(?![A-Za-z]))?\s*", re.I)
_EMPTY = re.compile(r"EMPTY\s*", re.I)
_OPEN, _CLOSE, _COMMA = (re.compile(rf"\s*{x}\s*") for x in (r"\(", r"\)", ","))
_QUOTED = re.compile(r'"((?:[^"]|"")*+)"')
_BARE = re.compile(r'[^,"]*')
_BARE_LINE = re.compile(r'[^,"\r\n]*')
_BREAK = re.compile(r"\r\n|\n|\r")
_INTEGER = re.compile(r"-?[0-9]+")
_DECIMAL = re.compile(_NUM, re.ASCII)
_ANCHOR = re.compile(r'(?:"(?:[^"\n]|"")*"|[^",\n]+),"?-?\d+"?,', re.ASCII)


class Fault(Exception):
    """A syntax error: reason, offset in the parsed text, detail."""

    def __init__(self, reason: str, at: int, detail: str):
        super().__init__(reason, at, detail)
        self.reason, self.at, self.detail = reason, at, detail


def parse_record(text: str, at: int = 0, multiline: bool = False, end: int | None = None) -> tuple[list[tuple[str, int]], int]:
    """The fields (value, offset) from at, up to end, and the offset after them; Fault('quoting') if quotes break."""
    fields, size = [], len(text) if end is None else end
    bare = _BARE_LINE if multiline else _BARE
    while True:
        if text.startswith('"', at, size):
            m = _QUOTED.match(text, at, size)
            if not m:
                raise Fault("quoting", at, "quote isn't closed")
            stop = m.end()
            if stop < size and text[stop] != "," and not (multiline and text[stop] in "\r\n"):
                raise Fault("quoting", stop, "text after a closing quote")
            fields.append((m[1].replace('""', '"'), at + 1))
        else:
            m = bare.match(text, at, size)
            stop = m.end()
            if stop < size and text[stop] == '"':
                raise Fault("quoting", stop, "quote inside an unquoted field")
            fields.append((m[0], at))
        if stop < size and text[stop] == ",":
            at = stop + 1
        else:
            return fields, stop


def _ring(text: str, at: int) -> int:
    m = _RING.match(text, at)
    if not m:
        raise Fault("value", at, "not a ring of positions of two or three numbers")
    positions = m[1].split(",")
    if len(positions) < 4:
        raise Fault("value", m.start(1), "ring of fewer than four positions")
    first, last = positions[0].split(), positions[-1].split()
    if first != last and [*map(float, first)] != [*map(float, last)]:
        raise Fault("value", m.start(1), "ring isn't closed")
    if ("e" in m[1] or "E" in m[1] or len(m[1]) > 300) and not all(math.isfinite(float(x)) for p in positions for x in p.split()):
        raise Fault("value", m.start(1), "number isn't finite")
    return m.end()


def _list(text: str, at: int, item) -> int:
    m = _OPEN.match(text, at)
    if not m:
        raise Fault("value", at, "opening parenthesis expected")
    at = item(text, m.end())
    while m := _COMMA.match(text, at):
        at = item(text, m.end())
    m = _CLOSE.match(text, at)
    if not m:
        raise Fault("value", at, "closing parenthesis expected")
    return m.end()


def _polygon(text: str, at: int) -> int:
    return _list(text, at, _ring)


def parse_geometry(text: str) -> str:
    """The kind, POLYGON or MULTIPOLYGON; Fault('value') at the offset where the grammar fails."""
    m = _HEAD.match(text)
    if not m:
        raise Fault("value", 0, "neither POLYGON nor MULTIPOLYGON")
    kind = m[1].upper()
    if e := _EMPTY.match(text, m.end()):
        at = e.end()
    else:
        at = _polygon(text, m.end()) if kind == "POLYGON" else _list(text, m.end(), _polygon)
    if at != len(text):
        raise Fault("value", at, "text after the geometry")
    return kind


def check_fields(fields: list[tuple[str, int]], header: list[str]) -> dict:
    """The typed record; Fault if the columns' number or a value is wrong."""
    if len(fields) != len(header):
        raise Fault("column_count", fields[-1][1], f"{len(fields)} columns, the header has {len(header)}")
    out = {"image_id": None, "building_id": None, "confidence": None, "geometries": {}, "others": {}}
    for name, (value, at) in zip(header, fields):
        if name == "ImageId":
            if not value:
                raise Fault("value", at, "ImageId is empty")
            out["image_id"] = value
        elif name == "BuildingId":
            if not _INTEGER.fullmatch(value):
                raise Fault("value", at, "BuildingId isn't an integer")
            number = int(value) if len(value) < 20 else None
            if number is not None and -(2**63) <= number < 2**63:
                out["building_id"] = number
            else:
                out["others"][name] = value
        elif name == "Confidence":
            if not _DECIMAL.fullmatch(value) or not math.isfinite(float(value)):
                raise Fault("value", at, "Confidence isn't a finite decimal number")
            out["confidence"] = float(value)
        elif name in GEOMETRY_COLUMNS:
            try:
                parse_geometry(value)
            except Fault as f:
                raise Fault("value", at + f.at, f"{name}: {f.detail}") from None
            out["geometries"][name] = value
        else:
            out["others"][name] = value
    return out


def header_columns(line: str | None) -> list[str]:
    try:
        return [name for name, _ in parse_record(line or "")[0]]
    except Fault:
        return [x.strip('"') for x in (line or "").split(",")]


#: A piece of a text: where it starts and ends, its record or its fault.
Piece = tuple[int, int, dict | None, Fault | None]


def recover(text: str, header: list[str], at: int = 0, starts: list[tuple[int, int]] | None = None) -> Iterator[Piece]:
    """All records of a text, each parsed or with its fault; after a fault parsing resumes at the next validated record start.

    starts: (start, end) of each record where they are known, as for lines that come one by one;
    each is validated by that. Else records begin at lines; quoted fields may hold line breaks,
    and after a broken quote a line counts as a record's start if it begins like one and parses
    with the header's number of columns. The text that is skipped belongs to the fault's piece.
    """
    if starts is not None:
        for start, end in starts:
            try:
                yield start, end, check_fields(parse_record(text, start, end=end)[0], header), None
            except Fault as f:
                yield start, end, None, f
        return
    lines = [at, *(m.end() for m in _BREAK.finditer(text, at))]
    if lines[-1] == len(text):
        lines.pop()
    ends = [*lines[1:], len(text)]
    i = 0
    while i < len(lines):
        record = fault = None
        follow = i + 1
        try:
            fields, end = parse_record(text, lines[i], True)
            while follow < len(lines) and lines[follow] <= end:
                follow += 1
            record = check_fields(fields, header)
        except Fault as f:
            fault = f
            if f.reason == "quoting":
                follow = i + 1
                if text.count('"', lines[i], ends[i]) % 2:  # else the line's quotes are balanced and its fault can't reach into the next
                    while follow < len(lines) and not starts_record(text, lines[follow], header):
                        follow += 1
        yield lines[i], ends[follow - 1], record, fault
        i = follow


def starts_record(text: str, at: int, header: list[str]) -> bool:
    """Whether the line at this offset is a validated record start."""
    if not _ANCHOR.match(text, at):
        return False
    try:
        return len(parse_record(text, at, True)[0]) == len(header)
    except Fault:
        return False


def parse_file(text: str) -> Iterator[dict]:
    """Records and errors of a whole file, its first line the header: dicts of line_no, text, record (or None) and fault (or None)."""
    first = _BREAK.search(text)
    header = header_columns(text[: first.start()] if first else text)
    at = line = first.end() if first else len(text)
    number = 2
    for start, end, record, fault in recover(text, header, at) if text else ():
        number += len(_BREAK.findall(text, line, start))
        line = start
        yield {"line_no": number, "text": text[start:end].rstrip("\r\n"), "record": record, "fault": fault}


SCHEMA = "image_id string, building_id bigint, confidence double, geometries map<string,string>, others map<string,string>, reason string, error_at int, error_detail string"


def _values(start: int, record: dict | None, fault: Fault | None) -> tuple:
    """The columns of SCHEMA; offsets count from the record's start."""
    if record is not None:
        return record["image_id"], record["building_id"], record["confidence"], record["geometries"], record["others"], None, None, None
    return None, None, None, None, None, fault.reason, fault.at - start, fault.detail


_COLUMNS = ["image_id", "building_id", "confidence", "geometries", "others", "reason", "error_at", "error_detail"]


def _classify(batches: Iterable[pd.DataFrame], id_col: str) -> Iterator[pd.DataFrame]:
    columns = lru_cache(maxsize=1024)(header_columns)
    for batch in batches:
        by_header: dict[str | None, list[int]] = {}
        for k, head in enumerate(batch["_header"]):
            by_header.setdefault(head, []).append(k)
        lines, rows = batch["_line"].tolist(), [()] * len(batch)
        for head, mine in by_header.items():
            starts, at = [], 0
            for k in mine:
                starts.append((at, at + len(lines[k] or "")))
                at = starts[-1][1] + 1
            text = "\n".join(lines[k] or "" for k in mine)
            for k, (start, _, record, fault) in zip(mine, recover(text, columns(head), starts=starts)):
                rows[k] = _values(start, record, fault)
        out = pd.DataFrame(rows, columns=_COLUMNS)
        out.insert(0, id_col, batch[id_col].to_numpy())
        yield out.astype({"building_id": "Int64", "error_at": "Int64"})


def load_lines(df: DataFrame, id_col: str, header_col: str, line_col: str) -> DataFrame:
    """One row a line: id, the typed record, or reason, error_at (offset in the line) and error_detail.

    The lines of a batch are one text of which every record start is known, so that a broken quote
    ends with its line. reason is null for valid lines, else quoting, column_count or value (the first that holds).
    A null line counts as an empty one, a null header as one with a single nameless column.
    Columns of unknown names aren't checked and come out in others, as do BuildingIds beyond
    BIGINT, which are valid. Repeated lines come out repeatedly; an empty table gives an empty one. Map-only.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.col(header_col).alias("_header"), F.col(line_col).alias("_line"))
    return rows.mapInPandas(lambda it: _classify(it, id_col), f"`{id_col}` {id_type}, {SCHEMA}")


def load_files(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """load_lines for small whole files (name, text): one row a record or fault, with line_no and the text it covers."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch[name_col], batch[text_col]):
                rows = [(name, x["line_no"], x["text"], *_values(0, x["record"], x["fault"])) for x in parse_file(text or "")]
                out = pd.DataFrame(rows, columns=["file_name", "line_no", "line_text", *_COLUMNS])
                yield out.astype({"line_no": "Int64", "building_id": "Int64", "error_at": "Int64"})

    return df.select(name_col, text_col).mapInPandas(run, f"file_name string, line_no int, line_text string, {SCHEMA}")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class SummaryFiles(DataSource):
    """spark.read.format("summary_csv").load(folder or file): summary CSV files of any size, split at validated record starts.

    Rows are (file_name, split_at, record_no, line_text) and those of SCHEMA: every record or
    fault of the files, record_no counting within the split. Option split_bytes (32 MB): a range
    of that size goes to one task. A range's records are those that start from its first
    validated record start on up to that of the next range, so that neighbours agree without
    talking to each other and nothing is lost or read twice, also where a broken quote spans the border. Option glob: names to be read.
    """

    @classmethod
    def name(cls) -> str:
        return "summary_csv"

    def schema(self) -> str:
        return f"file_name string, split_at bigint, record_no int, line_text string, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _SummaryReader(self.options)


class _SummaryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.glob = options["path"], int(options.get("split_bytes", 32 << 20)), options.get("glob", "*.csv")

    def partitions(self):
        files, path = filesystem(self.path)
        info = files.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob)]
        return [_Range(f.path, at, min(f.size, at + self.size)) for f in found for at in range(0, f.size, self.size)]

    def read(self, part: _Range):
        files, _ = filesystem(self.path)
        with files.open_input_file(part.path) as f:
            size = f.size()
            head = _line(f, 0, size)
            header, body = header_columns(head.decode(errors="replace").rstrip("\r\n")), len(head)
            start, stop = (_first_record(f, max(at, body), body, size, header) for at in (part.start, part.stop))
            text = f.read_at(stop - start, start).decode(errors="replace")
        for number, (a, b, record, fault) in enumerate(recover(text, header)):
            yield (part.path.rpartition("/")[2], part.start, number, text[a:b].rstrip("\r\n"), *_values(a, record, fault))


def _line(f, at: int, size: int) -> bytes:
    """The line from an offset on, with its line break."""
    out = b""
    while at < size and b"\n" not in out:
        piece = f.read_at(min(1 << 16, size - at), at)
        out, at = out + piece, at + len(piece)
    return out[: out.find(b"\n") + 1] or out


def _first_record(f, at: int, body: int, size: int, header: list[str], look: int = 1 << 16) -> int:
    """Offset of the first validated record start from at on; body, where records begin, is one, and so is the end."""
    if at <= body or at >= size:
        return min(max(at, body), size)
    at += len(_line(f, at - 1, size)) - 1  # the first line that starts at or after at
    while at < size:
        ahead = f.read_at(min(look, size - at), at)
        text, complete = ahead.decode("latin-1"), at + len(ahead) == size
        line = 0
        while 0 <= line < len(text):
            if starts_record(text, line, header) and (complete or text.find("\n", line) >= 0):
                return at + line
            following = text.find("\n", line) + 1
            if not following:
                break
            line = following
        if line == 0:  # a line longer than what was read
            line = len(_line(f, at, size))
        at += line
    return size
