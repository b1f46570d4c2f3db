"""CSV reader: encoding ladder, clean headers, missing tokens, typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import column, parse_number
from ..operators.dataset import ARRIVAL, Dataset
from ..vocab import MISSING_TOKENS
from .records import csv_records

# What the bytes 0x80-0x9F mean in Windows-1252. The bytes 81, 8D,
# 8F, 90 and 9D are undefined there.
_CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_UNDEFINED_CP1252 = "^(?:..)*(?:81|8D|8F|90|9D)"
#: Columns typed in one pass over the file.
PASS_COLUMNS = 75
_BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def validate_csv_filename(filename: str | None) -> str:
    cleaned = str(filename or "").strip()
    if not cleaned.lower().endswith(".csv"):
        raise ValueError("Please upload a CSV file.")
    return cleaned


def detect_layout(spark: SparkSession, path: str) -> tuple[str, bool, bool]:
    """Encoding, whether quoted fields may span lines, and whether line feeds end all lines, from one splittable scan.

    Lines arrive as raw bytes, so validity is tested before anything is decoded.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    raw = F.col("value")
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))
    seen = lines.agg(
        F.count_if(~F.is_valid_utf8(raw)).alias("invalid"),
        F.count_if(F.hex(raw.cast("binary")).rlike(_UNDEFINED_CP1252)).alias("undefined"),
        F.count_if(quotes % 2 == 1).alias("open_quotes"),
        F.count_if(raw.rlike("\r(?!$)")).alias("bare_returns"),
    ).first()
    encoding = "utf-8-sig" if seen.invalid == 0 else "cp1252" if seen.undefined == 0 else "latin-1"
    return encoding, seen.open_quotes > 0, seen.bare_returns == 0


def clean_headers(names: list[str | None]) -> list[str]:
    """Trimmed names; blanks become ``Unnamed: i``, repeats ``x.1``, ``x.2`` ..."""
    out: list[str] = []
    taken = set()
    repeats: dict[str, int] = {}
    for i, raw in enumerate(names):
        base = (raw or "").lstrip("﻿").strip() or f"Unnamed: {i}"
        name = base
        while name in taken:
            repeats[base] = repeats.get(base, 0) + 1
            name = f"{base}.{repeats[base]}"
        taken.add(name)
        out.append(name)
    return out


def _decode(value: Column, encoding: str) -> Column:
    return F.translate(value, _CP1252_BYTES, _CP1252_TEXT) if encoding == "cp1252" else value


def infer_types(raw: DataFrame) -> DataFrame:
    """Give every text column the narrowest type all its values fit."""
    names = [n for n in raw.columns if n != ARRIVAL]
    out = [F.col(ARRIVAL)] if ARRIVAL in raw.columns else []
    for start in range(0, len(names), PASS_COLUMNS):
        chunk = names[start : start + PASS_COLUMNS]
        aggs = []
        for i, n in enumerate(chunk):
            v = column(n)
            number = parse_number(v)
            whole = F.trim(v).rlike(r"^[+-]?[0-9]+$") & F.trim(v).try_cast("long").isNotNull()
            aggs += [
                F.count(v).alias(f"n{i}"), F.count_if(whole).alias(f"l{i}"), F.count(number).alias(f"d{i}"),
                F.count_if(v.isin(_BOOLEANS)).alias(f"b{i}"),
            ]
        row = raw.agg(*aggs).first()
        for i, n in enumerate(chunk):
            v, present = column(n), row[f"n{i}"]
            if present and row[f"l{i}"] == present:
                v = F.trim(v).try_cast("long")
            elif present and row[f"d{i}"] == present:
                v = parse_number(v)
            elif present and row[f"b{i}"] == present:
                v = F.lower(v).try_cast("boolean")
            out.append(v.alias(n))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, name: str | None = None, order_by: list[str] | None = None, **options) -> Dataset:
    """Read CSV with a header line. Files split over tasks, also where quoted
    fields contain line breaks; only where carriage returns stand inside lines
    (or end them, as on old Macs; they become line feeds in fields then) is a
    file read by one task. Rows with more
    fields than the header are an error; rows with fewer are filled with missing
    values."""
    validate_csv_filename(path)
    encoding, spans_lines, line_feeds = detect_layout(spark, path)
    charset = "UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1"
    parsing = {"quote": '"', "escape": '"', "multiLine": str(spans_lines or not line_feeds).lower(), "maxCharsPerColumn": "-1"}
    reader = spark.read.options(encoding=charset, **parsing)
    first = reader.csv(path, header=False).limit(1).first()
    if first is None:
        raise ValueError("Unable to read CSV file: it is empty.")
    # one column more than the header has catches rows that are too long
    schema = ", ".join(f"c{i} string" for i in range(len(first) + 1))
    if spans_lines and line_feeds:
        parsed = F.from_csv("record", schema, {**parsing, "lineSep": "\n"}).alias("row")
        body = csv_records(spark, path, charset).where("not is_first").select(parsed, ARRIVAL).select("row.*", ARRIVAL)
    else:
        body = reader.csv(path, header=True, enforceSchema=True, schema=schema)
    long = body.where(F.col(f"c{len(first)}").isNotNull()).count()
    if long:
        raise ValueError(f"Unable to read CSV file: {long} rows have more fields than the header.")
    names = clean_headers([spark.range(1).select(_decode(F.lit(v), encoding)).first()[0] if encoding == "cp1252" and v else v for v in first])
    cells = []
    for i, n in enumerate(names):
        v = _decode(F.col(f"c{i}"), encoding)
        cells.append(F.when(~v.isin(MISSING_TOKENS), v).alias(n))
    if ARRIVAL in body.columns:
        cells.append(F.col(ARRIVAL))
    ds = Dataset(infer_types(body.select(*cells)), name or path.rstrip("/").rsplit("/", 1)[-1], order_by, encoding=encoding, **options)
    ds.source = ds.source.drop(ARRIVAL)  # the rows keep it
    return ds
