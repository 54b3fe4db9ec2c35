"""Readers: files with sniffed form and coerced types, guarded paths, samples."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S

FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "ndjson", ".ndjson": "ndjson", ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel"}
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
COERCE_SHARE = 0.95
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
_C1 = "".join(map(chr, range(0x80, 0xA0)))


class SourceError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class LoadReport:
    format: str
    encoding: str | None = None
    delimiter: str | None = None
    coerced: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def resolve(path: str, roots: Sequence[str] = ()) -> Path:
    """The real path, if it is inside one of the roots (any place if there are none)."""
    real = Path(path).expanduser().resolve()
    if roots and not any(real.is_relative_to(Path(r).expanduser().resolve()) for r in roots):
        raise SourceError("PATH_NOT_ALLOWED", "the path is outside the allowed folders")
    if not real.exists():
        raise SourceError("SOURCE_NOT_FOUND", f"no such file: {path}")
    return real


def detect_format(path: str) -> str:
    try:
        return FORMATS[Path(path).suffix.lower()]
    except KeyError:
        raise SourceError("UNSUPPORTED_FORMAT", f"files of this kind are not read: {Path(path).suffix or path}") from None


def detect_encoding(path: Path, size: int = 200_000) -> str:
    head = path.open("rb").read(size)
    for name in ENCODINGS:
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4 or len(head) < size:
                continue
        return "utf-8-sig" if name == "utf-8" and head.startswith(b"\xef\xbb\xbf") else name
    return "latin-1"


def detect_delimiter(path: Path, encoding: str, size: int = 65_536) -> str:
    try:
        return csv.Sniffer().sniff(path.open("rb").read(size).decode(encoding, "ignore"), ",;\t|").delimiter
    except csv.Error:
        return ","


def load(spark: SparkSession, path: str, *, roots: Sequence[str] = (), limit: int | None = None, options: dict | None = None, coerce: bool = True) -> tuple[DataFrame, LoadReport]:
    """A file as a frame: csv, tsv, txt, parquet, json (an array) and ndjson; texts that are numbers or dates get their types."""
    real, options = resolve(path, roots), options or {}
    kind = options.get("format") or detect_format(str(real))
    report = LoadReport(kind)
    if kind == "excel":
        raise SourceError("DEPENDENCY_MISSING", "reading Excel files needs a package that is not installed; save the sheet as CSV")
    if kind in ("csv", "tsv"):
        report.encoding = options.get("encoding") or detect_encoding(real)
        report.delimiter = options.get("delimiter") or ("\t" if kind == "tsv" else detect_delimiter(real, report.encoding))
        encoding = {"utf-8-sig": "utf-8", "cp1252": "iso-8859-1", "latin-1": "iso-8859-1"}.get(report.encoding, report.encoding)
        df = spark.read.csv(str(real), header=True, sep=report.delimiter, encoding=encoding, quote='"', escape='"', multiLine=True, inferSchema=False)
        if report.encoding == "cp1252":  # read as its neighbour, which differs in these characters only
            df = df.select(*[F.translate(F.col(f"`{c}`"), _C1, _CP1252).alias(c.translate(str.maketrans(_C1, _CP1252))) for c in df.columns])
        df = df.select(*[F.when(~F.col(f"`{c}`").isin(*S.NA_VALUES), F.col(f"`{c}`")).alias(c) for c in df.columns])
    elif kind == "parquet":
        df = spark.read.parquet(str(real))
    else:
        df = spark.read.json(str(real), multiLine=kind == "json")
    if limit is not None:
        df = df.limit(limit)
        report.notes.append(f"only the first {limit} rows were read")
    df = S.normalise_missing(df)
    return coerce_types(df, report) if coerce and kind != "parquet" else (df, report)


def coerce_types(df: DataFrame, report: LoadReport | None = None) -> tuple[DataFrame, LoadReport]:
    """Text columns of which 95 per cent read as numbers, numbers with commas, or dates become those; one pass decides all."""
    report = report or LoadReport("frame")
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not texts:
        return df, report
    readers = {"numeric": S.parse_number, "numeric (commas removed)": S.parse_number_with_commas, "datetime": S.parse_date}
    c = lambda name: F.col(f"`{name}`")
    sums = [x for i, t in enumerate(texts) for x in (F.count(c(t)).alias(f"n{i}"), *[F.count(f(c(t))).alias(f"{k}{i}") for k, f in enumerate(readers.values())])]
    r = df.agg(*sums).first()
    chosen = {}
    for i, t in enumerate(texts):
        for k, name in enumerate(readers):
            if r[f"n{i}"] and r[f"{k}{i}"] >= COERCE_SHARE * r[f"n{i}"]:
                chosen[t] = name
                break
    report.coerced |= chosen
    return df.select(*[readers[chosen[x]](c(x)).alias(x) if x in chosen else c(x) for x in df.columns]), report


def hash_sample(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Rows whose key hashes below the share: repeatable, and the same under any partitioning."""
    return df.where(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
