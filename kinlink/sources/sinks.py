"""Writers: result lists as tab-separated text, Parquet tables, the submission archive."""

from __future__ import annotations

import os
import shutil
import warnings
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lists(rows: DataFrame, path: str, single_file: bool = False, order_by: str | None = None) -> None:
    """Header, then id and comma list; an empty list leaves the line's end blank. Nothing is quoted."""
    key, listed = rows.columns[:2]
    out = rows.select(F.col(key), F.coalesce(F.col(listed), F.lit("")).alias(listed), *([order_by] if order_by and order_by not in rows.columns[:2] else []))
    if single_file:
        out = out.coalesce(1)
    if order_by:
        out = out.sortWithinPartitions(order_by)
    out.select(key, listed).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet; a candidate index is written by country, so that runs over one country read only its files."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def _whole_file(out: zipfile.ZipFile, path: str, name: str) -> None:
    """A file as it is; a folder that Spark wrote as one file: its parts under one header."""
    if not os.path.isdir(path):
        out.write(path, name)
        return
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    if not parts:
        raise FileNotFoundError(f"{path}: no part files")
    head = None
    with out.open(name, "w", force_zip64=True) as to:
        for n in parts:
            with open(os.path.join(path, n), "rb") as part:
                first = part.readline()
                if head is None and first:
                    head = first
                    to.write(first if first.endswith(b"\n") else first + b"\n")
                elif first and first.rstrip(b"\n") != head.rstrip(b"\n"):
                    raise ValueError(f"{path}/{n}: header differs from that of the first part")
                shutil.copyfileobj(part, to, 1 << 20)


def write_archive(path: str, files: list[str], code_dir: str, extensions: tuple[str, ...] = (".py", ".md", ".txt"), skip: tuple[str, ...] = ("__pycache__", ".git"), document: str | None = None) -> list[str]:
    """A zip of result files (or folders of parts) and the document at its top and of the code under code/; returns the
    names inside. A file that is missing is an error, before anything is written."""
    for f in [*files, *([document] if document else []), code_dir]:
        if not os.path.exists(f):
            raise FileNotFoundError(f)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in files:
            _whole_file(out, f, os.path.basename(os.path.normpath(f)))
        if document:
            out.write(document, os.path.basename(document))
        for top, dirs, names in os.walk(code_dir):
            dirs[:] = sorted(d for d in dirs if d not in skip)
            for n in sorted(names):
                if n.endswith(extensions):
                    out.write(os.path.join(top, n), os.path.join("code", os.path.relpath(os.path.join(top, n), code_dir)))
        return out.namelist()


def write_features(rows: DataFrame, path: str) -> str:
    """Pair features as Parquet; as CSV with a header where Parquet cannot be written. Returns the path used."""
    try:
        rows.write.mode("overwrite").parquet(path)
        return path
    except Exception as fault:  # e.g. a column type or codec that Parquet does not take
        other = f"{path}.csv"
        warnings.warn(f"{path}: {type(fault).__name__}; writing {other}", stacklevel=2)
        rows.write.mode("overwrite").option("header", True).csv(other)
        return other
