"""Writers of CSV and JSON exports."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def quoted(value: Column) -> Column:
    """A CSV field in quotes, on one line; null is an empty field."""
    text = F.replace(F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), F.coalesce(text, F.lit("")), F.lit('"'))


def csv_lines(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """``keep`` columns and line: the columns as one CSV line each."""
    return df.select(*keep, F.concat_ws(",", *(quoted(c) for c in columns.values())).alias("line"))


def write_csv(df: DataFrame, columns: dict[str, Column], path: str) -> None:
    """A folder of CSV files with carriage returns, each with a byte order mark and the header first, as spreadsheets expect."""
    header = BOM + ",".join('"' + n.replace('"', '""') + '"' for n in columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in itertools.chain([[header]], (batch.column(0).to_pylist() for batch in batches)):
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    csv_lines(df, columns).mapInArrow(headed, "line string").write.option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and value: each row as JSON, nulls left out."""
    return df.select(*keep, F.to_json(F.struct(*(c for c in df.columns))).alias("value"))
