"""Sinks: guarded CSV, JSON with sorted keys, aligned text tables, and partitions replaced by source."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First characters that a spreadsheet reads as a formula.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]


def guarded(text: Column) -> Column:
    """Without control characters, and with a quote before what a spreadsheet would run."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.when(F.substring(plain, 1, 1).isin(FORMULA_STARTS), F.concat(F.lit("'"), plain)).otherwise(plain)


def csv_cells(df: DataFrame) -> DataFrame:
    """All columns as text: doubles with six decimals, strings guarded."""
    def cell(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.when(F.col(name).isNotNull(), F.format_string("%.6f", F.col(name).cast("double")))
        return guarded(F.col(name)) if kind == "string" else F.col(name).cast("string")

    return df.select(*(cell(n, k).alias(n) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON objects with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def report_json(df: DataFrame, most: int = 10_000) -> str:
    """A report as one indented JSON list. Reports are top-k or one row per period; more rows than ``most`` are refused."""
    rows = [r.asDict(recursive=True) for r in _bounded(df, most)]
    return json.dumps(rows, indent=2, sort_keys=True, default=str, ensure_ascii=False)


def report_table(df: DataFrame, most: int = 10_000) -> str:
    """A report as text: columns as wide as their widest cell, numbers to the right."""
    kinds = dict(df.dtypes)
    cells = [list(df.columns), *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in _bounded(df, most))]
    widths = [max(len(row[k]) for row in cells) for k in range(len(df.columns))]
    right = [kinds[c] in ("int", "bigint", "double") for c in df.columns]
    return "\n".join("  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(row, widths, right, strict=True)).rstrip() for row in cells)


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has more than {most} rows; write it to a path instead")
    return rows


def replace_sources(df: DataFrame, path: str, by: str = "source_id") -> None:
    """Writes rows by source; partitions of sources in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_sources(gone: DataFrame, path: str, by: str = "source_id") -> None:
    """Removes the rows of the sources in ``gone`` (a column ``by``). Only the partitions of these sources are touched:
    each is replaced by nothing. The names of vanished sources pass through the driver, a bounded page at a time."""
    spark = gone.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in gone.select(by).distinct().toLocalIterator():
        folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, str(r[0]))
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, folder), True)
