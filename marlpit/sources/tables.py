"""Reading and writing tables: Parquet, CSV, JSON, binary files, inline rows, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",") -> DataFrame:
    """CSV with a given schema: the files are read once, no inference."""
    return spark.read.csv(path, schema=schema, header=header, sep=separator)


def write(df: DataFrame, path: str, kind: str = "parquet", files: int | None = None) -> None:
    """Write as parquet, csv, json or tab-separated text; files bounds their number."""
    out = (df.coalesce(files) if files else df).write
    if kind == "tabs":
        out.csv(path, sep="\t", header=True)
    elif kind == "csv":
        out.csv(path, header=True)
    else:
        getattr(out, kind)(path)


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """A compacted copy: as few files as the number of rows allows."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, hex) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.hex("content").alias("hex"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def generate_series(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """value from first to last, both included, in partitions."""
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def rendered(df: DataFrame, mode: str = "list", separator: str = "|") -> DataFrame:
    """Rows as one text column `line`: list, csv, tabs, ascii, json, quote, insert, line, html, tcl or markdown."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    numeric = {f.name for f in df.schema if f.dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    sql = [F.coalesce(c.cast("string") if n in numeric else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c, n in zip(cols, df.columns)]
    line = {
        "list": lambda: F.concat_ws(separator, *text),
        "tabs": lambda: F.concat_ws("\t", *text),
        "ascii": lambda: F.concat_ws("\x1f", *text),
        "markdown": lambda: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(t, F.lit("|"), F.lit("\\|")) for t in text)), F.lit(" |")),
        "csv": lambda: F.concat_ws(",", *(F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text)),
        "json": lambda: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}),
        "quote": lambda: F.concat_ws(",", *sql),
        "insert": lambda: F.concat(F.lit("INSERT INTO t VALUES("), F.concat_ws(",", *sql), F.lit(");")),
        "line": lambda: F.concat_ws("\n", *(F.concat(F.lit(f"{n} = "), t) for n, t in zip(df.columns, text))),
        "html": lambda: F.concat(F.lit("<TR>"), *(F.concat(F.lit("<TD>"), F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</TD>")) for t in text), F.lit("</TR>")),
        "tcl": lambda: F.concat_ws(" ", *(F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for t in text)),
    }[mode]()
    return df.select(line.alias("line"))


#: What stands before, between and after the padded columns.
FRAMES = {"column": ("", "  ", ""), "table": ("| ", " | ", " |"), "box": ("│ ", " │ ", " │")}


def aligned(df: DataFrame, mode: str = "column") -> DataFrame:
    """Rows as one text column `line`, columns padded to their widest value or name: column, table or box.

    The widths are one row of maxima, joined to every row.
    """
    before, between, after = FRAMES[mode]
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    widths = df.agg(*(F.greatest(F.coalesce(F.max(F.char_length(c)), F.lit(0)), F.lit(len(n))).alias(f"__w{i}") for i, (c, n) in enumerate(zip(cols, df.columns))))
    padded = [F.rpad(c, F.col(f"__w{i}"), F.lit(" ")) for i, c in enumerate(cols)]
    return df.crossJoin(F.broadcast(widths)).select(F.concat(F.lit(before), F.concat_ws(between, *padded), F.lit(after)).alias("line"))
