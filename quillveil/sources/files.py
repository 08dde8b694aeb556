"""File sources and sinks: JSON lines, CSV, YAML settings, report tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines with sorted keys; overwrites."""
    writer = df.select(*sorted(df.columns)).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """A YAML file of settings."""
    import yaml

    rows = spark.read.text(path, wholetext=True).collect()  # one settings file
    return yaml.safe_load(rows[0][0]) if rows else {}


def read_conditions(spark: SparkSession, path: str, conditions: list[str], required: bool = True) -> DataFrame:
    """Rows of some conditions of a table partitioned by condition; a missing one is an error if required."""
    df = spark.read.parquet(path).where(F.col("condition").isin(*conditions))
    if required:
        found = {r[0] for r in df.select("condition").distinct().collect()}  # one row per condition
        if missing := sorted(set(conditions) - found):
            raise ValueError(f"no rows for conditions: {', '.join(missing)}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def cache_summary(spark: SparkSession, path: str) -> DataFrame:
    """Number of cached answers and token sums of a folder of JSON files; missing counts are 0."""
    usage = "usage struct<input_tokens:long,output_tokens:long,total_tokens:long>"
    rows = spark.read.schema(usage).option("multiLine", True).json(path)
    total = lambda c: F.coalesce(F.sum(F.coalesce(f"usage.{c}", F.lit(0))), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("n"), total("input_tokens"), total("output_tokens"), total("total_tokens"))


def note_value(text: str, label: str):
    """Value after ``Label:`` in a notes text, as a column over the text column."""
    return F.trim(F.regexp_extract(text, rf"(?m)^[\s*-]*\Q{label}\E:\s*(.*)$", 1))


def discover_runs(spark: SparkSession, path: str, pattern: str = r"batch_(\d+)_([a-z0-9_]+)\.json") -> DataFrame:
    """(path, batch, run) of the artifacts whose names match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(F.regexp_like("path", F.lit(pattern))).select("path", F.regexp_extract("path", pattern, 1).cast("int").alias("batch"), F.regexp_extract("path", pattern, 2).alias("run"))


def markdown_table(df: DataFrame, digits: int = 3) -> str:
    """A report table as padded Markdown; floats with fixed digits. For small tables only."""
    rows = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.collect()]
    width = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)])


def latex_table(df: DataFrame, caption: str, label: str, digits: int = 3) -> str:
    """A report table in LaTeX, special characters escaped. For small tables only."""
    special = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}
    clean = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "".join(special.get(c, c) for c in str("" if v is None else v))
    body = [" & ".join(map(clean, r)) + r" \\" for r in [df.columns, *df.collect()]]
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", r"\end{table}"])
