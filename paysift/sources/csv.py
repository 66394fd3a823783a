"""Header CSV scans and the report sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_header_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV with every column a nullable string (no inference pass over the data).

    With ``columns`` the schema is given up front, so no job is spent reading the header and
    the plan prunes unused columns. Without it Spark reads only the header line for names.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", True)
    return reader.csv(path)


def read_wide_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns of a header CSV of any width, by name and as text, null where empty. Only the
    header line is read for the names; the scan parses no other column. A name that the header
    lacks is an error."""
    wide = read_header_csv(spark, path)
    missing = [c for c in columns if c not in wide.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return wide.select(*(f"`{c}`" for c in columns))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """Parquet (default) or header CSV by format name."""
    if fmt == "csv":
        return read_header_csv(spark, path, columns)
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def write_report(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = True) -> None:
    """Header CSV sink. ``mode`` is a parameter: the default refuses an existing path (as the
    original did), ``overwrite`` replaces it.

    ``single_file`` coalesces to one task; use it only for bounded results such as an error
    report (one row per group), never for row-level output.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_reports(spark: SparkSession, reports: dict[str, Callable[[], DataFrame]], out_dir: str, run_id: str,
                  mode: str = "errorifexists", single_file: bool = True) -> dict[str, str]:
    """Several reports (name: function that computes it) as header CSVs under ``out_dir``, all or
    none: they are written to a staging folder of the run, and once all are there, each takes
    its place by one rename. A run that was lost is repeated under the same ``run_id``: before
    the last report was staged it starts anew, after that it only renames what is left. Returns
    the paths.

    ``mode``: ``errorifexists`` refuses to start where a report of this name exists,
    ``overwrite`` replaces it."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    root = out_dir.rstrip("/")
    staged, paths = f"{root}/_staging-{run_id}", {name: f"{root}/{name}" for name in reports}
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    ready = path(f"{staged}/_READY")
    if not files.exists(ready):
        taken = [p for p in paths.values() if files.exists(path(p))]
        if taken and mode == "errorifexists":
            raise FileExistsError(f"reports exist: {taken}")
        files.delete(path(staged), True)
        for name, compute in reports.items():
            write_report(compute(), f"{staged}/{name}", single_file=single_file)
        files.create(ready).close()
    for name, target in paths.items():
        source = path(f"{staged}/{name}")
        if files.exists(source):  # else it is in its place since an earlier try
            files.delete(path(target), True)
            if not files.rename(source, path(target)):
                raise OSError(f"{source} can't be renamed to {target}")
    files.delete(path(staged), True)
    return paths
