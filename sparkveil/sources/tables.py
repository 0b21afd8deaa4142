"""Tables as units, and units and findings as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "doc_id string, unit_id string, unit_ord long, text string, header string, sheet string, col string, row long, kind string"


def cell_text(column: Column, kind: T.DataType) -> Column:
    """What of a cell is scanned: text, and integers of five digits or more; no fractions, truth values or dates."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.IntegralType):
        whole = column.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = F.when(column == F.floor(column), column.cast("decimal(38,0)").cast("string"))
    else:
        return F.lit(None).cast("string")
    return F.when(F.length(F.regexp_replace(whole, "-", "")) >= 5, whole)


def unpivot(table: DataFrame, doc: str, key: Column, sheet: str = "table", skip: tuple[str, ...] = ()) -> DataFrame:
    """A unit for each cell of a table, in row and column order. key: a column that names the row (long); skip: no cells."""
    fields = [f for f in table.schema.fields if f.name not in skip]
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(_letter(k)).alias("col"), F.lit(f.name).alias("header"), cell_text(F.col(f"`{f.name}`"), f.dataType).alias("text"))
        for k, f in enumerate(fields)
    ])
    width = len(fields)
    made = table.select(key.cast("long").alias("row"), F.explode(cells).alias("c")).where("c.text is not null and c.text <> ''")
    return made.select(
        F.lit(doc).alias("doc_id"), F.concat_ws("!", F.lit(sheet), F.concat("c.col", F.col("row").cast("string"))).alias("unit_id"), (F.col("row") * width + F.col("c.k")).alias("unit_ord"),
        "c.text", "c.header", F.lit(sheet).alias("sheet"), "c.col", "row", F.lit("cell").alias("kind"),
    )


def _letter(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def texts(table: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A unit for each row of a table with a text column."""
    return table.select(
        F.col(key).cast("string").alias("doc_id"), F.concat(F.lit("u"), F.col(key).cast("string")).alias("unit_id"), F.lit(0).cast("long").alias("unit_ord"), F.coalesce(F.col(column), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("col"), F.lit(None).cast("long").alias("row"), F.lit("text").alias("kind"),
    )


def formula_literals(formula: Column) -> Column:
    """The quoted texts of a formula with their places."""
    from ..functions.text import spans

    inside = lambda m: F.struct((m["start"] + 1).alias("start"), (m["end"] - 1).alias("end"), F.replace(F.substring(m["value"], F.lit(2), F.length(m["value"]) - 2), F.lit('""'), F.lit('"')).alias("value"))
    return F.transform(spans(formula, r'"(?:[^"]|"")*"'), inside)


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A list of names or products: a line each, lower-cased, # begins a comment. A missing file is an empty list."""
    try:
        lines = [r["value"] for r in spark.read.text(path).collect()]  # a list that goes into expressions
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted({w for w in (x.strip().lower() for x in lines) if w and not w.startswith("#")})


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Units out of JSON lines."""
    return spark.read.schema(UNIT).json(path)


def read_csv(spark: SparkSession, path: str, doc: str | None = None) -> DataFrame:
    """A CSV file's cells as units; the first row holds the headers. Row numbers rise through the file, with gaps between its parts."""
    table = spark.read.csv(path, header=True).withColumn("_row", F.monotonically_increasing_id() + 2)
    return unpivot(table, doc or path, F.col("_row"), skip=("_row",))


def write_findings_csv(export: DataFrame, path: str) -> None:
    """The diagnostic export, with headers."""
    export.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def write_report(report: DataFrame, path: str, facts: dict) -> None:
    """A report without values, as JSON: per class numbers with the facts of the run (configuration hash, verified, ...)."""
    for name, value in facts.items():
        report = report.withColumn(name, F.lit(value))
    report.write.mode("errorifexists").json(path)


def log_event(spark: SparkSession, path: str, event: str, detail: str = "") -> None:
    """Append to the audit log. Give no values."""
    spark.sql("select current_timestamp() as at, :event as event, :detail as detail", args={"event": event, "detail": detail}).write.mode("append").json(path)


def read_recent(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    return spark.read.schema("at timestamp, event string, detail string").json(path).orderBy(F.desc("at")).limit(limit)


def publish(frame: DataFrame, folder: str, check) -> str:
    """Write to a staging folder, let `check` read it again and raise, and only then give it its name. Returns the folder."""
    spark = frame.sparkSession
    staged = f"{folder}._staged_{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    store = path(staged).getFileSystem(conf)
    try:
        frame.write.parquet(staged)
        check(spark.read.parquet(staged))
        target = free_name(spark, folder)
        if not store.rename(path(staged), path(target)):
            raise OSError(f"{staged} could not be renamed to {target}")
    except BaseException:
        store.delete(path(staged), True)
        raise
    return target


def free_name(spark: SparkSession, folder: str) -> str:
    """The folder, or the first of folder (2), folder (3), ... that is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    name, k = folder, 1
    while store.exists(path(name)):
        k += 1
        name = f"{folder} ({k})"
    return name


def output_name(path: str) -> str:
    """report.docx: report_psd.docx."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}_psd.{end}" if dot and "/" not in end else f"{path}_psd"
