"""Detection on streams: stateless, so a batch's plan serves; numbered tokens are given out batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.rules import Rule
from ..operators import detect, pseudonymize
from ..operators.resolve import resolved


def findings(units: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """Findings of a stream of units (doc_id, unit_id, unit_ord, text, lang), without overlaps. No state, no watermark."""
    found = detect.candidates(units, rules, **options).withColumn("found", resolved("found", "text"))
    return detect.rows(found)


def counts(units: DataFrame, rules: list[Rule], time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by entity type and window of event time; what comes later than `late` is left out."""
    from pyspark.sql import functions as F

    found = detect.candidates(units.withWatermark(time, late), rules).withColumn("found", resolved("found", "text"))
    rows = found.select(time, F.explode("found").alias("f"))
    return rows.groupBy(F.window(time, width), F.col("f.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("findings"))


def write_pseudonymized(units: DataFrame, rules: list[Rule], decide: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str | None = None, compact: int = 100) -> DataStreamWriter:
    """A writer that replaces decided values batch by batch under folder/output/batch=N.

    A batch adds what it mints to folder/mapping/N (new entries and all counters, which are few), so its cost does not grow with
    the stream's age; every `compact` batches the whole mapping is written to folder/mapping/whole=N, and reading begins there.
    A batch that is repeated after a failure begins with the mapping before it and writes the same folders again, so its
    tokens stay the same. The mapping is there before any text that uses it.
    """

    def batch(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        frame = frame.persist()
        try:
            before = mapping_before(spark, f"{folder}/mapping", number, key)
            rows = findings(frame, rules)
            out, after = pseudonymize.apply(frame, rows, decide(rows), before)
            for part in (f"{folder}/mapping/{number}", f"{folder}/mapping/whole={number}", f"{folder}/output/batch={number}"):
                _remove(spark, part)
            new = after.entries.join(before.entries.select("placeholder"), "placeholder", "left_anti").select(*after.entries.columns)
            pseudonymize.Mapping(new, after.counters).save(f"{folder}/mapping/{number}", key)
            if number % compact == compact - 1:
                after.save(f"{folder}/mapping/whole={number}", key)
            out.write.parquet(f"{folder}/output/batch={number}")
        finally:
            frame.unpersist()

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapping_before(spark: SparkSession, folder: str, number: int = 1 << 62, key: str | None = None) -> pseudonymize.Mapping:
    """The mapping (of folder/mapping) before a batch, or after the last one: the last whole one, and what batches have added since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    whole = [n for n in (int(x[6:]) for x in names if x.startswith("whole=")) if n < number]
    last = max(whole, default=-1)
    parts = [f"whole={last}"] * bool(whole) + [str(n) for n in sorted(int(x) for x in names if x.isdigit()) if last < n < number]
    found = [pseudonymize.Mapping.load(spark, f"{folder}/{part}", key) for part in parts]
    if not found:
        return pseudonymize.Mapping.empty(spark)
    entries = reduce(DataFrame.unionByName, [m.entries for m in found])
    return pseudonymize.Mapping(entries, found[-1].counters)


def run_once(writer: DataStreamWriter) -> StreamingQuery:
    """Take what is there and end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
