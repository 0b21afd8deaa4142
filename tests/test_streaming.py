from pyspark.sql import functions as F

from sparkveil.functions import text
from sparkveil.functions.rules import Rule
from sparkveil.operators import pseudonymize
from sparkveil.streaming import detection

RULES = [Rule("EMAIL_ADDRESS", r"[a-z.]+@[a-z.]+[a-z]", 1.0, "mail")]
SCHEMA = "doc_id string, unit_id string, unit_ord long, text string, lang string, ts timestamp"


def batch(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id string, unit_id string, unit_ord long, text string, lang string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def decide(rows):
    return rows.select("entity_type", text.key(F.col("value")).alias("value_key"), F.lit("pseudonymize").alias("action")).distinct()


def test_tokens_stay_the_same_from_batch_to_batch(spark, tmp_path):
    stream_batches(spark, tmp_path, 100)


def test_whole_mappings_now_and_then(spark, tmp_path):
    stream_batches(spark, tmp_path, 1)


def stream_batches(spark, tmp_path, compact):
    source, out, at = f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k, rows in enumerate(([("1", "a", 0, "x a@b.de y", "de", "2026-01-01 00:00:00")], [("2", "a", 0, "c@d.de then A@b.de", "de", "2026-01-01 00:01:00")])):
        batch(spark, source, rows)
        detection.run_once(detection.write_pseudonymized(spark.readStream.schema(SCHEMA).parquet(source), RULES, decide, out, at, compact=compact))
        assert spark.read.parquet(f"{out}/output/batch={k}").count() == 1
    got = {r["doc_id"]: r["output"] for r in spark.read.parquet(f"{out}/output").collect()}
    assert got == {"1": "x [EMAIL_1] y", "2": "[EMAIL_2] then [EMAIL_1]"}
    assert pseudonymize.Mapping.load(spark, f"{out}/mapping/1").entries.count() == 1, "a batch writes what it adds"
    assert [detection.mapping_before(spark, f"{out}/mapping", n).entries.count() for n in (0, 1, 2)] == [0, 1, 2]
    assert {r["next_n"] for r in detection.mapping_before(spark, f"{out}/mapping").counters.collect()} == {3}


def test_windows(spark, tmp_path):
    batch(spark, f"{tmp_path}/in", [("1", "a", 0, "a@b.de c@d.de", "de", "2026-01-01 00:00:00"), ("1", "b", 1, "e@f.de", "de", "2026-01-01 00:07:00")])
    rows = detection.counts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), RULES)
    query = rows.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["findings"] for r in spark.table("counted").collect()) == [1, 2]
