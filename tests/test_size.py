"""What must hold at any size of the tables."""

from pyspark.sql import functions as F

from sparkveil.functions import text
from sparkveil.operators import document, review
from sparkveil.plans import queries


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_propagation_broadcasts_neither_words_nor_units(spark, tmp_path):
    """A file says little of how many words it makes: its size must not send them through the driver."""
    name = lambda k: f"Bergmann{chr(97 + k % 26)}{chr(97 + k // 26)}"
    units = [(str(k), "a", f"Herr {name(k)}") for k in range(50)] + [(str(k), "b", f"An {name(k)} und {name(k + 1)}") for k in range(50)]
    spark.createDataFrame(units, "doc_id string, unit_id string, text string").write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    known = units.where("unit_id = 'a'").select("doc_id", F.lit("PERSON").alias("entity_type"), F.substring("text", 6, 20).alias("seed"))
    found = document.propagated(units, known)
    assert "Broadcast" not in plan(found)
    got = {(r["doc_id"], r["unit_id"], r["f"]["start"], r["f"]["value"]) for r in found.select("doc_id", "unit_id", F.explode("found").alias("f")).collect()}
    assert got == {(str(k), *x) for k in range(50) for x in (("a", 5, name(k)), ("b", 3, name(k)))}


def test_a_phone_number_at_the_start_of_a_line_keeps_its_plus(spark, tmp_path):
    said = ["+1 (555) 010-9999", "a\n  +1 (555) 010-9998", "-+1 (555) 010-9997", "++1 (555) 010-9996", "see +1 (555) 010-9995", "+Punkt 1"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert [r["t"] for r in docs.select(text.neutralize(F.col("text")).alias("t")).collect()] == [said[0], said[1], " +1 (555) 010-9997", " +1 (555) 010-9996", said[4], " Punkt 1"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = queries.flagship(spark, str(tmp_path)).collect()
    assert (got["entity_type"], got["occurrences"], got["distinct_values"]) == ("PHONE_NUMBER", 5, 5)


def test_a_miss_beside_an_accented_letter_is_told(spark):
    """Shapes of ASCII letters end where these end."""
    said = ["LA CIÓNQUEESDO!!", "DEUTDEFFÉ x", "éKD-48151623", "XNQUEESDO NQUEESDOX", "Bank NQUEESDO."]
    units = spark.createDataFrame([(str(k), "u", 0, t) for k, t in enumerate(said)], "doc_id string, unit_id string, unit_ord long, text string")
    none = spark.createDataFrame([], "doc_id string, unit_id string, start int, end int")
    got = {(r["doc_id"], r["value_key"]) for r in review.possible_misses(units, none, ["DE", "ES"]).collect()}
    assert got == {("0", "nqueesdo"), ("1", "deutdeff"), ("2", "kd-48151623"), ("4", "nqueesdo")}


def test_a_column_summary_shows_the_first_row(spark):
    """Column A has its first text in row 10001; what the sheet's first row shows of it is nothing."""
    cells = [("s", "A", 10001, "c_custkey", "10000"), ("s", "B", 2, "name", " Anna "), ("s", "B", 3, "name", "Bernd"), ("s", "C", 3, "note", "x"), ("t", "A", 7, "h", "y")]
    cells = spark.createDataFrame(cells, "sheet string, col string, row long, header string, text string")
    found = cells.where("col = 'B'").select("sheet", "col")
    shown = lambda rows: {(r["sheet"], r["col"]): (r["sample"], r["pii_count"]) for r in review.column_summary(cells, found, rows=rows).collect()}
    assert shown(1) == {("s", "A"): (None, 0), ("s", "B"): ("Anna", 2), ("s", "C"): (None, 0), ("t", "A"): ("y", 0)}
    assert shown(2)["s", "C"] == ("x", 0) and shown(2)["s", "A"] == (None, 0)
    assert shown(None) == shown(1) | {("s", "A"): ("10000", 0), ("s", "C"): ("x", 0)}


def test_column_summary_query_beyond_ten_thousand_customers(spark, tmp_path):
    rows = [(k, f"Customer#{k}", 1, 0.0, "BUILDING") for k in (0, 1, 2, 10000, 10001)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["col"]: (r["sample"], r["pii_count"]) for r in queries.g_column_summary(spark, str(tmp_path)).collect()}
    assert got["A"] == (None, 0) and got["D"] == ("BUILDING", 0) and got["E"] == ("Customer#1", 0) and got["B"][1] == 5 and got["C"][1] == 2


def test_people_repeat_in_a_long_column(spark):
    """Distinct among themselves in 500 rows, though not in all; a thinly filled column of one name is no list of people."""
    people = lambda k: f"{('Anna', 'Bernd', 'Clara', 'Dieter')[k % 4]} Koch{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"
    cells = [("d", "s", "A", k + 2, "Spalte", people(k % 600)) for k in range(3000)]
    cells += [("d", "s", "B", k + 2, "Spalte", people(k % 30)) for k in range(3000)]
    cells += [("d", "s", "C", 900 * k + 2, "Spalte", "Anna Koch") for k in range(20)]
    cells += [("d", "s", "D", 900 * k + 2, "Spalte", people(k)) for k in range(20)]
    cells += [("d", "s", "E", k + 2, "Spalte", people(k // 2)) for k in range(10)] + [("d", "s", "F", k + 2, "Spalte", people(k // 3)) for k in range(9)]
    cells += [("d", "s", "G", None, "Spalte", people(k)) for k in range(9)] + [("d", "s", "H", None, "Spalte", people(k // 3)) for k in range(9)]
    frame = spark.createDataFrame(cells, "doc_id string, sheet string, col string, row long, header string, text string")
    assert {r["col"] for r in document.people_columns(frame, ("Anna", "Bernd")).collect()} == {"A", "D", "E", "G"}
