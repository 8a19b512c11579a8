"""The streamed log across several runs keeps its state."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.registry import city
from urbanframe.streaming import changelog

DDL = (
    "id long, seq long, ts timestamp, op string, last_modification_date timestamp, termination_date timestamp, "
    "objectclass_id int, objectid string, reason_for_update string"
)


def _change(spark, rows):
    raw = "id long, seq long, op string, mod string, term string, cls int"
    df = spark.createDataFrame(rows, raw)
    return df.select(
        "id", "seq", F.lit("2024-01-01").cast("timestamp").alias("ts"), "op", F.col("mod").cast("timestamp").alias("last_modification_date"),
        F.col("term").cast("timestamp").alias("termination_date"), F.col("cls").alias("objectclass_id"), F.lit("x").alias("objectid"), F.lit("why").alias("reason_for_update"),
    )


def test_state_lives_between_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    oc = city.dictionary(spark, "objectclass")

    def run(rows):
        _change(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).parquet(src)
        changelog.run_to_table(changelog.changelog_stream(stream, oc), out, state)
        return sorted((r.feature_id or 0, r.transaction_type) for r in spark.read.parquet(out).collect())

    first = run([(1, 1, "INSERT", "2024-01-01", None, 901), (2, 2, "INSERT", "2024-01-01", None, 710), (3, 3, "UPDATE", "2024-01-01", None, 901)])
    assert first == [(1, "INSERT")]
    second = run([(1, 4, "UPDATE", "2024-01-01", None, 901), (1, 5, "UPDATE", "2024-01-02", None, 901), (1, 6, "UPDATE", "2024-01-03", "2024-01-03", 901), (1, 7, "DELETE", None, None, 901)])
    assert second == [(0, "DELETE"), (1, "INSERT"), (1, "TERMINATE"), (1, "UPDATE")]
    third = run([(1, 8, "UPDATE", "2024-01-09", None, 901)])
    assert third == second


def test_snapshots(spark):
    ddl = "id long, objectclass_id int, objectid string, last_modification_date string, termination_date string, reason_for_update string"
    old = spark.createDataFrame([(1, 901, "a", "d1", None, "r"), (2, 901, "b", "d1", None, "r"), (3, 901, "c", None, None, "r"), (5, 710, "e", "d1", None, "r")], ddl)
    new = spark.createDataFrame([(1, 901, "a", "d2", None, "r"), (3, 901, "c", None, None, "r"), (4, 901, "d", "d1", "t", "r"), (5, 710, "e", "d9", None, "r")], ddl)
    log = changelog.changelog_from_snapshots(old, new, city.dictionary(spark, "objectclass"))
    got = {(r.feature_id, r.objectid, r.transaction_type, r.reason_for_update) for r in log.collect()}
    assert got == {(1, "a", "UPDATE", "r"), (None, "b", "DELETE", None), (4, "d", "TERMINATE", "r")}


def test_full_rows_between_snapshots(spark):
    ddl = "id long, objectclass_id int, objectid string, last_modification_date string, termination_date string, reason_for_update string, identifier string"
    old = spark.createDataFrame([(1, 901, "a", "d1", None, "r", "i1"), (2, 901, "b", "d1", None, "r", "i2")], ddl)
    new = spark.createDataFrame([(1, 901, "a", "d2", None, "r", "i9"), (4, 901, "d", "d1", None, "r", "i4")], ddl)
    at = F.lit("2024-05-06").cast("timestamp")
    log = changelog.changelog_from_snapshots(old, new, city.dictionary(spark, "objectclass"), ["identifier"], at, "me", 10)
    got = [(r.id, r.feature_id, r.identifier, r.transaction_type, r.db_user) for r in log.orderBy("id").collect()]
    assert got == [(11, 1, "i9", "UPDATE", "me"), (12, None, "i2", "DELETE", "me"), (13, 4, "i4", "INSERT", "me")]


def _plain_log(rows):
    """One change after the other."""
    out, state = [], {}
    for i, seq, op, mod, term, name in rows:
        if op == "INSERT" or (op == "UPDATE" and i in state):
            if op == "INSERT" or state[i][0] != mod:
                out.append((seq, i, name, "TERMINATE" if term else op))
            state[i] = (mod, name)
        elif op == "DELETE" and i in state:
            out.append((seq, None, state.pop(i)[1], "DELETE"))
    return sorted(out)


def test_files_in_any_order_give_the_log_of_the_right_order(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for seq in range(400):
        op = rnd.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"])
        mod = rnd.choice([None, "2024-01-01", "2024-01-02"])
        rows.append((rnd.randrange(25), seq, op, mod, rnd.choice([None, None, "2024-02-02"]), f"n{seq}"))
    raw = "id long, seq long, op string, mod string, term string, identifier string"
    df = spark.createDataFrame(rows, raw).select(
        "id", "seq", F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("version"), "op", "identifier", F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.col("mod").cast("timestamp").alias("last_modification_date"), F.col("term").cast("timestamp").alias("termination_date"),
        F.lit(901).alias("objectclass_id"), F.lit("x").alias("objectid"), F.lit("why").alias("reason_for_update"),
        G.st_point(F.col("seq").cast("double"), F.lit(1.0)).alias("envelope"),
    )
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = df.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(7))).cache()
    order = list(range(7))
    rnd.shuffle(order)
    for part in [*order, order[0]]:  # the last file brings changes that were there already
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    changelog.run_to_table(changelog.changelog_stream(stream, city.dictionary(spark, "objectclass")), out, str(tmp_path / "state"))
    log = spark.read.schema(changelog.LOG_DDL).parquet(out)
    got = log.where("NOT late").collect()
    key = lambda r: (r[0], str(r[1:]))
    assert sorted(((r.id, r.feature_id, r.identifier, r.transaction_type) for r in got), key=key) == sorted(_plain_log(rows), key=key)
    assert all(r.envelope.parts[0][0][0].x == float(r.identifier[1:]) for r in got)
    again = parts.where(F.col("part") == order[0]).count()
    assert log.where("late").count() == again
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != changelog.ROCKSDB


def test_a_change_behind_the_last_one_is_set_apart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    oc = city.dictionary(spark, "objectclass")
    for rows in ([(1, 5, "INSERT", "2024-01-01", None, 901)], [(1, 3, "UPDATE", "2023-01-01", None, 901), (1, 6, "UPDATE", "2024-01-05", None, 901)]):
        _change(spark, rows).coalesce(1).write.mode("append").parquet(src)
        changelog.run_to_table(changelog.changelog_stream(spark.readStream.schema(DDL).parquet(src), oc), out, state)
    got = sorted((r.id, r.transaction_type, r.late) for r in spark.read.schema(changelog.LOG_DDL).parquet(out).collect())
    assert got == [(3, "UPDATE", True), (5, "INSERT", False), (6, "UPDATE", False)]


def test_features_with_many_short_histories_take_little_time():
    change = {"op": "INSERT", "at": 5, "modified": 7, "terminated": None, "db_user": "u", "reason_for_update": "why", **dict.fromkeys(changelog._KNOWN, "x")}
    start, state = time.process_time(), None
    for i in range(20_000):
        rows = [{**change, "id": i, "seq": 2 * i}, {**change, "id": i, "seq": 2 * i + 1, "op": "DELETE"}, {**change, "id": i, "seq": 2 * i + 2, "op": "UPDATE"}]
        log, state = changelog.transitions(rows, None)
        assert [r["transaction_type"] for r in log] == ["INSERT", "DELETE"] and log[1]["feature_id"] is None and log[1]["objectid"] == "x"
    assert not state["alive"] and state["modified"] == 7
    assert time.process_time() - start < 10
