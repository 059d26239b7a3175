"""Edit histories in event time: batches in any order give the batch query's history, and the state stays bounded."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioframe.operators import elements as e
from folioframe.streaming import edits

SCHEMA = "doc_id long, event_id long, ts timestamp, op string"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def stream(spark, tmp_path, batches, **more):
    """Rows that the query tells; each batch is a file, taken one at a time."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = edits.in_event_time(source, **more).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, spark.table("told").collect()


def test_batches_out_of_order_give_the_batch_history(spark, tmp_path, rocks):
    r = random.Random(4)
    rows = [(r.randrange(3), i, START + timedelta(seconds=i * 20 + r.randrange(9)), r.choice(["click", "error", "view", "purchase"])) for i in range(120)]
    late = [(t[2].timestamp() + r.randrange(0, 500), t) for t in rows]  # comes up to 500 seconds late
    order = [t for _, t in sorted(late)]
    batches = [order[i : i + 30] for i in range(0, 120, 30)]
    end = START + timedelta(hours=20)
    _, told = stream(spark, tmp_path, [*batches, [(99, 9999, end, "click")], [(99, 10000, end + timedelta(hours=1), "click")]])
    last = {}
    for t in told:
        if t["doc_id"] != 99:
            last[t["doc_id"]] = max(last.get(t["doc_id"], (datetime.min,)), (t["ts"], t["history"], t["cursor"]))
    want = e.undo_log(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {k: v[1:] for k, v in last.items()} == {w["doc_id"]: (w["history"], w["cursor"]) for w in want}


def test_saves_and_idle_documents_leave_no_state(spark, tmp_path, rocks):
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [(1, 1, at(0), "click"), (1, 2, at(0.1), "click"), (2, 3, at(0), "click"), (2, 4, at(0.2), "save")],
        [(3, 5, at(1), "click")], [(9, 6, at(30), "click")], [(1, 7, at(31), "click"), (9, 8, at(31), "click")], [(9, 9, at(60), "click")], [(9, 10, at(90), "click")], [(9, 11, at(120), "click")],
    ]
    q, told = stream(spark, tmp_path, batches, save="save")
    got = {(t["doc_id"], t["ts"]): (t["history"], t["cursor"]) for t in told}
    assert got[1, at(0.1)] == (2, 2) and got[2, at(0.2)] == (0, 0)
    assert got[1, at(31)] == (1, 1), "after a day without edits a history begins anew"
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 6, "only the last document is left"
