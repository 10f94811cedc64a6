import datetime as dt

from pyspark.sql import functions as F

from barloom.operators.services import STATES
from barloom.streaming import live
from barloom.streaming.live import order_lifecycle, streamed_bars
from barloom.streaming.order_life import order_life


def run_to_end(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_bars_from_ticks(spark, tmp_path, sf_dir):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    ticks.write.parquet(str(tmp_path / "ticks"))
    live = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    got = run_to_end(streamed_bars(live), "bars_live")
    whole = ticks.groupBy("symbol", F.date_trunc("hour", "ts")).count().count()
    assert whole * 0.9 <= got.count() <= whole


def test_order_lifecycle(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    moves = [(1, s) for s in ("DRAFT", "CALCULATING", "CONFIRMED", "READY_FOR_REVIEW")] + [(2, "ACKED")]
    data = [(o, start + dt.timedelta(seconds=k), s) for k, (o, s) in enumerate(moves)]
    df = spark.createDataFrame(data, "order_id long, ts timestamp, state string")
    df.write.parquet(str(tmp_path / "moves"))
    got = run_to_end(order_lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "moves"))), "orders_live")
    assert [r.legal for r in got.orderBy("order_id", "ts").collect()] == [True, True, False, True, False]


def test_second_life_of_an_order_wherever_batches_end(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    moves = [*STATES, "ACKED", *STATES[:2]]
    df = spark.createDataFrame([(1, start + dt.timedelta(seconds=k), s) for k, s in enumerate(moves)], "order_id long, ts timestamp, state string").coalesce(1)
    for name, files in (("one", 1), ("each", len(moves))):
        path = str(tmp_path / name)
        for k in range(files):
            (df if files == 1 else df.where(F.second("ts") == k)).write.mode("append").parquet(path)
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = run_to_end(order_lifecycle(live), f"second_life_{name}").orderBy("ts").collect()
        assert [r.legal for r in got] == [True] * 7 + [False, True, True]
        assert [r.previous for r in got] == [None, *STATES[:6], None, None, "DRAFT"]


MOVES = "order_id long, ts timestamp, state string"
START = dt.datetime(2024, 1, 1)


def life_moves():
    """Order 1 is confirmed in time, 2 too late, 3 never, 4 stays in review, 5 comes much later and drives the watermark."""
    out = [(o, 60 * k, s) for o in (1, 2, 3) for k, s in enumerate(STATES[:4])] + [(4, 60 * k, s) for k, s in enumerate(STATES[:3])]
    out += [(1, 185, "CONFIRMED"), (1, 186, "SUBMITTED"), (1, 187, "ACKED"), (2, 200, "CONFIRMED"), (2, 201, "DRAFT")]
    return [(o, START + dt.timedelta(seconds=t), s) for o, t, s in out] + [(5, START + dt.timedelta(days=3), "DRAFT"), (5, START + dt.timedelta(days=6), "DRAFT")]


def run_life(spark, path, out, files):
    df = spark.createDataFrame(life_moves(), MOVES).orderBy("ts").coalesce(1)
    rows = df.collect()
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], MOVES).coalesce(1).write.mode("append").parquet(path)
    stream = order_life(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), 10, "1 minute")
    with live.state_store(spark, live.KEYED_STORE):
        q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted((r.order_id, r.ts, r.state, r.previous, r.legal) for r in spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()), kept


def test_countdown_runs_out_wherever_batches_end(spark, tmp_path):
    one, kept = run_life(spark, str(tmp_path / "one"), str(tmp_path / "out1"), 1)
    many, kept_too = run_life(spark, str(tmp_path / "many"), str(tmp_path / "out2"), 6)
    assert one == many
    expired = {o: ts for o, ts, s, _, _ in one if s == "EXPIRED"}
    assert expired == {2: START + dt.timedelta(seconds=190), 3: START + dt.timedelta(seconds=190)}
    by_move = {(o, s): (p, ok) for o, _, s, p, ok in one if o != 5}
    assert by_move[1, "ACKED"] == ("SUBMITTED", True) and by_move[2, "CONFIRMED"] == (None, False) and by_move[3, "EXPIRED"] == ("COUNTDOWN", True)
    # Order 2's life began again at 201 s and it was idle for a day since, as order 4: forgotten. Order 5 alone is left.
    assert by_move[2, "DRAFT"] == (None, True)
    assert kept <= 3 and kept_too <= 3


def test_orders_share_state_by_groups(spark, tmp_path):
    """900 orders, each judged as if alone: in time, too late, or left open; one move without an order, one without a time."""
    moves, expected = [], []
    for o in range(900):
        late = 11 if o % 3 == 1 else 5
        steps = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3 + late)] if o % 3 < 2 else [(0, 0), (2, 1)]
        moves += [(o, START + dt.timedelta(seconds=t, microseconds=o), STATES[k]) for k, t in steps]
        expected += [(o, STATES[k], STATES[k - 1] if k and not (k == 4 and late > 10) else None, not (k == 4 and late > 10)) for k, _ in steps if o % 3 < 2]
        expected += [(o, "EXPIRED", "COUNTDOWN", True)] * (o % 3 == 1) + [(o, "DRAFT", None, True), (o, "READY_FOR_REVIEW", "DRAFT", False)] * (o % 3 == 2)
    moves += [(None, START, "DRAFT"), (2**60 + 1, None, "DRAFT")]
    expected += [(None, "DRAFT", None, True), (2**60 + 1, "DRAFT", None, True)]
    path = str(tmp_path / "moves")
    for part in ("ts is null or ts < '2024-01-01 00:00:02'", "ts >= '2024-01-01 00:00:02'"):
        spark.createDataFrame(moves, MOVES).where(part).coalesce(1).write.mode("append").parquet(path)
    stream = order_life(spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).parquet(path), 10, "1 hour", groups=8)
    with live.state_store(spark, live.KEYED_STORE):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "rows")).collect()
    assert sorted(((r.order_id, r.state, r.previous, r.legal) for r in got), key=str) == sorted(expected, key=str)
    assert {r.ts for r in got if r.state == "EXPIRED" and r.order_id == 1} == {START + dt.timedelta(seconds=13, microseconds=1)}
    assert [r.order_id for r in got if r.ts is None] == [2**60 + 1]
    # A value and two entries of a timer for a group, not for an order.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 27


def test_fills_join_their_orders(spark, tmp_path):
    def at(minutes):
        return START + dt.timedelta(minutes=minutes)

    orders = spark.createDataFrame([(1, 7, at(0)), (2, 7, at(30)), (3, 8, at(10)), (4, 9, at(2000))], "order_id long, account long, ts timestamp")
    fills = spark.createDataFrame([(10, 7, at(0)), (11, 7, at(149)), (12, 7, at(151)), (13, 8, at(9)), (14, 6, at(2000))], "fill_id long, account long, filled timestamp")
    orders.write.parquet(str(tmp_path / "o"))
    fills.write.parquet(str(tmp_path / "f"))
    joined = live.orders_with_fills(spark.readStream.schema(orders.schema).parquet(str(tmp_path / "o")), spark.readStream.schema(fills.schema).parquet(str(tmp_path / "f")))
    got = sorted(((r.order_id, r.fill_id) for r in live.run_once(joined, "fills-test").collect()), key=str)
    # Order 3 has no fill in time and the watermark has passed; order 4 may still get one.
    assert got == [(1, 10), (2, 11), (3, None)]


def test_session_setting_is_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with live.state_store(spark, live.KEYED_STORE):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == live.KEYED_STORE
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
