import json
import os

from pyspark.sql import functions as F

from tessella.streaming import acceptance, segments


def test_exchange(spark, tmp_path):
    inbox, store, marks = (str(tmp_path / x) for x in ("inbox", "store", "marks"))
    (tmp_path / "inbox").mkdir()

    def send(name, *messages):
        (tmp_path / "inbox" / name).write_text("\n".join(json.dumps(dict(zip(("issue", "user", "stamp", "text"), m, strict=True))) for m in messages))

    first = ("i", "ann", "2024-01-01T10:00:00Z", "hello\n____\nold text")
    send("1.json", first, first, ("i", "bob", "2024-01-01T11:00:00Z", "In progress: wait"), (None, "x", "2024-01-01T11:00:00Z", "lost"))
    segments.exchange(spark, inbox, store, marks)
    send("2.json", ("i", "bob", "2024-01-01T12:00:00Z", "answer"), ("j", "ann", "2024-01-01T12:30:00Z", "other"))
    segments.exchange(spark, inbox, store, marks)
    found = {r.issue: (r.n, r.text) for r in segments.assembled(spark.read.parquet(store)).collect()}
    assert found == {"i": (2, "bob: answer\n____\nann: hello"), "j": (1, "ann: other")}


def test_windows_on_a_stream_and_a_table(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = segments.windowed_counts(stream, "ts", "event_type")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    table = segments.windowed_counts(events, "ts", "event_type")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, table.collect()))


TABLE = {("0", "a"): "1", ("1", "b"): "1", ("1", "c"): "2"}


def test_acceptance(spark):
    rows = spark.createDataFrame([(list("abbc"),), (list("ab"),), (list("b"),), ([],)], "s array<string>")
    got = rows.select(acceptance.end_state(F.col("s"), TABLE, "0").alias("e"), acceptance.accepted(F.col("s"), TABLE, "0", ["2"]).alias("y")).collect()
    assert [tuple(r) for r in got] == [("2", True), ("1", False), (None, False), ("0", False)]
    assert acceptance.expected(TABLE, "1") == ["b", "c"]


def test_symbol_by_symbol(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate(([("x", "a"), ("y", "b")], [("x", "b"), ("y", "a")], [("x", "c")])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"key": a, "symbol": b}) for a, b in part))
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("key string, symbol string").option("maxFilesPerTrigger", 1).json(str(folder))
    out = []
    query = acceptance.follow(stream, "key", "symbol", TABLE, "0", ["2"]).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    last = {r.key: r for r in out}
    assert (last["x"].accepted_n, last["x"].complete, last["x"].error) == (3, True, "")
    assert last["y"].error == "b after 0 symbols; expected: a"


def feed(folder, parts):
    """One file for each batch, taken in this order."""
    folder.mkdir()
    for k, rows in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))


def test_states_expire(spark, tmp_path):
    """x stops half way, y is complete and z in error when their time is over; x begins anew afterwards."""
    row = lambda key, symbol, minute: {"key": key, "symbol": symbol, "at": f"2024-01-01T10:{minute:02}:00Z"}
    feed(tmp_path / "in", [[row("x", "a", 0), row("y", "a", 0), row("z", "b", 0)], [row("y", "c", 5), row("w", "a", 20)], [row("w", "b", 40)], [row("x", "b", 41), row("w", "c", 41)], [row("v", "a", 41)]])
    stream = spark.readStream.schema("key string, symbol string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = []
    followed = acceptance.follow(stream, "key", "symbol", TABLE, "0", ["2"], "at", 600)
    followed.writeStream.foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    gone = {r[1]: r[2:6] for r in out if r[6]}
    assert gone["x"] == (1, "1", False, "expired after 1 symbols; expected: b, c")
    assert gone["y"] == (2, "2", True, "") and gone["z"][3] == "b after 0 symbols; expected: a"
    anew = [r for r in out if r[1] == "x" and not r[6]]
    assert anew[-1][2:6] == (0, "0", False, "b after 0 symbols; expected: a")
    assert [r[2:6] for r in out if r[1] == "w" and not r[6]][-1] == (3, "2", True, "")


def test_late_events_join_sessions_or_are_dropped(spark, tmp_path):
    row = lambda user, hour, minute=0: {"user": user, "at": f"2024-01-01T{hour:02}:{minute:02}:00Z"}
    # after the first batch the watermark is 11:00, which holds for late rows from the third one on: 10:20 is too late, 11:10 is in time
    feed(tmp_path / "in", [[row("a", 10), row("a", 11, 30), row("b", 13)], [row("b", 13)], [row("a", 10, 20), row("a", 11, 10)], [row("c", 23)], [row("c", 23, 1)]])
    stream = spark.readStream.schema("user string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = []
    sessions = segments.session_counts(stream, "user", "at", "30 minutes", "2 hours")
    sessions.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    found = sorted((r.user, r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.n) for r in out)
    assert found == [("a", "10:00", "10:30", 1), ("a", "11:10", "12:00", 2), ("b", "13:00", "13:30", 2)]
