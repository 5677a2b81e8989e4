"""The live session operators as streams over the events, against the same functions over the table."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quirework.plans import live as plans
from quirework.streaming import live
from quirework.streaming.cursors import Commands, after

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import shutil

    d = tmp_path_factory.mktemp("events")
    shutil.copy(f"{SF}/events.parquet", d / "part-0.parquet")
    return str(d)


def drain(stream, mode, tmp_path):
    """The last row of each batch for each key, by a memory table."""
    name = f"t{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_bursts(spark, folder, tmp_path):
    got = {tuple(r) for r in drain(live.edit_bursts(live.read_events(spark, folder, True)), "append", tmp_path)}
    want = {tuple(r) for r in live.edit_bursts(live.read_events(spark, folder)).collect()}
    assert got and got <= want  # sessions that the watermark hasn't passed are still open


def test_latest_generation(spark, folder, tmp_path):
    pick = lambda df: live.latest_generation(df.selectExpr("user_id as doc_id", "event_id as generation", "event_type as result"))
    got = {r.doc_id: tuple(r) for r in drain(pick(live.read_events(spark, folder, True)), "update", tmp_path)}
    assert got == {r.doc_id: tuple(r) for r in pick(live.read_events(spark, folder)).collect()}


def test_reply_deadlines(spark, folder, tmp_path):
    one = live.read_events(spark, folder, True)
    got = {tuple(r) for r in drain(live.reply_deadlines(plans.requests(one), plans.replies(live.read_events(spark, folder, True))), "append", tmp_path)}
    table = live.read_events(spark, folder)
    want = {tuple(r) for r in live.reply_deadlines(plans.requests(table), plans.replies(table)).collect()}
    assert got and got <= want and {r for r in want if r[1] is not None} <= got


@pytest.fixture(scope="module")
def mixed_folder(spark, tmp_path_factory):
    """The events in files of which each reaches some hours back into the one before, so that rows come out of order."""
    d = tmp_path_factory.mktemp("mixed")
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts").reset_index(drop=True)
    size = len(rows) // 5
    order = (rows.index + (rows["event_id"] % 3) * (size // 200)) // size
    for k, (_, part) in enumerate(rows.groupby(order)):
        f = d / f"part-{k}.parquet"
        spark.createDataFrame(part).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(d / f"w{k}"))
        next((d / f"w{k}").glob("*.parquet")).rename(f)
        os.utime(f, (1_000_000 + k, 1_000_000 + k))
    return str(d / "part-*.parquet")


def in_files(spark, path):
    """A stream that takes one file a micro-batch."""
    return spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def test_each_request_is_decided_once(spark, mixed_folder, tmp_path):
    one = lambda: in_files(spark, mixed_folder)
    got = [tuple(r) for r in drain(live.answered_requests(plans.requests(one()), plans.replies(one()), lateness="2 days"), "append", tmp_path)]
    table = live.read_events(spark, f"{SF}/events.parquet")
    asked = {r.request_id: r.asked_at for r in plans.requests(table).collect()}
    end = table.agg(F.max("ts")).first()[0] - dt.timedelta(days=2, hours=6)
    want = [tuple(r) for r in live.first_replies(live.reply_deadlines(plans.requests(table), plans.replies(table))).collect()]
    assert len({r[0] for r in got}) == len(got)
    assert sorted(got, key=str) == sorted((r for r in want if asked[r[0]] < end), key=str)
    assert {r[2] for r in got} == {True, False}


def test_live_cursor(spark, mixed_folder, tmp_path):
    own = lambda df: plans.commands(df).selectExpr("doc_id", "seq.ts as ts", "seq.event_id as event_id", "command")
    got = {r.doc_id: tuple(r) for r in drain(live.live_cursor_stream(own(in_files(spark, mixed_folder)), "2 days"), "update", tmp_path)}
    assert got == {r.doc_id: tuple(r) for r in live.live_cursor(plans.commands(live.read_events(spark, f"{SF}/events.parquet"))).collect()}


def fold(commands, cursor=0, undone=0):
    for c in commands:
        if c == "append":
            cursor, undone = cursor + 1, 0
        elif c == "undo" and cursor:
            cursor, undone = cursor - 1, undone + 1
        elif c == "redo" and undone:
            cursor, undone = cursor + 1, undone - 1
    return cursor, undone


def test_summaries_of_commands():
    for seed in range(400):
        rng = random.Random(seed)
        weights = [rng.random() * rng.choice([0.02, 1]), rng.random(), rng.random()]
        commands = rng.choices(["append", "undo", "redo"], weights, k=rng.randrange(80))
        own = Commands()
        for c in commands:
            own.add(c)
        runs, pieces = own.parts()
        for cursor in range(9):
            for undone in range(9):
                assert after((cursor, undone), runs, pieces) == fold(commands, cursor, undone)


def test_a_document_in_many_tasks(spark):
    commands = spark.range(60_000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "id as seq", "element_at(array('append', 'undo', 'redo', 'undo'), cast(pmod(xxhash64(id), 4) as int) + 1) as command")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.cursor, r.length) for r in live.live_cursor(commands).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen: dict = {}
    for r in commands.orderBy("seq").collect():
        seen.setdefault(r.doc_id, []).append(r.command)
    assert got == {d: (c, c + u) for d, (c, u) in ((d, fold(x)) for d, x in seen.items())}


def test_progress(spark, mixed_folder, tmp_path):
    seen: list[list[tuple]] = []
    live.follow_progress(plans.statuses(in_files(spark, mixed_folder)), lambda df, n: seen.append([tuple(r) for r in df.collect()]), str(tmp_path / "c")).awaitTermination()
    last = {r[0]: r for rows in seen for r in rows}
    assert len(seen) > 2 and set(last.values()) == {tuple(r) for r in live.batch_progress(plans.statuses(live.read_events(spark, f"{SF}/events.parquet"))).collect()}
    held: dict = {}
    for rows in seen:  # only what has changed is told
        assert len({r[0] for r in rows}) == len(rows) and all(held.get(r[0]) != r for r in rows)
        held |= {r[0]: r for r in rows}
