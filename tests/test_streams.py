"""Streams that keep state: reducers with a deadline, an audit chain over restarts, job states; and their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import governance, jobs, summaries
from lodestone.streaming import reducers, sinks


def put(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-tmp-{name}")
    part = next(f for f in os.listdir(f"{folder}-tmp-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-tmp-{name}/{part}", f"{folder}/{name}.parquet")


CHILD = "parent long, child string, total int, ts timestamp"
RESULT = "parent long, child string, ok boolean, ts timestamp"


def at(s):
    import datetime

    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def test_reducers_wait_for_children_or_the_deadline(spark, tmp_path):
    kids, ends, out, check = (str(tmp_path / x) for x in ("kids", "ends", "out", "check"))
    put(spark, kids, [(p, f"{p}-{c}", n, at(0)) for p, n in ((1, 2), (2, 2), (3, 3), (4, 1)) for c in range(n)], CHILD, "a")
    put(spark, ends, [(1, "1-0", True, at(5)), (1, "1-0", True, at(6)), (2, "2-0", True, at(5)), (3, "3-0", None, at(5)), (4, "4-0", False, at(7))], RESULT, "a")

    def run():
        read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        stream = reducers.decisions(read(kids, CHILD), read(ends, RESULT), 60)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert run() == [(4, "reduce", 0, 0, 1)]
    put(spark, ends, [(1, "1-1", True, at(30)), (3, "3-1", True, at(31))], RESULT, "b")
    assert run() == [(1, "reduce", 0, 2, 0), (4, "reduce", 0, 0, 1)]
    put(spark, kids, [(9, "9-0", 5, at(300))], CHILD, "c")  # time goes on
    put(spark, ends, [(9, "9-0", True, at(301))], RESULT, "c")
    run()
    put(spark, kids, [(9, "9-1", 5, at(302))], CHILD, "d")
    put(spark, ends, [(2, "2-1", True, at(303))], RESULT, "d")  # after 2 was given up
    got = run()
    assert got == [(1, "reduce", 0, 2, 0), (2, "partial", 1, 1, 0), (3, "partial", 2, 1, 0), (4, "reduce", 0, 0, 1)]
    # The batch form over what was there when the deadline passed says the same.
    c = spark.read.parquet(kids).where("parent < 9").select("parent", "child")
    r = spark.read.parquet(ends).where("ts < timestamp'2026-01-01 00:05:00'")
    found = r.where("ok IS NULL OR ok").select("child", F.when(F.col("ok"), "{}").alias("payload")).distinct()
    states = r.where("NOT ok").select("child", F.lit("failed").alias("state"))
    want = summaries.reducer_action(summaries.child_outcomes(c, found, states), F.lit(60)).select("parent", "action", "pending")
    assert sorted(tuple(x) for x in want.collect()) == [x[:3] for x in got]


EVENT = "chain string, at long, actor string, role string, action string, outcome string, job_id string"


def test_audit_chain_goes_on_over_restarts(spark, tmp_path):
    source, out, check, archive = (str(tmp_path / x) for x in ("in", "out", "check", "archive"))
    put(spark, source, [("a", i, "me", "user", f"act {i}", "ok", "j") for i in range(5)] + [(None, 1, "x", "y", "z", "ok", "j")] + [("a", 2, "me", "user", "act 2", "ok", "j")], EVENT, "a")

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.audit_chain(stream, out, check).awaitTermination()
        return spark.read.parquet(f"{out}/events")

    assert run().count() == 7
    put(spark, source, [("a", 9, "me", "user", "late", "ok", "j"), ("b", 1, "you", "user", "new <chain>", "ok", "j")], EVENT, "b")
    rows = sorted(((r.chain or "", r.seq, r.prev_hash, r.event_hash) for r in run().collect()))
    assert [r[:2] for r in rows] == [("", 1), *(("a", i) for i in range(1, 8)), ("b", 1)]
    assert all(r.valid for r in sinks.checked(spark.read.parquet(f"{out}/events")).collect())
    for name in ("1", ".1.crc"):  # a loss before the commit: the batch runs again
        os.remove(f"{check}/commits/{name}")
    assert sorted(((r.chain or "", r.seq, r.prev_hash, r.event_hash) for r in run().collect())) == rows
    put(spark, source, [("a", 10, "me", "user", "third", "ok", "j")], EVENT, "c")
    run()
    sinks.rotate(spark, out, archive, 2)
    kept = spark.read.parquet(f"{archive}/events")
    assert kept.count() == 3 and {r.chain: r.valid for r in sinks.checked(kept).collect()} == {"a": True, "b": True}
    forged = kept.withColumn("action", F.when(F.col("seq") == 7, "forged").otherwise(F.col("action")))
    assert {r.chain: r.valid for r in sinks.checked(forged).collect()} == {"a": False, "b": True}
    cut = kept.where("seq <> 7")
    assert not next(r.valid for r in sinks.checked(cut).collect() if r.chain == "a")
    assert governance.verify(kept.drop("anchor"), "chain", "seq").where("chain = 'a'").first().valid is False  # without its anchor


def test_job_states_are_those_of_the_batch(spark, tmp_path):
    schema = "job_id long, state string, at timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [(1, "queued", at(0)), (1, "running", at(5)), (2, "running", at(1)), (2, "succeeded", at(9)), (3, "lost in space", at(1)), (None, "running", at(1)), (4, "running", None)]
    second = [(1, "running", at(3)), (1, "failed", at(20)), (2, "succeeded", at(9)), (2, "running", at(4)), (5, "cancelled", at(2))]
    states = ["queued", "running", "succeeded", "failed", "cancelled"]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.job_states(stream, out, check, states).awaitTermination()
        return sorted(tuple(r) for r in sinks.current_states(spark, out).collect())

    os.makedirs(source)
    assert run() == []
    put(spark, source, first, schema, "a")
    assert [r[:2] for r in run()] == [(1, "running"), (2, "succeeded")]
    put(spark, source, second, schema, "b")
    got = run()
    sound = spark.createDataFrame([r for r in first + second if r[0] and r[2] and r[1] in states], schema)
    assert got == sorted(tuple(r) for r in jobs.transitions(sound).select("job_id", "state", "started_at", "completed_at").collect())
    assert run() == got and spark.read.parquet(f"{out}/rejected").count() == 3


@pytest.mark.parametrize("n", [0, 3])
def test_shard_lists_are_bounded(spark, n):
    rows = [(None if i % 2 else "g", i, [f"c{i % 3}", f"d{i}"], ["s"], f"start {i}", f"end {i}") for i in range(20)][: 20 if n else 0]
    shards = spark.createDataFrame(rows, "g string, i long, codes array<string>, next_steps array<string>, log_start string, failure string")
    got = {r.g: r for r in summaries.reduce_logs(shards, "g", "i", findings=3, timeline=3).collect()}
    if n:
        assert got["g"].codes == ["c0", "d0", "c2"] and got["g"].timeline == ["start 0", "end 0", "start 2"] and got["g"].next_steps == ["s"]
        assert got[None].shards == 10 and got[None].codes == ["c1", "d1", "c0"]
    else:
        assert got == {}
