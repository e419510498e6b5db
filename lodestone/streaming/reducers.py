"""When a reducer of shards may start, as a stream: all children are there, or the deadline has passed.

The batch form is summaries.reducer_action. Here each parent has a state of five numbers, however many children it has,
and a timer of event time, so a replay decides as the first run did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decisions(children: DataFrame, results: DataFrame, deadline_s: int = 60, late: str = "10 seconds") -> DataFrame:
    """children (parent, child, total, ts): each names how many its parent has. results (parent, child, ok, ts): true where a child's result was read, false where it failed, null where the result is broken, which is still pending.

    A stream of one row a parent: reduce once every child is ready or failed, partial when the first of its children has
    waited deadline_s, with the numbers of that moment. The first outcome of a child counts, repeats within the
    watermark do not, and what comes after a decision changes nothing.
    """
    import pandas as pd

    registered = children.select("parent", "child", F.col("total").cast("long").alias("total"), F.lit(None).cast("boolean").alias("ok"), F.lit("child").alias("kind"), "ts")
    ended = results.where("ok IS NOT NULL").select("parent", "child", F.lit(0).cast("long").alias("total"), "ok", F.lit("result").alias("kind"), "ts")
    events = registered.unionByName(ended).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    events = events.dropDuplicatesWithinWatermark(["parent", "child", "kind"])

    def row(parent: int, action: str, total: int, ready: int, failed: int) -> pd.DataFrame:
        return pd.DataFrame({"parent": [parent], "action": [action], "pending": [max(0, total - ready - failed)], "ready": [ready], "failed": [failed]})

    def follow(key, frames, state):
        total, ready, failed, since, decided = state.get if state.exists else (0, 0, 0, -1, False)
        if state.hasTimedOut:
            state.remove()
            if not decided:
                state.update((total, ready, failed, since, True))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1000 * deadline_s)  # so long late rows find the decision
                yield row(key[0], "partial", total, ready, failed)
            return
        for pdf in frames:
            total = max(total, int(pdf["total"].max()))
            ended = pdf[pdf["kind"] == "result"]
            good = int((ended["ok"] == True).sum())  # noqa: E712  a column of booleans and nulls
            ready, failed = ready + good, failed + len(ended) - good
            began = pdf.loc[pdf["kind"] == "child", "ts"]
            if len(began):
                first = int(began.min().timestamp() * 1000)
                since = first if since < 0 else min(since, first)
        now = not decided and total > 0 and ready + failed >= total
        state.update((total, ready, failed, since, decided or now))
        due = since + 1000 * deadline_s if since >= 0 else state.getCurrentWatermarkMs() + 1000 * deadline_s
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if now:
            yield row(key[0], "reduce", total, ready, failed)

    state = "total long, ready long, failed long, since long, decided boolean"
    return events.groupBy("parent").applyInPandasWithState(follow, "parent long, action string, pending long, ready long, failed long", state, "append", "EventTimeTimeout")
