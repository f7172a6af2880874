"""Sessions and their step log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: days of an age unit.
DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def _latest(*values: str) -> list[Column]:
    """The values of a group's last step, by start and then id."""
    last = F.max_by(F.struct(*values), F.struct("started_at", "step_id"))
    return [last.getField(v).alias(f"last_{v}") for v in values]


def last_step(steps: DataFrame) -> DataFrame:
    """The last step of each session."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("started_at"), F.desc("step_id")))
    return steps.withColumn("rn", rank).filter("rn = 1").drop("rn")


def session_states(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Sessions by state; a session whose last step is pending, or without steps, is in progress."""
    last = steps.groupBy("session_id").agg(*_latest("status"))
    state = F.when(F.coalesce("last_status", F.lit("pending")) == "pending", "in-progress").otherwise(F.col("last_status"))
    return sessions.join(last, "session_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def session_stats(sessions: DataFrame, steps: DataFrame, components: DataFrame) -> DataFrame:
    """One row: sessions by state, steps and components in all, oldest and newest start."""
    last = steps.groupBy("session_id").agg(*_latest("status"))
    of = lambda s: F.count_if(F.col("last_status") == s)
    states = sessions.join(last, "session_id", "left").agg(
        F.count("*").alias("sessions"),
        of("complete").alias("complete"),
        of("failed").alias("failed"),
        of("interrupted").alias("interrupted"),
        F.count_if(F.coalesce("last_status", F.lit("pending")) == "pending").alias("in_progress"),
    )
    totals = steps.agg(F.count("*").alias("steps"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))
    return states.crossJoin(totals).crossJoin(components.agg(F.count("*").alias("components")))  # one row each


def latest_session(sessions: DataFrame, steps: DataFrame, command: str) -> DataFrame:
    """The session of the last completed step of a command: no row if there is none."""
    done = steps.filter((F.col("command") == command) & (F.col("status") == "complete")).join(sessions, "session_id")
    return done.agg(F.max_by("session_id", F.struct("started_at", "step_id")).alias("session_id")).filter("session_id IS NOT NULL")


def session_list(sessions: DataFrame, steps: DataFrame, limit: int, status: str | None = None, show_interrupted: bool = False) -> DataFrame:
    """Newest sessions with step count and last step. The limit comes before the status filter."""
    log = steps.groupBy("session_id").agg(F.count("*").alias("steps"), F.min("started_at").alias("created_at"), *_latest("command", "status"))
    listed = sessions.join(log, "session_id", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    listed = listed.orderBy(F.desc_nulls_last("created_at"), "session_id").limit(limit)
    if status is not None:
        return listed.filter(F.col("last_status") == status)
    return listed if show_interrupted else listed.filter(~F.col("last_status").eqNullSafe("interrupted"))


def session_steps(steps: DataFrame, session_id) -> DataFrame:
    """A session's steps, numbered in order, their inputs decoded."""
    own = steps.filter(F.col("session_id") == session_id)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("started_at", "step_id"))
    return own.withColumn("number", number).withColumn("inputs", F.from_json("inputs", "map<string,string>"))


def interrupt_stale_steps(steps: DataFrame) -> DataFrame:
    """A pending step becomes interrupted when the session starts a later step of the same command."""
    later = F.lead("started_at").over(Window.partitionBy("session_id", "command").orderBy("started_at", "step_id"))
    stale = (F.col("status") == "pending") & later.isNotNull()
    return steps.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def prune_sessions(sessions: DataFrame, steps: DataFrame, now, session_id=None, older_than: str | None = None, status: str | None = None) -> DataFrame:
    """Sessions with `deleted`: those that meet all criteria given. older_than is a number and d, w, m or y; status that of the last step."""
    log = steps.groupBy("session_id").agg(F.min("started_at").alias("created_at"), *_latest("status"))
    gone = F.lit(session_id is not None or older_than is not None or status is not None)
    if session_id is not None:
        gone &= F.col("session_id") == session_id
    if older_than is not None:
        cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(int(older_than[:-1]) * DAYS[older_than[-1]]))
        gone &= F.coalesce(F.col("created_at") < cutoff, F.lit(False))
    if status is not None:
        gone &= F.col("last_status").eqNullSafe(status)
    return sessions.join(log.select("session_id", "created_at", "last_status"), "session_id", "left").withColumn("deleted", gone)


def without_pruned(children: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows of a child table whose session stays."""
    return children.join(pruned.filter("deleted").select("session_id"), "session_id", "left_anti")


def command_lifecycle(events: DataFrame) -> DataFrame:
    """Each invocation with the event that ended it: outcome ok, error, interrupted (a failure with exit_code 130) or open, and seconds between.

    An invocation ends with the next completed or failed event of its session before the next invocation.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    run = F.count_if(F.col("kind") == "invoked").over(order)
    ended = F.when(F.col("kind").isin("completed", "failed"), F.struct("ts", "event_id", "kind", "exit_code"))
    runs = events.withColumn("run", run).filter("run > 0").groupBy("session_id", "run").agg(
        F.min(F.when(F.col("kind") == "invoked", F.col("ts"))).alias("started_at"), F.min(ended).alias("ended")
    )
    outcome = F.when(F.col("ended.kind") == "completed", "ok").when(F.col("ended.exit_code") == 130, "interrupted").when(F.col("ended.kind") == "failed", "error").otherwise("open")
    seconds = (F.unix_micros(F.col("ended.ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.select("session_id", "run", "started_at", outcome.alias("outcome"), seconds.alias("seconds"))


def session_started_once(events: DataFrame) -> DataFrame:
    """The first start of each session."""
    starts = events.filter("kind = 'started'")
    return starts.groupBy("session_id").agg(F.min(F.struct("ts", "event_id")).alias("s")).select("session_id", "s.ts", "s.event_id")
