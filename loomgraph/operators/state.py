"""Keyed state: get-or-create, conversation context, message retention, planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import planner_action


def get_or_create(state: DataFrame, keys: DataFrame, on: str, defaults: dict) -> DataFrame:
    """The state's rows and a default row for every key it lacks; existing rows are never changed.

    keys: a frame with the column ``on``; nulls are no keys. Missing keys come by an anti join.
    """
    new = keys.select(on).where(F.col(on).isNotNull()).distinct().join(state.select(on), on, "left_anti")
    rest = [F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in state.schema if f.name != on]
    return state.unionByName(new.select(on, *rest))


def conversation_context(sessions: DataFrame, episodic: DataFrame, procedural: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per session: the three memories and its messages in order.

    sessions: interview_id, user_id, ...; the others join on user_id and interview_id; absent memories are null.
    """
    whole = lambda df, *keys: F.struct(*[c for c in df.columns if c not in keys])
    m = messages.groupBy("interview_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))).alias("messages"))
    e = episodic.select("user_id", whole(episodic, "user_id").alias("episodic"))
    p = procedural.select("user_id", whole(procedural, "user_id").alias("procedural"))
    s = sessions.select("interview_id", "user_id", whole(sessions, "interview_id", "user_id").alias("session"))
    return s.join(e, "user_id", "left").join(p, "user_id", "left").join(m, "interview_id", "left")


def retain_messages(messages: DataFrame, key: str, order: list, more_than: int = 30, keep: int = 5) -> DataFrame:
    """The last ``keep`` messages of sequences longer than ``more_than``; shorter ones whole. Adds message_no from the end.

    Long sequences are cut by their rank, which Catalyst also applies before the shuffle, so none is sorted whole in one task.
    Null keys are no sequences.
    """
    known = messages.where(F.col(key).isNotNull())
    long = known.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > more_than).select(key)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    ends = known.join(long, key, "left_semi").withColumn("message_no", n).where(F.col("message_no") <= keep)
    return known.join(long, key, "left_anti").withColumn("message_no", n).unionByName(ends)


def plan_actions(states: DataFrame, sessions: DataFrame, on: str) -> DataFrame:
    """Each state with the action for its skill, and the result in hand or else the session's last one."""
    joined = states.join(sessions.select(on, "last_eval_result"), on, "left")
    return joined.select(on, "skill", planner_action(F.col("skill")).alias("action"), F.coalesce("execution_result", "last_eval_result").alias("evaluation"))
