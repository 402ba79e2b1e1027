"""Chat turns to request bodies, agent replies to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlens.functions import texts


def conversation_payload(turns: DataFrame, max_output_tokens: int = 1000) -> DataFrame:
    """The JSON request body of each conversation, one piece per turn.

    The pieces of a conversation, put together in the order of their turns, are its body: the
    first opens it, the last closes it. No task gathers a conversation, whatever its
    length. Turn numbers must be unique within a conversation; a turn without one is an error.
    """
    number = F.coalesce(F.col("turn"), F.raise_error(F.lit("a turn has no number")).cast("bigint"))
    pieces = turns.select("conv_id", number.alias("turn"), texts.turn_json(F.col("role"), F.col("content")).alias("json"))
    ends = turns.groupBy(F.col("conv_id").alias("of")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    opening = F.when(F.col("turn") == F.col("first"), '{"input":[').otherwise(",")
    closing = F.when(F.col("turn") == F.col("last"), f'],"max_output_tokens":{max_output_tokens}}}').otherwise("")
    return pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "turn", F.concat(opening, "json", closing).alias("piece")
    )


def response_text(responses: DataFrame, status: str | None = None) -> DataFrame:
    """Answer of each reply; `status` names the HTTP status column, if there is one."""
    code = F.col(status) if status else None
    return responses.withColumn("answer", texts.answer_text(F.col("body"), code))
