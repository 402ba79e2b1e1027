"""Labels, chat text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Any character that is not white space, Unicode spaces and separators included.
_VISIBLE = r"[^\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def has_text(value: Column) -> Column:
    return value.rlike(_VISIBLE)


def island_label(theme: Column, island_id: Column) -> Column:
    return F.concat(theme, F.lit(" Arena "), island_id.cast("string"))


def hover_label(city: Column, country: Column, sessions: Column, players: Column, minutes: Column) -> Column:
    """Multi-line place label. Minutes are rounded half-even to one decimal."""
    rounded = F.bround(minutes.cast("double"), 1).cast("decimal(18,1)").cast("string")
    return F.concat(
        city, F.lit(", "), country,
        F.lit("<br>🎮 Active Sessions: "), sessions.cast("string"),
        F.lit("<br>👥 Players: "), players.cast("string"),
        F.lit("<br>⏱ Avg Duration: "), rounded, F.lit(" min"),
    )


def turn_json(role: Column, content: Column) -> Column:
    """One chat turn as a JSON object; a missing content stays visible as null."""
    return F.to_json(
        F.struct(role.alias("role"), content.alias("content")), {"ignoreNullFields": "false"}
    )


def answer_text(body: Column, status: Column | None = None) -> Column:
    """Answer inside an agent's JSON reply.

    Tries the output list, then the choices list; any other body is reported whole. With an
    HTTP status other than 200 the body is an error text.
    """
    answer = F.coalesce(
        F.get_json_object(body, "$.output[0].content[0].text"),
        F.get_json_object(body, "$.choices[0].message.content"),
        F.concat(F.lit("❌ Error: Unexpected response format. Response: "), body),
    )
    if status is None:
        return answer
    failed = F.concat(F.lit("❌ API Error "), status.cast("string"), F.lit(": "), body)
    return F.when(status != 200, failed).otherwise(answer)
