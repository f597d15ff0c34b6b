"""Column functions over ``array<struct<role, content>>`` message columns.

For requests that already carry their messages in one row. Conversations kept
as one row per turn are handled by ``operators.dialogue`` without building an
array per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_query(messages: Column) -> Column:
    """Content of the last message; null for no messages."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def history(messages: Column) -> Column:
    """All messages but the last."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def history_messages(messages: Column) -> Column:
    """History limited to what the user and the assistant said."""
    return F.filter(history(messages), lambda m: m["role"].isin("user", "assistant"))


def message_line(role: Column, content: Column) -> Column:
    """``User: ...`` or ``Assistant: ...``; null for other roles and empty assistant turns."""
    return (
        F.when(role == "user", F.concat(F.lit("User: "), content))
        .when((role == "assistant") & (content != ""), F.concat(F.lit("Assistant: "), content))
    )


def format_history(messages: Column) -> Column:
    spoken = F.transform(history(messages), lambda m: message_line(m["role"], m["content"]))
    return F.array_join(spoken, "\n")


def needs_rewrite(messages: Column) -> Column:
    """Only a question with something before it can depend on it."""
    return F.size(messages) > 1


def drop_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def build_prompt(system: Column, messages: Column) -> Column:
    """System message, spoken history, then the question."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    spoken = F.transform(history_messages(messages),
                         lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.concat(F.array(message("system", system)), spoken, F.array(message("user", last_query(messages))))
