"""Multi-turn dialogs as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import as_text

CANDIDATES = ("history", "conversation_a", "conversation_b", "conversations", "messages")


def _turn(user: Column, bot: Column) -> Column:
    return F.concat(F.lit("user: "), as_text(user), F.lit("\n\nassistant: "), as_text(bot))


def dialog_column(df: DataFrame, content: str | None = None) -> str:
    """The configured dialog column, else the first known name that holds a list."""
    if content:
        return content
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in CANDIDATES:
        if isinstance(kinds.get(name), T.ArrayType):
            return name
    raise ValueError(f"no dialog column among {df.columns}")


def flatten_dialog(df: DataFrame, content: str | None = None) -> DataFrame:
    """Replace the list of turns by its text; works on user/bot and on role/content turns."""
    name = dialog_column(df, content)
    kind = df.schema[name].dataType
    keys = set(kind.elementType.names) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else set()
    if {"user", "bot"} <= keys:
        turn = lambda t: _turn(t["user"], t["bot"])
    elif {"role", "content"} <= keys:
        turn = lambda t: _by_role(t["role"], t["content"])
    else:
        raise ValueError(f"unsupported dialog turns in {name}: {sorted(keys)}")
    return df.withColumn(name, F.array_join(F.transform(name, turn), "\n\n"))


def _by_role(role: Column, text: Column) -> Column:
    bot = F.coalesce(role == "assistant", F.lit(False))
    return _turn(F.when(~bot, text), F.when(bot, text))


def dialogs_from_turns(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One text per dialog out of a table with one row per turn."""
    line = _by_role(F.col(role), F.col(text))
    rows = turns.select(key, F.struct(F.col(order).alias("o"), line.alias("t")).alias("x"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        key, F.array_join(F.col("x.t"), "\n\n").alias("content"))
