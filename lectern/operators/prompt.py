"""Few-shot labelling as table steps: render chat prompts, call a generator, read the answer.

Rendering and parsing are built-in expressions. The generator is the one Python step:
a user function over pandas batches (``mapInPandas``), loaded once per worker, that
receives ``category`` and the rendered ``messages`` and returns the answer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import templates as TP

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render(df: DataFrame, templates: DataFrame, text_col: str = "text", category_col: str = "category",
           out_col: str = "messages") -> DataFrame:
    """Adds the six-message chat for each row's category (templates broadcast; one per category)."""
    t = F.broadcast(templates.withColumnRenamed("category", category_col))  # one row per category
    task = F.replace(F.replace(F.lit(TP.TASK_TEXT), F.lit("{title}"), F.col("title")),
                     F.lit("{question}"), F.col("question"))
    examples = F.replace(F.replace(F.lit(TP.EXAMPLES_TEXT), F.lit("{yes_example}"), F.col("yes_example")),
                         F.lit("{no_example}"), F.lit(TP.NO_EXAMPLE))
    messages = F.array(
        _msg("system", F.lit(TP.SYSTEM_TEXT)), _msg("user", task),
        _msg("assistant", F.lit(TP.ASK_EXAMPLES_TEXT)), _msg("user", examples),
        _msg("assistant", F.lit(TP.READY_TEXT)),
        _msg("user", F.concat(F.lit(TP.FINAL_PREFIX), F.coalesce(F.col(text_col), F.lit("")))))
    return (df.join(t, category_col)
            .withColumn(out_col, messages)
            .drop("title", "question", "yes_example"))


def prompt_text(messages: Column) -> Column:
    """One string per chat, ``role: content`` lines."""
    return F.concat_ws("\n", F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])))


def generate(df: DataFrame, generator: Callable[[pd.DataFrame], pd.Series],
             id_cols=("row_id", "category"), messages_col: str = "messages",
             out_col: str = "chat", text_col: str = "text") -> DataFrame:
    """Runs ``generator`` on Arrow batches and appends its answer as a seventh message.

    Rows pass through the Python step unchanged (no join back, no second scan); only
    the answer column is added. ``text_col`` is dropped first: the last message holds it.
    """
    from ..session import ship_package
    ship_package(df.sparkSession)
    df = df.drop(text_col)
    schema = T.StructType(df.schema.fields + [T.StructField("_answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["_answer"] = pd.Series(generator(pdf), index=pdf.index).astype(object)
            yield pdf

    answered = df.mapInPandas(run, schema)
    chat = F.concat(F.col(messages_col), F.array(_msg("assistant", F.col("_answer"))))
    return answered.withColumn(out_col, chat).drop("_answer")


def answer(chat: Column, position: int = 6) -> Column:
    """Content of the message at ``position`` (0-based); null when the chat is shorter."""
    return F.get(chat, position)["content"]


def parse_yes(text: Column, tag: str = TP.YES_TAG) -> Column:
    """1 when the answer contains the yes tag, else 0 (null answers count as 0)."""
    return F.coalesce(F.contains(text, F.lit(tag)), F.lit(False)).cast("int")
