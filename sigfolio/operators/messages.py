"""Prompt, chat-message, request and response records as columns.

All JVM expressions (``concat``, ``array(struct)``, ``to_json`` /
``from_json``): building a million training records is a map stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfolio.functions._util import as_col
from sigfolio.functions.text import fill_template, row_to_text

# Fixed values of the reference configuration.
PROMPT_TEMPLATE = ("Classify the paragraph '{}' into one of these categories: {}; "
                   "only give name of the class")
SYSTEM_MESSAGE = ("Ensure that the generated output aligns with one of the predefined categories provided. "
                  "Avoid generating content that does not belong to any of these specified categories.")
COLUMN_MAP = {"item_1": "item_1", "item_1a": "item_1a", "item_7a": "item_7a", "truth": "true_category"}
TRUE_CATEGORY = "true_category"
MODEL_PARAMS = {"max_tokens": 100, "model_type": "gpt-4o-mini-2024-07-18", "temperature": 0.7, "top_p": 1}
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"

RECORD_SCHEMA = "struct<messages: array<struct<role: string, content: string>>>"
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", MESSAGE)])))]))]))])


def build_prompt(text, categories, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill the two-slot template with the text and the categories: a list
    (sorted, joined with ', ') or a Column holding the joined string."""
    cats = categories if isinstance(categories, Column) else F.lit(", ".join(sorted(categories)))
    return fill_template(template, as_col(text), cats)


def data_categories(df: DataFrame, truth: str, config: Sequence[str] | None = None) -> Column:
    """Distinct lower-cased truth labels (intersected with the configured
    categories when given), sorted and joined -- a scalar subquery, so the
    label set never passes through the driver."""
    labels = F.collect_set(F.lower(F.col(truth)))
    if config:
        labels = F.array_intersect(labels, F.array(*[F.lit(c.lower()) for c in config]))
    return df.agg(F.array_join(F.array_sort(labels), ", ")).scalar()


def build_messages(prompt, system: str | None = SYSTEM_MESSAGE, truth=None) -> Column:
    """[system?, user, assistant?] as array<struct<role, content>>."""
    msgs = []
    if system:
        msgs.append(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    msgs.append(F.struct(F.lit("user").alias("role"), as_col(prompt).alias("content")))
    if truth is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), as_col(truth).alias("content")))
    return F.array(*msgs)


def training_records(df: DataFrame, text_cols: Sequence[str], categories: Sequence[str] | None = None,
                     truth: str = TRUE_CATEGORY, system: str | None = SYSTEM_MESSAGE,
                     keep: Sequence[str] = (), config: Sequence[str] | None = None) -> DataFrame:
    """One ``{"messages": [...]}`` JSON line per row; the truth column is the
    assistant answer and is not part of the prompt text.  Without explicit
    ``categories`` the prompt lists the labels found in the truth column
    (intersected with ``config``)."""
    if categories is None:
        categories = data_categories(df, truth, config)
    text = row_to_text([c for c in text_cols if c != truth])
    msgs = build_messages(build_prompt(text, categories), system, F.col(truth))
    return df.select(*keep, F.to_json(F.struct(msgs.alias("messages"))).alias("value"))


def batch_requests(df: DataFrame, key: str, text_cols: Sequence[str], categories: Sequence[str],
                   params: Mapping = MODEL_PARAMS, system: str | None = SYSTEM_MESSAGE) -> DataFrame:
    """Numbered request envelopes (custom_id = the row's stable key)."""
    text = row_to_text(list(text_cols))
    msgs = build_messages(build_prompt(text, categories), system)
    body = F.struct(F.lit(params["max_tokens"]).alias("max_tokens"), F.lit(params["model_type"]).alias("model"),
                    msgs.alias("messages"), F.lit(params["temperature"]).alias("temperature"),
                    F.lit(params["top_p"]).alias("top_p"))
    env = F.struct(F.col(key).cast("string").alias("custom_id"), F.lit(REQUEST_METHOD).alias("method"),
                   F.lit(REQUEST_URL).alias("url"), body.alias("body"))
    return df.select(F.col(key).cast("string").alias("custom_id"), F.to_json(env).alias("value"))


def unwrap_responses(lines: DataFrame, value: str = "value") -> DataFrame:
    """(custom_id, content) from response JSON lines: the first choice."""
    r = lines.select(F.from_json(value, RESPONSE_SCHEMA).alias("r"))
    return r.select(F.col("r.custom_id").alias("custom_id"),
                    F.col("r.response.body.choices").getItem(0)["message"]["content"].alias("content"))


def order_responses(df: DataFrame, key: str = "custom_id") -> DataFrame:
    """Responses sorted by numeric id (a range-partitioned sort)."""
    return df.orderBy(F.col(key).try_cast("long"), F.col(key))


def response_lines(df: DataFrame, key: str, content: str) -> DataFrame:
    """Render (id, content) as response JSON lines (the answer format)."""
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), F.col(content).alias("content")).alias("message"))
    env = F.struct(F.col(key).cast("string").alias("custom_id"),
                   F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))
    return df.select(F.to_json(env).alias("value"))
