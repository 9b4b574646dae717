"""Advisory prompts from decided facts, batch model calls, and reply checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fixed_values as V
from ..functions import text
from ..schemas import REPLY
from ..session import names_in
from .review_queue import one_per_key
from .spread import join_unique, number_rows

# The advised actions, most cautious first.
CAUTION = V.ADVISORY_ACTIONS

# Flags in one part of a text.  The n-th flag of a compound is in part (n - 1) div FLAGS_PER_PROMPT + 1.
FLAGS_PER_PROMPT = 1000


def breach_texts(flags: DataFrame, per_part: int = FLAGS_PER_PROMPT) -> DataFrame:
    """Breaches and distinct reasons of each compound's flags as text.

    Flags are listed in a fixed order, ``per_part`` to a row, so a compound's text
    stays whole and its rows bounded.  A reason is listed once per compound, in
    the part of the first flag that has it; a part without a new one has ''.
    """
    placed = number_rows(
        flags.where("is_flagged").select(
            "compound_id", "reading_id", "assay_name", "result_value", "threshold", "margin", "reason"),
        ["assay_name", "margin", "reading_id"], group=["compound_id"], group_size="n_flags",
    )
    part = f"CAST(floor((position - 1) / {per_part}) + 1 AS INT) AS part"
    breach = text.fill(
        "{assay} {value} vs threshold {threshold} (margin {margin})",
        assay="assay_name", value="round(result_value, 3)", threshold="threshold",
        margin="round(margin, 3)",
    )
    # Reasons are made distinct over the whole compound before they are dealt to parts.
    first = placed.groupBy("compound_id", "reason").agg(F.expr("min(position) AS position"))
    listed = placed.selectExpr("compound_id", "position", "n_flags", f"{breach} AS breach", "NULL AS reason")
    lines = listed.unionByName(first.selectExpr(
        "compound_id", "position", "NULL AS n_flags", "NULL AS breach", "reason"))
    return (
        lines.selectExpr("*", part)
        .groupBy("compound_id", "part")
        .agg(F.expr("max(n_flags) AS n_flags"),
             F.expr("array_sort(collect_list(CASE WHEN breach IS NOT NULL THEN struct(position, breach) END)) AS told"),
             F.expr("array_sort(collect_list(CASE WHEN reason IS NOT NULL THEN struct(position, reason) END)) AS why"))
        .selectExpr(
            "compound_id", "part", "n_flags",
            "array_join(told.breach, '; ') AS breaches", "array_join(why.reason, ' || ') AS reason_text",
        )
    )


def recommendation_prompts(
    flags: DataFrame, correlation: DataFrame, as_of: datetime, model_label: str,
    per_part: int = FLAGS_PER_PROMPT, hot_rows: int | None = None,
) -> DataFrame:
    """One grounded prompt per flagged compound (and part), with audit columns."""
    signal = correlation.select("compound_id", "correlation_state", "n_adverse_obs", "signal_detail")
    joined = join_unique(
        breach_texts(flags, per_part), signal, ["compound_id"], spread=["part"], hot_rows=hot_rows
    )
    state = f"coalesce(correlation_state, '{V.NO_MAPPING}')"
    prompt = text.prompt(
        "compound_id", "n_flags", "reason_text", "breaches", state, "n_adverse_obs", "signal_detail")
    return joined.selectExpr(
        "compound_id", "part", "n_flags",
        f"{state} AS correlation_state",
        "n_adverse_obs",
        f"{prompt} AS recommendation_input",
        f"{text.quote(model_label)} AS model_endpoint",
        f"{text.stamp(as_of)} AS generated_ts",
    )


def recommend(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Prompts with the model's replies.

    ``model`` maps a batch of prompt texts to reply texts and runs on the
    executors, one Arrow batch at a time.
    """
    schema = StructType([*prompts.schema.fields, StructField("recommendation", StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(recommendation=model(batch["recommendation_input"]).to_numpy())

    return prompts.mapInPandas(call, schema)


REPLY_KEY = ("prompt_hash", "model_endpoint")


def prompt_hash(prompt: str = "recommendation_input") -> str:
    """SQL for the name of a prompt text."""
    return f"sha2({prompt}, 256)"


def kept_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The replies kept under ``folder``, one per prompt text and model."""
    if not names_in(spark, folder):
        return spark.createDataFrame([], REPLY)
    return one_per_key(spark.read.schema(REPLY).parquet(folder), REPLY_KEY)


def recommend_kept(prompts: DataFrame, model: Callable[[pd.Series], pd.Series], folder: str) -> DataFrame:
    """Prompts with replies, of which only those without a kept one go to the model.

    A reply is known by the hash of its prompt text and the label of its model, so another model, or a prompt that
    changed in one number, is asked anew, and equal prompts are asked once.  New replies are appended to ``folder``
    in one write before they are used: a run that fails in it keeps none of them, one that fails later all.  A NULL prompt
    isn't asked and has no reply; a NULL reply of the model is kept as such.
    """
    spark = prompts.sparkSession
    asked = prompts.where("recommendation_input IS NOT NULL").selectExpr(
        f"{prompt_hash()} AS prompt_hash", "model_endpoint", "recommendation_input").dropDuplicates(list(REPLY_KEY))
    new = asked.join(kept_replies(spark, folder).select(*REPLY_KEY), list(REPLY_KEY), "left_anti")
    recommend(new, model).select(*REPLY.fieldNames()).write.mode("append").parquet(folder)
    told = kept_replies(spark, folder).withColumnRenamed("prompt_hash", "_hash")
    named = prompts.withColumn("_hash", F.expr(prompt_hash()))
    return named.join(told, ["_hash", "model_endpoint"], "left").select(*prompts.columns, "recommendation")


def one_action(checked: DataFrame) -> DataFrame:
    """One row per compound: the most cautious valid action over the parts of its prompt.

    Caution follows the order of ``CAUTION``, ties the first part; ``is_valid``
    says whether any reply kept the format, and without one action and rationale are NULL.
    """
    rank = " ".join(f"WHEN {text.quote(a)} THEN {k}" for k, a in enumerate(CAUTION))
    best = f"min_by(struct(action, rationale), struct(CASE action {rank} END AS rank, part)) FILTER (WHERE is_valid)"
    return checked.groupBy("compound_id").agg(
        F.expr(f"{best} AS best"), F.expr("bool_or(is_valid) AS is_valid"), F.expr("count(1) AS n_parts"),
    ).selectExpr("compound_id", "best.action AS action", "best.rationale AS rationale", "is_valid", "n_parts")


def checked_replies(recommended: DataFrame) -> DataFrame:
    """Action and rationale of each reply, and whether it kept the format."""
    reply = "recommendation"
    return recommended.selectExpr(
        "*",
        f"{text.reply_action(reply)} AS action",
        f"{text.reply_rationale(reply)} AS rationale",
        f"{text.reply_valid(reply)} AS is_valid",
    )
