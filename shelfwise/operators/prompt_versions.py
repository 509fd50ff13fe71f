"""Prompts by content, so that replies are not taken for what a product was before.

A prompt is told by its task and the hash of its text. Products with the same prompt share its
replies, and a product whose prompt has changed has none yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import PAIRING_ATTEMPTS
from shelfwise.functions.replies import pairing_items

#: Of replies to prompts: ``attempt`` counts from 1.
VERSIONED_REPLY_SCHEMA = "task string, prompt_hash string, attempt int, reply string"


def with_hash(prompts: DataFrame) -> DataFrame:
    """Prompts (barcode, task, prompt) with ``prompt_hash``."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256))


def current_replies(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """(barcode, task, attempt, reply): the replies to the prompts that products have now.

    The shape is that of the reply table the jobs read. Replies to earlier prompts stay in
    ``replies`` and match nothing. A prompt that very many products share is split by adaptive
    execution on the products' side.
    """
    asked = with_hash(prompts).select("barcode", "task", "prompt_hash")
    return asked.join(replies, ["task", "prompt_hash"]).select("barcode", "task", "attempt", "reply")


def _usable() -> Column:
    """Whether a reply ends the asking: of pairings one that holds any, of others any text."""
    items = F.size(F.when(F.col("task") == "pairings", pairing_items(F.col("reply"))))
    return F.coalesce(F.when(F.col("task") == "pairings", items > 0).otherwise(F.col("reply").isNotNull()), F.lit(False))


def unanswered(prompts: DataFrame, replies: DataFrame, attempts: int = PAIRING_ATTEMPTS) -> DataFrame:
    """(task, prompt_hash, prompt, attempt): what is still to be asked, each prompt once.

    A prompt is left out as soon as a usable reply to it is there, or after ``attempts`` tries;
    ``attempt`` is the number of the next one.
    """
    tries = replies.groupBy("task", "prompt_hash").agg(
        F.max(_usable()).alias("answered"), F.max(F.coalesce("attempt", F.lit(1))).alias("tried")
    )
    distinct = with_hash(prompts).groupBy("task", "prompt_hash").agg(F.min("prompt").alias("prompt"))
    open_tries = F.coalesce("tried", F.lit(0))
    return (
        distinct.join(tries, ["task", "prompt_hash"], "left")
        .filter(~F.coalesce("answered", F.lit(False)) & (open_tries < attempts))
        .select("task", "prompt_hash", "prompt", (open_tries + 1).alias("attempt"))
    )
