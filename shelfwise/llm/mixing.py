"""Mixing sources to target weights by iterative proportional fitting.

Token counts are raked to the target shares of source, language and topic at once. The
sums go into one table of cells (source, language, topic); fitting scales the cells of
each value of one dimension in turn until a whole round changes no cell any more. All three
margins hold then, if any weights can meet them; where none can, as when a source has a
language of its own and the two have different targets, the last dimension holds and the
others are as near as the fit comes, which ``residuals`` tells. Every cell ends with
one factor per token; documents are kept with probabilities in proportion to the factor
of their cell, by a hash of their id, so a rerun keeps the same ones.

Cells stay a distributed table. Sums over a margin are aggregations with partial sums,
so a source or language with most of the cells is no bottleneck, and each round of
fitting is written to the shared folder, which keeps plans short. Targets are joined to
the cells once, before the first round, so a round has one join for each dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage
from shelfwise.sources.sinks import Staging

DIMENSIONS = ("source", "lang", "topic")
#: Largest change of a cell in a round, against its weight, at which fitting ends.
TOLERANCE = 1e-13
#: Rounds at most: contradicting targets may go on changing very slowly.
MAX_ROUNDS = 200
#: Rounds after which the driver gives up what it holds of those before: plans, broadcast sums, shuffles.
SETTLE_ROUNDS = 4
#: Cells up to which a round is a single task: fewer are no work to share out, and cost the driver more than the executors.
TASK_CELLS = 1 << 16
#: Largest difference of a margin's share from a caller's target.
CLOSE = 1e-6
#: Share of all tokens to keep.
KEEP_SHARE = 0.3
#: Power that turns present shares into targets; 1 keeps the mix, 0 makes it even.
TEMPER = 0.7


def n_tokens(text: str = "text") -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    found = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return found.cast("long")


def _uniform(value: Column, digits: int = 12) -> Column:
    """A number from 0 to below 1 by the md5 of a text."""
    whole = F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("double")
    return whole / F.lit(float(16**digits))


def topic(text: str = "text") -> Column:
    """A rule-based label of what kind of text it is, where no topic model has labelled it.

    The first that fits of: legal (license and rights lines), contact (holds an at sign),
    table (cells between bars), note (under 300 characters), prose.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    legal = F.contains(given, F.lit("icense")) | F.contains(given, F.lit("ights reserved"))
    return (
        F.when(legal, "legal")
        .when(F.contains(given, F.lit("@")), "contact")
        .when(F.contains(given, F.lit(" | ")), "table")
        .when(F.length(given) < 300, "note")
        .otherwise("prose")
    )


def described(documents: DataFrame) -> DataFrame:
    """The documents with ``n_tokens`` and, unless there is such a column, ``topic``."""
    out = documents if "topic" in documents.columns else documents.withColumn("topic", topic())
    return out.withColumn("n_tokens", n_tokens())


def cells(documents: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): the token count of each cell; nulls are a value of their own."""
    return documents.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))


def tempered_targets(table: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """(value, share): the present token shares raised to a power, adding up to one."""
    present = table.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens"))
    powers = present.filter(F.col("tokens") > 0).select(
        F.col(dimension).alias("value"), F.pow("tokens", F.lit(temper)).alias("power")
    )
    total = powers.agg(F.sum("power")).first()[0]
    return powers.select("value", (F.col("power") / F.lit(total)).alias("share"))


def residuals(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, held): the shares of every value that holds weight.

    Targets count among the values that hold weight, whose shares are made to add up to one.
    """
    margins = [F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("value")) for n in targets]
    held = (
        fitted.select(F.explode(F.array(*margins)).alias("m"), "weight")
        .groupBy("m.dimension", "m.value")
        .agg(F.sum("weight").alias("held"))
        .filter(F.col("held") > 0)
    )
    wanted = None
    for name, goal in targets.items():
        part = goal.select(F.lit(name).alias("of"), F.col("value").cast("string").alias("goal"), "share")
        wanted = part if wanted is None else wanted.unionByName(part)
    same = (F.col("dimension") == F.col("of")) & F.col("value").eqNullSafe(F.col("goal"))
    margin = held.join(wanted, same, "left").select(
        "dimension", "value", "held", F.coalesce("share", F.lit(0.0)).alias("share")
    )
    totals = margin.groupBy("dimension").agg(F.sum("held").alias("all_held"), F.sum("share").alias("all_share"))
    return margin.join(totals, "dimension").select(
        "dimension",
        "value",
        F.try_divide("share", "all_share").alias("target"),
        (F.col("held") / F.col("all_held")).alias("held"),
    )


def _scaled(fitted: DataFrame, name: str, in_one: bool = False) -> DataFrame:
    """The cells scaled to the goals of one dimension; ``change`` is multiplied by the factor.

    With ``in_one`` the cells are one partition, so that only the sums leave it.
    """
    fitted = fitted.coalesce(1) if in_one else fitted
    sums = fitted.groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("held"))
    sums = F.broadcast(sums) if in_one else sums
    factor = F.coalesce(F.when(F.col("s.held") > 0, F.col(f"c.goal_{name}") / F.col("s.held")), F.lit(0.0))
    return (
        fitted.alias("c")
        .join(sums.alias("s"), F.col(f"c.{name}").eqNullSafe(F.col("s.value")))
        .select(
            *(F.col(f"c.{c}") for c in fitted.columns if c not in ("weight", "change")),
            (F.col("c.weight") * factor).alias("weight"),
            (F.col("c.change") * factor).alias("change"),
        )
    )


def _with_goals(table: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """The cells with the target of each of their values as ``goal_<dimension>``, null where it has none."""
    for name, goal in goals.items():
        same = F.col(f"c.{name}").eqNullSafe(F.col("g.value"))
        table = table.alias("c").join(goal.alias("g"), same, "left").select("c.*", F.col("g.share").alias(f"goal_{name}"))
    return table


def raked(
    table: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, strict: bool = True
) -> DataFrame:
    """The cells with ``weight``: their share of the tokens after fitting all margins.

    ``targets`` has a table (value, share) for each dimension; the shares of a dimension
    need not add up to one. Values without a target get weight 0, targets of values that
    do not occur are shared out by the others. Fitting goes on until a round changes no cell
    by more than ``TOLERANCE`` of its weight, or ``MAX_ROUNDS`` rounds; given ``rounds``, just as
    many are made. If a margin is then further than ``CLOSE`` from its target, the targets
    contradict each other: an error with ``strict``, else the fit is returned as it is.
    """
    goals = {name: stage(frame, "targets") for name, frame in targets.items()}
    driver = Staging(table.sparkSession)
    # stored before the first round, whose plan would hold these joins eight times
    counted = Observation()
    fitted = _with_goals(table.withColumn("weight", F.col("tokens").cast("double")), goals)
    fitted = stage(fitted.observe(counted, F.count("*").alias("n")), "cells-with-goals")
    in_one = (counted.get.get("n") or 0) <= TASK_CELLS
    for done in range(MAX_ROUNDS if rounds is None else rounds):
        if done % SETTLE_ROUNDS == 0:
            driver.settle()
        scaled = fitted.withColumn("change", F.lit(1.0))
        for name in goals:
            scaled = _scaled(scaled, name, in_one)
        if rounds is not None:
            fitted = stage(scaled, "cells")
            continue
        # the change is seen as the cells are written: a round is one query for the driver to plan and remember
        seen = Observation()
        largest = F.max(F.when(F.col("weight") > 0, F.abs(F.col("change") - 1)))
        fitted = stage(scaled.observe(seen, largest.alias("change")), "cells")
        if (seen.get.get("change") or 0.0) <= TOLERANCE:
            break
    if strict and rounds is None:
        off = residuals(fitted, goals).agg(F.max(F.abs(F.col("held") - F.col("target")))).first()[0] or 0.0
        if off > CLOSE:
            raise ValueError(f"the targets contradict each other: a margin stays {off:.1e} off its target")
    return fitted.select(*DIMENSIONS, "tokens", "weight")


def calibrated(fitted: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The fitted cells with ``probability``: in proportion to weight per token, at most 1.

    The common factor is such that ``keep_share`` of all tokens are kept on average. Cells
    that reach 1 leave the rest to the others, so the factor is found again with those set
    apart, until none is added; only sums over the cells reach the driver.
    """
    live = fitted.filter((F.col("tokens") > 0) & (F.col("weight") > 0))
    rate = F.col("weight") / F.col("tokens")
    all_tokens = fitted.agg(F.sum("tokens")).first()[0] or 0
    factor = 0.0
    while True:
        full = rate * factor >= 1
        row = live.agg(
            F.sum(F.when(full, F.col("tokens"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (keep_share * all_tokens - (row["full"] or 0)) / row["open"]
        # sums of the same cells may differ in the last digits
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    probability = F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.least(F.lit(1.0), rate * factor))
    return fitted.withColumn("probability", F.coalesce(probability, F.lit(0.0)))


def fitted_cells(described_documents: DataFrame, rounds: int | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Cells with weights and probabilities for tempered targets in every dimension.

    Tempered margins of dimensions that hang together may contradict each other, so the fit
    comes as near to them as it gets.
    """
    table = stage(cells(described_documents), "cells")
    targets = {name: tempered_targets(table, name) for name in DIMENSIONS}
    return stage(calibrated(raked(table, targets, rounds, strict=False), keep_share), "cells")


def mixed(documents: DataFrame, rounds: int | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Every document with ``topic``, ``n_tokens``, ``probability`` and ``kept``.

    A document is kept if the hash of its id, from 0 to 1, is below its cell's
    probability. Null sources, languages and topics are values of their own. Texts of any
    length count whole. Texts without tokens have no weight: their cell decides if it holds other texts, else they
    go. Null ids count as the id "null"; rows repeated with one id share their lot.
    Other columns stay as they are; an empty table gives no rows. Columns named like the
    added ones are replaced, but for a given ``topic``, which is used.
    """
    plain = documents.drop(*(c for c in ("n_tokens", "probability", "kept") if c in documents.columns))
    own = described(plain)
    facts = stage(own.select(*DIMENSIONS, "n_tokens"), "facts")
    made = fitted_cells(facts, rounds, keep_share).alias("m")
    same = [F.col(f"d.{name}").eqNullSafe(F.col(f"m.{name}")) for name in DIMENSIONS]
    lot = _uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return (
        own.alias("d")
        .join(made, same[0] & same[1] & same[2], "left")
        .select("d.*", F.coalesce("m.probability", F.lit(0.0)).alias("probability"))
        .withColumn("kept", lot < F.col("probability"))
    )


def sampled(documents: DataFrame, rounds: int | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The documents that the mix keeps, with topic, token count and probability."""
    return mixed(documents, rounds, keep_share).filter("kept").drop("kept")
