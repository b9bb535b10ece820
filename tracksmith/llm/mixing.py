"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted for each cell of (source, language, topic). Raking scales the cells until their sums meet the
target shares of every source, language and topic; documents are then sampled, each with its cell's probability,
chosen so that the expected tokens come to the wanted part of all and stand in the raked proportions. A cell asked
for more than it has gives all it has, and the rest is shared out among the others.

Targets are weights that the caller gives for a margin's values; values that are not named share what is left of 1
as they did. A margin without targets flattens the shares found by an exponent. `gap` tells how far the margins are
from their targets after the last round: targets may ask for what no scaling of the cells can give.

Up to CELLS cells are raked on the driver, more as Spark tables. Both take the same steps in the same order and
differ by the order of sums only: shares and chances agree to 1e-9 of their value.

Defined cases: a null in source, language or topic is a value of its own; a null text has no tokens; documents
without tokens stand in their cell with its probability (1 if the whole cell has none); an empty table gives no
rows; repeated rows share their fate, as the draw depends on seed and id only; other columns are left alone,
whatever their names; weights for values that do not occur are passed over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rounds, fresh, saved, unit, whole

#: Margins, with the exponent by which each flattens the shares found (1: as found, 0: all equal).
SMOOTHING = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, KEEP = 30, 0.5
#: Up to so many cells are raked on the driver (about 10 MB) and broadcast.
CELLS = 100_000

Targets = Mapping[str, Mapping[str | None, float]]


def form(text: Column | str) -> Column:
    """A topic by the text's form, for tables without a topic: its ASCII marks and digits, its capitals, and its lines, each against its length."""
    t = whole(text)
    size, count = F.char_length(t), lambda pattern: F.regexp_count(t, F.lit(pattern))
    return F.when(count(r"[!-@\x5B-`{-~]") * 8 > size, "symbols").when(count("[A-Z]") * 4 > size, "capitals").when(count("\n") * 100 > size, "lines").otherwise("prose")


def words(text: Column | str) -> Column:
    """Words of the text: the first characters of runs without white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets_of(found: np.ndarray, values: Sequence[str], given: Mapping[str | None, float] | None, exponent: float) -> np.ndarray:
    """The wanted share of each value of a margin; found: its share of the tokens; values as value() has them."""
    if given is None:
        raised = np.where(found > 0, found**exponent, 0.0)
        return raised / max(raised.sum(), 1e-300)
    weight = {"null" if k is None else f"={k}": float(v) for k, v in given.items()}
    own = np.array([weight.get(v, np.nan) for v in values])
    if np.nansum(own) > 1 + 1e-9 or np.nanmin(own, initial=0) < 0:
        raise ValueError("target weights must be 0 or more and sum up to 1 at most")
    named = ~np.isnan(own)
    left, rest = max(0.0, 1 - np.nansum(own[named])), found[~named].sum()
    wanted = np.where(named, own, found * (left / rest if rest else 0.0))
    wanted = np.where(found > 0, wanted, 0.0)
    return wanted / max(wanted.sum(), 1e-300)


def rake(codes: Sequence[np.ndarray], tokens: np.ndarray, targets: Sequence[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The raked share of each cell, and the largest gap between a margin and its target. codes: each cell's value in each margin."""
    share = tokens / max(tokens.sum(), 1)
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, share, len(target))
            share = share * np.divide(target, now, out=np.zeros(len(now)), where=now > 0)[code]
    gaps = [np.abs(np.bincount(code, share, len(target)) - target).max(initial=0) for code, target in zip(codes, targets, strict=True)]
    return share, float(max(gaps, default=0))


def probabilities(tokens: np.ndarray, share: np.ndarray, keep: float) -> np.ndarray:
    """Each cell's chance: the expected tokens are `keep` of all and follow the shares, but for cells that are used up."""
    asked = np.divide(share, tokens, out=np.zeros(len(share)), where=tokens > 0)
    full = np.zeros(len(asked), bool)
    while True:
        rest = share[~full].sum()
        scale = (keep * tokens.sum() - tokens[full].sum()) / rest if rest > 0 else np.inf
        more = (asked > 0) & (asked * scale >= 1) & ~full
        if not more.any():
            break
        full |= more
    return np.where((tokens > 0) & ~full, np.clip(asked * (scale if np.isfinite(scale) else 0.0), 0, 1), 1.0)


def cell_chances(cells: DataFrame, margins: Sequence[str], targets: Targets, smoothing: Mapping[str, float], rounds: int, keep: float, most: int) -> DataFrame:
    """The cells with share, chance and gap."""
    spark = cells.sparkSession
    if cells.count() <= most:
        found = cells.orderBy(*margins).toPandas()
        tokens = found.tokens.to_numpy(float)
        coded = [pd.factorize(found[m], sort=True) for m in margins]
        share = tokens / max(tokens.sum(), 1)
        goals = [targets_of(np.bincount(code, share, len(values)), list(values), targets.get(m), smoothing.get(m, 1.0)) for m, (code, values) in zip(margins, coded, strict=True)]
        share, gap = rake([code for code, _ in coded], tokens, goals, rounds)
        found = found.assign(share=share, chance=probabilities(tokens, share, keep), gap=gap)
        schema = ", ".join(f"{m} string" for m in margins) + ", tokens long, share double, chance double, gap double"
        return F.broadcast(spark.createDataFrame(found, schema)) if len(found) else spark.createDataFrame([], schema)
    steps = Rounds(spark)
    try:
        return saved(_cell_chances(cells, margins, targets, smoothing, rounds, keep, steps))
    finally:
        steps.close()


def _cell_chances(cells: DataFrame, margins: Sequence[str], targets: Targets, smoothing: Mapping[str, float], rounds: int, keep: float, steps: Rounds) -> DataFrame:
    """cell_chances() as joins of Spark tables; margins may have any number of values."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now, goals = steps.keep(cells.withColumn("share", F.col("tokens") / max(total, 1.0))), {}
    for m in margins:
        found = now.groupBy(m).agg(F.sum("share").alias("found"))
        if m in targets:
            rows = [("null" if k is None else f"={k}", float(v)) for k, v in targets[m].items()]
            if sum(w for _, w in rows) > 1 + 1e-9 or min((w for _, w in rows), default=0) < 0:
                raise ValueError("target weights must be 0 or more and sum up to 1 at most")
            own = found.join(spark.createDataFrame(rows, f"{m} string, own double"), m, "left")
            left, rest = own.agg(1 - F.coalesce(F.sum("own"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("found"))), F.lit(0.0))).first() or (0, 0)
            wanted = F.coalesce("own", F.col("found") * (max(0.0, left or 0) / rest if rest else 0.0))
            raised = own.select(m, F.when(F.col("found") > 0, wanted).otherwise(0.0).alias("raised"))
        else:
            raised = found.select(m, F.when(F.col("found") > 0, F.pow("found", F.lit(float(smoothing.get(m, 1.0))))).otherwise(0.0).alias("raised"))
        goals[m] = steps.keep(raised.select(m, (F.col("raised") / (raised.agg(F.sum("raised")).first()[0] or 1.0)).alias("target")))
    for _ in range(rounds):
        for m in margins:
            scale = now.groupBy(m).agg(F.sum("share").alias("found")).join(goals[m], m).select(m, F.when(F.col("found") > 0, F.col("target") / F.col("found")).otherwise(0.0).alias("scale"))
            now = steps.keep(now.join(scale, m).withColumn("share", F.col("share") * F.col("scale")).drop("scale"))
    gap = 0.0
    for m in margins:
        off = now.groupBy(m).agg(F.sum("share").alias("found")).join(goals[m], m).agg(F.max(F.abs(F.col("found") - F.col("target")))).first()[0]
        gap = max(gap, off or 0.0)
    now = steps.keep(now.withColumn("asked", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(0.0)))
    full, scale = F.lit(False), 0.0
    while True:  # each turn fills up more cells; few are needed, as the scale grows with each
        free = now.where(~full)
        rest, used = free.agg(F.sum("share")).first()[0] or 0.0, now.where(full).agg(F.sum("tokens")).first()[0] or 0
        if rest <= 0:
            break
        last, scale = scale, (keep * total - used) / rest
        full = (F.col("asked") > 0) & (F.col("asked") * scale >= 1)
        if scale == last:
            break
    chance = F.when((F.col("tokens") > 0) & ~full, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("asked") * scale))).otherwise(1.0)
    return now.select(*margins, "tokens", "share", chance.alias("chance"), F.lit(gap).alias("gap"))


def calibrated(
    df: DataFrame, margins: Mapping[str, Column] | None = None, targets: Targets | None = None, smoothing: Mapping[str, float] | None = None, keep: float = KEEP, rounds: int = ROUNDS, text: str = "text", most: int = CELLS
) -> tuple[DataFrame, dict[str, str]]:
    """df with its margins, tokens, share, chance and gap in new columns, and the names of these.

    margins: a column for each; without them source, lang and topic, where a column topic is used if there is one.
    targets: for a margin, the wanted share of the kept tokens by value (None: null).
    """
    topic = F.col("topic") if "topic" in df.columns else form(text)
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    smoothing, more = {**SMOOTHING, **(smoothing or {})}, ("tokens", "share", "chance", "gap")
    names = dict(zip([*margins, *more], fresh(df, *(f"{m}__" for m in [*margins, *more])), strict=True))
    value = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    cells = df.select(*[value(c).alias(m) for m, c in margins.items()], words(text).alias("tokens")).groupBy(*margins).agg(F.sum("tokens").alias("tokens"))
    chances = cell_chances(saved(cells), list(margins), targets or {}, smoothing, rounds, keep, most)
    chances = chances.select(*[F.col(c).alias(names[c]) for c in (*margins, "share", "chance", "gap")])
    marked = df.withColumns({names[m]: value(c) for m, c in margins.items()} | {names["tokens"]: words(text)})
    return marked.join(chances, [names[m] for m in margins]), names


def weigh(df: DataFrame, key: str = "doc_id", seed: int = 42, **options: object) -> DataFrame:
    """key, the margins' values, n_tokens, cell_share, chance, margin_gap and kept of every document."""
    marked, n = calibrated(df, **options)  # type: ignore[arg-type]
    margins = [m for m in n if m not in ("tokens", "share", "chance", "gap")]
    draw = unit(seed, F.col(key))
    plain = lambda m: F.when(F.col(n[m]) != "null", F.substring(F.col(n[m]), 2, 1 << 30))
    return marked.select(key, *[plain(m).alias(m) for m in margins], F.col(n["tokens"]).alias("n_tokens"), F.round(n["share"], 9).alias("cell_share"), F.round(n["chance"], 9).alias("chance"), F.round(n["gap"], 9).alias("margin_gap"), (draw < F.col(n["chance"])).alias("kept"))


def sample(df: DataFrame, key: str = "doc_id", seed: int = 42, **options: object) -> DataFrame:
    """The rows of df that are drawn, with df's columns."""
    marked, n = calibrated(df, **options)  # type: ignore[arg-type]
    return marked.where(unit(seed, F.col(key)) < F.col(n["chance"])).select(*[F.col(f"`{c}`") for c in df.columns])
