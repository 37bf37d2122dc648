"""Imputation and repair.  Statistics come from the rows they are fitted on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.hashing import uniform
from gapwise.functions.linear import any_null, fill_text, number, quoted
from gapwise.operators.profile import incomplete_columns


def apply_fills(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.selectExpr(*fill_text(df.columns, {c: v for c, v in fills.items()
                                                 if v is not None}))


def mean_fills(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = train.selectExpr(*[f"avg({quoted(c)})" for c in columns]).collect()[0]
    return dict(zip(columns, row))


def max_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.selectExpr(*[f"cast(max({quoted(c)}) AS double)" for c in columns]).collect()[0]
    return dict(zip(columns, row))


def mean_or_mode_fills(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean when a column has more than two distinct values, else its mode.

    With at most two values they are the minimum and the maximum, so the mode
    follows from two conditional counts: no distinct, no shuffle of values.
    """
    if not columns:
        return {}
    first = train.selectExpr(*[f"{fn}(cast({quoted(c)} AS double))" for c in columns
                               for fn in ("min", "max", "avg")]).collect()[0]
    stats = {c: tuple(first[3 * i:3 * i + 3]) for i, c in enumerate(columns)}
    known = [c for c in columns if stats[c][0] is not None]
    if not known:
        return {}
    tests = []
    for c in known:
        low, high, _ = stats[c]
        value = f"cast({quoted(c)} AS double)"
        tests += [f"count_if({value} > {number(low)} AND {value} < {number(high)})",
                  f"count_if({value} = {number(low)})", f"count_if({value} = {number(high)})"]
    second = train.selectExpr(*tests).collect()[0]
    fills = {}
    for i, c in enumerate(known):
        between, at_low, at_high = second[3 * i:3 * i + 3]
        low, high, mean = stats[c]
        fills[c] = mean if between else (low if at_low >= at_high else high)
    return fills


def impute_mean(train: DataFrame, other: DataFrame, columns: Sequence[str]):
    """(train, other) filled with the training means."""
    fills = mean_fills(train, columns)
    return apply_fills(train, fills), apply_fills(other, fills)


def impute_constant(df: DataFrame, number_fill: float = 0.0, text_fill: str = "missing"):
    return df.na.fill(number_fill).na.fill(text_fill)


def impute_tiny_random(df: DataFrame, key: str, features: Sequence[str], seed,
                       scale: float = 0.01, only_missing: bool = False,
                       gaps: Sequence[str] | None = None) -> DataFrame:
    """Start values for iterative cleaning.

    In every incomplete row all columns that are incomplete anywhere get a small
    random value; ``only_missing`` keeps the observed cells of such rows.
    """
    gaps = incomplete_columns(df, features) if gaps is None else list(gaps)
    hit = any_null(gaps)
    draws = {c: F.when(F.col(c).isNull() if only_missing else hit,
                       F.lit(scale) * uniform(seed, key, F.lit(c))).otherwise(F.col(c))
             for c in gaps}
    return df.withColumns(draws)


def extreme_versions(df: DataFrame, key: str, gaps: Mapping[str, tuple[float, float]],
                     versions: int, seed, version: str = "version") -> DataFrame:
    """Repair versions of the incomplete rows: each gap becomes its column's min or max.

    Only incomplete rows are multiplied; complete rows are the same in every version.
    """
    many = (df.filter(any_null(list(gaps)))
            .withColumn(version, F.explode(F.sequence(F.lit(0), F.lit(versions - 1)))))
    picks = {c: F.coalesce(F.col(c), F.when(uniform(seed, version, key, F.lit(c)) < 0.5,
                                            F.lit(high)).otherwise(F.lit(low)))
             for c, (low, high) in gaps.items()}
    return many.withColumns(picks)


def adversarial_text(features: Sequence[str], weights: Sequence[float], label: str,
                     bounds: Mapping[str, tuple[float, float]]) -> tuple[list[str], str]:
    """SQL for the worst-case repair under ``weights``.

    Returns the repaired cells and the condition choosing the second end: one
    end takes max where the weight is positive and min elsewhere, the other the
    opposite; a row keeps the end with the larger absolute residual.
    """
    def end(first: bool):
        cells = []
        for f, w in zip(features, weights, strict=True):
            if f in bounds:
                low, high = bounds[f]
                pick = high if (w > 0) == first else low
                cells.append(f"coalesce({quoted(f)}, {number(pick)})")
            else:
                cells.append(quoted(f))
        return cells

    def residual(cells):
        score = " + ".join(f"{c} * {number(w)}" for c, w in zip(cells, weights))
        return f"abs({score} - {quoted(label)})"

    up, down = end(True), end(False)
    second = f"{residual(down)} > {residual(up)}"
    repaired = [f if f == g else f"CASE WHEN {second} THEN {g} ELSE {f} END"
                for f, g in zip(up, down)]
    return repaired, second


def impute_adversarial(df: DataFrame, features: Sequence[str], weights: Sequence[float],
                       label: str, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    cells, _ = adversarial_text(features, weights, label, bounds)
    by_name = dict(zip(features, cells))
    return df.selectExpr(*[f"{by_name[c]} AS {quoted(c)}" if c in by_name else quoted(c)
                           for c in df.columns])


