"""The exploration report: a set of long tables over one input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import statistics as S
from ..operators.correlations import correlation


def report(
    df: DataFrame,
    pearson: list[list[str]] = (),
    spearman: list[list[str]] = (),
    crosstabs: list[tuple[str, str]] = (),
    exclude: tuple[str, ...] = ("latitude", "longitude", "logerror"),
) -> dict[str, DataFrame]:
    """Named results; nothing runs until one of them is used, apart from written intermediates."""
    out = {
        "missing_percent": S.missing_percent(df),
        "describe": S.describe_long(df),
        "summary": S.summary_continuous(df.select(S.numeric_columns(df, exclude))),
    }
    out |= {f"distribution:{c}": S.value_distribution(df, c) for c in S.categorical_columns(df)}
    out |= {f"pearson:{','.join(c)}": correlation(df.select(c), "pearson") for c in pearson}
    out |= {f"spearman:{','.join(c)}": correlation(df.select(c), "spearman") for c in spearman}
    out |= {f"crosstab:{a},{b}": S.crosstab(df, a, b) for a, b in crosstabs}
    return out
