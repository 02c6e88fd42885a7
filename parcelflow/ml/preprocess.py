"""Rule-driven preprocessing as an ML stage: minima are learnt once, every rule is a Column expression."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import fixed_values as V

MODES = ("intended", "as_coded")


@dataclass(frozen=True)
class Rules:
    """What happens to which column. Rules on absent columns are skipped unless ``strict``."""

    fill: dict = field(default_factory=dict)
    log: list = field(default_factory=list)
    sqrt: list = field(default_factory=list)
    cube_root: list = field(default_factory=list)
    keep: list = field(default_factory=list)  # (column, kept values, replacement)
    above: list = field(default_factory=list)  # (column, threshold)
    flags: list = field(default_factory=list)  # (column, text that means 1)
    null_zero_with: list = field(default_factory=list)  # (size column, count column)
    dates: list = field(default_factory=list)  # (date column, prefix of the parts)
    drop: list = field(default_factory=list)

    def columns(self) -> set[str]:
        single = [*self.fill, *self.log, *self.sqrt, *self.cube_root]
        first = [rule[0] for rules in (self.keep, self.above, self.flags, self.null_zero_with, self.dates) for rule in rules]
        return {*single, *first, *[counts for _, counts in self.null_zero_with]}


PROPERTY_RULES = Rules(
    fill=V.FILL,
    log=V.LOG,
    sqrt=V.SQRT,
    cube_root=V.CUBE_ROOT,
    keep=V.KEEP,
    above=V.ABOVE,
    flags=[("taxdelinquencyflag", "Y")],
    null_zero_with=[("garagetotalsqft", "garagecarcnt")],
    dates=[("transactiondate", "transaction")],
    drop=V.DROP,
)


class _PreprocessParams(Params):
    rules = Param(Params._dummy(), "rules", "preprocessing rules as a dictionary", TypeConverters.identity)
    mode = Param(Params._dummy(), "mode", "'intended' or 'as_coded'", TypeConverters.toString)
    strict = Param(Params._dummy(), "strict", "fail when a rule's column is absent", TypeConverters.toBoolean)

    def _rules(self) -> Rules:
        return Rules(**self.getOrDefault(self.rules))


class Preprocess(Estimator, _PreprocessParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the minima needed by the log and square-root shifts."""

    @keyword_only
    def __init__(self, *, rules: Rules | None = None, mode: str = "intended", strict: bool = False):
        super().__init__()
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self._setDefault(rules=asdict(PROPERTY_RULES), mode="intended", strict=False)
        self._set(rules=asdict(rules or PROPERTY_RULES), mode=mode, strict=strict)

    def _fit(self, dataset: DataFrame) -> PreprocessModel:
        rules = self._rules()
        absent = sorted(rules.columns() - set(dataset.columns))
        if absent and self.getOrDefault(self.strict):
            raise ValueError(f"columns missing for the preprocessing rules: {absent}")
        shifted = [c for c in [*rules.log, *rules.sqrt] if c in dataset.columns]
        minima = dataset.agg(*[F.min(c).cast("double").alias(c) for c in shifted]).first().asDict() if shifted else {}
        model = PreprocessModel()._set(minima=minima)
        return self._copyValues(model)


class PreprocessModel(Model, _PreprocessParams, DefaultParamsReadable, DefaultParamsWritable):
    minima = Param(Params._dummy(), "minima", "column minima before filling", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._setDefault(rules=asdict(PROPERTY_RULES), mode="intended", strict=False, minima={})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rules, present = self._rules(), set(dataset.columns)
        integers = [name for name, dtype in dataset.dtypes if dtype == "int"]
        casts = {c: F.col(c).cast("float") for c in integers}
        filled = dataset.fillna({c: v for c, v in rules.fill.items() if c in present})
        values = self._value_rules(rules, present)
        flags = {c: scalars.above(F.col(c), t) for c, t in rules.above if c in present}
        others = self._other_rules(rules, present)
        if self.getOrDefault(self.mode) == "as_coded":
            # All expressions read the filled input; for one column the later rule wins.
            done = filled.withColumns({**values, **flags, **others, **casts})
        else:
            done = filled.withColumns(casts).withColumns({**values, **others})
            done = done.withColumns({f"{c}_bin": e for c, e in flags.items()})
        return done.drop(*rules.drop)

    def _value_rules(self, rules: Rules, present: set[str]) -> dict[str, Column]:
        lowest = self.getOrDefault(self.minima)
        out = {c: scalars.log_shift(F.col(c), lowest.get(c)) for c in rules.log if c in present}
        out |= {c: scalars.sqrt_shift(F.col(c), lowest.get(c)) for c in rules.sqrt if c in present}
        out |= {c: scalars.cube_root(F.col(c)) for c in rules.cube_root if c in present}
        out |= {c: scalars.keep_or_bin(F.col(c), keep, other) for c, keep, other in rules.keep if c in present}
        return out

    def _other_rules(self, rules: Rules, present: set[str]) -> dict[str, Column]:
        out = {c: scalars.flag_to_number(F.col(c), yes) for c, yes in rules.flags if c in present}
        for size, count in rules.null_zero_with:
            if {size, count} <= present:
                out[size] = scalars.null_when(F.col(size), (F.col(size) == 0) & (F.col(count) > 0))
        for c, prefix in rules.dates:
            if c in present:
                out |= {f"{prefix}_year": F.year(c), f"{prefix}_month": F.month(c), f"{prefix}_day": F.dayofmonth(c)}
        return out


def preprocess(df: DataFrame, rules: Rules | None = None, mode: str = "intended", strict: bool = False) -> DataFrame:
    """Fit and apply in one call."""
    return Preprocess(rules=rules, mode=mode, strict=strict).fit(df).transform(df)
