"""Design terms: treatment contrasts keyed by term name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.functions.levels import INFECTION, PANEL_AGE, PANEL_AGE_10Y, PANEL_SEX, VACCINATION, Levels, sql_literal

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Design:
    """Factors in model order and pairs of factors that interact."""

    factors: tuple[Levels, ...]
    interactions: tuple[tuple[str, str], ...] = ()

    def _factor(self, name: str) -> Levels:
        return next(f for f in self.factors if f.name == name)

    def parts(self) -> dict[str, tuple[tuple[str, str], ...]]:
        """Term name to the ``(factor, level)`` pairs it stands for."""
        out: dict[str, tuple[tuple[str, str], ...]] = {INTERCEPT: ()}
        for f in self.factors:
            for level in f.contrasts:
                out[f"{f.name}{level}"] = ((f.name, level),)
        for a, b in self.interactions:
            for lb in self._factor(b).contrasts:
                for la in self._factor(a).contrasts:
                    out[f"{a}{la}:{b}{lb}"] = ((a, la), (b, lb))
        return out

    @property
    def terms(self) -> list[str]:
        return list(self.parts())

    def indicator(self, term: str) -> Column:
        """0/1 column of a term."""
        pairs = self.parts()[term]
        hit = " AND ".join(f"`{n}` = {sql_literal(x)}" for n, x in pairs)
        return F.expr(f"CASE WHEN {hit} THEN 1 ELSE 0 END") if pairs else F.lit(1)

    def predictor(self, prefix: str = "", replace: Mapping[str, str] | None = None) -> str:
        """Linear predictor as one SQL expression over coefficient columns ``<prefix><term>``.

        A factor is one ``CASE``; ``replace`` gives other expressions for factors.
        """
        replace = replace or {}

        def coef(term: str) -> str:
            return f"`{prefix}{term}`"

        def is_level(name: str, level: str) -> str:
            return f"{replace.get(name, f'`{name}`')} = {sql_literal(level)}"

        parts = [coef(INTERCEPT)]
        for f in self.factors:
            arms = [f"WHEN {is_level(f.name, x)} THEN {coef(f.name + x)}" for x in f.contrasts]
            parts.append(f"CASE {' '.join(arms)} ELSE 0D END")
        for a, b in self.interactions:
            arms = [
                f"WHEN {is_level(a, x)} AND {is_level(b, y)} THEN {coef(f'{a}{x}:{b}{y}')}"
                for x in self._factor(a).contrasts for y in self._factor(b).contrasts]
            parts.append(f"CASE {' '.join(arms)} ELSE 0D END")
        return " + ".join(parts)


#: Age schemes of the panel by column name.
AGE_SCHEMES = {"age_cat_uep": PANEL_AGE, "age_cat_10y": PANEL_AGE_10Y}


def panel_models(age: Levels) -> dict[str, Design]:
    """The two model types under one age scheme."""
    factors = (age, PANEL_SEX, INFECTION, VACCINATION)
    return {"additive": Design(factors), "interaction": Design(factors, (("inf_latest", "vacc_status_3way"),))}


MODELS = panel_models(PANEL_AGE)


def model_design(name: str, age_scheme: str = "age_cat_uep") -> Design:
    """Design of a model type under an age scheme; an unknown name of either is an error."""
    if age_scheme not in AGE_SCHEMES:
        raise ValueError(f"unknown age scheme {age_scheme!r}, known: {', '.join(AGE_SCHEMES)}")
    models = panel_models(AGE_SCHEMES[age_scheme])
    if name not in models:
        raise ValueError(f"unknown model type {name!r}, known: {', '.join(models)}")
    return models[name]


def design_rows(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per term, named by the term."""
    return df.select(*keep, *[design.indicator(t).alias(t) for t in design.terms])


def scenario_rows(df: DataFrame, design: Design, keep: Sequence[str] = (),
                  scenarios: Sequence[str] = ("inf_bef_2022", "inf_2022")) -> DataFrame:
    """Rows with no infection date, once per scenario, with that scenario's terms."""
    undated = df.where(F.col("inf_latest").isNull()).withColumn(
        "inf_latest", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    return undated.select(*keep, F.col("inf_latest").alias("scenario"),
                          *[design.indicator(t).alias(t) for t in design.terms])


def require_same_terms(left: Sequence[str], right: Sequence[str]) -> None:
    """Raise unless both sides name the same terms, in any order."""
    a, b = set(left), set(right)
    if a != b:
        raise ValueError(f"terms differ: only left {sorted(a - b)}, only right {sorted(b - a)}")
