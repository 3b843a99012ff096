"""Post-stratification: weighted means per draw over many overlapping subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.functions.levels import Levels, sql_literal
from strata_spark.functions.scalars import mean_by_weight, ratio, whole_sum
from strata_spark.session import literal_table


def cell_sums(df: DataFrame, by: Sequence[str], value: str = "seropos", weight: str = "strata_pop") -> DataFrame:
    """Weighted sum ``wx`` and weight ``w`` per cell.

    Both add up again, so later groupings work on cells instead of input rows. A cell with a missing value is null, and
    so is every estimate that it belongs to.
    """
    return df.groupBy(*by).agg(
        whole_sum(F.col(value) * F.col(weight)).alias("wx"), whole_sum(F.col(weight)).alias("w"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str = "seropos", weight: str = "strata_pop",
                  name: str = "p") -> DataFrame:
    """``sum(x * w) / sum(w)`` per group; null where a value is missing or the group has no weight."""
    return df.groupBy(*by).agg(mean_by_weight(F.col(value), F.col(weight)).alias(name))


def _stack(cells: DataFrame, by: Sequence[str], tags: Sequence[Column]) -> DataFrame:
    """Add each cell to every tagged estimate it belongs to."""
    tagged = cells.select(*by, "wx", "w", F.explode(F.array_compact(F.array(*tags))).alias("_t"))
    return tagged.groupBy(*by, "_t.var", "_t.val").agg(
        ratio(whole_sum(F.col("wx")), whole_sum(F.col("w"))).alias("p"))


def _tag(var: str, val: Column) -> Column:
    return F.struct(F.lit(var).alias("var"), val.alias("val"))


def conditional_estimates(scored: DataFrame, age_ref: str, sex_ref: str, by: Sequence[str] = ("sim",),
                          value: str = "seropos", weight: str = "strata_pop") -> DataFrame:
    """Overall; age at the reference sex only; sex at the reference age only."""
    cells = cell_sums(scored, [*by, "age_cat", "Sex"], value, weight)
    return _stack(cells, by, [
        _tag("Overall", F.lit("")),
        F.when(F.col("Sex") == sex_ref, _tag("Age", F.col("age_cat"))),
        F.when(F.col("age_cat") == age_ref, _tag("Sex", F.col("Sex"))),
    ])


def marginal_estimates(scored: DataFrame, by: Sequence[str] = ("sim",), value: str = "seropos",
                       weight: str = "strata_pop") -> DataFrame:
    """Overall and population-weighted mean per age and per sex."""
    cells = cell_sums(scored, [*by, "age_cat", "Sex"], value, weight)
    return _stack(cells, by, [
        _tag("Overall", F.lit("")), _tag("Age", F.col("age_cat")), _tag("Sex", F.col("Sex"))])


def compact(col: Column) -> Column:
    """Level text without blanks, as in subset names."""
    return F.regexp_replace(col, " ", "")


def poststratify_sets(scored: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str] = ("sim",),
                      value: str = "p", weight: str = "strata_size_final") -> DataFrame:
    """One mean per draw and level combination of every set; ``()`` is the total."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = scored.groupingSets(
        [[F.col(c) for c in (*by, *s)] for s in sets], *[F.col(c) for c in (*by, *columns)]
    ).agg(mean_by_weight(F.col(value), F.col(weight)).alias("p"),
          *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    name = F.concat_ws("&", *[
        F.when(F.col(f"_g_{c}") == 0, F.concat(F.lit(f"{c}:"), compact(F.col(c)))) for c in columns])
    return grouped.select(*by, F.when(name == "", "all").otherwise(name).alias("postrat_name"), "p")


def subset_specs(factors: Sequence[Levels], pairs: Sequence[tuple[Levels, Levels]] = ()) -> list[dict[str, str]]:
    """Every level of every factor, then every combination of each pair (first factor fastest)."""
    single = [{f.name: x} for f in factors for x in f.labels]
    double = [{a.name: x, b.name: y} for a, b in pairs for y in b.labels for x in a.labels]
    return single + double


def _key(names: Sequence[str]) -> str:
    return "&".join(names)


def subset_catalog(spark, specs: Sequence[dict[str, str]]) -> DataFrame:
    """``(subset_id, expr, postrat_name, vars, vals)``, one row per subset; ``expr`` is its condition in SQL."""
    rows = [
        (i, " AND ".join(f"{c} = {sql_literal(level)}" for c, level in spec.items()),
         _key([f"{c}:{level.replace(' ', '')}" for c, level in spec.items()]), _key(list(spec)), "\u0001".join(spec.values()))
        for i, spec in enumerate(specs, start=1)]
    return literal_table(spark, rows, "subset_id int, expr string, postrat_name string, vars string, vals string")


def subset_members(strata: DataFrame, specs: Sequence[dict[str, str]], keep: Sequence[str] = ("row",)) -> DataFrame:
    """Which strata rows belong to which subset.

    A conjunction of equalities is an equi join on the values of its columns,
    so each stratum looks up its own subsets once per distinct column list.
    """
    lists = list(dict.fromkeys(tuple(s) for s in specs))
    keys = F.array(*[
        F.struct(F.lit(_key(names)).alias("vars"), F.concat_ws("\u0001", *[F.col(c) for c in names]).alias("vals"))
        for names in lists])
    keyed = strata.select(*keep, F.explode(keys).alias("_k")).select(*keep, "_k.vars", "_k.vals")
    return keyed.join(subset_catalog(strata.sparkSession, specs), ["vars", "vals"], "inner").select(
        "subset_id", "expr", "postrat_name", *keep)


def subset_offsets(members: DataFrame) -> DataFrame:
    """Size of each subset and its first and last position when subsets are laid end to end."""
    sizes = members.groupBy("subset_id", "postrat_name").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("subset_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(running)
    return sizes.select("subset_id", "postrat_name", "n", (end - F.col("n") + 1).alias("first"), end.alias("last"))


def poststratify_subsets(scored: DataFrame, specs: Sequence[dict[str, str]], by: Sequence[str] = ("sim",),
                         value: str = "p", weight: str = "strata_size_final") -> DataFrame:
    """One mean per draw and subset for an arbitrary list of overlapping subsets.

    Scored rows look up their own subsets in the catalog, whose length is
    known; sums are combined before they are shuffled.
    """
    members = subset_members(scored, specs, [*by, value, weight])
    return members.groupBy(*by, "subset_id", "postrat_name").agg(
        mean_by_weight(F.col(value), F.col(weight)).alias("p"))


def label_estimates(df: DataFrame, name: str = "postrat_name") -> DataFrame:
    """Split a subset name into its covariates ``var_cat`` and their levels ``var``.

    A name is ``covariate:level`` for each condition, joined by ``&``; both parts are joined by ``:``. A name without
    a condition is its own covariate and level.
    """
    def parts(take: str) -> Column:
        return F.expr(f"array_join(transform(split(`{name}`, '&'), x -> {take}), ':')")

    return df.withColumns({"var_cat": parts("split(x, ':')[0]"), "var": parts("regexp_replace(x, '^[^:]*:', '')")})
