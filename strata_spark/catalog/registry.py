"""Registration of queries and building blocks of their SQL statements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import AGE, Levels, bin_labels
from strata_spark.functions.scalars import rounded
from strata_spark.operators.design import Design
from strata_spark.sources.views import SERO_DESIGN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round double columns to six digits, as the SQL statements do."""
    return df.select(*[
        rounded(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema])


def query(name: str, body: str | None = None, uses: Sequence[str] = (), doubles: Sequence[str] = ()):
    """Register a query; ``body`` is its SQL over the named views, ``doubles`` are rounded."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already there")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if body is not None:
            ORACLES[name] = statement(body, uses, doubles)
        return fn

    return register


def statement(body: str, uses: Sequence[str], doubles: Sequence[str]) -> str:
    """``WITH`` list of the views used (in order of need), then the body."""
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in VIEWS[v][1]:
            visit(dep)
        if v not in order:
            order.append(v)

    for v in uses:
        visit(v)
    parts = [f"{v} AS ({VIEWS[v][0]})" for v in order]
    if doubles:
        parts.append(f"result AS ({body})")
        swaps = ", ".join(f'floor("{c}" * 1e6 + 0.500001e0) / 1e6 AS "{c}"' for c in doubles)
        body = f"SELECT * REPLACE ({swaps}) FROM result"
    return (f"WITH {', '.join(parts)} {body}") if parts else body


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_values(rows) -> str:
    """Rows of a fixed table as a ``VALUES`` list."""
    def one(x):
        return sql_text(x) if isinstance(x, str) else (f"{x!r}e0" if isinstance(x, float) and "e" not in repr(x) else repr(x))

    return ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)


def sql_cut(column: str, breaks: Sequence[int]) -> str:
    cases, labels = [], bin_labels(breaks)
    for i, label in enumerate(labels):
        op = "<=" if i == len(labels) - 1 else "<"
        cases.append(f"WHEN {column} >= {breaks[i]} AND {column} {op} {breaks[i + 1]} THEN {sql_text(label)}")
    return "CASE " + " ".join(cases) + " END"


def sql_ordinal(levels: Levels, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(x)} THEN {i}" for i, x in enumerate(levels.labels)) + " END"


def sql_predictor(design: Design, prefix: str = "", alias: str = "", swap: dict[str, str] | None = None) -> str:
    """Linear predictor as one ``CASE`` per term, from the declared terms."""
    swap, dot = swap or {}, f"{alias}." if alias else ""
    out = []
    for term, pairs in design.parts().items():
        coef = f'{dot}"{prefix}{term}"'
        if pairs:
            hit = " AND ".join(f"{swap.get(n, n)} = {sql_text(lv)}" for n, lv in pairs)
            coef = f"CASE WHEN {hit} THEN {coef} ELSE 0e0 END"
        out.append(coef)
    return "(" + " + ".join(out) + ")"


def sql_logistic(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def sql_fixed(x: str, digits: int) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(18,6)) AS DECIMAL(18,{digits})) AS VARCHAR)"


def sql_interval(mid: str, lo: str, hi: str, digits: int, scale: str = "1e0") -> str:
    m, a, b = (sql_fixed(f"{c} * {scale}", digits) for c in (mid, lo, hi))
    return f"{m} || ' (' || {a} || '-' || {b} || ')'"


def sql_count_percent(n: str, total: str) -> str:
    return f"CAST({n} AS VARCHAR) || ' (' || {sql_fixed(f'{n} * 1e2 / {total}', 1)} || '%)'"


def _sero_columns() -> str:
    out = []
    for i, term in enumerate(SERO_DESIGN.terms):
        out.append(f'{-0.5 if i == 0 else 0.0}e0 + 0.4e0 * sin(u + {i}) AS "inf:{term}"')
        out.append(f'{0.8 if i == 0 else 0.0}e0 + 0.5e0 * cos(u + {i}) AS "vacc:{term}"')
    return ", ".join(out)


def _panel_columns(design: Design) -> str:
    return ", ".join(
        f'0.3e0 * sin(u + {i} + length(fit_id)) AS "{t}"' for i, t in enumerate(design.terms))


def panel_draws_sql(design: Design) -> str:
    return (
        f"SELECT fit_id, sim, {_panel_columns(design)}, 0.95e0 + 0.03e0 * sin(u) AS sens, "
        "0.97e0 + 0.02e0 * cos(u) AS spec, 0.9e0 + 0.03e0 * cos(u) AS sens_child, "
        "0.96e0 + 0.02e0 * sin(u) AS spec_child, 0.5e0 + 0.25e0 * sin(u + 3) AS sigma_od "
        "FROM (SELECT event_type AS fit_id, event_id % 200 AS sim, sum(CAST(floor(value) AS BIGINT)) / count(value) AS u "
        "FROM events GROUP BY 1, 2) x")


_USER = f"""CASE WHEN user_id % 8 < 4 THEN 'f' ELSE 'm' END AS sex, CAST(user_id % 106 AS INT) AS age,
 {sql_cut('(user_id % 106)', fx.AGE_BREAKS_10Y)} AS age_cat_10y,
 {sql_cut('(user_id % 106)', fx.AGE_BREAKS)} AS age_cat,
 CASE user_id % 4 WHEN 1 THEN 'uninfected' WHEN 2 THEN 'inf_bef_2022' WHEN 3 THEN 'inf_2022' END AS inf_latest,
 CASE user_id % 3 WHEN 0 THEN 'No vacc' WHEN 1 THEN 'Dose 1 or 2 only' ELSE 'Boosted' END AS vacc_status_3way"""

# view name -> (SQL, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "raw_cohort": ("""
 SELECT o_orderkey AS uid, o_custkey AS hh_id, CASE WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 106 AS INT) AS age,
 CASE WHEN o_orderstatus <> 'F' THEN 'pos' ELSE 'neg' END AS S_interp,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pos' ELSE 'neg' END AS N_interp,
 (o_orderpriority <> '5-LOW') AS vaccinated FROM orders""", ()),
    "cohort": (f"""
 SELECT uid, hh_id, age, {sql_cut('age', fx.AGE_BREAKS)} AS age_cat,
 CASE sex WHEN 'f' THEN 'Female' WHEN 'm' THEN 'Male' END AS Sex,
 CASE S_interp WHEN 'pos' THEN 1 WHEN 'neg' THEN 0 END AS s_result,
 CASE N_interp WHEN 'pos' THEN 1 WHEN 'neg' THEN 0 END AS n_result,
 CAST(vaccinated AS INT) AS vaccinated FROM raw_cohort""", ("raw_cohort",)),
    "census": ("""
 SELECT Sex, CASE WHEN a >= 105 THEN '>= 105' ELSE CAST(a AS VARCHAR) END AS Age, CAST(count(*) AS DOUBLE) AS Total
 FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Sex,
 CAST(floor(abs(c_acctbal)) AS BIGINT) % 106 AS a FROM customer) x GROUP BY Sex, a""", ()),
    "pop_strata": (f"""
 SELECT Sex, age_cat, strata_pop, strata_pop / (SELECT sum(Total) FROM census) AS percent FROM (
 SELECT Sex, {sql_cut("CAST(replace(Age, '>= ', '') AS INT)", fx.AGE_BREAKS)} AS age_cat, sum(Total) AS strata_pop
 FROM census GROUP BY ALL) y""", ("census",)),
    "scored": ("""
 SELECT l_orderkey % 200 AS sim, CAST(year(l_shipdate) AS VARCHAR) AS age_cat,
 CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS Sex, l_quantity AS strata_pop,
 l_discount * 10 AS seropos, l_tax * 10 AS infection, (l_discount * 10) * (l_tax * 10) AS vaccination,
 1e0 - (l_discount * 10) * (l_tax * 10) AS "external" FROM lineitem""", ()),
    "shipped": ("""
 SELECT CAST(year(l_shipdate) AS VARCHAR) AS age_cat,
 CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS Sex,
 CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS s_result,
 CASE WHEN l_tax > 0.04e0 THEN 1 ELSE 0 END AS n_result,
 CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END AS vaccinated FROM lineitem""", ()),
    "panel": (f"""
 SELECT event_id AS obs_id, user_id AS uid, {_USER}, event_type AS variant, value AS ec50,
 (value > 50) AS ec50_thresh FROM events""", ()),
    "truth": (f"SELECT user_id AS uid, {_USER} FROM (SELECT DISTINCT user_id FROM events) x", ()),
    "vacc_by_age": (f"""
 SELECT * FROM (VALUES {sql_values(fx.VACCINATION_BY_AGE)})
 v(age_cat, vacc_status_3way, pop_total, strata_total, percentage)""", ()),
    "coverage": (f"""
 SELECT s.Sex, v.age_cat, v.coverage FROM (VALUES {sql_values(fx.COVERAGE_BY_AGE)}) v(age_cat, coverage),
 (VALUES ('Female'), ('Male')) s(Sex)""", ()),
    "coverage_percent": (f"SELECT * FROM (VALUES {sql_values(fx.COVERAGE_PERCENT)}) v(val, pc_coverage)", ()),
    "age_prior": (f"SELECT * FROM (VALUES {sql_values(fx.OTHER_INFECTION_PRIOR)}) v(age_cat, prior_before)", ()),
    "sero_draws": (f"""
 SELECT sim, {_sero_columns()}, 0.5e0 + 0.25e0 * sin(u + 3) AS sigma_inf,
 0.4e0 + 0.2e0 * cos(u + 3) AS sigma_vacc, 0.1e0 + 0.05e0 * cos(u) AS resp_sn_np,
 0.2e0 + 0.1e0 * sin(u) AS resp_sp_nn, 0.9e0 + 0.05e0 * sin(u) AS vacc_response,
 0.95e0 + 0.02e0 * sin(u) AS sens_s, 0.98e0 + 0.01e0 * cos(u) AS spec_s,
 0.9e0 + 0.03e0 * cos(u) AS sens_n, 0.97e0 + 0.01e0 * sin(u) AS spec_n
 FROM (SELECT l_orderkey % 200 AS sim, (4 * sum(CAST(round(l_discount * 100) AS BIGINT))
 + 3 * sum(CAST(round(l_tax * 100) AS BIGINT))) / count(*) AS u FROM lineitem GROUP BY 1) x""", ()),
    "ages": (f"SELECT * FROM (VALUES {sql_values([(x,) for x in AGE.labels])}) v(age_cat)", ()),
    "sexes": ("SELECT * FROM (VALUES ('Female'), ('Male')) v(Sex)", ()),
}
