"""Spline features over `lineitem`, row standardisation over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query, rounded, rounded_sql
from millrace.operators import features
from millrace.plans.views import table

LINE = "l_orderkey, l_linenumber"


@query("spline_basis", f"""
with x as (select {LINE}, l_discount * 10 - 0.5 as x from lineitem)
select {LINE}, {', '.join(
    rounded_sql(f'pow(greatest(tanh(x) - cast({g} as double), cast(0 as double)), 2)') + f' as k{i}'
    for i, g in enumerate(features.knots(6)))} from x""")
def basis(spark, sf_dir):
    x = F.col("l_discount") * 10 - 0.5
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[rounded(c).alias(f"k{i}") for i, c in enumerate(features.spline_basis(x, 6))])


@query("silu_feature", f"""
select {LINE}, {rounded_sql('x / (1 + exp(-x))')} as base
from (select {LINE}, l_discount * 10 - 0.5 as x from lineitem)""")
def silu(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        rounded(features.silu(F.col("l_discount") * 10 - 0.5)).alias("base"))


@query("standardised_rows", f"""
with e as (select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as pos,
                  cast(unnest(embedding) as double) as x from embeddings)
select vec_id, pos, {rounded_sql('''(x - avg(x) over (partition by vec_id)) /
  sqrt(var_pop(x) over (partition by vec_id) + cast(1e-5 as double))''')} as x from e""")
def standardised(spark, sf_dir):
    rows = features.standardised_rows(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", rounded("x"))


INPUTS, TARGET, KNOTS = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3
RIDGE = 1e-3


def design_sql() -> str:
    """The design: per input its base and knots, then the scaled target and a one."""
    scale = ", ".join(f"(cast({c} as double) - avg(cast({c} as double)) over ()) / "
                      f"stddev_pop(cast({c} as double)) over () as {c}" for c in [*INPUTS, TARGET])
    parts = [p for c in INPUTS for p in (
        f"{c} / (1 + exp(-{c}))",
        *(f"pow(greatest(tanh({c}) - cast({g} as double), cast(0 as double)), 2)" for g in features.knots(KNOTS)))]
    row = f"[{', '.join([*parts, TARGET, 'cast(1 as double)'])}]"
    return f"""scaled as (select {scale} from lineitem),
design as (select {row} as x from scaled),
width as (select len(any_value(x)) as w from design),
products as (
  select i, j, sum(x[i] * x[j]) as value from design, width,
    lateral (select unnest(range(1, w + 1)) as i), lateral (select unnest(range(1, w + 1)) as j)
  group by i, j)"""


NAMES = [n for c in INPUTS for n in (f"{c}_base", *(f"{c}_k{i}" for i in range(KNOTS)))]


def fitted(spark, sf_dir):
    return features.spline_design(table(spark, sf_dir, "lineitem"), INPUTS, TARGET, KNOTS)


@query("regression_sums", f"""
with {design_sql()}, n as (select count(*) as n from lineitem)
select cast(i - 1 as int) as i, cast(j - 1 as int) as j, {rounded_sql('value / n')} as value
from products, n where i <= j""")
def regression_sums(spark, sf_dir):
    """All mean products of the design, from one pass."""
    wide, names = fitted(spark, sf_dir)
    n = wide.agg(F.count("*")).scalar()
    return features.gram(wide, [*names, TARGET]).select(
        "i", "j", rounded(F.col("value") / n).alias("value"))


# The same normal equations, solved by elimination: step k clears column k everywhere else.
@query("additive_spline_regression", f"""
with recursive {design_sql()},
n as (select count(*)::double as n from lineitem),
augmented as (
  select list(r order by i) as m from (
    select i, list(value + case when i = j and i <= {len(NAMES)} then {RIDGE} * n else 0 end order by
                   case when j = {len(NAMES) + 1} then 1000 else j end) as r
    from products, n where i <> {len(NAMES) + 1} group by i)),
solved as (
  select 0 as k, m from augmented
  union all
  select k + 1, list_transform(m, lambda r, i: case when i = k + 1
      then list_transform(r, lambda v: v / m[k + 1][k + 1])
      else list_transform(r, lambda v, c: v - m[i][k + 1] * m[k + 1][c] / m[k + 1][k + 1]) end)
  from solved where k < {len(NAMES) + 1})
select unnest({[*NAMES, '(intercept)']}) as feature,
       unnest(list_transform(m, lambda r: round(r[-1], 4) + cast(0 as double))) as weight
from solved where k = {len(NAMES) + 1}""")
def regression(spark, sf_dir):
    fit = features.additive_spline_regression(
        table(spark, sf_dir, "lineitem"), INPUTS, TARGET, KNOTS, RIDGE)
    return fit.where("feature <> '(r2)'").select("feature", (F.round("weight", 4) + F.lit(0.0)).alias("weight"))
