"""Registered queries: each runs one operator over a whole table, with the same computation in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keyed, scalars
from ..functions.keyed import sql_normal, sql_uniform
from ..operators import estimators, evaluate, fdr, gmm, knockoffs, solvers, stats
from ..operators.terms import Term, dictionary, expand, linear, n_terms, terms_table
from ..sources import tables
from ..sources.scratch import Written
from . import simulate, sweep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def _clip(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-8::DOUBLE THEN (CASE WHEN {x} >= 0 THEN 1e-8::DOUBLE ELSE -1e-8::DOUBLE END) ELSE {x} END)"


# --- Terms of the dictionary -----------------------------------------------------------------------------------------


@query(f"""SELECT o_orderkey, round({_clip('x')}, 6) AS t0, round(pow({_clip('x')}, 2), 6) AS t1, round(pow({_clip('x')}, -1), 6) AS t2,
       round(pow({_clip('x')}, -2), 6) AS t3 FROM (SELECT o_orderkey, o_totalprice / 123456.789::DOUBLE AS x FROM orders)""")
def poly_monomials_d2(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 123456.789).alias("x"))
    wide = expand(df, ["x"], dictionary(1, 2, bias=False), ["o_orderkey"])
    return wide.select("o_orderkey", *(r(f"t{k}").alias(f"t{k}") for k in range(4)))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(pow({_clip('l_discount')}, -1)), 2) AS mean_inverse FROM lineitem GROUP BY l_returnflag")
def poly_clip_negative_power(spark, sf_dir):
    df = expand(table(spark, sf_dir, "lineitem"), ["l_discount"], [Term((0,), (-1,))], ["l_returnflag"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("t0"), 2).alias("mean_inverse"))


def _pairs(degree: int) -> list[Term]:
    return [t for t in dictionary(2, degree, bias=False) if t.kind == "interaction"]


def _pair_sql(degree: int) -> str:
    cols = ", ".join(f"round(pow(a, {t.exp[0]}) * pow(b, {t.exp[1]}), 6) AS t{k}" for k, t in enumerate(_pairs(degree)))
    return f"SELECT p_partkey, {cols} FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 1234.567::DOUBLE AS b FROM part)"


def _pair_query(spark, sf_dir, degree):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 1234.567).alias("b"))
    terms = _pairs(degree)
    return expand(df, ["a", "b"], terms, ["p_partkey"]).select("p_partkey", *(r(f"t{k}").alias(f"t{k}") for k in range(len(terms))))


@query(_pair_sql(2))
def poly_interactions_d2(spark, sf_dir):
    return _pair_query(spark, sf_dir, 2)


@query(_pair_sql(3))
def poly_interactions_d3(spark, sf_dir):
    return _pair_query(spark, sf_dir, 3)


@query("""WITH s AS (SELECT DISTINCT p_size AS p FROM part), d AS (SELECT unnest(range(1, 5)) AS d)
SELECT p::INT AS p, d::INT AS degree, (2*p*d + p*(p-1)*d*(d-1) + 1)::BIGINT AS n_terms FROM s, d""")
def n_expanded_formula(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("p")).distinct()
    return sizes.withColumn("degree", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("n_terms", n_terms(F.col("p").cast("long"), F.col("degree")))


@query("""WITH e AS (SELECT unnest([-2,-1,1,2]) AS e), f AS (SELECT column_name AS name, row_number() OVER (ORDER BY column_name) - 1 AS i FROM (VALUES ('p_retailprice'), ('p_size')) v(column_name)),
o AS (SELECT i, e, name || CASE WHEN e = 1 THEN '' WHEN e > 0 THEN '^' || e ELSE '^(' || e || ')' END AS name FROM f, e),
m AS (SELECT i::VARCHAR || '^' || e AS term_key, name FROM o), x AS (SELECT a.i || '^' || a.e || '*' || b.i || '^' || b.e AS term_key, a.name || '*' || b.name AS name FROM o a, o b WHERE a.i < b.i AND abs(a.e) + abs(b.e) <= 2),
t AS (SELECT * FROM m UNION ALL SELECT * FROM x UNION ALL SELECT '1', '1')
SELECT p_brand, term_key, name, count(*) AS n FROM t, part GROUP BY ALL""")
def dictionary_terms(spark, sf_dir):
    names = ["p_retailprice", "p_size"]
    terms = terms_table(spark, dictionary(2, 2), names).select("term_key", "name")
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return brands.crossJoin(F.broadcast(terms)).select("p_brand", "term_key", "name", "n")  # a dictionary of two features


# --- Moments ---------------------------------------------------------------------------------------------------------


def _standard_sql(std: str) -> str:
    return f"WITH s AS (SELECT avg(p_retailprice) AS m, {std}(p_retailprice) AS s FROM part) SELECT p_partkey, round((p_retailprice - m) / s, 6) AS z FROM part, s"


@query(_standard_sql("stddev_pop"))
def standardize_ddof0(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    mean, scale = stats.moments(df, ["p_retailprice"])
    return df.select("p_partkey", *stats.standardised(["p_retailprice"], mean, scale)).select("p_partkey", r("p_retailprice").alias("z"))


@query(_standard_sql("stddev_samp"))
def standardize_ddof1(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    mean, scale = stats.moments(df, ["p_retailprice"], ddof=1)
    return df.select("p_partkey", *stats.standardised(["p_retailprice"], mean, scale)).select("p_partkey", r("p_retailprice").alias("z"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(var_pop(l_quantity), 4) AS var_quantity,
       min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(stddev_samp(l_tax), 6) AS sd_tax FROM lineitem GROUP BY ALL""")
def column_moments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"), r(F.var_pop("l_quantity"), 4).alias("var_quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), r(F.stddev_samp("l_tax")).alias("sd_tax"))


_DIMS = 64
_COV = f"l AS (SELECT vec_id, unnest(range({_DIMS})) AS i, unnest(embedding[1:{_DIMS}])::DOUBLE AS e FROM embeddings), c AS (SELECT a.i, b.i AS j, covar_samp(a.e, b.e) AS c FROM l a JOIN l b USING (vec_id) GROUP BY ALL)"


def _embedded(spark, sf_dir, dims: int = _DIMS) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(dims)))


def _long(spark: SparkSession, matrix: np.ndarray, name: str) -> DataFrame:
    """A small matrix of statistics as rows (i, j, value)."""
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(matrix)]
    return spark.createDataFrame(rows, f"i int, j int, {name} double")


@query(f"WITH {_COV} SELECT i::INT AS i, j::INT AS j, round(c, 8) AS cov FROM c")
def covariance_long(spark, sf_dir):
    _, cov, _ = knockoffs.covariance(_embedded(spark, sf_dir), [f"e{k}" for k in range(_DIMS)])
    return _long(spark, cov, "cov").withColumn("cov", r("cov", 8))


_GRAM_TERMS = ["q", "pow(q, 2)", "pow(q, -1)", "t", "q * t", "q * pow(t, -1)"]
_GRAM_SQL = f"""WITH x AS (SELECT l_quantity / 10.0::DOUBLE AS q, l_tax + 1.0::DOUBLE AS t FROM lineitem),
w AS (SELECT {', '.join(f'{e} AS w{k}' for k, e in enumerate(_GRAM_TERMS))} FROM x), s AS (SELECT {', '.join(f'avg(w{k}) AS m{k}, stddev_pop(w{k}) AS s{k}' for k in range(6))} FROM w),
z AS (SELECT {', '.join(f'(w{k} - m{k}) / s{k} AS z{k}' for k in range(6))} FROM w, s)
""" + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(avg(z{i} * z{j}), 6) AS g FROM z" for i in range(6) for j in range(6))


@query(_GRAM_SQL)
def gram_long(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10.0).alias("q"), (F.col("l_tax") + 1.0).alias("t"))
    terms = [Term((0,), (1,)), Term((0,), (2,)), Term((0,), (-1,)), Term((1,), (1,)), Term((0, 1), (1, 1)), Term((0, 1), (1, -1))]
    wide = expand(df, ["q", "t"], terms)
    names = [f"t{k}" for k in range(6)]
    z = wide.select(*stats.standardised(names, *stats.moments(wide, names)))
    g = stats.total(stats.gram(z, names, "t0"))
    return _long(spark, g.a[1:-1, 1:-1] / g.n, "g").withColumn("g", r("g"))


@query("""WITH s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mr, stddev_pop(p_retailprice) AS sr, avg(pow(p_size, -1)) AS mi, stddev_pop(pow(p_size, -1)) AS si FROM part),
z AS (SELECT (p_size - ms) / ss AS z0, (pow(p_size, -1) - mi) / si AS z1, (p_retailprice - mr) / sr AS y FROM part, s),
c AS (SELECT 'p_size' AS name, abs(avg(z0 * y)) AS c FROM z UNION ALL SELECT 'p_size^(-1)', abs(avg(z1 * y)) FROM z)
SELECT name, round(c, 8) AS score, row_number() OVER (ORDER BY round(c, 8) DESC, name)::INT AS rank FROM c""")
def xty_screen_topk(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    wide = expand(df, ["p_size"], [Term((0,), (1,)), Term((0,), (-1,))], ["p_retailprice"])
    names = ["t0", "t1", "p_retailprice"]
    g = stats.total(stats.gram(wide.select(*stats.standardised(names, *stats.moments(wide, names))), names[:2], names[2]))
    out = spark.createDataFrame([(t, float(v)) for t, v in zip(["p_size", "p_size^(-1)"], np.abs(g.a[1:-1, -1]) / g.n, strict=True)], "name string, score double").withColumn("score", r("score", 8))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "name")))


_GERSH = f"WITH {_COV}"


@query(_GERSH + " SELECT round(min(d), 8) AS bound FROM (SELECT i, sum(CASE WHEN i = j THEN c ELSE -abs(c) END) AS d FROM c GROUP BY i)")
def gershgorin_bound(spark, sf_dir):
    _, cov, _ = knockoffs.covariance(_embedded(spark, sf_dir), [f"e{k}" for k in range(_DIMS)])
    return spark.createDataFrame([(knockoffs.gershgorin(cov),)], "bound double").select(r("bound", 8).alias("bound"))


@query(_GERSH + """, b AS (SELECT min(d) AS low FROM (SELECT i, sum(CASE WHEN i = j THEN c ELSE -abs(c) END) AS d FROM c GROUP BY i)), m AS (SELECT min(c) AS v FROM c WHERE i = j)
SELECT i::INT AS i, round(greatest(1e-10::DOUBLE, least(2 * low, v - 1e-10::DOUBLE)), 8) AS s FROM c, b, m WHERE i = j""")
def s_values_gershgorin(spark, sf_dir):
    _, cov, _ = knockoffs.covariance(_embedded(spark, sf_dir), [f"e{k}" for k in range(_DIMS)])
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(knockoffs.s_values_bound(cov))], "i int, s double").withColumn("s", r("s", 8))


# --- Planted responses -----------------------------------------------------------------------------------------------

def _planted_sql(p: int) -> str:
    made = ", ".join(f"0.5::DOUBLE + {sql_uniform('o_orderkey', 1, f'x{j}')} * 2.5::DOUBLE AS x{j}" for j in range(p))
    return f"SELECT o_orderkey, {', '.join(f'x{j}' for j in range(p))}, x0 + 1.0::DOUBLE / x1 + 0.1::DOUBLE * {sql_normal('o_orderkey', 1, 'noise')} AS y FROM (SELECT o_orderkey, {made} FROM orders)"


_PLANTED = _planted_sql(3)
TRUTH = [Term((0,), (1,)), Term((1,), (-1,))]


def planted(spark: SparkSession, sf_dir: str, p: int = 3) -> DataFrame:
    """Orders with p keyed uniform features on (0.5, 3) and y = x0 + 1/x1 + 0.1 noise."""
    return _plant(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", p)


def _plant(df: DataFrame, key: str, p: int) -> DataFrame:
    return simulate.planted(simulate.uniform_features(df, key, p, 1), key, p, TRUTH, [1.0, 1.0], 0.1, 1)


def _coefs(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, coef double").withColumn("coef", r("coef"))


@query(f"WITH d AS ({_PLANTED}) SELECT 'x0' AS name, round(regr_slope(y, x0), 6) AS coef FROM d UNION ALL SELECT 'intercept', round(regr_intercept(y, x0), 6) FROM d")
def ols_1var(spark, sf_dir):
    g = stats.total(stats.gram(planted(spark, sf_dir), ["x0"], "y"))
    s, c, _, m, y = g.centred()
    b = solvers.ols(s, c)
    return _coefs(spark, {"x0": b[0], "intercept": y - m @ b})


_TWO = f"""WITH d AS ({_PLANTED}), m AS (SELECT count(*)::DOUBLE AS n, covar_pop(x0, x0) AS a, covar_pop(x0, x1) AS b, covar_pop(x1, x1) AS c, covar_pop(x0, y) AS u, covar_pop(x1, y) AS v FROM d),
q AS (SELECT *, LAMBDA / n AS l FROM m) SELECT 'x0' AS name, round(((c + l) * u - b * v) / ((a + l) * (c + l) - b * b), 6) AS coef FROM q UNION ALL SELECT 'x1', round(((a + l) * v - b * u) / ((a + l) * (c + l) - b * b), 6) FROM q"""


def _two(spark, sf_dir, alpha: float) -> DataFrame:
    g = stats.total(stats.gram(planted(spark, sf_dir), ["x0", "x1"], "y"))
    s, c, *_ = g.centred()
    b = solvers.ridge(s, c, alpha, g.n) if alpha else solvers.ols(s, c)
    return _coefs(spark, {"x0": b[0], "x1": b[1]})


@query(_TWO.replace("LAMBDA", "0.0::DOUBLE"))
def ols_2var(spark, sf_dir):
    return _two(spark, sf_dir, 0.0)


@query(_TWO.replace("LAMBDA", "50.0::DOUBLE"))
def ridge_2var(spark, sf_dir):
    return _two(spark, sf_dir, 50.0)


@query("SELECT p_partkey, round(sign(x)::DOUBLE * greatest(abs(x) - 0.3::DOUBLE, 0.0::DOUBLE), 6) AS shrunk FROM (SELECT p_partkey, p_retailprice / 1000.0::DOUBLE - 1.5::DOUBLE AS x FROM part)")
def soft_threshold(spark, sf_dir):
    x = F.col("p_retailprice") / 1000.0 - 1.5
    return table(spark, sf_dir, "part").select("p_partkey", r(scalars.soft_threshold(x, 0.3)).alias("shrunk"))


_SIGNS = [f"(CASE WHEN (o_orderkey // {2**k}) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" for k in range(2)]


@query(f"""WITH d AS (SELECT {_SIGNS[0]} AS z, ({_SIGNS[0]} * 0.8::DOUBLE + {sql_normal('o_orderkey', 2, 'e')}) AS y FROM orders), c AS (SELECT covar_pop(z, y) AS c, var_pop(z) AS v FROM d)
SELECT 'z' AS name, round(sign(c)::DOUBLE * greatest(abs(c) - 0.25::DOUBLE, 0.0::DOUBLE) / v, 6) AS coef FROM c""")
def lasso_one_column(spark, sf_dir):
    z = F.when(F.floor(F.col("o_orderkey")) % 2 == 0, 1.0).otherwise(-1.0)
    df = table(spark, sf_dir, "orders").select(z.alias("z"), (z * 0.8 + keyed.normal(F.col("o_orderkey"), 2, "e")).alias("y"))
    s, c, *_ = stats.total(stats.gram(df, ["z"], "y")).centred()
    return _coefs(spark, {"z": solvers.lasso(s, c, 0.25)[0]})


@query("""SELECT p_brand, round(least(10.0::DOUBLE, greatest(1e-4::DOUBLE, 0.5::DOUBLE * stddev_pop(p_retailprice) / 1000.0::DOUBLE * sqrt(2 * ln(count(DISTINCT p_size)::DOUBLE) / count(*)))), 8) AS alpha
FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1""")
def lasso_theory_alpha(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.stddev_pop("p_retailprice") / 1000.0).alias("s"), F.count("*").alias("n"), F.countDistinct("p_size").alias("p")).where("p > 1")
    return g.select("p_brand", r(scalars.theory_alpha(F.col("s"), F.col("n"), F.col("p")), 8).alias("alpha"))


@query("SELECT p_size::INT AS p, n, round(least(1.0::DOUBLE, greatest(0.01::DOUBLE, (CASE WHEN p_size <= n THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * sqrt(ln(p_size::DOUBLE) / n))), 8) AS alpha FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)")
def adaptive_alpha_grid(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("p")).agg(F.count("*").alias("n"))
    return g.select("p", "n", r(scalars.adaptive_alpha(F.col("n"), F.col("p")), 8).alias("alpha"))


@query("""SELECT c_custkey, n, p, greatest(1, least(floor(s / 2), floor(n / 3.0), floor(p / 3.0), 15))::INT AS k FROM (SELECT *, CASE WHEN p > n THEN floor(n / (2 * ln(p::DOUBLE / n))) ELSE floor(least(n, p) / 2.0) END AS s
FROM (SELECT c_custkey, 5 + c_custkey % 97 AS n, 3 + (c_custkey * 7) % 211 AS p FROM customer))""")
def omp_sparsity_rule(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", (5 + F.col("c_custkey") % 97).alias("n"), (3 + (F.col("c_custkey") * 7) % 211).alias("p"))
    return df.withColumn("k", scalars.omp_sparsity(F.col("n"), F.col("p")))


@query(f"WITH d AS ({_PLANTED}), c AS (SELECT 'x0' AS name, abs(corr(x0, y)) AS c FROM d UNION ALL SELECT 'x1', abs(corr(x1, y)) FROM d UNION ALL SELECT 'x2', abs(corr(x2, y)) FROM d) SELECT name, round(c, 6) AS score FROM c ORDER BY c DESC, name LIMIT 1")
def omp_first_step(spark, sf_dir):
    s, c, v, *_ = stats.total(stats.gram(planted(spark, sf_dir), ["x0", "x1", "x2"], "y")).centred()
    score = np.abs(c) / np.sqrt(np.diag(s) * v)
    j = int(np.flatnonzero(solvers.omp(s, c, 1))[0])
    return spark.createDataFrame([(f"x{j}", float(score[j]))], "name string, score double").withColumn("score", r("score"))


@query(f"SELECT p_brand, p_partkey, abs(c) >= 0.1::DOUBLE * max(abs(c)) OVER (PARTITION BY p_brand) AS keep FROM (SELECT p_brand, p_partkey, pow({sql_normal('p_partkey', 3, 'c')}, 3) AS c FROM part)")
def stlsq_threshold_mask(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.pow(keyed.normal(F.col("p_partkey"), 3, "c"), F.lit(3.0)).alias("c"))
    return df.select("p_brand", "p_partkey", (F.abs("c") >= 0.1 * F.max(F.abs("c")).over(Window.partitionBy("p_brand"))).alias("keep"))


# --- Mixtures --------------------------------------------------------------------------------------------------------

_LOGPDF = " + ".join(f"pow(e{k} - 0.01::DOUBLE * {k}, 2) / 0.04::DOUBLE" for k in range(_DIMS))


@query(f"SELECT vec_id, round(-0.5::DOUBLE * ({_LOGPDF} + {_DIMS} * ln(2 * pi() * 0.04::DOUBLE)), 5) AS logpdf FROM (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(_DIMS)) + " FROM embeddings)")
def gaussian_logpdf_diag(spark, sf_dir):
    normal = gmm.Mixture(np.ones(1), 0.01 * np.arange(_DIMS)[None, :], np.eye(_DIMS)[None] / 0.04)
    out = gmm.with_responsibilities(_embedded(spark, sf_dir), [f"e{k}" for k in range(_DIMS)], normal, ["vec_id"])
    return out.select("vec_id", r("loglik", 5).alias("logpdf"))


_MIX = gmm.Mixture(np.array([0.4, 0.6]), np.array([[20.0], [60.0]]), np.array([[[1 / 225.0]], [[1 / 400.0]]]))
_JOINT = "ln(0.4::DOUBLE) - 0.5::DOUBLE * (ln(2 * pi() * 225) + pow(value - 20, 2) / 225) AS a, ln(0.6::DOUBLE) - 0.5::DOUBLE * (ln(2 * pi() * 400) + pow(value - 60, 2) / 400) AS b"
_RESP = f"SELECT *, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS r0, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS ll FROM (SELECT event_id, value, {_JOINT} FROM events WHERE value IS NOT NULL)"


def _responsible(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events").where("value is not null").select("event_id", F.col("value").cast("double").alias("value"))
    return gmm.with_responsibilities(df, ["value"], _MIX, ["event_id"])


@query(f"SELECT event_id, round(r0, 6) AS r0, round(ll, 5) AS loglik FROM ({_RESP})")
def gmm_responsibilities_k2(spark, sf_dir):
    return _responsible(spark, sf_dir).select("event_id", r(F.col("responsibilities")[0]).alias("r0"), r("loglik", 5).alias("loglik"))


@query(f"""WITH q AS ({_RESP}), w AS (SELECT 0::INT AS k, r0 AS w, value FROM q UNION ALL SELECT 1, 1 - r0, value FROM q), m AS (SELECT k, sum(w) AS n, sum(w * value) / sum(w) AS m, sum(w * value * value) / sum(w) AS s FROM w GROUP BY k)
SELECT k, round(n / (SELECT sum(n) FROM m), 6) AS weight, round(m, 4) AS mean, round(s - m * m, 3) AS variance FROM m""")
def gmm_mstep_k2(spark, sf_dir):
    df = table(spark, sf_dir, "events").where("value is not null").select(F.col("value").cast("double").alias("value"))
    sums, _ = gmm.weighted_sums(df, ["value"], _MIX)
    weight, mean, precision = gmm._maximise(sums, 0.0, 0.0)
    rows = [(k, float(weight[k]), float(mean[k, 0]), float(1 / precision[k, 0, 0])) for k in range(2)]
    return spark.createDataFrame(rows, "k int, weight double, mean double, variance double").select("k", r("weight").alias("weight"), r("mean", 4).alias("mean"), r("variance", 3).alias("variance"))


@query(f"SELECT count(*) AS n, round(avg(ll), 6) AS mean_loglik, round((2 * (1 + 1 + 1.0::DOUBLE) * ln(count(*)) - 2 * sum(ll)) / count(*), 6) AS bic_per_row FROM ({_RESP})")
def gmm_bic(spark, sf_dir):
    m = gmm.scored(table(spark, sf_dir, "events"), ["value"], _MIX)
    return spark.createDataFrame([(int(round(m.n)), m.loglik / m.n, float(m.bic / m.n))], "n long, mean_loglik double, bic_per_row double").select("n", r("mean_loglik").alias("mean_loglik"), r("bic_per_row").alias("bic_per_row"))


@query("WITH s AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, covar_samp(p_size, p_retailprice) / var_samp(p_size) AS k FROM part) SELECT p_partkey, round(b + k * (p_size - a), 4) AS mean FROM part, s")
def conditional_mean_1d(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    mean, cov, _ = knockoffs.covariance(df, ["a", "b"])
    normal = gmm.Mixture(np.ones(1), mean[None, :], np.linalg.inv(cov)[None])
    return gmm.with_conditional_means(df, ["a", "b"], normal, [0], ["p_partkey"]).select("p_partkey", r(F.col("means")[0], 4).alias("mean"))


# --- Knockoffs and selection -----------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT avg(x) AS m, var_samp(x) AS v FROM (SELECT p_retailprice / 1000.0::DOUBLE AS x FROM part)), t AS (SELECT m, v, least(2 * v, v - 1e-10::DOUBLE) AS s FROM s)
SELECT p_partkey, round(m + (1 - s / v) * (p_retailprice / 1000.0::DOUBLE - m) + sqrt(2 * s - s * s / v) * {sql_normal('p_partkey', 5, 'knock0')}, 5) AS knock FROM part, t""")
def knockoff_1d_equicorrelated(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000.0).alias("x"))
    mean, cov, _ = knockoffs.covariance(df, ["x"])
    return knockoffs.with_knockoffs(df, ["x"], F.col("p_partkey"), 5, sampler=knockoffs.Sampler.gaussian(mean, cov)).select("p_partkey", r("knock_x", 5).alias("knock"))


_N = {k: sql_normal("o_orderkey", 6, k) for k in ("a", "b", "knock0", "knock1")}


@query(f"""WITH d AS (SELECT {_N['a']} AS x0, 0.5::DOUBLE * {_N['a']} + sqrt(0.75::DOUBLE) * {_N['b']} AS x1, {_N['knock0']} AS z0, {_N['knock1']} AS z1 FROM orders),
k AS (SELECT x0, x1, x0 - (4.0::DOUBLE / 3 * x0 - 2.0::DOUBLE / 3 * x1) * (1 - 1e-10::DOUBLE) + (sqrt(2.0::DOUBLE / 3) * z0) AS k0,
 x1 - (4.0::DOUBLE / 3 * x1 - 2.0::DOUBLE / 3 * x0) * (1 - 1e-10::DOUBLE) + (sqrt(2.0::DOUBLE / 3) * z0 + 0.0::DOUBLE * z1) AS k1 FROM d)
SELECT round(covar_samp(k0, k0), 3) AS v0, round(covar_samp(k1, k1), 3) AS v1, round(covar_samp(k0, k1), 3) AS c01, round(covar_samp(x0, k1), 3) AS cross01, round(covar_samp(x0, k0), 3) AS cross00 FROM k""")
def knockoff_moments(spark, sf_dir):
    key = F.col("o_orderkey")
    a, b = keyed.normal(key, 6, "a"), keyed.normal(key, 6, "b")
    df = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("x0"), (0.5 * a + float(np.sqrt(0.75)) * b).alias("x1"))
    sampler = knockoffs.Sampler.gaussian(np.zeros(2), np.array([[1.0, 0.5], [0.5, 1.0]]))
    k = knockoffs.with_knockoffs(df, ["x0", "x1"], key, 6, sampler=sampler)
    cov = lambda x, y: r(F.covar_samp(x, y), 3)
    return k.agg(cov("knock_x0", "knock_x0").alias("v0"), cov("knock_x1", "knock_x1").alias("v1"), cov("knock_x0", "knock_x1").alias("c01"), cov("x0", "knock_x1").alias("cross01"), cov("x0", "knock_x0").alias("cross00"))


@query(f"SELECT o_orderpriority, count(*) AS n, round(avg(z), 6) AS mean, round(var_pop(z), 6) AS variance FROM (SELECT o_orderpriority, {sql_normal('o_orderkey', 7, 'z')} AS z FROM orders) GROUP BY ALL")
def keyed_normal_moments(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", keyed.normal(F.col("o_orderkey"), 7, "z").alias("z"))
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.avg("z")).alias("mean"), r(F.var_pop("z")).alias("variance"))


_BETAS = f"SELECT p_partkey, p_brand, round({sql_normal('p_partkey', 8, 'b')} + (CASE WHEN p_partkey % 5 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS beta, round({sql_normal('p_partkey', 8, 'k')}, 4) AS knock FROM part"
_W = f"SELECT p_partkey, p_brand, round(greatest(abs(beta), abs(knock)) * sign(abs(beta) - abs(knock))::DOUBLE, 4) AS w FROM ({_BETAS})"


def _betas(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    beta = keyed.normal(key, 8, "b") + F.when(key % 5 == 0, 2.0).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", r(beta, 4).alias("beta"), r(keyed.normal(key, 8, "k"), 4).alias("knock"))


def _w(spark, sf_dir) -> DataFrame:
    return _betas(spark, sf_dir).select("p_partkey", "p_brand", r(scalars.w_signed_max(F.col("beta"), F.col("knock")), 4).alias("w"))


@query(_W)
def w_signed_max(spark, sf_dir):
    return _w(spark, sf_dir)


@query(f"SELECT p_partkey, round(abs(beta) - abs(knock), 4) AS w FROM ({_BETAS})")
def w_difference(spark, sf_dir):
    return _betas(spark, sf_dir).select("p_partkey", r(scalars.w_difference(F.col("beta"), F.col("knock")), 4).alias("w"))


def _spending_sql(share: str) -> str:
    return f"SELECT t, round(q, 10) AS q_t, round(sum(q) OVER (ORDER BY t), 8) AS spent FROM (SELECT t, {share} AS q FROM (SELECT DISTINCT p_size::INT AS t FROM part))"


def _spent(spark, sf_dir, rule: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_size").alias("t")).distinct()
    return t.withColumn("q", scalars.spending(F.col("t"), 0.1, rule)).select("t", r("q", 10).alias("q_t"), r(F.sum("q").over(Window.orderBy("t")), 8).alias("spent"))  # at most 50 sizes


@query(_spending_sql("6 * 0.1::DOUBLE / (pi() * pi() * t * t)"))
def alpha_spending_zeta(spark, sf_dir):
    return _spent(spark, sf_dir, "zeta")


@query(_spending_sql("0.1::DOUBLE * 0.5::DOUBLE * pow(0.5::DOUBLE, t - 1)"))
def alpha_spending_geometric(spark, sf_dir):
    return _spent(spark, sf_dir, "geometric")


@query(_spending_sql("0.1::DOUBLE / (t * (t + 1.0::DOUBLE))"))
def alpha_spending_telescoping(spark, sf_dir):
    return _spent(spark, sf_dir, "telescoping")


def _tau_sql(offset: int, q: float, by: bool = True, pick: str = "min") -> str:
    g, p = ("p_brand, ", "PARTITION BY p_brand ") if by else ("", "")
    steps = f"SELECT {g}abs(w) AS s, count(*) FILTER (w > 0) AS pos, count(*) FILTER (w < 0) AS neg FROM w WHERE w <> 0 GROUP BY ALL"
    ratio = f"SELECT {g}s, ({offset} + sum(neg) OVER ({p}ORDER BY s DESC))::DOUBLE / greatest(1, sum(pos) OVER ({p}ORDER BY s DESC)) AS ratio FROM ({steps})"
    best = f"SELECT {g}{pick}(s) FILTER (ratio <= {q}::DOUBLE) AS tau FROM ({ratio}) GROUP BY ALL"
    return f"WITH w AS ({_W}) " + (f"SELECT b.p_brand, t.tau FROM (SELECT DISTINCT p_brand FROM w) b LEFT JOIN ({best}) t USING (p_brand)" if by else best)


@query(_tau_sql(0, 0.2, by=False))
def knockoff_threshold_offset0(spark, sf_dir):
    return fdr.threshold_frame(_w(spark, sf_dir), "w", 0.2, 0)


@query(_tau_sql(1, 0.2, by=False))
def knockoff_threshold_offset1(spark, sf_dir):
    return fdr.threshold_frame(_w(spark, sf_dir), "w", 0.2, 1)


@query(_tau_sql(1, 0.3))
def knockoff_threshold_grouped(spark, sf_dir):
    return fdr.threshold_frame(_w(spark, sf_dir), "w", 0.3, 1, ["p_brand"])


@query(_tau_sql(0, 0.3, pick="max"))
def knockoff_threshold_largest(spark, sf_dir):
    return fdr.threshold_frame(_w(spark, sf_dir), "w", 0.3, 0, ["p_brand"], largest=True)


@query(f"WITH w AS ({_W}) SELECT p_partkey, w FROM w WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_partkey = w.p_partkey AND a.p_size > 25)")
def active_set_exclusion(spark, sf_dir):
    active = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    return _w(spark, sf_dir).join(active, "p_partkey", "left_anti").select("p_partkey", "w")


@query(_tau_sql(1, 0.3).replace("WITH w AS", "WITH w AS", 1).replace("SELECT b.p_brand, t.tau", ", tau AS (SELECT b.p_brand, t.tau", 1) + ") SELECT w.p_brand, w.p_partkey, w.w FROM w JOIN tau USING (p_brand) WHERE w.w >= tau.tau")
def select_terms_above_tau(spark, sf_dir):
    w = _w(spark, sf_dir)
    return fdr.select(w, "w", fdr.threshold_frame(w, "w", 0.3, 1, ["p_brand"]), ["p_brand"]).select("p_brand", "p_partkey", "w")


# --- Evaluation ------------------------------------------------------------------------------------------------------

_FIT = f"SELECT *, 0.9::DOUBLE * x0 + 1.1::DOUBLE / x1 + 0.05::DOUBLE AS f FROM ({_PLANTED})"


def _fitted(spark, sf_dir) -> DataFrame:
    df = planted(spark, sf_dir)
    return df.withColumn("f", linear(TRUTH, [0.9, 1.1], 0.05, [F.col(f"x{j}") for j in range(3)]))


@query(f"""WITH s AS (SELECT count(*)::DOUBLE AS n, sum(pow(y - f, 2)) AS sse, var_pop(y) * count(*) AS sst FROM ({_FIT})), l AS (SELECT *, -0.5::DOUBLE * n * (ln(2 * pi() * sse / n) + 1) AS ll FROM s)
SELECT n, round(sse / n, 6) AS mse, round(sst / n, 6) AS mst, round(1 - sse / sst, 6) AS r2, round(1 - (sse / sst) * (n - 1) / (n - 3), 6) AS adj_r2, round(ll / n, 6) AS loglik, round((3 * ln(n) - 2 * ll) / n, 6) AS bic, round((6 - 2 * ll) / n, 6) AS aic FROM l""")
def fit_stats(spark, sf_dir):
    s = stats.fit_stats_frame(_fitted(spark, sf_dir), "y", "f", 2)
    each = lambda c: r(F.col(c) / F.col("n")).alias(c)
    return s.select("n", r(F.col("sse") / F.col("n")).alias("mse"), r(F.col("sst") / F.col("n")).alias("mst"), r("r2").alias("r2"), r("adj_r2").alias("adj_r2"), each("loglik"), each("bic"), each("aic"))


@query(f"SELECT round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(pow(y - f, 2))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, count(*) AS n_test FROM ({_FIT}) WHERE o_orderkey % 4 = 0")
def test_metrics(spark, sf_dir):
    s = stats.test_metrics(_fitted(spark, sf_dir).where("o_orderkey % 4 = 0"), "y", "f")
    return s.select(r("r2").alias("r2"), r("rmse").alias("rmse"), r("mae").alias("mae"), "n_test")


@query(f"SELECT round(sqrt(sum(pow(y - f, 2)) / count(*)), 6) AS norm_per_row FROM ({_FIT})")
def residual_norm(spark, sf_dir):
    return _fitted(spark, sf_dir).agg(r(F.sqrt(F.sum(F.pow(F.col("y") - F.col("f"), F.lit(2.0))) / F.count("*"))).alias("norm_per_row"))


_SETS = f"WITH p AS (SELECT p_brand, p_partkey AS term_key, {sql_uniform('p_partkey', 9, 's')} < 0.3::DOUBLE AS s, {sql_uniform('p_partkey', 9, 't')} < 0.25::DOUBLE AS t FROM part), c AS (SELECT p_brand, count(*) FILTER (s AND t) AS n_tp, count(*) FILTER (s AND NOT t) AS n_fp, count(*) FILTER (t AND NOT s) AS n_fn FROM p WHERE s OR t GROUP BY p_brand)"


@query(f"""{_SETS} SELECT p_brand, n_tp, n_fp, n_fn, round(n_fp / greatest(1.0::DOUBLE, n_tp + n_fp), 6) AS fdr, round(n_tp / greatest(1.0::DOUBLE, n_tp + n_fn), 6) AS tpr,
 CASE WHEN n_tp + n_fn > 0 THEN round(n_tp / greatest(1.0::DOUBLE, n_tp + n_fn), 6) ELSE 1.0::DOUBLE END AS recall_or_one, CASE WHEN n_tp + n_fp > 0 THEN round(1 - n_fp / greatest(1.0::DOUBLE, n_tp + n_fp), 6) ELSE 0.0::DOUBLE END AS precision,
 round(2.0::DOUBLE * n_tp / greatest(1.0::DOUBLE, 2.0::DOUBLE * n_tp + n_fp + n_fn), 6) AS f1 FROM c""")
def discovery_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("term_key"))
    pick = lambda stream, share: df.where(keyed.uniform(F.col("term_key"), 9, stream) < share)
    out = evaluate.discovery_metrics(pick("s", 0.3), pick("t", 0.25), ["p_brand"])
    return out.select("p_brand", "n_tp", "n_fp", "n_fn", *(r(c).alias(c) for c in ("fdr", "tpr", "recall_or_one", "precision", "f1")))


@query("""WITH c AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 9900) AS n_tp, count(*) FILTER (c_acctbal < -900) AS n_fp, count(*) FILTER (c_acctbal BETWEEN 5000 AND 5050) AS n_fn FROM customer GROUP BY 1)
SELECT c_nationkey, n_tp, n_fp, n_fn, round(n_fp / greatest(1.0::DOUBLE, n_tp + n_fp), 6) AS fdr, round(n_tp / greatest(1.0::DOUBLE, n_tp + n_fn), 6) AS tpr, CASE WHEN n_tp + n_fn > 0 THEN round(n_tp / greatest(1.0::DOUBLE, n_tp + n_fn), 6) ELSE 1.0::DOUBLE END AS recall_or_one FROM c""")
def discovery_edge_cases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 9900).alias("n_tp"), F.count_if(F.col("c_acctbal") < -900).alias("n_fp"), F.count_if(F.col("c_acctbal").between(5000, 5050)).alias("n_fn"))
    return evaluate.with_rates(c).select("c_nationkey", "n_tp", "n_fp", "n_fn", *(r(x).alias(x) for x in ("fdr", "tpr", "recall_or_one")))


@query(f"""{_SETS}, u AS (SELECT p_brand, count(*) AS universe FROM part GROUP BY 1), g AS (SELECT *, greatest(0.0::DOUBLE, universe - (n_tp + n_fn) - n_fp) AS tn FROM c JOIN u USING (p_brand))
SELECT p_brand, universe, round(CASE WHEN n_tp + n_fp > 0 THEN n_tp / (n_tp + n_fp) ELSE 0.0::DOUBLE END, 6) AS precision, round(0.5::DOUBLE * (n_tp / greatest(1.0::DOUBLE, n_tp + n_fn) + CASE WHEN tn + n_fp > 0 THEN tn / greatest(1.0::DOUBLE, tn + n_fp) ELSE 0.0::DOUBLE END), 6) AS auc FROM g""")
def discovery_auc(spark, sf_dir):
    """Precision and area under the curve of selections from dictionaries of different sizes."""
    df = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("term_key"))
    pick = lambda stream, share: df.where(keyed.uniform(F.col("term_key"), 9, stream) < share)
    counts = evaluate.discovery_metrics(pick("s", 0.3), pick("t", 0.25), ["p_brand"]).select("p_brand", "n_tp", "n_fp", "n_fn")
    out = evaluate.with_rates(counts.join(df.groupBy("p_brand").agg(F.count("*").alias("universe")), "p_brand"), F.col("universe"))
    return out.select("p_brand", "universe", r("precision").alias("precision"), r("auc").alias("auc"))


# --- Folds, trials, reports ------------------------------------------------------------------------------------------


@query("SELECT (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INT AS fold, o_orderkey FROM orders")
def kfold_contiguous(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    placed = stats.in_order(df.withColumn("one", F.lit(1)), [F.col("o_orderkey")], ["one"], Written(spark))
    return placed.select(stats.contiguous_fold(F.col("before_one"), df.count(), 5).alias("fold"), "o_orderkey")


_TRIALS = f"SELECT o_orderkey AS id, o_orderpriority AS config, 'm' || (o_orderkey % 4) AS method, round({sql_uniform('o_orderkey', 11, 'r2')}, 4) AS r2, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round({sql_uniform('o_orderkey', 11, 'fdr')}, 4) END AS fdr FROM orders"


def _trials(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderpriority").alias("config"), F.concat(F.lit("m"), (key % 4).cast("string")).alias("method"), r(keyed.uniform(key, 11, "r2"), 4).alias("r2"), F.when(key % 7 != 0, r(keyed.uniform(key, 11, "fdr"), 4)).alias("fdr"))


@query(f"WITH t AS ({_TRIALS}), k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY r2 DESC, id) AS rn FROM t) SELECT config, id AS best, r2 FROM k WHERE rn = 1")
def val_best_param(spark, sf_dir):
    return sweep.best_by(_trials(spark, sf_dir), ["config"], "r2", "id", "id").select("config", F.col("id").alias("best"), "r2")


@query(f"SELECT config, method, count(*) AS n_trials, round(avg(r2), 6) AS r2_mean, round(avg(fdr), 6) AS fdr_mean, round(CASE WHEN count(r2) > 1 THEN stddev_pop(r2) END, 6) AS r2_std, round(CASE WHEN count(fdr) > 1 THEN stddev_pop(fdr) END, 6) AS fdr_std FROM ({_TRIALS}) GROUP BY ALL")
def trial_aggregate(spark, sf_dir):
    out = sweep.trial_aggregate(_trials(spark, sf_dir), ["r2", "fdr"], ["config", "method"])
    return out.select("config", "method", "n_trials", *(r(c).alias(c) for c in ("r2_mean", "fdr_mean", "r2_std", "fdr_std")))


@query(f"SELECT method, round(avg(r2), 3) AS r2_mean, round(stddev_samp(r2), 3) AS r2_std, round(median(r2), 3) AS r2_median FROM ({_TRIALS}) GROUP BY method")
def report_group_stats(spark, sf_dir):
    return sweep.group_stats(_trials(spark, sf_dir), ["method"], ["r2"])


@query("SELECT config, " + ", ".join(f"round(avg(r2) FILTER (method = 'm{k}'), 3) AS m{k}_r2, round(median(fdr) FILTER (method = 'm{k}'), 3) AS m{k}_fdr" for k in range(4)) + f" FROM ({_TRIALS}) GROUP BY config")
def report_pivot(spark, sf_dir):
    return sweep.pivoted(_trials(spark, sf_dir), ["config"], [f"m{k}" for k in range(4)], {"r2": "mean", "fdr": "median"})


@query(f"""WITH t AS ({_TRIALS}), g AS (SELECT config, method, count(r2) AS n_completed, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, avg(fdr) AS fdr_mean, CASE WHEN count(fdr) > 1 THEN stddev_pop(fdr) END AS fdr_std FROM t GROUP BY ALL)
SELECT config, method, id // 500 AS block, id AS trial, r2, fdr, n_completed, round(r2_mean, 6) AS r2_mean, round(CASE WHEN n_completed > 1 THEN r2_std END, 6) AS r2_std, round(fdr_mean, 6) AS fdr_mean, round(fdr_std, 6) AS fdr_std FROM t JOIN g USING (config, method)""")
def sweep_summary(spark, sf_dir):
    """A sweep's nested records written as JSON and read again: each trial beside the means of its configuration."""
    made = sweep.summary(_trials(spark, sf_dir), ["config", "method"], ["r2", "fdr"], ["r2", "fdr"], "id", 500)
    path = Written(spark).path()
    tables.write_json(made, path)
    back = sweep.read_summary(spark.read.schema(made.schema).json(path))
    return back.select("config", "method", "block", "trial", "r2", "fdr", "n_completed", *(r(c).alias(c) for c in ("r2_mean", "r2_std", "fdr_mean", "fdr_std")))


@query(f"SELECT method, count(*) AS n_trials, round(avg(fdr), 3) AS fdr, round(median(r2), 3) AS r2 FROM ({_TRIALS}) WHERE config = '1-URGENT' GROUP BY method")
def metrics_of_config(spark, sf_dir):
    return sweep.filtered_metrics(_trials(spark, sf_dir), {"config": "1-URGENT"}, {"fdr": "mean", "r2": "median"})


@query("SELECT p.p, c.k, d.d::INT AS degree FROM (SELECT DISTINCT p_size AS p FROM part) p, (SELECT DISTINCT c_nationkey AS k FROM customer) c, (SELECT unnest([1, 2, 3]) AS d) d WHERE k < 2 * d * p")
def config_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("p")).distinct()
    k = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    return p.crossJoin(k).withColumn("degree", F.explode(F.array(*(F.lit(d) for d in (1, 2, 3))))).where("k < 2 * degree * p")  # a grid of parameters: 50 by 25 by 3 at most


@query(f"SELECT method, config AS dataset, CAST(id AS VARCHAR) || '|m' AS selected_names, round(r2 - 0.5::DOUBLE, 4) AS intercept, r2 AS fit_r2, CASE WHEN r2 > 0.9 THEN NULL ELSE 10 * r2 END AS fit_sse, fdr AS discovery_fdr, id % 5 AS discovery_n_tp FROM ({_TRIALS})")
def result_json_roundtrip(spark, sf_dir):
    """Results written as JSON and read again; NaN comes back as null."""
    t, null = _trials(spark, sf_dir), lambda kind: F.lit(None).cast(kind)
    fit = F.struct(null("double").alias("n"), null("int").alias("k"), F.when(F.col("r2") > 0.9, float("nan")).otherwise(10 * F.col("r2")).alias("sse"), "r2", null("double").alias("adj_r2"), null("double").alias("bic"), null("double").alias("aic"))
    found = F.struct((F.col("id") % 5).cast("long").alias("n_tp"), null("long").alias("n_fp"), null("long").alias("n_fn"), "fdr", null("double").alias("tpr"))
    made = t.select("method", F.col("config").alias("dataset"), F.array(F.col("id").cast("string"), F.lit("m")).alias("selected_names"), F.array().cast("array<double>").alias("coef"), r(F.col("r2") - 0.5, 4).alias("intercept"), fit.alias("fit"), found.alias("discovery"), F.struct(null("double").alias("elapsed_seconds")).alias("compute"), F.lit(None).cast("map<string, string>").alias("params"))
    path = Written(spark).path()
    tables.write_json(made, path)
    return tables.flat(tables.read_json(spark, path)).select("method", "dataset", "selected_names", "intercept", "fit_r2", "fit_sse", "discovery_fdr", "discovery_n_tp")


@query(f"SELECT method, config AS dataset, id, r2 AS alpha, CASE WHEN id % 3 > 0 THEN config END AS kind, CASE WHEN id % 2 = 0 THEN id + 1 END AS second, id % 5 AS depth, id % 3 = 0 AND fdr IS NOT NULL AS has_extra, CASE WHEN id % 3 = 0 THEN fdr END AS fdr FROM ({_TRIALS})")
def result_open_maps(spark, sf_dir):
    """Results whose parameters differ from row to row, nested and with nulls, written as JSON, read again and asked."""
    null = lambda kind: F.lit(None).cast(kind)
    t = _trials(spark, sf_dir)
    fields = {f.name: null(f.dataType).alias(f.name) for f in tables.OPEN_RESULT.fields if f.name not in ("method", "dataset", "params", "extra")}
    own = t.select("method", F.col("config").alias("dataset"), *fields.values(), "id", F.col("r2").alias("alpha"), F.when(F.col("id") % 3 > 0, F.col("config")).alias("kind"), F.array(F.col("id"), F.when(F.col("id") % 2 == 0, F.col("id") + 1)).alias("list"), F.struct(F.struct((F.col("id") % 5).alias("depth")).alias("in")).alias("tree"), F.when(F.col("id") % 3 == 0, F.col("fdr")).alias("fdr"))
    path = Written(spark).path()
    tables.write_json(tables.with_open(own, params=["id", "alpha", "kind", "list", "tree"], extra=["fdr"]), path)
    back = tables.read_open_json(spark, path)
    said = lambda at, kind, of="params": F.try_variant_get(of, f"$.{at}", kind)
    return back.select("method", "dataset", said("id", "long").alias("id"), said("alpha", "double").alias("alpha"), said("kind", "string").alias("kind"), said("list[1]", "long").alias("second"), said("tree.in.depth", "long").alias("depth"), F.col("extra").isNotNull().alias("has_extra"), said("fdr", "double", "extra").alias("fdr"))


# --- Generators ------------------------------------------------------------------------------------------------------


@query(f"WITH m AS (SELECT p_partkey, CASE WHEN {sql_uniform('p_partkey', 12, 'missing-x')} >= 0.1::DOUBLE THEN p_retailprice END AS x FROM part) SELECT p_partkey, round(coalesce(x, (SELECT avg(x) FROM m)), 4) AS x FROM m")
def mean_impute_mcar(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return simulate.mean_imputed(simulate.with_missing(df, "p_partkey", ["x"], 0.1, 12), ["x"]).select("p_partkey", r("x", 4).alias("x"))


@query(f"""WITH d AS (SELECT p_partkey, p_retailprice AS x, row_number() OVER (ORDER BY {sql_uniform('p_partkey', 13, 'outlier')}, p_partkey) AS k, {sql_uniform('p_partkey', 13, 'sign')} AS u FROM part), s AS (SELECT floor(count(*) * 0.05::DOUBLE) AS n, stddev_pop(x) AS sd FROM d)
SELECT p_partkey, round(CASE WHEN k <= n THEN x + (CASE WHEN u < 0.5::DOUBLE THEN -10.0::DOUBLE ELSE 10.0::DOUBLE END) * sd ELSE x END, 3) AS x FROM d, s""")
def outlier_inject(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return simulate.with_outliers(df, "p_partkey", "x", 0.05, 10.0, 13).select("p_partkey", r("x", 3).alias("x"))


@query(f"SELECT p_partkey, round({sql_normal('p_partkey', 14, 'noise')} * (1 + 0.5::DOUBLE * abs(p_size)), 5) AS noise FROM part")
def hetero_noise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(simulate.heteroscedastic("p_partkey", 14, "p_size", 0.5), 5).alias("noise"))


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{k + 1}]::DOUBLE + greatest(0, 0.5::DOUBLE - (SELECT min(embedding[{k + 1}]::DOUBLE) FROM embeddings) + 1e-9::DOUBLE), 6) AS e{k}" for k in range(_DIMS)) + " FROM embeddings")
def positive_shift(spark, sf_dir):
    names = [f"e{k}" for k in range(_DIMS)]
    return simulate.shifted(_embedded(spark, sf_dir), names, 0.5).select("vec_id", *(r(c).alias(c) for c in names))


@query("SELECT split, count(*) AS n, round(avg(p_retailprice), 4) AS mean, count(y) AS n_labeled FROM (SELECT p_retailprice, 'labeled' AS split, p_size AS y FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_retailprice, 'unlabeled', NULL FROM part WHERE p_partkey % 3 = 0) GROUP BY split")
def union_unlabeled(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = tables.from_frame(part.where("p_partkey % 3 <> 0"), ["p_retailprice"], "p_size", key="p_partkey")
    both = tables.union_unlabeled(own, part.where("p_partkey % 3 = 0")).data
    return both.groupBy("split").agg(F.count("*").alias("n"), r(F.avg("p_retailprice"), 4).alias("mean"), F.count("y").alias("n_labeled"))


# --- Whole fits (iterative: compared by optimality conditions in the tests) ------------------------------------------

_FEATURES = [f"x{j}" for j in range(4)]


def _selection(spark: SparkSession, model: estimators.Fitted) -> DataFrame:
    truth = {t.key for t in TRUTH}
    out = model.selected(spark).select("name", "term_key", r("coef", 5).alias("coef"))
    return out.withColumn("is_true", F.col("term_key").isin(*truth))


def _fit(spark, sf_dir, estimator: estimators.Estimator) -> DataFrame:
    return _selection(spark, estimator.fit(planted(spark, sf_dir, 4), _FEATURES, "y", "o_orderkey"))


@query()
def lasso_theory_select(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolyLasso(sigma="response", interactions=False))


@query()
def lasso_cv_select(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolyLasso(alpha="cv"))


@query()
def knockoff_select(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolyKnockoff(q=0.2))


@query()
def clime_select(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolyClime(q=0.2))


@query()
def ic_select(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.IterativeKnockoffs(q=0.3, max_iter=3))


def _term_sql(term: Term) -> str:
    one = lambda i, e: f"pow({_clip(f'x{i}')}, {e})"
    return " * ".join(one(i, e) for i, e in zip(term.idx, term.exp, strict=True))


def _pair_sql(chosen: str) -> str:
    """Least squares on the two terms that ``chosen`` numbers as a and b, from rows d."""
    terms = dictionary(4, 2, bias=False)
    names = ", ".join(f"({k + 1}, '{t.name(_FEATURES)}', '{t.key}', {str(t in TRUTH).lower()})" for k, t in enumerate(terms))
    return f"""WITH d AS (SELECT o_orderkey, y, [{", ".join(map(_term_sql, terms))}] AS t FROM ({_planted_sql(4)})), names(k, name, term_key, is_true) AS (VALUES {names}),
 l AS (SELECT o_orderkey, y, t, unnest(t) AS v, generate_subscripts(t, 1) AS k FROM d), {chosen},
 m AS (SELECT min(c.a) AS ka, min(c.b) AS kb, var_pop(t[c.a]) AS aa, covar_pop(t[c.a], t[c.b]) AS ab, var_pop(t[c.b]) AS bb, covar_pop(t[c.a], y) AS ay, covar_pop(t[c.b], y) AS yb FROM d, chosen c)
 SELECT name, term_key, round(CASE WHEN k = ka THEN bb * ay - ab * yb ELSE aa * yb - ab * ay END / (aa * bb - ab * ab), 5) AS coef, is_true FROM m JOIN names ON k IN (ka, kb)"""


_GREEDY = """f AS (SELECT k AS a, corr(v, y) AS fy FROM l GROUP BY k ORDER BY abs(fy) DESC, k LIMIT 1),
 chosen AS (SELECT a, k AS b FROM l, f WHERE k <> a GROUP BY a, k, fy ORDER BY abs(corr(v, y) - corr(v, t[a]) * fy) DESC, k LIMIT 1)"""
#: Thresholding must end at the planted terms.
_AT_TRUTH = "chosen AS (SELECT min(k) AS a, max(k) AS b FROM names WHERE is_true)"


@query(_pair_sql(_GREEDY))
def omp_fit(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolyOMP(k=2))


@query(_pair_sql(_AT_TRUTH))
def stlsq_fit(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.PolySTLSQ(interactions=False))


@query()
def improved_stlsq_fit(spark, sf_dir):
    return _fit(spark, sf_dir, estimators.ImprovedSTLSQ(interactions=False))


@query()
def gmm_fit(spark, sf_dir):
    m = gmm.fit(_embedded(spark, sf_dir), [f"e{k}" for k in range(_DIMS)], "vec_id", k=2, max_iter=20)
    rows = [(k, float(m.weight[k]), m.mean[k].tolist(), m.precision[k].tolist()) for k in range(2)]
    return spark.createDataFrame(rows, "k int, weight double, mean array<double>, precision array<array<double>>")


@query()
def gmm_bic_fit(spark, sf_dir):
    """The mixture of two components, of ten penalties, with the least BIC; its components."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (100 * F.col("l_discount")).alias("c"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"))
    m = gmm.fit(df, ["a", "b", "c"], "key", k=2, alpha="bic", max_iter=20, stop="responsibility")
    rows = [(k, float(m.weight[k]), m.mean[k].tolist(), m.precision[k].tolist(), float(m.bic), m.n_iter) for k in range(2)]
    return spark.createDataFrame(rows, "k int, weight double, mean array<double>, precision array<array<double>>, bic double, n_iter int")


@query()
def sweep_small(spark, sf_dir):
    """Trials are groups of about 150 orders each."""
    n = table(spark, sf_dir, "orders").count()
    trials = max(1, n // 150)
    rows = table(spark, sf_dir, "orders").select(F.lit(0).alias("config_id"), F.pmod(F.xxhash64("o_orderkey"), F.lit(trials)).cast("int").alias("trial"), F.col("o_orderkey").alias("row_id"))
    out = sweep.run(rows, ["config_id", "trial"], _FEATURES, "y", TRUTH, list(estimators.METHODS), trials=trials, make=lambda dealt: _plant(dealt, "row_id", 4))
    return out.drop("elapsed_seconds")


@query()
def ic_cv_select(spark, sf_dir):
    """The budget of the iterative estimator by cross-validation, all budgets and folds side by side; its selection."""
    e = estimators.IterativeKnockoffs(max_iter=2, interactions=False)
    m = e.fit_with_cv(planted(spark, sf_dir, 4), _FEATURES, "y", "o_orderkey", (0.05, 0.1, 0.2))
    return _selection(spark, m).withColumn("q", F.lit(m.params["q"])).withColumn("cv_r2", r(F.lit(m.params["cv_r2"][m.params["q"]]), 4))


@query()
def comparison_results(spark, sf_dir):
    """Methods side by side on planted rows: what they select and find of the truth, and how they fit the rows they were
    fitted on and those held out."""
    methods = ["poly_lasso", "poly_omp", "sparse_poly_stlsq", "improved_stlsq", "poly_knockoff"]
    out = estimators.comparison(planted(spark, sf_dir, 3), ["x0", "x1", "x2"], "y", "o_orderkey", methods, TRUTH)
    scores = [r(c, 4 if "r2" in c or "rmse" in c or "mae" in c else 2).alias(c) for c in out.columns if c.startswith(("train_", "test_"))]
    return out.select("method", "n_selected", "selected_names", "tp", "fp", "fn", r("fdr").alias("fdr"), r("tpr").alias("tpr"), *scores)
