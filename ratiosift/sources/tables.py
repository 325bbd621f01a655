"""Reading observations and writing results.

Observations become ``row_id``, ``split`` ("labeled" or "unlabeled"), the features as doubles and the response ``y``
(``response`` where a feature has that name), null for unlabeled rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numpy_files
from .scratch import qualified


@dataclass
class Observations:
    data: DataFrame
    features: list[str]
    source: str
    response: str = "y"
    key: str = "row_id"

    def counts(self) -> dict[str, int]:
        row = self.data.agg(F.count(self.response).alias("labeled"), F.count("*").alias("rows")).first()
        return {"n_labeled": row.labeled, "n_unlabeled": row.rows - row.labeled, "n_features": len(self.features)}


def from_frame(df: DataFrame, features: Sequence[str], y: str | None, source: str = "frame", key: str | None = None) -> Observations:
    response = F.col(y).cast("double") if y else F.lit(None).cast("double")
    name = "response" if "y" in features else "y"
    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    out = df.select(row.alias("row_id"), *(F.col(f).cast("double").alias(f) for f in features), response.alias(name))
    return Observations(out.withColumn("split", F.when(F.col(name).isNull(), "unlabeled").otherwise("labeled")), list(features), source, name)


def union_unlabeled(labeled: Observations, extra: DataFrame) -> Observations:
    """Adds rows without a response; their features are matched by name."""
    if missing := [f for f in labeled.features if f not in extra.columns]:
        raise ValueError(f"the unlabeled rows lack {missing}")
    own = from_frame(extra, labeled.features, None)
    return Observations(labeled.data.unionByName(own.data.withColumn("row_id", -1 - F.col("row_id"))), labeled.features, labeled.source, labeled.response)


def _numeric(spark: SparkSession, path: str, header: bool, sep: str) -> DataFrame:
    """All columns as doubles; without a header they are called x0, x1, ..."""
    raw = spark.read.csv(path, header=header, sep=sep, inferSchema=False)
    if not raw.columns:
        raise ValueError(f"{path} is empty")
    names = raw.columns if header else [f"x{k}" for k in range(len(raw.columns))]
    return raw.toDF(*names).select(*(F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in names))


def read_csv(spark: SparkSession, path: str, response: str | int | None = None, header: bool = True, sep: str = ",", unlabeled_path: str | None = None) -> Observations:
    """The response is the last column unless named or numbered. A second file holds the features of unlabeled rows."""
    df = _numeric(spark, path, header, sep)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    if isinstance(response, str) and not header:
        raise ValueError("a response by name needs a header")
    y = df.columns[-1] if response is None else df.columns[response] if isinstance(response, int) else response
    if y not in df.columns:
        raise ValueError(f"no column {y!r} in {path}")
    features = [c for c in df.columns if c != y]
    out = from_frame(df, features, y, path)
    if unlabeled_path is None:
        return out
    extra = _numeric(spark, unlabeled_path, header, sep)
    if len(extra.columns) != len(features):
        raise ValueError(f"X_unlabeled must have shape (*, {len(features)})")
    return union_unlabeled(out, extra.toDF(*features))


def read_csv_sniffed(spark: SparkSession, path: str, sep: str = ",") -> Observations:
    """A header is assumed if the first line holds anything but numbers; bad and missing cells become 0."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    cells = first.value.split(sep)
    if len(cells) < 2:
        raise ValueError("at least two columns are needed")
    df = _numeric(spark, path, not all(map(number, cells)), sep).fillna(0.0)
    return from_frame(df, df.columns[:-1], df.columns[-1], path)


def _arrays(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """Rows (part, at, row) of a NumPy file, or of one member of an archive, dealt to tasks by byte ranges."""
    numpy_files.register(spark)
    source = spark.read.format("numpy")
    return (source.option("names", name) if name else source).load(qualified(spark, path))


def _assembled(x: DataFrame, y: DataFrame, extra: DataFrame | None, source: str) -> Observations:
    p = x.select(F.size("row").alias("p")).first().p
    names = [f"x{k}" for k in range(p)]
    wide = lambda df: [F.col("row")[k].alias(n) for k, n in enumerate(names)]
    joined = x.select("at", *wide(x)).join(y.select("at", F.col("row")[0].alias("__y")), "at")
    out = from_frame(joined, names, "__y", source, key="at")
    return out if extra is None or extra.isEmpty() else union_unlabeled(out, extra.select(*wide(extra)))


def read_npz(spark: SparkSession, path: str) -> Observations:
    """An archive with X, y and perhaps X_unlabeled."""
    return _assembled(*(_arrays(spark, path, n) for n in ("X", "y", "X_unlabeled")), path)


def read_npy(spark: SparkSession, x_path: str, y_path: str, unlabeled_path: str | None = None) -> Observations:
    return _assembled(_arrays(spark, x_path), _arrays(spark, y_path), _arrays(spark, unlabeled_path) if unlabeled_path else None, x_path)


#: Nested results, one row per method and data set.
_LONG, _DOUBLE, _TEXT = T.LongType(), T.DoubleType(), T.StringType()
_STRUCT = lambda **fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
RESULT = _STRUCT(
    method=_TEXT,
    dataset=_TEXT,
    selected_names=T.ArrayType(_TEXT),
    coef=T.ArrayType(_DOUBLE),
    intercept=_DOUBLE,
    fit=_STRUCT(n=_DOUBLE, k=T.IntegerType(), sse=_DOUBLE, r2=_DOUBLE, adj_r2=_DOUBLE, bic=_DOUBLE, aic=_DOUBLE),
    discovery=_STRUCT(n_tp=_LONG, n_fp=_LONG, n_fn=_LONG, fdr=_DOUBLE, tpr=_DOUBLE),
    compute=_STRUCT(elapsed_seconds=_DOUBLE),
    params=T.MapType(_TEXT, _TEXT),
)
#: The same with open ``params`` and ``extra``: any numbers, texts, lists and maps.
OPEN_RESULT = T.StructType([*(f for f in RESULT.fields if f.name != "params"), T.StructField("params", T.VariantType()), T.StructField("extra", T.VariantType())])


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, in structs too."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, kind.valueType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def with_open(df: DataFrame, **columns: Sequence[str]) -> DataFrame:
    """Gathers columns in open maps, ``params=["alpha", "folds"]`` in ``params``: each row has the entries of its columns with a
    value (null where there is none), and lists, structs and maps stay as they are. NaN and infinities become null."""
    df = finite(df)
    if clash := [n for n in columns if n in df.columns and n not in {c for own in columns.values() for c in own}]:
        raise ValueError(f"there are columns {clash} already")

    def gathered(own: Sequence[str]) -> Column:
        text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in own)), {"ignoreNullFields": "true"})
        return F.when(text != "{}", F.parse_json(text))

    gone = {c for own in columns.values() for c in own}
    return df.select(*(f"`{c}`" for c in df.columns if c not in gone), *(gathered(own).alias(n) for n, own in columns.items()))


def rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Numbers with a fraction to ``digits`` decimals, as reports show them."""
    return df.select(*(F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def stamped(df: DataFrame, column: str = "run_at") -> DataFrame:
    """Adds the time of the run, one for all rows."""
    return df.withColumn(column, F.current_timestamp())


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """A table as Parquet. ``append`` adds to what an earlier run wrote; a write that may be repeated is ``write_records``."""
    df.write.mode("append" if append else "error").parquet(path)


def write_records(df: DataFrame, path: str, by: str = "config_id") -> None:
    """Records as Parquet in a folder for each value of ``by``. Folders of values in ``df`` are replaced as a whole when the
    job commits, the others stay, so a write that is repeated, or resumed after a stop, never doubles a record."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str, digits: int = 8) -> None:
    """A summary or pivot table as CSV: decimals cut to ``digits``, NaN empty."""
    rounded(finite(df), digits).coalesce(1).write.csv(path, header=True)  # a row for each configuration


def write_json(results: DataFrame, path: str) -> None:
    """Nulls stand for NaN and infinities."""
    finite(results).write.json(path, ignoreNullFields=False)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def read_open_json(spark: SparkSession, path: str) -> DataFrame:
    """Results with open maps as written; an open map that was null is null again."""
    back = spark.read.schema(OPEN_RESULT).json(path)
    opened = {n: F.when(~F.is_variant_null(n), F.col(n)) for n in ("params", "extra")}
    return back.withColumns(opened)


def flat(results: DataFrame) -> DataFrame:
    """One CSV row per result; names joined by ``|``."""
    nested = ("fit", "discovery", "compute")
    return results.select("method", "dataset", F.concat_ws("|", "selected_names").alias("selected_names"), "intercept", *(F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in nested for f in RESULT[n].dataType.fieldNames()))


def write_csv(results: DataFrame, path: str) -> None:
    flat(results).write.csv(path, header=True)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment files ``{"results": [{"method", "config": {...}, "fdr", ...}]}``, one row per record."""
    kind = "results array<struct<method: string, config: struct<n: int, p: int, k: int, degree: int, noise: double, trial: int>, fdr: double, tpr: double, test_r2: double, test_rmse: double, n_selected: int>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*").where("config is not null")
    return rows.select("method", "config.*", "fdr", "tpr", "test_r2", "test_rmse", "n_selected")


def done_before(spark: SparkSession, path: str, configs: DataFrame, on: Sequence[str]) -> DataFrame:
    """The configurations without a record in an earlier run's table: a sweep that was stopped goes on with these. All of
    them if there is no such table yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return configs
    found = spark.read.option("recursiveFileLookup", "false").schema(", ".join(f"`{c}` {configs.schema[c].dataType.simpleString()}" for c in on)).parquet(path)
    return configs.join(found.select(*on).distinct(), list(on), "left_anti")
