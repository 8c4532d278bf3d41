"""Reading of train and test tables, configuration, and writing of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean null in a CSV file (fixed values).
NULL_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A")


def normalised(df: DataFrame) -> DataFrame:
    """Null tokens as null, int as bigint, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*NULL_TOKENS), c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its extension: csv (with a header), json (one document or one per line), parquet or orc.

    Without a schema a CSV file's types are inferred from its values other than null tokens; dates stay text.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = spark.read.csv(path, header=True, inferSchema=False) if schema is None else spark.read.csv(path, header=True, schema=schema, nullValue="NA")
        if schema is not None:
            return normalised(raw)
        plain = normalised(raw)
        # One pass tells which columns are whole numbers or numbers in every value that is there.
        tests = [f for c in plain.columns for f in (
            F.bool_and(F.coalesce(F.col(f"`{c}`").rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.lit(True))), F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()), F.count(F.col(f"`{c}`")))]
        seen = list(plain.agg(*[t.alias(str(i)) for i, t in enumerate(tests)]).first())
        kinds = ["bigint" if seen[3 * i] and seen[3 * i + 2] else "double" if seen[3 * i + 1] and seen[3 * i + 2] else "string" for i in range(len(plain.columns))]
        return plain.select(*[F.trim(F.col(f"`{c}`")).cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in zip(plain.columns, kinds)])
    if kind == "json":
        return normalised(spark.read.json(path, schema=schema, multiLine=not by_lines(spark, path)))
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for .{kind} files")


def by_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file's first line that is not empty is a whole record."""
    import json

    first = spark.read.text(path).filter("trim(value) <> ''").first()
    try:
        return first is not None and isinstance(json.loads(first[0]), dict)
    except ValueError:
        return False


def read_pair(spark: SparkSession, folder: str, kind: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Train and Test of a folder; FileNotFoundError if one is missing."""
    out = []
    for name in ("Train", "Test"):
        path = f"{folder.rstrip('/')}/{name}.{kind}"
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            raise FileNotFoundError(path)
        out.append(read_table(spark, path))
    return out[0], out[1]


@dataclass(frozen=True)
class Config:
    """What a run is told."""

    bias_assessment: bool = False
    feature: str | None = None
    folds: int = 5
    search: str | None = None  # randomized, exhaustive or none
    correlation_limit: float = 0.7
    metric: str = "balanced_accuracy"
    models: tuple[str, ...] = field(default=("Logistic Regression",))
    selector: str | None = "featurewiz"
    target: str = "Target"
    label: int = 1
    subgroup: str | None = None
    key: str | None = None


#: Names of metrics in a configuration file.
METRIC_NAMES = {"AUC": "auc", "Sensitivity": "sensitivity", "Specificity": "specificity", "F1-Score": "f1", "Accuracy": "accuracy", "Balanced Accuracy": "balanced_accuracy"}


#: Names of selectors in a configuration file.
SELECTOR_NAMES = {"FeatureWiz": "featurewiz", "RFE": "rfe", "Lasso": "lasso", "Random Forest": "rf", "XGBoost": "xgboost"}


def read_config(spark: SparkSession, path: str) -> Config:
    """A YAML file with the keys of the input form, and Target, Label, Subgroup, Key and Selector beside them; `None` or nothing leaves a key as it is.

    A selector is named as in SELECTOR_NAMES or in lower case; `none` selects nothing. ValueError for another one.
    """
    import yaml

    said = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}
    grid = said.get("apply_grid_search") or {}
    enabled = grid.get("enabled", False) if isinstance(grid, dict) else bool(grid)
    kinds = grid.get("type") or {} if isinstance(grid, dict) else {}
    models = said.get("Machine Learning Models") or {}
    bias = said.get("BiasAssessment", False)
    plain = lambda k: None if said.get(k) in (None, "None", "") else str(said[k])
    selector = Config.selector if plain("Selector") is None and said.get("Selector") != "None" else SELECTOR_NAMES.get(str(said["Selector"]), str(said["Selector"]).lower())
    if selector not in (*SELECTOR_NAMES.values(), "none"):
        raise ValueError(f"no selector {said['Selector']}")
    return Config(
        target=plain("Target") or Config.target, label=int(said.get("Label", Config.label)), subgroup=plain("Subgroup"), key=plain("Key"), selector=None if selector == "none" else selector,
        bias_assessment=bool(bias), feature=plain("Feature"), folds=int(said.get("number_of_k_folds", 5)),
        search=("exhaustive" if kinds.get("Exhaustive") else "randomized") if enabled else None,
        correlation_limit=float(said.get("Correlation Limit", 0.7)), metric=METRIC_NAMES.get(said.get("Metric For Threshold Optimization"), "balanced_accuracy"),
        models=tuple(m for m, on in models.items() if on) or Config.models,
    )


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as parquet, or csv with a header; what was there is replaced."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_errors(spark: SparkSession, errors: list[tuple[str, str, int, str]], path: str) -> None:
    """(stage, model, fold, error) of what failed in a run."""
    write_table(spark.createDataFrame(errors, "stage string, model string, fold int, error string"), path)
