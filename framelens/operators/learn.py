"""Random forests over window features, trained and applied as Spark ML pipelines."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import round_half_even
from framelens.operators.features import feature_columns

METRICS = ["framesReceivedPerSecond", "bitrate", "frame_jitter", "frameHeight"]
ROUNDED = ("framesPerSecond", "framesRendered", "framesReceived", "framesReceivedPerSecond")
CLASSES = ("frameHeight",)
TREES = 100
# Spark's limit, and its number of candidate splits of a feature; the trees re-expressed here have neither.
DEPTH = 30
BINS = 32


def model_input(rows: DataFrame, metric: str) -> tuple[DataFrame, list[str]]:
    """Rows with a complete feature set and target; array features become vectors."""
    names = feature_columns(rows, METRICS)
    types = dict(rows.dtypes)
    ready = rows.dropna(subset=[*names, metric]).select(
        *[c for c in rows.columns if c not in names],
        *[
            array_to_vector(c).alias(c) if types[c].startswith("array") else F.col(c)
            for c in names
        ],
    )
    target = F.col(metric).cast("double")
    return ready.withColumn(
        "_y", round_half_even(target) if metric in ROUNDED else target
    ), names


def cross_input(rows: DataFrame, metric: str) -> DataFrame:
    """vca, trace_id, ts, fold, the target ``gt`` and all features in one array ``x``, of complete rows."""
    names = feature_columns(rows, METRICS)
    types = dict(rows.dtypes)
    parts = [F.col(c) if types[c].startswith("array") else F.array(c) for c in names]
    target = F.col(metric).cast("double")
    return rows.dropna(subset=[*names, metric]).select(
        "vca",
        "trace_id",
        F.col("et").alias("ts"),
        F.col("fold").cast("int").alias("fold"),
        (round_half_even(target) if metric in ROUNDED else target).alias("gt"),
        F.concat(*[c.cast("array<double>") for c in parts]).alias("x"),
    )


def forest(metric: str, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 1):
    """A regressor on all features, or a classifier on the square root of them per split."""
    assemble = VectorAssembler(inputCols=names, outputCol="_x")
    # Deep trees: keep each row's node instead of walking down again, and split more nodes a pass.
    options = dict(
        featuresCol="_x",
        numTrees=trees,
        maxDepth=depth,
        maxBins=BINS,
        seed=seed,
        cacheNodeIds=True,
        maxMemoryInMB=1024,
    )
    if metric in CLASSES:
        return Pipeline(
            stages=[
                assemble,
                StringIndexer(inputCol="_y", outputCol="_c"),
                RandomForestClassifier(
                    labelCol="_c",
                    predictionCol="_p",
                    featureSubsetStrategy="sqrt",
                    **options,
                ),
            ]
        )
    return Pipeline(
        stages=[
            assemble,
            RandomForestRegressor(
                labelCol="_y", predictionCol="_p", featureSubsetStrategy="all", **options
            ),
        ]
    )


def fit(train: DataFrame, metric: str, **options) -> PipelineModel | None:
    """Fit on labelled window features; None without training rows."""
    rows, names = model_input(train, metric)
    if rows.isEmpty():
        return None
    return forest(metric, names, **options).fit(rows)


PREDICTIONS = (
    "metric string, method string, vca string, trace_id bigint, ts bigint, pred double, gt double"
)
IMPORTANCES = (
    "metric string, method string, fold int, vca string, feature string, score double"
)


def fit_many(tasks: dict, metric: str, parallelism: int = 3, **options) -> dict:
    """Fit one model per entry of ``tasks`` (key to training rows), several at a time.

    The fits are independent Spark jobs; running a few together fills executors that a single
    small forest leaves idle. Keys without training rows are left out.
    """
    spark = SparkSession.getActiveSession()

    def one(item):
        key, train = item
        return key, fit(train, metric, **options)

    if not tasks:
        return {}
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        done = pool.map(inheritable_thread_target(spark)(one), list(tasks.items()))
    return {key: model for key, model in done if model is not None}


def predict(model: PipelineModel, test: DataFrame, metric: str, method: str) -> DataFrame:
    """Prediction rows for all test traces at once; frame counts rounded half to even."""
    rows, _ = model_input(test, metric)
    if metric in CLASSES:
        # The indexer's own labels, without the column it would need from the target.
        back = IndexToString(
            inputCol="_p", outputCol="_label", labels=model.stages[1].labels
        )
        scored = back.transform(_without_target(model).transform(rows))
        pred = F.col("_label").cast("double")
    else:
        scored = model.transform(rows)
        pred = round_half_even("_p") if metric in ROUNDED else F.col("_p")
    return scored.select(
        F.lit(metric).alias("metric"),
        F.lit(method).alias("method"),
        "vca",
        "trace_id",
        F.col("et").alias("ts"),
        pred.alias("pred"),
        F.col("_y").alias("gt"),
    )


def _without_target(model: PipelineModel) -> PipelineModel:
    return PipelineModel([model.stages[0], model.stages[2]])


def importances(
    model: PipelineModel, rows: DataFrame, metric: str, method: str, fold: int, vca: str
) -> DataFrame:
    """Feature scores of one model, one row per feature; element i of an array feature is ``<name>_i``."""
    names = feature_names(rows)
    scores = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return rows.sparkSession.createDataFrame(
        [(metric, method, fold, vca, n, s) for n, s in zip(names, scores, strict=True)],
        IMPORTANCES,
    )


def feature_names(rows: DataFrame) -> list[str]:
    """The features in the order they are assembled in, array features element by element from 1.

    Array features are as wide in every row of one application.
    """
    names, types = feature_columns(rows, METRICS), dict(rows.dtypes)
    arrays = [c for c in names if types[c].startswith("array")]
    widths = rows.select(*[F.size(c).alias(c) for c in arrays]).first() if arrays else None
    out = []
    for c in names:
        out += [f"{c}_{i + 1}" for i in range(widths[c])] if c in arrays else [c]
    return out
