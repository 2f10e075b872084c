"""The full experiment: features once, then every metric, method, fold and application."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import round_half_even
from framelens.operators import errors, features, grove, heuristics, learn, splits
from framelens.operators.validate import valid_traces, validate
from framelens.sources import tables
from framelens.sources.catalog import trial_id
from framelens.session import cut_lineage, path_exists

METHODS = ["ip-udp-heuristic", "rtp-heuristic", "ip-udp-ml", "rtp-ml"]


@dataclass
class Experiment:
    """Inputs are whole tables; only (metric, method, fold, vca) is looped over on the driver.

    ``out`` receives features, folds, predictions, models, importances and run_metrics. Features
    and heuristic estimates are written once and read back, so no fit repeats their plan. With
    ``resume`` whatever ``out`` already holds in full is kept, and the run goes on from there.
    """

    packets: DataFrame
    labels: DataFrame
    traces: DataFrame
    ptypes: DataFrame
    out: str
    dataset: str = "dataset"
    metrics: Sequence[str] = tuple(learn.METRICS)
    methods: Sequence[str] = tuple(METHODS)
    groups: tuple[str, ...] = ("LSTATS", "TSTATS")
    folds: int = 5
    window_us: int = 1_000_000
    forest: dict = field(default_factory=dict)
    resume: bool = False

    def _has(self, path: str) -> bool:
        return self.resume and path_exists(self.spark, f"{self.out}/{path}")

    @property
    def spark(self):
        return self.packets.sparkSession

    def validated_folds(self, ranges: DataFrame) -> DataFrame:
        """Folds over the traces that pass validation."""
        good = valid_traces(self.traces, validate(self.packets, ranges))
        return splits.kfold(good, self.folds)

    def prepare(self, ranges: DataFrame | None = None) -> None:
        if not self._has("folds/_SUCCESS"):
            folds = (
                splits.kfold(self.traces, self.folds)
                if ranges is None
                else self.validated_folds(ranges)
            )
            folds.write.mode("overwrite").parquet(f"{self.out}/folds")
        for method in self.methods:
            if method.endswith("-ml") and not self._has(f"features/{method}/_SUCCESS"):
                rows = self._features(method)
                # A second without one label still serves the other metrics.
                labelled = features.join_labels(
                    rows, self.labels, list(self.metrics), every=False
                )
                tables.write_features(labelled, f"{self.out}/features/{method}")
            elif not method.endswith("-ml") and not self._has(f"estimates/{method}/_SUCCESS"):
                self._estimates(method).write.mode("overwrite").parquet(
                    f"{self.out}/estimates/{method}"
                )

    def _features(self, method: str) -> DataFrame:
        if method == "ip-udp-ml":
            return features.ip_udp_features(self.packets, self.window_us, groups=self.groups)
        return features.rtp_ml_features(self.packets, self.ptypes, self.window_us, self.groups)

    def _estimates(self, method: str) -> DataFrame:
        if method == "ip-udp-heuristic":
            seconds = heuristics.ip_udp_heuristic(self.packets)
        else:
            seconds = heuristics.rtp_heuristic(self.packets, self.ptypes)
        return heuristics.to_predictions(seconds, self.labels, method)

    def run(self, ranges: DataFrame | None = None) -> DataFrame:
        """Run the grid; returns all predictions."""
        self.prepare(ranges)
        spark = self.spark
        folds = spark.read.parquet(f"{self.out}/folds").select("trace_id", "vca", "fold")
        for method in self.methods:
            if method.endswith("-ml"):
                self._train_and_test(method, folds)
            # One job writes the estimates of all metrics.
            elif not any(self._has(f"predictions/metric={m}/method={method}") for m in self.metrics):
                rows = spark.read.parquet(f"{self.out}/estimates/{method}")
                rows = rows.where(F.col("metric").isin(list(self.metrics)))
                self._store(rows.join(folds.drop("vca"), "trace_id"))
        predictions = tables.read_predictions(spark, f"{self.out}/predictions")
        if not self._has("run_metrics/_SUCCESS"):
            tables.append_run_metrics(self.scores(predictions), f"{self.out}/run_metrics")
        return predictions

    def _train_and_test(self, method: str, folds: DataFrame) -> None:
        rows = self.spark.read.parquet(f"{self.out}/features/{method}")
        rows = rows.join(folds.drop("vca"), "trace_id")
        apps = [r["vca"] for r in folds.select("vca").distinct().collect()]
        for metric, fold in product(self.metrics, range(1, self.folds + 1)):
            of_app = {
                vca: rows.where(F.col("vca") == vca)
                for vca in apps
                if not self._has(f"predictions/{_partition(metric, method, fold, vca)}")
            }
            # A forest passes over its input once per level.
            train = {
                vca: r.where(F.col("fold") != fold).persist() for vca, r in of_app.items()
            }
            models = learn.fit_many(train, metric, **self.forest)
            for vca, model in models.items():
                key = f"{metric}/{method}/{fold}/{vca}"
                model.write().overwrite().save(f"{self.out}/models/{key}")
                scores = learn.importances(model, of_app[vca], metric, method, fold, vca)
                tables.write_predictions(scores, f"{self.out}/importances")
                test = of_app[vca].where(F.col("fold") == fold)
                found = learn.predict(model, test, metric, method)
                self._store(found.withColumn("fold", F.lit(fold)))
            for r in train.values():
                r.unpersist()

    def _store(self, predictions: DataFrame) -> None:
        tables.write_predictions(predictions, f"{self.out}/predictions")

    def scores(self, predictions: DataFrame) -> DataFrame:
        """The run log: two decimals, accuracy in percent."""
        return trial_scores(predictions, "-".join(self.groups), self.dataset).select(
            "trial",
            "vca",
            F.round("mae", 2).alias("mae_avg"),
            F.round(F.col("accuracy") * 100, 2).alias("accuracy_avg"),
        )


def _partition(metric: str, method: str, fold: int, vca: str) -> str:
    values = zip(tables.PREDICTION_KEYS, (metric, method, fold, vca))
    return "/".join(f"{key}={value}" for key, value in values)


def trial_scores(predictions: DataFrame, subset: str, dataset: str) -> DataFrame:
    """Mean over traces of MAE and accuracy per trial (metric, method, fold) and application."""
    trial = trial_id(
        F.col("metric"), F.col("method"), F.lit(subset), F.lit(dataset), F.col("fold")
    )
    # Scores are kept apart by whatever stands in `method`.
    scored = errors.macro_scores(predictions.withColumn("method", trial))
    return scored.select(F.col("method").alias("trial"), "vca", "mae", "accuracy", "n_traces")


def cross_validated(rows: DataFrame, metric: str, method: str, **forest) -> tuple[DataFrame, DataFrame]:
    """Predictions of every fold for every application found in ``rows``, each by a model of the other
    folds, and the importances of all models. ``rows`` has ``fold`` and is stored; folds without training
    rows give none.
    """
    given = learn.cross_input(rows, metric)
    options = {"trees": learn.TREES, "depth": learn.DEPTH, "bins": learn.BINS, "seed": 1} | forest
    found, gains = grove.cross_predicted(given, metric in learn.CLASSES, **options)
    pred = round_half_even("pred") if metric in learn.ROUNDED else F.col("pred")
    trial = [F.lit(metric).alias("metric"), F.lit(method).alias("method")]
    predictions = found.select(*trial, "vca", "trace_id", "ts", pred.alias("pred"), "gt", "fold")
    names = _names(rows)
    return predictions, gains.join(names, ["vca", "pos"]).select(*trial, "fold", "vca", "feature", "score")


def _names(rows: DataFrame) -> DataFrame:
    """The name of every feature position of every application."""
    apps = [r["vca"] for r in rows.select("vca").distinct().collect()]
    named = [(v, i, n) for v in apps for i, n in enumerate(learn.feature_names(rows.where(F.col("vca") == v)))]
    return rows.sparkSession.createDataFrame(named, "vca string, pos int, feature string")


def window_sweep(
    packets: DataFrame,
    labels: DataFrame,
    folds: DataFrame,
    windows_us: Sequence[int],
    metric: str = "framesReceivedPerSecond",
    **forest,
) -> DataFrame:
    """MAE per application and prediction window, over the test rows of all folds. A window of several
    seconds still takes the label of the one second it ends in."""
    parts = [
        packets.sparkSession.createDataFrame(
            [], "metric string, vca string, mae double, window_s double"
        )
    ]
    for window_us in windows_us:
        rows = features.join_labels(
            features.ip_udp_features(packets, window_us), labels, [metric]
        ).join(folds.select("trace_id", "fold"), "trace_id")
        # A forest passes over its rows once per level.
        found, _ = cross_validated(cut_lineage(rows), metric, "ip-udp-ml", **forest)
        parts.append(
            errors.micro_mae(found, ("metric", "vca")).withColumn(
                "window_s", F.lit(window_us / 1e6)
            )
        )
    return errors.all_results(parts)
