"""The whole experiment from data directories: discover, validate, split, features, grid.

Every stage is a table below ``out``. A run that was cut off goes on with the first stage that is not
there in full; the grid keeps the models and predictions it has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.chunks import assign_chunks
from framelens.operators.validate import valid_traces, validate
from framelens.plans.experiment import Experiment
from framelens.session import path_exists
from framelens.sources import dumps
from framelens.sources.linked import data_sets, linked_dumps, linked_packets, linked_traces
from framelens.sources.settings import payload_types


@dataclass
class FolderRun:
    """``roots`` are data directories whose base names say the data set; ``options`` go to Experiment."""

    spark: SparkSession
    roots: list[str]
    out: str
    headered: bool = True
    options: dict = field(default_factory=dict)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.out}/{name}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def traces(self) -> DataFrame:
        return self.stage("traces", lambda: linked_traces(self.spark, self.roots))

    def packets(self) -> DataFrame:
        rows = self.stage(
            "packets", lambda: linked_packets(self.spark, self.roots, self.traces(), self.headered)
        )
        return assign_chunks(rows)

    def labels(self) -> DataFrame:
        bodies = lambda: linked_dumps(self.spark, self.roots, self.traces())
        return self.stage("labels", lambda: dumps.read_labels(bodies()))

    def dump_status(self) -> DataFrame:
        bodies = lambda: linked_dumps(self.spark, self.roots, self.traces())
        return self.stage("dump_status", lambda: dumps.dump_status(bodies()))

    def verdicts(self) -> DataFrame:
        """(trace_id, reason) of every trace; traces whose dump gives no labels have none."""
        return self.stage(
            "verdicts", lambda: validate(self.packets(), dumps.label_ranges(self.labels()))
        )

    def run(self) -> DataFrame:
        """Predictions of every data set, with the column ``dataset``."""
        good = valid_traces(self.traces(), self.verdicts())
        packets, found = self.packets(), []
        for dataset in data_sets(self.roots):
            own = F.col("dataset") == dataset
            grid = Experiment(
                packets.where(own),
                self.labels(),
                good.where(own).select("trace_id", "vca"),
                payload_types(self.spark).where(own),
                f"{self.out}/{dataset}",
                dataset=dataset,
                resume=True,
                **self.options,
            )
            found.append(grid.run().withColumn("dataset", F.lit(dataset)))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
