"""Result tables of a run, one folder per project, version, stage, model and phase.

Every write goes to a folder of its own; only when it is complete, one row of a
manifest names the folders that make up the table from then on.  So readers see a
table as it was before a write or after it, also while one runs or when one fails,
and what a lost or failed attempt leaves behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "number long, writes array<string>"
# Which stage a phase belongs to.
STAGE_OF_PHASE = {"CAL": "testing", "CNF": "testing", "HRP": "application", "VP": "application"}


@dataclass(frozen=True)
class ResultStore:
    """Writes and reads the tables of one project version below ``root``."""

    spark: SparkSession
    root: str
    project: str = "default"
    version: str = "1"

    def _place(self, model: str, phase: str) -> str:
        return f"project={self.project}/version={self.version}/stage={STAGE_OF_PHASE[phase]}/model={model}/phase={phase}"

    def path(self, table: str, model: str, phase: str) -> str:
        """Folder of a table; the parts are readable as partition columns."""
        return f"{self.root}/{table}/{self._place(model, phase)}"

    def _manifest(self, table: str, place: str = "") -> DataFrame | None:
        """``number, writes`` of what was published, or nothing."""
        base = f"{self.root}/published/{table}"
        try:
            return self.spark.read.option("basePath", base).parquet(f"{base}/{place}")
        except AnalysisException:
            return None

    def published(self, table: str, model: str, phase: str) -> list[str] | None:
        """Names of the complete writes that make up a table."""
        manifest = self._manifest(table, self._place(model, phase))
        newest = None if manifest is None else manifest.orderBy(F.desc("number")).select("number", "writes").first()
        return None if newest is None else list(newest["writes"])

    def _write(self, df: DataFrame, table: str, model: str, phase: str, name: str = "w") -> str:
        """Write beside what is published, under a new name."""
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path(table, model, phase)}/write={name}")
        return name

    def _publish(self, table: str, model: str, phase: str, writes: Sequence[str]) -> None:
        """Make complete writes the table, by adding one file with one row."""
        manifest = self._manifest(table, self._place(model, phase))
        last = manifest.agg(F.max("number")).first()[0] if manifest is not None else None
        row = self.spark.createDataFrame([((last or 0) + 1, list(writes))], MANIFEST_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/published/{table}/{self._place(model, phase)}")

    def write(self, df: DataFrame, table: str, model: str, phase: str) -> None:
        """Replace a table."""
        self._publish(table, model, phase, [self._write(df, table, model, phase)])

    def read(self, table: str, model: str, phase: str) -> DataFrame:
        """The table, or an error naming the phase that has to run first."""
        path, writes = self.path(table, model, phase), self.published(table, model, phase)
        if writes is None:
            raise FileNotFoundError(f"{table} of {model} {phase} not found at {path}: run that phase first")
        return self.spark.read.parquet(*[f"{path}/write={name}" for name in writes])

    def has(self, table: str, model: str, phase: str) -> bool:
        return self.published(table, model, phase) is not None

    def overview(self, table: str) -> DataFrame:
        """All versions, models and phases of a table, as partition columns."""
        manifest = self._manifest(table)
        if manifest is None:
            raise FileNotFoundError(f"no {table} found below {self.root}")
        # One row for each write ever published: as many as phases were run.
        newest = manifest.groupBy("project", "version", "stage", "model", "phase").agg(F.max_by("writes", "number").alias("writes"))
        every = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        return every.join(newest.select(F.explode("writes").alias("write")), "write", "left_semi").drop("write")

    # Frequency tables keep every revision: 0 as fitted, higher ones after imputation.

    def write_frequency(self, table: DataFrame, model: str, phase: str, revision: int = 0) -> None:
        """Store one revision; a new fit (revision 0) replaces all revisions of the old one."""
        out = table.select("region_id", "defor_px", "area_px", "rel_freq", "imputed", F.lit(revision).alias("revision"))
        kept = [] if revision == 0 else self.published("frequency", model, phase) or []
        name = self._write(out, "frequency", model, phase, f"r{revision}")
        self._publish("frequency", model, phase, [w for w in kept if not w.startswith(f"r{revision}-")] + [name])

    def read_frequency(self, model: str, phase: str, revision: int | None = None) -> DataFrame:
        """The newest revision, or the one asked for."""
        every = self.read("frequency", model, phase)
        if revision is None:
            revision = every.agg(F.max("revision")).first()[0]
        return every.filter(F.col("revision") == revision).drop("revision")

    def add_frequency_revision(self, table: DataFrame, model: str, phase: str) -> int:
        """Store a table after imputation beside the earlier ones; an unchanged table adds none."""
        newest = self.read("frequency", model, phase).agg(F.max("revision")).first()[0]
        exact = ["region_id", "defor_px", "area_px", "imputed", F.round("rel_freq", 12).alias("rel_freq")]
        old, new = self.read_frequency(model, phase, newest).select(exact), table.select(exact)
        if new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty():
            return newest
        self.write_frequency(table, model, phase, newest + 1)
        return newest + 1

    def write_threshold(self, threshold: DataFrame) -> None:
        self.write(threshold.coalesce(1), "threshold", "benchmark", "CAL")

    def read_threshold(self) -> int:
        row = self.read("threshold", "benchmark", "CAL").first()
        if row is None or row["nrt"] is None:
            raise ValueError("the stored risk threshold is empty")
        return int(row["nrt"])


def named(base: str, project: str | None = None, version: str | None = None) -> str:
    """Output name: project after a leading number or in front, version before the suffix."""
    stem, dot, suffix = base.rpartition(".")
    if not dot:
        stem, suffix = base, ""
    lead, underscore, rest = stem.partition("_")
    numbered = bool(underscore) and lead.isdigit() and bool(rest)
    parts = [lead, project, rest] if numbered else [project, stem]
    name = "_".join(p for p in parts if p)
    return name + (f"_v{version}" if version else "") + dot + suffix


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report (evaluation cells, metrics, logs) as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)
