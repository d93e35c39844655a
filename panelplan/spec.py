"""Column roles of a panel and the tags of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    """Names of key, time and target columns, static attributes (text) and covariates known ahead (numbers)."""

    series: str
    time: str
    target: str
    static: tuple[str, ...]
    future: tuple[str, ...]

    @classmethod
    def infer(cls, schema: T.StructType, series: str, time: str, target: str, exclude: tuple[str, ...] = ()) -> PanelSpec:
        """Roles by type: text columns are static, the other numeric columns are covariates."""
        taken = {series, time, target, *exclude}
        rest = [f for f in schema.fields if f.name not in taken]
        return cls(series, time, target, tuple(f.name for f in rest if isinstance(f.dataType, T.StringType)), tuple(f.name for f in rest if isinstance(f.dataType, T.NumericType)))


@dataclass(frozen=True)
class RunTags:
    """What a published table is partitioned by."""

    run_date: str
    run_version: str
    planning_month: str
    obd_flag: str = "N"
