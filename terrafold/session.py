"""Session factory and validated parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def session(app: str = "terrafold", **settings: str) -> SparkSession:
    """UTC, adaptive plans, RocksDB state store; ``settings`` with ``_`` for ``.`` win."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(app).config(map=conf | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


@dataclass(frozen=True)
class RegistrationParams:
    """Feature extraction settings; bounds as documented for the scanner front end."""

    scan_period: float = 0.1
    imu_history: int = 200
    feature_regions: int = 6
    curvature_region: int = 5
    max_corner_sharp: int = 2
    max_corner_less_sharp: int = 20
    max_surface_flat: int = 4
    less_flat_filter_size: float = 0.2
    surface_curvature_threshold: float = 0.1

    def __post_init__(self) -> None:
        low = {"imu_history": 1, "feature_regions": 1, "curvature_region": 1, "max_corner_sharp": 1, "max_surface_flat": 1, "less_flat_filter_size": 0.001, "surface_curvature_threshold": 0.001}
        for f in fields(self):
            value = getattr(self, f.name)
            if value <= 0 or value < low.get(f.name, 0):
                raise ValueError(f"{f.name} out of range: {value}")
        if self.max_corner_less_sharp < self.max_corner_sharp:
            raise ValueError("max_corner_less_sharp must be at least max_corner_sharp")
