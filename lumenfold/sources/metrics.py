"""The metrics that ship with the library, as a catalogue that `registry.set_up` and `registry.execute` run.

An embedding is a frame (id, state) of one set of vectors; a module is (id, state, projected), vectors before and after
a projection. Each metric gives one row, `value`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import geometry, tangent
from lumenfold.sources.registry import Catalogue, implements

_HERE = "lumenfold.sources.metrics."


def _one(frame: DataFrame, state: str = "state") -> DataFrame:
    return frame.select(F.lit(0).alias("group"), F.col("id").cast("long").alias("id"), F.col(state).cast("array<double>").alias("state"))


def _value(answer: DataFrame, name: str) -> DataFrame:
    return answer.select(F.col(name).alias("value"))


@implements(_HERE + "participation_ratio")
def participation_ratio(frame: DataFrame) -> DataFrame:
    return _value(geometry.participation_ratio(_one(frame), "group"), "participation_ratio")


@implements(_HERE + "local_intrinsic_dimensionality")
def local_intrinsic_dimensionality(frame: DataFrame, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    return _value(geometry.intrinsic_dimension(_one(frame), k, near=near), "local_intrinsic_dim")


@implements(_HERE + "connected_components")
def connected_components(frame: DataFrame, k: int = 5, near: DataFrame | None = None) -> DataFrame:
    return _value(geometry.connected_parts(_one(frame), k, near=near), "connected_components")


#: Metrics that take `near`, the neighbours that are found once for all metrics of a frame.
local_intrinsic_dimensionality.takes_near = connected_components.takes_near = True


@implements(_HERE + "anisotropy")
def anisotropy(frame: DataFrame) -> DataFrame:
    return _value(geometry.anisotropy(_one(frame), "group"), "anisotropy")


@implements(_HERE + "tangent_space")
def tangent_space(frame: DataFrame, k: int = 10, variance: float = 0.95) -> DataFrame:
    """The mean number of directions that a neighbourhood spreads in."""
    return _value(tangent.tangent_spaces(_one(frame), k, 1, variance).agg(F.avg("dimension").alias("dimension")), "dimension")


@implements(_HERE + "trajectory_velocity")
def trajectory_velocity(frame: DataFrame) -> DataFrame:
    """The mean cosine velocity of the vectors in order of their ids."""
    states = frame.select(F.lit(0).alias("trace_id"), F.col("id").alias("token_idx"), "state")
    return _value(geometry.mean_of_means(geometry.velocity(states), "velocity"), "mean_velocity")


@implements(_HERE + "trajectory_curvature")
def trajectory_curvature(frame: DataFrame) -> DataFrame:
    states = frame.select(F.lit(0).alias("trace_id"), F.col("id").alias("token_idx"), "state")
    return _value(geometry.mean_of_means(geometry.curvature(states), "curvature"), "mean_curvature")


@implements(_HERE + "trustworthiness")
def trustworthiness(frame: DataFrame, k: int = 5) -> DataFrame:
    return _value(geometry.preserved(_one(frame), _one(frame, "projected"), k), "trustworthiness")


@implements(_HERE + "continuity")
def continuity(frame: DataFrame, k: int = 5) -> DataFrame:
    return _value(geometry.preserved(_one(frame), _one(frame, "projected"), k), "continuity")


SHIPPED = {
    "participation_ratio": ("embedding", {}), "local_intrinsic_dimensionality": ("embedding", {"k": 10}), "connected_components": ("embedding", {"k": 5}), "anisotropy": ("embedding", {}), "tangent_space": ("embedding", {"k": 10, "variance": 0.95}),
    "trajectory_velocity": ("embedding", {}), "trajectory_curvature": ("embedding", {}), "trustworthiness": ("module", {"k": 5}), "continuity": ("module", {"k": 5}),
}


def catalogue() -> Catalogue:
    """The shipped metrics; others join by `Catalogue` as their settings are scanned."""
    return Catalogue({name: {"class": _HERE + name, "group": group, "defaults": dict(defaults), "partial": True, "source": "core", "source_file": "lumenfold/sources/metrics.py"} for name, (group, defaults) in SHIPPED.items()})
