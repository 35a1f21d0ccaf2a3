"""What the Python workers of a job get from the driver."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import SparkSession

from fleetlens.session import ship_package


def share(spark: SparkSession, value: Any) -> Broadcast:
    """A value of bounded size for the functions of a job, and the code it needs."""
    ship_package(spark)
    return spark.sparkContext.broadcast(value)


_KEPT: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing, of the operator that runs.

    Workers outlive a job; what the operator before has kept is let go.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]
