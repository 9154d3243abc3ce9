"""Objects that every worker holds: broadcast once, unpickled once a worker."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives the value on a worker. It travels as bytes, so its class need not be installed there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    key = sent._jbroadcast.id()

    def get() -> Any:
        held = sys.modules.setdefault("_lexmill_shared", types.ModuleType("_lexmill_shared")).__dict__
        if key not in held:
            for old in [k for k in held if isinstance(k, int)]:
                del held[old]  # the worker may have served another query
            held[key] = pickle.loads(sent.value)
        return held[key]

    return get
