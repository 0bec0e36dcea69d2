"""XML and tree analytics on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark) -> None:
    """Let Python workers on machines that have this folder import the package. On a
    cluster, install it or pass it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
