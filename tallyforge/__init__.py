"""tallyforge: contest ranking and training-data operators on Spark DataFrames."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Puts the place of this package on the path of Python workers, wherever the session was started from.

    On a cluster whose machines don't have that place, the package comes by --py-files or an image instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, *have) if p)
