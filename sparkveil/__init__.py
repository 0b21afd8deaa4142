"""Sensitive-text analytics on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give the executors this package, once for each application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="sparkveil-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    here = os.path.dirname(os.path.abspath(__file__))
    for top, _, names in os.walk(here):
        for name in names:
            if not name.endswith(".pyc"):
                to = os.path.join(folder, "tree", os.path.relpath(os.path.join(top, name), os.path.dirname(here)))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                shutil.copyfile(os.path.join(top, name), to)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "sparkveil"), "zip", os.path.join(folder, "tree")))
    _shipped.add(app)
