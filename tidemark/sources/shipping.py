"""Makes the package importable in Python workers that don't share the driver's search path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Sends the package to the executors, once a session, unless the JVM was started with root on its path or in it."""
    context = getattr(spark, "sparkContext", None)
    if context is None or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    system = context._jvm.System
    if root in (system.getenv("PYTHONPATH") or "").split(":") or system.getProperty("user.dir") == root:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "tidemark")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
