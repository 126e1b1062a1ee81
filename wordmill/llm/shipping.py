"""Bringing this package to Python workers that couldn't import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the running application a zip of the package, once.

    Not needed on one machine if workers start in the package's parent folder or have it in
    PYTHONPATH. Spark serves the file to executors itself.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    near = [str(_ROOT) == p for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if not (context.master.startswith("local") and any(near)):
        path = Path(tempfile.mkdtemp(prefix="wordmill_code_")) / "wordmill.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((_ROOT / "wordmill").rglob("*.py")):
                z.write(p, p.relative_to(_ROOT))
        context.addPyFile(str(path))
    _shipped.add(context.applicationId)
