"""Makes this package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Hands the package to the workers once a context, unless their path has it already."""
    context = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if Path.cwd() == _ROOT or any(Path(p).resolve() == _ROOT for p in paths) or getattr(context, "_parchment_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "parchment_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((_ROOT / "parchment").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(target))
    context._parchment_shipped = True
