"""Make the package importable in Python workers, wherever they run."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files once per application, unless workers find it on PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    context._quillspark_shipped = True
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(PACKAGE.rglob("*.py")):
            out.write(p, p.relative_to(PACKAGE.parent))
    path = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    Path(path).write_bytes(body.getvalue())
    context.addPyFile(path)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
