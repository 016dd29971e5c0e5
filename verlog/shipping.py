"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .sources import paths


def ship(spark: SparkSession) -> str:
    """Put the package as an archive into the folder that all executors see and add it to their path; its place."""
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    at = f"{paths.new_folder(spark, 'package')}/{root.name}.zip"
    paths.write_bytes(spark, at, packed.getvalue())
    spark.sparkContext.addPyFile(at)
    return at
