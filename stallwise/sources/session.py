"""What a session needs before Python code of this package runs on its workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, unless PYTHONPATH already leads them to it."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in on_path or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="stallwise-")) / "stallwise.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "stallwise").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is made and run in here leaves no shuffle files: Spark deletes those of a query when it ends."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
