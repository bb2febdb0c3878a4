"""Making the package known to a session's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        root = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="spark-sitewright-")) / "sitewright.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(packed))
    return spark
