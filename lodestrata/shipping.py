"""The package on the executors, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code once for each application; Python functions that name its modules then load there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not when it was itself loaded from such an archive
        archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
