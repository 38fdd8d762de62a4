"""Make the package importable on the executors of a session that was started without it."""

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once for each application.

    The archive is built beside the driver and served by Spark. Where the package is installed everywhere
    (``pip install .``, or ``--py-files``) this changes nothing.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
