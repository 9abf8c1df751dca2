"""Sends this package's code to the executors, for functions that run in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

PACKAGE = Path(__file__).parents[1]


def with_code(df: DataFrame) -> DataFrame:
    """``df``, once its application's executors can import this package whatever folder they run in.

    Done once an application, through Spark's own file server, so nothing has to be installed or shared.
    """
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_marginflow_code", None) is None:
        archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(PACKAGE.rglob("*.py")):
                z.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
        sc.addPyFile(str(archive))
        sc._marginflow_code = str(archive)
    return df
