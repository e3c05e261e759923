"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there: its work is not repeated, a lost executor loses nothing.

    A cluster must name the folder (spark.checkpoint.dir); only a local master may do without.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
