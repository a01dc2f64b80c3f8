"""Session defaults and the helpers that cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Everything else (executors, memory, partitions) belongs to the cluster that runs the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them (dots written as ``__``)."""
    builder = SparkSession.builder.master(master).appName("evidentia")
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. A temporary folder is taken only where the
    session names none and runs in this one process (unit tests); on a cluster, whose machines do
    not share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="evidentia-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
