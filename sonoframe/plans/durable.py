"""Cutting lineage so that a lost executor costs no more than the stage it worked on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder of this machine is used if all work is done on it (master
    ``local``), and removed when Python ends; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sonoframe-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the :func:`shared_folder` and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the :func:`shared_folder`; nothing is made yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
