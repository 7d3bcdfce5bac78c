"""Session settings and the folder for intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive execution sizes partitions and splits skewed joins; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings and the given ones on top."""
    builder = SparkSession.builder.appName("tidemill").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: By application, the folder of a local session that names none.
_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder of this application if the master is local and none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_roots:
            _own_roots[application] = tempfile.mkdtemp(prefix="tidemill-")
        root = _own_roots[application]
    return root


def application_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; other applications may share the root."""
    return f"{shared_root(spark)}/tidemill/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
