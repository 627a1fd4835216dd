"""Session factory for tests and the benchmark; a cluster brings its own session."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidewire-"),
    } | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.appName("tidewire").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
