"""Session settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: The JVM leaves methods above so many bytes uncompiled; Spark generates them up to 65535 unless told otherwise.
METHOD_BYTES = "8000"


def small_methods(spark: SparkSession) -> None:
    """Has a session split code that would be too long to be compiled; plans that judge pairs are many times slower without."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)


def session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time."""
    return (
        SparkSession.builder.master(master)
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
