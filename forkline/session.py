"""A local session for tests, benches and notebooks; on a cluster the session comes from outside."""

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g", name: str = "forkline") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
