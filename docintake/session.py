"""Session helpers: a local session for tests and the shared scratch folder."""

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def send_by_value(module: str) -> None:
    """Let tasks get a module's functions with the plan, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cpus: int | str = "*", app: str = "docintake", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.metricsEnabled": "false",
        # small files too make a task per core
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "64k",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
TASKS_A_CORE = 4


def list_in_few_tasks(spark: SparkSession) -> None:
    """Let the session list folders and files in a few tasks a core.

    Spark gives every path a task of its own, up to 10,000, and a task takes
    far longer to start than to list a path.  A lower setting stays.
    """
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING_TASKS)) > tasks:
        spark.conf.set(LISTING_TASKS, str(tasks))


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is not set, a folder below the warehouse, which is shared as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts the lineage and is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
