"""Session helpers: a tuned local session and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int = 8, name: str = "auditlake") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; only a local session may fall back to its own."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="auditlake-")
    return _LOCAL_FOLDERS[app]


def write_cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so later plans start from files."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class RoundTable:
    """Append-only table of a fixpoint loop: one folder of rows per round."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.schema = None

    def append(self, df: DataFrame) -> int:
        """Write one round and return its row count (counted while writing)."""
        seen = Observation()
        path = f"{self.root}/{len(self.paths):04d}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        return seen.get["n"]

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


#: Inputs below this estimate are spread over all cores before CPU-heavy narrow work.
SPREAD_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Size of df as Spark's optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """Repartition a small input (often one file, one task); large inputs keep their splits."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= limit else df
