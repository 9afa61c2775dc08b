"""Tables that a job keeps in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_written: list[str] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without it, as in a
    test, gets one of its own."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CONF} to a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write once as Parquet to the shared folder and read back: later steps need neither
    the lineage nor the executors that computed it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove what keep() has written in this process; call it once the results are stored."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        n += 1
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once in an application, so that workers need no
    installed copy. Registered queries and pipeline stages do it; a job that has the package
    among its --py-files need not."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / f"{package.name}-llm.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        out.write(package / "__init__.py", f"{package.name}/__init__.py")
        for file in sorted((package / "llm").glob("*.py")):
            out.write(file, f"{package.name}/llm/{file.name}")
    context.addPyFile(str(archive))
    # Texts are long: fewer rows in a batch bound what a worker holds at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _shipped.add(context.applicationId)


def with_bytes(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns, and the text as UTF-8 bytes (null: empty) in ``text``."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
