"""What several operators share: reading, batch sizes, and the two word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.session import checkpoint_root, ship_package

#: Letters a-z, digits and everything outside ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text that still has capitals.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]+"

#: Rows of a batch handed to Python: texts can be 100 kB and more, so batches stay small.
BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession) -> SparkSession:
    """Ship the package and keep the batches of texts for Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship_package(spark)


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes that are no part of a word become spaces, A-Z become a-z: bytes.translate, then split.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str) -> list[bytes]:
    """The words of ``WORD`` as UTF-8 bytes: every byte of a character outside ASCII is at least 128."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()


def tokens(text: str) -> list[bytes]:
    """The words of ``NO_SPACE`` with A-Z lower-cased, as UTF-8 bytes; bytes.split() splits at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Scratch:
    """Work tables of one job below the shared checkpoint folder, dropped together when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written once as Parquet and read back: cuts the lineage and survives lost executors."""
        path = f"{checkpoint_root(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        hadoop = self.spark._jsparkSession.sessionState().newHadoopConf()
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(hadoop).delete(path, True)
