"""Results that outlive a run: a table addressed by what was analysed, so that equal texts are classified once.

An entry's address is a digest of the text and of everything that the result depends on. Entries lie in folders by the
first digits of the address, so a run reads addresses only, and results only where they meet its texts. New entries are
appended; which addresses a run used is appended beside them, and `evict` writes a new generation of those used last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import SPAN
from ..operators.classify import Classifier
from .options import Options
from .pipeline import analyze, clip
from .scratch import checkpointed


class ResultCache:
    """The cache in a folder that driver and executors share. `version` names what a result depends on beside the options:
    classifier, model and its revision."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        empty = spark.createDataFrame([], "text string")
        whole = analyze(empty, Options(), lambda t: F.lit(None).cast(f"array<{SPAN}>"))
        self.schema = T.StructType([T.StructField("address", T.StringType()), whole.schema["entities"], whole.schema["stats"], T.StructField("prefix", T.StringType())])

    def address(self, text: Column, options: Options) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(self.version), F.lit(repr(options)), text), 256)

    def generation(self) -> int:
        """The last generation that was written to its end; 0 where there is none."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        path = fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [0]
        for entry in system.listStatus(path) if system.exists(path) else []:
            name = entry.getPath().getName()
            if name.startswith("entries-") and system.exists(fs.Path(entry.getPath(), "_SUCCESS")):
                done.append(int(name.split("-")[1]))
        return max(done)

    def _read(self, kind: str, schema: T.StructType | str, generation: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-{generation}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path.toString())

    def entries(self) -> DataFrame:
        return self._read("entries", self.schema, self.generation())

    def uses(self) -> DataFrame:
        return self._read("uses", "address string, run long", self.generation())

    def analyze(self, docs: DataFrame, run: int, options: Options = Options(), classifier: Classifier | None = None, text: str = "text") -> DataFrame:
        """As pipeline.analyze, but only texts without an entry are classified. `run` is a number that grows from run to run,
        such as a micro-batch's; eviction goes by it. A text on which a model raises gets no entry, and null results."""
        generation = self.generation()
        rows = clip(docs, options, text)
        rows = rows.withColumn("_address", self.address(F.col(text), options))
        wanted = rows.select(F.col("_address").alias("address"), F.col(text).alias("text")).dropDuplicates(["address"])
        known = self._read("entries", self.schema, generation).select("address")
        found = analyze(wanted.join(known, "address", "left_anti"), options, *([classifier] if classifier else []), error="_error")
        prefix = F.substring("address", 1, 2).alias("prefix")
        fresh = checkpointed(found.select("address", "entities", "stats", prefix, "_error")).where(F.col("_error").isNull()).drop("_error")
        fresh.write.partitionBy("prefix").mode("append").parquet(f"{self.folder}/entries-{generation}")
        rows.select(F.col("_address").alias("address")).distinct().withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{self.folder}/uses-{generation}")
        met = self._read("entries", self.schema, generation).select(F.col("address").alias("_entry"), "entities", "stats")
        return rows.join(met, F.col("_address") == F.col("_entry"), "left").drop("_address", "_entry")

    def evict(self, size: int) -> None:
        """Keep the `size` entries used last, as a new generation; of those used last in one run, the first by address. No task
        sorts all entries: whole runs stay up to the one in which the limit falls."""
        generation = self.generation()
        last = self.uses().groupBy("address").agg(F.max("run").alias("run"))
        entries = self.entries().dropDuplicates(["address"])
        last = checkpointed(entries.select("address").join(last, "address", "left").withColumn("run", F.coalesce("run", F.lit(-1).cast("long"))))
        left, edge = size, None
        for r in last.groupBy("run").count().orderBy(F.desc("run")).collect():  # a row a run
            if left < r["count"]:
                edge = (r.run, left)
                break
            left -= r["count"]
        kept = last
        if edge:
            some = last.where(F.col("run") == edge[0]).orderBy("address").limit(edge[1])
            kept = last.where(F.col("run") > edge[0]).union(some)
        kept = checkpointed(kept)
        kept.write.parquet(f"{self.folder}/uses-{generation + 1}")
        entries.join(kept.select("address"), "address", "left_semi").write.partitionBy("prefix").parquet(f"{self.folder}/entries-{generation + 1}")
