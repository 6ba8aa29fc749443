"""Incremental versions of the trace and status aggregates. A stream over all of a table equals the batch result."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import last_wins
from ..sources.files import TRACE
from ..tables import load, shared_dir


def trace_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines of model calls as they arrive."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", per_trigger).json(path)


def stage_totals(traces: DataFrame) -> DataFrame:
    """Token sums by stage; blank stages are unclassified."""
    stage = F.coalesce(F.when(F.trim("stage") != "", F.trim("stage")), F.lit("unclassified"))
    return traces.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"))


def windowed_results(results: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Results per event-time window. In append mode a window is put out once the watermark has passed it and later rows of it are dropped; in complete mode all windows stay and no row is."""
    return results.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"))


def run_to_end(df: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what is there and returns its result as a table in the shared folder.

    Each micro-batch of a complete-mode query replaces the table, of an append-mode query is written under its own number,
    so a batch that is repeated after a failure overwrites itself.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{label}"
    base = f"{base}-{uuid.uuid4().hex[:12]}"

    def sink(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else no}")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out/batch=*") if mode != "complete" else spark.read.schema(df.schema).parquet(f"{base}/out/batch=0")


def upsert_latest(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], base: str | None = None, parts: int = 32) -> DataFrame:
    """The latest row of each key, kept across micro-batches in a table of ``parts`` parts by hash of the key.

    A micro-batch rewrites only the parts that its keys fall into, under its own number, so one that is repeated after a
    failure overwrites itself; the newest version of a part holds. With ``base``, a folder of its own, a later call goes on
    where the last one ended.
    """
    base = base or f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex[:12]}"
    schema = T.StructType([*stream.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("version", T.LongType())])

    def held() -> DataFrame:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{base}/rows")

    def newest(rows: DataFrame) -> DataFrame:
        top = rows.groupBy("part").agg(F.max("version").alias("version"))  # a row a part
        return rows.join(F.broadcast(top), ["part", "version"], "left_semi")

    def merge(batch: DataFrame, no: int) -> None:
        rows = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        old = newest(held().where(F.col("version") < no))
        old = old.join(F.broadcast(rows.select("part").distinct()), "part", "left_semi").drop("version")
        out = last_wins(rows.unionByName(old), keys, order)
        out.repartition(parts, "part").withColumn("version", F.lit(no).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{base}/rows")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return newest(held()).drop("part", "version")


def status_changes(results: DataFrame, keys: list[str]) -> DataFrame:
    """Each time a key's success differs from the one before it: an operator with state of its own, one flag a key.

    Within a micro-batch rows are taken by time; a key's first row is a change. State is kept as long as the stream runs.
    """
    out = ", ".join(f"{k} string" for k in keys) + ", recorded_at timestamp, success boolean"

    def step(key: tuple, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("recorded_at")
        changed = []
        for t, ok in zip(rows["recorded_at"], rows["success"]):
            if ok is not None and ok == ok and bool(ok) != last:
                last = bool(ok)
                changed.append((*key, t, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(changed, columns=[*keys, "recorded_at", "success"])

    return results.groupBy(*keys).applyInPandasWithState(step, out, "last boolean", "append", "NoTimeout")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = load(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if one else "*.parquet")
    return reader.parquet(sf_dir if one else path)
