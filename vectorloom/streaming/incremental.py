"""Models and counts kept fresh from streams of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TextProcessor
from ..operators.vocab import batches
from ..plans.training import VectorModel, update
from ..sources.formats import line_sentences
from ..sources.models import load_model, save_model


def sentence_stream(spark: SparkSession, folder: str, processor: TextProcessor | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (words): a sentence for each line of each file that arrives in the folder."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else spark.readStream
    return line_sentences(reader.text(folder), processor)


def count_stream(stream: DataFrame, state: str) -> None:
    """Counts the words of a stream of (words), all there are now, into
    `state`: one table of partial counts for each micro-batch, so that a batch that runs again replaces its own."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        counts = batch.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
        counts.write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()


def counted(spark: SparkSession, state: str) -> DataFrame:
    """(word, freq) of all batches so far."""
    return spark.read.parquet(f"{state}/counts").groupBy("word").agg(F.sum("freq").alias("freq"))


def stream_train(stream: DataFrame, model: VectorModel, corpus: DataFrame, state: str, batch_size: int, epochs: int) -> VectorModel:
    """Trains on a stream of (words) in groups of `batch_size` sentences, the
    last one shorter, and gives the model after all that is there now.

    Model and corpus are kept in `state` by micro-batch: a batch that runs
    again starts from the state before it, so its work is never applied twice."""
    spark = stream.sparkSession
    save_model(model, f"{state}/model-0")
    corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_id").cast("int").alias("sent_id"), "words").write.mode("overwrite").parquet(f"{state}/corpus-0")
    last = 0

    def learn(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        now, seen = load_model(spark, f"{state}/model-{batch_id}"), spark.read.parquet(f"{state}/corpus-{batch_id}")
        rows = batches(batch.withColumn("_u", F.monotonically_increasing_id()), ["_u"], batch_size, F.shiftright("_u", 12))
        number = (F.col("batch_id") * batch_size + F.col("place")).cast("int")
        path = f"{state}/arrived-{batch_id}"
        rows.select(F.lit(-1 - batch_id).cast("long").alias("doc_id"), number.alias("sent_id"), "words", "batch_id").write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        for k in [r["batch_id"] for r in rows.select("batch_id").distinct().orderBy("batch_id").collect()]:
            now, seen = update(now, seen, rows.where(F.col("batch_id") == k).drop("batch_id"), epochs)
        save_model(now, f"{state}/model-{batch_id + 1}")
        seen.write.mode("overwrite").parquet(f"{state}/corpus-{batch_id + 1}")
        last = batch_id + 1

    stream.writeStream.foreachBatch(learn).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start().awaitTermination()
    return load_model(spark, f"{state}/model-{last}")
