"""Streams: documents that arrive as files are ingested batch by batch; conversations keep their last turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.cache import upsert
from ..operators.chunking import chunk_document
from ..operators.ingest import replace_partitions

INCOMING = "doc_key string, heading string, text string"
HISTORY = 6


def ingest(spark: SparkSession, incoming: str, chunks: str, checkpoint: str, strategy: str = "fixed") -> StreamingQuery:
    """Chunks each batch of Parquet drops into `chunks`, partitioned by strategy and document. A document that comes again takes the
    place of its former self, and a batch that runs again writes the same, so restarts do no harm."""

    def write(batch: DataFrame, _: int) -> None:
        last = batch.withColumn("n", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("arrived"), "text"))).where("n = 1")
        made = chunk_document(last, strategy).withColumn("strategy", F.lit(strategy)).withColumn("doc_key", F.regexp_extract("chunk_uid", f"^(.*)-{strategy}-L", 1))
        replace_partitions(made, chunks, ["strategy", "doc_key"])

    rows = spark.readStream.schema(INCOMING).parquet(incoming).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_turns(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """conversations (conv_id, turn, role, text): at each user turn the user's own texts so far, the last n at most."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(n - 1), 0)
    return turns.where("role = 'user'").select("conv_id", "turn", F.collect_list("text").over(order).alias("history"))


def history_stream(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The same for a stream: each conversation keeps its last n user texts as state, and each user turn comes out with them."""

    def step(key, frames, state):
        import pandas as pd

        texts = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, text in zip(rows["turn"], rows["text"]):
            texts = [*texts, text][-n:]
            out.append((key[0], int(turn), texts))
        state.update((texts,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])

    users = turns.where("role = 'user'").select("conv_id", "turn", "text").groupBy("conv_id")
    return users.applyInPandasWithState(step, "conv_id long, turn long, history array<string>", "texts array<string>", "append", GroupStateTimeout.NoTimeout)


def store_cache(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of entries of the cache goes into versions under path: each batch makes one, from the version before and its own, of each key the last entry. A
    batch that runs again writes the same version."""
    spark = entries.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("exp_id", "cache_key").orderBy(F.desc("created_at"), F.desc("answer_json"))
        fresh = batch.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
        before = cache_versions(spark, path, number)
        whole = upsert(spark.read.parquet(f"{path}/version-{before[-1]}"), fresh) if before else fresh
        whole.write.mode("overwrite").parquet(f"{path}/version-{number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """Versions that have been written, ascending; those below a number."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in store.listStatus(place)] if store.exists(place) else []
    done = [int(p.getName().removeprefix("version-")) for p in names if p.getName().startswith("version-") and store.exists(p.suffix("/_SUCCESS"))]
    return sorted(v for v in done if below is None or v < below)


def exact_cache(answers: DataFrame, hours: int = 24) -> DataFrame:
    """A stream of (key, answer, created_at) with each key's first answer of the last hours: the state of older ones is dropped. For a store where the last
    answer counts, see store_cache."""
    return answers.withWatermark("created_at", f"{hours} hours").dropDuplicatesWithinWatermark(["key"])
