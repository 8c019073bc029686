"""Helpers shared by the operators: tables kept in the shared folder, words, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`saved` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def representatives(docs: DataFrame, keep: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each ``(doc_id, text_mark)`` of ``keep``, and all rows without an id.

    ``text_mark`` is the hash of the text. Of rows equal in both, that with the smallest hash of the whole row stays.
    """
    mark, key, kept_mark, whole = fresh(docs, "text_mark", "kept_id", "kept_mark", "whole")
    kept = keep.select(F.col("doc_id").alias(key), F.col("text_mark").alias(kept_mark))
    marked = docs.withColumn(mark, F.xxhash64(text))
    found = marked.join(kept, (marked[doc_id] == kept[key]) & (marked[mark] == kept[kept_mark]), "left_semi")
    one = found.groupBy(doc_id, mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(whole))
    return one.select(*(F.col(whole)[c].alias(c) for c in docs.columns)).unionByName(docs.where(F.col(doc_id).isNull()))


#: Bytes of one Arrow batch. Texts are long, and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "64m")).rstrip("b").replace("m", "000000").replace("k", "000").replace("g", "000000000")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """Apply ``fn(batch, texts)`` to Arrow batches; ``texts`` are UTF-8 bytes or None, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary() if pa.types.is_large_string(batch.column(text).type) else pa.binary())
            yield fn(batch, texts.to_pylist())

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def utf8(column) -> F.Column:
    """Text as UTF-8 bytes."""
    return F.encode(column, "UTF-8")


def held_out(doc_id) -> F.Column:
    """Rows that no label may be learnt from: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(utf8(doc_id.cast("string"))) % 5 == 0, F.lit(False))


class WordHash(dict):
    """64-bit hash per word; the dictionary is emptied when it grows beyond ``most`` words, which changes no value."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a``-``b``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        la, lb = la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
