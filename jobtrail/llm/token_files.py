"""Token ids as flat unsigned integer files with 64-bit document offsets.

A set of files holds, for each part of the ascending id order,

* ``part-N.ids``: the ids of its documents one after another, unsigned 16-bit
  where the vocabulary allows, else 32-bit, little-endian;
* ``part-N.off``: one more unsigned 64-bit number than it has documents: where
  each document's ids begin among the ids of *all* parts, and where the last end;
* ``part-N.doc``: the signed 64-bit document ids.

``index`` (Parquet) has a row per part. A part's first offset, its base, is the
sum of the ids in the parts before it. Files are memory-mapped for reading, so
the folder must be mounted on every executor; the vocabulary file too.

Nulls, empty and odd input: a null text is an empty one and yields the end id
alone; null document ids come first and are read back as null; rows with equal
ids are ordered by a hash of their text; other columns are ignored; an empty
table gives an index without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobtrail.llm.shared import shuffle_parts, text_of
from jobtrail.llm.word_pieces import word_pieces

INDEX_SCHEMA = "part int, n_docs long, n_tokens long, n_null_ids long, width int"
BUFFER = 4 << 20


def mounted(folder: str) -> str:
    """The local path of a folder on a mounted file system."""
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"Memory-mapped files need a mounted folder, not {folder!r}.")
    return parsed.path


class _Replaced:
    """A file that appears under its name when complete; a retried task replaces it by the same bytes."""

    def __init__(self, path: str):
        self.path = path
        self.part = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
        self.file = open(self.part, "wb", buffering=BUFFER)

    def done(self) -> None:
        self.file.close()
        os.replace(self.part, self.path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int,
                      id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> None:
    """Encode whole texts, append ``end_id`` to each and write the files in ascending id order.

    ``tokenizer`` is the path of a word-level BPE file. Rows are
    range-partitioned by id, so each task writes one part from a stream of
    Arrow batches.
    """
    spark, root = docs.sparkSession, mounted(folder)
    width = 2 if vocabulary <= 1 << 16 else 4
    dtype = f"<u{width}"
    os.makedirs(root, exist_ok=True)
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    placed = rows.repartitionByRange(parts or shuffle_parts(spark), F.col("id").asc_nulls_first(), "tie") \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").select("id", "text")

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        part, encoder = TaskContext.get().partitionId(), word_pieces(tokenizer, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        files = {kind: _Replaced(f"{root}/part-{part:06d}.{kind}") for kind in ("ids", "len", "doc")}
        docs, tokens, nulls = 0, 0, 0
        for batch in batches:
            lengths = np.empty(batch.num_rows, dtype="<i8")
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text)
                files["ids"].file.write(ids)
                files["ids"].file.write(end)
                lengths[i] = len(ids) // width + 1
            files["len"].file.write(lengths.tobytes())
            files["doc"].file.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs, tokens, nulls = docs + batch.num_rows, tokens + int(lengths.sum()), nulls + batch.column(0).null_count
        for file in files.values():
            file.done()
        encoder.forget()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n_docs": [docs], "n_tokens": [tokens], "n_null_ids": [nulls],
            "width": pa.array([width], pa.int32())})

    placed.mapInArrow(write_part, INDEX_SCHEMA).where("n_docs > 0").write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/counts")
    # One row per part: the only ordered window over a few numbers per task of the first job.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = counts.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:06d}"
                ends = np.cumsum(np.fromfile(f"{name}.len", dtype="<i8"))
                file = _Replaced(f"{name}.off")
                file.file.write((np.concatenate([[0], ends]) + row["base"]).astype("<u8").tobytes())
                file.done()
            yield batch

    index.repartition(shuffle_parts(spark), "part").mapInArrow(write_offsets, index.schema) \
        .write.mode("overwrite").parquet(f"{folder}/index")


def map_token_parts(spark: SparkSession, folder: str, batch_docs: int = 4096) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` from the memory-mapped files.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers.
    """
    root = mounted(folder)
    index = spark.read.parquet(f"{folder}/index").select("part", "n_docs", "n_tokens", "n_null_ids", "width")

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            name = f"{root}/part-{row['part']:06d}"
            ids, offsets, docs = (np.memmap(f"{name}.{kind}", dtype=dtype, mode="r") for kind, dtype in
                                  (("ids", f"<u{row['width']}"), ("off", "<u8"), ("doc", "<i8")))
            for low in range(0, row["n_docs"], batch_docs):
                high = min(low + batch_docs, row["n_docs"])
                at = offsets[low:high + 1].astype(np.int64)
                inside = at - int(offsets[0])
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(inside[:-1], inside[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs[low:high], pa.int64(), mask=np.arange(low, high) < row["n_null_ids"]),
                    "start": at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(sums, pa.int64())})

    return index.repartition(shuffle_parts(spark), "part") \
        .mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")
