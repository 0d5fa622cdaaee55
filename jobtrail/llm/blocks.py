"""Distinct words of blocks of documents, answered word by word, joined back by position.

Texts hold hundreds of words each, and the vocabulary grows with the corpus, so
neither a row per word nor a broadcast table is affordable. Here documents are
dealt into blocks by hash (one shuffle of compressed texts). A block sends each
of its distinct words once to the bucket of that word; the bucket sees all of
the corpus' occurrences of its words, answers every distinct word once, and
returns the answers in the order in which the block sent the words. There are
as many buckets as shuffle partitions, and at least as many blocks, more if a
block's texts would exceed ``BLOCK_BYTES``; a frequent word is one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.llm.shared import releasing, releasing_group, shuffle_parts

BLOCK = "_block"
SUMMARY = -1
# Bytes of the texts of a block.
BLOCK_BYTES = 64 << 20
Words = list[bytes]


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(packed: Sequence[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in packed)


def block_count(rows: DataFrame, text: str = "text", block_bytes: int | None = None) -> int:
    """As many blocks as shuffle partitions, more if a block would have more than ``block_bytes`` of texts."""
    size = rows.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return max(shuffle_parts(rows.sparkSession), -(-size // (block_bytes or BLOCK_BYTES)))


def pack(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """Deal rows into ``n`` blocks by the hash of ``key``; a row holds some of a block's rows, compressed together."""
    dealt = rows.withColumn(BLOCK, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))

    def pack_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = table.column(BLOCK).to_numpy()
            order = np.argsort(block, kind="stable")
            table = table.drop_columns([BLOCK]).take(order)
            found, starts = np.unique(block[order], return_index=True)
            for b, low, high in zip(found, starts, [*starts[1:], len(order)]):
                yield pa.RecordBatch.from_pydict({BLOCK: pa.array([b], pa.int32()),
                                                  "rows": pa.array([to_bytes(table.slice(low, high - low))], pa.binary())})

    return dealt.mapInArrow(releasing(pack_batch), f"{BLOCK} int, rows binary").repartition(n, BLOCK)


def by_bucket(words: set[bytes] | Sequence[bytes], buckets: int) -> dict[int, Words]:
    """Words of each bucket in a fixed order."""
    out: dict[int, Words] = {}
    for word in sorted(words):
        out.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return out


def answer_words(packed: DataFrame, count_words: Callable[[pa.Table], tuple[Sequence[bytes], np.ndarray]],
                 answer: Callable[[Words, np.ndarray], tuple[np.ndarray, np.ndarray]],
                 summary: Callable[[Words, np.ndarray], bytes] | None = None) -> DataFrame:
    """Send distinct words to their buckets and the answers back.

    ``count_words`` gives a block's distinct words and a number for each.
    ``answer`` gets the distinct words of a bucket with the sums of their
    numbers and gives ``(lengths, data)``: the length of each word's answer and
    all answers in one array. Result: ``_block, bucket, answers`` (see
    ``read_answers``). With ``summary`` each bucket adds a row whose block is
    ``SUMMARY`` and whose answer is the summary of its words.
    """
    buckets = shuffle_parts(packed.sparkSession)

    def send(table: pa.Table) -> pa.Table:
        block = table.column(BLOCK)[0].as_py()
        words, numbers = count_words(from_bytes(table.column("rows").to_pylist()))
        number_of = dict(zip(words, numbers.tolist()))
        rows = by_bucket(words, buckets)
        return pa.table({
            BLOCK: pa.array([block] * len(rows), pa.int32()), "bucket": pa.array(list(rows), pa.int32()),
            "words": pa.array([squeeze(b"\n".join(w)) for w in rows.values()], pa.binary()),
            "numbers": pa.array([squeeze(np.array([number_of[x] for x in w], "<i8").tobytes()) for w in rows.values()],
                                pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        sent, sums = [], np.zeros(0, dtype=np.int64)
        for words, numbers in zip(table.column("words").to_pylist(), table.column("numbers").to_pylist()):
            at = np.array([place.setdefault(w, len(place)) for w in unsqueeze(words).split(b"\n")])
            if len(place) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(place), dtype=np.int64)])
            sums[at] += np.frombuffer(unsqueeze(numbers), "<i8")
            sent.append(at)
        lengths, data = answer(list(place), sums[:len(place)])
        ends = np.cumsum(lengths)
        out = []
        for at in sent:
            size = lengths[at]
            first = np.cumsum(size) - size
            take = np.repeat(ends[at] - size - first, size) + np.arange(int(size.sum()))
            out.append(squeeze(size.astype("<u4").tobytes() + data[take].tobytes()))
        blocks, bucket = table.column(BLOCK).to_pylist(), table.column("bucket")[0].as_py()
        if summary is not None:
            blocks.append(SUMMARY)
            out.append(summary(list(place), sums[:len(place)]))
        return pa.table({BLOCK: pa.array(blocks, pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "answers": pa.array(out, pa.binary())})

    sent = packed.groupBy(BLOCK).applyInArrow(releasing_group(send), f"{BLOCK} int, bucket int, words binary, numbers binary")
    return sent.groupBy("bucket").applyInArrow(releasing_group(reply), f"{BLOCK} int, bucket int, answers binary")


def read_answers(words: Sequence[bytes], table: pa.Table, buckets: int, dtype: str) -> Iterator[tuple[bytes, list[int]]]:
    """Each word and its answer, for the block whose answers are in ``table``; one bucket's at a time are in memory."""
    sent = by_bucket(words, buckets)
    for bucket, packed in zip(table.column("bucket").to_pylist(), table.column("answers")):
        names, data = sent.pop(bucket), unsqueeze(packed.as_py())
        ends = np.cumsum(np.frombuffer(data, "<u4", len(names))).tolist()
        answers = np.frombuffer(data, dtype, offset=4 * len(names)).tolist()
        for word, low, high in zip(names, [0, *ends], ends):
            yield word, answers[low:high]


def read_numbers(words: Sequence[bytes], table: pa.Table, buckets: int) -> dict[bytes, int]:
    """Word -> its answer, where every answer is one number."""
    sent, out = by_bucket(words, buckets), {}
    for bucket, packed in zip(table.column("bucket").to_pylist(), table.column("answers").to_pylist()):
        names = sent[bucket]
        out.update(zip(names, np.frombuffer(unsqueeze(packed), "<i8", offset=4 * len(names)).tolist()))
    return out


def join_answers(packed: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table],
                 schema: str) -> DataFrame:
    """Give each block's rows and its answers to ``finish``."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(from_bytes(left.column("rows").to_pylist()), right)

    return packed.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(releasing_group(both), schema)
