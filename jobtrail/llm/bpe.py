"""BPE encoding and decoding of whole texts through a table of distinct words.

Texts are split into words, every distinct word of the corpus is encoded once
with the tokenizers library, and the ids are joined back to the documents by
position. To decode, the distinct ids of the corpus are joined to the table of the
vocabulary's pieces, a row per id; what is found are the pieces texts are put
together from. The vocabulary's size is fixed, so its table is broadcast and what
is found travels to every block.

Defined results: null texts are empty and have no ids (digests of the empty
string); every input row gives one output row, also repeated ones and those
with a null id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.llm.blocks import BLOCK, answer_words, block_count, join_answers, pack, read_answers, unsqueeze
from jobtrail.llm.shared import shuffle_parts, text_of
from jobtrail.llm.word_pieces import split_words, word_pieces

# The bucket number of the rows that hold a block's pieces.
PIECES = -2


def _distinct(texts: list[str]) -> list[bytes]:
    words: set[str] = set()
    for text in texts:
        words.update(split_words(text))
    words.discard("")
    return [w.encode() for w in words]


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``id, piece`` of the whole vocabulary."""
    pieces = word_pieces(tokenizer, "<u4").tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, piece) for piece, i in pieces.items()), "id long, piece string")


def _used_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct ids of a task's answers, each behind its words' lengths; at most a vocabulary of them."""
    used = np.zeros(0, dtype="<u4")
    for batch in batches:
        for data in batch.column("answers").to_pylist():
            numbers = np.frombuffer(unsqueeze(data), "<u4")
            # The lengths come first and add up to the number of ids behind them.
            ends = np.cumsum(numbers, dtype=np.int64) + np.arange(1, len(numbers) + 1)
            words = int(np.searchsorted(ends, len(numbers))) + 1
            used = np.union1d(used, numbers[words:])
    yield pa.RecordBatch.from_pydict({"id": pa.array(used.astype(np.int64))})


def _block_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's answers, each of which is in one task."""
    blocks: set[int] = set()
    for batch in batches:
        blocks.update(batch.column(BLOCK).to_pylist())
    yield pa.RecordBatch.from_pydict({BLOCK: pa.array(sorted(blocks), pa.int32())})


def encode_and_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the decimal ids joined by a space and of the decoded
    text, special tokens included.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"))
    blocks = block_count(rows)
    packed = pack(rows, F.struct("doc_id", "text"), blocks)
    buckets = shuffle_parts(docs.sparkSession)

    def words_of_block(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
        words = _distinct(table.column("text").to_pylist())
        return words, np.zeros(len(words), dtype=np.int64)

    def encode_words(words: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        encoder = word_pieces(tokenizer, "<u4")
        ids = [encoder.encode_word(w.decode()) for w in words]
        encoder.forget()
        return np.array([len(i) // 4 for i in ids], dtype=np.int64), np.frombuffer(b"".join(ids), "<u4")

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        is_piece = pc.equal(answers.column("bucket"), PIECES)
        ids_of = read_answers(_distinct(texts), answers.filter(pc.invert(is_piece)), buckets, "<u4")
        piece: dict[int, str] = {}
        for listed in answers.filter(is_piece).column("answers").to_pylist():
            piece |= {int(i): p for i, p in json.loads(listed or b"{}").items()}
        decimal = {i: str(i) for i in piece}
        known = {}
        for word, ids in ids_of:
            if ids:
                known[word.decode()] = (" ".join([decimal[i] for i in ids]), " ".join([piece[i] for i in ids]), len(ids))
        counts, id_sums, text_sums = [], [], []
        for text in texts:
            found = [known[w] for w in split_words(text) if w in known]
            counts.append(sum([f[2] for f in found]))
            id_sums.append(hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest())
            text_sums.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                         "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())})

    # One exchange by block serves the ids' join and the texts.
    answers = answer_words(packed, words_of_block, encode_words).repartition(blocks, BLOCK)
    used = answers.mapInArrow(_used_ids, "id long").distinct()
    found = used.join(F.broadcast(piece_table(docs.sparkSession, tokenizer)), "id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "piece")))).alias("pieces"))
    # One row of at most a vocabulary of pieces, a constant that every block gets as one more answer.
    pieces = answers.mapInArrow(_block_numbers, f"{BLOCK} int").select(
        BLOCK, F.lit(PIECES).alias("bucket"), found.scalar().cast("binary").alias("answers"))
    return join_answers(packed, answers.unionByName(pieces), finish,
                        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
