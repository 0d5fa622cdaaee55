"""Log-likelihood of whole documents under a gated recurrent language model.

Counts cover every training token. The most frequent words are the model's; all
others share the last output class, inside which a word has the probability
``(count + 1)`` over the sum of that for all other words and one unknown word,
so the model is a distribution over texts. Training goes once over all
training documents in slices of growing size: each task continues from the
shared parameters on its documents, then the parameters are averaged, weighted
by words, in two levels.

Defined results: null and empty texts are the end alone; without training
documents counts are zero and the model is uniform over the end and the rest;
repeated rows and null ids are kept; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.llm import gru
from jobtrail.llm.blocks import BLOCK, SUMMARY, answer_words, block_count, join_answers, pack, read_numbers, squeeze, unsqueeze
from jobtrail.llm.shared import hex_unit, shuffle_parts, text_of, written

# Hash slices of the training documents; parameters are averaged after each.
SLICES = (0.0, 1 / 64, 1 / 8, 1 / 2, 1.0)
RATES = (0.08, 0.08, 0.06, 0.04)
# Words learned from in one go, and parts averaged in the second level.
GO_WORDS = 1 << 20
GROUPS = 32
# Groups in which the buckets' most frequent words are brought together.
MERGED = 16
PART_SCHEMA = "part int, weight long, model binary"


def tokens(text: bytes) -> list[bytes]:
    """Words between the white space of ASCII, A-Z lower-cased."""
    return text.lower().split()


class _Numbers(dict):
    """Word -> number; all words not listed share one."""

    def __init__(self, words: list[bytes], other: int):
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self.other = other

    def __missing__(self, word: bytes) -> int:
        return self.other


def _numbered(words: list[bytes], number: _Numbers) -> np.ndarray:
    out = np.empty(len(words) + 1, dtype=np.int32)
    get, other = number.get, number.other
    out[:-1] = [get(word, other) for word in words]
    out[-1] = gru.END
    return out


class _Places(dict):
    """Distinct words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def _head_words(answers: DataFrame, words: int) -> tuple[int, int, list[tuple[bytes, int]]]:
    """Training tokens, distinct ones, and the most frequent words of the corpus."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals and the most frequent words of a group of buckets; one bucket's at a time is in memory."""
        total = distinct = 0
        top: list[tuple[int, bytes]] = []
        for batch in batches:
            for data in batch.column("answers").to_pylist():
                data = unsqueeze(data)
                tokens_, types, n = np.frombuffer(data, "<i8", 3).tolist()
                counts = np.frombuffer(data, "<i8", n, offset=24).tolist()
                total, distinct = total + tokens_, distinct + types
                top = sorted([*top, *zip([-c for c in counts], data[24 + 8 * n:].split(b"\n"))])[:words]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([None, *[w for _, w in top]], pa.binary()),
            "n": pa.array([total, *[-c for c, _ in top]], pa.int64()),
            "distinct": pa.array([distinct, *[0] * len(top)], pa.int64())})

    rows = answers.where(F.col(BLOCK) == SUMMARY).select(
        F.pmod("bucket", F.lit(MERGED)).alias("group"), "answers").groupBy("group") \
        .applyInArrow(merge, "word binary, n long, distinct long")
    total, distinct = rows.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)),
                                                     F.coalesce(F.sum("distinct"), F.lit(0))).first()
    heads = rows.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(words).collect()
    return total, distinct, [(bytes(r["word"]), r["n"]) for r in heads]


def _summary(words: int):
    """A bucket's tokens, distinct words and most frequent words."""

    def summary(names: list[bytes], counts: np.ndarray) -> bytes:
        seen = np.flatnonzero(counts)
        top = sorted(seen[np.argsort(-counts[seen], kind="stable")].tolist(), key=lambda i: (-counts[i], names[i]))[:words]
        facts = np.array([counts.sum(), len(seen), len(top), *counts[top]], dtype="<i8")
        return squeeze(facts.tobytes() + b"\n".join([names[i] for i in top]))

    return summary


def average(models: DataFrame) -> DataFrame:
    """The weighted mean of the models of each group of parts; one model at a time is in memory."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, group = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                numbers = np.frombuffer(row["model"], "<f4").astype(np.float64) * row["weight"]
                total = numbers if total is None else total + numbers
                weight, group = weight + row["weight"], row["part"]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([group], pa.int32()), "weight": pa.array([weight], pa.int64()),
            "model": pa.array([(total / max(weight, 1)).astype("<f4").tobytes()], pa.binary())})

    return models.withColumn("part", F.pmod("part", F.lit(GROUPS)).cast("int")).groupBy("part").applyInArrow(mean, PART_SCHEMA)


def train(docs: DataFrame, model: gru.Gru, number: _Numbers) -> gru.Gru:
    """One pass over ``docs`` (``slice, text``) in hash slices with averaging after each."""
    for low, high, rate in zip(SLICES, SLICES[1:], RATES):

        def learn(batches: Iterator[pa.RecordBatch], start: gru.Gru = model, rate: float = rate) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(start.unpack(start.pack()), rate)
            waiting, size = [], 0
            for batch in batches:
                for text in batch.column(0).cast(pa.binary()):
                    waiting.append(_numbered(tokens(text.as_py()), number))
                    size += len(waiting[-1])
                    if size >= GO_WORDS:
                        trainer.learn(np.concatenate(waiting))
                        waiting, size = [], 0
            if waiting:
                trainer.learn(np.concatenate(waiting))
            if trainer.words:
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                    "weight": pa.array([trainer.words], pa.int64()), "model": pa.array([trainer.model.pack()], pa.binary())})

        part = docs.where((F.col("slice") >= low) & (F.col("slice") < high)).select("text")
        found = average(part.mapInArrow(learn, PART_SCHEMA)).collect()
        weight = sum(r["weight"] for r in found)
        if weight:
            mean = sum(np.frombuffer(r["model"], "<f4").astype(np.float64) * (r["weight"] / weight) for r in found)
            model = model.unpack(mean.astype("<f4"))
    return model


def score_documents(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text",
                    words: int = gru.WORDS) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the base-10 log-probability of the whole text under the model,
    ``base_score`` that under smoothed word counts.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    blocks = block_count(rows)
    packed = pack(rows, F.struct("doc_id", "text"), blocks)
    buckets = shuffle_parts(docs.sparkSession)

    def words_of_block(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
        counts: Counter = Counter()
        others: set[bytes] = set()
        for value, out in zip(table.column("text").cast(pa.binary()), table.column("held_out").to_pylist()):
            (others if out else counts).update(tokens(value.as_py()))
        names = [*counts, *(others - counts.keys())]
        return names, np.array([*counts.values(), *[0] * (len(names) - len(counts))], dtype=np.int64)

    def answer(names: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(names), dtype=np.int64), counts.astype("<i8")

    # Read for the corpus counts and again for the scores.
    answers = written(answer_words(packed, words_of_block, answer, _summary(words - 1)), "word-counts")
    n_words, distinct, heads = _head_words(answers, words - 1)
    texts = rows.where(~F.col("held_out"))
    ends = texts.count()
    train_tokens, types = n_words + ends, distinct + (ends > 0)
    number = _Numbers([w for w, _ in heads], len(heads) + 1)
    counts = np.array([max(ends, 1), *[n for _, n in heads]], dtype=np.float64)
    other = train_tokens - ends - sum(n for _, n in heads)
    other_mass = other + (distinct - len(heads)) + 1
    model = gru.Gru.untrained(counts, other)
    if ends:
        place = hex_unit(F.concat(F.lit("slice|"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))))
        model = train(texts.select(place.alias("slice"), "text"), model, number)
    whole = float(train_tokens + types + 1)

    def finish(table: pa.Table, right: pa.Table) -> pa.Table:
        # Every text is split once; from then on its words are places in the list of the block's distinct ones.
        place, texts_at = _Places(), []
        for value in table.column("text").cast(pa.binary()):
            found = tokens(value.as_py())
            texts_at.append(np.fromiter(map(place.__getitem__, found), dtype=np.int32, count=len(found)))
        names = list(place)
        count_of = read_numbers(names, right, buckets)
        counts_at = np.array([*map(count_of.__getitem__, names), ends], dtype=np.int64)
        ids_at = np.array([*map(number.__getitem__, names), gru.END], dtype=np.int32)
        logs_at = np.log(counts_at + 1.0)
        end, sizes, known, base, tail, numbered = len(names), [], [], [], [], []
        for at in texts_at:
            at = np.append(at, end)
            ids, logs = ids_at[at], logs_at[at]
            sizes.append(len(at))
            known.append(int(np.count_nonzero(counts_at[at])))
            base.append((logs.sum() - len(at) * np.log(whole)) / np.log(10.0))
            rare = ids == number.other
            tail.append(logs[rare].sum() - np.count_nonzero(rare) * np.log(other_mass))
            numbered.append(ids)
        scores = (gru.score_texts(model, numbered) + np.array(tail)) / np.log(10.0)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([train_tokens] * len(sizes), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})

    return join_answers(packed, answers.where(F.col(BLOCK) != SUMMARY), finish,
                        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                        "base_score double, score double")
