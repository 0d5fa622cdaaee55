"""Language of whole texts from a conditional random field over their words.

The field is fitted on the driver from a bounded sample: about ``sample``
labelled whole texts, spread evenly over the languages by a hash of the document
id. Runs of different texts are put together to code-switched sequences. In scripts
without spaces the pieces of ``crf.tokens_of`` are the words. Every text is then
labelled whole; its language is the one with the most expected words, and the
score is that language's share of the words.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything if there is no labelled text to learn from; languages that
tie go by name; repeated rows and null ids are kept; a null id counts as
the empty text when the held-out part is chosen; extra columns are ignored by
``predict`` and kept by ``with_language``; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.llm import crf
from jobtrail.llm.shared import hex_unit, releasing

UNKNOWN = "und"
# Documented bound of the labelled sample: whole texts over all languages.
SAMPLE_TEXTS = 4_000


def learning_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, seed: int = 3, id_column: str = "doc_id",
                    text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, str]]:
    """About ``texts`` labelled texts, as many of each language: the words that have labels, a line each.

    The hash keeps a text with the probability that gives its language its
    part, so the sample's size is bounded in expectation whatever the input.
    """
    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(texts).collect()}
    if not sizes:
        return []
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, texts / len(sizes) / n))).otherwise(share)
    identity = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("t"), F.md5("text")))
    chosen = labelled.where(hex_unit(F.concat(F.lit(f"sample{seed}|"), identity)) < share)
    texts_ = chosen.select("lang", identity.alias("identity"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = ["\n".join(token for word in text.split() for token in crf.tokens_of(word))
                    for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.string())],
                                             names=["lang", "identity", "run"])

    rows = texts_.mapInArrow(releasing(cut), texts_.select("lang", "identity").schema.add("run", "string")).collect()
    return [(row["lang"], row["run"]) for row in sorted(rows, key=lambda r: (r["lang"], r["identity"], r["run"])) if row["run"]]


def fit(docs: DataFrame, **sample: object) -> crf.Crf | None:
    """The field learned from the labelled rows of ``docs``; None if there are none."""
    samples = learning_sample(docs, **sample)
    return crf.train((lang, run.split("\n")) for lang, run in samples) if samples else None


def with_language(docs: DataFrame, model: crf.Crf | None, text_column: str = "text", lang_column: str = "lang_pred",
                  score_column: str = "score") -> DataFrame:
    """Add the language and its share of the words; columns of these names are replaced."""
    kept = docs.drop(lang_column, score_column)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = crf.Labeller(model) if model is not None else None
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if labeller is not None:
                shares, counts = labeller.shares(texts)
                best = shares.argmax(axis=1)
                langs = [model.labels[b] if n else UNKNOWN for b, n in zip(best, counts)]
                top = shares[np.arange(len(texts)), best]
                scores = np.clip(np.divide(top, counts, out=scores, where=counts > 0), 0.0, 1.0)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores)],
                                             names=[*batch.schema.names[:-1], lang_column, score_column])

    schema = kept.withColumn(lang_column, F.lit("")).withColumn(score_column, F.lit(0.0)).schema
    return kept.withColumn("_text", F.col(text_column)).mapInArrow(releasing(label), schema)


def predict(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text",
            lang_column: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out; ``doc_id, held_out, lang_pred, score`` of all rows."""
    model = fit(docs.where(~held_out), id_column=id_column, text_column=text_column, lang_column=lang_column)
    narrow = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), held_out.alias("held_out"),
                         F.col(text_column).alias("text"))
    return with_language(narrow, model).select("doc_id", "held_out", "lang_pred", "score")


def id_remainder(divisor: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(divisor)
