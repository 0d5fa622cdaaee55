"""The corpus pipeline against brute force, stage by stage and as a whole."""

import hashlib
import math

import pytest

import corpus_pipeline
from jobtrail.llm import language, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame
from tests.llm.test_near_duplicates import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def poisson_copies(rows):
    """Copies of each (doc_id, source, text) by inverting the distribution term by term."""
    size = {}
    for _, source, text in rows:
        size[source] = size.get(source, 0) + len((text or "").encode())
    weight = {s: n ** corpus_pipeline.MIX_POWER for s, n in size.items()}
    out = {}
    for doc_id, source, _ in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source]
        pieces = max(1, math.ceil(rate / 8))
        n = 0
        for k in range(1, pieces + 1):
            u, p = unit(f"7|{doc_id}|{k}"), math.exp(-rate / pieces)
            total, x = p, 0
            while total <= u:
                x += 1
                p *= rate / pieces / x
                total += p
            n += x
        out[doc_id] = n
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
        out.append(docs)
    return out


def test_language_stage(spark, stages):
    docs = queries.table(spark, SMALL, "documents")
    rows = language.with_language(docs, language.fit(docs)).collect()
    want = {r.doc_id for r in rows if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE}
    assert {r.doc_id for r in stages[0].collect()} == want
    assert stages[0].columns == docs.columns
    assert len(want) >= 0.97 * len(rows)


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    want = {i for i, r in brute(rows, 5).items() if r[3]}
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(want)


def test_mixing_stage(stages):
    want = poisson_copies([(r.doc_id, r.source, r.text) for r in stages[1].collect()])
    got = [r.doc_id for r in stages[2].collect()]
    assert {i: got.count(i) for i in want} == want


def test_bpe_stage_and_run(spark, stages):
    from tokenizers import Tokenizer
    from tests.llm.test_tokens import expected_bpe
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r.doc_id, *expected_bpe(tokenizer, r.text)) for r in stages[2].collect())
    assert sorted(map(tuple, stages[3].collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == want


def test_odd_rows_pass_every_stage(spark):
    for frame in (odd_frame(spark), empty_frame(spark)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SMALL)
            if name != "bpe":
                assert after.columns == frame.columns
            after.collect()
            docs = after
