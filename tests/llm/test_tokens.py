"""Token files and BPE digests against the tokenizers library used directly."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from jobtrail.llm import bpe, queries, token_files
from jobtrail.llm.word_pieces import WordPieces
from tests.llm.odd import SMALL, empty_frame, odd_frame, odd_texts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def expected_bpe(tokenizer, text):
    ids = ids_of(tokenizer, text)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_words_give_the_ids_of_the_text(tokenizer):
    encoder = WordPieces(queries.tokenizer_path())
    for text in odd_texts():
        assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == ids_of(tokenizer, text)


def test_words_forgotten_by_the_cache_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr("jobtrail.llm.word_pieces.CACHED_WORDS", 5)
    encoder = WordPieces(queries.tokenizer_path())
    text = odd_texts()[9]
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_bpe_of_odd_rows(spark, tokenizer):
    df = odd_frame(spark)
    got = sorted(map(tuple, bpe.encode_and_decode(df, queries.tokenizer_path()).collect()), key=str)
    want = sorted(((r.doc_id, *expected_bpe(tokenizer, r.text)) for r in df.collect()), key=str)
    assert got == want
    assert bpe.encode_and_decode(empty_frame(spark), queries.tokenizer_path()).count() == 0


def test_bpe_query(spark, tokenizer):
    docs = queries.table(spark, SMALL, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_bpe(spark, SMALL).collect()}
    assert got == {d.doc_id: expected_bpe(tokenizer, d.text) for d in docs}


def test_bpe_ships_each_text_once(spark):
    found = queries.op9_bpe(spark, SMALL)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # Texts are packed once and words are encoded once, though both are read twice.
    assert final.count("ReusedExchange") >= 2
    assert final.count("Scan parquet") == 1 and final.count("FlatMapGroupsInArrow") == 2, final


def expected_files(tokenizer, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark, tokenizer, tmp_path):
    df = odd_frame(spark)
    folder = f"file://{tmp_path}/files"
    token_files.write_token_files(df, folder, queries.tokenizer_path(), 2, queries.VOCABULARY, parts=5)
    got = sorted(map(tuple, token_files.map_token_parts(spark, folder, batch_docs=3).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda i: -1 if i is None else i)
    sums = sorted(r[2:] for r in got)
    assert sums == sorted(r[2:] for r in expected_files(tokenizer, [(r.doc_id, r.text) for r in df.collect()]))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_token_files_may_be_empty(spark, tmp_path):
    token_files.write_token_files(empty_frame(spark), str(tmp_path / "none"), queries.tokenizer_path(), 2, 49_408)
    assert token_files.map_token_parts(spark, str(tmp_path / "none")).count() == 0


def test_token_files_need_a_mounted_folder(spark):
    with pytest.raises(ValueError):
        token_files.mounted("s3a://bucket/files")


def test_wide_vocabularies_use_four_bytes(spark, tmp_path):
    df = odd_frame(spark).where("doc_id = 4")
    token_files.write_token_files(df, str(tmp_path / "wide"), queries.tokenizer_path(), 2, 1 << 17, parts=2)
    token_files.write_token_files(df, str(tmp_path / "short"), queries.tokenizer_path(), 2, 49_408, parts=2)
    wide, short = (sorted(map(tuple, token_files.map_token_parts(spark, str(tmp_path / k)).collect()))
                   for k in ("wide", "short"))
    assert wide == short
    size = {k: sum(os.path.getsize(tmp_path / k / f) for f in os.listdir(tmp_path / k) if f.endswith(".ids"))
            for k in ("wide", "short")}
    assert size["wide"] == 2 * size["short"]


def test_token_file_query(spark, tokenizer):
    docs = sorted((d.doc_id, d.text) for d in queries.table(spark, SMALL, "documents").collect())
    got = sorted(map(tuple, queries.op1_token_files(spark, SMALL).collect()))
    assert got == expected_files(tokenizer, docs)


def test_blocks_shrink_with_their_bytes_and_pieces_are_joined(spark, monkeypatch):
    """Blocks of a few bytes give the same rows; the plan joins ids to the table of pieces."""
    from jobtrail.llm import blocks, bpe

    want = sorted(map(str, bpe.encode_and_decode(odd_frame(spark), queries.tokenizer_path()).collect()))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2_000)
    got = bpe.encode_and_decode(odd_frame(spark), queries.tokenizer_path())
    assert sorted(map(str, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin [id" in plan and "piece" in plan
    assert blocks.block_count(odd_frame(spark)) > 40 and blocks.block_count(empty_frame(spark)) == 4
