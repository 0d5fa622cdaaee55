"""Consistent weighted samples: edits against plain Python, likeness against generalised Jaccard."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import fingerprints, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jaccard(a, b):
    a, b = (Counter(WORD.findall(t.translate(LOWER))) for t in (a, b))
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def expected(rows):
    """Per id: characters, edited text's digest, exact likenesses."""
    out = {}
    texts = [t or "" for _, t in rows]
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, after))
    return out


def same(found, rows, tolerance=0.45):
    want = expected(rows)
    assert len(found) == len(rows)
    gaps = []
    for r in found:
        n, digest, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        gaps += [r.near_edited - edited, r.near_next - after]
    assert max(map(abs, gaps)) < tolerance
    assert abs(sum(gaps) / len(gaps)) < 0.03


def test_query(spark):
    rows = sorted((d.doc_id, d.text) for d in queries.table(spark, SMALL, "documents").collect())
    found = queries.op2_fingerprints(spark, SMALL).collect()
    same(found, rows)
    text = dict(rows)
    marks = {}
    for r in found:
        marks.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values())


@pytest.mark.parametrize("heads", [0, 500_000])
def test_blocks_and_gaps(spark, monkeypatch, heads):
    monkeypatch.setattr(fingerprints, "BLOCK_BITS", 3)
    monkeypatch.setattr(fingerprints, "SENT_HEADS", heads)
    rows = [(i * i * 5 - 400, f"word{i} and more of text {i % 3} \U0001f600 A B a b " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(fingerprints.edited_fingerprints(df).collect(), rows)


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """One long fingerprint per pair, so the rate is known closely."""
    pairs = [("a a a a b b c d", "a a b b b c e"), ("x y z", "x y w"), ("p p p p p p p p q", "p q q q q q q q q"),
             ("one two", "three four"), ("k " * 50, "k " * 25)]
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(df, samples=1500).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(found[2 * i] - jaccard(a, b)) < 0.05


def test_odd_rows(spark):
    df = odd_frame(spark)
    found = fingerprints.edited_fingerprints(df).collect()
    assert len(found) == df.count()
    assert sum(r.doc_id is None for r in found) == 1
    clean = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same(fingerprints.edited_fingerprints(clean).collect(), sorted((r.doc_id, r.text) for r in clean.collect()), 0.6)
    assert {r.fingerprint for r in found if r.doc_id in (0, 1, 2)} == {""}
    assert fingerprints.edited_fingerprints(empty_frame(spark)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "alone here")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0


def test_main_path_is_native(spark):
    plan = queries.op2_fingerprints(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_logarithms_per_term(spark):
    """A sample costs the three logarithms of its hashes; those of the weights are taken before terms meet the seeds."""
    terms = spark.createDataFrame([(1, 1, 7, 2, 1), (1, 1, 8, 0, 3), (1, 2, None, 1, 1)],
                                  "block long, place int, term long, a long, b long")
    drawn = fingerprints.draw_samples(terms, ["block", "place"], 4)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "cast(a#" not in above and below.count("LOG(cast(") + below.count("ln(cast(") == 2
    found = {r.place: r.samples for r in drawn.collect()}
    assert all(s.a is not None and s.b is not None for s in found[1]) and len(found[1]) == 4
    assert all(s.a is None and s.b is None for s in found[2])
