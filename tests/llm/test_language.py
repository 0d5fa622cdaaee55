"""Forward-backward against enumeration, gradients, and held-out accuracy."""

import itertools

import numpy as np

from jobtrail.llm import crf, language, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    labels, lengths = 3, np.array([5, 4, 1])
    emissions = rng.normal(size=(5, 3, labels))
    transitions, start = rng.normal(size=(labels, labels)), rng.normal(size=labels)
    got, pairs = crf.marginals(emissions, lengths, transitions, start)
    want, want_pairs = np.zeros_like(got), np.zeros_like(pairs)
    for n, length in enumerate(lengths):
        paths = list(itertools.product(range(labels), repeat=int(length)))
        weight = np.exp([start[p[0]] + sum(emissions[t, n, p[t]] for t in range(length))
                         + sum(transitions[p[t - 1], p[t]] for t in range(1, length)) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for t in range(length):
                want[t, n, p[t]] += w
                if t:
                    want_pairs[p[t - 1], p[t]] += w
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    model = crf.Crf(["a", "b", "c"], np.zeros((1, 3)), transitions, start)
    assert np.allclose(crf.label_shares(emissions.copy(), lengths, model), want.sum(axis=0))


def test_code_switched_words_are_labelled():
    english = "the and of that with this from have which would there their about".split()
    german = "der die und das nicht mit sich auch werden einer durch wurde sind".split()
    rng = np.random.default_rng(1)
    samples = [(name, list(rng.choice(words, 60))) for name, words in (("en", english), ("de", german)) for _ in range(40)]
    model = crf.train(samples, passes=10)
    shares, counts = crf.Labeller(model).shares(["the and of that with this der die und das 12 ...", "", "nicht mit sich"])
    assert counts.tolist() == [10, 0, 3]
    assert model.labels == ["de", "en"]
    assert abs(shares[0, 1] - 6) < 0.7 and shares[2, 0] > 2.5


def test_query_learns_languages(spark):
    lang = {d.doc_id: d.lang for d in queries.table(spark, SMALL, "documents").collect()}
    rows = queries.op10_language(spark, SMALL).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    df = odd_frame(spark)
    out = language.predict(df, language.id_remainder(5) == 0).collect()
    assert len(out) == df.count()
    found = {r.doc_id: (r.lang_pred, r.score) for r in out}
    for doc_id, text in enumerate(r for r in [None, "", " \t\n\r "]):
        assert found[doc_id] == ("und", 0.0)
    assert found[15] == ("und", 0.0)
    assert found[4][0] == "en"
    assert language.predict(empty_frame(spark), language.id_remainder(5) == 0).count() == 0


def test_nothing_to_learn_from(spark):
    rows = language.with_language(odd_frame(spark), language.fit(odd_frame(spark).where("lang = 'zz'"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_labels_are_no_input_of_a_prediction(spark):
    docs = queries.table(spark, SMALL, "documents")
    model = language.fit(docs.where("doc_id < 100"))
    one = language.with_language(docs, model).select("doc_id", "lang_pred", "score").collect()
    two = language.with_language(docs.selectExpr("doc_id", "text", "'xx' lang", "'s' source"), model) \
        .select("doc_id", "lang_pred", "score").collect()
    assert sorted(one) == sorted(two)


JAPANESE = "私たちは毎日新しい言葉を学びながら生活しています。東京の天気は晴れで、電車はとても便利です。"
THAI = "ภาษาไทยเป็นภาษาที่ไม่มีช่องว่างระหว่างคำและมีวรรณยุกต์"


def test_tokens_leave_no_letter_out():
    for text in (JAPANESE * 40, THAI * 40, "unspaced" * 100, "z" * 49 + ",und" + "ß" * 60):
        tokens = crf.tokens_of(text)
        assert len(tokens) >= len(text) / 16
        for run in text.replace("、", "。").replace(",", "。").split("。"):
            for n in (2, 3):
                for i in range(len(run) - n + 1):
                    gram = run[i:i + n]
                    if len({crf._script(c) for c in gram}) == 1:
                        assert any(gram in t for t in tokens)
    assert crf.tokens_of("Donaudampfschifffahrt,") == ["donaudampfschifffahrt"] and crf.tokens_of("--12--") == []


def test_unspaced_texts_count_whole(spark):
    english = "the and of that with this from have which would there their about other".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(english, 60)), "en") for i in range(60)]
    rows += [(100 + i, (JAPANESE if i % 2 else JAPANESE[20:] + JAPANESE[:20]) * 8, "ja") for i in range(60)]
    rows += [(200 + i, THAI[i % 9:] * 8, "th") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    footer = " read more about this from the other"
    texts = [(0, JAPANESE * 60 + footer), (1, THAI * 60 + footer), (2, footer * 60 + JAPANESE)]
    found = language.with_language(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(found)] == ["ja", "th", "en"]
    assert all(r.score > 0.8 for r in found)


def test_whole_texts_are_learned_from(spark):
    """The languages of the rows differ only far behind their beginnings."""
    same, tails = " ".join(["zz"] * 400), {"xa": "alpha beta gamma delta", "xb": "rho sigma tau upsilon"}
    rows = [(i, f"{same} {tails[lang]}", lang) for i in range(40) for lang in tails]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.learning_sample(df)
    assert sorted(sample) == sorted((lang, text.replace(" ", "\n")) for _, text, lang in rows)
    shares, _ = crf.Labeller(language.fit(df)).shares(list(tails.values()))
    assert shares[0].argmax() == 0 and shares[1].argmax() == 1


def plain_shares(model, text):
    """Expected words per label, a word and a label at a time."""
    k = range(len(model.labels))
    words = [token for word in text.split() for token in crf.tokens_of(word)]
    weights = model.weights.astype(float)
    local = [np.exp(s - s.max()) for s in (sum(weights[f] for f in crf.features_of(w)) for w in words)]
    move, start = np.exp(model.transitions), np.exp(model.start)
    ahead = []
    for t, here in enumerate(local):
        row = [here[j] * (start[j] if not t else sum(ahead[-1][i] * move[i, j] for i in k)) for j in k]
        ahead.append([x / sum(row) for x in row])
    total, back = np.zeros(len(k)), [1.0] * len(k)
    for t in reversed(range(len(local))):
        both = [ahead[t][j] * back[j] for j in k]
        total += np.array(both) / sum(both)
        before = [sum(move[i, j] * local[t][j] * back[j] for j in k) for i in k]
        back = [x / sum(before) for x in before]
    return total, len(words)


def test_query_against_plain_forward_backward(spark):
    docs = queries.table(spark, SMALL, "documents")
    model = language.fit(docs.where(language.id_remainder(5) != 0))
    texts = {d.doc_id: d.text for d in docs.collect()}
    for row in queries.op10_language(spark, SMALL).collect():
        total, n = plain_shares(model, texts[row.doc_id] or "")
        if not n:
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            at = model.labels.index(row.lang_pred)
            assert abs(row.score - total[at] / n) < 1e-3 and total[at] >= total.max() - 1e-3 * n
