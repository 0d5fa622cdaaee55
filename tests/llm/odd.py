"""Awkward rows that every operator must take."""

import os
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _block int, id long, rank string"
SMALL = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def odd_texts():
    rng = random.Random(5)
    syllables = ["the", "ing", "er", "tion", "an", "é", "ß", "ng"]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(9000))
    return [
        None, "", " \t\n\r ", "one", "One two, THREE!! it's we'll 12 3.14 <|endoftext|> x<|STARTOFTEXT|>y",
        "caf\u00e9 cafe\u0301 \u0130stanbul \u03a3\u03a3\u03a3 \u1e9e \ufb01 \u00a0wide\u2003space\u200bzero", "\u4f60\u597d \U0001f600 \u0645\u0631\u062d\u0628\u0627",
        "'s 't and.'s a.b don't.", "z" * 5000, prose, prose, prose + " end", "x" * 60 + ".,!", "a\x1cb\x85c\x0bd\x0ce",
        "\x00 null byte", "12 34-56 $$$ ***",
    ]


def odd_frame(spark, repeat=1):
    """Null and repeated ids, repeated rows and extra columns with clashing names."""
    rows = []
    for i, text in enumerate(odd_texts()):
        rows.append((i, text, "en" if i % 3 else None, "s" if i % 2 else None, None, 1, i, "r"))
    rows.append((None, "no id here", None, None, None, None, None, None))
    rows += [rows[4], rows[9]]
    return spark.createDataFrame(rows * repeat, SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
