"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory.

A file's lines (headers) and its whole text are compared with the notices in
``TEMPLATES``. Term weights use document frequencies of the templates' terms
over all files; words of no template weigh as much as a term found in one file,
so prose around a notice lowers the whole file's cosine but not the line's.
Windows of a notice's length slide over the file's terms, across line breaks,
and meet the standard headers, other wordings and short licence texts of
``notices.py``; an SPDX tag counts as a cosine of 1. The whole file also meets
the whole licence texts, with logarithms of counts; siblings whose texts hardly
differ are told by their titles. The largest cosine names the licence.
A file whose whole text is a notice is the licence file of its directory; files
without a notice take that of the nearest ancestor directory, found by joining
the directories' ancestor paths with the licence files' directories.

Only the templates' terms and their frequencies travel to the tasks; both are
bounded by the templates and texts. Joins by path are on distinct directories, so a root
with a third of all files adds a row per directory, not per file.

Defined results: null and empty texts have no notice but inherit; a null path
inherits nothing; equal cosines go to the alphabetically first licence; of
several licence files in one directory the highest cosine counts, then the
smallest path; a tag with several licences counts as the first; repeated rows are kept; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtrail.llm import notices
from jobtrail.llm.shared import written

# SPDX identifiers and the short notices by which files name these licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
LINE_COSINE = 0.75
FILE_COSINE = 0.6
TEXT_COSINE = 0.75
TERM = re.compile("[a-z0-9]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Cosines to the templates under given document frequencies."""

    def __init__(self, templates: Mapping[str, str], files: int, frequency: Mapping[str, int]):
        self.names = sorted(templates)
        counts = [Counter(terms_of(templates[n])) for n in self.names]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        rare = math.log((1 + files) / 2) + 1
        self.rare_square = rare * rare
        self.weight = np.array([math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in self.vocabulary])
        matrix = np.zeros((len(self.names), len(self.vocabulary)))
        for row, c in zip(matrix, counts):
            for t, n in c.items():
                row[self.vocabulary[t]] = n * self.weight[self.vocabulary[t]]
        self.matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        self.square = dict(zip(self.vocabulary, (self.weight ** 2).tolist()))

    def best(self, terms: list[str], least: float) -> tuple[str | None, float]:
        """The template of the largest cosine, if that reaches ``least``."""
        counts = Counter(terms)
        own = other = 0.0
        for t, n in counts.items():
            if t in self.square:
                own += n * n * self.square[t]
            else:
                other += n * n
        whole = own + other * self.rare_square
        # No cosine is larger than the share of the vector that lies in the templates' terms.
        if own == 0.0 or own < least * least * whole:
            return None, 0.0
        vector = np.zeros(len(self.vocabulary))
        for t, n in counts.items():
            if t in self.square:
                vector[self.vocabulary[t]] = n * self.weight[self.vocabulary[t]]
        cosines = self.matrix @ vector / math.sqrt(whole)
        at = int(np.argmax(np.round(cosines, 12)))
        return (self.names[at], min(1.0, float(cosines[at]))) if cosines[at] >= least else (None, 0.0)

    def scan(self, text: str) -> tuple[str | None, float, str | None, float]:
        """The best line's licence and cosine, and the whole file's."""
        lines = [terms_of(line) for line in text.split("\n")]
        best, score = None, 0.0
        for terms in lines:
            if not self.square.keys().isdisjoint(terms):
                name, cosine = self.best(terms, LINE_COSINE)
                if name is not None and (cosine, best is None or name < best) > (score, False):
                    best, score = name, cosine
        return best, score, *self.best([t for terms in lines for t in terms], FILE_COSINE)


class Windows:
    """The window of a file's terms that is most like one of the notices."""

    def __init__(self, texts: list[tuple[str, str]], files: int, frequency: Mapping[str, int]):
        self.names = [name for name, _ in texts]
        counts = [Counter(terms_of(text)) for _, text in texts]
        self.lengths = [sum(c.values()) for c in counts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        # The last row stands for all words of no notice.
        self.weight = np.array([math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in self.vocabulary]
                               + [math.log((1 + files) / 2) + 1])
        notice = np.zeros((len(self.weight), len(texts)))
        for k, c in enumerate(counts):
            for t, n in c.items():
                notice[self.vocabulary[t], k] = n * self.weight[self.vocabulary[t]]
        notice /= np.linalg.norm(notice, axis=0)
        self.reach = notice ** 2
        self.gain = np.ascontiguousarray((notice * self.weight[:, None]).T)
        marks = np.array([self.vocabulary[t] for t in sorted(notices.MARKS & self.vocabulary.keys())], dtype=np.int64)
        self.marked = [np.intersect1d(marks, np.flatnonzero(notice[:, k])) for k in range(len(texts))]
        self.strange = [np.setdiff1d(marks, m) if n <= notices.MARKED_TERMS else marks[:0]
                        for m, n in zip(self.marked, self.lengths)]

    def best(self, terms: list[str], least: float) -> tuple[str | None, float]:
        """The notice of the largest cosine to a window of its length, if that reaches ``least``."""
        get, unknown = self.vocabulary.get, len(self.vocabulary)
        ids = np.array([get(t, unknown) for t in terms], dtype=np.int64)
        present = np.unique(ids)
        # The rest of a notice, whose terms are not in the file, takes from every cosine.
        able = np.flatnonzero(self.reach[present].sum(axis=0) >= least * least)
        if not len(able):
            return None, 0.0
        square = np.concatenate([[0.0], np.cumsum(self.weight[ids] ** 2)])
        best, score = None, 0.0
        for k in able:
            short = self.lengths[k] <= notices.MARKED_TERMS
            if short and not np.isin(self.marked[k], present, assume_unique=True).all():
                continue
            size = min(self.lengths[k], len(ids))
            dot = np.concatenate([[0.0], np.cumsum(self.gain[k][ids])])
            dot = dot[size:] - dot[:-size]
            # A word that occurs n times adds n * n squares to the window's norm, so at least n.
            bound = dot / np.sqrt(square[size:] - square[:-size])
            wanted = max(least, score - 1e-9)
            for at in np.argsort(-bound, kind="stable"):
                if bound[at] < wanted:
                    break
                window, n = np.unique(ids[at:at + size], return_counts=True)
                if short and (len(np.intersect1d(window, self.marked[k])) < len(self.marked[k])
                              or len(np.intersect1d(window, self.strange[k]))):
                    continue
                many = n.astype(float)
                # Words of no notice count as different from each other.
                squares = float(((many * self.weight[window]) ** 2)[window < unknown].sum()
                                + many[window == unknown].sum() * self.weight[unknown] ** 2)
                cosine = min(1.0, round(float(dot[at]) / math.sqrt(squares), 12))
                if cosine >= least and (cosine, best is None or self.names[k] < best) > (score, False):
                    best, score = self.names[k], cosine
                    wanted = max(least, score)
        return best, score


class Texts:
    """Cosines of whole files to whole licence texts, with logarithms of counts."""

    def __init__(self, texts: Mapping[str, str], files: int, frequency: Mapping[str, int]):
        self.names = sorted(texts)
        counts = [Counter(terms_of(texts[n])) for n in self.names]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        self.weight = np.array([math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in self.vocabulary])
        self.rare_square = (math.log((1 + files) / 2) + 1) ** 2
        matrix = np.zeros((len(self.names), len(self.vocabulary)))
        for row, c in zip(matrix, counts):
            for t, n in c.items():
                row[self.vocabulary[t]] = (1 + math.log(n)) * self.weight[self.vocabulary[t]]
        self.matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def best(self, terms: list[str], least: float) -> tuple[str | None, float]:
        """The licence of the largest cosine, if that reaches ``least``."""
        counts = Counter(terms)
        known = [(i, n) for t, n in counts.items() if (i := self.vocabulary.get(t)) is not None]
        if not known:
            return None, 0.0
        at, n = np.array(known, dtype=np.int64).T
        values = (1 + np.log(n)) * self.weight[at]
        own = float((values ** 2).sum())
        # Other words weigh their squares at least once each.
        whole = own + (len(counts) - len(known)) * self.rare_square
        if own < least * least * whole:
            return None, 0.0
        whole = own + sum((1 + math.log(n)) ** 2 for t, n in counts.items() if t not in self.vocabulary) * self.rare_square
        cosines = self.matrix[:, at] @ values / math.sqrt(whole)
        top = int(np.argmax(np.round(cosines, 12)))
        if cosines[top] < least:
            return None, 0.0
        head = f" {' '.join(terms[:notices.TITLE_TERMS])} "
        title = next((name for words, name in notices.TITLES.items() if f" {words} " in head), None)
        name = title or self.names[top]
        return (name, min(1.0, float(cosines[top]))) if title or name not in notices.TITLED else (None, 0.0)


class Scanner:
    """Everything a file is compared with; ``scan`` gives its licence, cosine and kind."""

    def __init__(self, matcher: Matcher, windows: Windows, texts: Texts):
        self.matcher, self.windows, self.texts = matcher, windows, texts

    def scan(self, text: str) -> tuple[str | None, float | None, str]:
        line, line_score, whole, whole_score = self.matcher.scan(text)
        terms = terms_of(text)
        if not terms:
            return None, None, "none"
        other, other_score = self.texts.best(terms, TEXT_COSINE)
        if other is not None and (whole is None or other_score > whole_score):
            whole, whole_score = other, other_score
        if whole is not None:
            return whole, whole_score, "file"
        tag = notices.tagged(text)
        if tag is not None:
            return self.canonical(tag), 1.0, "header"
        window, window_score = self.windows.best(terms, LINE_COSINE)
        if window is not None and (line is None or window_score > line_score + 1e-9):
            line, line_score = window, window_score
        return (line, line_score, "header") if line is not None else (None, None, "none")

    def canonical(self, name: str) -> str:
        """A known licence in its usual spelling, any other as written."""
        known = {n.lower(): n for n in [*self.matcher.names, *self.texts.names]}
        return known.get(name.lower(), name)


def term_frequencies(files: DataFrame, text_column: str, texts: Iterable[str]) -> tuple[int, dict[str, int]]:
    """Files in all, and how many hold each term of the texts."""
    vocabulary = {t for text in texts for t in terms_of(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(vocabulary.intersection(terms_of(text)))
        yield pa.RecordBatch.from_pydict({"term": pa.array(["", *seen], pa.string()),
                                          "n": pa.array([rows, *seen.values()], pa.int64())})

    # A row per term of the texts at most.
    found = files.select(F.col(text_column).alias("text")).mapInArrow(count, "term string, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in found}
    return counts.pop("", 0), counts


def ancestors(directory: str):
    """The directory and all above it, deepest last."""
    parts = F.split(F.col(directory), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text",
                  templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Per file ``doc_id, path, license, cosine, kind, license_dir``.

    ``kind`` is ``file`` (a licence file), ``header`` (a line of the file),
    ``inherited`` or ``none``; ``license_dir`` is the directory inherited from.
    """
    texts = notices.whole_texts()
    # Short texts stand above code, too.
    inside = notices.notices(templates) + [(n, t) for n, t in texts.items() if len(terms_of(t)) <= notices.EMBEDDED_TERMS]
    total, frequency = term_frequencies(files, text_column, [*texts.values(), *(t for _, t in inside)])
    scanner = Scanner(Matcher(templates, total, frequency), Windows(inside, total, frequency),
                      Texts(texts, total, frequency))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, kinds = zip(*[scanner.scan(t or "") for t in batch.column(2).to_pylist()]) \
                if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(kinds, pa.string())], names=["doc_id", "path", "license", "cosine", "kind"])

    rows = files.select(F.col(id_column).alias("doc_id"), F.col(path_column).alias("path"), F.col(text_column).alias("text"))
    scanned = rows.mapInArrow(scan, rows.drop("text").schema.add("license", "string").add("cosine", "double")
                              .add("kind", "string"))
    placed = scanned.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    # Narrow rows, but behind a scan of all texts: written once, read by the directories and by the result.
    placed = written(placed, "licenses")
    licensed = placed.where("kind = 'file' AND dir IS NOT NULL").groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("low"), "path", "license")).alias("best")) \
        .select(F.col("dir").alias("above"), F.col("best.license").alias("dir_license"))
    directories = placed.where("dir IS NOT NULL").select("dir").distinct()
    lines = directories.select("dir", F.explode(ancestors("dir")).alias("above"))
    nearest = lines.join(licensed, "above").groupBy("dir").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "dir_license")).alias("near")) \
        .select("dir", F.col("near.above").alias("near_dir"), F.col("near.dir_license").alias("near_license"))
    joined = placed.join(nearest, "dir", "left")
    inherits = (F.col("kind") == "none") & F.col("near_license").isNotNull()
    return joined.select(
        "doc_id", "path", F.when(inherits, F.col("near_license")).otherwise(F.col("license")).alias("license"), "cosine",
        F.when(inherits, "inherited").otherwise(F.col("kind")).alias("kind"),
        F.when(inherits, F.col("near_dir")).alias("license_dir"))
