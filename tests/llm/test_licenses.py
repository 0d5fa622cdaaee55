"""Licence scans against plain Python: cosines by hand, inheritance by walking up."""

import math
from collections import Counter

import pytest

from jobtrail.llm import licenses, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame


def cosine(terms, template, files, frequency):
    vocabulary = {t for text in licenses.TEMPLATES.values() for t in licenses.terms_of(text)}

    def weights(counts):
        return {t: n * (math.log((1 + files) / (1 + (frequency.get(t, 0) if t in vocabulary else 1))) + 1)
                for t, n in counts.items()}
    a, b = weights(Counter(terms)), weights(Counter(licenses.terms_of(template)))
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if dot else 0.0


def expected(rows):
    frequency = Counter(t for _, _, text in rows for t in set(licenses.terms_of(text or "")))

    def best(terms, least):
        top = max(((round(cosine(terms, text, len(rows), frequency), 12), name) for name, text in licenses.TEMPLATES.items()),
                  key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        return (top[1], top[0]) if top[0] >= least else (None, None)

    found = []
    for doc_id, path, text in rows:
        whole = best(licenses.terms_of(text or ""), licenses.FILE_COSINE)
        lines = [best(licenses.terms_of(line), licenses.LINE_COSINE) for line in (text or "").split("\n")]
        lines = sorted((x for x in lines if x[0]), key=lambda x: (-x[1], x[0]))
        kind = "file" if whole[0] else "header" if lines else "none"
        found.append((doc_id, path, *(whole if whole[0] else lines[0] if lines else (None, None)), kind))
    of_dir = {}
    for doc_id, path, name, score, kind in sorted(found, key=lambda r: (-(r[3] or 0), r[1] or "")):
        if kind == "file" and path and "/" in path:
            of_dir.setdefault(path.rsplit("/", 1)[0], name)
    out = []
    for doc_id, path, name, score, kind in found:
        at = path.rsplit("/", 1)[0] if path and "/" in path else None
        while kind == "none" and at is not None and at not in of_dir:
            at = at.rsplit("/", 1)[0] if "/" in at else None
        if kind == "none" and at is not None:
            out.append((doc_id, path, of_dir[at], None, "inherited", at))
        else:
            out.append((doc_id, path, name, score, kind, None))
    return out


def same(found, rows):
    order = lambda r: (str(r[0]), str(r[1]), str(r[2]), str(r[4]))
    found, want = sorted(map(tuple, found), key=order), sorted(expected(rows), key=order)
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in want]
    assert all(a[3] == pytest.approx(b[3], abs=1e-9) for a, b in zip(found, want) if b[3] is not None)


def test_query(spark):
    docs = queries.table(spark, SMALL, "documents").collect()
    rows = [(d.doc_id, f"{d.source}/{d.doc_id // 10_000}/{d.doc_id // 100 % 100}/{d.doc_id}", d.text) for d in docs]
    found = queries.op6_licenses(spark, SMALL).collect()
    same(found, rows)
    noticed = {r.doc_id for r in found if r.kind in ("file", "header")}
    assert noticed == {d.doc_id for d in docs if any(t in d.text for t in licenses.TEMPLATES.values())}


def test_nearest_ancestor(spark):
    prose = "no notice in here at all"
    rows = [(1, "a/LICENSE", licenses.TEMPLATES["MIT"]), (2, "a/b/c/x", prose), (3, "a/b/LICENSE", licenses.TEMPLATES["GPL-3.0"]),
            (4, "a/b/c/d/e", prose), (5, "a/y", prose), (6, "ab/y", prose), (7, "top", prose), (8, None, prose),
            (9, "a/b/own", f"{prose}\n# {licenses.TEMPLATES['BSD-3-Clause']}\n{prose} and more of it, many words of it"),
            (10, "a/b/COPYING", licenses.TEMPLATES["GPL-2.0"]), (11, "a/b/c/x", prose), (12, "a/b/empty", None)]
    df = spark.createDataFrame([(*r, "dir") for r in rows], "doc_id long, path string, text string, dir string")
    found = licenses.scan_licenses(df).collect()
    same(found, rows)
    near = {r.doc_id: (r.license, r.license_dir) for r in found}
    assert near[4][1] == "a/b" and near[5] == ("MIT", "a") and near[6] == near[7] == near[8] == (None, None)
    assert near[9] == ("BSD-3-Clause", None)


def test_odd_rows(spark):
    df = odd_frame(spark).selectExpr("*", "concat('d/', source, '/', doc_id) AS path")
    same(licenses.scan_licenses(df).collect(), [(r.doc_id, r.path, r.text) for r in df.collect()])
    assert licenses.scan_licenses(empty_frame(spark).selectExpr("*", "rank AS path")).count() == 0


def test_notices_that_are_no_templates(spark):
    """Whole texts, headers over several lines, tags and other wordings, among files without any."""
    from jobtrail.llm import notices

    rows = [(100 + i, f"p/{i}", f"some words of prose number {i} that say nothing of note") for i in range(300)]
    texts = notices.whole_texts()
    want = {}

    def add(name, kind, text, path):
        want[len(rows)] = (name, kind)
        rows.append((len(rows), path, text))

    for name, text in texts.items():
        add(name, "file", f"Copyright 2020 Foo Bar\n{text}", f"whole-{name}/LICENSE")
        want[len(rows)] = (name, "inherited")
        rows.append((len(rows), f"whole-{name}/src/a", "nothing of note in here"))
    add("AGPL-3.0", "file", texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC"), "agpl/COPYING")
    add("CC-BY-4.0", "file", texts["CC-BY-SA-4.0"].replace("Attribution-ShareAlike", "Attribution"), "cc/COPYING")
    code = "\n".join(f"value{i} = compute{i}(argument{i})" for i in range(200))
    cut = lambda text: "\n".join(f"// {' '.join(text.split()[i:i + 7])}" for i in range(0, len(text.split()), 7))
    add("Apache-2.0", "header", f"{cut(notices.APACHE)}\n{code}", "h/a")
    add("MPL-2.0", "header", f"{cut(notices.MPL)}\n{code}", "h/b")
    for key, (name, version) in notices.GNU_NAMES.items():
        add(key, "header", f"{cut(notices.GNU.format(thing='program', name=name, version=version))}\n{code}", f"h/{key}")
    add("MIT", "header", f"{cut(texts['MIT'])}\n{code}", "h/mit")
    for tag, name in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("(mit OR Zlib)", "MIT"),
                      ("Zlib", "Zlib")):
        add(name, "header", f"{code}\n# SPDX-License-Identifier: {tag}\n{code}", f"t/{tag.strip('()')}")
    add("MIT", "header", f"{code}\nCopyright 2020 Foo Bar. Released under the MIT License. All else is his.\n{code}", "w/a")
    add("MIT", "header", f"{code}\nThis file is distributed\nunder the MIT license, see there\n{code}", "w/b")
    add("LGPL-2.1", "header", f"{code}\nIt is under the terms of the GNU Lesser General\nPublic License, version 2.1.\n{code}", "w/c")
    df = spark.createDataFrame([(i, path, text) for i, (_, path, text) in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.doc_id: (r.license, r.kind) for r in licenses.scan_licenses(df).collect()}
    assert {i: found[i] for i in want} == want
    assert all(found[i] == (None, "none") for i in range(300))


def test_a_near_wording_is_no_notice(spark):
    rows = [(i, None, f"words of prose {i} that are of no account here") for i in range(300)]
    rows += [(300, None, "It was released under the old bridge, licensed under the county, version 2 or 3.")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.kind for r in licenses.scan_licenses(df).collect() if r.doc_id == 300} == {"none"}
