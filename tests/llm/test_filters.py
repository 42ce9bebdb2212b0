"""Operators 2, 6, 8: licence scan, quality rules, line chunks."""

import os
import re
import textwrap

import duckdb
import pytest

from riskspark.llm import licence_digests, licence_texts, licences, line_chunks, line_rules
from tests.llm.helpers import clashing, empty, odd


def test_licences_in_many_spellings(spark):
    mit = licence_texts.MIT
    rows = [
        (1, "Copyright (c) 2020 Some Body\n\n" + mit, "MIT"),
        (2, mit.upper(), "MIT"),
        (3, "The MIT License (MIT)\n\nCopyright © 1999-2020 A, B\nAll rights reserved.\n\n" + mit.replace('"', "'"), "MIT"),
        (4, licence_texts.ZLIB.replace("acknowledgment", "acknowledgement").replace("\n", "\r\n"), "Zlib"),
        (5, mit.replace("sublicense", "sub-license"), "MIT"),
        (6, mit + " And more.", None),
        (7, "No licence at all.", None),
        (8, None, None),
        (9, "Copyright 2020 X", None),
        (10, licence_texts.BSD_3, "BSD-3-Clause"),
        (11, licence_texts.BSD_2, "BSD-2-Clause"),
        (12, " Released under the MIT   license ", "MIT"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.licence_report(df).collect()} == {i: want for i, _, want in rows}


def wrapped(text, width):
    return "\n".join("\n".join(textwrap.wrap(x, width, break_long_words=False)) for x in text.split("\n"))


def test_hard_wrapped_licences_keep_their_lines(spark):
    texts = {k: v for k, v in licence_texts.KNOWN.items()}
    texts["BSD-3-Clause#short"] = licence_texts.BSD_3.replace("\n\n", "\n")
    rows = [(f"{k}|{w}", wrapped(v, w)) for k, v in texts.items() for w in range(50, 101)]
    rows += [(f"{k}|*", "\n".join(f" * {x}" for x in wrapped(v, 64).split("\n"))) for k, v in texts.items() if "#line" not in k]
    assert any(x.lower().startswith("copyright notice") for _, t in rows for x in t.split("\n"))
    found = licences.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r.name for r in found if r.license_id != r.name.split("|")[0].split("#")[0]] == []


def refilled(text, width):
    """Paragraphs filled anew; those with a copyright statement stay as they are."""
    return "\n\n".join(x if re.search(r"(?im)copyright \(c\)|^\W*copyright .*yyyy", x) else textwrap.fill(x, width, break_long_words=False)
                       for x in text.split("\n\n"))


def test_whole_licences(spark):
    if not os.path.isdir("/usr/share/common-licenses"):
        pytest.skip("the texts are not on this machine")
    rows = []
    for name, (license_id, _, _) in licence_digests.SOURCES.items():
        with open(f"/usr/share/common-licenses/{name}") as f:
            text = f.read()
        rows += [(license_id, x) for x in (text, text.upper(), text.replace("\n", "\r\n"), "Copyright 2020 X\n\n" + text, *licence_digests.forms(name, text))]
        rows += [(license_id, refilled(text, w)) for w in range(50, 101)]
        rows += [(None, text + "\nAnd more."), (None, text[:len(text) // 2])]
    assert {x for x, _ in rows if x} == set(licence_digests.WHOLE)
    found = licences.scan(spark.createDataFrame(rows, "want string, text string").repartition(8)).collect()
    assert len(found) == len(rows) and [(r.want, r.license_id, r.text[:300]) for r in found if r.license_id != r.want] == []


STATEMENTS = ["Copyright 2020 X", "Copyright (c) 2020, X", "COPYRIGHT (C) The Regents", "Copyright © X", "(c) Jane Doe", "© 2020", " * (C) 1999 X",
              "Copyright by Jane Doe", "Copyright Jane Doe", "Copyright The Authors. All rights reserved.", "Copyright [yyyy] [name of copyright owner]",
              "Copyright: Jane Doe", "Copyright holder: Jane Doe", "All rights reserved.", "Copyright Émile", "# Copyright, 2001 X", "Copyright 日本"]
RUNNING_TEXT = ["copyright notice, this list of conditions", "COPYRIGHT HOLDERS BE LIABLE", " * copyright owner or contributors", "copyright", "copyright,",
                "copyright, patent, trademark", "copyright law. 2", "“Copyright” also means", "(c) You must retain", "(c) under Patent Claims", "copyrighted 2020 works"]


def test_only_statements_are_copyright_lines(spark):
    df = spark.createDataFrame([(x,) for x in STATEMENTS + RUNNING_TEXT], "text string")
    form = licences.canonical(df.text)
    assert {r.text for r in df.select("text", form.alias("f")).where("f = ''").collect()} == set(STATEMENTS)


def test_licence_scan_of_odd_rows(spark):
    assert licences.licence_report(odd(spark)).count() == 10
    assert licences.licence_report(empty(spark)).count() == 0
    docs = clashing(odd(spark), "license_id", "digest", "__digest", "k", "h")
    out = licences.scan(docs)
    assert out.where("digest = 'theirs' AND __digest = 'theirs'").count() == 10
    assert set(out.columns) == {*docs.columns, "canonical_digest"}


def test_licence_sql_has_the_same_rule_and_the_whole_licences(spark):
    texts = [wrapped(v, w) for v in licence_texts.KNOWN.values() for w in (56, 64, 72, 88)]
    texts += [f"{line}\nsome words\n{line}" for line in STATEMENTS + RUNNING_TEXT]
    texts += ["copyright notices: x\ny", "copyright notice : x\ny", "copyright the\ny", "(c) the\ny", "x (c) you\n© and\ny", ""]
    if os.path.isdir("/usr/share/common-licenses"):
        for name in licence_digests.SOURCES:
            with open(f"/usr/share/common-licenses/{name}") as f:
                texts.append(f.read())
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(licences.oracle_sql()).fetchall()
    got = [tuple(r) for r in licences.licence_report(df).select("doc_id", "canonical_digest", "license_id").collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_known_texts_have_their_own_digests(spark):
    found = {r.license_id for r in licences.known_digests(spark).collect()}
    assert found == {k.split("#")[0] for k in licence_texts.KNOWN}


def test_line_rules():
    rules = line_rules.LineRules()
    good = "A line of a dozen words or so that comes to a proper end."
    assert not rules.fails(good, 13)
    assert not rules.fails("A heading", 2)
    assert rules.fails("a line of a dozen words or so that never comes to an end", 13)
    assert rules.fails("Home | News | Sport | Contact.", 7)
    assert rules.fails("All rights reserved.", 3)
    assert rules.fails("BUY!! THIS!! NOW!! AND!! HERE!!", 5)
    assert line_rules.clean_lines(f"{good}\nHome | News | Sport | More\n\n{good}", rules) == (f"{good}\n\n{good}", 28, 1, 1)


def test_quality_rules_of_odd_rows(spark):
    rows = line_rules.quality_report(odd(spark)).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert by[5].n_words == 3000 and by[5].n_repeat_words == 3000
    assert line_rules.quality_report(empty(spark)).count() == 0
    assert line_rules.line_first(clashing(odd(spark), "kept", "n_words")).where("n_words >= 0").count() == 10


def test_repeated_words():
    import numpy as np
    text = ("a b c d e f g h i j " * 2 + "x y z").encode()
    n, rep = line_rules.repeated_words(np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]))
    assert n.tolist() == [23, 0] and rep.tolist() == [20, 0]


def _ranges(lines):
    return {(lo, hi) for d in line_chunks.DIVISORS for lo, hi in line_chunks.chunk_bounds(lines, d) if line_chunks._worth(lines, lo, hi, 2)}


def brute_chunks(docs):
    """Chunks of both levels in order of id (NULL last) and place; what has been seen before goes, line by line."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = (t or "").encode().split(b"\n")
        gone = set()
        for lo, hi in sorted(_ranges(lines)):
            body = b"\n".join(lines[lo:hi])
            if body in seen:
                gone |= set(range(lo, hi))
            seen.add(body)
        out[i] = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
    return out


def test_line_chunks_against_brute_force(spark):
    import random
    r = random.Random(2)
    lines = [f"line {k} of the corpus." for k in range(40)] + ["", " "]
    docs = [(i, "\n".join(r.choice(lines) if r.random() < .3 else lines[(i % 5 + k) % 40] for k in range(r.randrange(0, 25))))
            for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {x.row.doc_id: x.clean_text for x in line_chunks.dedup_line_chunks(df).collect()}
    want = brute_chunks(docs)
    assert got == want
    assert sum(map(len, want.values())) < sum(len(t) for _, t in docs)


def brute_windows(docs):
    """Chunks and pairs of worded lines in order of id and place; what has been seen goes, line by line."""
    seen, out = set(), {}
    for i, t in docs:
        lines = t.encode().split(b"\n")
        worded = [k for k, x in enumerate(lines) if x.strip()]
        spans = _ranges(lines)
        gone = set()
        for lo, hi in sorted(spans | {(a, b + 1) for a, b in zip(worded, worded[1:])}):
            body = b"\n".join(lines[lo:hi])
            if body in seen:
                gone |= set(range(lo, hi))
            seen.add(body)
        out[i] = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
    return out


def test_line_windows_against_brute_force(spark):
    import random
    r = random.Random(3)
    lines = [f"line {k} of the corpus." for k in range(40)] + ["", " "]
    docs = [(i, "\n".join(r.choice(lines) if r.random() < .5 else lines[(i % 5 + k) % 40] for k in range(r.randrange(0, 25))))
            for i in range(120)]
    df = spark.createDataFrame([*docs, *docs[:5]], "doc_id long, text string").repartition(5)
    got = {x.row.doc_id: x.clean_text for x in line_chunks.dedup_line_chunks(df, windows=True).collect()}
    assert got == brute_windows(docs)
    assert {x for t in got.values() for x in t.split("\n") if x.strip()} == {x for _, t in docs for x in t.split("\n") if x.strip()}


def _planted_passages():
    """Passages of 2 to 8 lines and over 50 words between foreign lines, each in two documents."""
    import random
    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(26))
    docs, planted = [], []
    for n in range(2, 9):
        for _ in range(12):
            passage = [line() for _ in range(n)]
            own = [[line() for _ in range(r.randrange(1, 6))] for _ in range(4)]
            planted.append((len(docs) + 1, passage, own[2] + own[3]))
            docs += [(len(docs), "\n".join(own[0] + passage + own[1])), (len(docs) + 1, "\n".join(own[2] + passage + own[3]))]
    return docs, planted


def test_two_levels_find_more_of_short_passages(spark):
    docs, planted = _planted_passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    left = {}
    for levels in ((4,), (4, 2)):
        got = {x.row.doc_id: x.clean_text.split("\n") for x in line_chunks.dedup_line_chunks(df, divisors=levels).collect()}
        left[levels] = sum(x in got[i] for i, passage, _ in planted for x in passage)
        assert all(set(own) <= set(got[i]) and got[i - 1] == docs[i - 1][1].split("\n") for i, _, own in planted)
    assert left[(4, 2)] < 0.85 * left[(4,)] < left[(4,)] < sum(len(p) for _, p, _ in planted) == 420


def test_line_windows_find_short_passages(spark):
    """The first copy stays, nothing of the second."""
    docs, planted = _planted_passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {x.row.doc_id: x.clean_text.split("\n") for x in line_chunks.dedup_line_chunks(df, windows=True).collect()}
    assert sum(x in got[i] for i, passage, _ in planted for x in passage) == 0
    assert all(got[i] == own and got[i - 1] == docs[i - 1][1].split("\n") for i, _, own in planted)


def test_boundaries_resist_shifts():
    lines = [f"number {k}".encode() for k in range(60)]
    longer = [b"new", *lines]
    ends = {lines[hi - 1] for _, hi in line_chunks.chunk_bounds(lines)}
    moved = {longer[hi - 1] for _, hi in line_chunks.chunk_bounds(longer)}
    assert len(ends) > 5 and ends <= moved <= ends | {lines[0]}


def test_line_chunks_of_odd_rows(spark):
    rows = line_chunks.dedup_line_chunks(odd(spark)).collect()
    assert len(rows) == 10
    assert [r.clean_text for r in rows if r.row.doc_id == 2] == [None]
    assert len({r.clean_text for r in rows if r.row.doc_id == 1}) == 1      # equal rows are treated alike
    assert line_chunks.chunk_report(empty(spark)).count() == 0
    assert line_chunks.dedup_line_chunks(clashing(odd(spark), "key", "digest", "places", "n_chunks")).count() == 10
