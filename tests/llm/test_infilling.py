"""Operator 12 against plain Python, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from riskspark.llm import infilling as op
from tests.llm.helpers import clashing, empty, odd

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed="7", rate=100, spm=50):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


TEXTS = [(i, "".join(f"line {j} of {i} é日😀\n" * (j % 3) for j in range(i))) for i in range(40)] + [
    (100, None), (101, ""), (102, "\n"), (103, "\n\n\n"), (104, "has <P> inside\nand more"), (105, "no end"), (None, "one\ntwo\nthree"),
    (None, "one\ntwo\nthree"), (106, "<M>"), (107, "x" * 100_000 + "\n" + "y\n" * 50_000), (108, "a\r\nb\rc\n"), (109, "<P\n>\n<S")]


@pytest.mark.parametrize("piece", [1 << 14, 7])
def test_equals_plain_python(spark, piece):
    texts = TEXTS if piece > 7 else [t for t in TEXTS if len(t[1] or "") < 5000]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    out = op.digests(op.fim_pieces(docs, piece_bytes=piece))
    got = sorted((str(r["head"]["rest"]["doc_id"]), r["head"]["n"], r["head"]["form"], r["head"]["prefix_chars"] or 0,
                  r["head"]["middle_chars"] or 0, r["output_sha256"], r["restored_sha256"]) for r in out.collect())
    want = []
    for doc_id, text in texts:
        n, form, p, m, output = brute(doc_id, text)
        want.append((str(doc_id), n, form, p or 0, m or 0, sha(output), sha(text or "")))
    assert got == sorted(want)


def test_texts_and_restoration(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    rows = op.fim_texts(docs)
    rows = rows.withColumn("back", op.restore(rows["output"], rows["form"])).collect()
    got = sorted((str(r["rest"]["doc_id"]), r["output"], r["back"]) for r in rows)
    assert got == sorted((str(i), brute(i, t)[4], t or "") for i, t in TEXTS)


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = [r["form"] for r in op.fim_texts(docs, rate=40, spm=25, seed="z").collect()]
    assert sorted(forms) == sorted(brute(i, f"a{i}\nb\nc", "z", 40, 25)[1] for i in range(400))
    assert 0.3 < 1 - forms.count("plain") / 400 < 0.5


def test_odd_rows_repeats_and_empty(spark):
    out = op.fim_report(odd(spark))
    assert out.count() == odd(spark).count()
    assert {r["form"] for r in out.where("doc_id in (2, 3)").collect()} == {"plain"}
    assert out.where("doc_id = 1").distinct().count() == 1 and out.where("doc_id = 1").count() == 2
    assert op.fim_report(empty(spark)).count() == 0 and op.fim_texts(empty(spark)).count() == 0


def test_clashing_columns(spark):
    names = ("key", "part", "no", "position", "piece", "head", "form", "output", "rest")
    out = op.fim_texts(clashing(odd(spark), *names))
    assert out.select("rest.key", "rest.head", "rest.output").distinct().collect() == [("theirs",) * 3]


def test_one_shuffle(spark):
    """The pieces cross the network once; the restoration is a sort inside the partitions."""
    plan = op.digests(op.fim_pieces(odd(spark).coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(key", plan)) == 1
    assert len(re.findall(r"Sort \[key", plan)) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", max_size=12), max_size=6), st.integers(1, 9))
def test_pieces_cover_units(parts, size):
    raw = "".join(parts).encode()
    ends = op.unit_ends(np.frombuffer(raw, np.uint8))
    assert len(ends) == len(UNIT.findall(raw.decode()))
    cuts = list(op.piece_cuts(ends, 0, len(raw), size))
    assert b"".join(raw[a:b] for a, b in cuts) == raw and all(0 < b - a <= size for a, b in cuts)
    units = set(ends.tolist()) | {0}
    for a, b in cuts:                       # a piece that cuts a unit holds nothing else after its start
        assert b in units or not any(a < u < b for u in units)
