"""The pipeline against a plain Python version, stage by stage and as a whole."""

import hashlib
import math
from fractions import Fraction

import pytest

import corpus_pipeline as cp
from riskspark.llm import line_rules, pieces
from riskspark.llm.common import table
from tests.conftest import SF0001
from tests.llm.helpers import empty, odd
from tests.llm.test_filters import brute_chunks
from tests.llm.test_mixing import fair_targets
from tests.llm.test_near_duplicates import brute_classes
from tests.llm.test_pieces import plain_viterbi


def words(text):
    return (text or "").encode().split()


def passes(text):
    """Base test and line-first verdict, from their definitions."""
    w = words(text)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)} if len(set(runs)) < len(runs) else ()
    if len(w) < 20 or 100 * len(twice) > 30 * len(w):
        return None
    rules = line_rules.LineRules()
    lines = text.split("\n")
    kept = [x for x in lines if not words(x) or not rules.fails(x, len(words(x)))]
    left = sum(len(words(x)) for x in kept)
    return "\n".join(kept) if 2 * left >= len(w) else None


def mixed(rows):
    """Systematic sampling within each source, in order of size class and hash."""
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets, out = fair_targets(sizes), []
    for s in sizes:
        u = (int(hashlib.md5(f"mix-1|s{s}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32
        rate = float(Fraction(targets[s], 1) / sizes[s]) if sizes[s] else 0.0
        mine = sorted((r for r in rows if r[3] == s),
                      key=lambda r: (math.isqrt(len(words(r[1]))), hashlib.md5(str(r[0]).encode()).hexdigest()))
        for i, r in enumerate(mine):
            out += [r] * (math.floor(u + (i + 1) * rate) - math.floor(u + i * rate))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of what the one before left."""
    docs, out = table(spark, SF0001, "documents"), []
    for name, stage in cp.STAGES:
        rows = stage(spark, docs, SF0001).collect()
        docs = spark.createDataFrame(rows, schema=stage(spark, docs, SF0001).schema) if not out or name != "sentencepiece" else docs
        out.append([tuple(r) for r in rows])
    return out


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near dedup", "mix sources", "sentencepiece"]


def test_against_plain_python(spark, stages):
    rows = [tuple(r) for r in table(spark, SF0001, "documents").select(*cp.COLUMNS).collect()]
    key = lambda r: (r[0], r[1] or "")
    want = [(i, c, lang, s, len(c)) for i, t, lang, s, _ in rows if (c := passes(t or "")) is not None]
    assert sorted(stages[0], key=key) == sorted(want, key=key) and 0 < len(want) < len(rows)

    left = brute_chunks([(r[0], r[1]) for r in want])
    want = [(i, left[i], lang, s, len(left[i])) for i, _, lang, s, _ in want]
    assert sorted(stages[1], key=key) == sorted(want, key=key)

    classes = brute_classes([(r[0], r[1]) for r in want])
    want = [r for r in want if classes[r[0]][0] == r[0]]
    assert sorted(stages[2], key=key) == sorted(want, key=key)

    want = mixed(want)
    assert sorted(stages[3], key=key) == sorted(want, key=key)

    vocabulary = pieces.read_pieces(pieces.DEFAULT_MODEL)
    codec = pieces.Codec(vocabulary)
    assert len(stages[4]) == len(want)
    for r in stages[4]:
        ids, n, same = r[5:]
        assert same and n == len(ids) and codec.decode(ids) == r[1]
        if len(r[1]) < 3000 and pieces.MARK not in r[1]:
            assert ids == plain_viterbi(r[1], vocabulary, codec.automaton.byte_score, codec.automaton.byte_id)


def test_run_is_its_stages(spark, stages):
    got = cp.run(spark, SF0001)
    assert sorted((r.doc_id, r.text, r.n_tokens) for r in got.collect()) == sorted((r[0], r[1], r[6]) for r in stages[-1])


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF0001)
            if name != "sentencepiece":
                assert out.columns == list(cp.COLUMNS)
            out.collect()
