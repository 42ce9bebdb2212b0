import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskspark.llm import repeats
from riskspark.llm.repeats import RepeatParams, anchors, covered, remove_repeats, repeat_report
from riskspark.llm.suffix_array import longest_common, suffix_array
from riskspark.llm.textkernel import gram_hashes, prefix_hash, range_hash
from tests.llm.helpers import clashing, empty, odd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array(text) == order
    common = longest_common(text, order, [2] * len(text))
    for k in range(1, len(order)):
        a, b = text[order[k]:], text[order[k - 1]:]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == 2 * n


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            places[b[i:i + length]].append((d, i))
    gone = [bytearray(len(b)) for b in bodies]
    for held in places.values():
        if len(held) > 1:
            for d, i in held:
                gone[d][i:i + length] = b"\1" * length
    out = []
    for b, g in zip(bodies, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet,group", [("abcdefgé ", 512), ("ab", 512), ("abcdefgé ", 4), ("ab", 4)])
def test_against_all_windows(spark, alphabet, group):
    """Both ways: small groups by suffix arrays, larger ones split first."""
    r = random.Random(7)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(10, 120))) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(1, 7)):
            b = r.choice(base)
            i = r.randrange(len(b))
            parts.append(b[i:r.randrange(i, len(b) + 1)] + "".join(r.choice("xyz") for _ in range(r.randrange(0, 9))))
        texts.append("".join(parts))
    texts += [None, "", "x" * 23, "x" * 24, "y" * 60, texts[0], texts[1], texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    p = RepeatParams(length=24, gram=6, group=group, parts=(7, 3, 1))
    got = {x.row.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df, p=p).collect()}
    assert got == dict(enumerate(brute(texts, 24)))


def test_production_length(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij klm") for _ in range(n))
    passage = text(700)
    texts = [text(900) + passage + text(300), text(50) + passage[100:] + text(500), passage[:399], passage[:400], text(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeat_report(df).collect()}
    assert got == dict(enumerate(brute(texts, 400)))


def test_odd_rows(spark):
    rows = repeat_report(odd(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].n_removed == by[5].n_bytes == 15000 and by[5].n_spans == 1     # repeats inside itself
    assert repeat_report(empty(spark)).count() == 0
    extra = remove_repeats(clashing(odd(spark), "node", "body", "ranges", "n_bytes", "row"))
    assert {r.row["n_bytes"] for r in extra.collect()} == {"theirs"}


def test_anchors_against_every_window():
    r = np.random.default_rng(3)
    for _ in range(200):
        off = np.concatenate(([0], np.cumsum(r.integers(0, 60, r.integers(1, 6)))))
        data = r.integers(97, 97 + r.integers(1, 9), off[-1]).astype(np.uint8)
        length = int(r.integers(3, 30))
        p = RepeatParams(length=length, gram=int(r.integers(1, length + 1)))
        want = {}
        if len(data) >= p.gram:
            at = np.arange(len(data) - p.gram + 1)
            hashes = gram_hashes(data, p.gram)
            assert (hashes == range_hash(prefix_hash(data), at, at + p.gram)).all()
            for t, (a, b) in enumerate(zip(off, off[1:])):
                for i in range(a, b - length + 1):
                    k = min(range(i, i + p.reach + 1), key=lambda j: (hashes[j] >> np.uint64(28), j))
                    want[k] = (t, k, hashes[k])
        assert list(zip(*anchors(data, off, p))) == [want[k] for k in sorted(want)]


def test_contexts_are_cut_on_their_own_way_only(monkeypatch):
    """A pair that parts from the rest at once gets no cut where other pairs part."""
    r = random.Random(2)
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    gram, contexts, want = noise(100), [], []
    for k in range(40):
        before, behind = noise(200 + k), noise(150 + 2 * k)
        for side in (b"\0", b"\1"):
            body = noise(30) + side + before + gram + behind + side + noise(30)
            contexts.append((231 + k, body, noise(16), 0))
            want.append([(31, 31 + 450 + 3 * k)])
    symbols = []
    monkeypatch.setattr(repeats, "suffix_array", lambda text: symbols.append(len(text)) or suffix_array(text))
    assert covered(contexts, 400) == want
    assert sum(symbols) < 12 * len(contexts)


def test_small_groups_are_dealt_out_without_large_ones(spark):
    rows = spark.createDataFrame([("large", 1, i) for i in range(9)] + [("small", 1, i) for i in range(3)]
                                 + [("one", 1, 0), *(("copies", 2, i) for i in range(2))], "name string, n long, place long")
    rows = rows.selectExpr("cast(name as binary) as core", "n", "cast('t' as binary) as node", "place", "0 as left", "core as body")
    sized = repeats._sized(rows)
    assert {(bytes(x.core).decode(), x.members) for x in sized.collect()} == {("large", 9), ("small", 3)}
    small, large = repeats._groups(sized, 4)
    assert [sorted(m.place for m in x.members) for x in small.collect()] == [[0, 1, 2]]
    assert large.count() == 9
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
