import random

import numpy as np
import pyarrow as pa
import pytest

from riskspark.llm import near_duplicates as near
from riskspark.llm.bagminhash import overlap, signatures, text_shingles
from riskspark.llm.common import text_blocks
from riskspark.llm.components import components
from tests.llm.helpers import clashing, empty, odd


def multiset(text, k=5):
    words = (text or "").split()
    runs = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    out = {}
    for x in runs:
        out[x] = out.get(x, 0) + 1
    return out


def similarity(a, b):
    both = sum(min(n, b.get(x, 0)) for x, n in a.items())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def brute_classes(docs):
    sets = [multiset(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = (docs[i][1] or "") == (docs[j][1] or "")
            if same or 100 * similarity(sets[i], sets[j]) >= 80 - 1e-9:
                up[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(top(i), []).append(d)
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


def corpus(seed, n_base=12, n=140):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 5)))
    base = [[word() for _ in range(r.randrange(3, 90))] for _ in range(n_base)]
    base.append(["again"] * 60 + [word() for _ in range(20)])
    docs = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            k = r.randrange(len(words))
            words[k:k + r.randrange(0, 2)] = [word()]
        docs.append((i, " ".join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, docs[0][1]), (n + 3, "one two")]


def block(texts):
    (_, _, data, off), = text_blocks(pa.array(texts), 1 << 40)
    return data, off


def test_signatures_estimate_weighted_similarity():
    r = random.Random(1)
    errors = []
    for trial in range(60):
        a = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(60)] + ["w"] * (40 * (trial % 2))
        b = list(a)
        for _ in range(r.randrange(0, 8)):
            b[r.randrange(60)] = "z"
        if trial % 2:
            b += ["w"] * r.randrange(0, 60)
        rows = text_shingles(*block([" ".join(a), " ".join(b)]), 5)
        s = signatures(*rows, 2, 300)
        errors.append((s[0] == s[1]).mean() - similarity(multiset(" ".join(a)), multiset(" ".join(b))))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_overlap_is_exact():
    docs = [t or "" for _, t in corpus(3)]
    for i in range(0, 100, 2):
        a, b = (text_shingles(*block([t]), 5) for t in docs[i:i + 2])
        both, either = overlap(a, b, 1)
        want = similarity(multiset(docs[i]), multiset(docs[i + 1]))
        assert (both[0] / either[0] if either[0] else 0.0) == pytest.approx(want)


def test_similar_pairs_are_all_pairs():
    docs = [t or "" for _, t in corpus(5)]
    a, b = near.similar_pairs(block(docs), near.NearParams())
    sets = [multiset(t) for t in docs]
    want = {(i, j) for j in range(len(docs)) for i in range(j) if 100 * similarity(sets[i], sets[j]) >= 80 - 1e-9}
    assert set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("seed,p", [(1, near.NearParams()), (2, near.NearParams(pairs_up_to=2, chunk=5))])
def test_classes_against_all_pairs(spark, seed, p):
    """With buckets compared by pairs, and by blocks."""
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = near.classes(df, p=p).collect()
    want = brute_classes(docs)
    assert {r.row.doc_id: r.class_id for r in rows} == {d: c for d, (c, _) in want.items()}
    if seed == 1:
        assert {(r.doc_id, r.class_id, r.n_in_class) for r in near.near_report(df).collect()} == \
            {(d, c, n) for d, (c, n) in want.items()}
        assert {r.doc_id for r in near.keep_one(df).collect()} == {c for c, _ in want.values()}


def test_blocks_of_long_texts_are_bounded_by_bytes(spark):
    """A bucket of 60 texts of 10 kB: far below 1,000 rows, but no task takes more than a few chunks' bytes."""
    from pyspark.sql import functions as F
    p = near.NearParams(pairs_up_to=2, chunk_bytes=50_000)
    rows = [(i, f"{i:05}" * 2000) for i in range(60)]
    bodies = spark.createDataFrame(rows, "n int, text string").select(near.text_node(F.col("text")).alias("node"), "text")
    large = bodies.select(F.lit(1).cast("long").alias("band"), "node", F.lit(60).cast("long").alias("size"), F.col("node").alias("root"))
    units = near._units(large, bodies, p)
    held = units.groupBy("band", "i", "j").agg(F.sum(F.octet_length("text")).alias("bytes"), F.collect_list("node").alias("nodes")).collect()
    assert max(r.bytes for r in held) <= 5 * p.chunk_bytes < 60 * 10_000
    met = {(bytes(a), bytes(b)) for r in held for a in r.nodes for b in r.nodes if a < b}
    assert len(met) == 60 * 59 // 2                       # every two of them meet


def test_components(spark):
    links = [("a", "b"), ("c", "b"), ("d", "e"), *((f"n{i:02}", f"n{i + 1:02}") for i in range(30)), ("x", "x")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in links], "a binary, b binary")
    got = {bytes(r.node).decode(): bytes(r.root).decode() for r in components(df).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("de", "d"), **{f"n{i:02}": "n00" for i in range(31)}}


def test_classes_by_blocks_of_few_bytes(spark):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = near.classes(df, p=near.NearParams(pairs_up_to=2, chunk_bytes=2000)).collect()
    assert {r.row.doc_id: r.class_id for r in rows} == {d: c for d, (c, _) in brute_classes(docs).items()}


def test_odd_rows(spark):
    rows = near.near_report(odd(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].class_id == 1 and by[6].n_in_class == 3
    assert by[2].class_id == by[3].class_id == 2
    kept = near.keep_one(clashing(odd(spark), "node", "root", "place", "id", "o"))
    assert kept.count() == 6 and kept.where("root = 'theirs'").count() == 6
    assert near.near_report(empty(spark)).count() == 0 and near.keep_one(empty(spark)).count() == 0
