"""Operator 11 against a brute-force search of every window."""

import hashlib
import random
import re

import pytest

from riskspark.llm import decontamination as op
from riskspark.llm.registry import QUERIES
from tests.conftest import SF0001
from tests.llm.helpers import clashing, empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """doc -> (n_words, n_hit, sorted ids)."""
    held = {}
    for item, text in items:
        w = _words(text)
        span = min(10, len(w))
        for i in range(len(w) - span + 1 if w else 0):
            held.setdefault(tuple(w[i:i + span]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in held}
    out = []
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for span in lengths:
            for i in range(len(w) - span + 1):
                ids = held.get(tuple(w[i:i + span]))
                if ids:
                    hit.update(range(i, i + span))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, ITEMS)
    rows = op.decontaminate(d, b, **options).select("row.doc_id", "n_words", "n_hit", "items").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])
    assert sorted((tuple(r) for r in rows), key=key) == sorted(brute(docs, items), key=key)


def planted(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "delta", "ÉTÉ", "zeta", "eta", "x1", "日本"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 12, 10, 9, 7, 5, 3, 2, 40, 0])] + [(None, text(11)), (2, text(15)), (90, None)]
    docs = []
    for k in range(60):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(w) - 10))
            parts += [rnd.choice(["; ", "\n", " - "]).join(w[a:a + rnd.randint(8, 16)]).upper(), text(rnd.randint(0, 9))]
        docs.append((k, " ".join(parts)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (None, None), (70, ""), (71, " \n"), (72, docs[3][1] * 40)], items


@pytest.mark.parametrize("few", [10 ** 6, 0])
def test_equals_brute_force_both_ways(spark, few):
    docs, items = planted()
    check(spark, docs, items, broadcast_windows=few)


def test_only_short_items(spark):
    check(spark, [(1, "a b c d"), (2, "A, b!"), (3, "b a"), (4, None)], [(7, "a b"), (8, "c"), (9, "")])


def test_every_long_shared_span_is_found(spark):
    rnd = random.Random(1)
    w = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(60)]
    docs = [(a, " ".join(["foreign"] * 7 + w[a:a + 10] + ["other"] * 7)) for a in range(51)]
    rows = op.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame([(1, " ".join(w))], ITEMS)).collect()
    assert [r["n_hit"] for r in rows] == [10] * 51 and all([p["at"] for p in r["places"]] == [7] for r in rows)
    nine = [(a, " ".join(["foreign"] * 7 + w[a:a + 9] + ["other"] * 7)) for a in range(51)]
    assert not op.decontaminate(spark.createDataFrame(nine, "doc_id long, text string"),
                                spark.createDataFrame([(1, " ".join(w))], ITEMS)).where("n_hit > 0").count()


def test_many_copies_and_items_with_one_passage(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, passage + " end") for i in range(300)] + [(400 + i, f"lone text {i}") for i in range(30)]
    check(spark, docs, [(i, f"{passage} of item {i}") for i in range(40)])


def test_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "One two three. Four five six seven eight. Nine ten"), (2, "😀 日本語 ñandú")], ITEMS)
    out = op.decontamination_report(odd(spark), items)
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in out.collect()}
    assert {(1, 13, 10, 1), (6, 13, 10, 1), (7, 5, 3, 1), (2, 0, 0, 0), (3, 0, 0, 0), (5, 3000, 0, 0)} <= got
    assert out.count() == odd(spark).count()
    assert op.decontamination_report(empty(spark), items).count() == 0
    none = op.decontamination_report(odd(spark), spark.createDataFrame([], ITEMS)).collect()
    assert all(not r["contaminated"] and r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in none)
    assert len(none) == odd(spark).count()


def test_clashing_columns(spark):
    names = ("key", "tokens", "prints", "places", "items", "n_words", "row", "span", "f")
    out = op.decontaminate(clashing(odd(spark), *names), spark.createDataFrame([(1, "word word")], ITEMS))
    assert out.select("row.key", "row.places", "row.items").distinct().collect() == [("theirs",) * 3]
    assert out.where("n_hit = 3000").count() == 1


def test_plan_is_native(spark):
    df = QUERIES["op11_decontamination"](spark, SF0001)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    b = spark.createDataFrame([(1, "a b c d e f g h i j k")], ITEMS)
    windows, _ = op.benchmark_windows(b)
    texts = spark.createDataFrame([(b"x", "a b")], "key binary, text string")
    for few in (True, False):
        plan = op.hit_windows(texts, windows, [10], few)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
        assert plan.count("regexp_extract_all") < 40      # no step is worked out again inside another


def test_words_are_those_of_the_pattern(spark):
    texts = ["", " ", "...", "One two", "\x00One\x7f-two_3 ", "ÉCOLE İI ß\u2028x", "a\nb\r\nc\t", "日本 語!", "\U0001F600 ok", "x" * 5000 + "@" + "Y" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", op.words(df.text).alias("w")).collect():
        assert r.w == WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.i] or ""))
