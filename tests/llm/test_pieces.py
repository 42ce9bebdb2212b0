import random

import numpy as np
import pytest

from riskspark.llm import pieces
from tests.conftest import SF0001
from tests.llm.helpers import clashing, empty, odd


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_pieces(pieces.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return pieces.Codec(vocabulary)


def best_score(text, vocabulary, byte_score):
    """Plain dynamic programme over all pieces and all places of the whole text."""
    score = {p: s for p, s, use in vocabulary if use}
    longest = max(map(len, score))
    best = [0.0] + [-np.inf] * len(text)
    for i in range(1, len(text) + 1):
        best[i] = best[i - 1] + byte_score
        for n in range(1, min(longest, i) + 1):
            if (s := score.get(text[i - n:i])) is not None:
                best[i] = max(best[i], best[i - n] + s)
    return best[-1]


def test_scores_are_best_over_whole_texts(codec, vocabulary):
    r = random.Random(4)
    by_byte = codec.automaton.byte_of
    for _ in range(200):
        text = "".join(r.choice(["the", "ing", " ", "  ", "zq", "é", "日本", "\n", "Q", "tion", "☃", "a"]) for _ in range(r.randrange(1, 30)))
        ids = codec.encode(text).tolist()
        plain = [i for i in ids if i not in by_byte]
        chars_in_bytes = len(bytes(by_byte[i] for i in ids if i in by_byte).decode())
        got = sum(vocabulary[i][1] for i in plain) + chars_in_bytes * codec.automaton.byte_score
        whole = pieces.MARK + text.replace(" ", pieces.MARK)
        assert got == pytest.approx(best_score(whole, vocabulary, codec.automaton.byte_score))
        assert codec.decode(ids) == text


def test_in_step_is_the_same_pass(codec):
    r = random.Random(9)
    units = ["▁" * r.randrange(3) + "".join(r.choice("abcdefghistnoé.") for _ in range(r.randrange(1, 60))) for _ in range(500)]
    many = codec.automaton.best_of_many(units)
    assert [np.frombuffer(b, np.int32).tolist() for b in many] == [codec.automaton.best(u) for u in units]


@pytest.mark.parametrize("text", ["", " ", "a", "  a  ", "▁", "▁a ▁▁ b▁", "\x00\x01￿😀﷽", "line\nbreak\ttab\r\n", "x" * 5000])
def test_round_trip(codec, text):
    assert codec.decode(codec.encode(text)) == text


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_UNITS", 3)
    small, texts = pieces.Codec(vocabulary), ["some words here", "other words there", "▁ some", "words"]
    plain = pieces.Codec(vocabulary)
    assert [x.tolist() for x in small.encode_many(texts) + small.encode_many(texts[::-1])] == \
        [plain.encode(t).tolist() for t in texts + texts[::-1]]


def test_odd_rows(spark, vocabulary):
    out = pieces.encode(odd(spark), vocabulary)
    rows = out.collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id == 2] == [None] and [r.ids for r in rows if r.doc_id == 3] == [[]]
    back = pieces.decode(out.drop("text"), vocabulary).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.text or "")
    assert sorted(map(key, back)) == sorted(map(key, rows))
    assert pieces.encode(empty(spark), vocabulary).count() == 0
    assert pieces.encode(clashing(odd(spark), "ids", "n_tokens"), vocabulary).where("n_tokens >= 0").count() == 10


def test_ids_of_a_merge_model_are_the_models_own(vocabulary):
    """Against sentencepiece itself; a text with a literal mark is the one thing that is written otherwise (in bytes)."""
    import duckdb
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    r = random.Random(12)
    texts = [t for (t,) in duckdb.sql(f"SELECT substr(text, 1, 3000) FROM '{SF0001}/documents.parquet' WHERE text <> ''").fetchall()]
    texts += ["".join(r.choice(["the", "ing", " ", "  ", " " * r.randrange(40), "zq", "é", "日本", "\n", "Q", "tion", "☃", "a", "aaa", "\x00"])
                      for _ in range(r.randrange(1, 30))) for _ in range(500)]
    texts += ["".join(r.choice("abcdefghinorst .") for _ in range(200)) for _ in range(200)]
    texts = [t for t in texts if pieces.MARK not in t]
    assert pieces.is_merge_model(pieces.DEFAULT_MODEL) and len(texts) > 800
    codec = pieces.Codec(vocabulary, merges=True)
    assert [x.tolist() for x in codec.encode_many(texts)] == [sp.encode(t) for t in texts]
    assert all(codec.decode(codec.encode(t)) == t for t in ["", "▁", "▁a ▁▁ b▁", "\x00\x01￿😀﷽", "x" * 5000, " " * 5000, *texts])


def plain_viterbi(text, vocabulary, byte_score, byte_id):
    """Ids of the best sum of scores by a dynamic programme over the whole text at once; of equal sums the longest last piece."""
    score: dict = {}
    for i, (p, s, use) in enumerate(vocabulary):
        if use and p and (p not in score or s > score[p][0]):
            score[p] = (s, i)
    whole = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    longest = max(map(len, score))
    best, came, by = [0.0] * (len(whole) + 1), [0] * (len(whole) + 1), [-1] * (len(whole) + 1)
    for i in range(1, len(whole) + 1):
        top, back, how = best[i - 1] + byte_score, i - 1, -1
        for n in range(min(longest, i), 0, -1):
            if (found := score.get(whole[i - n:i])) is not None:
                x = best[i - n] + found[0]
                if x > top or (x == top and how < 0):
                    top, back, how = x, i - n, found[1]
        best[i], came[i], by[i] = top, back, how
    out, i = [], len(whole)
    while i:
        out += [by[i]] if by[i] >= 0 else [byte_id[b] for b in reversed(whole[i - 1].encode())]
        i = came[i]
    return out[::-1]


def test_query_gives_the_ids_of_a_plain_dynamic_programme(spark, vocabulary, codec):
    """Whole documents, the report's own ids."""
    rows = pieces.token_report(spark.read.parquet(f"{SF0001}/documents.parquet")).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    a = codec.automaton
    some = [r for r in rows if len(texts[r.doc_id]) < 6000 and pieces.MARK not in texts[r.doc_id]]
    assert len(some) > 100
    for r in some[:120]:
        assert r.ids == plain_viterbi(texts[r.doc_id], vocabulary, a.byte_score, a.byte_id)
    assert all(r.round_trip for r in rows)


def test_report_by_merges_gives_the_models_own_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    text = "The model encodes these words by merges, not by sums of ranks."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.ids for r in pieces.token_report(df, merges=True).collect()] == [sp.encode(text)]


@pytest.mark.parametrize("merges", [False, True])
def test_parts_of_texts_and_small_memory_change_nothing(monkeypatch, merges):
    """Long texts in parts, many texts in a group, long units and a memory that starts anew: the same ids."""
    words = ["the", "of", "é", pieces.MARK, "x" * 60, "日本", "", "\n", "a" + pieces.MARK + "b", "token", "7"]
    texts = [" ".join(words[(i * k + k) % 11] + ("  " if i % 13 == 0 else "") for i in range(n))
             for k, n in ((1, 400), (3, 50), (7, 0), (5, 900), (2, 1))] + [None, " ", "   ", " " * 300, "y" * 500]
    vocabulary = pieces.read_pieces(pieces.DEFAULT_MODEL)
    want = [x.tolist() for x in pieces.Codec(vocabulary, merges).encode_many(texts)]
    for chars, units in ((50, 10), (1, 100_000), (1000, 3)):
        monkeypatch.setattr(pieces, "PART_CHARS", chars)
        monkeypatch.setattr(pieces, "MEMORY_UNITS", units)
        codec = pieces.Codec(vocabulary, merges)
        assert [x.tolist() for x in codec.encode_many(texts)] == want
        assert [codec.decode(x) for x in want] == [t or "" for t in texts] and len(codec.known) <= max(units, 1)
