"""What the two trained classifiers share: which rows may be learned from, a
bounded sample of them, sparse feature rows, and scoring word by word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import map_arrow, small_batches
from riskspark.llm.textkernel import BASE, mix

#: Words remembered by a worker while scoring (results don't depend on it).
MEMORY_WORDS = 400_000


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % parts


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct ids, those with the least MD5: a bounded sample that reruns repeat."""
    return ids.where("doc_id is not null").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)


def word_grams(words: list[str], buckets: int, grams: tuple[int, ...] = (), prefixes: tuple[int, ...] = ()) \
        -> tuple[np.ndarray, np.ndarray]:
    """(features, which word) of all words at once: each word's own bucket, then
    those of its character n-grams (edges marked) and of its first characters.

    Equal words get equal features in every task: the hashes depend on characters only."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    start = np.cumsum(size) - size
    letters = mix(codes.astype(np.uint64) + np.uint64(1))
    which = np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) - start[which]
    # A running hash from the first letter on; its value at the last letter stands for the word.
    power = np.multiply.accumulate(np.full(int(size.max()) + 1, BASE, np.uint64))
    run = np.cumsum(letters * power[place])
    before = run[start] - letters[start] * power[0]

    def upto(words_at: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
        total = run[start[words_at] + length] - before[words_at]
        return (mix(total + np.uint64(salt)) % np.uint64(buckets)).astype(np.int32)

    every = np.arange(n)
    feats, owner = [upto(every, size - 1, 1)], [every]
    for k in grams:
        at = np.flatnonzero(place + k <= size[which])
        h = letters[at]
        for j in range(1, k):
            h = mix(h * np.uint64(BASE) + letters[at + j])
        feats.append((mix(h + np.uint64(100 + k)) % np.uint64(buckets)).astype(np.int32))
        owner.append(which[at])
    for k in prefixes:
        long = np.flatnonzero(size - 2 > k)
        feats.append(upto(long, np.full(len(long), k), 200 + k))
        owner.append(long)
    return np.concatenate(feats), np.concatenate(owner)


class Rows:
    """Sparse rows: the features of row i are ids[start[i]:start[i + 1]] with their counts."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray]):
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        self.ids = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        self.counts = np.concatenate([*counts, np.zeros(0, np.float32)]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.start) - 1

    def only(self, learned: np.ndarray, buckets: int) -> "Rows":
        """The same rows with the learned features alone, numbered by their place in ``learned``."""
        place = np.full(buckets, -1, np.int64)
        place[learned] = np.arange(len(learned))
        ids = place[self.ids]
        keep = ids >= 0
        out = Rows([], [])
        out.ids, out.counts = ids[keep].astype(np.int32), self.counts[keep]
        out.start = np.concatenate(([0], np.cumsum(keep)))[self.start].astype(np.int64)
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, which of ``rows``) of the chosen rows, one after another."""
        n = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.ids[at], self.counts[at], np.repeat(np.arange(len(rows)), n)


def sparse_features(docs: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> list:
    """Collect (doc_id, ids, counts) of a bounded sample of documents; whole texts, read in the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            found = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([ids.astype(np.int32).tobytes() for ids, _ in found], pa.binary()),
                pa.array([counts.astype(np.float32).tobytes() for _, counts in found], pa.binary())],
                names=["doc_id", "ids", "counts"])

    rows = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary, counts binary").collect()
    seen: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):      # one text per id, whatever the order of arrival
        seen.setdefault(r[0], (np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)))
    return [(i, *x) for i, x in seen.items()]


class WordMemory:
    """word -> row of figures, worked out for many new words at once and kept up to a bound."""

    def __init__(self, figures: Callable[[list[str]], np.ndarray]):
        self.figures, self.place, self.rows = figures, {}, None

    def look_up(self, texts: list[Iterable[str]]) -> list[np.ndarray]:
        """Per text, the rows of its words."""
        new = list({w for words in texts for w in words if w not in self.place})
        if self.rows is None or len(self.place) + len(new) > MEMORY_WORDS:
            self.place, new, self.rows = {}, list({w for words in texts for w in words}), None
        if new or self.rows is None:
            got = self.figures(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.rows = got if self.rows is None else np.concatenate((self.rows, got))
        return [self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64)] for words in texts]


def add_scores(docs: DataFrame, text_col: str, name: str,
               make: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """Add a double column with a score of each whole text; ``make`` builds the scorer once per task."""
    keep = [c for c in docs.columns if c != name]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(name, "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in small_batches(batches, 500):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score([t or "" for t in texts]), pa.float64())],
                                             names=[*keep, name])

    return map_arrow(docs, run, schema)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))
