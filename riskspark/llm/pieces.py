"""Operator 10: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position
its output links name every piece that ends there, and each relaxes the best
score of a segmentation up to that position (Viterbi).  This is the encoding of
a unigram model.  A BPE model's scores are ranks of merges, which don't add up: the pass gives the
segmentation with the best sum of them, not the model's own.  ``merges=True`` gives
that: each piece that ends at a position is tried, longest first, and taken if
it and the last piece before it are what the merges make of the two together
(a row of pieces is the merges' result if all its neighbours are).

A space is written as the mark U+2581, one mark is put in front, and no piece
holds a mark behind another character.  So a best segmentation of a text is the
best segmentations of its units (marks and the characters up to the next mark),
one after another, and units that come again are looked up.

A character that no piece covers, and a literal mark in the text, is
written as its UTF-8 bytes (one byte piece each), so decoding gives back every text."""

from __future__ import annotations

import heapq
import re
from collections import ChainMap, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskspark.llm.common import map_arrow, small_batches

# Fixed values of the SentencePiece format: the mark of a space, and the forms of byte pieces.
MARK = "▁"
BYTE_PIECE = re.compile(r"^<0x([0-9A-F]{2})>$")
#: What a character in bytes costs, below the worst piece.
BYTE_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units of at most LONG_UNIT characters remembered by a worker; beyond that the memory starts anew (results don't depend on it).
MEMORY_UNITS = 100_000
#: Characters whose units are looked up at once; longer texts are taken in parts of about that length.
PART_CHARS = 200_000
#: Pairs of pieces remembered by a worker, likewise.
MEMORY_PAIRS = 400_000
#: Characters with a complete transition table (those of most pieces), the longest unit and the number of units taken in step.
TABLE_CHARS = 160
LONG_UNIT = 48
STEP_UNITS = 20_000


def read_pieces(model_file: str) -> list[tuple[str, float, bool]]:
    """(piece, score, may be used for text) by id, from a model file; needs the sentencepiece package on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i),
             not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)))
            for i in range(sp.get_piece_size())]


def is_merge_model(model_file: str) -> bool:
    """Whether the model encodes by merges (BPE); needs the sentencepiece package on the driver only."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


class Automaton:
    """Goto, failure and output links over the pieces; state 0 is the root."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        self.text = [p for p, _, _ in pieces]
        self.byte_id = {int(m[1], 16): i for i, (p, _, _) in enumerate(pieces) if (m := BYTE_PIECE.match(p))}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces; texts with other characters could not be decoded")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.goto: list[dict[str, int]] = [{}]
        self.piece = [-1]        # the piece that ends in a state
        self.score = [0.0]
        self.length = [0]
        for i, (p, score, use) in enumerate(pieces):
            if not use or not p:
                continue
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {i} goes across a space")
            state = 0
            for c in p:
                nxt = self.goto[state].get(c)
                if nxt is None:
                    nxt = len(self.goto)
                    self.goto[state][c] = nxt
                    self.goto.append({})
                    self.piece.append(-1)
                    self.score.append(0.0)
                    self.length.append(0)
                state = nxt
            if self.piece[state] < 0 or score > self.score[state]:
                self.piece[state], self.score[state], self.length[state] = i, score, len(p)
        self.fail = [0] * len(self.goto)
        self.link = [0] * len(self.goto)   # nearest proper suffix state in which a piece ends; 0 is none
        todo = deque(self.goto[0].values())
        while todo:
            state = todo.popleft()
            for c, nxt in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.goto[back].get(c, 0) if state else 0
                todo.append(nxt)
            f = self.fail[state]
            self.link[state] = f if self.piece[f] >= 0 else self.link[f]
        self.byte_score = min((s for _, s, use in pieces if use), default=0.0) - BYTE_PENALTY
        self.plain = [p.replace(MARK, " ").encode() for p in self.text]
        for i, b in self.byte_of.items():
            self.plain[i] = bytes([b])

        self.rank = {self.text[i]: s for i, s in zip(self.piece, self.score) if i >= 0}
        self.pairs: dict[int, bool] = {}
        self._as_arrays()

    def _as_arrays(self) -> None:
        """The links as arrays, and for the characters of most pieces the complete transition table."""
        count: dict[str, int] = {}
        for p in self.text:
            for c in p:
                count[c] = count.get(c, 0) + 1
        common = sorted(count, key=lambda c: (-count[c], c))[:TABLE_CHARS]
        self.char_id = np.full(0x110000, -1, dtype=np.int16)
        self.char_id[[ord(c) for c in common]] = np.arange(len(common))
        self.a_piece, self.a_length = np.array(self.piece, np.int32), np.array(self.length, np.int32)
        self.a_score, self.a_link = np.array(self.score), np.array(self.link, np.int32)
        self.table = np.zeros((len(self.goto), len(common)), dtype=np.int32)
        todo = deque([0])
        while todo:              # parents and shorter suffixes come first
            state = todo.popleft()
            if state:
                self.table[state] = self.table[self.fail[state]]
            for c, nxt in self.goto[state].items():
                cid = self.char_id[ord(c)]
                if cid >= 0:
                    self.table[state, cid] = nxt
                todo.append(nxt)

    def best_of_many(self, units: list[str]) -> list[bytes]:
        """``best`` of every unit as int32 bytes: the same single pass, made in step for all units.

        Units with rarer characters, or longer than LONG_UNIT, or that need bytes go through ``best``."""
        out: list[bytes | None] = [None] * len(units)
        if units:
            size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
            codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            end = np.cumsum(size)
            cid = self.char_id[codes]
            rare = np.concatenate(([0], np.cumsum(cid < 0)))
            plain = np.flatnonzero((size <= LONG_UNIT) & (rare[end] == rare[end - size]))
            plain = plain[np.argsort(-size[plain], kind="stable")]
            for lo in range(0, len(plain), STEP_UNITS):
                self._in_step(plain[lo:lo + STEP_UNITS], size, end - size, cid, out)
        return [self._bytes(self.best(u)) if x is None else x for u, x in zip(units, out)]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.int32).tobytes()

    def _in_step(self, rows: np.ndarray, size: np.ndarray, start: np.ndarray, cid: np.ndarray,
                 out: list[bytes | None]) -> None:
        """Rows are sorted by falling length, so those still running are always the first."""
        n, longest = len(rows), int(size[rows[0]])
        length, begin = size[rows], start[rows]
        best = np.zeros((longest + 1, n))
        by = np.full((longest + 1, n), -1, dtype=np.int32)
        back = np.zeros((longest + 1, n), dtype=np.int16)
        state = np.zeros(n, dtype=np.int32)
        for i in range(1, longest + 1):
            m = int(np.searchsorted(-length, -i, side="right"))
            state = self.table[state[:m], cid[begin[:m] + (i - 1)]]
            top = best[i - 1, :m] + self.byte_score
            came, how = np.full(m, i - 1, dtype=np.int16), np.full(m, -1, dtype=np.int32)
            hit = np.where(self.a_piece[state] >= 0, state, self.a_link[state])
            at = np.flatnonzero(hit)
            hit = hit[at]
            while len(at):
                x = best[i - self.a_length[hit], at] + self.a_score[hit]
                better = (x > top[at]) | ((x == top[at]) & (how[at] < 0))
                w, h = at[better], hit[better]
                top[w], came[w], how[w] = x[better], i - self.a_length[h], self.a_piece[h]
                hit = self.a_link[hit]
                at, hit = at[hit > 0], hit[hit > 0]
            best[i, :m], back[i, :m], by[i, :m] = top, came, how
        ids = np.zeros((longest, n), dtype=np.int32)      # from the last piece to the first
        count, pos, usable = np.zeros(n, dtype=np.int64), length.copy(), np.ones(n, dtype=bool)
        run = np.arange(n)
        while len(run):
            p = pos[run]
            piece = by[p, run]
            usable[run[piece < 0]] = False
            ids[count[run], run] = piece
            count[run] += 1
            pos[run] = back[p, run]
            run = run[pos[run] > 0]
        step = np.arange(longest)[:, None]
        flat = ids.T[(step < count).T]
        ends = np.cumsum(count)
        order = np.repeat(ends, count) - 1 - (np.arange(len(flat)) - np.repeat(ends - count, count))
        body, ends = flat[order].tobytes(), (ends * 4).tolist()
        lo = 0
        for r, hi, ok in zip(rows.tolist(), ends, usable.tolist()):
            if ok:
                out[r] = body[lo:hi]
            lo = hi

    def best(self, unit: str) -> list[int]:
        """Ids of the segmentation with the largest sum of scores; of equal ones, the longest last piece wins."""
        n = len(unit)
        best, came, by = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        goto, fail, link, piece, score, length = self.goto, self.fail, self.link, self.piece, self.score, self.length
        state = 0
        for i, c in enumerate(unit, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, back, how = best[i - 1] + self.byte_score, i - 1, -1
            hit = state if piece[state] >= 0 else link[state]
            while hit:                       # from the longest piece that ends here to the shortest
                x = best[i - length[hit]] + score[hit]
                if x > top or (x == top and how < 0):
                    top, back, how = x, i - length[hit], piece[hit]
                hit = link[hit]
            best[i], came[i], by[i] = top, back, how
        out: list[int] = []
        i = n
        while i:
            if by[i] >= 0:
                out.append(by[i])
            else:
                out.extend(self.byte_id[b] for b in reversed(unit[i - 1].encode("utf-8")))
            i = came[i]
        return out[::-1]

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: the neighbours whose union has the best score are
        united, the leftmost of equal ones, until no union is a piece."""
        parts, rank = list(text), self.rank
        follows, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        todo = [(-rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        heapq.heapify(todo)
        while todo:
            _, i, both = heapq.heappop(todo)
            k = follows[i]
            if not parts[i] or k >= len(parts) or parts[i] + parts[k] != both:
                continue                     # one of the two has gone into another piece
            parts[i], parts[k], follows[i] = both, "", follows[k]
            if follows[i] < len(parts):
                before[follows[i]] = i
            for x, y in ((before[i], i), (i, follows[i])):
                if x >= 0 and y < len(parts) and (union := parts[x] + parts[y]) in rank:
                    heapq.heappush(todo, (-rank[union], x, union))
        return [p for p in parts if p]

    def _fits(self, last: int, piece: int) -> bool:
        """Whether the merges leave the two pieces as they are (last = -1: the second alone); remembered."""
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        want = [self.text[piece]] if last < 0 else [self.text[last], self.text[piece]]
        known = self.pairs[last * len(self.text) + piece] = self.merged("".join(want)) == want
        return known

    def merge_path(self, unit: str) -> list[int]:
        """Ids that the merges of a BPE model give, in one pass over the automaton."""
        last, came = [-1] * (len(unit) + 1), [0] * (len(unit) + 1)
        goto, fail, link, piece, length = self.goto, self.fail, self.link, self.piece, self.length
        pairs, size, state = self.pairs.get, len(self.text), 0
        for i, c in enumerate(unit, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            came[i] = i - 1                  # no piece fits: the character is written in bytes
            hit = state if piece[state] >= 0 else link[state]
            while hit:
                j, p = i - length[hit], piece[hit]
                fits = pairs(last[j] * size + p)
                if fits or (fits is None and self._fits(last[j], p)):
                    last[i], came[i] = p, j
                    break
                hit = link[hit]
        out: list[int] = []
        i = len(unit)
        while i:
            if last[i] >= 0:
                out.append(last[i])
            else:
                out.extend(self.byte_id[b] for b in reversed(unit[i - 1].encode("utf-8")))
            i = came[i]
        return out[::-1]


#: Stands for a literal mark among the units (no unit is empty).
_LITERAL = ""
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: A space that begins a unit, so that a text may be parted before it.
_SEAM = re.compile("(?<=[^ ]) ")


def _parts(text: str) -> Iterator[str]:
    """A text with the space that stands in front of it, in parts that hold whole units."""
    text, lo = " " + text, 0
    while len(text) - lo > PART_CHARS and (seam := _SEAM.search(text, lo + PART_CHARS)):
        yield text[lo:seam.start()]
        lo = seam.start()
    yield text[lo:]


class Codec:
    """Encode and decode texts, by the best sum of scores or by merges; keeps a bounded memory of units."""

    def __init__(self, pieces: list[tuple[str, float, bool]], merges: bool = False):
        self.automaton = Automaton(pieces)
        self.merges = merges
        mark = [self.automaton.byte_id[b] for b in MARK.encode()]
        self.literal = self.automaton._bytes(mark)
        self.known: dict[str, bytes] = {_LITERAL: self.literal}

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as int32; NULL and the empty text have none.  Literal
        marks part a text, and each is written in bytes."""
        bodies: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        chars = 0
        for k, text in enumerate(texts):
            for part in _parts(text) if text else ():
                if chars + len(part) > PART_CHARS and group:
                    self._encode_group(group, bodies)
                    group, chars = [], 0
                chars += len(part)
                group.append((k, self._units(part)))
        if group:
            self._encode_group(group, bodies)
        return [np.frombuffer(b"".join(x), dtype=np.int32) for x in bodies]

    @staticmethod
    def _units(part: str) -> list[str]:
        if MARK not in part:
            return _UNIT.findall(part.replace(" ", MARK))
        between = re.split(f"({MARK})", part)                   # the marks stand at odd places
        return [u for i, x in enumerate(between) for u in ([_LITERAL] if i % 2 else _UNIT.findall(x.replace(" ", MARK)))]

    def _encode_group(self, group: list[tuple[int, list[str]]], bodies: list[list[bytes]]) -> None:
        """Append the ids of the units to the bodies of their texts."""
        new = list({u for _, us in group for u in us if u not in self.known})
        found = self.known
        if new:
            made = dict(zip(new, self._encode_units(new)))
            short = {u: x for u, x in made.items() if len(u) <= LONG_UNIT}
            if len(found) + len(short) > MEMORY_UNITS:          # keep what these texts use
                found = {u: found[u] for _, us in group for u in us if u in found}
                found[_LITERAL] = self.literal
            found.update(short)
            self.known = found if len(found) <= MEMORY_UNITS else {_LITERAL: self.literal}
            if len(short) < len(made):                          # long units are for this group alone
                found = ChainMap(made, found)
        for k, us in group:
            bodies[k].append(b"".join([found[u] for u in us]))

    def _encode_units(self, units: list[str]) -> list[bytes]:
        if self.merges:
            return [self.automaton._bytes(self.automaton.merge_path(u)) for u in units]
        return self.automaton.best_of_many(units)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the mark in front goes, bytes that are no UTF-8 become U+FFFD."""
        plain = self.automaton.plain
        body = b"".join([plain[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


_codecs: dict[tuple[int, bool], Codec] = {}


def _codec(shared, merges: bool = False) -> Codec:
    """One codec per worker process and broadcast."""
    key = id(shared.value), merges
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, merges)
    return _codecs[key]


def encode(docs: DataFrame, pieces: list[tuple[str, float, bool]], text_col: str = "text",
           ids_col: str = "ids", merges: bool = False) -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens`` and ``round_trip`` (decoding gives
    the text back) to every row, in one narrow pass; same-named columns are replaced.
    ``merges`` is for the pieces of a BPE model (see ``is_merge_model``).

    NULL text: ids NULL, n_tokens 0, round_trip true.  Empty text: no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)   # one entry per piece of the vocabulary
    added = {ids_col: T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType()}
    keep = [c for c in docs.columns if c not in added]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema
    for c, t in added.items():
        schema = schema.add(c, t)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, merges)
        for batch in small_batches(batches, 500):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            ids = codec.encode_many(texts)
            same = [codec.decode(x) == (text or "") for x, text in zip(ids, texts)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.concatenate([*ids, np.zeros(0, dtype=np.int32)])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32),
                               mask=np.array([x is None for x in texts] + [False]))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cols += [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(sizes),
                     pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return map_arrow(docs, run, schema)


def decode(rows: DataFrame, pieces: list[tuple[str, float, bool]], ids_col: str = "ids",
           text_col: str = "text") -> DataFrame:
    """Add the text of each array of ids (NULL for NULL); a same-named column is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    keep = [c for c in rows.columns if c != text_col]
    schema = rows.select(*[f"`{c}`" for c in keep]).schema.add(text_col, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in small_batches(batches, 500):
            at = batch.schema.get_field_index(ids_col)
            texts = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*keep, text_col])

    return map_arrow(rows, run, schema)


def token_report(docs: DataFrame, model_file: str = DEFAULT_MODEL, merges: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip: the Viterbi pass over the model's scores; with ``merges`` the merges of a BPE model."""
    return encode(docs.select("doc_id", "text"), read_pieces(model_file), merges=merges).drop("text")
