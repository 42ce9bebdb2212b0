"""Operator 6: line-first cleaning.

Each line is judged on its own (punctuation, navigation, boilerplate, symbol
and shouting rules); failing lines are removed, and a document that loses
too much of its text that way is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.llm.common import map_arrow, text_blocks
from riskspark.llm.textkernel import mix, prefix_hash, range_hash, shingles, word_ranges

# Fixed values of the base figures: symbols, window length, limits of the base test.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Fixed values of the line rules, in RE2's and Python's common syntax.
#: A sentence ends somewhere in the line (at a word's end), or the line is a heading-like list item ending in a colon.
SENTENCE_END = r"""[.!?…:;。！？]["'”’)\]]*([\x20\x09-\x0D]|$)"""
#: Menus: separators standing alone between words.
SEPARATOR = r"(^|[\x20\x09-\x0D])[|»›·•>/]+"
BOILERPLATE = (r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|accept cookies"
               r"|enable javascript|javascript is (disabled|required)|lorem ipsum|click here|read more|sign up|log ?in"
               r"|subscribe (now|to)|share (this|on)|skip to (main )?content|back to top|copyright ©)")
#: Words with decoration, such as "word%%%" or "word!!".
DECORATED = r"([#*$%&|<>]{2,}|!{2,})"

_SENTENCE, _SEPARATOR, _BOILERPLATE, _DECORATED = (re.compile(x) for x in (SENTENCE_END, SEPARATOR, BOILERPLATE, DECORATED))
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class LineRules:
    """``min_sentence_words``: lines shorter than this may lack a sentence end
    (headings); ``max_separators``: share of words that may be menu separators;
    ``boilerplate_words``: a line with a boilerplate phrase fails if it has at
    most this many words; ``max_decorated``: share of decorated words;
    ``max_loss_percent``: a document that loses more of its words is rejected."""

    min_sentence_words: int = 12
    max_separator_percent: int = 10
    boilerplate_words: int = 20
    max_decorated_percent: int = 30
    max_loss_percent: int = 50

    def fails(self, line: str, words: int) -> bool:
        """``line`` has ``words`` words, one at least."""
        if words >= self.min_sentence_words and not _SENTENCE.search(line):
            return True
        if words >= 4 and 100 * sum(1 for _ in _SEPARATOR.finditer(line)) > self.max_separator_percent * words:
            return True
        if words <= self.boilerplate_words and _BOILERPLATE.search(line):
            return True
        return 100 * sum(1 for _ in _DECORATED.finditer(line)) > self.max_decorated_percent * words


def repeated_words(data: np.ndarray, off: np.ndarray, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside k-word windows that occur twice or more in the text."""
    starts, ends, first = word_ranges(data, off)
    n_words = np.diff(first)
    if not len(starts):
        return n_words, np.zeros(len(n_words), dtype=np.int64)
    hashes, text, at = shingles(range_hash(prefix_hash(data), starts, ends), first, k)
    keys = mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
    return n_words, covered[first[1:]] - covered[first[:-1]]


def clean_lines(text: str, rules: LineRules) -> tuple[str, int, int, int]:
    """(text without failing lines, words of it, lines that repeat an earlier one, lines removed).

    Lines without words stay as they are."""
    seen: set[str] = set()
    kept, words_kept, dup, removed = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            if line in seen:
                dup += 1
            seen.add(line)
            if rules.fails(line, n):
                removed += 1
                continue
            words_kept += n
        kept.append(line)
    return "\n".join(kept), words_kept, dup, removed


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines_removed long, n_words_kept long, clean_text string")
_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
          "n_lines_removed", "n_words_kept", "clean_text")


def line_first(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(),
               with_text: bool = True) -> DataFrame:
    """One narrow pass that adds, to every row, the base figures, the verdict
    and the cleaned text (in columns that replace same-named ones).

    NULL text counts as empty; an empty text fails the base test; repeated rows
    are judged alike; an empty table gives an empty result.  Memory: one block of
    texts at a time."""
    added = _ADDED if with_text else _ADDED[:-1]
    keep = [c for c in docs.columns if c not in added]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema
    types = dict(part.rsplit(" ", 1) for part in SCHEMA.split(", "))
    for c in added:
        schema = schema.add(c, types[c])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, data, off in text_blocks(batch.column(at)):
                n_words, n_repeat = repeated_words(data, off)
                out: dict[str, list] = {c: [] for c in added}
                for i, text in enumerate(batch.column(at).slice(lo, hi - lo).to_pylist()):
                    text = text or ""
                    n, rep = int(n_words[i]), int(n_repeat[i])
                    clean, left, dup, removed = clean_lines(text, rules)
                    failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
                    row = (n, len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"),
                           sum(text.count(c) for c in SYMBOLS), dup, rep, failed,
                           not failed and 100 * (n - left) <= rules.max_loss_percent * n, removed, left, clean)
                    for c, v in zip(added, row):
                        out[c].append(v)
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep]
                cols += [pa.array(out[c], {"boolean": pa.bool_(), "string": pa.string()}.get(types[c], pa.int64()))
                         for c in added]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return map_arrow(docs, run, schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and what the line rules removed."""
    return line_first(docs.select("doc_id", "text"), with_text=False).drop("text")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
wd AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
run AS (SELECT r, i, {" || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(WINDOW))} AS k FROM wd
        WINDOW o AS (PARTITION BY r ORDER BY i)),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM run WHERE k IS NOT NULL),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS k FROM win WHERE c > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
ln AS (
  SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY r, l ORDER BY i) > 1 AS dup,
         regexp_matches(l, '{SENTENCE_END.replace("'", "''")}') AS ends,
         len(regexp_extract_all(l, '{SEPARATOR}')) AS seps,
         regexp_matches(l, '{BOILERPLATE}') AS boiler,
         len(regexp_extract_all(l, '{DECORATED}')) AS deco
  FROM lines
), lf AS (
  SELECT *, (n >= 12 AND NOT ends) OR (n >= 4 AND 100 * seps > 10 * n) OR (n <= 20 AND boiler) OR 100 * deco > 30 * n AS fails
  FROM ln WHERE n > 0
), lr AS (
  SELECT r, count(*) FILTER (dup) AS n_dup, count(*) FILTER (fails) AS n_removed,
         coalesce(sum(n) FILTER (NOT fails), 0)::BIGINT AS left_words FROM lf GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_lines_removed, coalesce(left_words, 0) AS n_words_kept
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lr USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * (n_words - n_words_kept) <= 50 * n_words AS kept,
       n_lines_removed, n_words_kept
FROM f
"""
