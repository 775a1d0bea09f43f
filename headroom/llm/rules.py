"""Quality rules on repetition: characters inside repeated n-grams and lines.

Word n-grams of several lengths are hashed by a rolling hash over the word
hashes of a text; n-grams found twice or more mark the words they cover, and
the characters of marked words are what a rule measures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headroom.llm.words import BASE, GROUP_BYTES, Hashed, groups, mix, pieces, powers

# fixed values: characters that count as symbols, length of the base rule's window
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

# the most that may lie inside repeated n-grams of that many words, or in repeated lines
NGRAM_SHARES = ((3, 0.45), (5, 0.38), (8, 0.35))
LINE_SHARE = 0.30
SYMBOL_SHARE = 0.10

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, repeat3_share double, repeat5_share double, repeat8_share double, line_share double"
)


class Scan:
    """Words and lines of a group of texts, as arrays that no longer need their bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        hashed = Hashed(data, bounds)
        starts = (data & 0xC0) != 0x80
        points = np.concatenate(([0], np.cumsum(starts)))
        symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[data])))
        words, lines = hashed.words(), hashed.lines()
        self.n_texts = len(bounds) - 1
        self.symbols = np.diff(symbols[bounds])
        self.word, self.word_text = words.hash, words.text
        self.word_chars = points[words.end] - points[words.start]
        first = np.searchsorted(words.start, lines.start)
        has_word = np.searchsorted(words.start, lines.end) > first
        self.line, self.line_text = lines.hash[has_word], lines.text[has_word]
        self.line_chars = (points[lines.end] - points[lines.start])[has_word]

    @classmethod
    def of_long_text(cls, data: np.ndarray) -> Scan:
        """One text, scanned a piece at a time."""
        parts = [cls(p, np.array([0, len(p)])) for p in pieces(data)]
        whole = cls.__new__(cls)
        whole.n_texts = 1
        whole.symbols = sum(p.symbols for p in parts)
        for name in ("word", "word_text", "word_chars", "line", "line_text", "line_chars"):
            setattr(whole, name, np.concatenate([getattr(p, name) for p in parts]))
        return whole

    def per_text(self, text: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=values, minlength=self.n_texts).astype(np.int64)

    def repeated(self, n: int) -> np.ndarray:
        """Per word, whether an n-gram found twice or more in its text covers it."""
        m = len(self.word) - n + 1
        if m <= 0:
            return np.zeros(len(self.word), dtype=bool)
        weights = powers(BASE, n)
        rolling = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            rolling += self.word[k : k + m] * weights[k]
        at = np.flatnonzero(self.word_text[:m] == self.word_text[n - 1 :])
        key = mix(rolling[at] + mix(self.word_text[at].astype(np.uint64) + np.uint64(n)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        found = np.zeros(len(at), dtype=bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        cover = np.zeros(len(self.word) + 1, dtype=np.int64)
        np.add.at(cover, at[found], 1)
        np.add.at(cover, at[found] + n, -1)
        return np.cumsum(cover)[:-1] > 0

    def repeated_lines(self) -> np.ndarray:
        """Per line with a word, whether an earlier line of its text equals it."""
        key = mix(self.line + mix(self.line_text.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        return again

    def columns(self) -> list[np.ndarray]:
        ones = np.ones(len(self.word))
        n_words = self.per_text(self.word_text, ones)
        word_chars = self.per_text(self.word_text, self.word_chars)
        again = self.repeated_lines()
        n_dup = self.per_text(self.line_text, again)
        line_share = self.per_text(self.line_text, self.line_chars * again) / np.maximum(
            self.per_text(self.line_text, self.line_chars), 1
        )
        shares, fine = [], (line_share <= LINE_SHARE) & (self.symbols <= SYMBOL_SHARE * np.maximum(word_chars, 1))
        for n, most in NGRAM_SHARES:
            covered = self.repeated(n)
            if n == BASE_WINDOW:
                n_repeat = self.per_text(self.word_text, covered)
            shares.append(self.per_text(self.word_text, covered * self.word_chars) / np.maximum(word_chars, 1))
            fine &= shares[-1] <= most
        failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
        return [n_words, word_chars, self.symbols, n_dup, n_repeat, failed, ~failed & fine, *shares, line_share]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        found = []
        for first, last, data, bounds in groups(batch.column(1)):
            scan = Scan.of_long_text(data) if last - first == 1 and len(data) > GROUP_BYTES else Scan(data, bounds)
            found.append(scan.columns())
        if found:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Counts, shares and the verdict for every document.

    kept is false if the base rule failed (fewer than 20 words, or more than
    30 % of the words in 8-word windows found twice), if too large a part of
    the word characters lies inside repeated 3-, 5- or 8-grams, of the line
    characters in lines that repeat an earlier one, or if there are too many
    symbols.  Spans are compared by 64-bit hashes.

    Defined cases: null text: no words, fails the base rule; texts of any
    length are read whole, a piece at a time; repeated rows are measured each;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_measure, f"doc_id {id_type}, {SCHEMA}")


