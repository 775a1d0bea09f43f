"""Fixtures and plain-Python forms of what the text operators return."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SENTENCE = "The quick brown fox jumps over the lazy dog while nine small birds sing above an old stone bridge"
LONG = " ".join(f"word{i % 977} plus{i % 31}" for i in range(30_000))
ROWS = [
    (1, SENTENCE, "en", "a"),
    (2, SENTENCE.upper(), "en", "a"),
    (3, SENTENCE, None, None),
    (3, SENTENCE, None, None),  # a repeated row
    (4, None, "en", "b"),
    (5, "", "en", "b"),
    (6, " \t\n ", None, "b"),
    (7, "É è ß", "fr", "c"),
    (8, "é è ß", "fr", "c"),
    (9, "12 34 ++", "en", "c"),
    (10, LONG, "en", "a"),
    (11, LONG + " tail", "en", "a"),
    (12, "one two", "en", None),
    (13, "one two\none two\n\none two", "en", "d"),
    (None, "no id here at all", None, "d"),
    (15, "x" * 3000, "en", "d"),
    (16, "a  b c\x1cd <|endoftext|> e", "en", "d"),
]
# names that the operators use themselves
CLASHES = ("gone", "_block", "_pass", "_row", "n", "key", "component", "size", "_text")


def odd_documents(spark):
    """Every awkward case in one table, with columns of clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def no_documents(spark):
    return odd_documents(spark).limit(0)


def documents(folder: str) -> dict[int, str]:
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, n: int = 3) -> frozenset:
    w = words((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(rows: list[tuple], similarity: int = 85) -> tuple[list[int], list]:
    """(set sizes, component) per row; every pair with a common shingle is compared."""
    sets = [shingle_set(text) for _, text in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if None not in (rows[i][0], rows[j][0]) and 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [len(s) for s in sets], [least.get(root(i)) for i in range(len(rows))]


def repetition(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)
