"""Language by words first, by ever shorter character n-grams for unseen words.

A word of the model scores its log frequency in each language.  For a word the
model does not hold, the longest n-grams of it that the model knows decide:
all known 5-grams, or else all known 4-grams, and so on down to single
characters.  A text scores the sum over its words.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from headroom.llm.common import id_remainder, kept
from headroom.session import stage

SAMPLE_ROWS = 8_000  # of a language
MODEL_WORDS = 60_000
MODEL_GRAMS = 120_000
LONGEST_GRAM = 5
SMOOTHING = 0.5
CACHE_WORDS = 300_000
PIECE_CHARS = 1 << 20
PLACES = 2**20

LETTERS = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s")


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words, a bounded piece of the text at a time."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_CHARS:
            cut = SPACE.search(text, at + PIECE_CHARS)
            end = cut.start() if cut else end
        found = LETTERS.findall(text[at:end].lower())
        yield found if all(map(str.isalpha, found)) else [w for run in found for w in _letters(run)]
        at = end


def _letters(run: str) -> list[str]:
    """The words of a run without its numbers that are no digits, such as fractions and superscripts."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def grams_of(word: str) -> Iterator[tuple[int, str]]:
    padded = f"<{word}>"
    for n in range(LONGEST_GRAM, 1, -1):
        for i in range(len(padded) - n + 1):
            yield n, padded[i : i + n]
    for character in word:
        yield 1, character


# --- the model ------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for words in words_of(text):
                counts.update((lang, w) for w in words)
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        columns = [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "unit", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for _, gram in grams_of(word):
                counts[lang, gram] += n
        langs, grams = zip(*counts, strict=True) if counts else ((), ())
        columns = [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "unit", "n"])


def _most_frequent(counts: DataFrame, totals: dict[str, int], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Up to ``most`` units and their counts per language, those with the largest share of a language: what the model holds.

    Units rank by their largest share of any language's words, in steps of a
    few per cent, so the units of a rare language stand beside those of a
    common one.  The bound comes from the number of units of each step, so
    nothing has to be sorted.
    """
    langs = sorted(totals)
    n = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs]
    share = F.greatest(*[c / totals[x] for c, x in zip(n, langs, strict=True)], F.lit(0.0), F.lit(0.0))
    step = F.floor(F.log(F.greatest(share, F.lit(1e-18))) * 32).alias("step")
    units = stage(counts.groupBy("unit").agg(step, *[c.alias(f"n{i}") for i, c in enumerate(n)]), "units")
    held, least = 0, None
    for at, number in sorted(map(tuple, units.groupBy("step").count().collect()), reverse=True):
        held += number
        if held > most and least is not None:
            break
        least = at
    found = units.filter(F.col("step") >= (0 if least is None else least)).drop("step").toArrow().sort_by("unit")
    rows = {w: i for i, w in enumerate(found.column("unit").to_pylist())}
    columns = [found.column(f"n{i}").to_numpy() for i in range(len(langs))]
    return rows, np.stack(columns, axis=1).astype(float) if langs else np.zeros((len(rows), 0))


def _log_frequencies(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(units, languages): log frequency against the mean over languages."""
    if not counts.size:
        return counts.astype(np.float32)
    logs = np.log((counts + SMOOTHING) / (totals + SMOOTHING * (len(counts) + 1)))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def train_language_model(
    labelled: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    model_words: int = MODEL_WORDS,
    model_grams: int = MODEL_GRAMS,
) -> dict:
    """Learn from (doc_id, text, lang): word and n-gram frequencies per language.

    Counts come from a sample of about ``sample_rows`` rows of every language,
    drawn by a hash of the id and the text, or all its rows if there are no
    more; whole texts.  The model holds up to ``model_words`` words and
    ``model_grams`` n-grams, those with the largest share of a language, so it
    grows with the number of languages and not with the corpus.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    bounds = [F.when(F.col("lang") == x, F.lit(int(PLACES * min(1.0, sample_rows / n)))) for x, n in rows.items() if n > sample_rows]
    bound = F.coalesce(*bounds, F.lit(PLACES))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES)) < bound)
    schema = "lang string, unit string, n long"
    counted = drawn.select("lang", "text").mapInArrow(_count_words, schema).groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    counted = stage(counted, "word-frequencies")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    words, word_counts = _most_frequent(counted, totals, model_words)
    grams = counted.mapInArrow(_count_grams, schema).groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    grams, gram_counts = _most_frequent(grams, totals, model_grams)
    whole = np.array([totals[x] for x in langs], dtype=float)
    return {
        "langs": langs,
        "words": words,
        "word_scores": _log_frequencies(word_counts, whole),
        "grams": grams,
        "gram_scores": _log_frequencies(gram_counts, whole),
    }


class Scorer:
    """Scores of texts; unseen words are worked out together and the first ones remembered."""

    def __init__(self, model: dict):
        self.langs, self.grams, self.gram_scores = model["langs"], model["grams"], model["gram_scores"]
        self.rows = dict(model["words"])
        self.scores = np.asarray(model["word_scores"], dtype=np.float32).reshape(len(self.rows), len(self.langs))
        self.most = len(self.rows) + CACHE_WORDS

    def backoff(self, words: list[str]) -> np.ndarray:
        """(words, languages): the mean over the longest known n-grams of each word, 0 if none is known."""
        get, rows, counts = self.grams.get, [], []
        for word in words:
            before, padded = len(rows), f"<{word}>"
            for n in range(LONGEST_GRAM, 0, -1):
                text = padded if n > 1 else word
                rows += [r for i in range(len(text) - n + 1) if (r := get(text[i : i + n])) is not None]
                if len(rows) > before:
                    break
            counts.append(len(rows) - before)
        counts = np.array(counts)
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        some = counts > 0
        if some.any():
            first = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.gram_scores[rows], first, axis=0) / counts[some, None]
        return out

    def add(self, total: np.ndarray, texts: list[int], words: list[list[str]]) -> None:
        """Add the scores of pieces of texts to the rows of their texts."""
        flat = list(itertools.chain.from_iterable(words))
        if not flat or not self.langs:
            return
        rows = np.fromiter(map(self.rows.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        unseen = np.flatnonzero(rows < 0)
        scores = self.scores
        if len(unseen):
            names = [flat[i] for i in unseen]
            new = {w: len(scores) + k for k, w in enumerate(dict.fromkeys(names))}
            rows[unseen] = np.fromiter(map(new.__getitem__, names), np.int64, len(names))
            scores = np.concatenate([scores, self.backoff(list(new))])
            kept = min(len(new), self.most - len(self.scores))
            if kept > 0:
                self.rows.update(itertools.islice(new.items(), kept))
                self.scores = scores[: len(self.scores) + kept]
        sizes = np.array([len(w) for w in words])
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        found = np.add.reduceat(scores[rows], first, axis=0, dtype=np.float64)
        np.add.at(total, np.array(texts)[sizes > 0], found)

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text; a bounded number of characters is worked on at a time."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        at, held, chars = [], [], 0
        for k, text in enumerate(texts):
            for words in words_of(text or ""):
                n[k] += len(words)
                at.append(k)
                held.append(words)
            chars += len(text or "")
            if chars >= PIECE_CHARS:
                self.add(total, at, held)
                at, held, chars = [], [], 0
        self.add(total, at, held)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.langs[b] if w else "und" for b, w in zip(best, n, strict=True)]
        return langs, np.where(n > 0, score, 0.0)


def language_scorer(model: dict):
    """A function for mapInArrow over (doc_id, held_out, text)."""
    key = ("headroom-language", len(model["words"]), float(model["word_scores"].sum()), float(model["gram_scores"].sum()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(model))
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            langs, scores = scorer.texts(text.to_pylist())
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return score


def held_out(doc_id):
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def detect_language(docs: DataFrame, model: dict | None = None, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Without a ``model`` one is learned from the documents that are not held
    out.  The score is the share of the best language in the sum of likelihoods.

    Defined cases: null text or no letter: ``und`` with score 0; numbers such
    as fractions and superscripts are no letters; very long texts are read
    whole, a piece at a time; null lang: not
    learned from; ties: the first language by name; repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    model = model or _model_of(docs, **settings)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        language_scorer(model), f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    )


def _model_of(docs: DataFrame, **settings) -> dict:
    return train_language_model(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **settings)


def keep_identified(docs: DataFrame, min_score: float = 0.0, model: dict | None = None, **settings) -> DataFrame:
    """The rows whose language is told, whole; `und` and scores below ``min_score`` go.

    A row is decided by its own text, in one pass over whole rows, so equal
    and null ids do not matter.
    """
    score = language_scorer(model or _model_of(docs, **settings))
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (told,) = score(iter([batch.select([at])]))
            named = pc.not_equal(told.column("lang_pred"), "und")
            yield batch.filter(pc.and_(named, pc.greater_equal(told.column("score"), min_score)))

    return docs.mapInArrow(keep, docs.schema)
