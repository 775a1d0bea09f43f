"""A byte-level convolutional network for text quality, in numpy.

A text is cut into overlapping chunks that cover it whole.  Learned filters
run over the bytes of a chunk and are max-pooled; mean and maximum over the
chunks go through one small layer to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headroom.llm.common import id_remainder, kept
from headroom.llm.words import groups
from headroom.session import stage

CHUNK = 512
STEP = 480
FILTERS = 16
WIDTH = 6
HIDDEN = 16
THRESHOLD = 0.3

SAMPLE_ROWS = 5_000
SAMPLE_BYTES = 64 << 20
EPOCHS = 10
BATCH = 64
RATE = 0.01
SEED = 11
PLACES = 2**20
CHUNKS_AT_ONCE = 128


def chunk_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every chunk; every text has at least one, and the last reaches its end."""
    sizes = np.diff(bounds)
    n = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return bounds[:-1][text] + k * STEP, text


def read_chunks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes; behind the end of a text they are 0."""
    at = start[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, dtype=np.uint8)
    out = data[np.minimum(at, len(data) - 1)]
    out[at >= end[:, None]] = 0
    return out


def responses(model: dict, chunks: np.ndarray) -> np.ndarray:
    """(chunks, positions, filters): every filter at every position."""
    table = model["pairs"]
    pair = chunks[:, :-1].astype(np.intp) * 256 + chunks[:, 1:]
    n = CHUNK - WIDTH + 1
    out = table[0][pair[:, :n]]
    for k in range(1, WIDTH // 2):
        out += table[k][pair[:, 2 * k : 2 * k + n]]
    return out


def with_pairs(model: dict) -> dict:
    """Tables for two bytes at once, out of those for one: half the lookups."""
    t = model["filters"]
    pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
    return model | {"pairs": [p.astype(np.float32) for p in pairs]}


def combine(model: dict, pooled: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, ...]:
    """(logits, hidden, features, active) out of max-pooled responses of chunks sorted by text."""
    active = np.maximum(pooled + model["bias"], 0)
    first = np.searchsorted(text, np.arange(n_texts))
    counts = np.diff(np.append(first, len(text)))[:, None]
    mean = np.add.reduceat(active, first, axis=0) / counts
    most = np.maximum.reduceat(active, first, axis=0)
    features = np.concatenate([mean, most], axis=1)
    hidden = np.tanh(features @ model["w1"] + model["b1"])
    return hidden @ model["w2"] + model["b2"], hidden, features, active


def probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


# --- training ------------------------------------------------------------------------------


def _all_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk of a text."""
    for batch in batches:
        out = []
        for first, last, data, bounds in groups(batch.column(2)):
            start, text = chunk_starts(bounds)
            cuts = np.searchsorted(text, np.arange(last - first + 1))
            for k in range(last - first):
                own = start[cuts[k] : cuts[k + 1]]
                out.append(read_chunks(data, own, np.full(len(own), bounds[k + 1])).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "chunks"])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int = SAMPLE_BYTES
) -> tuple[list[np.ndarray], np.ndarray]:
    """All chunks and the labels of about ``sample_rows`` labelled documents, drawn by a hash of the id.

    If their chunks take more than ``sample_bytes``, there are fewer
    documents: they are taken in the order of the hash, whole, and one that
    does not fit into what is left is passed over.
    """
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.filter(~held_out(F.col("doc_id")))
    rows = labels.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    # a bounded number of rows: that is what the share is for
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    drawn = labels.filter(place < int(share * PLACES))
    drawn = drawn.groupBy("doc_id").agg(F.max("y").alias("y"))
    id_type = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text")
    found = stage(found, "labelled")
    size = F.greatest(F.lit(1), F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) - (CHUNK - STEP)) / STEP)) * CHUNK
    # one row per drawn document
    sizes = found.groupBy("doc_id").agg(F.sum(size).alias("size")).select("doc_id", "size", place.alias("place")).collect()
    if sum(r["size"] for r in sizes) > sample_bytes:
        fits, left = [], sample_bytes
        for doc_id, bytes_, _ in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
            if bytes_ <= left:
                fits.append((doc_id,))
                left -= bytes_
        fits = docs.sparkSession.createDataFrame(fits, docs.select("doc_id").schema)
        found = found.join(F.broadcast(fits), "doc_id").select("doc_id", "y", "text")
    table = found.mapInArrow(_all_chunks, f"doc_id {id_type}, y double, chunks binary").orderBy("doc_id", "chunks").toArrow()
    chunks = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c in table.column("chunks").to_pylist()]
    return chunks, np.array(table.column("y").to_pylist(), dtype=float)


def train_quality_model(chunks: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Log loss, Adam, batches of texts; the gradient of a maximum goes to where it was taken."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    model = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -1.0, dtype=np.float32),
        "w1": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, dtype=np.float32),
        "w2": np.zeros(HIDDEN, dtype=np.float32),
        "b2": np.array(np.log(share / (1 - share)), dtype=np.float32),
    }
    if not len(y) or y.min() == y.max():
        return with_pairs(model)  # nothing to tell apart: the share of the labels for every text
    names = list(model)
    first = {k: np.zeros_like(model[k]) for k in names}
    second = {k: np.zeros_like(model[k]) for k in names}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            chosen = order[at : at + BATCH]
            step += 1
            gradient = _gradient(with_pairs(model), [chunks[i] for i in chosen], y[chosen])
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * gradient[k]
                second[k] = 0.999 * second[k] + 0.001 * gradient[k] ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model[k] = (model[k] - rate * change).astype(np.float32)
    return with_pairs(model)


def pool(model: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, its position) per chunk and filter, a bounded number of chunks at a time."""
    most, where = [], []
    for at in range(0, len(chunks), CHUNKS_AT_ONCE):
        found = responses(model, chunks[at : at + CHUNKS_AT_ONCE])
        where.append(found.argmax(axis=1))
        most.append(np.take_along_axis(found, where[-1][:, None, :], axis=1)[:, 0])
    return np.concatenate(most), np.concatenate(where)


def _gradient(model: dict, texts: list[np.ndarray], y: np.ndarray) -> dict:
    chunks = np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pooled, where = pool(model, chunks)
    logits, hidden, features, active = combine(model, pooled, text, len(texts))
    d_logit = ((probability(logits) - y) / len(y)).astype(np.float32)
    d_hidden = d_logit[:, None] * model["w2"] * (1 - hidden**2)
    d_features = d_hidden @ model["w1"].T
    counts = np.bincount(text, minlength=len(texts))[:, None]
    d_active = (d_features[:, :FILTERS] / counts)[text]
    is_most = active == features[text, FILTERS:]
    d_active = (d_active + d_features[:, FILTERS:][text] * is_most) * (active > 0)
    d_filters = np.empty((WIDTH, 256, FILTERS), dtype=np.float32)
    rows, columns = np.arange(len(chunks))[:, None], np.arange(FILTERS)
    for k in range(WIDTH):
        cell = chunks[rows, where + k].astype(np.int64) * FILTERS + columns
        d_filters[k] = np.bincount(cell.ravel(), d_active.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {
        "filters": d_filters,
        "bias": d_active.sum(axis=0),
        "w1": features.T @ d_hidden,
        "b1": d_hidden.sum(axis=0),
        "w2": hidden.T @ d_logit,
        "b2": d_logit.sum(),
    }


# --- scoring -------------------------------------------------------------------------------


def score_texts(model: dict, column: pa.Array) -> np.ndarray:
    """The probability of label 1 for every text of a column."""
    out = [np.zeros(0)]
    for first, last, data, bounds in groups(column):
        start, text = chunk_starts(bounds)
        ends = bounds[1:][text]
        pooled = np.empty((len(start), FILTERS), dtype=np.float32)
        for at in range(0, len(start), CHUNKS_AT_ONCE):
            part = slice(at, at + CHUNKS_AT_ONCE)
            pooled[part] = responses(model, read_chunks(data, start[part], ends[part])).max(axis=1)
        out.append(probability(combine(model, pooled, text, last - first)[0]))
    return np.concatenate(out)


def quality_scorer(model: dict):
    """A function for mapInArrow over (doc_id, held_out, text)."""
    slim = {k: v for k, v in model.items() if k != "pairs"}
    key = float(sum(np.abs(v).sum(dtype=float) for v in slim.values()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = kept(("quality", key), lambda: with_pairs(slim))
        for batch in batches:
            found = score_texts(network, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64())]
            columns.append(pa.array((found >= THRESHOLD).astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return score


def held_out(doc_id):
    return F.coalesce(id_remainder(doc_id, 5) == 0, F.lit(False))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    model: dict | None = None,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Without a ``model`` one is trained on a sample of about ``sample_rows``
    labelled documents that are not held out.  Training and scores read whole
    texts; ``sample_bytes`` bounds the number of documents trained on.

    Defined cases: null and empty texts are one chunk of zeros and get a score
    too; null labels are left out, of several labels of a document the largest
    counts; without labels, or with one kind, every text scores their smoothed
    share; an empty table gives no rows; other columns are ignored.
    """
    if model is None:
        model = train_quality_model(*labelled_sample(docs, labels, sample_rows, sample_bytes))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(quality_scorer(model), f"doc_id {id_type}, held_out boolean, score double, predicted int")
