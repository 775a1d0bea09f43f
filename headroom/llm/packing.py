"""Packing token sequences by exact complements, then best fit.

Only the histogram of lengths is planned over.  Going down from the longest,
a length's gap is filled exactly by one length, else by a pair, else by a
triple, as long as the counts last; each choice is taken as often as they
allow.  What is left is packed best fit, longest first.  Short pieces fit
almost anywhere, so plans are made that keep the shortest lengths back from
exact fills, each for another bound, and the plan with the fewest sequences is
taken.  A plan is a short list of patterns with multiplicities, and the k-th
piece of a length finds its place by its number alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from headroom.llm.common import blocks_for, running_totals
from headroom.llm.tokens import encoder
from headroom.session import stage

LENGTH = 1024
END_ID = 2
BLOCK_ROWS = 20_000
RESERVES = (0, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1)  # lengths kept back from pairs and triples, as a part of the size

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), in their order in the sequence


# --- the plan ----------------------------------------------------------------------------


class Counts:
    """How many pieces of each length are left; pairs and triples use lengths from ``reserve`` on."""

    def __init__(self, histogram: dict[int, int], size: int, reserve: int = 1):
        self.reserve = max(reserve, 1)
        self.left = np.zeros(size + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.left[length] = n

    def available(self, parts: tuple[int, ...]) -> int:
        """How often all of ``parts`` can be taken together."""
        return min(int(self.left[p]) // parts.count(p) for p in parts)

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that add up to ``gap``, the larger as large as can be."""
        larger = np.arange(gap - self.reserve, (gap - 1) // 2, -1)
        smaller = gap - larger
        there = (self.left[larger] > 0) & (self.left[smaller] > (larger == smaller))
        k = int(there.argmax()) if len(there) else 0
        return (int(larger[k]), int(smaller[k])) if len(there) and there[k] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths that add up to ``gap``, the largest as large as can be."""
        for largest in range(gap - 2 * self.reserve, (gap - 1) // 3, -1):
            if not self.left[largest]:
                continue
            self.left[largest] -= 1
            rest = self.pair(gap - largest)
            self.left[largest] += 1
            if rest is not None:
                return (largest, *rest)
        return None


def exact_complements(counts: Counts, size: int) -> dict[Pattern, int]:
    """Patterns that fill a sequence to the last token; takes their pieces out of ``counts``."""
    patterns: dict[Pattern, int] = defaultdict(int)
    for length in range(size, 0, -1):
        while counts.left[length]:
            gap = size - length
            counts.left[length] -= 1  # one piece is the sequence's first
            fill = () if not gap else counts.one(gap) or counts.pair(gap) or counts.triple(gap)
            counts.left[length] += 1
            if fill is None:
                break
            parts = (length, *fill)
            times = counts.available(parts)
            for p in parts:
                counts.left[p] -= times
            patterns[tuple((p, 1) for p in parts)] += times
    return patterns


def best_fit(counts: Counts, size: int) -> dict[Pattern, int]:
    """Best fit, longest first, over what is left: many equal sequences at a time."""
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)  # gap -> pattern -> how many

    def put(gap: int, pattern: Pattern, times: int) -> None:
        open_[gap][pattern] = open_[gap].get(pattern, 0) + times

    for length in range(size, 0, -1):
        left = int(counts.left[length])
        while left:
            gap = next((g for g in range(length, size + 1) if open_.get(g)), None)
            if gap is None:
                each = size // length
                for n in (each, left % each):
                    times = left // each if n == each else 1
                    if n and times:
                        put(size - n * length, ((length, n),), times)
                left = 0
                break
            pattern, times = next(iter(open_[gap].items()))
            taken = min(times, left)
            if taken == times:
                del open_[gap][pattern]
            else:
                open_[gap][pattern] = times - taken
            put(gap - length, (*pattern, (length, 1)), taken)
            left -= taken
        counts.left[length] = 0
    packed: dict[Pattern, int] = defaultdict(int)
    for patterns in open_.values():
        for pattern, times in patterns.items():
            packed[pattern] += times
    return packed


def plan_packing(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[Pattern, int]]:
    """(pattern, times) for every kind of sequence: the plan of the best reserve."""
    plans = []
    for reserve in RESERVES:
        counts = Counts(histogram, size, int(reserve * size))
        patterns = exact_complements(counts, size)
        for pattern, times in best_fit(counts, size).items():
            patterns[pattern] += times
        plans.append(patterns)
    return sorted(min(plans, key=lambda p: sum(p.values())).items())


def places(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, each, sequence, offset): where the pieces of a length go by their number.

    Pieces first to last - 1 go to sequences from ``sequence`` on, ``each``
    to a sequence, from ``offset`` on.
    """
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            first = used[length]
            used[length] += times * each
            rows.append((length, first, used[length], each, sequence, offset))
            offset += length * each
        sequence += times
    return rows


# --- the documents -------------------------------------------------------------------------


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    if n <= size:
        return [(0, n)]
    rest = n % size
    first = [(0, rest)] if rest else []
    return first + [(at, size) for at in range(rest, n, size)]


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc, held = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encode.encode(text.as_py()) + last
                for k, (at, n) in enumerate(cut_pieces(len(found) // 4, size)):
                    part = found[4 * at : 4 * (at + n)]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part)
            columns = [
                pa.array(ids, batch.schema.types[0]),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def token_pieces(docs: DataFrame, path: str, size: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as pieces of at most ``size`` tokens."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_pieces(path, size, end_id, with_ids), schema + (", ids binary" if with_ids else ""))


def pack_documents(
    docs: DataFrame, path: str, size: int = LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    Documents are encoded once, whole, and closed by ``end_id``.  The driver
    sees one count per length.  Pieces are numbered within their length and
    find their sequence in a table of the plan, whose size is bounded by the
    number of lengths and not by the documents.

    Defined cases: null and empty texts are the end id alone; documents above
    ``size`` are cut, the first piece may be shorter; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.  ``path``
    is the tokenizer file, found on every executor.
    """
    spark: SparkSession = docs.sparkSession
    pieces = stage(token_pieces(docs, path, size, end_id, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = places(plan_packing(histogram, size))
    schema = "length long, _first long, _last long, _each long, _sequence long, _offset long"
    table = spark.createDataFrame(rows, schema)
    blocks = blocks_for(sum(histogram.values()), BLOCK_ROWS)
    order = ["doc_id", "start", "ids_crc32"]
    numbered = running_totals(pieces, ["length"], order, {"_number": F.lit(1)}, blocks).drop("_block")
    at = F.col("_number") - F.col("_first")
    inside = (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_last"))
    placed = numbered.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    sequence = (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long")
    offset = (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long")
    return placed.select(*pieces.columns[:5], sequence.alias("sequence_id"), offset.alias("offset"), *pieces.columns[5:])
