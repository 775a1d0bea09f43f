"""Packing training examples under several limits at once.

A sequence has room for so many tokens, so many segments and so many tokens
that bear a loss.  An example is a vector of demands in these three, and the
next one placed is the one whose vector has the largest dot product with the
room that is left, each dimension weighed by how much of it all examples still
ask for.  When nothing fits a gap, an example is cut and its head fills it; a
sequence that stays short all the same is cut back to a length that needs no
padding.

Only the histogram of demands is planned over.  A choice is taken as often as
the counts allow, so a plan is a list of patterns with multiplicities whose
size is bounded by the number of different demands; an example finds its
pieces by its number among those of equal demand.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headroom.llm.common import blocks_for, fresh, running_totals
from headroom.llm.tokens import encoder
from headroom.session import stage

END_ID = 1
BLOCK_ROWS = 20_000
LOSS_STEPS = 16  # demands on loss are rounded up to this many steps

Demand = tuple[int, int]  # tokens, most tokens that bear a loss


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def demand(self, tokens: int, loss: int) -> Demand:
        """The demand that stands for these numbers: loss is rounded up, never above the tokens."""
        step = max(1, self.tokens // LOSS_STEPS)
        return tokens, min(tokens, -(-loss // step) * step, self.loss)


# --- the plan ----------------------------------------------------------------------------------


@dataclass
class Part:
    """A place in every sequence of a pattern: an example's first ``taken`` tokens, the rest of it stays open."""

    demand: Demand
    taken: int
    rest: Demand | None


class Pool:
    """How many examples of every demand are open, as arrays that grow with new demands."""

    def __init__(self, histogram: dict[Demand, int]):
        self.at: dict[Demand, int] = {}
        self.tokens, self.loss, self.open = (np.zeros(0, dtype=np.int64) for _ in range(3))
        for demand, n in sorted(histogram.items()):
            self.add(demand, n)

    def add(self, demand: Demand, n: int) -> None:
        if demand not in self.at:
            self.at[demand] = len(self.tokens)
            self.tokens, self.loss = np.append(self.tokens, demand[0]), np.append(self.loss, demand[1])
            self.open = np.append(self.open, 0)
        self.open[self.at[demand]] += n

    def demand(self, k: int) -> Demand:
        return int(self.tokens[k]), int(self.loss[k])


def _best(pool: Pool, room: np.ndarray, weights: np.ndarray) -> int | None:
    """The open demand that fits and has the largest dot product with the room."""
    fits = (pool.open > 0) & (pool.tokens <= room[0]) & (pool.loss <= room[2])
    if not fits.any():
        return None
    score = weights[0] * room[0] * pool.tokens + weights[1] * room[1] + weights[2] * room[2] * pool.loss
    return int(np.where(fits, score, -1.0).argmax())


def _to_cut(pool: Pool, room: np.ndarray) -> tuple[int, int] | None:
    """(demand, head): the open demand whose head fills most of the room, the longest of them."""
    if not (pool.open > 0).any():
        return None
    # a head bears no more loss than it has tokens, and no more than the whole
    head = np.where(pool.loss <= room[2], room[0], np.minimum(room[0], room[2]))
    head = np.where(pool.open > 0, np.minimum(head, pool.tokens - 1), 0)
    k = int(np.lexsort((pool.tokens, head))[-1])
    return (k, int(head[k])) if head[k] > 0 else None


def _sequence(pool: Pool, limits: Limits, cut: bool, weights: np.ndarray) -> list[Part]:
    """The parts of the next sequence; they are taken out of the pool."""
    room = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
    parts: list[Part] = []
    while room[0] and room[1]:
        k = _best(pool, room, weights)
        if k is not None:
            part = Part(pool.demand(k), int(pool.tokens[k]), None)
        elif cut and (found := _to_cut(pool, room)):
            k, head = found
            tokens, loss = pool.demand(k)
            part = Part((tokens, loss), head, limits.demand(tokens - head, min(loss, tokens - head)))
        else:
            break
        pool.open[k] -= 1
        room -= (part.taken, 1, min(part.taken, part.demand[1]))
        parts.append(part)
    return _cut_back(pool, limits, parts) if cut else parts


def _cut_back(pool: Pool, limits: Limits, parts: list[Part]) -> list[Part]:
    """A short sequence cut back to a power of two, which needs no padding."""
    tokens = sum(p.taken for p in parts)
    over = 0 if tokens == limits.tokens else tokens - (1 << (tokens.bit_length() - 1))
    while over:
        last = parts.pop()
        gone = min(over, last.taken)
        over -= gone
        if gone < last.taken:
            whole, loss = last.demand
            left = whole - last.taken + gone
            parts.append(Part(last.demand, last.taken - gone, limits.demand(left, min(loss, left))))
        else:
            pool.open[pool.at[last.demand]] += 1
    return parts


def plan(histogram: dict[Demand, int], limits: Limits, cut: bool = True) -> list[tuple[list[Part], int]]:
    """(parts, times) of every kind of sequence, for examples that fit a sequence each."""
    pool = Pool(histogram)
    size = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    patterns = []
    while (pool.open > 0).any():
        asked = np.array([pool.open @ pool.tokens, pool.open.sum(), pool.open @ pool.loss], dtype=float)
        weights = asked / size / size**2  # how much is asked for; room and demand as parts of the limit
        parts = _sequence(pool, limits, cut, weights)
        uses: dict[Demand, int] = defaultdict(int)
        for p in parts:
            uses[p.demand] += 1
        more = min(int(pool.open[pool.at[d]]) // n for d, n in uses.items())
        for d, n in uses.items():
            pool.open[pool.at[d]] -= more * n
        for p in parts:
            if p.rest is not None:
                pool.add(p.rest, 1 + more)
        patterns.append((parts, 1 + more))
    return patterns


@dataclass
class Piece:
    """Where the examples of an interval of numbers put one of their pieces.

    Example ``first`` of the interval goes to ``sequence`` at ``offset``, the
    next one to the next sequence; ``start`` counts from the example's begin.
    """

    start: int
    length: int
    sequence: int
    offset: int


class Places:
    """The pieces of the k-th example of a demand, out of a plan."""

    def __init__(self, histogram: dict[Demand, int], patterns: list[tuple[list[Part], int]]):
        used: dict[Demand, int] = defaultdict(int)
        added = defaultdict(int, histogram)
        # demand -> (first number, sequence, offset, taken, demand of the rest, its first number)
        steps: dict[Demand, list[tuple]] = defaultdict(list)
        self.sequences = 0
        for parts, times in patterns:
            offset, rests = 0, []
            for p in parts:
                steps[p.demand].append([used[p.demand], self.sequences, offset, p.taken, p.rest, None])
                used[p.demand] += times
                if p.rest is not None:
                    rests.append((steps[p.demand][-1], p.rest))
                offset += p.taken
            for step, rest in rests:
                step[5] = added[rest]
                added[rest] += times
            self.sequences += times
        self.steps = dict(steps)
        self.firsts = {d: [s[0] for s in found] for d, found in steps.items()}

    def pieces(self, demand: Demand, number: int) -> list[Piece]:
        found, start = [], 0
        while True:
            step = self.steps[demand][bisect.bisect_right(self.firsts[demand], number) - 1]
            first, sequence, offset, taken, rest, rest_first = step
            found.append(Piece(start, taken, sequence + number - first, offset))
            if rest is None:
                return found
            start, demand, number = start + taken, rest, rest_first + number - first


# --- the examples --------------------------------------------------------------------------------


def cut_long(n: int, prompt: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, length, loss) of parts that fit a sequence; loss is borne behind the prompt."""
    parts, at = [], 0
    while at < n:
        before = max(0, prompt - at)
        length = min(limits.tokens, n - at, before + limits.loss)
        parts.append((at, length, max(0, length - before)))
        at += length
    return parts


def _encoded(path: str, limits: Limits, end_id: int, keep_all: bool):
    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc, start, length, demand, crc, tokens, held = [], [], [], [], [], [], []
            for doc_id, prompt, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                head = encode.encode(prompt.as_py())
                ids = head + encode.encode(text.as_py()) + last
                for at, n, loss in cut_long(len(ids) // 4, len(head) // 4, limits):
                    part = ids[4 * at : 4 * (at + n)]
                    doc.append(doc_id)
                    start.append(at)
                    length.append(n)
                    demand.append(limits.demand(n, loss)[1])
                    crc.append(zlib.crc32(part))
                    tokens.append(len(ids) // 4)
                    held.append(part if keep_all or n < limits.tokens else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, batch.schema.types[0]),
                    *[pa.array(c, pa.int64()) for c in (start, length, demand, crc, tokens)],
                    pa.array(held, pa.binary()),
                ],
                names=["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens", "ids"],
            )

    return encode_all


def _placed(places: Places):
    """(key, pieces) of rows (key, length, loss, number)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, length, loss, number = (c.to_pylist() for c in batch.columns)
            found = [
                [(p.start, p.length, p.sequence, p.offset) for p in places.pieces((t, b), n)]
                for t, b, n in zip(length, loss, number, strict=True)
            ]
            fields = [pa.field(name, pa.int64()) for name in ("start", "length", "sequence", "offset")]
            rows = [[dict(zip(("start", "length", "sequence", "offset"), p, strict=True)) for p in ps] for ps in found]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rows, pa.list_(pa.struct(fields)))], names=["key", "pieces"])

    return place


def _with_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ids, pieces) as (key, start, length, sequence, offset, ids_crc32, ids), a piece each."""
    for batch in batches:
        ids = batch.column(1)
        out = [[] for _ in range(7)]
        for row, (key, pieces) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            whole = ids[row].as_py()
            for p in pieces:
                part = whole[4 * p["start"] : 4 * (p["start"] + p["length"])]
                values = (key, p["start"], p["length"], p["sequence"], p["offset"], zlib.crc32(part), part)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
        names = ["key", "start", "length", "sequence", "offset", "ids_crc32", "ids"]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:6]], pa.array(out[6], pa.binary())], names=names)


PIECES = "array<struct<start:long,length:long,sequence:long,offset:long>>"


def pack_examples(
    docs: DataFrame,
    path: str,
    limits: Limits = Limits(),  # noqa: B008
    end_id: int = END_ID,
    prompt: str | None = None,
    cut: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    An example is the ids of the column ``prompt``, which bear no loss, if one
    is named, those of ``text``, and ``end_id``.  Examples beyond a limit are
    cut into parts that fit; a part of full length is a sequence by itself.
    With ``cut`` other examples are cut too where that saves padding: every
    sequence is then full or has a power of two of tokens.  No sequence
    exceeds a limit; loss is counted by an upper bound, rounded to a sixteenth
    of a sequence.

    Texts are encoded once.  The driver sees one count per demand, at most
    tokens times ``LOSS_STEPS`` of them; the plan goes to the tasks and is
    bounded likewise.  Ids are written once and shuffled once, to meet the
    examples that are cut; those are few, as a gap is first filled whole.

    Defined cases: null and empty texts are the end id alone; null ids and
    repeated rows are examples like others; equal demands are told apart by
    the place of a row; very long texts are encoded whole and cut; an empty
    table gives no rows; other columns are ignored.  ``path`` is the tokenizer
    file, found on every executor.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be 1 at least")
    asked = F.lit(None).cast("string") if prompt is None else F.col(prompt)
    rows = docs.select("doc_id", asked.alias(fresh("prompt", ["doc_id", "text"])), "text")
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, start long, length long, loss long, ids_crc32 long, doc_tokens long, ids binary"
    encoded = rows.mapInArrow(_encoded(path, limits, end_id, with_ids), schema)
    encoded = stage(encoded.withColumn("key", F.monotonically_increasing_id()), "examples")
    full = F.col("length") == limits.tokens
    open_ = encoded.filter(~full)
    histogram = {(r[0], r[1]): r[2] for r in open_.groupBy("length", "loss").count().collect()}
    places = Places(histogram, plan(histogram, limits, cut))

    blocks = blocks_for(sum(histogram.values()), BLOCK_ROWS)
    narrow = open_.select("key", "length", "loss")
    numbered = running_totals(narrow, ["length", "loss"], ["key"], {"number": F.lit(1)}, blocks)
    numbered = numbered.select("key", "length", "loss", F.col("number").cast("long").alias("number"))
    placed = stage(numbered.mapInArrow(_placed(places), f"key long, pieces {PIECES}"), "placed")
    several = F.lit(True) if with_ids else F.size("pieces") > 1
    one = placed.filter(~several).select("key", F.inline("pieces").alias("at", "_length", "sequence", "offset"))
    told = encoded.select("key", "doc_id", F.col("start").alias("begin"), "doc_tokens")
    of_one = encoded.drop("ids", "loss").join(one, "key")
    pieces = of_one.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")
    ids = encoded.select("key", "ids").join(placed.filter(several), "key").select("key", "ids", "pieces")
    checked = ids.mapInArrow(
        _with_checksums, "key long, start long, length long, sequence long, offset long, ids_crc32 long, ids binary"
    )
    more = told.join(checked, "key")
    columns = [
        "doc_id", (F.col("begin") + F.col("start")).alias("start"), "length", "ids_crc32", "doc_tokens",
        F.col("sequence").alias("sequence_id"), "offset",
    ]
    whole = encoded.filter(full).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("key") + places.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )
    if with_ids:
        return more.select(*columns, "ids").unionByName(whole)
    return pieces.unionByName(more.select(*columns)).unionByName(whole)
