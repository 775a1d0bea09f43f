"""How far apart the sources of a language are in their words.

Every (language, source) group gives every kept term of its language a
smoothed share p in billionths, in whole numbers.  Groups are sorted arrays of
(term id, count), cut into ranges of term ids so that an array has a bounded
length.  Two arrays of a range meet once per unordered pair of sources: the
shorter one gallops through the longer one, terms of both are priced by both
counts, terms of one by its count against the other's share of an unseen term,
and the terms of neither by their number alone.  The sum holds both ways.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from headroom.session import stage

LEAST_DOCUMENTS = 30
ADDED = 5  # to every count
UNIT = 1_000_000_000  # shares are in billionths
TOP_TERMS = 50
RANGE_BITS = 15  # term ids of one array: 32,768 at most
STRIDE = 32  # needles that gallop from one anchor
PIECE_BYTES = 1 << 20
HELD_TERMS = 200_000  # counts a task holds before it hands them on

# fixed values: terms are runs of letters A-Z, a-z and bytes above ASCII; A-Z count as a-z
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


# --- counts ----------------------------------------------------------------------------------


def text_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece of a long text at a time."""
    plain = data.translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        end = len(plain)
        if end - at > PIECE_BYTES:
            cut = plain.find(b" ", at + PIECE_BYTES)
            end = end if cut < 0 else cut
        yield plain[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, documents) summed over some documents of a partition."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    holders: dict[tuple, Counter] = defaultdict(Counter)
    added = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            own, group = set(), (lang, source)
            for terms in text_terms(text.as_buffer().to_pybytes()):
                counts[group].update(terms)
                own.update(terms)
            before = len(holders[group])
            holders[group].update(own)
            added += len(holders[group]) - before
            if added > HELD_TERMS:
                yield from _handed_on(counts, holders)
                counts.clear()
                holders.clear()
                added = 0
    yield from _handed_on(counts, holders)


def _handed_on(counts: dict, holders: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), found in counts.items():
        n = len(found)
        if n:
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                    pa.array([holders[lang, source][t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of every term in every group."""
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


# --- shares ----------------------------------------------------------------------------------


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)), digits of the quotient three at a time.

    Whole 64-bit numbers hold every step for totals up to 9 * 10^15.
    """
    rest, under, out = count + ADDED, total + ADDED * kept, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, under)
        rest = rest % under
    return out + 1


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """As ``share``, over an array of counts."""
    rest, under, out = np.asarray(count, dtype=np.int64) + ADDED, total + ADDED * kept, 0
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // under, rest * 1000 % under
    return out + 1


# --- pairs of sources --------------------------------------------------------------------------


def gallop(needles: np.ndarray, hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common values in two sorted arrays of distinct values.

    The shorter array's values are the needles.  Every ``STRIDE``-th needle is
    an anchor found by bisection; the needles behind it gallop on from there,
    side by side, doubling their steps until they have passed their value.
    """
    if len(needles) > len(hay):
        there, here = gallop(hay, needles)
        return here, there
    if not len(needles):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = np.repeat(np.searchsorted(hay, needles[::STRIDE]), STRIDE)[: len(needles)]
    high, step, last = low.copy(), 1, len(hay) - 1
    open_ = np.arange(len(needles))
    while len(open_ := open_[(high[open_] <= last) & (hay[np.minimum(high[open_], last)] < needles[open_])]):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, len(hay))
        step *= 2
    # the first value that is not smaller lies in [low, high]
    while (wide := np.flatnonzero(low < high)).size:
        middle = (low[wide] + high[wide]) // 2
        less = hay[middle] < needles[wide]
        low[wide] = np.where(less, middle + 1, low[wide])
        high[wide] = np.where(less, high[wide], middle)
    hit = np.flatnonzero((low <= last) & (hay[np.minimum(low, last)] == needles))
    return hit, low[hit]


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, apart, met) of every row: two arrays of one range, either may be missing."""
    for batch in batches:
        held = {name: batch.column(name) for name in batch.schema.names}
        apart, met = [], []

        def numbers(name: str, row: int, held=held) -> np.ndarray:
            value = held[name][row]
            return np.frombuffer(value.as_buffer() if value.is_valid else b"", dtype="<i8")

        for row in range(batch.num_rows):
            ids_a, ids_b, n_a, n_b = (numbers(name, row) for name in ("ids_a", "ids_b", "n_a", "n_b"))
            total_a, total_b, kept = (held[name][row].as_py() for name in ("total_a", "total_b", "kept"))
            p_a, p_b = shares(n_a, total_a, kept), shares(n_b, total_b, kept)
            none_a, none_b = (int(shares(np.zeros(1), total, kept)[0]) for total in (total_a, total_b))
            i, j = gallop(ids_a, ids_b)
            only_a, only_b = np.ones(len(ids_a), dtype=bool), np.ones(len(ids_b), dtype=bool)
            only_a[i] = only_b[j] = False
            both = np.abs(p_a[i] - p_b[j]).sum()
            apart.append(int(both + np.abs(p_a[only_a] - none_b).sum() + np.abs(p_b[only_b] - none_a).sum()))
            met.append(len(ids_a) + len(ids_b) - len(i))
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["lang", "a", "b"]).columns, pa.array(apart, pa.int64()), pa.array(met, pa.int64())],
            names=["lang", "a", "b", "apart", "met"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of (id, n) as two strings of little-endian 64-bit numbers, sorted by id."""
    for batch in batches:
        ids, counts = [], []
        for entries in batch.column(3):
            pair = entries.values
            id_, n = (pair.field(k).to_numpy().astype("<i8") for k in ("id", "n"))
            order = np.argsort(id_)
            ids.append(id_[order].tobytes())
            counts.append(n[order].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
            names=["lang", "source", "range", "ids", "n"],
        )


def source_pairs(groups: DataFrame, counted: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of every two sources of a language, both ways.

    ``groups``: (lang, source, total, kept), one row each; ``counted``: (lang,
    source, id, n) of kept terms.  A pair is one small task per range of term
    ids; only a number per range leaves it.
    """
    entries = counted.withColumn("range", F.shiftright("id", RANGE_BITS)).groupBy("lang", "source", "range")
    entries = entries.agg(F.collect_list(F.struct("id", "n")).alias("entries"))
    arrays = stage(entries.mapInArrow(_packed, "lang string, source string, range long, ids binary, n binary"), "term-arrays")
    sides = [groups.select("lang", F.col("source").alias(k), F.col("total").alias(f"total_{k}"), "kept") for k in ("a", "b")]
    pairs = stage(sides[0].join(sides[1].drop("kept"), "lang").filter("a < b"), "source-pairs")
    held = [
        arrays.select("lang", F.col("source").alias(k), "range", F.col("ids").alias(f"ids_{k}"), F.col("n").alias(f"n_{k}"))
        for k in ("a", "b")
    ]
    first = pairs.join(held[0], ["lang", "a"])
    second = pairs.select("lang", "a", "b").join(held[1], ["lang", "b"])
    met = first.drop("total_a", "total_b", "kept").join(second, ["lang", "a", "b", "range"], "full").join(pairs, ["lang", "a", "b"])
    numbers = ("total_a", "total_b", "kept")
    met = met.select("lang", "a", "b", "ids_a", "n_a", "ids_b", "n_b", *numbers)
    priced = met.mapInArrow(_priced, "lang string, a string, b string, apart long, met long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.sum("met").alias("met"))
    none = [share(F.lit(0).cast("long"), F.col(f"total_{k}"), F.col("kept")) for k in ("a", "b")]
    absent = (F.col("kept") - F.coalesce("met", F.lit(0))) * F.abs(none[0] - none[1])
    value = F.when(F.col("kept") > 0, F.coalesce("apart", F.lit(0)) + absent).otherwise(F.lit(0)).cast("long")
    summed = pairs.join(priced, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])
    return summed.select("lang", F.inline(ways), "value")


# --- the operator --------------------------------------------------------------------------------


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    Part ``pair``: the difference to every other source of the language,
    summed over the kept terms.  Part ``term``: the ``top`` terms the source
    has a larger share of than its language, by the difference.  Kept are the
    terms of at least ``least_documents`` documents of a language.  Ranks go
    down by value, then up by item, per group and part.

    Terms are counted per task before anything is shuffled; no group, term or
    language is collected.  Pairs are as many as the answer has rows.

    Defined cases: null text, lang and source: empty; groups without terms
    count nothing and are paired like others; a language without kept terms has differences of 0 and no
    terms; repeated rows are documents each; long texts are read whole, a
    piece at a time; ids and other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("lang", "source", "text")
    counted = stage(term_counts(docs), "term-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("documents").alias("documents"))
    kept = kept.filter(F.col("documents") >= least_documents).drop("documents").repartition("lang", "term")
    # ids ascend within a written partition, so a range of them is a bounded part of one
    kept = stage(kept.withColumn("id", F.monotonically_increasing_id()), "kept-terms")
    counted = stage(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "id", "in_lang"), "kept-counts")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total"))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*texts).distinct()
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = stage(groups, "groups")

    pairs = source_pairs(groups, counted.select("lang", "source", "id", "n")).withColumn("part", F.lit("pair"))
    of_group = counted.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    terms = of_group.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).select(columns)
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select(columns))
