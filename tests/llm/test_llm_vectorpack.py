import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import ROWS, TOKENIZER, documents, no_documents, odd_documents
from tokenizers import Tokenizer

from headroom.llm import vectorpack
from headroom.llm.queries import QUERIES
from headroom.llm.vectorpack import Limits


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, examples, size=2048, segments=64):
    """Every id of every example (doc_id, ids) lies in one piece, pieces of a sequence lie end to end; {sequence: length}."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    wanted = defaultdict(list)
    for doc_id, ids in examples:
        wanted[doc_id].append(ids)
    assert set(by_doc) == set(wanted)
    for doc_id, texts in wanted.items():
        covered = Counter()
        for r in by_doc[doc_id]:
            spans = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for t in texts if len(t) == r["doc_tokens"]}
            assert r["ids_crc32"] in spans and r["length"] > 0
            covered.update((r["doc_tokens"], k) for k in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter((len(t), k) for t in texts for k in range(len(t)))
    lengths = {}
    for sequence, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and len(pieces) <= segments
        lengths[sequence] = at
    return lengths


def padding(lengths, size=2048):
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths)


def test_packing_query(spark, data_folder, tokenizer):
    rows = QUERIES["op13_vector_packing"](spark, data_folder).collect()
    examples = [(i, [*ids_of(tokenizer, t), 1]) for i, t in documents(data_folder).items()]
    lengths = check(rows, examples)
    assert padding(lengths.values()) == 0
    tokens = sum(lengths.values())
    assert len(lengths) <= tokens // 2048 + 12  # full ones, and powers of two at the end
    assert len(rows) <= tokens // 2048 + 1.5 * len(examples)


def test_packing_odd_cases(spark, tokenizer):
    docs = odd_documents(spark)
    for name in ("prompt", "start", "length", "loss", "ids", "number", "pieces", "sequence"):
        docs = docs.withColumn(name, docs["lang"])
    examples = [(r[0], [*ids_of(tokenizer, r[1]), 1]) for r in ROWS]
    lengths = check(vectorpack.pack_examples(docs, TOKENIZER).collect(), examples)
    assert padding(lengths.values()) == 0
    assert vectorpack.pack_examples(no_documents(spark), TOKENIZER).count() == 0
    uncut = check(vectorpack.pack_examples(docs, TOKENIZER, cut=False).collect(), examples)
    assert sum(uncut.values()) == sum(lengths.values())


def test_instructions_meet_all_limits(spark, tokenizer):
    rng = np.random.default_rng(11)
    rows = [(i, "ask " * int(rng.integers(0, 150)), "say it " * int(rng.integers(0, 60))) for i in range(300)]
    rows += [(900, None, None), (901, "ask " * 700, ""), (902, "", "say it " * 400)]
    limits = Limits(tokens=256, segments=5, loss=64)
    df = spark.createDataFrame(rows, "doc_id long, ask string, text string")
    for cut in (True, False):
        got = vectorpack.pack_examples(df, TOKENIZER, limits, prompt="ask", cut=cut, with_ids=True).collect()
        examples = [(i, [*ids_of(tokenizer, a), *ids_of(tokenizer, t), 1]) for i, a, t in rows]
        lengths = check(got, examples, 256, 5)
        prompts = {i: len(ids_of(tokenizer, a)) for i, a, _ in rows}
        loss = Counter()
        for r in got:
            loss[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(r["start"], prompts[r["doc_id"]]))
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        assert max(loss.values()) <= 64
        if cut:
            assert all(n & (n - 1) == 0 for n in lengths.values())


def test_many_examples_of_one_length(spark, tokenizer):
    rows = [(i, "") for i in range(3000)] + [(10_000 + i, "word " * 900) for i in range(40)]
    got = vectorpack.pack_examples(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    lengths = check(got, [(i, [*ids_of(tokenizer, t), 1]) for i, t in rows])
    assert padding(lengths.values()) == 0


def expand(histogram, limits, cut):
    """Every example's pieces, and what every sequence holds."""
    patterns = vectorpack.plan(histogram, limits, cut)
    places = vectorpack.Places(histogram, patterns)
    held = defaultdict(list)
    for demand, n in histogram.items():
        for k in range(n):
            pieces = places.pieces(demand, k)
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
            assert sum(p.length for p in pieces) == demand[0]
            for p in pieces:
                held[p.sequence].append((p.offset, p.length, min(p.length, demand[1])))
    assert set(held) == set(range(places.sequences))
    return held


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_the_limits(seed):
    rng = np.random.default_rng(seed)
    limits = Limits(int(rng.integers(4, 40)), int(rng.integers(1, 6)), int(rng.integers(2, 40)))
    histogram = Counter()
    for n in rng.integers(1, limits.tokens + 1, 80):
        loss = min(int(rng.integers(0, n + 1)), limits.loss)
        histogram[limits.demand(int(n), loss)] += int(rng.integers(1, 5))
    for cut in (True, False):
        for parts in expand(dict(histogram), limits, cut).values():
            at = 0
            for offset, length, _ in sorted(parts):
                assert offset == at
                at += length
            assert at <= limits.tokens and len(parts) <= limits.segments
            assert sum(loss for *_, loss in parts) <= limits.loss
            assert not cut or at == limits.tokens or at & (at - 1) == 0


def test_the_dot_product_spreads_what_is_scarce():
    """Loss is as scarce as tokens: long prompts go with short ones that are all loss."""
    limits = Limits(tokens=100, segments=10, loss=50)
    histogram = {(75, 0): 40, (25, 25): 80, (50, 0): 40}
    patterns = vectorpack.plan(histogram, limits, cut=False)
    assert sum(n for _, n in patterns) <= 1.1 * (40 * 75 + 80 * 25 + 40 * 50) / 100


def test_plans_do_not_grow_with_the_examples():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.lognormal(6, 1.1, 50_000).astype(int) % 2047 + 1, return_counts=True)
    sizes = [len(vectorpack.plan({(int(n), int(n)): int(k) * many for n, k in zip(lengths, counts, strict=True)}, Limits())) for many in (1, 1000)]
    assert sizes[1] <= 1.5 * sizes[0] and max(sizes) < 4 * 2048
