import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import ROWS, TOKENIZER, documents, no_documents, odd_documents
from tokenizers import Tokenizer

from headroom.llm import packing, tokens
from headroom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(tokenizer, data_folder):
    encode = tokens.Encoder(TOKENIZER)
    odd = ["", " ", "\n\n", " a", "a \n b", "a\t\tb", "don't  we'll", "x\x1cy \x85z\xa0 q", "日本語 テキスト 🙂🙂", "1234 5,6", "é" * 700]
    for text in [*documents(data_folder).values(), *(r[1] for r in ROWS), *odd]:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_other_tokenizers_are_refused(tmp_path):
    Tokenizer.from_file(TOKENIZER).save(str(tmp_path / "t.json"))
    text = (tmp_path / "t.json").read_text().replace('"ByteLevel"', '"Whitespace"', 1)
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(ValueError, match="byte-level|merges"):
        tokens.read_vocabulary(str(tmp_path / "t.json"))


# --- sections ----------------------------------------------------------------------------


def sections_of(tokenizer, source, text):
    """(field, section, start, n_chars, n_tokens, n_crossing) by the tokenizer's own offsets."""
    parts = [("source", 0, 0, source or "")]
    at = 0
    for k, line in enumerate((text or "").split("\n")):
        parts.append(("text", k, at, line))
        at += len(line) + 1
    whole = "\n".join(p[3] for p in parts)
    ends = np.cumsum([len(p[3]) + 1 for p in parts])
    ends[-1] -= 1
    counts, crossing = [0] * len(parts), [0] * len(parts)
    for begin, end in tokenizer.encode(whole, add_special_tokens=False).offsets:
        place = next(k for k, e in enumerate(ends) if begin < e)
        counts[place] += 1
        crossing[place] += end > ends[place]
    return [(f, k, s, len(x), c, o) for (f, k, s, x), c, o in zip(parts, counts, crossing, strict=True)]


def test_section_counts_equal_offsets(spark, tokenizer):
    rows = [(1, "web", "one two\n\n\n  three\nfour"), (2, None, "\n\n"), (3, "a\nb", None), (4, "", ""), (5, "x", "tail\n \n\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = defaultdict(list)
    for r in tokens.section_tokens(df, TOKENIZER).collect():
        got[r[0]].append(tuple(r[1:]))
    for doc_id, source, text in rows:
        assert sorted(got[doc_id]) == sorted(sections_of(tokenizer, source, text))
    assert any(r[-1] for rows in got.values() for r in rows)  # some token crosses


def test_section_query_adds_up(spark, data_folder, tokenizer):
    import duckdb

    wanted = {
        i: len(ids_of(tokenizer, f"{s}\n{t}"))
        for i, s, t in duckdb.sql(f"SELECT doc_id, source, text FROM '{data_folder}/documents.parquet'").fetchall()
    }
    total = QUERIES["op5_token_counts"](spark, data_folder).groupBy("doc_id").sum("n_tokens")
    assert {r[0]: r[1] for r in total.collect()} == wanted


def test_section_odd_cases(spark):
    got = tokens.section_tokens(odd_documents(spark), TOKENIZER).groupBy("doc_id").count().collect()
    wanted = Counter()
    for doc_id, text, *_ in ROWS:
        wanted[doc_id] += 1 + len((text or "").split("\n"))
    assert {r[0]: r[1] for r in got} == wanted
    assert tokens.section_tokens(no_documents(spark), TOKENIZER).count() == 0


# --- packing -----------------------------------------------------------------------------


def check_packing(rows, texts, tokenizer, size=1024, end_id=2):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for doc_id, text in texts:
        ids = [*ids_of(tokenizer, text), end_id]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        copies = sum(i == doc_id for i, _ in texts)
        pieces = pieces[::copies]
        at = 0
        for k, r in enumerate(pieces):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert k == 0 or r["length"] == size
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing_query(spark, data_folder, tokenizer):
    texts = list(documents(data_folder).items())
    rows = QUERIES["op10_packing"](spark, data_folder).collect()
    n = check_packing(rows, texts, tokenizer)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 2


def test_packing_odd_cases(spark, tokenizer):
    rows = packing.pack_documents(odd_documents(spark), TOKENIZER).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS], tokenizer)
    assert packing.pack_documents(no_documents(spark), TOKENIZER).count() == 0


def test_ids_can_be_carried(spark, tokenizer):
    df = spark.createDataFrame([(1, "one two three " * 40), (2, "four")], "doc_id long, text string")
    for r in packing.pack_documents(df, TOKENIZER, size=50, with_ids=True).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


def fewest_sequences(lengths, size):
    """By trying everything, for a handful of lengths."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, gaps):
        if len(gaps) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(gaps)
            return
        for g in sorted({g for g in gaps if g >= lengths[k]}):
            rest = list(gaps)
            rest.remove(g)
            place(k + 1, [*rest, g - lengths[k]])
        place(k + 1, [*gaps, size - lengths[k]])

    place(0, [])
    return best[0]


def test_plans_are_whole_and_near_the_best():
    rng = np.random.default_rng(6)
    over = 0
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 10)).tolist()
        plan = packing.plan_packing(Counter(lengths), 20)
        used = Counter()
        for pattern, times in plan:
            assert sum(a * b for a, b in pattern) <= 20
            for length, each in pattern:
                used[length] += each * times
        assert used == Counter(lengths)
        over += sum(t for _, t in plan) - fewest_sequences(lengths, 20)
    assert over <= 2


def test_large_plans_are_close_to_full():
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.lognormal(5.5, 1, 300_000).astype(int) % 1024 + 1, 1024)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan_packing(histogram)
    assert sum(t for _, t in plan) <= 1.001 * lengths.sum() / 1024
    assert len(packing.places(plan)) < 20_000  # does not grow with the pieces


def test_complements_are_exact():
    counts = packing.Counts({700: 4, 324: 1, 300: 2, 24: 2, 200: 1, 100: 1}, 1024)
    found = packing.exact_complements(counts, 1024)
    assert {tuple(a for a, _ in p): t for p, t in found.items()} == {(700, 324): 1, (700, 300, 24): 2}
    assert counts.left[700] == 1


def test_cut_pieces():
    for n, size in itertools.product((1, 9, 10, 11, 20, 25), (10,)):
        pieces = packing.cut_pieces(n, size)
        assert [a for a, _ in pieces] == [0, *np.cumsum([b for _, b in pieces])[:-1]]
        assert sum(b for _, b in pieces) == n and all(b == size for _, b in pieces[1:])
