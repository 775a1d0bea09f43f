import zlib
from collections import Counter

import numpy as np
from llm_cases import TOKENIZER, near_components, words
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from headroom.llm import mixing
from headroom.llm.queries import ORACLES, QUERIES


def test_registry():
    names = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == set(QUERIES) and {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_stages_one_by_one(spark, data_folder, tmp_path):
    """Every stage against what a plain form keeps of its own input."""
    source = spark.read.parquet(f"{data_folder}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, "12 34", None, "src0", 5), (10**6 + 1, None, None, "src0", None)], source.schema
    )
    docs, columns = source.unionByName(extra), source.columns
    tables = [docs.toPandas().astype(object).where(lambda t: t.notna(), None)]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, data_folder)
        assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs.toPandas().astype(object).where(lambda t: t.notna(), None))
    first, told, exact, near, mixed, packed = tables
    # 1: only texts without a letter go
    assert set(told["doc_id"]) == {r.doc_id for r in first.itertuples() if any(c.isalpha() for c in r.text or "")}
    # 8: the largest id of equal texts stays
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    largest = {}
    for r in told.itertuples():
        t = (r.text or "").translate(lower)
        largest[t] = max(largest.get(t, -1), r.doc_id)
    assert set(exact["doc_id"]) == set(largest.values())
    # 2: the smallest id of near duplicates stays
    rows = [(r.doc_id, r.text) for r in exact.itertuples()]
    assert set(near["doc_id"]) == {i for (i, _), c in zip(rows, near_components(rows)[1], strict=True) if i == c}
    assert {r.doc_id: r.text for r in near.itertuples()}.items() <= {r.doc_id: r.text for r in first.itertuples()}.items()
    # 6: the words taken of every document
    size = Counter({r.doc_id: len(words(r.text)) for r in near.itertuples()})
    got = Counter()
    for r in mixed.itertuples():
        got[r.doc_id] += len(words(r.text))
    assert all(got[i] <= 2 * size[i] for i in got)
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) <= 20 * 2 * mixing.BLOCK_WORDS
    # 10: every token once, in sequences of at most 1024
    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted = Counter()
    for r in mixed.itertuples():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            wanted[r.doc_id, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in packed.itertuples()) == wanted
    full = packed.groupby("sequence_id")["length"].sum()
    assert full.max() <= 1024 and len(full) <= 1.03 * full.sum() / 1024 + 2


def test_run(spark, data_folder):
    assert corpus_pipeline.run(spark, data_folder).count() > 0


def test_filters_decide_row_by_row(spark):
    """Null ids of which one is rejected, one id with two texts, a row repeated whole."""
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd", "ef"))
    rows = [
        (None, "12 34"),  # no letter
        (None, two.upper()),  # a copy of a text with an id
        (None, "clean text of its own"),
        (None, "another text"),
        (None, "another text"),  # repeated whole
        (1, one),
        (2, two),
        (2, two),  # repeated whole
        (5, one + " tail"),  # near the text of 1
        (5, three),  # another text under that id
        (7, "12 34"),
        (7, "text of seven"),
    ]
    source = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = corpus_pipeline.identify_language(spark, source, "")
    wanted = Counter(r for r in rows if r[1] != "12 34")
    assert Counter((r.doc_id, r.text) for r in told.collect()) == wanted
    exact = corpus_pipeline.exact_dedup(spark, told, "")
    assert exact.columns == source.columns
    wanted = Counter(set(wanted) - {(None, two.upper())})
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == wanted
    near = corpus_pipeline.near_dedup(spark, exact, "")
    del wanted[5, one + " tail"]
    assert Counter((r.doc_id, r.text) for r in near.collect()) == wanted
    # rows repeated whole also fall to one where near duplicates are dropped alone
    alone = corpus_pipeline.near_dedup(spark, source.filter("doc_id = 2"), "")
    assert alone.count() == 1
