import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LONG, ROWS, documents, no_documents, odd_documents, repetition

from headroom.llm import language, quality, rules, words
from headroom.llm.queries import QUERIES


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- language --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def told(spark, data_folder):
    return {r["doc_id"]: r for r in QUERIES["op1_language"](spark, data_folder).collect()}


def test_language_of_held_out_documents(told, data_folder):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data_folder}/documents.parquet'").fetchall())
    assert set(told) == set(langs)
    assert all(r["held_out"] == (crc(i) % 3 == 1) for i, r in told.items())
    judged = [r["lang_pred"] == langs[i] for i, r in told.items() if r["held_out"] and langs[i] is not None]
    assert len(judged) > 40 and np.mean(judged) > 0.95
    assert all(0 <= r["score"] <= 1 for r in told.values())


def test_language_scores_equal_a_plain_form(spark, data_folder, told):
    docs = spark.read.parquet(f"{data_folder}/documents.parquet")
    learn = docs.filter(~language.held_out(docs["doc_id"])).select("doc_id", "text", "lang")
    model = language.train_language_model(learn)
    for doc_id, text in list(documents(data_folder).items())[:40]:
        total = np.zeros(len(model["langs"]))
        for word in language.LETTERS.findall(text.lower()):
            if word in model["words"]:
                total += model["word_scores"][model["words"][word]]
                continue
            padded = f"<{word}>"
            for n in range(language.LONGEST_GRAM, 0, -1):
                grams = [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)
                known = [model["gram_scores"][model["grams"][g]] for g in grams if g in model["grams"]]
                if known:
                    total += np.mean(known, axis=0)
                    break
        assert told[doc_id]["lang_pred"] == model["langs"][int(total.argmax())]
        assert told[doc_id]["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-3)


def test_language_odd_cases(spark):
    docs = odd_documents(spark)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.detect_language(docs).collect()]
    assert len(got) == len(ROWS)
    by = {i: (lang, score) for i, lang, score in got}
    assert all(by[i] == ("und", 0.0) for i in (4, 5, 6, 9))
    assert all(lang in ("en", "fr") for i, (lang, _) in by.items() if i not in (4, 5, 6, 9))
    assert language.detect_language(no_documents(spark)).count() == 0
    left = language.keep_identified(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {r[0] for r in ROWS} - {4, 5, 6, 9}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language.detect_language(docs).first()["lang_pred"] == "und"


def test_long_texts_are_read_in_pieces(monkeypatch):
    whole = [w for part in language.words_of(LONG) for w in part]
    monkeypatch.setattr(language, "PIECE_CHARS", 50)
    assert [w for part in language.words_of(LONG) for w in part] == whole


def test_a_small_memory_of_unseen_words_changes_nothing(monkeypatch):
    model = {
        "langs": ["a", "b"],
        "words": {"one": 0},
        "word_scores": np.array([[1.0, -1.0]], dtype=np.float32),
        "grams": {"x": 0, "yz": 1},
        "gram_scores": np.array([[0.5, -0.5], [-2.0, 2.0]], dtype=np.float32),
    }
    texts = [" ".join(f"x{chr(97 + (i * k) % 26)} yz one" for i in range(60)) for k in range(1, 6)] + ["", None, "12", "q q"]
    wanted = language.Scorer(model).texts(texts)
    monkeypatch.setattr(language, "CACHE_WORDS", 4)
    monkeypatch.setattr(language, "PIECE_CHARS", 50)
    got = language.Scorer(model).texts(texts)
    assert got[0] == wanted[0] and got[0][5:] == ["und", "und", "und", "a"]
    assert got[1] == pytest.approx(wanted[1])


# --- quality ---------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark, data_folder):
    got = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, data_folder).collect()}
    assert set(got) == set(documents(data_folder))
    assert all(r["held_out"] == (crc(i) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{data_folder}/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    good = [got[i]["score"] for i, q in labels if q == 1]
    bad = [got[i]["score"] for i, q in labels if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_quality_learns_junk_from_prose():
    rng = np.random.default_rng(3)
    syllables = ["an", "the", "or", "in", "re", "st", "on", "ed"]

    def text(junk):
        out = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(30, 200))]
        return " ".join(w + ("***" if junk and rng.random() < 0.7 else "") for w in out)

    y = rng.integers(0, 2, 240)
    texts = [text(not q) for q in y]
    start = [quality.chunk_starts(np.array([0, len(t)]))[0] for t in texts]
    chunks = [
        quality.read_chunks(np.frombuffer(t.encode(), np.uint8), s, np.full(len(s), len(t)))
        for t, s in zip(texts, start, strict=True)
    ]
    model = quality.train_quality_model(chunks[:160], y[:160].astype(float), epochs=6)
    score = quality.score_texts(model, pa.array(texts[160:]))
    assert np.mean((score >= 0.5) == y[160:]) > 0.95


def test_chunks_cover_whole_texts():
    for size in (0, 1, 480, 511, 512, 513, 992, 993, 5000):
        start, _ = quality.chunk_starts(np.array([0, size]))
        assert start[0] == 0 and start[-1] + quality.CHUNK >= size
        assert len(start) == 1 or start[-1] + quality.CHUNK - quality.STEP < size
        assert (np.diff(start) == quality.STEP).all()


def test_gradient_of_the_network():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 110, (n, quality.CHUNK)).astype(np.uint8) for n in (1, 3)]
    y = np.array([0.0, 1.0])
    model = quality.train_quality_model(texts, y, epochs=1)
    model = {k: (np.asarray(v, dtype=float) if k != "pairs" else v) for k, v in model.items()}

    def loss(changed):
        chunks, text = np.concatenate(texts), np.array([0, 1, 1, 1])
        pooled, _ = quality.pool(quality.with_pairs(changed), chunks)
        p = quality.probability(quality.combine(changed, pooled, text, 2)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality._gradient(quality.with_pairs(model), texts, y)
    for name, at in (("w1", (3, 2)), ("b1", (1,)), ("w2", (4,)), ("b2", ()), ("bias", (2,))):
        step = 1e-3
        up, down = (model | {name: model[name].copy()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        assert found[name][at] == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=2e-3)


def test_quality_odd_cases(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (10, 1), (13, None), (99, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(no_documents(spark), labels).count() == 0
    alone = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_quality_trains_on_whole_texts(spark):
    """Junk in any one chunk of a long text reaches training; a bound in bytes lowers the number of texts only."""
    texts = [(i, "".join(f"{i:03d}-{k:04d} " for k in range(600 + i))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    trained = [(i, t.encode()) for i, t in texts if crc(i) % 5]
    chunks, y = quality.labelled_sample(docs, labels, 5000)
    assert y.tolist() == [i % 2 for i, _ in trained]
    for (_, text), own in zip(trained, chunks, strict=True):
        assert len(own) > 8 and b"".join(c[: quality.STEP].tobytes() for c in own[:-1]) + own[-1].tobytes().rstrip(b"\0") == text
    few, _ = quality.labelled_sample(docs, labels, 5000, sample_bytes=80 * quality.CHUNK)
    assert 1 < len(few) < len(chunks) and sum(c.nbytes for c in few) <= 80 * quality.CHUNK
    whole = {c.tobytes() for c in chunks}
    assert all(c.tobytes() in whole for c in few)


# --- repetition rules --------------------------------------------------------------------


def test_rules_query_equals_brute_force(spark, data_folder):
    got = {r["doc_id"]: r for r in QUERIES["op9_repetition"](spark, data_folder).collect()}
    texts = documents(data_folder)
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        r, wanted = got[doc_id], repetition(text)
        assert tuple(r[1:6]) == wanted
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_good_documents(spark, data_folder):
    got = {r["doc_id"]: r for r in QUERIES["op9_repetition"](spark, data_folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id FROM '{data_folder}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()
    long_enough = [got[i]["kept"] for (i,) in labels if got[i]["n_words"] >= 20]
    assert np.mean(long_enough) > 0.97


def test_rules_odd_cases(spark):
    got = rules.repetition_rules(odd_documents(spark)).collect()
    assert sorted((repr(r[0]), *r[1:6]) for r in got) == sorted((repr(i), *repetition(t)) for i, t, *_ in ROWS)
    assert rules.repetition_rules(no_documents(spark)).count() == 0


def test_long_texts_are_scanned_in_pieces():
    rng = np.random.default_rng(8)
    lines = [" ".join(rng.choice(["ä", "bb", "ccc", "#d|", ""], rng.integers(0, 12))) for _ in range(300)]
    text = "\n".join(lines)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = rules.Scan(data, np.array([0, len(data)])).columns()
    parts = list(words.pieces(data, 64))
    assert len(parts) > 20 and b"".join(p.tobytes() for p in parts) == data.tobytes()
    scans = [rules.Scan(p, np.array([0, len(p)])) for p in parts]
    joined = rules.Scan.__new__(rules.Scan)
    joined.n_texts, joined.symbols = 1, sum(s.symbols for s in scans)
    for name in ("word", "word_text", "word_chars", "line", "line_text", "line_chars"):
        setattr(joined, name, np.concatenate([getattr(s, name) for s in scans]))
    assert [c.tolist() for c in joined.columns()] == [c.tolist() for c in whole]
    assert tuple(int(c[0]) for c in whole[:5]) == repetition(text)




def test_numbers_are_no_letters(spark):
    texts = ["½", "²", "Ⅷ", "①", "½ ² Ⅷ ① 7", None, "x²"]
    rows = [(i, "the words of one language", "en") for i in range(3, 30, 3)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.detect_language(docs).collect()}
    assert all(got[100 + i] == ("und", 0.0) for i in range(6)) and got[106][0] == "en"
    assert [w for part in language.words_of("a½b ²c d") for w in part] == ["a", "b", "c", "d"]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"common words number{'abcdefghij'[i % 10]} of english text again", "en") for i in range(3000)]
    rows += [(10_000 + i, "maneno machache ya kiswahili yanatosha", "sw") for i in range(3)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language_model(learn, sample_rows=300, model_words=12, model_grams=60)
    assert model["langs"] == ["en", "sw"]
    assert {"maneno", "machache", "ya", "kiswahili", "yanatosha"} <= set(model["words"])
    scorer = language.Scorer(model)
    assert scorer.texts(["kiswahili maneno", "english words"])[0] == ["sw", "en"]
