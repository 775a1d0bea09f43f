"""Token ids of whole texts, and token counts per section."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headroom.llm.common import kept

# fixed value: how byte-level tokenizers of this kind split a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 500


def byte_characters() -> dict[str, int]:
    """Character -> byte in vocabulary files: visible bytes stand for themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes -> id, special string -> id) of a byte-level tokenizer file.

    Ids must follow the order of merges, as then the merge of the smallest id
    is the merge that comes first; anything else is refused.
    """
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    before = held["pre_tokenizer"] or {}
    if held["model"]["type"] != "BPE" or held.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
    decode = byte_characters()
    vocab, merges = held["model"]["vocab"], held["model"]["merges"]
    ranks = {bytes(decode[c] for c in token): i for token, i in vocab.items() if token not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    if any(vocab["".join(pair)] != 256 + k for k, pair in enumerate(pairs)):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return ranks, special


class Encoder:
    """Ids of whole texts, the same as the tokenizer file's own.

    The merges of the file run in the faster of two libraries; texts with
    special strings or very long words, which that one takes quadratic time
    for, go to the other, which is read in when the first of them comes.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        ranks, self.special = read_vocabulary(path)
        self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        for token, i in self.special.items():
            self.n_bytes[i] = len(token.encode())

    @cached_property
    def full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.special) or max(map(len, text.split()), default=0) > LONG_WORD:
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of a worker; its modules outlive its tasks."""
    return kept(("encoder", path), lambda: Encoder(path))


# --- counts per section ----------------------------------------------------------------------


def _sections(path: str, fields: Sequence[str], by_line: Sequence[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids, names, numbers, starts, sizes, tokens, crossing = [], [], [], [], [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                values = ["" if v is None else v for v in row[1:]]
                whole = "\n".join(values)
                parts = []
                for field, value in zip(fields, values, strict=True):
                    lines = value.split("\n") if field in by_line else [value]
                    at = 0
                    for k, line in enumerate(lines):
                        parts.append((field, k, at, line))
                        at += len(line) + 1
                # sections tile the text; the line feed behind a section is part of it
                ends = np.cumsum([len(p[3].encode()) + 1 for p in parts])
                ends[-1] -= 1
                found = np.frombuffer(encode.encode(whole), dtype="<u4")
                stop = np.cumsum(encode.n_bytes[found])
                begin = stop - encode.n_bytes[found]
                place = np.searchsorted(ends, begin, side="right")
                last = np.searchsorted(ends, stop, side="left")
                ids += [row[0]] * len(parts)
                names += [p[0] for p in parts]
                numbers += [p[1] for p in parts]
                starts += [p[2] for p in parts]
                sizes += [len(p[3]) for p in parts]
                tokens.append(np.bincount(place, minlength=len(parts)))
                crossing.append(np.bincount(place[last > place], minlength=len(parts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.types[0]),
                    pa.array(names, pa.string()),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.concatenate([*tokens, np.zeros(0)]).astype(np.int64)),
                    pa.array(np.concatenate([*crossing, np.zeros(0)]).astype(np.int64)),
                ],
                names=["doc_id", "field", "section", "start", "n_chars", "n_tokens", "n_crossing"],
            )

    return count


def section_tokens(
    docs: DataFrame, path: str, fields: Sequence[str] = ("source", "text"), by_line: Sequence[str] = ("text",)
) -> DataFrame:
    """(doc_id, field, section, start, n_chars, n_tokens, n_crossing) of every section.

    A document is its ``fields`` joined by line feeds and is encoded once, as
    a whole.  Sections are fields, and the lines of fields in ``by_line``;
    ``start`` and ``n_chars`` count code points inside the field.  A token
    belongs to the section that holds its first byte; the line feed behind a
    section belongs to it.  ``n_crossing`` counts its tokens that end in a
    later section.  The counts of a document add up to its tokens.

    Defined cases: null fields are empty and are sections with no characters;
    a document always has at least one section per field; repeated rows are
    counted each; an empty table gives no rows; other columns are ignored.
    ``path`` is the tokenizer file, found on every executor.
    """
    rows = docs.select("doc_id", *[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)])
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, field string, section int, start long, n_chars long, n_tokens long, n_crossing long"
    return rows.mapInArrow(_sections(path, list(fields), list(by_line)), schema)
