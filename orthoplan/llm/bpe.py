"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding at places where no match of the pattern can reach across: after a word character
and before a blank or a line feed. Matches take white space at their start only, and nothing in the pattern looks back,
so the pieces have the ids of the whole. Decoding joins the bytes of the ids.

Nulls: a null text counts as empty (no ids, no bytes); any other column may be null. Empty texts have no ids. Texts of any
length are encoded whole. Repeated rows are encoded separately. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts above so many characters are split.
LONG = 1 << 16
SAFE = re.compile(r"(?<=\w)(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """One encoding for each worker process, rank file and pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = LONG) -> Iterator[str]:
    """text in pieces of about most characters, cut at safe places only; a stretch without one stays whole."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc, most: int = LONG) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, most) for i in enc.encode_ordinary(piece)]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>."""

    def rows(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode(t or "", enc) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens(doc_id, ids) -> doc_id, bytes binary (raw: a part of a character stays as it is)."""

    def rows(batches):
        enc = encoding(path, pattern)
        for b in batches:
            out = [enc.decode_bytes(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, nothing kept."""

    def rows(batches):
        enc = encoding(path, pattern)
        digits = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                ids = encode(text or "", enc)
                out.append((len(ids), hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            n, a, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
