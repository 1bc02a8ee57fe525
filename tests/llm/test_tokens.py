import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from orthoplan.llm import arrow_tokens, bpe, scratch

TEXTS = [
    None, "", " ", "  \n ", "a", "Hello world", " leading and trailing ", "tabs\t here", "double  blanks  here\n\n new", "it's they're 'quoted' <|endoftext|> x",
    "naïve été   nbsp wide", "数字 123 456abc", "x\n y", "a\x1c b", "ends, marks... here!? yes; no: ok.\nStart. Éa, ﬁn ªº ٣٤ x٣ don't!",
    "line\nline two. Next, one!\n", "word " * 30_000, "a" * 70_000, "a" * 70_000 + " tail 12",
]
SCHEMA = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_arrow_files_hold_what_the_tokenizer_gives(spark, docs):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    manifest = arrow_tokens.write(docs, scratch.new_path(spark, "t"), path, length=64)
    got = arrow_tokens.documents(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    at = 0
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    for r in got:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        at += len(ids)
    assert len(got) == len(TEXTS) + 2


def test_sequences_are_views_with_masks(spark, docs):
    manifest = arrow_tokens.write(docs, scratch.new_path(spark, "t"), P.path("byte_bpe_50k.json"), length=64)
    for m in manifest.collect():
        parts = [arrow_tokens.sequence(m.path, i) for i in range(m.n_sequences)]
        assert all(len(ids) == 64 == len(mask) for ids, mask in parts)
        assert sum(int(mask.sum()) for _, mask in parts) == m.n_tokens
        assert not parts[0][0].flags.owndata


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert arrow_tokens.documents(arrow_tokens.write(none, scratch.new_path(spark, "t"), P.path("byte_bpe_50k.json"))).count() == 0
    assert bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_matches_the_library_on_whole_texts(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc: tiktoken.Encoding = bpe.encoding(path, P.PATTERN)
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    for r in bpe.round_trip(docs, path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.bytes).decode() == (texts[r.doc_id] or "") for r in back)


@pytest.mark.parametrize("most", [1, 3, 10, 100])
def test_pieces_have_the_ids_of_the_whole(most):
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for text in TEXTS[2:15]:
        assert "".join(bpe.pieces(text, most)) == text
        assert bpe.encode(text, enc, most) == enc.encode_ordinary(text)
