"""The registered queries on a small folder of tables: their columns, their folds, and brute force where SQL has no say."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from test_classifiers import prose
from tokenizers import Tokenizer

from orthoplan.llm import html_tree, language_id, quality_knn
from orthoplan.llm.queries import QUERIES

PAGE = "<html><body><nav><a href=/>Home</a></nav><article><h1>{}</h1><p>{}</p><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be it.</p><noscript><p>Without scripts, too.</p></noscript></article><footer>&copy; Us</footer></body></html>"


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    langs = [rng.choice(["en", "de", "fr", "es"]) for _ in range(240)]
    docs = [(7 * i, "\n".join(prose(rng, lang, rng.choice([30, 60])) for _ in range(rng.randint(1, 3))), lang, rng.choice(["a", "a", "b", None])) for i, lang in enumerate(langs)]
    docs = [(i, t.upper().replace(" ", "!! ") if i % 5 == 0 else t, lang, s) for i, t, lang, s in docs]
    docs += [(5001, None, "en", "a"), (5002, "", None, "a"), (5003, "½ 12 !!", "en", "b"), (5004, "x <|endoftext|> y", "en", "b")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, *_ in docs if i < 5000], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"u{i}", PAGE.format(prose(rng, "en", 4), prose(rng, "en", 60))) for i in range(20)] + [(99, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs


def rows(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


def test_language_of_every_text(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op2_family_svm_language")}
    docs = tables[1]
    assert len(got) == len(docs) and next(iter(got.values())).__fields__[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    known = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in docs if crc(i) % 3 != 1], "doc_id long, text string, lang string")
    model = language_id.learn(known)
    assert sum(map(len, model.families.values())) == 4
    for i, t, _, _ in docs:
        assert got[i].held_out == (crc(i) % 3 == 1)
        assert (got[i].lang_pred, got[i].score) == language_by_loop(model, t), i
    assert [got[i].lang_pred for i in (5001, 5002, 5003)] == ["und"] * 3
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in docs if i < 5000 and crc(i) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def language_by_loop(model, text):
    """Every byte pair and triple by itself, every machine in turn."""
    raw = language_id.letters(text) if text else b""
    if not raw:
        return "und", 0.0
    n = {}
    for k in range(len(raw) - 1):
        n[raw[k] << 8 | raw[k + 1]] = n.get(raw[k] << 8 | raw[k + 1], 0) + 1
        if k + 2 < len(raw):
            h = ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1 % 2**32 >> 15) + language_id.PAIRS
            n[h] = n.get(h, 0) + 1
    i = np.array(sorted(n))
    v = np.sqrt(np.array([n[k] for k in sorted(n)]) / sum(n.values())).astype(np.float32)
    margin = lambda m: float(m.weights[i] @ v) + m.bias
    sure = lambda x: float(1 / (1 + np.exp(-2 * np.clip(x, -30, 30))))
    (m,) = model.between  # two families here
    family, chance = (m.first, sure(margin(m))) if margin(m) >= 0 else (m.second, sure(-margin(m)))
    (d,) = model.within[family]
    lang, surer = (d.first, sure(margin(d))) if margin(d) > 0 else (d.second, sure(-margin(d)))
    return lang, chance * surer


def test_sixty_languages_stay_small(spark):
    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(60)]
    docs = [(100 * k + j, " ".join(c * rng.randint(1, 3) + "ab" for _ in range(20)), f"q{k:02d}") for k, c in enumerate(letters) for j in range(6)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.learn(table)
    machines = [*model.between, *(m for ms in model.within.values() for m in ms)]
    assert len(model.families) == 60 and len(machines) == 60  # one a family, not one a pair of them
    assert sum(m.weights.nbytes for m in machines) < 60e6
    assert all(language_id.predict(model, t)[0] == lang for _, t, lang in docs[::7])


def test_quality_of_every_text(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op4_latent_knn_quality")}
    folder, docs = tables
    assert len(got) == len(docs) and next(iter(got.values())).__fields__ == ["doc_id", "held_out", "score", "predicted"]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, *_ in docs if i < 5000 and crc(i) % 4 != 2], "doc_id long, quality int")
    model = quality_knn.learn(table, labels)
    for i, t, _, _ in docs:
        assert got[i].held_out == (crc(i) % 4 == 2) and got[i].predicted == (got[i].score >= 0.7)
        assert abs(got[i].score - quality_by_loop(model, t)) < 1e-8, i
    held = [(got[i].predicted, int(i % 5 != 0)) for i, *_ in docs if i < 5000 and crc(i) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    texts = [t for _, t, _, _ in docs]
    assert (quality_knn.scores(model, texts) == np.array([quality_knn.scores(model, [t])[0] for t in texts])).all()  # whatever is in the block


def quality_by_loop(model, text):
    """Cosines one by one, the K nearest and all that tie with the last of them."""
    v = quality_knn.damped(text) * model.idf @ model.axes
    if not np.linalg.norm(v):
        return model.prior
    cosine = [round(float(v @ w / np.linalg.norm(v)), 9) for w in model.vectors]
    least = sorted(cosine)[-min(quality_knn.K, len(cosine))]
    votes = [(max(c, 0.0) ** 4 * w, q) for c, w, q in zip(cosine, model.votes, model.labels) if c >= least]
    total = sum(w for w, _ in votes)
    return sum(w for w, q in votes if q == 1) / total if total else model.prior


def test_token_files_follow_the_library(spark, tables):
    got = sorted(rows(spark, tables, "op5_arrow_tokens"), key=lambda r: r.doc_id)
    assert got[0].__fields__ == ["doc_id", "start", "n_tokens", "ids_crc32"]
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, texts = 0, {i: t or "" for i, t, *_ in tables[1]}
    for r in got:
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        at += len(ids)
    special = json.loads(open(P.path("byte_bpe_50k.json")).read())["added_tokens"]
    assert any(t["content"] == "<|endoftext|>" for t in special)


def test_articles_come_whole(spark, tables):
    got = {r.page_id: r for r in rows(spark, tables, "op6_dom_sum_product")}
    assert len(got) == 21 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert (got[99].text, got[99].n_chars) == ("", 0)
    for i in range(20):
        assert got[i].text.endswith("Let x+1 be it. Without scripts, too.") and "Home" not in got[i].text and "Us" not in got[i].text
        assert got[i].n_chars == len(got[i].text)


def test_fingerprints_and_round_trips(spark, tables):
    docs = sorted(tables[1])
    got = {r.doc_id: r for r in rows(spark, tables, "op7_iblt_fingerprints")}
    assert len(got) == len(docs) and next(iter(got.values())).__fields__ == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for (i, t, *_), (_, following, *_) in zip(docs, docs[1:] + docs[:1]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    back = {r.doc_id: r for r in rows(spark, tables, "op10_tiktoken_bpe")}
    assert all(back[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in docs)


def test_text_outside_the_article_goes():
    model = html_tree.trained()
    text = html_tree.main_texts(model, [PAGE.format("Title", "Some words, and more of them, make a sentence of the usual length for an article.")])[0]
    assert text == "Title Some words, and more of them, make a sentence of the usual length for an article. Let x+1 be it. Without scripts, too."
