import random
import zlib

import pytest

from orthoplan.llm import language_id, quality_knn

SYLLABLES = {"en": "the ing tion ou ea wh st er an", "de": "sch ung keit ü ä ß pf tz en", "fr": "eau eux oi é è ment que ai", "es": "ción ñ ll rr ado ez os que", "xx": "ka ki ku ke ko ta"}
SCHEMA = "doc_id long, text string, lang string, score string"


def prose(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([8, 40, 200])), lang, "clash") for i in range(600)]
    rows += [(900, None, "en", None), (901, "", "en", None), (902, "12 34 !!", "en", None), (903, "the thing", None, None), (None, "whing the", None, None), (904, "the " * 60_000, None, None), (903, "the thing", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_languages_of_held_out_texts(docs):
    model = language_id.learn(docs.filter("doc_id % 3 <> 1"))
    assert model.families["germanic"] == ["de", "en"] and model.families["xx"] == ["xx"]
    got = language_id.identified(docs, model).collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "en", "en"]


def test_nothing_learned(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert {r.lang_pred for r in language_id.identified(docs, language_id.learn(none)).collect()} == {"und"}
    assert language_id.identified(none, language_id.learn(docs)).count() == 0


def test_quality_of_held_out_texts(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(800):
        t, bad = prose(rng, rng.choice(["en", "fr"]), rng.choice([40, 90])), i % 4 == 0
        if bad:
            t = rng.choice([lambda: t.upper().replace(" ", "!! "), lambda: t.replace(" ", "%%% "), lambda: " | ".join(t.split()), lambda: " ".join([t.split()[0]] * 60)])()
        texts.append((i, t))
        labels.append((i, int(not bad)))
    texts += [(1800, None), (1801, ""), (1802, "x"), (None, "no id"), (1803, "the word " * 50_000)]
    labels += [(None, 1), (4, None), (1900, 1), (8, 0), (8, 0)]
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    model = quality_knn.learn(docs, marks.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = {r.doc_id: r.score for r in quality_knn.scored(docs, model).collect()}
    held = [(got[i], q) for i, q in labels[:800] if part(i) == 2]
    assert len(held) > 100
    assert sum((s >= 0.7) == (q == 1) for s, q in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1800] == got[1801] == model.prior


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_knn.scored(docs, quality_knn.learn(docs, none)).collect()] == [0.5]
    assert quality_knn.scored(docs.limit(0), quality_knn.learn(docs, none)).count() == 0
