import hashlib
import random
from collections import Counter

import public_tokenizers as P
from test_classifiers import prose
from test_line_templates import brute as dropped_lines
from test_mixing import filled
from test_near_dedup import brute as near_components

import corpus_pipeline
from orthoplan.llm import bpe, language_id


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de", "fr", "es"])
        text = "\n".join(prose(rng, lang, rng.choice([12, 30])) for _ in range(rng.randint(1, 3)))
        rows.append((3 * i, text, lang, rng.choice(["a", "a", "a", "b", None])))
    rows += [(3 * i + 1, rows[i][1] + " more words", rows[i][2], "c") for i in range(30)]  # near copies, in two documents only
    rows += [(1000 + i, f"{prose(rng, 'en', 30)}\nAll rights reserved by somebody 20{i}", "en", "b") for i in range(5)]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "12 34", "en", "a"), (2003, "All rights reserved by somebody 1999", None, "a")]
    data = [(*r, len(r[1] or "")) for r in rows]
    folder = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    model = language_id.learn(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = [(i, t, s) for i, t, _, s in rows if language_id.predict(model, t)[0] != "und"]
    drops = dropped_lines([(i, t) for i, t, _ in kept])
    clean = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drops[i]) for i, t, _ in kept}
    clean = {i: t for i, t in clean.items() if t}
    assert 2003 not in clean and 1000 in clean and len(drops) == len(kept)
    component = near_components(list(clean.items()))
    clean = {i: t for i, t in clean.items() if component[i] == i}
    assert len(clean) < len(component)
    source = {i: s for i, _, s in kept}
    sizes = {}
    for i, t in clean.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    targets, copies = filled(sizes), Counter(r.doc_id for r in got)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    for s, target in targets.items():
        assert abs(sum(n * len(clean[i].split()) for i, n in copies.items() if source[i] == s) - target) <= 2 * 100
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in got:
        ids = enc.encode_ordinary(clean[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns
