"""Extra columns with any name, ids that repeat, rules that hold at every size."""

import random

import corpus_pipeline
from orthoplan.llm import iblt, line_templates, mixing

INTERNAL = ["k", "h", "h2", "tid", "tid2", "leaf", "idx", "dropped", "docs", "first", "rep", "rest", "ls", "p", "t", "pos", "least", "row", "none", "name", "known", "ident", "tie", "block", "block2", "block3", "n", "at", "above", "u", "i", "rank", "source_size", "target", "copies", "taken", "copy", "_u", "_i", "_block", "Dropped_", "N_LINES"]


def wide(spark, rows):
    names = [c for c in INTERNAL if c.lower() not in ("n_lines",)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    return names, spark.createDataFrame([(*r, *range(100, 100 + len(names))) for r in rows], schema)


def test_columns_pass_through_whatever_their_names(spark):
    names, docs = wide(spark, [(i, f"the same line {i}\n{'abcdefghij'[i] * 5}", "ab"[i % 2]) for i in range(10)])
    got = line_templates.deduplicated(docs).collect()
    assert sum(r.n_dropped for r in got) == 9
    assert all(r[c] == 100 + k for r in got for k, c in enumerate(names))
    kept = [c for c in names if c not in mixing.ADDED]
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", *kept, *mixing.ADDED]
    assert all(r[c] == 100 + names.index(c) for r in mixed.collect() for c in kept)
    drawn = mixing.drawn(docs)
    assert drawn.columns == docs.columns and all(r[c] == 100 + k for r in drawn.collect() for k, c in enumerate(names))


def test_sparse_and_missing_ids_are_ranked_in_blocks(spark):
    rng = random.Random(2)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [None] * 100 + [5, 5, 5]
    docs = spark.createDataFrame([(i, "w " * (k % 3), "a" if k % 4 else "b") for k, i in enumerate(ids)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    words = sum(r["size"] for r in got)
    assert len(got) == len(ids) and abs(sum(r.taken for r in got) - words) <= 2 * 2
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(7)).collect())


def test_a_template_of_two_fields_holds_at_every_size_with_a_share(spark):
    """With a count alone, values that recur become constants; with a share of the leaf they do not."""
    for n in (60, 3000):
        rows = [(i, f"report filed under topic {'abcdefghij'[i % 10] * 3} by writer {'klmnopqrst'[i // 10 % 10] * 3} for all our readers") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sum(r.n_dropped for r in line_templates.deduplicated(docs, constant_share=0.3).collect()) == n - 1


def test_what_no_sketch_recovers_is_subtracted(spark, monkeypatch):
    monkeypatch.setattr(iblt, "ROUNDS", 0)
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(40))), (2, "\n".join(f"line {i}" for i in range(30, 70)))], "doc_id long, text string")
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    assert abs(got[1].near_next - 0.25) < 1e-12


def test_near_stage_judges_rows_not_ids(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [(3, words("a")), (5, words("a")), (5, words("b")), (5, words("b")), (7, words("c")), (None, words("c")), (None, words("d")), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == [("3", words("a")), ("5", words("b")), ("7", words("c")), ("None", words("d"))]
    assert len(got) == 6


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 !!", None, "s", 5), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
