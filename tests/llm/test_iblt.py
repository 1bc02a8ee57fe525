import hashlib
import re

from pyspark.sql import functions as F

from orthoplan.llm import iblt

SCHEMA = "doc_id long, text string, bucket string"
WORDS = [f"w{i}x" for i in range(97)]


def pieces(text):
    out = set()
    for line in text.split("\n"):
        words = line.split(" ")
        for i in range(0, len(words), iblt.WORDS):
            piece = " ".join(words[i : i + iblt.WORDS])
            out.add(piece[:-1] if i + iblt.WORDS >= len(words) and piece.endswith(" ") and not text.endswith(line) else piece)
    return out - {""}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 1.0 if a == b else 1 - len(a ^ b) / (len(a) + len(b))


def text(seed, lines, words):
    return "\n".join(" ".join(WORDS[(seed * 31 + k * 17 + j * (seed % 5 + 1)) % 97] for j in range(words)) for k in range(lines))


def rows():
    out = [(1, None), (2, ""), (3, "ä"), (5, "abc"), (6, "same\n" * 50), (8, "a  b\n\n c "), (9, "x" * 30_000), (70, text(4, 400, 33))]
    out += [(100 + 3 * i, text(i, i % 13 + 1, i % 40 + 1)) for i in range(150)]
    return out + [(100 + 3 * 150 + i, text(7, 6, 20)) for i in range(4)]


def test_matches_set_differences(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BUCKET", 10)
    docs = rows()
    got = iblt.fingerprints(spark.createDataFrame([(*r, "clash") for r in docs], SCHEMA).repartition(5)).collect()
    assert len(got) == len(docs)
    by_id, prints = {r.doc_id: r for r in got}, {}
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        t, nxt, r = t or "", nxt or "", by_id[i]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, nxt)) < 1e-9, i
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if t == edited:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1.0
    assert len({r.fingerprint for r in got}) == len({frozenset(pieces(t or "")) for _, t in docs})


def test_peeling_recovers_or_fails_by_load(spark):
    keys = lambda lo, hi: F.transform(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long")), lambda i: F.xxhash64(i))

    def found(third):
        t = F.lit(third).cast("long")
        diff = iblt.cells(F.concat(iblt.entries(keys(1, 120), 1, t, 0), iblt.entries(keys(101, 140), -1, t, 0)))
        return spark.range(1).select(iblt.recovered(diff, t, 0)).first()[0]

    assert found(400) == 120 and found(20) is None


def test_null_ids_repeated_rows_and_empty_table(spark):
    data = [(None, "no id", None), (1, "a b", None), (1, "a b", None)]
    got = iblt.fingerprints(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    alone = iblt.fingerprints(spark.createDataFrame(data[1:2], SCHEMA)).first()
    assert alone.near_next == 1.0
    assert iblt.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c\nd", None)], SCHEMA)
    assert not re.search("Python|Pandas|Arrow", iblt.fingerprints(docs)._jdf.queryExecution().toString())
