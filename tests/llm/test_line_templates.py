import random
import re
from collections import defaultdict

from orthoplan.llm import line_templates

SCHEMA = "doc_id long, text string, k string, n_lines string"


def brute(rows, min_docs=3, min_tokens=3):
    """rows(doc_id, text) with distinct ids -> id: numbers of dropped lines."""
    forms, where = {}, defaultdict(lambda: defaultdict(list))
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            m = " ".join("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\t-\r ]+", line.strip("\t\n\x0b\f\r ")))
            if len(m.split(" ")) >= min_tokens:
                where[m][i].append(n)
                forms[m] = (len(m.split(" ")), *m.split(" ")[:3])
    leaves = defaultdict(list)
    for m, leaf in forms.items():
        leaves[leaf].append(m)
    template = {m: m for m in forms}
    for leaf, ms in leaves.items():
        if len(ms) > 1 and sum(len(where[m]) for m in ms) >= min_docs:
            count = defaultdict(int)
            for m in ms:
                for p, t in enumerate(m.split(" ")):
                    count[p, t] += len(where[m])
            for m in ms:
                ts = [t if count[p, t] >= min_docs else None for p, t in enumerate(m.split(" "))]
                if sum(t is not None for t in ts) / len(ts) >= 0.7:
                    template[m] = (leaf, tuple(ts))
    docs = defaultdict(list)
    for m, t in template.items():
        docs[t] += list(where[m])
    return {i: {n for m in forms for n in where[m].get(i, []) if len(docs[template[m]]) >= min_docs and min(docs[template[m]]) != i} for i, _ in rows}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    shared = [" ".join(word() for _ in range(n)) for n in (3, 8, 60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "x" * 50_000 + " 1 2"), (4, "a 1\na 2\na 3")]
    for i in range(5, 120):
        lines = [" ".join(word() for _ in range(rng.choice([2, 6, 20]))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        if i % 5 == 0:  # one template, a free word and a number in it
            lines.append(f"user logged in as {word()} from host {rng.randrange(999)} at the usual place today")
        if i % 7 == 0:
            lines += [lines[0], "too short"]
        rows.append((i, "\n".join(lines)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "kept", "clash") for i, t in rows], SCHEMA).repartition(4)
    out = line_templates.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "k", "n_lines", "n_dropped"]
    want, texts = brute(rows), dict(rows)
    got = out.collect()
    assert len(got) == len(rows) and sum(r.n_dropped for r in got) > 40
    for r in got:
        lines = (texts[r.doc_id] or "").split("\n")
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(x for n, x in enumerate(lines) if n not in want[r.doc_id])), r.doc_id
        assert r.n_dropped == len(want[r.doc_id]) and r.k == "kept"


def test_null_ids_repeated_rows_and_empty_table(spark):
    line = "this line is in every document"
    rows = [(None, line, None, None), (9, line, None, None), (9, line, None, None), (4, line + "\nown words", None, None), (4, "other", None, None)]
    got = line_templates.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("4", "other"), ("4", line + "\nown words"), ("9", ""), ("9", ""), ("None", "")]
    assert line_templates.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c\nd")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", line_templates.deduplicated(docs)._jdf.queryExecution().toString())
