"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

A text's features are the shares of its byte pairs and (hashed) byte triples, lower-cased and with every run of other
characters than letters as one blank. Families: a table of fixed values by ISO code; a learned language that it does not
name is a family of its own. Each family has a machine that tells it from all others, and the widest margin wins (of two
families one machine decides); then the one-versus-one machines of the winning family's languages vote. So machines grow
in number with the families, and with the square of the table's families only, which hold a dozen languages at most; one
takes 0.8 MB. Each machine is fitted on the driver by dual coordinate descent on a sample of the
labelled rows, drawn from all of them by a hash. On average it holds SAMPLE rows and CHARACTERS characters of each
language at most, and less of each where there are more than LANGUAGES of them.

Nulls: rows without text or language teach nothing; a text that is null or has no letter is `und` with score 0, and so
is every text if nothing was learned. Texts are scored whole, whatever their length. Repeated rows get the same answer.
Ties go to the family or language that comes first by name. An empty table gives an empty result; language, source and id
play no part in a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Labelled rows and characters of each language that the machines are fitted on, on average; with more languages than
#: LANGUAGES the samples shrink, so that all together stay within LANGUAGES times that.
SAMPLE = 1000
CHARACTERS = 8_000_000
LANGUAGES = 16
PAIRS, TRIPLES = 1 << 16, 1 << 17
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
}
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words with one blank between and around them; empty if there is no letter."""
    words = OTHER.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if any(map(str.isalpha, words)) else b""


def grams(raw: bytes) -> np.ndarray:
    """A feature number for each byte pair and triple."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(15)
    return np.concatenate([two, three + np.uint32(PAIRS)])


@dataclass
class Machine:
    """A positive margin speaks for first, a negative one for second."""

    first: str
    second: str
    weights: np.ndarray
    bias: float

    def margin(self, i: np.ndarray, v: np.ndarray) -> float:
        return float(self.weights[i] @ v) + self.bias


@dataclass
class Model:
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def fitted(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent; each class has the same total cost."""
    w = np.zeros(PAIRS + TRIPLES + 1)
    bias = PAIRS + TRIPLES
    norm = np.array([v @ v for _, v in x]) + 0.09
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    limit = cost * len(y) / (2 * share)
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            i, v = x[k]
            step = min(max(alpha[k] - (y[k] * (w[i] @ v + 0.3 * w[bias]) - 1) / norm[k], 0.0), limit[k]) - alpha[k]
            if step:
                alpha[k] += step
                w[i] += step * y[k] * v
                w[bias] += step * y[k] * 0.3
    return w[:bias].astype(np.float32), float(w[bias] * 0.3)


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """(text, lang), picked by a hash among all rows of each language; equal rows count once."""
    d = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = d.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters")).collect()
    if not sizes:
        return []
    fit = min(1.0, LANGUAGES / len(sizes))
    shares = {r.lang: min(1.0, fit * SAMPLE / r.rows, fit * CHARACTERS / max(1, r.characters)) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    rows = d.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).distinct().collect()
    return sorted((r.text, r.lang) for r in rows)


def learn(labelled: DataFrame) -> Model:
    """labelled(text, lang) -> the machines."""
    by_lang: dict[str, list] = {}
    for text, lang in sample(labelled):
        raw = letters(text)
        if len(raw) > 2:
            i, n = np.unique(grams(raw), return_counts=True)
            by_lang.setdefault(lang, []).append((i.astype(np.int32), np.sqrt(n / n.sum())))
    family_of = {lang: family for family, langs in FAMILIES.items() for lang in langs}
    families: dict[str, list[str]] = {}
    for lang in sorted(by_lang):
        families.setdefault(family_of.get(lang.lower()[:2], lang), []).append(lang)

    def machine(first: str, a: list, second: str, b: list) -> Machine:
        return Machine(first, second, *fitted(a + b, np.array([1.0] * len(a) + [-1.0] * len(b))))

    rows = {family: [x for lang in langs for x in by_lang[lang]] for family, langs in families.items()}
    if len(families) == 2:
        between = [machine(*(x for f in families for x in (f, rows[f])))]
    else:
        between = [machine(f, own, "", [x for g, others in rows.items() if g != f for x in others]) for f, own in rows.items()] if len(families) > 2 else []
    within = {f: [machine(a, by_lang[a], b, by_lang[b]) for a, b in combinations(langs, 2)] for f, langs in families.items()}
    return Model(families, between, within)


def chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def family_of(model: Model, i: np.ndarray, v: np.ndarray) -> tuple[str, float]:
    """The family whose machine has the widest margin, and how sure that machine is, as a chance."""
    margins = [m.margin(i, v) for m in model.between]
    if len(model.families) == 1:
        return next(iter(model.families)), 1.0
    if len(model.families) == 2:
        m = model.between[0]
        return (m.first if margins[0] >= 0 else m.second), chance(abs(margins[0]))
    k = int(np.argmax(margins))
    return model.between[k].first, chance(margins[k])


def vote(names: list[str], machines: list[Machine], i: np.ndarray, v: np.ndarray) -> tuple[str, float]:
    """The name with most votes (then with the largest margins) and how sure its closest duel was, as a chance."""
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for m in machines:
        margin = m.margin(i, v)
        for name, sign in ((m.first, 1), (m.second, -1)):
            votes[name] += sign * margin > 0
            sums[name] += sign * margin
            least[name] = min(least[name], chance(sign * margin))
    best = max(names, key=lambda n: (votes[n], sums[n]))
    return best, least[best]


def predict(model: Model, text: str | None) -> tuple[str, float]:
    raw = letters(text) if text else b""
    if not raw or not model.families:
        return "und", 0.0
    n = np.bincount(grams(raw))
    i = np.flatnonzero(n)
    v = np.sqrt(n[i] / n.sum()).astype(np.float32)
    family, sure = family_of(model, i, v)
    lang, surer = vote(model.families[family], model.within[family], i, v)
    return lang, sure * surer


def identified(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs(text, ...) -> the same columns (but for clashing ones) + lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some MB for each dozen languages, whatever the corpus
    keep = [c for c in docs.columns if c not in (lang, score)]
    d = docs.select(*keep)

    def rows(batches):
        for b in batches:
            got = [predict(held.value, t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, lang, score])

    return d.mapInArrow(rows, StructType([*d.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]))
