"""Toxicity by a weighted grammar of clauses.

Small transducers read the words of a clause together: a lexicon turns words into insults with weights, others
track negation, reported speech, a person spoken to, and threats (a verb of harm near a person or an insult).
Their composition emits weighted events, each marked with the states it happened in. A document's score is a
logistic function of its events, so an insult counts for what it is worth where it stands.

Both lexicon and logistic weights are learned from labelled documents. The lexicon holds whole words and
proper beginnings of words, as inflected languages need. The logistic weights are fitted on documents that
the lexicon they see was not made from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm.staging import stage

# Function words of English, German, French and Spanish.
NEGATORS = frozenset("not no never nor without n't nicht kein keine keinen nie weder pas ne jamais aucun aucune sans no nunca jamás sin".split())
REPORTERS = frozenset(
    "said says wrote writes called claims quoted quote reported sagte sagt schrieb nannte zitiert dit disait écrit "
    "appelé cité dijo dice escribió llamó citó".split())
PERSONS = frozenset("you your you're u he she they him her them du dich dir ihr euch sie tu te toi vous il elle usted ustedes te ti él ella".split())
HARMS = frozenset("kill hurt beat destroy shoot stab töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_QUOTES = re.compile("[\"“”„«»]")
_REACH = 4  # words over which a negation, a person or a harm is felt
KNOWN_WORDS, HELD_FEATURES = 150_000, 100_000  # kept in a task before it starts anew; bounds its memory
_EVENTS = ("plain", "negated", "reported", "aimed", "threat")
_PREFIXES = range(3, 9)


@dataclass(frozen=True)
class Machine:
    """A transducer over word classes: a counter set by one class and run down by every word."""

    opens: str
    lasts: int  # words until it closes; 0: until the clause ends

    def step(self, state: int, word_class: str) -> int:
        if word_class == self.opens:
            return self.lasts or -1
        return state - 1 if state > 0 else state


_NEGATION, _REPORT, _PERSON, _HARM = Machine("negator", _REACH), Machine("reporter", 0), Machine("person", _REACH), Machine("harm", _REACH)


@dataclass(frozen=True)
class Model:
    """Learned parts. ``lexicon`` maps ``=word`` and ``beginning+`` to weights in log odds."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()

    def word_weight(self, word: str) -> float:
        found = [self.lexicon.get("=" + word, 0.0)]
        found += [self.lexicon.get(word[:k] + "+", 0.0) for k in _PREFIXES if k < len(word)]
        return max(found)


def _features_of(word: str) -> list[str]:
    return ["=" + word, *[word[:k] + "+" for k in _PREFIXES if k < len(word)]]


class Reader:
    """Runs the composed machines over documents; remembers the class and weight of words seen, up to a bound."""

    def __init__(self, model: Model) -> None:
        self._model, self._known = model, {}

    def _look(self, word: str) -> tuple[str, float]:
        if len(self._known) > KNOWN_WORDS:
            self._known.clear()
        weight = self._model.word_weight(word)
        kind = "insult" if weight > 0 else next(
            (k for k, s in (("negator", NEGATORS), ("reporter", REPORTERS), ("person", PERSONS), ("harm", HARMS)) if word in s), "word")
        self._known[word] = kind, weight
        return kind, weight

    def clause(self, words: list[str], quoted: bool) -> list[tuple[str, float]]:
        """The weighted events of one clause."""
        known, look = self._known, self._look
        read = [known.get(w) or look(w) for w in words]
        if not any(k in ("insult", "harm") for k, _ in read):
            return []
        negated = person = harm = 0
        reported = -1 if quoted else 0
        events = []
        for kind, weight in read:
            negated, reported = _NEGATION.step(negated, kind), _REPORT.step(reported, kind)
            person, harm = _PERSON.step(person, kind), _HARM.step(harm, kind)
            if harm and kind in ("person", "insult"):
                events.append(("threat", 1.0))
            if kind == "insult":
                events.append(("negated" if negated else "reported" if reported else "aimed" if person else "plain", weight))
        return events

    def features(self, text: str | None) -> np.ndarray:
        """What the logistic part sees: a constant, the length, and per kind of event its best clause and its sum."""
        best, total, words_read, matched = Counter(), Counter(), 0, set()
        for clause in _CLAUSE.split((text or "").lower()):
            words = _WORD.findall(clause)
            words_read += len(words)
            here = Counter()
            for kind, weight in self.clause(words, bool(_QUOTES.search(clause))):
                here[kind] += weight
            for kind, weight in here.items():
                best[kind] = max(best[kind], min(weight, 12.0))
                total[kind] += weight
            if here:
                matched.add(clause)
        density = math.log1p(100 * len(matched) / (words_read + 20))
        return np.array([1.0, math.log1p(words_read) / 4, density, math.log1p(len(matched)), *[best[k] / 4 for k in _EVENTS], *[math.log1p(total[k]) for k in _EVENTS]])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self._model.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each feature, by label and half, added up within a task."""
    counts: dict[str, list[int]] = {}

    def made() -> pd.DataFrame:
        return pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["feature", "clean_a", "toxic_a", "clean_b", "toxic_b"])

    for batch in batches:
        for text, toxic, half in zip(batch["text"], batch["toxic"], batch["half"]):
            for feature in {f for w in set(_WORD.findall((text or "").lower())) for f in _features_of(w)}:
                counts.setdefault(feature, [0, 0, 0, 0])[2 * half + toxic] += 1
        if len(counts) > HELD_FEATURES:
            yield made()
            counts = {}
    yield made()


def _lexicon(rows: list, toxic: int, clean: int, of: tuple[str, ...], least: int) -> dict[str, float]:
    """Features with enough support and a log ratio that is large and certain."""
    found = {}
    for r in rows:
        t, c = sum(r[f"toxic_{k}"] for k in of), sum(r[f"clean_{k}"] for k in of)
        a, b = (t + 0.5) / (toxic + 1), (c + 0.5) / (clean + 1)
        ratio = math.log(a / b)
        sure = ratio - 1.64 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= least and ratio > 1.5 and sure > 0.7:
            found[r["feature"]] = ratio
    return found


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic weights by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, lexicon: int = 20_000, least: int = 4) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, held-out rows left aside.

    At most ``sample`` labelled rows are used, those of the smallest hash of their id, and at most ``lexicon``
    features, those of most toxic documents; both bound what comes to the driver. Labels other than 0 and 1 and
    null ids are left out. Without labels of both kinds, the score is the share of toxic ones (0 without any).
    """
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(
        ~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    half = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).cast("int")
    # bounded by the sample's size
    known = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", half.alias("half")), "labelled")
    sizes = {(r[0], r[1]): r[2] for r in known.groupBy("half", "toxic").count().collect()}
    toxic, clean = [sum(v for (_, t), v in sizes.items() if t == k) for k in (1, 0)]
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Model({}, (math.log((share + 1e-9) / (1 - share + 1e-9)), *[0.0] * (3 + 2 * len(_EVENTS))))
    counted = known.mapInPandas(_counts, "feature string, clean_a long, toxic_a long, clean_b long, toxic_b long")
    rows = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]]).where(
        f"toxic_a + toxic_b >= {least} AND (toxic_a + toxic_b) * {clean} > 4 * (clean_a + clean_b) * {toxic}").orderBy(
        F.desc(F.col("toxic_a") + F.col("toxic_b")), "feature").limit(lexicon).collect()
    first = Model(_lexicon(rows, sizes.get((0, 1), 0), sizes.get((0, 0), 0), ("a",), least), ())

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(first)
        for batch in batches:
            yield pd.DataFrame({"x": [reader.features(t).tolist() for t in batch["text"]], "y": batch["toxic"]})

    seen = known.where("half = 1").mapInPandas(see, "x array<double>, y int").collect()
    if len({r["y"] for r in seen}) < 2:  # too few labels to set a half aside
        first = Model(_lexicon(rows, toxic, clean, ("a", "b"), least), ())
        seen = known.mapInPandas(see, "x array<double>, y int").collect()
    weights = _fit(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float))
    return Model(_lexicon(rows, toxic, clean, ("a", "b"), least), weights)


def scores(text: Column, model: Model) -> Column:
    """The toxicity of whole texts, from 0 to 1. Null and empty texts get the score of no event."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model)
        for part in texts:
            yield part.map(reader.score, na_action=None).astype(float)

    return run(text)
