"""Toxicity by a weighted grammar of small transducers over clauses.

A lexicon turns words into symbols (insult, threat, target, negation, report). Two transducers rewrite what they govern:
negation marks the hostile words of the next few words, reported speech those of the rest of the clause. Three
acceptors then remember the hostile words and targets of the clause. Their composition is one automaton; the state in
which it leaves a clause names the pattern (an insult at a target, a denied threat, ...), and a document's score is a
logistic function of how many clauses match each pattern.

Insults are learned as word stems from labelled documents: a stem counts if it follows toxic labels far beyond
chance, measured by the different words after it, so that copies of one document count once. Pattern weights are
fitted to the labels around prior weights that state the grammar. The fit sees a bounded sample of the
labelled training rows (``SAMPLE_ROWS`` per label, ``SAMPLE_BYTES`` of text in all); every document is scored in full.

Defined results: a null or empty text matches no pattern and gets the score of the bias; a null key is hashed as
an empty text; repeated rows are scored each; labels that repeat a key count as toxic if one is; no labels leave the
prior weights and no stems.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 16 << 20
HELD_OUT_FOLD = (5, 0)
STEM_LENGTHS = range(3, 7)
NEGATION_SCOPE = 3

# Seed words of the grammar, by symbol. Insults have no seeds.
WORDS = {
    "threat": "kill hurt destroy shoot stab burn beat punish töten schlagen zerstören tuer détruire frapper matar destruir golpear",
    "target": "you your yours he she him her they them these those du dich dein ihr sie tu toi vous ton il elle ils elles usted ustedes tú él ella ellos",
    "negation": "not no never nobody nothing without nicht kein keine niemals nie pas jamais aucun sans nunca nadie sin",
    "report": "said says say wrote writes told called quoted claimed sagte sagt schrieb dit disait écrit dijo dice escribió",
}

_WORD = re.compile(r"[^\W\d_]+")
# A colon or a quotation mark does not end a clause: what is reported stands behind it.
CLAUSE_ENDS = ".!?;\n"
_CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")


# --- transducers ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs (state, symbol) -> (state, symbol out); any other symbol follows ``otherwise`` and stays."""

    start: object
    arcs: dict
    otherwise: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol)


def negation(scope: int = NEGATION_SCOPE) -> Transducer:
    arcs = {(s, "negation"): (scope, "negation") for s in range(scope + 1)}
    arcs |= {(s, w): (s - 1, f"{w}-denied") for s in range(1, scope + 1) for w in ("insult", "threat")}
    return Transducer(0, arcs, {s: s - 1 for s in range(1, scope + 1)})


def reported() -> Transducer:
    arcs = {(s, "report"): (1, "report") for s in (0, 1)}
    hostile = [w + d for w in ("insult", "threat") for d in ("", "-denied")]
    return Transducer(0, arcs | {(1, w): (1, w.split("-")[0] + "-reported") for w in hostile}, {})


def memory(word: str) -> Transducer:
    """Remembers the gravest form of ``word``: none, reported, denied, plain. A report verb after it makes it reported."""
    forms = ["", f"{word}-reported", f"{word}-denied", word]
    arcs = {(a, b): (max(a, b, key=forms.index), b) for a in forms for b in forms[1:]}
    return Transducer("", arcs | {(a, "report"): (f"{word}-reported", "report") for a in forms[1:]}, {})


def compose(first: Transducer, second: Transducer, symbols) -> Transducer:
    """What ``second`` makes of the output of ``first``, as one transducer over ``symbols``."""
    start, arcs = (first.start, second.start), {}
    todo, seen = [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in symbols:
            a2, between = first.step(a, symbol)
            b2, out = second.step(b, between)
            arcs[state, symbol] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(start, arcs, {})


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


def _flat(state) -> list:
    return [x for part in state for x in _flat(part)] if isinstance(state, tuple) else [state]


def grammar() -> tuple[Transducer, dict]:
    """The composed automaton, and the pattern each of its states stands for."""
    machine = negation()
    for part in (reported(), memory("insult"), memory("threat"), memory("target")):
        machine = compose(machine, part, SYMBOLS)
    patterns = {}
    for state in {s for s, _ in machine.arcs}:
        _neg, _rep, insult, threat, target = _flat(state)
        aimed = "+target" if target else ""
        patterns[state] = tuple(word + aimed for word in (insult, threat) if word)
    return machine, patterns


# Prior weight of a pattern for one clause, before labels are seen.
PRIORS = {
    "bias": -3.0,
    **{f"insult{form}{aim}": w + (0.5 if aim else 0.0) for form, w in (("", 4.0), ("-denied", 2.0), ("-reported", 1.5)) for aim in ("", "+target")},
    **{f"threat{form}{aim}": w + (2.0 if aim else 0.0) for form, w in (("", 0.5), ("-denied", 0.0), ("-reported", 0.0)) for aim in ("", "+target")},
}
FEATURES = tuple(PRIORS)


class Grammar:
    """Counts the patterns of a text's clauses, given learned insult stems."""

    def __init__(self, stems: list[str]):
        self.machine, self.patterns = grammar()
        self.lexicon = {w: symbol for symbol, listed in WORDS.items() for w in listed.split()}
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.stems = frozenset(stems)
        hostile = "|".join(filter(None, [_trie(stems), rf"(?:{_trie(WORDS['threat'].split())})(?!\w)"]))
        self.hostile = re.compile(rf"(?<!\w)(?:{hostile})")

    def symbol(self, word: str) -> str:
        for length in self.lengths:
            if word[:length] in self.stems:
                return "insult"
        return self.lexicon.get(word, "other")

    def counts(self, text: str | None) -> Counter:
        """How many clauses match each pattern. Clauses without a hostile word are passed over."""
        found: Counter = Counter()
        low, begin = (text or "").lower(), 0
        for hit in self.hostile.finditer(low):
            if hit.start() < begin:
                continue
            start = max([begin, *(low.rfind(c, begin, hit.start()) + 1 for c in CLAUSE_ENDS)])
            stop = _CLAUSE_END.search(low, hit.end())
            begin = stop.end() if stop else len(low)
            state = self.machine.start
            for word in _WORD.finditer(low, start, begin):
                state, _out = self.machine.step(state, self.symbol(word[0]))
            found.update(self.patterns[state])
        return found

    def features(self, text: str | None) -> list[float]:
        found = self.counts(text)
        return [1.0, *(math.log1p(found[name]) if found else 0.0 for name in FEATURES[1:])]


def _trie(words: list[str]) -> str:
    """A pattern for any of ``words`` that shares their beginnings; a shorter word wins over its extensions."""
    below, whole = defaultdict(list), False
    for w in words:
        if w:
            below[w[0]].append(w[1:])
        else:
            whole = True
    if whole or not below:
        return ""
    branches = [re.escape(c) + _trie(rest) for c, rest in sorted(below.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


# --- learning ------------------------------------------------------------------------------------------------------


def learned_stems(texts: list[str], toxic: list[int], lengths=STEM_LENGTHS, doubt: float = 0.01) -> list[str]:
    """Word stems that mark toxic texts: few clean texts have them, and chance cannot explain how often toxic ones do."""
    def stems_of(text):
        return {w[:k] for w in set(_WORD.findall(text.lower())) for k in lengths if len(w) >= k}

    hostile = Counter(s for t, y in zip(texts, toxic) if y for s in stems_of(t))
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    if not n_toxic or not n_clean:
        return []
    share = sum(len(t) for t, y in zip(texts, toxic) if y) / max(1, sum(map(len, texts)))
    needed = math.ceil(math.log(doubt / max(1, len(hostile))) / math.log(min(max(share, 1e-3), 0.9)))
    candidates = {s for s, n in hostile.items() if n >= 3}
    clean = Counter(s for t, y in zip(texts, toxic) if not y for s in stems_of(t) & candidates)
    candidates = {s for s in candidates if clean[s] / n_clean <= 0.005 * hostile[s] / n_toxic}
    after = defaultdict(set)
    for t, y in zip(texts, toxic):
        if y:
            found = _WORD.findall(t.lower())
            for w, following in zip(found, [*found[1:], ""]):
                for k in lengths:
                    if len(w) >= k and w[:k] in candidates:
                        after[w[:k]].add(following)
    good = {s for s in candidates if len(after[s]) >= needed}

    def narrowed(stem):
        """The longest stem that covers nearly all of this one."""
        longer = [s for s in good if len(s) == len(stem) + 1 and s.startswith(stem) and hostile[s] >= 0.97 * hostile[stem]]
        return narrowed(max(longer, key=lambda s: (hostile[s], s))) if longer else stem

    shortest = [s for s in good if not any(s[:k] in good for k in range(1, len(s)))]
    return sorted(narrowed(s) for s in shortest)


def fitted_weights(rows: np.ndarray, toxic: np.ndarray, strength: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic weights of the patterns, drawn towards the priors (Newton steps)."""
    prior = np.array([PRIORS[name] for name in FEATURES])
    weights = prior.copy()
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (p - toxic) + strength * (weights - prior)
        curvature = (rows * (p * (1 - p))[:, None]).T @ rows + strength * np.eye(len(prior))
        step = np.linalg.solve(curvature, gradient)
        weights = weights - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    weights: tuple[float, ...]


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Learn from labelled rows outside the held-out fold: ``sample_rows`` of each label, in the order of a hash."""
    parts, held = HELD_OUT_FOLD
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), parts) != held))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(label).cast("int")).alias("_toxic"))
        .withColumn("_order", F.xxhash64("_key"))
    )
    chosen = []
    for value in (0, 1):
        chosen += known.where(F.col("_toxic") == value).orderBy("_order", "_key").limit(sample_rows).collect()
    picked = docs.sparkSession.createDataFrame(chosen, known.schema)  # 2 * sample_rows at most
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), "_key")
    rows = rows.where(F.length("_text") <= sample_bytes // 64)
    once = rows.groupBy("_key", "_toxic", "_order").agg(F.min("_text").alias("_text"))
    bytes_so_far, texts, toxic = 0, [], []
    for row in once.orderBy("_order", "_key").toLocalIterator():
        bytes_so_far += len(row["_text"])
        if bytes_so_far > sample_bytes:
            break
        texts.append(row["_text"])
        toxic.append(row["_toxic"])
    stems = learned_stems(texts, toxic)
    reader = Grammar(stems)
    features = np.array([reader.features(t) for t in texts]).reshape(-1, len(FEATURES))
    return Model(tuple(stems), tuple(fitted_weights(features, np.array(toxic, float))))


# --- scoring -------------------------------------------------------------------------------------------------------


def scorer(model: Model):
    """A column function: text to score."""
    def score(texts: pa.Array) -> pa.Array:
        if "reader" not in state:
            state["reader"] = Grammar(list(model.stems))
        reader, bias, weights = state["reader"], model.weights[0], model.weights
        out = []
        for text in texts:  # one at a time, so that a batch is not held twice
            found = reader.counts(text.as_py())
            total = bias + sum(w * math.log1p(found[n]) for n, w in zip(FEATURES[1:], weights[1:]) if n in found)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        return pa.array(out, pa.float64())

    state: dict = {}
    return F.arrow_udf(score, "double")


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from a score of 0.5 on)."""
    parts, held = HELD_OUT_FOLD
    return (
        docs.withColumn("held_out", fold(F.col(key), parts) == held)
        .withColumn("score", scorer(model)(F.col(text)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
