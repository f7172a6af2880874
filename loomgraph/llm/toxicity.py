"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into classes: insults with weights, threats, targets, negation, reported speech, modal verbs. Five
weighted transducers read the classes of a clause: an insult or threat is marked as off within reach of a negation, as
said after reported speech or inside quotation marks, as aimed near a target before or after it, as meant after a modal
verb. Each copies what it reads and adds its mark, so their composition writes all marks; its arcs carry the product of
their weights. The best path through a clause says which insults and threats match and in which pattern. A document's
score is a logistic function of the weights that its matched clauses collect; isolated words have none.

Closed classes are fixed lists. The lexicon comes from the labelled rows: document counts of all of them, over distinct
texts. Arc weights are chosen by likelihood from ordered ranges, so that a negated or reported insult never weighs as
much as one aimed at somebody; a pattern that no fitted row shows keeps its first value. Rows whose crc32 of doc_id
leaves 0 mod 5 are held out.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one

FOLDS = 5
#: The logistic model is fitted on about so many labelled rows, chosen by hash.
MAX_FITTED = 20_000
#: An entry of the lexicon is in so many toxic texts and in this share of them, which bounds the lexicon at every size.
LEAST_DOCS, LEAST_SHARE = 3, 0.0005
LEAST_WINS, LEAST_WEIGHT, WINS_FROM = 2, 2.0, 0.3
STEMS = (4, 5, 6, 7, 8)
#: Labels up to this many rows are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 2_000_000
_COUNTED_TOGETHER, _KNOWN_WORDS = 120_000, 40_000

# Fixed word lists of the closed classes, in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself he him she her they them their these those people du dich dir dein deine ihr euch sie ihn ihm tu te toi ton ta vous votre vos il elle ils elles eux usted ustedes tus él ella ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody neither nor without isnt arent wasnt dont doesnt didnt cant wont nicht kein keine keinen nie niemals ne pas jamais aucun aucune sans nunca jamás tampoco sin ningún ninguna".split())
REPORTS = frozenset("said says say told tells wrote writes called calls claimed claims quoted quote quoting according reported sagte sagt schrieb nannte zitiert dit disait écrit appelé selon cité dijo dice escribió llamó según citó".split())
MODALS = frozenset("will gonna going should must ought deserve deserves let shall werde wirst soll sollte muss va vais doit devrait voy debe debería".split())
THREATS = frozenset("kill hurt beat shoot stab burn destroy hang strangle murder töten umbringen schlagen sterben tuer frapper brûler mourir matar golpear quemar morir".split())

THREAT_WEIGHT = 4.0

OTHER, TARGET, NEGATION, REPORT, MODAL, THREAT, INSULT = range(7)
PATTERNS = ("plain", "aimed", "negated", "reported", "threat", "threat off")
#: What the weight of an insult or threat is multiplied with in each pattern: the values it may take, the first by default.
FACTORS = ((1.0,), (1.25, 1.5, 2.0), (0.25, 0.1, 0.5), (0.5, 0.25, 0.7), (1.25, 2.0), (0.25, 0.5))
#: Bias and slope of the logistic function before any label is seen.
PRIOR = (-3.0, 1.3)
REACH, NEGATION_REACH = 4, 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”")
_CLASSES = {w: k for k, words in ((MODAL, MODALS), (THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in words}


@dataclass(frozen=True)
class Transducer:
    """arcs: for a state and a class, the arcs (next state, marks written beside the class, weight)."""

    start: Hashable
    final: frozenset
    arcs: dict[tuple[Hashable, int], tuple[tuple[Hashable, tuple[str, ...], float], ...]]

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: both read the classes, and the second passes on the marks of the first with its own."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for c in range(7):
                both = itertools.product(self.arcs.get((state[0], c), ()), other.arcs.get((state[1], c), ()))
                arcs[state, c] = tuple(((a, b), m + n, x * y) for (a, m, x), (b, n, y) in both)
                for target, _, _ in arcs[state, c]:
                    if target not in seen:
                        seen.add(target)
                        todo.append(target)
        return Transducer(start, frozenset(s for s in seen if s[0] in self.final and s[1] in other.final), arcs)


def lexical() -> Transducer:
    """Insults and threats are written as such."""
    names = {INSULT: ("insult",), THREAT: ("threat",)}
    return Transducer(0, frozenset([0]), {(0, c): ((0, names.get(c, ()), 1.0),) for c in range(7)})


def within(opens: int, reach: int, mark: str) -> Transducer:
    """Marks insults and threats up to `reach` words after a word of class opens. A state is how many words are left."""
    arcs = {}
    for left in range(reach + 1):
        for c in range(7):
            marks = (mark,) if left and c in (INSULT, THREAT) else ()
            arcs[left, c] = ((reach if c == opens else max(left - 1, 0), marks, 1.0),)
    return Transducer(0, frozenset(range(reach + 1)), arcs)


def reported(quoted: bool) -> Transducer:
    """Marks insults and threats after a word of reporting, or all of them in quotation marks."""
    arcs = {(s, c): ((1 if c == REPORT else s, ("said",) if s and c in (INSULT, THREAT) else (), 1.0),) for s in (0, 1) for c in range(7)}
    return Transducer(int(quoted), frozenset((0, 1)), arcs)


def aimed(reach: int = REACH, bonus: float = 1.25) -> Transducer:
    """Marks insults and threats with a target up to `reach` words before them, or after them.

    For a target to come the machine guesses: state -k is a promise of one within k words, and no path ends in one.
    """
    arcs = {}
    for left in range(-reach, reach + 1):
        for c in range(7):
            after = reach if c == TARGET else left - 1 if left > 0 else left + 1
            if left == -1 and c != TARGET:
                arcs[left, c] = ()  # a promise broken
            elif c not in (INSULT, THREAT):
                arcs[left, c] = ((after if left or c == TARGET else 0, (), 1.0),)
            elif left:
                arcs[left, c] = ((after, ("aimed",), bonus),)
            else:
                arcs[left, c] = ((0, (), 1.0), (-reach, ("aimed",), bonus))
    return Transducer(0, frozenset(range(reach + 1)), arcs)


def pattern(marks: tuple[str, ...]) -> int:
    """The pattern that marks make, or -1: a threat needs a modal verb and somebody it is meant for."""
    off = "off" in marks
    if "insult" in marks:
        return 2 if off else 3 if "said" in marks else 1 if "aimed" in marks else 0
    if "threat" in marks and "meant" in marks and "aimed" in marks:
        return 5 if off or "said" in marks else 4
    return -1


class Machine:
    """The composition of all transducers, its states numbered."""

    def __init__(self, quoted: bool):
        whole = lexical() @ within(NEGATION, NEGATION_REACH, "off") @ reported(quoted) @ within(MODAL, REACH, "meant") @ aimed()
        number = {s: i for i, s in enumerate(dict.fromkeys([whole.start, *(s for s, _ in whole.arcs)]))}
        self.final = frozenset(number[s] for s in whole.final)
        self.arcs = [[()] * 7 for _ in number]
        for (s, c), arcs in whole.arcs.items():
            self.arcs[number[s]][c] = tuple((number[t], pattern(marks), weight) for t, marks, weight in arcs)

    def best_path(self, clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """Patterns and lexical weights written on the path of the highest weight through a clause of (class, weight)."""
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for kind, weight in clause:
            grown: dict[int, tuple[float, tuple]] = {}
            for state, (total, out) in paths.items():
                for target, found, factor in self.arcs[state][kind]:
                    new = total + factor * weight if found >= 0 else total
                    if target not in grown or new > grown[target][0]:
                        grown[target] = (new, (out, found, weight) if found >= 0 else out)
            paths = grown
        out = max((paths[s] for s in sorted(paths) if s in self.final), key=lambda p: p[0])[1]
        written = []
        while out:
            out, found, weight = out
            written.append((found, weight))
        return written[::-1]


_MACHINES: dict[bool, Machine] = {}


def machine(quoted: bool) -> Machine:
    if quoted not in _MACHINES:
        _MACHINES[quoted] = Machine(quoted)
    return _MACHINES[quoted]


def held_out(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a row's label is never learned from; rows without an id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def features_of(words: set[str]) -> set[str]:
    """Words and stems, the latter marked by a star."""
    found = set(words)
    for n in STEMS:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


@dataclass
class Grammar:
    """The lexicon of insults, the patterns' factors, and bias and slope of the logistic function."""

    lexicon: dict[str, float] = field(default_factory=dict)
    factors: tuple[float, ...] = tuple(x[0] for x in FACTORS)
    weights: tuple[float, float] = PRIOR
    known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "factors": self.factors, "weights": self.weights, "known": {}}

    def classify(self, word: str) -> tuple[int, float]:
        """Class of a word and its weight."""
        found = self.known.get(word)
        if found is None:
            weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n)])
            kind = INSULT if weight else _CLASSES.get(word.replace("'", "").replace("’", ""), OTHER)
            found = (kind, weight or (THREAT_WEIGHT if kind == THREAT else 0.0))
            if len(self.known) < _KNOWN_WORDS:
                self.known[word] = found
        return found

    def matched(self, text: str | None) -> list[list[tuple[int, float]]]:
        """Of each clause with insults or threats that match: their patterns and weights."""
        if not text:
            return []
        words = _WORD.findall(text.lower())
        kinds = {w: self.classify(w) for w in set(words)}
        if not any(weight for _, weight in kinds.values()):
            return []
        found, clause, hit, quoted = [], [], False, False

        def close() -> None:
            if hit and (written := machine(quoted).best_path(clause)):
                found.append(written)

        for w in words:
            if w in _ENDS or w in _QUOTES:
                close()
                # a report still holds for what follows in quotation marks
                clause = [c for c in clause if c[0] == REPORT] if w in _QUOTES else []
                hit, quoted = False, quoted != (w in _QUOTES)
            else:
                clause.append(kinds[w])
                hit = hit or kinds[w][1] > 0
        close()
        return found

    def features(self, text: str | None) -> list[float]:
        """The weight collected in each pattern."""
        return _sums(self.matched(text))

    def score(self, sums: list[float]) -> float:
        z = self.weights[0] + self.weights[1] * math.log1p(sum(f * s for f, s in zip(self.factors, sums, strict=True)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _sums(matched: list[list[tuple[int, float]]]) -> list[float]:
    sums = [0.0] * len(PATTERNS)
    for clause in matched:
        for found, weight in clause:
            sums[found] += weight
    return sums


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled rows that are not held out; a document labelled twice counts as toxic if either says so. Labels without a document, or whose text is null, are left out."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labels")
    few = known.count() <= MAX_BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic").filter("text IS NOT NULL")


def _words(text: str) -> set[str]:
    return {w for w in _WORD.findall(text.lower()) if w not in _ENDS and w not in _QUOTES}


def _counts(rows: DataFrame) -> DataFrame:
    """feature, toxic and other: in how many texts of either label each word or stem is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(both[0].keys() | both[1].keys())
            batch = pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in both)], names=["feature", "toxic", "other"])
            for c in both:
                c.clear()
            return batch

        for batch in batches:
            for text, toxic in zip(one_by_one(batch.column(0)), one_by_one(batch.column(1)), strict=True):
                both[0 if toxic else 1].update(features_of(_words(text)))
                if len(both[0]) + len(both[1]) > _COUNTED_TOGETHER:
                    yield out()
        yield out()

    return of_texts(rows).mapInArrow(run, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _wins(rows: DataFrame, candidates: dict[str, tuple[float, int]]) -> DataFrame:
    """feature and wins: for how many toxic texts a candidate's evidence (weight times texts) is near the best that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won: Counter = Counter()
        for batch in batches:
            for text in one_by_one(batch.column(0)):
                held = features_of(_words(text)) & candidates.keys()
                strength = {x: candidates[x][0] * candidates[x][1] for x in held}
                won.update(x for x, s in strength.items() if s >= WINS_FROM * max(strength.values()))
        yield pa.record_batch([pa.array(list(won), pa.string()), pa.array(list(won.values()), pa.int64())], names=["feature", "wins"])

    return rows.filter("toxic = 1").select("text").mapInArrow(run, "feature string, wins long").groupBy("feature").agg(F.sum("wins").alias("wins"))


def fit(docs: DataFrame, labels: DataFrame, max_fitted: int = MAX_FITTED) -> Grammar:
    """Learn the insults' weights, the patterns' factors and the logistic function from docs (doc_id, text) and labels (doc_id, toxic).

    Equal texts count once, as toxic if one label says so, so repeated rows change nothing. Null ids, texts and labels,
    labels without a document, documents without a label and other columns are left out. Without labels of both kinds
    the grammar has its fixed parts only.
    """
    rows = materialize(_training(docs, labels).groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "training")
    sizes = {bool(t): n for t, n in rows.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Grammar()
    weight = F.log((F.col("toxic") + 0.5) / (sizes[True] + 1)) - F.log((F.col("other") + 0.5) / (sizes[False] + 1))
    found = _counts(rows).filter(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * sizes[True])).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
    # as many as the words and stems of 1 / LEAST_SHARE texts at most
    candidates = {r.feature: (r.weight, r.toxic) for r in found.collect()}
    wins = [r.feature for r in _wins(rows, candidates).filter(F.col("wins") >= LEAST_WINS).collect()]
    grammar = Grammar({x: candidates[x][0] for x in sorted(wins)})
    share = max_fitted / (sizes[True] + sizes[False])
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(1e6 * share))
    seen = sample.mapInArrow(_featured(grammar), "features array<double>, toxic int").collect()
    if seen:
        grammar.factors, grammar.weights = _fitted(np.array([r.features for r in seen]), np.array([float(r.toxic) for r in seen]))
    return grammar


def _featured(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.features(t) for t in one_by_one(batch.column(0))]
            yield pa.record_batch([pa.array(found, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["features", "toxic"])

    return run


def _fitted(sums: np.ndarray, toxic: np.ndarray) -> tuple[tuple[float, ...], tuple[float, float]]:
    """Factors and weights of the highest likelihood: one pattern's factor after the other, until none changes."""

    def logistic(factors: list[float]) -> tuple[float, tuple[float, float]]:
        x = np.c_[np.ones(len(sums)), np.log1p(sums @ np.array(factors))]
        w = np.array(PRIOR)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (toxic - p) - 0.05 * (w - PRIOR)
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), slope)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
        return float(np.log(np.where(toxic > 0, p, 1 - p)).sum()), (float(w[0]), float(w[1]))

    factors = [x[0] for x in FACTORS]
    best = logistic(factors)
    changed = True
    while changed:
        changed = False
        for i, values in enumerate(FACTORS):
            for value in values:
                tried = logistic([*factors[:i], value, *factors[i + 1 :]])
                if tried[0] > best[0] + 1e-9:
                    best, factors[i], changed = tried, value, True
    return tuple(factors), best[1]


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Add score, predicted and clauses (how many clauses matched) to docs, in place of columns of these names.

    A null or empty text gets the score of a text without matches. Whole texts are read. Rows are scored one by one,
    repeated or not; an empty table stays empty.
    """

    @F.arrow_udf("struct<score: double, clauses: int>")
    def scored(texts: pa.Array) -> pa.Array:
        found = [grammar.matched(t) for t in one_by_one(texts)]
        return pa.StructArray.from_arrays([pa.array([grammar.score(_sums(m)) for m in found], pa.float64()), pa.array([len(m) for m in found], pa.int32())], names=["score", "clauses"])

    own = [c for c in docs.columns if c not in ("score", "predicted", "clauses")]
    out = of_texts(docs).select(*own, scored("text").alias("__s")).select(*own, F.col("__s.score").alias("score"), F.col("__s.clauses").alias("clauses"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
