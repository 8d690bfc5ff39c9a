"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labels: words, and beginnings of words, that toxic training documents hold far more often than the rest. It is stored as a trie.
A token is run through the product of the trie with the Levenshtein automaton of the allowed number of edits; its states
(sets of trie node and edits used) are built when first met, so a token costs a few dictionary reads. Beginnings of words
must match without edits, words up to ``edits_of(word)``.

Each match is weighed by its window of ``window`` tokens to either side: inside quotation marks or beside words of
reporting it counts as quoted, beside words of address or other matches as abuse. The sums of direct, quoted and misspelled
matches are the inputs of a logistic regression, fitted on the same bounded sample.

Terms are learned from different texts: of sample texts that share one of ``SIGNATURES`` least shingle hashes one is counted, so that the words of
a much copied text do not look like words of toxic texts. A term must be in ``LEAST_DOCS`` such toxic texts, however large the sample
is, have log odds of ``LEAST_LOG_ODDS``, and a likelihood ratio that chance gives to none of all candidates (``CHANCE``, shared out among them). No number of terms is
set. Candidates are words of ``LETTERS`` letters and beginnings of ``BEGINNING`` letters: what bounds them is the sample, of at most ``SAMPLE`` labelled rows.

Scoring maps the documents where they lie: no shuffle, no row limit, whole texts. What is sent to the executors is
the lexicon and a few coefficients.

Defined cases: null and empty texts have no matches and get the score of such documents; a null id is never held out; without
labels of both classes every score is the training share of toxic documents (0 without any labels); repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import _BASE, Shingler, mixed
from .labelled import sigmoid, training_sample
from .store import sliced, tidy, written

SAMPLE = 20_000
SIGNATURES = 4
LEAST_DOCS = 5
LEAST_LOG_ODDS = 2.5
CHANCE = 0.05
LETTERS, BEGINNING = range(3, 25), range(3, 8)
WINDOW = 6
TOKENS_KEPT, STATES_KEPT = 200_000, 50_000
#: Words of reporting and of address in the four languages.
REPORTING = frozenset("said says say called calls quote quoted quotes quoting word words term terms wrote reported meaning defined sagte sagt nannte zitat wort begriff dit disait appelle citation mot terme dijo dice llama cita palabra término".split())
ADDRESS = frozenset("you your yours you're youre u du dich dir dein deine ihr euch tu toi te vous ton ta tes votre vos tú ti usted ustedes vosotros tus".split())
QUOTES = "\"“”„«»‹›「」"
EDGES = string.punctuation + QUOTES + "…–—¡¿’‘"
_INSIDE = re.compile(r"[^\W\d_]+")


def edits_of(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 10 else 2


class Lexicon:
    """Terms in a trie, and the lazily built product automaton. A term that ends in * stands for all words that begin so."""

    def __init__(self, terms: dict[str, float]):
        self.weight = list(terms.values())
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int | None] = [None]
        self.stem: list[int | None] = [None]
        self.most = [0]  # edits that some term below allows
        for i, term in enumerate(terms):
            stem, text = term.endswith("*"), term.rstrip("*")
            allowed, node = 0 if stem else edits_of(text), 0
            self.most[0] = max(self.most[0], allowed)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    for column, empty in ((self.children, {}), (self.word, None), (self.stem, None), (self.most, 0)):
                        column.append(empty)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            (self.stem if stem else self.word)[node] = i
        self.allowed = [0 if t.endswith("*") else edits_of(t) for t in terms]
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple, int] = {(): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state: closed under leaving out characters of a term, without pairs that cost more than another of their node."""
        least: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = tuple(sorted(least.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        to: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if (child := self.children[node].get(c)) is not None:
                to.add((child, e))
            if e < self.most[node]:
                to.add((node, e + 1))
                to.update((child, e + 1) for child in self.children[node].values())
        self.moves[state][c] = new = self._state(to)
        return new

    def excludes(self, begin: str) -> bool:
        """No term matches a word that begins so."""
        state = self.start
        for c in begin:
            state = self._move(state, c)
            if any(e == 0 and self.stem[node] is not None for node, e in self.states[state]):
                return False
        return not state

    def match(self, word: str) -> tuple[int, int] | None:
        """The matching term with the fewest edits (heavier terms first) and its edits."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        state, stem = self.start, None
        for c in word:
            new = self.moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if not state:
                break
            for node, e in self.states[state]:
                if e == 0 and self.stem[node] is not None:
                    stem = self.stem[node]
        found = [(e, -self.weight[t], t) for node, e in self.states[state] if (t := self.word[node]) is not None and e <= self.allowed[t]]
        if found and (min(found)[0] == 0 or stem is None):
            return min(found)[2], min(found)[0]
        return None if stem is None else (stem, 0)


@dataclass
class Model:
    terms: dict[str, float]
    share: float
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)


class Scorer:
    """Matches and their sums for whole texts."""

    def __init__(self, terms: dict[str, float], window: int = WINDOW):
        self.lexicon, self.window = Lexicon(terms), window
        self.clean: set[str] = set()  # tokens known to match nothing, and those that match
        self.known: dict[str, tuple[int, int]] = {}
        self.dead: dict[str, bool] = {}

    def lookup(self, token: str) -> tuple[int, int] | None:
        low = token.lower().strip(EDGES)
        if low and not (low[0].isalnum() and low[-1].isalnum()):
            low = low.strip("".join(c for c in set(low) if not c.isalnum()))
        if not low:
            return None
        found = self._match(low)
        if found is None and not low.isalpha():
            found = min((m for p in _INSIDE.findall(low) if (m := self._match(p))), key=lambda m: m[1], default=None)
        return found

    def _match(self, word: str) -> tuple[int, int] | None:
        """As the lexicon's match; beginnings that no match can have are kept."""
        begin = word[:4]
        dead = self.dead.get(begin)
        if dead is None:
            if len(self.dead) >= TOKENS_KEPT:
                self.dead.clear()
            dead = self.dead[begin] = len(begin) == 4 and self.lexicon.excludes(begin)
        return None if dead else self.lexicon.match(word)

    def matches(self, text: str) -> list[tuple[int, int, int, bool, bool]]:
        """(token index, term, edits, quoted, abuse) of every match."""
        tokens = text.split()
        matching = set()
        for token in set(tokens) - self.clean:
            found = self.known.get(token) or self.lookup(token)
            if found is not None:
                matching.add(token)
                self.known[token] = found
            elif len(token) <= 64:
                self.clean.add(token)
        hits = [(i, self.known[t]) for i, t in enumerate(tokens) if t in matching] if matching else []
        if len(self.clean) > TOKENS_KEPT:
            self.clean.clear()
        if len(self.known) > TOKENS_KEPT:
            self.known.clear()
        out, at = [], [i for i, _ in hits]
        for k, (i, (term, edits)) in enumerate(hits):
            near = tokens[max(0, i - self.window) : i + self.window + 1]
            middle = i - max(0, i - self.window)
            before, after = near[:middle], near[middle + 1 :]
            own = tokens[i]
            opened = any(q in own[:1] for q in QUOTES) or sum(t.count(q) for t in before for q in QUOTES) % 2 == 1
            closed = any(q in own[1:] for q in QUOTES) or any(q in t for t in after for q in QUOTES)
            words = {t.strip(".,;:!?()").lower() for t in near}
            quoted = (opened and closed) or not words.isdisjoint(REPORTING)
            abuse = not words.isdisjoint(ADDRESS) or (k > 0 and i - at[k - 1] <= self.window) or (k + 1 < len(at) and at[k + 1] - i <= self.window)
            out.append((i, term, edits, quoted, abuse))
        return out

    def features(self, text: str, matches: list[tuple[int, int, int, bool, bool]] | None = None) -> list[float]:
        weight, n = self.lexicon.weight, max(1, text.count(" ") + 1)
        direct = quoted = fuzzy = abuse = 0.0
        terms, hits = set(), 0
        for _, term, edits, in_quotes, beside in self.matches(text) if matches is None else matches:
            w = weight[term]
            hits += 1
            if edits:
                fuzzy += w / (1 + edits)
                continue
            terms.add(term)
            if in_quotes and not beside:
                quoted += w
            else:
                direct += w
                abuse += w * beside
        return [math.log1p(direct), math.log1p(quoted), math.log1p(fuzzy), math.log1p(abuse), math.log1p(len(terms)), math.sqrt((direct + quoted) / n), math.sqrt(fuzzy / n), float(direct > 0), float(hits > 0)]


def _candidates(text: str) -> set[str]:
    out = set()
    for w in set(_INSIDE.findall(text.lower())):
        if len(w) in LETTERS:
            out.add(w)
        out.update(w[:k] + "*" for k in BEGINNING if k < len(w))
    return out


def without_copies(sample: DataFrame) -> DataFrame:
    """text and y of one row (the least id) of those of a class that share a least hash of their three-word shingles under one of
    ``SIGNATURES`` scrambles. The driver picks by the signatures of the bounded sample, a few numbers a row."""

    @tidy
    def run(batches):
        shingler = Shingler(3)
        for b in sliced(batches):
            sets = shingler.sets([t.encode() for t in b.column(0).to_pylist()])
            least = [[int(mixed(s ^ np.uint64((2 * i + 1) * _BASE % 2**64)).min().view(np.int64)) if len(s) else 0 for s in sets] for i in range(SIGNATURES)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), *(pa.array(x, pa.int64()) for x in least)], names=["doc_id", "y", *names])

    names = [f"s{i}" for i in range(SIGNATURES)]
    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("text", "y", "doc_id").mapInArrow(run, f"doc_id {id_type}, y int, " + ", ".join(f"{n} long" for n in names)).toArrow().sort_by("doc_id")
    y, keep = rows.column("y").to_numpy(), np.arange(len(rows))
    for n in names:
        _, first = np.unique(np.stack([y[keep], rows.column(n).to_numpy()[keep]]), axis=1, return_index=True)
        keep = np.sort(keep[first])
    chosen = sample.sparkSession.createDataFrame(rows.select(["doc_id"]).take(keep))
    return sample.join(F.broadcast(chosen), "doc_id").select("text", "y")


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Number of documents that hold each candidate term, summed in every task first."""

    @tidy
    def run(batches):
        c: Counter = Counter()
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                c.update(_candidates(t) if wanted is None else _candidates(t) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def likelihood_ratio(k: int, n: int, m: int, of: int) -> float:
    """Twice the log of how much likelier k of n and m of ``of`` are under two shares than under one."""
    if k + m == n + of:
        return 0.0
    x = np.array([k, n - k, m, of - m], float)
    all_in, all_out = (k + m) / (n + of), (n + of - k - m) / (n + of)
    share = np.array([k / n, (n - k) / n, m / of, (of - m) / of])
    base = np.array([all_in, all_out, all_in, all_out])
    on = x > 0
    return float(2 * (x[on] * np.log(share[on] / base[on])).sum())


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """The terms with their log odds, and the whole words of those that are beginnings."""
    rows = written(without_copies(sample), "toxicity-texts")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return {}
    a = {r.term: r.n for r in _counted(rows.where("y = 1"), None).where(F.col("n") >= LEAST_DOCS).collect()}
    if not a:
        return {}
    b = {r.term: r.n for r in _counted(rows.where("y = 0"), frozenset(a)).collect()}
    odds = {t: math.log((n + 0.5) / (toxic - n + 0.5)) - math.log((b.get(t, 0) + 0.5) / (clean - b.get(t, 0) + 0.5)) for t, n in a.items()}
    # The ratio exceeds this with a probability below CHANCE / candidates: P(chi-square of one degree > 2 x) < exp(-x).
    least = 2 * math.log(len(a) / CHANCE)
    good = {t for t, o in odds.items() if o >= LEAST_LOG_ODDS and likelihood_ratio(a[t], toxic, b.get(t, 0), clean) >= least}
    # A beginning that is nearly always continued in one way gives way to the longer one, and to the whole word.
    longer: dict[str, int] = {}
    for t in good:
        text = t.rstrip("*")
        for k in range(BEGINNING[0], len(text) + 1):
            if (p := text[:k] + "*") != t:
                longer[p] = max(longer.get(p, 0), a[t])
    chosen: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (-odds[t] * math.sqrt(a[t]), t)):
        text = t.rstrip("*")
        if t.endswith("*") and longer.get(t, 0) >= 0.9 * a[t] or any(text[:k] + "*" in chosen for k in range(BEGINNING[0], len(text) + 1)):
            continue
        chosen[t] = round(odds[t], 6)
    # Whole words beside their beginning, for their misspellings.
    forms = {t for t in good - chosen.keys() if not t.endswith("*") and any(t[:k] + "*" in chosen for k in range(BEGINNING[0], len(t) + 1))}
    return chosen | {t: round(odds[t], 6) for t in sorted(forms)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients, the last that of the constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    sample = written(training_sample(docs, labels, label, most), "toxicity-sample")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return Model({}, share)
    terms = learn_terms(sample)

    @tidy
    def run(batches):
        scorer = Scorer(terms)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(terms, share, mean.tolist(), scale.tolist(), fit_logistic((x - mean) / scale, y).tolist())


def _probabilities(scorer: Scorer, model: Model, texts: list[str], matches: list) -> np.ndarray:
    if not model.coef:
        return np.full(len(texts), model.share)
    x = (np.array([scorer.features(t, m) for t, m in zip(texts, matches, strict=True)]).reshape(len(texts), -1) - model.mean) / model.scale
    return sigmoid(x @ np.array(model.coef[:-1]) + model.coef[-1])


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that score below ``threshold``, and those in which no term matches: labels that teach no terms, or are of one class, reject nothing."""
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        scorer = Scorer(model.terms)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = [scorer.matches(t) for t in texts] if model.terms else [[] for _ in texts]
            p = _probabilities(scorer, model, texts, found)
            yield b.filter(pa.array([s < threshold or not m for s, m in zip(p.tolist(), found, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the matched terms (term, token index, edits, quoted, abuse)."""
    names = list(model.terms)
    match = pa.struct([("term", pa.string()), ("token", pa.int64()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("abuse", pa.bool_())])
    id_type = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        scorer = Scorer(model.terms)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [scorer.matches(t) for t in texts] if names else [[] for _ in texts]
            p = _probabilities(scorer, model, texts, found)
            spans = [[{"term": names[t], "token": i, "edits": e, "quoted": q, "abuse": s} for i, t, e, q, s in m] for m in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(spans, pa.list_(match))], names=["doc_id", "score", "matches"])

    schema = f"doc_id {id_type}, score double, matches array<struct<term string, token long, edits int, quoted boolean, abuse boolean>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
