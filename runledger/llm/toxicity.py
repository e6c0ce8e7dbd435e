"""Toxicity by a weighted finite-state pattern grammar (operator 10).

Four small machines, each with its own states and arcs, are composed into one:

* the *lexicon* reads a word and writes a symbol: insult or threat (given words, and word stems
  learned from labelled rows, with weights), target, intent, negation, report verb, company (a
  word that is learned to stand near insults), or other;
* *negation* marks insults and threats that stand within three words after a negation;
* *report* marks those that stand after a reported-speech verb;
* *patterns* accepts clauses: a target up to four words before an insult, an insult up to three
  words before its target, a threat up to three words before its target, a target followed by
  intent and a threat, and, at NEAR of its weight, company up to four words before an insult or
  up to three words behind it. A word alone is no pattern and counts nothing.

Arcs multiply a word's weight by a factor (NEGATED, QUOTED, AIMED, NEAR) and a clause's strength
is the best sum over the paths of the composed machine that end with no pattern half done. A
clause is the text between ``. ! ? ; :`` or line ends. Matched clauses, not isolated words, are
scored; a text's features are the strength of its matched clauses and their number, and a
logistic curve fitted on labelled rows turns them into a score. Learning counts each stem's
documents by label with map-side combine; the lexicon kept is at most ``max_stems`` entries,
company at most ``max_near`` words: those that stand in a pattern's reach of an insult in most
toxic documents. The curve is fitted from a histogram of at most 2 x BINS cells, so what
reaches the driver has a fixed bound. The labelled rows that
teach are a hash-chosen sample of about ``sample`` rows (20,000); every row is scored.

Defined cases: null and empty texts, and texts without a match, score the curve's base;
without any labelled row the given lexicon and a default curve are used; repeated labels of
a document count once each; a null label or doc_id teaches nothing; other columns are ignored
(all are kept by ``without_toxic``); doc_id is cast to long.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

# The given lexicon, by symbol.
INSULT = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk".split()
THREAT = "kill hurt destroy beat smash punish burn".split()
TARGET = "you your yours he she they him her them his their people guy man woman".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't didn't nor without".split()
INTENT = "will would should must gonna going want wants ll deserve deserves".split()
REPORTED = "said says say told tells wrote writes claimed claims reported reports quoted according".split()

#: Stem lengths that are learned, besides whole words.
STEMS = (4, 5, 6, 7, 8)
BINS = 8
NEGATED, QUOTED, AIMED, NEAR = 0.3, 0.5, 1.25, 0.8
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def _learnable(text: str | None) -> set[str]:
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add("=" + w)
        out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


def _stem_counts(batches):
    """(stem, positive, negative) documents, combined within the task, in bounded portions."""
    pos, neg = Counter(), Counter()

    def portion():
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["stem", "pos", "neg"])
        pos.clear()
        neg.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (pos if toxic else neg).update(_learnable(text))
            if len(pos) + len(neg) > 400_000:
                yield from portion()
    yield from portion()


@dataclass
class Machine:
    """A weighted finite-state transducer. ``arcs[state][symbol]`` lists (symbol written, factor
    on the word's weight, next state); paths start in ``start`` and must end in ``finals``."""

    start: object
    finals: set
    arcs: dict

    def add(self, state, symbols, to, factor: float = 0.0, write=None) -> None:
        for x in symbols:
            self.arcs.setdefault(state, {}).setdefault(x, []).append((write or x, factor, to))


def compose(a: Machine, b: Machine) -> Machine:
    """Reads what a reads, writes what b writes of it; factors multiply. Only states that can
    be reached are built. An arc of factor 1 in a leaves the weight to b."""
    start = (a.start, b.start)
    out, todo = Machine(start, set(), {}), [start]
    seen = {start}
    while todo:
        state = p, q = todo.pop()
        if p in a.finals and q in b.finals:
            out.finals.add(state)
        for x, moves in a.arcs.get(p, {}).items():
            for y, f, p2 in moves:
                for z, g, q2 in b.arcs.get(q, {}).get(y, ()):
                    out.add(state, [x], (p2, q2), f * g, z)
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
    return out


#: Symbols: insult, threat, target, intent, negation, report verb, company, other. A mark is
#: written behind an insult or threat: - negated, q reported.
PLAIN = ["P", "M", "N", "R", "C", "X"]
MARKED = {"I": ["I", "I-", "Iq", "I-q"], "T": ["T", "T-", "Tq", "T-q"]}


def negation() -> Machine:
    m = Machine(0, {0, 1, 2, 3}, {})
    for left in range(4):
        m.add(left, ["N"], 3, 1.0)
        m.add(left, [x for x in PLAIN if x != "N"], max(0, left - 1), 1.0)
        for x in "IT":
            m.add(left, [x], max(0, left - 1), NEGATED if left else 1.0, x + "-" if left else x)
    return m


def report() -> Machine:
    m = Machine(False, {False, True}, {})
    for open_ in (False, True):
        m.add(open_, ["R"], True, 1.0)
        m.add(open_, [x for x in PLAIN if x != "R"], open_, 1.0)
        for x in ("I", "I-", "T", "T-"):
            m.add(open_, [x], open_, QUOTED if open_ else 1.0, x + "q" if open_ else x)
    return m


def patterns() -> Machine:
    """States: idle; after a target (t) or company (c) with k words of reach left; a target that
    waits for intent (s is the same as t) and then a threat (m); an insult (w) or a threat (v)
    that still needs its target within k words, and an insult that needs company (b). Half-done
    states w, v and b are not final."""
    insult, threat = MARKED["I"], MARKED["T"]
    every = [*PLAIN, *insult, *threat]
    idle = "idle"
    t, m_, c = [("t", k) for k in range(5)], [("m", k) for k in range(4)], [("c", k) for k in range(5)]
    out = Machine(idle, {idle, *t, *m_, *c}, {})
    one_less = lambda x: [(x[k], x[k - 1] if k > 1 else idle) for k in range(1, len(x))]
    # any state may let a word pass; a target opens its reach anew, company where no target is in reach
    for state, after in [(idle, idle), *one_less(t), *one_less(m_), *one_less(c)]:
        out.add(state, [x for x in every if x not in "PC"], after)
        out.add(state, ["P"], t[4])
        out.add(state, ["C"], after if state in t or state in m_ else c[4])
        # an insult or a threat that finds its target behind it, an insult that finds company
        out.add(state, insult, ("w", 3), AIMED)
        out.add(state, threat, ("v", 3), AIMED)
        out.add(state, insult, ("b", 3), NEAR)
        if state in t or state in m_:
            out.add(state, insult, after, AIMED)
        if state in c:
            out.add(state, insult, after, NEAR)
        if state in t:
            out.add(state, ["M"], m_[3])
        if state in m_:
            out.add(state, threat, after, AIMED)
    for wait in "wvb":
        for k in range(1, 4):
            out.add((wait, k), ["P"], t[4])
            if wait == "b":
                out.add((wait, k), ["C"], c[4])
            if k > 1:
                out.add((wait, k), [x for x in every if x not in (["P", "C"] if wait == "b" else ["P"])], (wait, k - 1))
    return out


class Grammar:
    """The composed machine over one lexicon and its company; ``features`` runs a text through it."""

    def __init__(self, stems: dict[str, float], company: list[str] = ()):
        self.words = {w: 2.0 for w in INSULT} | {s[1:]: x for s, x in stems.items() if s[0] == "=" and s[1:] not in THREAT}
        self.threats = {w: 2.0 for w in THREAT}
        self.stems = {s: x for s, x in stems.items() if s[0] != "="}
        self.sizes = sorted({len(s) for s in self.stems})
        self.symbol = {w: "P" for w in TARGET} | {w: "N" for w in NEGATION} | {w: "R" for w in REPORTED} | {w: "M" for w in INTENT}
        self.symbol = dict.fromkeys((w for w in company if self.reads(w)[0] == "X"), "C") | self.symbol
        self.near = ahocorasick.Automaton()
        for k in {*self.words, *self.stems, *self.threats}:
            self.near.add_word(k, len(k))
        self.near.make_automaton()
        self.machine = compose(compose(negation(), report()), patterns())

    def reads(self, word: str) -> tuple[str, float]:
        """The lexicon: symbol and weight of a word."""
        if word in self.symbol:
            return self.symbol[word], 0.0
        if word in self.threats:
            return "T", self.threats[word]
        best = self.words.get(word, 0.0)
        for k in self.sizes:
            if k > len(word):
                break
            best = max(best, self.stems.get(word[:k], 0.0))
        return ("I", best) if best else ("X", 0.0)

    def clause(self, words: list[str]) -> float:
        """The best sum over the machine's paths."""
        at = {self.machine.start: 0.0}
        for w in words:
            x, weight = self.reads(w)
            step: dict = {}
            for state, total in at.items():
                for _, factor, to in self.machine.arcs[state].get(x, ()):
                    v = total + factor * weight
                    if v > step.get(to, -1.0):
                        step[to] = v
            at = step
        return max((v for s, v in at.items() if s in self.machine.finals), default=0.0)

    def features(self, text: str | None) -> tuple[float, int]:
        low = (text or "").lower()
        if next(self.near.iter(low), None) is None:
            return 0.0, 0
        hits = []
        for part in _CLAUSE.split(low):
            if next(self.near.iter(part), None) is not None and (x := self.clause(_WORD.findall(part))):
                hits.append(x)
        return sum(hits), len(hits)


    def company(self, text: str | None) -> set[str]:
        """The words of no symbol of their own that stand in reach of an insult."""
        out: set[str] = set()
        for part in _CLAUSE.split((text or "").lower()):
            if next(self.near.iter(part), None) is None:
                continue
            words = _WORD.findall(part)
            kinds = [self.reads(w)[0] for w in words]
            for i in (i for i, k in enumerate(kinds) if k == "I"):
                out.update(w for w, k in zip(words[max(0, i - 4) : i + 4], kinds[max(0, i - 4) : i + 4]) if k == "X")
        return out


def _bin(strength: float) -> int:
    return 0 if strength <= 0 else min(BINS - 1, 1 + int(2 * np.log2(1 + strength)))


def learn(labelled: DataFrame, min_docs: int = 5, min_ratio: float = 40.0, max_stems: int = 2000, max_near: int = 400) -> tuple[dict[str, float], list[str], list[float]]:
    """Lexicon weights, company and the score of each strength bin, from (text, toxic) rows."""
    spark = labelled.sparkSession
    rows = labelled.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    size = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in size}
    p, q = n.get(1, 0), sum(c for k, c in n.items() if k != 1)
    stems: dict[str, float] = {}
    if p and q:
        counts = rows.mapInArrow(_stem_counts, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        ratio = ((F.col("pos") + 0.5) / (p + 1.0)) / ((F.col("neg") + 0.5) / (q + 1.0))
        least = max(min_docs, p // 100)
        best = counts.withColumn("ratio", ratio).where((F.col("pos") >= least) & (F.col("ratio") >= min_ratio)).orderBy(F.desc("ratio"), "stem").limit(max_stems)
        stems = {r["stem"]: float(min(4.0, np.log2(r["ratio"]) / 2)) for r in best.collect()}
    insults = spark.sparkContext.broadcast(Grammar(stems))

    def beside(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(insults.value.company(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    near = rows.where("toxic = 1").select("text").mapInArrow(beside, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    company = [r["word"] for r in near.where(F.col("n") >= min_docs).orderBy(F.desc("n"), "word").limit(max_near).collect()]
    model = spark.sparkContext.broadcast(Grammar(stems, company))

    def binned(batches):
        cells: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells[_bin(model.value.features(text)[0]), int(toxic == 1)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cells], pa.int32()), pa.array([t for _, t in cells], pa.int32()), pa.array(list(cells.values()), pa.int64())], ["bin", "toxic", "n"])

    table = np.zeros((BINS, 2))
    for r in rows.mapInArrow(binned, "bin int, toxic int, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect():
        table[r["bin"], r["toxic"]] = r["n"]
    if not table.sum():
        return stems, company, [0.02] + [min(0.98, 0.3 + 0.1 * b) for b in range(1, BINS)]
    # a logistic curve over the bins by a few Newton steps, then pulled to each bin's own rate
    x = np.stack([np.ones(BINS), (np.arange(BINS) > 0) * 1.0, np.arange(BINS) / BINS], 1)
    w, total = np.zeros(3), table.sum(1)
    for _ in range(25):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (table[:, 1] - total * s) - 0.1 * w
        w += np.linalg.solve(x.T @ (x * (total * s * (1 - s))[:, None]) + 0.1 * np.eye(3), grad)
    curve = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    rate = (table[:, 1] + 4 * curve) / (total + 4)
    return stems, company, [float(v) for v in np.maximum.accumulate(rate)]


def _scores(strength: np.ndarray, curve: list[float]) -> np.ndarray:
    """The bin's rate; within a bin stronger texts score slightly higher."""
    base = np.array([curve[_bin(s)] for s in strength], float)
    return np.clip(base + 1e-3 * (1 - np.exp(-strength)), 0, 1)


def score(docs: DataFrame, stems: dict[str, float], company: list[str], curve: list[float]) -> DataFrame:
    """doc_id, score, strength and n_clauses of every row."""
    model = docs.sparkSession.sparkContext.broadcast((Grammar(stems, company), curve))

    def run(batches):
        grammar, rate = model.value
        for batch in batches:
            out = [grammar.features(t) for t in batch.column(1).to_pylist()]
            strength = np.array([s for s, _ in out], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(strength, rate), pa.float64()), pa.array(strength, pa.float64()), pa.array([c for _, c in out], pa.int64())], ["doc_id", "score", "strength", "n_clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, strength double, n_clauses long")


def labelled_rows(docs: DataFrame, labels: DataFrame, held: str, sample: int = 20_000) -> DataFrame:
    """Texts with labels outside the fold named by the SQL condition on doc_id: all of them,
    or about ``sample``, chosen by a hash of doc_id."""
    own = labels.where(f"doc_id is not null and toxic is not null and not ({held})").select(F.col("doc_id").alias("__id"), "toxic").distinct()
    share = min(1.0, sample / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return cut(docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("__id")).select("text", "toxic"), "labelled")


HELD = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def toxicity(docs: DataFrame, labels: DataFrame, held: str = HELD, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    with scratch(docs.sparkSession):
        learned = learn(labelled_rows(docs, labels, held))
    rows = score(docs, *learned)
    return rows.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "strength", "n_clauses")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns, in the same cases
    as ``toxicity``: null and empty texts stay unless the curve's base is above it."""
    with scratch(docs.sparkSession):
        stems, company, curve = learn(labelled_rows(docs, labels, HELD))
    model = docs.sparkSession.sparkContext.broadcast((Grammar(stems, company), curve))

    def run(batches):
        grammar, rate = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = _scores(np.array([grammar.features(t)[0] for t in texts], float), rate) < threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
