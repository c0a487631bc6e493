"""Toxicity by a weighted finite-state pattern grammar.

An automaton over the lexicon finds words that may insult or threaten; only the clauses that hold one are read further. There the words become symbols (insult, threat,
target, negation, reported speech, quotation mark, other). The weighted transducers for insult, threat, negation, reported speech and target are composed into one machine that reads a clause
from the left, the target's is read from the right as well; what they mark is weighed by the product of their factors. Clauses are scored, not words, and a logistic model over the clause scores
gives a document's probability.
Lexicon weights are learnt from labels: whole words, and stems of compounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, slices, staged
from platewise.llm.labelled import fit_logistic, held_out, sample
from platewise.llm.simhash_golay import shingle_hashes

#: Labelled documents that are learnt from at most, and lexicon entries kept at most.
SAMPLE, LEXICON = 12_000, 1_000
STEMS = (4, 5, 6)
#: Least z of an entry's excess among toxic documents, least share of toxic ones, least number of documents.
LEAST_Z, LEAST_SHARE, LEAST_DOCS = 5.0, 0.75, 4

#: Word lists of the grammar.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb jerk filth vermin".split()
THREATS = "kill murder destroy hurt strangle shoot stab".split()
TARGETS = "you your yours u he she they him her them his their everyone people this that these those du dich dir ihr euch sie er tu toi te vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't cannot nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls wrote writes quoted claims told sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
QUOTES = '"“”«»„'
CLAUSE_END = re.compile(r"[.!?;\n\r]")
TOKEN = re.compile(rf"[\w']+|[{QUOTES}]")
SYMBOLS = "IHTNRQo"

@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state machine over SYMBOLS: it goes from state to state, and marks and weighs some of the symbols it reads by the state it is in."""

    mark: str
    factor: float
    table: tuple[tuple[int, ...], ...]  # next state by state and symbol
    marking: tuple[tuple[bool, ...], ...]  # whether the symbol is marked, by state and symbol


def machine(mark: str, factor: float, states: int, step, marks) -> Transducer:
    return Transducer(mark, factor, tuple(tuple(step(s, c) for c in SYMBOLS) for s in range(states)), tuple(tuple(marks(s, c) for c in SYMBOLS) for s in range(states)))


MATCHES = "IH"
#: Insults and threats are marked wherever they stand. Negation reaches three words on; reported speech lasts to the clause's end, quotation marks switch it; a target stands
#: before the match, read from the left, or after it, read from the right.
INSULT = machine("insult", 1.0, 1, lambda s, c: 0, lambda s, c: c == "I")
THREAT = machine("threat", 1.0, 1, lambda s, c: 0, lambda s, c: c == "H")
NEGATION = machine("negated", 0.3, 4, lambda s, c: 3 if c == "N" else max(0, s - 1), lambda s, c: s > 0 and c in MATCHES)
REPORTED = machine("reported", 0.5, 2, lambda s, c: 1 if c == "R" else 1 - s if c == "Q" else s, lambda s, c: s == 1 and c in MATCHES)
TARGETED = machine("targeted", 1.5, 2, lambda s, c: 1 if c == "T" else s, lambda s, c: s == 1 and c in MATCHES)
FACTORS = {t.mark: t.factor for t in (INSULT, THREAT, NEGATION, REPORTED, TARGETED)}


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[frozenset[str]]]]:
    """The product of transducers that read the same symbols: next state, and the marks it gives, by state and symbol. State 0 is the start."""
    start = (0,) * len(parts)
    index, order, table = {start: 0}, [start], []
    for state in order:
        row = []
        for k in range(len(SYMBOLS)):
            after = tuple(p.table[s][k] for p, s in zip(parts, state))
            if after not in index:
                index[after] = len(order)
                order.append(after)
            row.append(index[after])
        table.append(row)
    return table, [[frozenset(p.mark for p, s in zip(parts, state) if p.marking[s][k]) for k in range(len(SYMBOLS))] for state in order]


def read(machine: tuple[list[list[int]], list[list[frozenset[str]]]], symbols: list[int]) -> list[frozenset[str]]:
    """The marks of each symbol of a clause."""
    (table, marks), state, out = machine, 0, []
    for k in symbols:
        out.append(marks[state][k])
        state = table[state][k]
    return out


FEATURES = ["bias", "total", "best", "clauses", "threats", "targeted", "negated", "reported", "density"]
PRIOR = np.array([-3.0, 1.0, 0.5, 0.5, 0.5, 0.2, -0.2, -0.1, 0.5])


class Grammar:
    """Scores texts with a lexicon of (entry, is a stem, weight, symbol)."""

    def __init__(self, lexicon: list[tuple[str, bool, float, str]]) -> None:
        self.finder = ahocorasick.Automaton()
        best: dict[str, list] = {}
        for entry, stem, weight, symbol in lexicon:
            best.setdefault(entry, []).append((entry, stem, weight, symbol))
        for entry, found in best.items():
            self.finder.add_word(entry, found)
        if best:
            self.finder.make_automaton()
        self.any = bool(best)
        self.rightward, self.leftward = compose(INSULT, THREAT, NEGATION, REPORTED, TARGETED), compose(TARGETED)
        self.words = {**dict.fromkeys(TARGETS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R"), **dict.fromkeys(QUOTES, "Q")}
        self.number = {c: k for k, c in enumerate(SYMBOLS)}

    def hits(self, text: str) -> dict[int, tuple[float, str]]:
        """Weight and symbol of the strongest lexicon entry at each word start."""
        found: dict[int, tuple[float, str]] = {}
        for end, entries in self.finder.iter(text) if self.any else ():
            for entry, stem, weight, symbol in entries:
                start = end - len(entry) + 1
                if (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and (stem or end + 1 == len(text) or not text[end + 1].isalnum()):
                    if start not in found or found[start][0] < weight:
                        found[start] = (weight, symbol)
        return found

    def features(self, text: str) -> list[float]:
        """FEATURES of a text; a text without a match has only the bias."""
        text = text.lower()
        hits = self.hits(text)
        if not hits:
            return [1.0] + [0.0] * (len(FEATURES) - 1)
        total = best = 0.0
        counts = Counter()
        starts = sorted(hits)
        clauses, at, begin = 0, 0, 0
        for stop in [*(m.start() for m in CLAUSE_END.finditer(text)), len(text)]:
            if at < len(starts) and starts[at] < stop:
                score, symbols, weights = 0.0, [], []
                for m in TOKEN.finditer(text, begin, stop):
                    hit = hits.get(m.start())
                    symbols.append(self.number[hit[1] if hit else self.words.get(m.group(), "o")])
                    weights.append(hit[0] if hit else 0.0)
                matched = False
                for weight, ahead, behind in zip(weights, read(self.rightward, symbols), reversed(read(self.leftward, symbols[::-1]))):
                    if ahead:
                        matched, marks = True, ahead | behind
                        counts.update(marks)
                        score += weight * math.prod(FACTORS[mark] for mark in marks)
                total, best, clauses = total + score, max(best, score), clauses + matched
                while at < len(starts) and starts[at] < stop:
                    at += 1
            begin = stop + 1
        return [1.0, math.log1p(total), best / 4, math.log1p(clauses), *(math.log1p(counts[m]) for m in ("threat", "targeted", "negated", "reported")),
                math.log1p(1000 * total / (len(text) + 200))]


def base_lexicon() -> list[tuple[str, bool, float, str]]:
    return [*((w, False, 2.0, "I") for w in INSULTS), *((w, False, 2.0, "H") for w in THREATS)]


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> list[tuple[str, bool, float, str]]:
    """Words and stems that toxic texts have in excess. Texts that share their least or greatest shingle hash are copies of a kind and count once, as the one with the smallest id; all
    texts without words are such copies."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            hashes = [shingle_hashes(t, 5).view(np.int64) for t in part.column("_text").cast(pa.binary()).to_pylist()]
            ends = [[int(f(h)) if len(h) else 0 for h in hashes] for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(e, pa.int64()) for e in ends)], [*part.schema.names, "low", "high"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            names, stems = zip(*held) if held else ((), ())
            counts = list(zip(*held.values())) if held else [(), ()]
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(stems, pa.bool_()), *(pa.array(c, pa.int64()) for c in counts)],
                                               ["term", "stem", "n", "t"])
            held.clear()
            return batch

        for part in slices(batches, "_text"):
            for text, label in zip(part.column("_text").to_pylist(), part.column("_label").to_pylist()):
                words = {w for w in re.findall(r"\w+", text.lower()) if len(w) > 2}
                for term in {*((w, False) for w in words), *((w[:k], True) for w in words for k in STEMS if len(w) > k)}:
                    count = held.setdefault(term, [0, 0])
                    count[0] += 1
                    count[1] += label
            if len(held) > 300_000:
                yield out()
        yield out()

    kinds = dict(rows.dtypes)
    keyed = rows.mapInArrow(keys, f"_id {kinds['_id']}, _text string, _label int, low bigint, high bigint")
    for end in ("low", "high"):
        keyed = keyed.groupBy(end).agg(F.min(F.struct("_id", "_text", "_label", F.col("high").alias("other"))).alias("_first")).select("_first._id", "_first._text", "_first._label", F.col("_first.other").alias("high"))
    keyed = staged(keyed, "kinds")
    counted = keyed.select("_text", "_label").mapInArrow(terms, "term string, stem boolean, n bigint, t bigint")
    totals = keyed.agg(F.count("*"), F.sum("_label")).first()
    n, toxic = totals[0] or 0, totals[1] or 0
    if not 0 < toxic < n:
        return base_lexicon()
    p = toxic / n
    z = (F.col("t") - p * F.col("n")) / F.sqrt(F.col("n") * (p * (1 - p)))
    best = counted.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).withColumn("z", z).filter(
        (F.col("z") >= LEAST_Z) & (F.col("t") >= LEAST_SHARE * F.col("n")) & (F.col("n") >= LEAST_DOCS)).orderBy(F.desc("z"), "term", "stem").limit(limit).collect()
    learnt = [(r["term"], r["stem"], min(6.0, math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - math.log(p / (1 - p))), "I") for r in best]
    return base_lexicon() + learnt


def featured(rows: DataFrame, keep: tuple[str, ...], lexicon: list[tuple[str, bool, float, str]], weights: np.ndarray | None = None) -> DataFrame:
    """`keep` and the text's features (array<double>), or its `score` where weights are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = None
        for part in slices(batches, "_text"):
            grammar = grammar or Grammar(lexicon)
            x = np.array([grammar.features(t or "") for t in part.column("_text").to_pylist()])
            value = pa.array(list(x)) if weights is None else pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), value], [*keep, "score"])

    types = dict(rows.dtypes)
    return rows.select(*[col(c) for c in keep], "_text").mapInArrow(
        run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score " + ("array<double>" if weights is None else "double")]))


@dataclass(frozen=True)
class Model:
    lexicon: list[tuple[str, bool, float, str]]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> Model:
    """Learn lexicon and weights from at most `rows` labelled documents outside the held-out fold. Without usable labels the built-in lexicon and the prior hold."""
    known = staged(sample(docs, labels, label, rows, text, id_col), "sample")
    lexicon = learn_lexicon(known.select("_id", "_text", F.col("_label").cast("int").alias("_label")))
    got = sorted(featured(known, ("_id", "_label"), lexicon).collect(), key=lambda r: r["_id"])
    x, y = np.array([r["score"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["_label"] for r in got], float)
    return Model(lexicon, fit_logistic(x, y, PRIOR))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `score` (0 to 1) per row from the text alone. Null and empty texts have the score of a text without matches; repeated rows are scored each; other
    columns are left out; an empty table gives an empty result."""
    source = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("_text"))
    return featured(source, keep, model.lexicon, model.weights)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, with all their columns, whatever their names. Null and empty texts have the score of a text without matches;
    repeated rows are judged each; an empty table gives an empty result."""
    # By position, since a name with a dot would be taken for a field of a struct.
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for part in slices(batches, f"c{at}"):
            x = np.array([grammar.features(t or "") for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))) < threshold))

    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
