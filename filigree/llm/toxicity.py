"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, target, negation, report, quote, break, other). Five transducers read the
classes of a clause, each with its own states:

    insult    gives an insult its own weight
    target    someone addressed or meant close before or after an insult raises it
    threat    a threat followed by a target soon gives the threat's weight, alone half of it
    negation  a negation close before takes from what follows
    report    after a verb of saying, or inside quotation marks, what follows to the clause's end is someone else's

They are composed into one deterministic machine (the product of their states, as far as it can be reached), so a clause is
scored in one table step a word; scores are of matched clauses, not of words. A text's score is a logistic function of the
logarithm of its clauses' sum and of its length.

Lexicon. A fixed list of plain insults, and what labelled texts teach: words, and stems (prefixes of 4 to 8 bytes, for
languages that inflect), whose share of toxic texts is larger than that of others beyond doubt (by the log odds ratio, which is
the weight, and its lower bound). At most FIT_ROWS labelled documents, drawn by hash of doc_id, are used for it and for the logistic, each
different text once with each label; every text is scored. Only the text is ever an input of a score.

Defined cases: a null or empty text has no clause and gets the score of such; labels that are null count as none; a doc_id
with several labels is toxic if any says so; rows that repeat a doc_id are scored one by one; without labelled texts the
fixed list and a fixed logistic serve; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, table

FIT_ROWS = 20_000
#: Of what counts as insult: the least log odds ratio, and the least of its lower bound.
ODDS, LEAST_ODDS = 3.5, 2.5
STEMS = (4, 5, 6, 7, 8)

# Plain words of each class.
INSULTS = "idiot moron scum trash clown loser worthless stupid disgusting pathetic imbecile dumb".split()
THREATS = "kill hurt destroy beat smash stab shoot punish töten schlagen umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they them him her u du dich dir ihr euch sie tu te toi vous il elle ils tú te ti usted ustedes él ella ellos".split()
NEGATIONS = "not never no none hardly isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls wrote claims claimed quoted according sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
FIXED = {w: k for k, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}


@dataclass
class Transducer:
    """step(state, class) -> (state, factor, addition); what is emitted for a word is weight * factors + additions."""

    start: int
    step: object


def _armed(trigger: int, reach: int, factor: float, on: tuple[int, ...]) -> Transducer:
    """For reach words after a trigger, words of the classes `on` get the factor."""

    def step(state: int, kind: int) -> tuple[int, float, float]:
        if kind == BREAK:
            return 0, 1.0, 0.0
        if kind == trigger:
            return reach, 1.0, 0.0
        return max(0, state - 1), factor if state and kind in on else 1.0, 0.0

    return Transducer(0, step)


def _target(state: int, kind: int) -> tuple[int, float, float]:
    """States: 0; 1-3, words left after a target; 4-5, words left after an insult that had none yet."""
    if kind == BREAK:
        return 0, 1.0, 0.0
    if kind == TARGET:
        return 3, 1.0, 0.5 if state >= 4 else 0.0
    if kind == INSULT:
        return (state - 1, 1.3, 0.0) if 1 <= state <= 3 else (5, 1.0, 0.0)
    return {1: 0, 2: 1, 3: 2, 4: 0, 5: 4}.get(state, 0), 1.0, 0.0


def _threat(state: int, kind: int) -> tuple[int, float, float]:
    if kind == BREAK:
        return 0, 1.0, 0.0
    if kind == THREAT:
        return 3, 0.5, 0.0
    return (0, 1.0, 0.5) if kind == TARGET and state else (max(0, state - 1), 1.0, 0.0)


def _report(state: int, kind: int) -> tuple[int, float, float]:
    """States: 0; 1, after a verb of saying; 2, inside quotation marks."""
    if kind == QUOTE:
        return (0 if state == 2 else 2), 1.0, 0.0
    if kind == BREAK:
        return (2 if state == 2 else 0), 1.0, 0.0
    return max(state, int(kind == REPORT)), 0.5 if state and kind in (INSULT, THREAT) else 1.0, 0.0


TRANSDUCERS = (
    Transducer(0, lambda state, kind: (0, float(kind in (INSULT, THREAT)), 0.0)),
    Transducer(0, _target),
    Transducer(0, _threat),
    _armed(NEGATION, 3, 0.4, (INSULT, THREAT)),
    Transducer(0, _report),
)


def compose(parts: tuple[Transducer, ...]) -> tuple[list[list[int]], list[list[tuple[float, float]]]]:
    """The product machine: next[state][class] and (factor, addition)[state][class], over the states that can be reached."""
    number, todo = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)]
    after: list[list[int]] = []
    gives: list[list[tuple[float, float]]] = []
    for own in todo:
        row, out = [], []
        for kind in range(8):
            steps = [p.step(s, kind) for p, s in zip(parts, own)]
            to = tuple(s for s, _, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            out.append((float(np.prod([f for _, f, _ in steps])), sum(a for _, _, a in steps)))
        after.append(row)
        gives.append(out)
    return after, gives


NEXT, GIVES = compose(TRANSDUCERS)
_LETTERS = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_WORD, _TOKEN = re.compile(_LETTERS), re.compile(_LETTERS + r"|[.!?;:\n]+|[\"“”«»„]")


@dataclass
class Grammar:
    """words and stems with their weights; the logistic is that of bias + slope * log(1 + sum), plus by_length * log(1 + characters / 1000) if the sum is not 0: a
    long text meets a doubtful word by chance."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 5.0))
    stems: dict[bytes, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 3.0
    by_length: float = 0.0

    def weigh(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        raw = word.encode()
        return max((self.stems[raw[:n]] for n in STEMS if raw[:n] in self.stems), default=0.0)

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The clauses that the grammar matches, with their scores."""
        found, state, total, begin = [], 0, 0.0, 0
        low = text.lower()
        text = text if len(low) == len(text) else low
        for m in _TOKEN.finditer(low):
            word, weight = m[0], 0.0
            if word[0] in ".!?;:\n":
                kind = BREAK
            elif word[0] in "\"“”«»„":
                kind = QUOTE
            else:
                weight = self.weigh(word)
                kind = INSULT if weight else FIXED.get(word, OTHER)
                weight = weight or 3.0 * (kind == THREAT)
            factor, more = GIVES[state][kind]
            total += weight * factor + more * (2.0 if more else 0.0)
            state = NEXT[state][kind]
            if kind == BREAK:
                if total > 0:
                    found.append((text[begin : m.start()].strip(), total))
                total, begin = 0.0, m.end()
        if total > 0:
            found.append((text[begin:].strip(), total))
        return found

    def score(self, total: float, chars: int = 0) -> float:
        x = self.bias + self.slope * np.log1p(total) + self.by_length * (total > 0) * np.log1p(chars / 1000)
        return float(1 / (1 + np.exp(-x)))


def plain_words(text: str | None) -> set[bytes]:
    """The different words of a text as the grammar reads them, as bytes."""
    return set(" ".join(_WORD.findall((text or "").lower())).encode().split())


class _Scan:
    """Tells quickly whether a text has any word of the grammar, so that few are read clause by clause."""

    def __init__(self, grammar: Grammar) -> None:
        self.words = {w.encode() for w in (*grammar.words, *THREATS)}
        self.stems = set(grammar.stems)
        self.short = {s[: min(STEMS)] for s in self.stems}

    def hits(self, text: str) -> bool:
        words = plain_words(text)
        if not self.words.isdisjoint(words):
            return True
        n = min(STEMS)
        return any(w[:k] in self.stems for w in words if w[:n] in self.short for k in STEMS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean, rows = Counter(), Counter(), [0, 0]
    for batch in batches:
        for part in by_bytes(batch, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = plain_words(text)
                rows[label] += 1
                (toxic if label else clean).update({b"w" + w for w in words} | {b"s" + w[:n] for w in words for n in STEMS if len(w) >= n})
    keys = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_arrays([pa.array([b"", *keys], pa.binary()), pa.array([rows[1], *(toxic[k] for k in keys)], pa.int64()), pa.array([rows[0], *(clean[k] for k in keys)], pa.int64())], ["feature", "toxic", "clean"])


def lexicon(rows: list[tuple[bytes, int, int]], toxic: int, clean: int) -> Grammar:
    """Of (feature, toxic texts with it, clean texts with it) what counts as insult: a stem rather than its words where it is as sure."""
    g = Grammar()

    sure: dict[bytes, tuple[float, int]] = {}
    for f, a, b in rows:
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        if odds >= ODDS and odds - 1.64 * (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5 >= LEAST_ODDS:
            sure[bytes(f)] = odds, a
    most = Counter()  # of each stem: the texts of its most frequent word
    for f, (_, a) in sure.items():
        for n in STEMS if f[:1] == b"w" else ():
            most[f[1 : n + 1]] = max(most[f[1 : n + 1]], a)
    for f, (weight, a) in sorted(sure.items(), key=lambda x: (len(x[0]), x[0])):
        if f[:1] == b"s":
            # a stem that is mostly one word says no more than the word
            if most[f[1:]] < 0.6 * a and not any(f[1 : n + 1] in g.stems for n in STEMS if n < len(f) - 1):
                g.stems[f[1:]] = weight
        else:
            g.words[f[1:].decode("utf-8", "ignore")] = max(weight, g.words.get(f[1:].decode("utf-8", "ignore"), 0.0))
    return g


def _totals(grammar: Grammar):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(grammar)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = part.column("text").to_pylist()
                totals = [sum(t for _, t in grammar.clauses(x)) if x and scan.hits(x) else 0.0 for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(totals, pa.float64()), pa.array([len(x or "") for x in texts], pa.int64()), part.column("toxic")], ["total", "chars", "toxic"])

    return of


def fit_logistic(x: np.ndarray, chars: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Bias, slope of log(1 + x) and of the length, with a weak pull to the fixed ones; Newton's method."""
    prior = np.array([-3.0, 3.0, 0.0])
    z, beta = np.stack([np.ones(len(x)), np.log1p(x), (x > 0) * np.log1p(chars / 1000)], axis=1), prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - 0.5 * (beta - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(3), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1]), float(beta[2])


def fit(docs: DataFrame, labels: DataFrame, training: str, rows: int = FIT_ROWS) -> Grammar:
    """A grammar from the labelled texts whose doc_id meets the SQL condition `training`."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(training).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if not n:
        return Grammar()
    # the condition on doc_id goes to the texts, too, so that few are shuffled; the limit cuts what is drawn beyond the mean
    marks = marks.where(f"pmod(xxhash64(doc_id), {n}) < {rows}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sample = texts.join(marks, "doc_id").select("text", F.expr("int(toxic > 0)").alias("toxic")).distinct()
    counted = sample.mapInArrow(_features, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # what cannot reach LEAST_ODDS stays where it is; the rest is as many rows as sure features, of a bounded sample
    size = counted.where("feature = X''").first()
    if size is None or not size.toxic or not size.clean:
        return Grammar()
    odds = f"ln((toxic + 0.5) / {size.toxic + 1}) - ln((clean + 0.5) / {size.clean + 1}) - 1.64 * sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))"
    grammar = lexicon([tuple(r) for r in counted.where(f"feature <> X'' and {odds} >= {LEAST_ODDS}").collect()], size.toxic, size.clean)
    seen = sample.mapInArrow(_totals(grammar), "total double, chars long, toxic int").toPandas()  # three numbers for each row of the sample
    grammar.bias, grammar.slope, grammar.by_length = fit_logistic(*(seen[c].to_numpy(float) for c in ("total", "chars", "toxic")))
    return grammar


_REPORT = "doc_id long, score double, clauses array<struct<clause:string,score:double>>"


def _scored(grammar: Grammar):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(grammar)
        kind = pa.list_(pa.struct([("clause", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [grammar.clauses(x) if x and scan.hits(x) else [] for x in texts]
                scores = [grammar.score(sum(t for _, t in own), len(x or "")) for x, own in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([[{"clause": c, "score": t} for c, t in own] for own in found], kind)], ["doc_id", "score", "clauses"]
                )

    return of


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per document: doc_id, score, clauses (what the grammar matched, with each clause's score)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(grammar), _REPORT)


def _keep(grammar: Grammar, threshold: float):
    """Batches of rows of any columns, without those whose text is toxic."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(grammar)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = [k for k, x in enumerate(part.column("text").to_pylist()) if not (x and scan.hits(x)) or grammar.score(sum(t for _, t in grammar.clauses(x)), len(x)) < threshold]
                yield part.take(pa.array(rows, pa.int64()))

    return of


def without_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """docs, with all their columns, but for rows that score threshold or more."""
    return docs.mapInArrow(_keep(grammar, threshold), docs.schema)


TRAINING = "crc32(cast(doc_id as string)) % 5 <> 0"


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit(docs, table(spark, sf_dir, "labels"), TRAINING)
    held_out = F.coalesce(F.expr(f"not ({TRAINING})"), F.lit(False)).alias("held_out")
    return score(docs, grammar).select("doc_id", held_out, "score", F.expr("int(score >= 0.5)").alias("predicted"), F.expr("size(clauses)").alias("n_clauses"))
