"""Toxicity and mixing against plain versions of what they are defined to be, and the scan of random Unicode."""

import random
import re
from fractions import Fraction
from math import ceil, floor

import pytest
from filigree.llm import mixing, toxicity

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]+|[\"“”«»„]")


def plain_score(grammar, text):
    """Every word's weight under each rule by itself, with lists of what came before instead of machines."""
    clauses, words, quoted = [], [], False
    for word in [*WORD.findall(text.lower()), "."]:
        if word[0] in ".!?;:\n":
            clauses.append((words, quoted))
            words = []
            continue
        if word[0] in "\"“”«»„":
            quoted = not quoted
            words.append((word, "quote", 0.0, quoted))
            continue
        weight = grammar.weigh(word)
        kind = "insult" if weight else {toxicity.THREAT: "threat", toxicity.TARGET: "target", toxicity.NEGATION: "negation", toxicity.REPORT: "report"}.get(toxicity.FIXED.get(word), "other")
        words.append((word, kind, weight or 3.0 * (kind == "threat"), quoted))
    total = 0.0
    for words, _ in clauses:
        target = threat = negation = open_insult = 0
        said = False
        for _, kind, weight, inside in words:
            if kind == "quote":
                if not inside:
                    said = False
                factor, more = 0.0, 0.0
            else:
                factor = float(kind in ("insult", "threat"))
                more = 0.0
                if kind == "insult" and target:
                    factor *= 1.3
                if kind == "target" and open_insult:
                    more += 0.5
                if kind == "threat":
                    factor *= 0.5
                if kind == "target" and threat:
                    more += 0.5
                if negation and kind in ("insult", "threat"):
                    factor *= 0.4
                if (said or inside) and kind in ("insult", "threat"):
                    factor *= 0.5
            total += weight * factor + 2.0 * more
            # what is left of each rule's reach after this word
            if kind == "target":
                target, open_insult, threat = 3, 0, 0
            elif kind == "insult":
                target, open_insult, threat = (target - 1, 0, max(0, threat - 1)) if target else (0, 2, max(0, threat - 1))
            elif kind == "threat":
                target, open_insult, threat = max(0, target - 1), max(0, open_insult - 1), 3
            else:
                target, open_insult, threat = max(0, target - 1), max(0, open_insult - 1), max(0, threat - 1)
            negation = 3 if kind == "negation" else max(0, negation - 1)
            said |= kind == "report"
    return total


def test_toxicity_as_its_rules_one_by_one():
    rng = random.Random(14)
    grammar = toxicity.Grammar()
    pool = ["idiot", "scum", "kill", "hurt", "you", "they", "not", "never", "said", "called", "the", "fine", ".", '"', ";"]
    for _ in range(4000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))
        assert sum(t for _, t in grammar.clauses(text)) == pytest.approx(plain_score(grammar, text)), text


def test_scan_sees_whatever_the_grammar_matches():
    rng = random.Random(15)
    grammar = toxicity.Grammar(words={"idiot": 5.0, "réeux": 4.0}, stems={b"snor": 4.0})
    scan = toxicity._Scan(grammar)
    assert all(scan.hits(t) for t in ("you idiot\U0001f600", "you idiot。", "ICH WERDE DICH TÖTEN"))
    pool = ["idiot", "IDIOT", "kill", "töten", "TÖTEN", "snorkel", "RÉEUX", " ", "。", "\U0001f600", "-", "_", "7", "'", "’", "İ", "ß", "中", "́", ".", " ", "!", "«"]
    seen = 0
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))
        if grammar.clauses(text):
            seen += 1
            assert scan.hits(text), text
    assert seen > 5000


def by_earliest_deadline(weights, blocks):
    """Slot by slot over exact fractions: of all blocks that are released and first of their source, the one that is due first."""
    total = sum(Fraction(w) for w in weights)
    share = [Fraction(w) / total for w in weights]
    done, out, slot = [0] * len(weights), [], 0
    while done != blocks:
        free = [(ceil((done[s] + 1) / share[s]), s) for s in range(len(weights)) if done[s] < blocks[s] and floor(done[s] / share[s]) <= slot]
        if free:
            deadline, s = min(free)
            out.append((s, done[s], floor(done[s] / share[s]), deadline, slot))
            done[s] += 1
        slot += 1
    return out


def test_schedule_as_slot_by_slot():
    rng = random.Random(16)
    for _ in range(200):
        n = rng.randint(1, 6)
        weights, blocks = [rng.choice([1, 2, 5, 0.1, 0.7, 3.3]) for _ in range(n)], [rng.randint(1, 25) for _ in range(n)]
        assert mixing.run(weights, blocks) == by_earliest_deadline(weights, blocks)


def test_interleave_as_slot_by_slot(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice(["a", "b", "b", "c"])) for i in rng.sample(range(1000), 300)] + [(None, "a"), (5000, None)]
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = {(r.source, r.doc_id): (r.block, r.release, r.deadline, r.slot) for r in mixing.interleave(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=7).collect()}
    own = {s: sorted((i for i, t in rows if t == s), key=lambda i: (i is not None, i or 0)) for s in "abc"}
    plan = {(s, i): rest for s, i, *rest in by_earliest_deadline([weights[s] for s in "abc"], [-(-len(own[s]) // 7) for s in "abc"])}
    for k, s in enumerate("abc"):
        for place, i in enumerate(own[s]):
            assert got[s, i] == (place // 7, *plan[k, place // 7])
    assert got[None, 5000][0] == 0 and got[None, 5000][3] > max(v[3] for k, v in got.items() if k[0] is not None)
