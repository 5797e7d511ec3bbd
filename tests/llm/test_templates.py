"""Decontamination against a brute-force template matcher, and names that begin a sentence."""

import random
import re

from filigree.llm import decontaminate as d

NUMBERS, UNITS = set(d.NUMBER_WORDS), set(d.UNITS)


def found(spark, docs, items):
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def template(text):
    """[(plain word, type or None, begins a sentence)], for plain ASCII texts of words, full stops and digits."""
    out, begins, number = [], True, False
    for word in text.split():
        bare = word.strip(".,?!")
        kind = None
        if bare[0].isdigit() or bare.lower() in NUMBERS:
            kind = "number"
        elif number and bare.lower() in UNITS:
            kind = "unit"
        elif bare[0].isupper() and not (len(bare) > 1 and bare[1].isupper()):
            kind = "first" if begins else "name"
        number = kind == "number"
        out.append((bare.lower(), kind))
        begins = word[-1] in ".!?:"
    return out


def by_brute_force(doc, item):
    a, b = template(item), template(doc)
    n = min(len(a), d.WINDOW)
    if n < d.SHORTEST:
        return False
    for names in (False, True):
        kind = lambda w: "name" if w[1] == "first" and names else None if w[1] == "first" else w[1]
        form = lambda w, names=names: ("name" if w[1] == "first" and names else None if w[1] == "first" else w[1]) or w[0]
        # a document's own first words may be read either way
        for shift in range(-len(a), len(b)):
            covered, slots = set(), set()
            for p in range(len(a) - n + 1):
                q = p + shift
                if not 0 <= q <= len(b) - n:
                    continue
                x, y = a[p : p + n], b[q : q + n]
                few = sum(kind(w) is not None for w in x) * 2 <= n
                same = [form(w) for w in x] in ([form(w) for w in y], [("name" if w[1] == "first" else w[1]) or w[0] for w in y], [(None if w[1] == "first" else w[1]) or w[0] for w in y])
                if (few and same) or [w[0] for w in x] == [w[0] for w in y]:
                    covered |= set(range(p, p + n))
                    slots |= {(u[0], v[0]) for u, v in zip(x, y) if kind(u) is not None}
            if len(covered) >= min(len(a), d.LEAST) and len({s for s, _ in slots}) == len(slots):
                return True
    return False


def test_as_brute_force_does(spark):
    rng = random.Random(21)
    names, plain = "Tom Kim Ann Bob Sue".split(), "has gave apples pears bag red town boys went home with some old cart".split()

    def sentence():
        words = [rng.choice(names)] if rng.random() < 0.6 else [rng.choice(["The", "Some"])]
        for _ in range(rng.randint(4, 12)):
            r = rng.random()
            words += [rng.choice(names)] if r < 0.1 else [str(rng.randint(2, 6)), "km"] if r < 0.2 else [str(rng.randint(2, 30))] if r < 0.3 else [rng.choice(plain)]
        return " ".join(words) + "."

    items = [(i, " ".join(sentence() for _ in range(rng.randint(1, 2)))) for i in range(12)]
    docs = []
    for k in range(90):
        text = rng.choice(items)[1]
        renamed = dict(zip(names, rng.sample(names, 5)))
        if k % 3:
            text = re.sub(r"[A-Z]\w+", lambda m: renamed.get(m[0], m[0]), text)
        if k % 2:
            text = re.sub(r"\d+", lambda m: str(int(m[0]) + 3), text)
        if k % 5 == 0:
            text = re.sub(r"\d+", lambda m: str(rng.randint(2, 9)), text)
        docs.append((k, " ".join([sentence(), text, sentence()][k % 4 == 0 :])))
    want = {(i, j) for i, t in docs for j, u in items if by_brute_force(t, u)}
    got = found(spark, docs, items)
    assert len(want) > 50 and got == want, (got - want, want - got)


def test_a_name_at_the_beginning(spark):
    item = [(1, "Tom has 12 apples and 5 pears in one bag")]
    docs = [(1, "Kim has 31 apples and 8 pears in one bag"), (2, "Then Kim has 31 apples and 8 pears in one bag today"), (3, "Kim has 31 apples and 31 pears in one bag"), (4, "Kim has many apples and 8 pears in one bag")]
    assert found(spark, docs, item) == {(1, 1), (2, 1), (3, 1)}


def test_texts_of_one_doc_id_are_apart(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    item = [(1, " ".join(words))]
    head, tail = " ".join(words[:9] + ["x"] * 5), " ".join(["y"] * 5 + words[5:])
    assert found(spark, [(1, head), (1, tail)], item) == set()
    assert found(spark, [(1, head), (1, " ".join(words)), (1, " ".join(words))], item) == {(1, 1)}
