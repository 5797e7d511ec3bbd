"""Each operator against a brute-force version, and its defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from filigree.llm import decontaminate, hmm_lm, html_extract, license_scan, minhash_dedup, mixing, substring_dedup, token_output, toxicity, vptree_ann
from filigree.llm.components import components
from filigree.llm.words import Words, grams, slices, window_min

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: A table as it may come: other columns with names that the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key long, h string, pos int, _s string, _d long, _slot int, _kept int, _bad int, id int, score double"


def table(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 1, "x", 2, "y", 3, 4, 5, 6, 7, 0.5) for i, t, s in rows]
    return spark.createDataFrame(full, CLASH)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, out = prose(70), []
    for i in range(n):
        words = prose(rng.choice([0, 1, 3, 20, 60, 150]))
        kind = i % 6
        if kind == 1 and out:
            words = rng.choice(out)[:]  # a copy
        elif kind == 2 and out:
            words = [w if rng.random() > 0.04 else "zz" + w for w in rng.choice(out)]  # a near copy
        elif kind == 3:
            at = rng.randint(0, len(words))
            words[at:at] = shared[rng.randint(0, 10) :]  # a passage
        elif kind == 4 and words:
            words = (words[:7] or ["a"]) * 20  # periodic
        out.append(words)
    return [" \n\t"[i % 3].join(w) for i, w in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 3}" if i % 5 else "hot") for i, t in enumerate(texts())]
    rows += [(100, None, "a"), (101, "", None), (102, "é ß \x0b x y z", "a"), (5, rows[5][1], rows[5][2]), (None, "no id here", "b"), (None, None, None), (103, "long " * 40_000 + "end", "a")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_words_and_windows():
    column = pa.array(["Ab  c\n d", None, "", "x", " é\x0by z\xa0w "])
    for limit in (1, 4, 1 << 20):
        found = []
        for i, j, buf, bounds in slices(column, limit):
            w = Words(buf, bounds, lower=True)
            found += [[bytes(buf[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
        assert found == [WORD.findall(t or "") for t in column.to_pylist()]
    x = np.array([5, 3, 9, 1, 7, 7, 2], np.uint64)
    assert window_min(x, 3).tolist() == [min(x[k : k + 3]) for k in range(5)]
    h, at = grams(np.arange(6, dtype=np.uint64), np.array([0, 2, 2, 6]), 3)
    assert at.tolist() == [2, 3] and len(set(h.tolist())) == 2


def cut_by_brute_force(rows):
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        cut = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                cut[k : k + 50] = [True] * 50
        out[i] = (len(w), " ".join(x for x, y in zip(w, cut) if not y))
    return out


def test_substring_dedup(docs, empty):
    got = substring_dedup.substring_dedup(docs).collect()
    want = cut_by_brute_force([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.kept) == want[r.doc_id], r.doc_id
            assert sum(s.end - s.start for s in r.spans) == r.n_words - len(r.kept.split())
    assert any(r.spans for r in got) and sorted((r.kept for r in got if r.doc_id is None)) == ["", "no id here"]
    assert substring_dedup.substring_dedup(empty).count() == 0


def groups_by_brute_force(rows, n):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, empty, n):
    want = groups_by_brute_force([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], n)
    got = minhash_dedup.near_duplicates(docs, n).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = minhash_dedup.representatives(docs, n)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert minhash_dedup.near_duplicates(empty, n).count() == 0


def test_near_copies_of_a_large_group(spark):
    """A group whose members are near its middle, some just within and some just beyond the threshold."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = base[:]
        for k in rng.sample(range(120), rng.randint(0, 9)):
            w[k] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(w), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == groups_by_brute_force([(i, t) for i, t, _ in rows], 2)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tokens_round_trip(spark, docs, empty):
    path = token_output.default_tokenizer()
    encoder = token_output.Encoder(path)
    rng = random.Random(5)
    letters = " \n\t'’.,!?;:()-$%&*abcXYZéßñ12٣　 \x85\x1c​–“”\U0001f600中́<|endoftext|>"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        ids, n = encoder.encode([t, "x"], 0)
        assert ids[: n[0] - 1].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids and n.sum() == len(ids)
    folder = token_output.fresh_path(spark, "tokens")
    files = token_output.write_tokens(docs, folder, path, sequence=64, batch=4)
    got = sorted(token_output.read_index(spark, folder, files).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, everything = 0, []
    for r, d in zip(got, rows):
        ids = encoder.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        everything += ids
    assert len(got) == len(rows)
    held = []
    for name, start, n in files:  # equal-length sequences by place, over mapped memory
        batches = token_output.sequences(f"{folder.removeprefix('file://')}/{name}.arrow")
        own = []
        for k in range(sum(b.num_rows for b in batches)):
            b = batches[k // 4]
            ids, mask = b.column("ids")[k % 4].values, b.column("mask")[k % 4].values
            assert len(ids) == len(mask) == 64
            own += ids.filter(mask).to_pylist()
        assert own == everything[start : start + n]
        held += own
    assert held == everything
    assert token_output.read_index(spark, folder, token_output.write_tokens(empty, folder, path)).count() == 0


def test_pieces_are_cut_in_whole_slices(monkeypatch):
    """Python asks for each different piece of a slice of texts once, however often it occurs, and nulls and special strings stay exact."""
    encoder = token_output.Encoder(token_output.default_tokenizer())
    asked = []

    class Asked(type(encoder.number)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    numbers = Asked()
    numbers.default_factory = getattr(encoder.number, "default_factory", None)
    monkeypatch.setattr(encoder, "number", numbers)
    texts = ["one two, two\u2003one " * 50, "", " two\n\n", "caf\xe9, \u3042\u3000\u3042"] * 3
    ids, n = encoder.encode(texts, 7)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [x for w in want for x in w]
    assert len(asked) == len(set(asked)) > 5
    special = pa.array(["a b", "x<|endoftext|>y", None])
    ids, n = encoder.encode(special, 0)
    assert ids.tolist() == [x for t in special.to_pylist() for x in encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]] and n[2] == 1


def test_contamination(spark, docs, empty):
    item = "He said Tom Baker has 12 apples and 5 pears and gave 12 apples to the boy in town"
    rows = [(1, item, "a"), (2, item.replace("Tom Baker", "Ann Cole").replace("12", "31").replace("5", "8"), "a"), (3, item.replace("gave 12", "gave 13"), "a"), (4, "before it. " + item.lower().replace("tom baker", "Tom Baker") + " after", "a"), (None, item, "a"), (6, None, "a"), (7, "", "a"), (8, "He said that Tom Baker has no apples at all", "a")]
    bench = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (None, item, 1), (10, "five words are one window", 1)], "item_id long, text string, h int")
    got = decontaminate.contamination(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (4, 7)}
    left = decontaminate.decontaminate(table(spark, rows), bench)
    assert left.columns == table(spark, rows).columns and Counter(r.doc_id for r in left.collect()) == Counter([3, None, 6, 7, 8])
    assert decontaminate.contamination(table(spark, [(1, "x Five words, are one window! y", "a")]), bench).count() == 1
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_contamination_by_numbers_and_names(spark):
    """Exact copies whose windows are mostly placeholders or have lost their capitals, and different values that become equal."""
    items = [(1, "12 5 7 9 33 48 51 60 72 81 90 102 17 4"), (2, "He told Tom that Ann and Bob saw Kim near Rome with Max and Eve in Bonn"), (3, "there were at first 12 red apples and 5 ripe pears in the old basket by the door")]
    rows = [(1, "see " + items[0][1] + " there", "a"), (2, items[1][1].lower(), "a"), (3, items[2][1].replace("12", "7").replace("5", "7"), "a"), (4, items[0][1].replace("51", "52").replace("7 9", "7 8"), "a"), (5, items[2][1].replace("red", "green").replace("ripe", "soft").replace("old", "new"), "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(table(spark, rows), bench).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_contamination_in_blocks(spark, monkeypatch):
    """More windows than go to the tasks at once: the same result, in several passes."""
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randint(0, 999)}" for _ in range(30))) for k in range(8)]
    rows = [(k, "lead " + t + " tail", "s") for k, t in items[::2]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", 40)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(table(spark, rows), bench).collect()} == {(k, k) for k, _ in items[::2]}


def test_mixing(docs, empty):
    for parts in ([1], [3, 5], [1, 1, 1], [7, 2, 1, 90], [500, 300, 200, 24]):
        cycle, n = sum(parts), Counter()
        for s, i, release, deadline, slot in mixing.schedule(parts):
            assert i == n[s] and release <= slot < deadline
            n[s] += 1
            assert all(abs(n[k] - p / cycle * (slot + 1)) < 1 for k, p in enumerate(parts))
    assert sum(mixing.shares([5, 3, 1e-9], 16)) == 16 and min(mixing.shares([5, 3, 1e-9], 16)) == 1
    plan = mixing.interleave(docs, weights={"hot": 2.0, "a": 1.0, "src1": 1.0}, block=2, cycle=64).collect()
    assert len(plan) == docs.select("source", "doc_id").distinct().count()
    for source in {r.source for r in plan}:  # blocks in the order of doc_id
        own = sorted((r for r in plan if r.source == source), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [r.block for r in own] == sorted(r.block for r in own) and all(r.release <= r.slot < r.deadline for r in own)
    assert max(Counter((r.source, r.block) for r in plan).values()) <= 2
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(map(str, out.collect())) == Counter(map(str, docs.collect()))
    assert mixing.interleave(empty).count() == 0 and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "z": 0.0}, {"a": 0.9, "b": 0.0999, "c": 0.0001, "z": 0.0}])
def test_mixing_keeps_to_the_given_weights(spark, weights):
    rows = [(i, "t", s) for s, n in (("a", 4000), ("b", 4000), ("c", 3), ("z", 20)) for i in range(n)]
    plan = sorted(mixing.interleave(table(spark, rows), weights=weights, block=1).collect(), key=lambda r: r.slot)
    assert len(plan) == len(rows) == len({r.slot for r in plan}) and {r.source for r in plan[-20:]} == {"z"}
    left, n, at = Counter(r.source for r in plan), Counter(), {r.slot: r.source for r in plan}
    for slot in range(max(at) + 1):
        n[at.get(slot)] += 1
        assert all(abs(n[s] - weights[s] / sum(weights.values()) * (slot + 1)) < 1 + 1e-6 for s in "abc" if n[s] < left[s])
        assert not n["z"] or all(n[s] == left[s] for s in "abc")


def test_licences(spark, docs, empty):
    mit = dict((t, i) for i, t in license_scan.KNOWN)
    body = next(t for t in mit if t.startswith("MIT License"))
    rows = [(1, "Copyright (c) 2020 Some One\n" + body.upper().replace("LICENSE", "LICENCE"), "a"), (2, "words\nReleased under the MIT licence!!\nmore", "a"), (3, "I was released under the MIT License yesterday", "a"), (4, None, "a"), (5, "", "a"), (None, "All rights reserved", "a"), (6, "© 2019 X. All rights reserved.", "a")]
    got = {(r.doc_id, r.scope, r.line_no, r.license_id) for r in license_scan.scan(table(spark, rows)).collect()}
    assert {(1, "text", 0, "MIT"), (2, "line", 2, "MIT"), (None, "text", 0, "LicenseRef-all-rights-reserved"), (None, "line", 1, "LicenseRef-all-rights-reserved")} <= got
    assert not {r[0] for r in got} & {3, 4, 5, 6}
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0
    assert "Python" not in license_scan.scan(docs)._jdf.queryExecution().toString()


def test_licences_with_any_punctuation(spark):
    """What canonicalisation takes for a space may stand anywhere between a known text's words."""
    rows = [(1, "All rights\nreserved.", "a"), (2, "All rights-reserved", "a"), (3, "This work is in the public-domain.", "a"), (4, "x\nAll  rights   reserved\ny", "a")]
    got = {(r.doc_id, r.scope, r.license_id) for r in license_scan.scan(table(spark, rows)).collect()}
    assert {(1, "text", "LicenseRef-all-rights-reserved"), (2, "text", "LicenseRef-all-rights-reserved"), (3, "line", "LicenseRef-public-domain"), (4, "line", "LicenseRef-all-rights-reserved")} <= got
    for _, known in license_scan.KNOWN:
        assert any(m in word for m in license_scan.MARKS for word in re.findall(r"\w+", known.lower()))


def test_html():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div id="wrap"><div class="menu"><a href=x>Home</a> <a href=y>About</a></div>
<div class="post-content"><h2>Head &amp; tail</h2><p>First, para with, some commas and a length that goes on for a while, yes&nbsp;it does.<p>Second <b>para</b>,
 longer, with more text, and so on, and so forth until it's over.<!-- no --><ul><li>item one, x<li>item two</ul><script>var t="</p>";</script><div class="ad-box">Buy now!</div><blockquote>Quoted, text</blockquote></div>
<div id="comments"><p>Nice post, really, I liked it, a lot, so much, wow.</p></div><div class="sidebar"><p>Related</p></div></div><form><p>Subscribe, now</p></form><footer>foot</footer>"""
    assert html_extract.extract(page).split("\n") == ["Head & tail", "First, para with, some commas and a length that goes on for a while, yes it does.", "Second para, longer, with more text, and so on, and so forth until it's over.", "item one, x", "item two", "Quoted, text"]
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x</script>") == ""
    assert html_extract.extract("just text") == "just text" and html_extract.extract("<p>a<p>b") == "a\nb" and html_extract.extract("<p>1 &lt; 2</p><div") == "1 < 2\n<div"
    assert html_extract.extract("<article>" + "<p>x, y</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert html_extract.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_keeps_what_names_only_resemble():
    text = "A paragraph with some commas, and text, that goes on for quite a while, as an article's would do here."
    for name in ("layout no-sidebar", "rounded overflow-hidden"):
        assert html_extract.extract(f"<body><div class='{name}'><p>{text}</p><p>{text}</p></div></body>") == f"{text}\n{text}"
    page = f"<article><div class='section-header'><h2>Head</h2></div><p title='The hidden cost'>{text}</p><p data-id='comments'>{text}</p><p hidden>no</p><ul><li><a href=a>Ref one</a><li><a href=b>Ref two</a><li><a href=c>Ref three</a></ul><nav><a href=d>Home</a></nav></article>"
    assert html_extract.extract(page).split("\n") == ["Head", text, text, "Ref one", "Ref two", "Ref three"]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.main_text(pages).collect()), key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (2, None, ""), (None, "v", "")], key=str)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_toxicity_grammar():
    g = toxicity.Grammar()
    total = lambda t: sum(x for _, x in g.clauses(t))
    assert total("you are an idiot") > total("an idiot") > total("not an idiot") > 0
    assert total('they said "idiot"') < total("idiot") and total("he wrote: all fine. idiot") == total("idiot")
    assert total("I will kill you") > total("kill") > 0 and total("the weather is nice, you see") == 0
    assert total("IDIOT") == total("idiot") and total("idiotic") == 0
    assert [c for c, _ in g.clauses("Fine. You moron! Fine.")] == ["You moron"]


def test_toxicity_scan_sees_capitals_outside_ascii(spark):
    g = toxicity.Grammar(words={"réeux": 5.0})
    assert toxicity.plain_words("RÉEUX Töten TÖTEN") == {w.encode() for w in ("réeux", "töten")}
    got = {r.doc_id: r.clauses for r in toxicity.score(table(spark, [(1, "ICH WERDE DICH TÖTEN", "s"), (2, "QUEL RÉEUX", "s")]), g).collect()}
    assert [c.clause for c in got[1]] == ["ICH WERDE DICH TÖTEN"] and [c.clause for c in got[2]] == ["QUEL RÉEUX"]


def test_toxicity_learns_words_and_stems(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice("abc def ghi jkl mno pqr".split()) for _ in range(30)]
        if bad := i % 6 == 0:
            w[rng.randint(0, 29)] = rng.choice(["grumblefit", "snorkax" + rng.choice("abcdefghij") * 2])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad), 1))
    marks = spark.createDataFrame(labels + [(0, None, 1), (None, 1, 1), (1, 0, 1)], "doc_id long, toxic int, score int")
    grammar = toxicity.fit(table(spark, rows), marks, toxicity.TRAINING)
    assert "grumblefit" in grammar.words and any(s.startswith(b"snor") for s in grammar.stems)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(table(spark, rows), grammar).collect()}
    assert got == {i: i % 6 == 0 for i in range(600)}
    kept = toxicity.without_toxic(table(spark, rows), grammar)
    assert kept.count() == 500 and kept.columns == docs.columns
    assert toxicity.score(docs, grammar).count() == docs.count() and toxicity.score(empty, grammar).count() == 0
    plain = toxicity.fit(empty, marks, toxicity.TRAINING)
    assert plain.words.keys() == toxicity.Grammar().words.keys() and toxicity.fit(docs, marks.limit(0), "true") == toxicity.Grammar()


def test_hmm_is_exact_on_small_chains():
    rng = np.random.default_rng(0)
    model = hmm_lm.Model(np.zeros(0, np.uint64), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T.copy())
    seqs = [rng.integers(0, 4, n) for n in (3, 1, 5, 5, 2)]
    first, flat = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), np.concatenate(seqs)
    start, move, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)), []
    for s in seqs:
        paths = [(p, model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[s[i], p[i]] for i in range(1, len(s)))) for p in itertools.product(range(3), repeat=len(s))]
        z = sum(w for _, w in paths)
        logs.append(math.log10(z))
        for p, w in paths:
            start[p[0]] += w / z
            for i, x in enumerate(s):
                emit[x, p[i]] += w / z
                if i:
                    move[p[i - 1], p[i]] += w / z
    assert np.allclose(hmm_lm.log10_likelihoods(model, flat, first), logs)
    assert all(np.allclose(a, b) for a, b in zip(hmm_lm.expected_counts(model, flat, first), (start, move, emit)))


def test_language_model(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(hmm_lm, "SYMBOLS", 50)
    monkeypatch.setattr(hmm_lm, "LOOKUP", 80)
    out = hmm_lm.scores(docs, "crc32(cast(doc_id as string)) % 5 = 1", iterations=1).collect()
    rows = docs.collect()
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(x for r in rows if not held(r.doc_id) for x in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(counts[x] > 0 for x in tokens(r.text)), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(r.text))) for r in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and [r[-1] for r in got] == pytest.approx([r[-1] for r in want], rel=1e-8)
    assert all(r.score < 0 for r in out)
    assert hmm_lm.scores(empty, "false").count() == 0
    assert hmm_lm.scores(docs, "true").count() == docs.count()  # nothing to learn from


def test_language_model_probabilities_add_up(spark, docs):
    """Over all symbols and, within a class, all its tokens and the place for unseen ones, the next token has probability one."""
    model, counts, rest = hmm_lm.train(docs.where("doc_id is not null"), states=3, iterations=1)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    own = set(model.own.view(np.int64).tolist())
    for g in range(hmm_lm.CLASSES):
        inside = [r.c for r in counts.collect() if r.h not in own and r.g == g] if g < 3 else None
        if inside is not None:
            total = 10 ** rest["share"][g]
            assert np.isclose(sum(c + 0.5 for c in inside) + 0.5, total)


def test_rounds_read_batches_that_are_laid_out_once(monkeypatch):
    """What each round of Baum-Welch reads needs no sorting any more, and gives what forward-backward over the texts gives, whatever their lengths."""
    rng = random.Random(8)
    texts = pa.array([" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 9, 40, 3000]))) for _ in range(60)] + [None])
    (_, _, h, g, first), *more = hmm_lm.tokens(texts)
    noise = np.random.default_rng(2)
    own = np.unique(h)[:5]
    model = hmm_lm.Model(own, noise.dirichlet(np.ones(3)), noise.dirichlet(np.ones(3), 3), noise.dirichlet(np.ones(5 + hmm_lm.CLASSES), 3).T.copy())
    want = hmm_lm.expected_counts(model, model.symbols(h, g), first)
    rows = list(hmm_lm._encode(model)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    monkeypatch.setattr(hmm_lm, "_Batch", None)
    (got,) = hmm_lm._expect(model)(iter(rows))
    place = got.column("symbol").to_numpy()
    sums = np.stack([got.column(f"s{k}").to_numpy() for k in range(3)], axis=1)
    all_emit = np.zeros_like(want[2])
    all_emit[place[place >= 0]] = sums[place >= 0]
    assert not more and np.allclose(sums[0], want[0]) and np.allclose(sums[1:4], want[1]) and np.allclose(all_emit, want[2])


def test_hashes_are_found_by_their_leading_bits():
    rng = np.random.default_rng(3)
    ends = np.array([0, 1, 2**63, 2**64 - 2, 2**64 - 1], np.uint64)
    for values in (np.zeros(0, np.uint64), ends[:-1], ends, np.arange(300, dtype=np.uint64), np.unique(np.append(rng.integers(0, 2**64, 5000, np.uint64), ends))):
        asked = np.concatenate([values, ends, np.arange(400, dtype=np.uint64), rng.integers(0, 2**64, 5000, np.uint64)])
        at, there = hmm_lm.Places(values).find(asked)
        assert np.array_equal(there, np.isin(asked, values)) and np.array_equal(values[at[there]], asked[there])


def test_language_model_learns_from_all_texts_in_every_round(spark):
    """From the noise start, each round is one of Baum-Welch over all texts, more of them than any sample would hold."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a b c d", "w x y z"][i % 2].split()) for _ in range(rng.randint(1, 6))), "s") for i in range(2000)]
    data = table(spark, rows)
    begin, _, _ = hmm_lm.train(data, states=2, iterations=0)
    assert np.allclose(begin.move, [[0.95, 0.05], [0.05, 0.95]])
    (_, _, h, g, first), *more = hmm_lm.tokens(pa.array([t for _, t, _ in rows]))
    symbols, want = begin.symbols(h, g), begin
    overall = np.bincount(symbols, minlength=len(begin.emit)) + 0.5
    for _ in range(3):
        want = hmm_lm._estimate(want, hmm_lm.expected_counts(want, symbols, first), overall / overall.sum())
    got, _, _ = hmm_lm.train(data, states=2, iterations=3)
    assert not more and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit) and np.allclose(got.start, want.start)


def nearest_by_brute_force(vectors, asked, k):
    out = {}
    for q in asked:
        x = np.array(vectors[q])
        score = sorted(((-float(np.sum(np.cumsum(x * np.array(v))[-1:])), i) for i, v in vectors.items() if i != q))
        out[q] = [i for _, i in score[:k]]
    return out


def test_search_is_exact_with_ties_and_bad_vectors(spark):
    rng = random.Random(8)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(4)] for i in range(400)}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(900, None, 1), (901, [0.0] * 4, 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan"), 1.0, 1.0, 1.0], 1), (904, [float("inf"), 1.0, 1.0, 1.0], 1), (905, [1.0], 1), (None, [1.0] * 4, 1), (906, [], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, score int")
    got = vptree_ann.search(df, df.where("id % 20 = 0"), k=7, shard=100, block=8).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == sum(a * b for a, b in zip(vectors[r.query_id], vectors[r.vec_id]))
    assert found == nearest_by_brute_force(vectors, [i for i in vectors if i % 20 == 0], 7)
    assert vptree_ann.search(df.limit(0), df.limit(0)).count() == 0 and vptree_ann.search(df.where("id < 3"), df.where("id = 0")).count() == len([i for i in (1, 2) if i in vectors])


def test_search_is_exact_beside_a_very_long_vector(spark):
    x = np.random.default_rng(5).normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {}
    for r in sorted(vptree_ann.search(df, df.where("id % 100 = 0"), k=20).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [i for i in np.lexsort((np.arange(1200), -(x @ x[q]))).tolist() if i != q][:20] for q in range(0, 1200, 100)}


def test_tree_prunes_and_relaxes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in rng.normal(0, 1, (12, 8))])
    tree, asked = vptree_ann.VPTree(points, 64), points[::50] + 0.01
    exact, d = tree.search(asked, 5)
    want = np.argsort(((asked[:, None] - points) ** 2).sum(axis=2), axis=1, kind="stable")[:, :5]
    assert np.allclose(d, np.take_along_axis(np.sqrt(((asked[:, None] - points) ** 2).sum(axis=2)), want, 1))
    assert (tree.bounds(asked) > d[:, -1:]).mean() > 0.5  # most leaves are never looked at
    loose, _ = tree.search(asked, 5, relax=2.0)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(loose, want)]) >= 0.9


def test_queries_digest_what_operators_give(spark, sf_dir):
    from filigree.llm import queries

    out = queries.queries()["op4_substring_dedup"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    whole = substring_dedup.substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("doc_id = 3").first()
    assert out.where("doc_id = 3").first().kept_sha256 == hashlib.sha256(whole.kept.encode()).hexdigest()
    assert queries.queries()["op6_minhash_near_dedup"](spark, sf_dir).dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert queries.queries()["op9_vantage_point_search"](spark, sf_dir).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
