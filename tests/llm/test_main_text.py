"""Main text: what goes by name, what stays, hard pages in linear time, and a brute-force tree scorer."""

import html.parser
import random
import re
import time

import pytest
from filigree.llm import html_extract

LONG = "A paragraph with some commas, and text, that goes on for quite a while, as an article's would do here."


def lines(page):
    return html_extract.extract(page).split("\n")


@pytest.mark.parametrize("name", ["post-comments", "article-comments", "comment-list", "main-sidebar", "content-ad", "ad-box", "AdBanner", "cookie-notice", "relatedPosts", "share-buttons", "footer-content", "menu-item", "widget-area"])
def test_names_of_what_is_not_the_article(name):
    noise = f"<div class='{name}'><p>{LONG} Noise.</p><p>{LONG} Noise.</p></div>"
    assert lines(f"<body><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>{noise}</article></body>") == ["Head", LONG, LONG]
    assert lines(f"<body><div class='story'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>{noise}</body>") == ["Head", LONG, LONG]


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "rounded overflow-hidden", "article-header", "legal", "side note", "headerless", "section-header"])
def test_names_that_only_resemble(name):
    assert lines(f"<article><h1>Head</h1><div class='{name}'><p>{LONG}</p></div><p class='{name}'>{LONG}</p></article>") == ["Head", LONG, LONG]


def test_comments_as_articles_go():
    thread = "".join(f"<article class='comment'><p>{LONG} Reply {k}.</p></article>" for k in range(30))
    assert lines(f"<main><article><h1>Head</h1><p>{LONG}</p></article><section id='comments'><h2>Replies</h2>{thread}</section></main>") == ["Head", LONG]


def test_frames_stay():
    inner = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    assert lines(f"<body><div class='page right-sidebar'><article>{inner}</article></div></body>") == ["Head", LONG, LONG]
    assert lines(f"<body><form id='f'><div>{inner}</div><input name=q></form></body>") == ["Head", LONG, LONG]
    assert lines(f"<body><div class='sidebar'><p>{LONG}</p></div></body>") == [LONG]  # names leave nothing


def test_an_article_stays_whole():
    page = f"<main><section><h2>One</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><h2>Last</h2><p>Short.</p></section></main>"
    assert lines(page) == ["One", LONG, LONG, LONG, LONG, "Last", "Short."]
    assert lines(page.replace("main", "div"))[-2:] == ["Last", "Short."]
    assert lines(f"<article><header><h1>Head</h1></header><p>{LONG}</p><figure><img src=x><figcaption>What it shows</figcaption></figure><p>So <math><mi>x</mi></math> is.</p></article>") == ["Head", LONG, "What it shows", "So x is."]
    refs = "".join(f"<li><a href=#{k}>Reference {k}</a></li>" for k in range(9))
    assert lines(f"<article><p>{LONG}</p><h2>References</h2><ol>{refs}</ol></article>")[1:] == ["References", *(f"Reference {k}" for k in range(9))]
    assert lines(f"<div id=w><h1>Head</h1><div class=c><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=a>x y</a></div></div></div>")[0] == "Head"


def test_left_out_inside_a_line():
    assert lines(f"<article><p>Say <span hidden><b>not</b> this</span>that <button>Press</button>now, {LONG}</p></article>") == [f"Say that now, {LONG}"]


@pytest.mark.parametrize("piece", ["<div>", "<div>x", '<a "', "<b>", "<b>x</i>", "<a b='", "<a \"'>", "<li>x<div>", "</div>x<b>", '<p class="', "<!--", "<svg>", "<", "<form>x"])
def test_hard_pages_take_linear_time(piece):
    size = 200_000
    began = time.process_time()
    html_extract.extract(piece * (size // len(piece)))
    assert time.process_time() - began < 6


class _Plain(html.parser.HTMLParser):
    """Brute force for well-formed pages of div and p alone: every element with its paragraphs."""

    def __init__(self):
        super().__init__()
        self.open, self.nodes, self.blocks = [0], [None], []

    def handle_starttag(self, tag, attrs):
        self.nodes.append(self.open[-1])
        self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.blocks.append((self.open[-1], data))


def by_brute_force(page):
    tree = _Plain()
    tree.feed(page)
    up = lambda n: [] if n is None else [n, *up(tree.nodes[n])]
    points = dict.fromkeys(range(len(tree.nodes)), 0.0)
    size = dict.fromkeys(points, 0)
    for own, text in tree.blocks:
        for level, n in enumerate(up(own)):
            size[n] += len(text)
            if 0 < level < 12:
                points[n] += (1 + min(3, len(text) // 100) + text.count(",")) / level
    held = [n for n in points if n and points[n]] or [0]
    first = [n for n in held if points[n] == max(points[m] for m in held)]
    if points[0] > points[first[0]]:
        first = [0]
    if len(first) > 1:
        return None
    best, keep = first[0], {first[0]}
    for n in points:
        if n and best and tree.nodes[n] == tree.nodes[best]:
            is_p = any(own == n for own, _ in tree.blocks)
            if (points[n] and points[n] >= points[best] / 5) or (is_p and size[n] > 80):
                keep.add(n)
    return "\n".join(t for own, t in tree.blocks if keep & set(up(own)))


def test_scores_as_brute_force_does():
    rng = random.Random(12)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.5:
                out.append(f"<div>{tree(depth - 1)}</div>")
            else:
                out.append(f"<p>{'word, ' * rng.randint(0, 6)}{'text ' * rng.randint(1, 60)}end</p>")
        return "".join(out)

    seen = 0
    for _ in range(400):
        page = tree(3)
        want = by_brute_force(page)
        if want is not None:
            seen += 1
            assert html_extract.extract(page) == re.sub(" +", " ", want), page
    assert seen > 300
