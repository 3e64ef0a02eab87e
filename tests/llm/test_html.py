"""Articles in odd wrappers, and densities and choice recomputed plainly."""

import math
import random
import time

import pytest

from touchgrid.llm import html_text as H

ARTICLE = "<article><h1>T</h1><p>One long paragraph of prose here.</p><p>Two more words.</p></article>"
TEXT = "T\n\nOne long paragraph of prose here.\n\nTwo more words."
BODY = ARTICLE[len("<article>") : -len("</article>")]

WHOLE = {
    "a form round the page": f"<form id=aspnetForm><div>{ARTICLE}</div></form>",
    "a role round the article": f"<div role=alert>{ARTICLE}</div>",
    "shown later by a script": f"<div style='visibility: hidden'>{ARTICLE}</div>",
    "an unclosed form": f"<form><input>{ARTICLE}",
    "an unclosed menu": f"<nav><ul><li><a href=x>x</a><li><a href=y>y</a></ul>{ARTICLE}",
    "a name round the text": f"<div class='main overlay'>{BODY}</div>",
    "a hidden box round the text": f"<div aria-hidden=true><div class=modal>{BODY}</div></div>",
    "a form round the text": f"<form action=x><div>{BODY}</div><input type=hidden></form>",
    "the title in a header of the page": "<div class='page-header'><h1>T</h1></div>" + BODY[len("<h1>T</h1>") :],
    "long comments that are articles": f"{ARTICLE}<section id=comments><article class=comment><p>A reader writes at length, much longer than the article itself, and on and on, with many words.</p></article></section>",
    "comments in main": f"<main>{ARTICLE}<div class=comments><h3>Comments</h3><p>Nice one!</p></div></main>",
}


@pytest.mark.parametrize("kind", WHOLE)
def test_the_article_is_never_lost(kind):
    assert H.main_text(f"<html><body>{WHOLE[kind]}</body></html>") == TEXT


PARTS = {
    "<article><div class='post-header'><h1>The Title</h1><p>Intro</p></div><p>Body text.</p></article>": "The Title\n\nIntro\n\nBody text.",
    **{f"<article><h1>T</h1><p>Body text here.</p><section id='{w}'><h2>Head</h2><p>Section text.</p></section></article>": "T\n\nBody text here.\n\nHead\n\nSection text." for w in ("consent", "social", "promotions", "cookies")},
    **{f"<article><p>Before <{t}>x</{t}> after.</p><p>More text.</p></article>": "Before after.\n\nMore text." for t in ("script", "style", "button", "select", "iframe", "template", "textarea")},
    "<article><p>Before <input type=text> after.</p></article>": "Before after.",
    "<article><h1>T</h1><p>Body text here.</p><div class=newsletter><h3>Subscribe</h3><p>Get it</p><input></div><div class=ad><h4>Buy</h4><p>now</p></div><section id=comments><h2>Comments</h2><p>Nice!</p></section><aside><p>x</p></aside></article>": "T\n\nBody text here.",
}


@pytest.mark.parametrize("page", PARTS)
def test_parts_of_an_article_stay_and_boxes_in_it_go(page):
    assert H.main_text(page) == PARTS[page]


WRAPPERS = ["<form id=f1 method=post>", "<div class='layout-frame'>", "<div id=root>", "<section class=theme-dark>", "<div role=form>", "<div hidden>", "<div style='display:none'>", "<div class='zone alpha'>", "<table><tr><td>", "<center>", "<div class=sidebar-left-open>"]
NAMES = ["lead", "figure-note", "pull", "kicker", "byline", "gallery", "chapter", "epigraph", "timeline-row"]
INLINE = ["<em>{}</em>", "<a href=/x>{}</a>", "<code>{}</code>", "{}<script>var a='<p>';</script>", "<span class=smallcaps>{}</span>", "{}<button>copy</button>", "<abbr title=x>{}</abbr>", "{}<sup>2</sup>"]


@pytest.mark.parametrize("seed", range(60))
def test_drawn_pages_with_known_articles(seed):
    rng = random.Random(seed)
    words = "river town light winter quiet answer number garden stone letter".split()
    blocks, parts = [], []
    for i in range(rng.randrange(3, 9)):
        text = [rng.choice(words) for _ in range(rng.randrange(9, 50))]
        marked = list(text)
        if rng.random() < 0.6:
            k, form = rng.randrange(len(text)), rng.choice(INLINE)
            marked[k] = form.format(text[k])
            if "<sup>" in form:
                text[k] += "2"
        blocks.append(" ".join(text))
        body = " ".join(marked)
        tag = "h1" if i == 0 else rng.choice(["p", "p", "p", "blockquote"])
        part = f"<{tag}>{body}</{tag}>"
        parts.append(f"<div class='{rng.choice(NAMES)}'>{part}</div>" if rng.random() < 0.3 else part)
    page = f"<article class='{rng.choice(NAMES)}'>{''.join(parts)}</article>"
    for w in rng.sample(WRAPPERS, rng.randrange(4)):
        page = w + page  # left open now and then
        if "table" not in w and rng.random() < 0.7:
            page += f"</{w[1:].split()[0].rstrip('>')}>"
    page = f"<html><head><title>t</title></head><body><nav><a href=a>Home</a></nav>{page}<footer><p>All rights reserved.</p></footer></body></html>"
    assert H.main_text(page) == "\n\n".join(blocks), page


def plainly(page):
    """(density by node, the content nodes) of a pruned page, by the formula alone."""
    nodes = H._prune(H.parse(page))
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    below = {id(n): [m for m in nodes if any(a is n for a in ancestors(m))] for n in nodes}

    def own(n):
        return sum(len(x.replace(" ", "").replace("\n", "")) for x in n.parts if isinstance(x, str))

    chars = {id(n): own(n) + sum(own(m) for m in below[id(n)]) for n in nodes}
    links = {id(n): sum(own(m) for m in [n, *below[id(n)]] if (m is n or m in below[id(n)]) and any(a.tag == "a" for a in [m, *[x for x in ancestors(m) if x is n or x in below[id(n)]]])) for n in nodes}
    share = links[id(body)] / max(1, chars[id(body)])
    density = {}
    for n in nodes:
        c, t, lc, lt = chars[id(n)], max(1, len(below[id(n)])), max(1, links[id(n)]), max(1, sum(m.tag == "a" for m in below[id(n)]))
        base = math.log(1 + math.log(c / max(1, c - links[id(n)]) * links[id(n)] + share * c + math.e)) if c else 1
        density[id(n)] = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / base) if c else 0.0
    sums = {id(n): sum(density[id(k)] for k in nodes if k.parent is n) for n in nodes}
    return nodes, body, density, sums, below


def ancestors(n):
    while n.parent is not None:
        n = n.parent
        yield n


@pytest.mark.parametrize("seed", range(25))
def test_densities_and_choice_by_the_formula(seed):
    rng = random.Random(seed)

    def piece(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join(rng.choice(["one", "seventeen", "to", "garden"]) for _ in range(rng.randrange(1, 25)))
            return f"<p>{text}</p>" if rng.random() < 0.6 else f"<a href=x>{text}</a>"
        return "<div>" + "".join(piece(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"

    page = "<body>" + "".join(piece(4) for _ in range(rng.randrange(1, 5))) + "</body>"
    nodes, body, density, sums, below = plainly(page)
    H._weigh(nodes, body)
    for n in nodes:
        assert n.density == pytest.approx(density[id(n)]) and n.sum == pytest.approx(sums[id(n)])
    inside = [body, *below[id(body)]]
    top = max(sums[id(n)] for n in inside)
    assert body.best.sum == pytest.approx(top)
    chosen = H.choose(nodes, body)
    if top:
        path = [body.best, *ancestors(body.best)]
        threshold = min(density[id(n)] for n in path[: path.index(body) + 1])
        # the best node is content, and so is nothing under the threshold that holds no content
        assert any(c is body.best or c in ancestors(body.best) for c in chosen)
        for c in chosen:
            assert density[id(c)] >= threshold or any(density[id(a)] >= threshold for a in ancestors(c)) or c is body.best
    assert all(a not in ancestors(b) for a in chosen for b in chosen)


@pytest.mark.parametrize("page", ["<article>" + "<section id=ads><h2>x</h2><p>y" * 20_000, "<div class=overlay>" * 40_000 + "<p>x", "<article class=comment>" * 30_000 + "x", "<form><nav>" * 20_000 + "<article>x"])
def test_nested_boxes_take_linear_time(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 10


def test_a_page_over_a_slice_and_clashing_columns(spark):
    long = "<article>" + "<p>many words to read, again and again</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "x", 5)], "page_id int, url string, html string, text string, n_chars int")
    [r] = H.extract_text(df).collect()
    assert r.n_chars == len(r.text) and r.text.count("\n\n") == 59_999
