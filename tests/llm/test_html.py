"""Main text of pages: templates, votes and winners."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from atlasframe.llm import html_extract

BODY = "<h1>A title of some words</h1><p>The first paragraph tells what happened on that day, and to whom.</p><p>The second one tells it again in many more words than were needed.</p>"
WORDS = "A title of some words\nThe first paragraph tells what happened on that day, and to whom.\nThe second one tells it again in many more words than were needed."
MENU = '<nav><a href="/">Home</a></nav><div class="sidebar-left"><p>Elsewhere on this site</p></div><div class="cookie-notice"><p>We use cookies</p></div>'


def text_of(source):
    page = html_extract.parse(source)
    best = html_extract._shares(html_extract.path_scores(page))
    return html_extract.text_under(page, best[0][0] if best else None)


@pytest.mark.parametrize(
    "start",
    ['<div class="content-area has-sidebar">', '<div id="page" class="site no-sidebar">', '<main class="no-comments">', '<div class="page with-header">', '<div class="post search-results-item">', '<form id="aspnetForm"><div>', '<object data="x"><div>'],
)
def test_templates_keep_their_article(start):
    assert text_of(f"<html><body>{MENU}{start}{BODY}</div></body></html>") == WORDS


def test_outside_parts_go():
    comments = "<div id='comments' class='comments-area'>" + "<p>I say what I always say about such things, at length.</p>" * 40 + "</div>"
    form = "<form><label>Your name</label><input name=a><p>Send us a word</p></form>"
    page = f"<html><body>{MENU}<header><p>The Daily</p></header><div class='entry'>{BODY}</div>{form}<div class='ads'><p>Buy it</p></div>{comments}<footer><p>All rights</p></footer></body></html>"
    assert text_of(page) == WORDS


def random_pages(n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        parts = "".join(f"<{t} class='c{rng.randint(1, 3)} x{k}'>{rng.choice(['<p>', '<h2>', '<div>', '<div><a>', ''])}{'wort ' * rng.randint(1, 30)}{rng.choice(['.', ''])}</{t}>" for t in rng.choices(["div", "section", "article"], k=4))
        rows.append((k, f"https://host{k % 3 if k % 4 else 9}.example/p{k}", f"<html><body>{parts}</body></html>"))
    return rows


def plain_text(page, key):
    """Blocks below winners and, beside them, those of parts that read like prose; by walks up from each block."""
    nodes = page.nodes
    wins = lambda node: any(n.weight and n.key == key for n in above(page, node))
    winners = [k for k in range(len(nodes)) if wins(k)]
    holds = {k for w in winners for k in chain(nodes, w)}
    parts = defaultdict(list)
    own = {}
    for i, (node, text, free) in enumerate(page.blocks):
        beside = [k for k in chain(nodes, node) if k not in holds]
        own[i] = ("in",) if wins(node) else (beside[-1] if node not in holds else ("block", i))
        parts[own[i]].append((nodes[node].tag, text, free))
    if ("in",) not in parts:
        return ""
    prose = {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "blockquote"}
    good = {part for part, blocks in parts.items() if any(tag in prose or len(x) >= 80 or x.rstrip("\"'”’»)").endswith(tuple(".!?…。！？")) for tag, x, _ in blocks) and 2 * sum(len(x) * f for _, x, f in blocks) >= sum(len(x) for _, x, _ in blocks)}
    free = lambda part: sum(len(x) * f for _, x, f in parts[part])
    good -= {part for part in good if isinstance(part, int) and nodes[part].weight > 0 and free(part) > free(("in",))}
    named = lambda node: any(nodes[k].told and k not in holds for k in chain(nodes, node))
    return "\n".join(text for i, (node, text, _) in enumerate(page.blocks) if own[i] == ("in",) or (own[i] in good and not named(node)))


def chain(nodes, node):
    while node >= 0:
        yield node
        node = nodes[node].parent


def plain_extract(rows):
    """{page_id: (text, path, by_host)}: all votes of a host in one dict."""
    votes: dict = defaultdict(Counter)
    host = lambda url: url.split("//")[1].split("/")[0].lower()
    for _, url, source in rows:
        scores = html_extract.path_scores(html_extract.parse(source))
        for path, value in scores.items():
            votes[host(url)][path] += value / sum(scores.values())
    top = {h: min(v, key=lambda p: (-round(v[p], 6), p)) for h, v in votes.items()}
    out = {}
    for k, url, source in rows:
        page = html_extract.parse(source)
        path = top[host(url)]
        text = plain_text(page, path)
        scores = html_extract.path_scores(page)
        own = min(scores, key=lambda p: (-scores[p], p)) if not text else path
        if not text:
            text = plain_text(page, own)
        name = ">" + ">".join(n.name for n in reversed(list(above(page, next(k for k, n in enumerate(page.nodes) if n.weight and n.key == own)))) if n.name)
        out[k] = (text, name, own == path and bool(text))
    return out


def above(page, node):
    while node >= 0:
        yield page.nodes[node]
        node = page.nodes[node].parent


def test_votes_winners_and_fallback_equal_brute_force(spark):
    rows = random_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit(1)).withColumn("host", F.lit("h"))
    found = html_extract.extract(pages.repartition(5)).collect()
    assert {r.page_id: (r.text, r.path, r.by_host) for r in found} == plain_extract(rows)


def test_ties_repeats_and_edges(spark):
    tie = "<html><body><div class=b><p>same words here</p></div><div class=a><p>same words here</p></div></body></html>"
    long = "<html><body><article>" + "".join(f"<p>Absatz {k} einer langen Seite ohne Ende</p>" for k in range(120_000)) + "</article></body></html>"
    rows = [(1, "http://t.example/1", tie), (1, "http://t.example/1", tie), (2, "http://l.example/", long), (3, None, None), (4, "", ""), (None, "http://t.example/2", tie)]
    assert len(long) > 5_000_000
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == 6 and by_id[3].text == by_id[4].text == ""
    assert by_id[2].text.count("\n") == 119_999
    assert {r.text for r in found if r.page_id in (1, None)} == {by_id[1].text} != {""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- what stands beside the winner, inside of articles, and deep below

PROSE = "<p>Prose of some length tells what was found, where it was found, and why anyone should care for it.</p>" * 3
LINE = "Prose of some length tells what was found, where it was found, and why anyone should care for it."


def test_title_lead_and_last_paragraph_beside_the_content():
    page = f"<html><body>{MENU}<h1>The title</h1><p>A lead of one sentence.</p><div class=content>{PROSE}</div><p>The last paragraph.</p><div>Home page</div><div><p><a href=x>more</a> <a href=y>and more</a></p></div><footer><p>All rights</p></footer></body></html>"
    assert text_of(page) == "\n".join(["The title", "A lead of one sentence.", LINE, LINE, LINE, "The last paragraph."])


def test_a_long_advert_beside_a_short_article_stays_out():
    page = f"<html><body>{MENU}<div class=ad>Buy it now, as long as there is any, and tell all your friends.</div><article><h1>Short.</h1><p>Said.</p></article></body></html>"
    winner = next(n.key for n in html_extract.parse(page).nodes if n.tag == "article")
    assert html_extract.text_under(html_extract.parse(page), winner) == "Short.\nSaid."


def test_two_siblings_both_count():
    page = f"<html><body>{MENU}<div class=a>{PROSE}</div><div class=b>{PROSE * 2}</div></body></html>"
    assert text_of(page) == "\n".join([LINE] * 9)


def test_formulas_labels_and_legends_stay():
    page = f"<article>{PROSE}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> be a number.</p><label>A label of a figure</label><svg><text>drawn</text></svg><form><label>Your name</label></form></article>"
    assert text_of(page) == "\n".join([LINE] * 3 + ["Let x=2 be a number.", "A label of a figure"])


def test_sections_of_articles_with_names_of_outside_parts():
    named = "<section id=related-work><h2>Related work</h2><p>Others have looked at this before us, and found other things.</p></section><section class=notice-board><p>The notice board hung in the hall for all to see.</p></section>"
    gone = "<div class=related-posts><ul><li><a href=a>One more</a></li><li><a href=b>Two more</a></li></ul></div><div class=notice><p>We use cookies.</p></div><div class=ad>Buy it.</div><div class=share-buttons>Share this.</div>"
    page = f"<html><body><article>{PROSE}{named}{gone}</article></body></html>"
    assert text_of(page) == "\n".join([LINE] * 3 + ["Related work", "Others have looked at this before us, and found other things.", "The notice board hung in the hall for all to see."])


def test_hundred_thousand_nested_elements_take_seconds(spark):
    import time
    import tracemalloc

    deep = "<div class=c>" * 100_000 + "<p>text at the bottom.</p>" + "</p></x>" * 100_000
    tracemalloc.start()
    began = time.time()
    page = html_extract.parse(deep)
    assert html_extract.text_under(page, html_extract._shares(html_extract.path_scores(page))[0][0]) == "text at the bottom."
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    odd = "<div " + "a" * 300_000 + ">" + "<p>x</p>"
    began = time.time()
    html_extract.parse(odd)
    assert time.time() - began < 5
    rows = [(1, "http://d.example/1", deep), (2, "http://d.example/2", "<div><p>flat.</p></div>")]
    assert sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == [(1, "text at the bottom."), (2, "flat.")]
