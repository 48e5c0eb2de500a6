"""Pages whose names the training pages do not have: a grammar of its own, and pages as sites write them."""

from __future__ import annotations

import random

import pytest

from aerolake.llm.html_blocks import blocks
from aerolake.llm.html_extraction import Committee, PageGrammar

PROSE = "The river rose by two metres on Monday after three days of heavy rain in the hills, the water board said, and residents of the lower town were told to keep away from the bridges until the peak had passed".split()


@pytest.fixture(scope="module")
def committee():
    return Committee.trained()


def kept(committee, html: str) -> list[str]:
    found = blocks(html)
    return [b.text for b, k in zip(found, committee.label([html], [found])[0], strict=True) if k]


def test_disguised_pages(committee):
    """Made pages under names that tell nothing, from a seed that training never saw."""
    grammar, right, total = PageGrammar(4321), 0, 0
    for found, labels in (grammar.sample(1.0) for _ in range(150)):
        if found:
            right += int((committee.bare.label([found])[0] == labels).sum())
            total += len(labels)
    assert right / total > 0.94


def own_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of nested plain elements with names of no language, and its article's blocks."""
    name = lambda: "x" + "".join(r.choice("qwzkjvy0123456789") for _ in range(5))
    words = lambda a, b: " ".join(r.choice(PROSE) for _ in range(r.randrange(a, b))).capitalize() + "."
    links = lambda n: "".join(f'<div class="{name()}"><a href="/{name()}">{r.choice(PROSE).capitalize()}</a></div>' for _ in range(n))
    body = [words(4, 9)] + [words(25, 70) for _ in range(r.randrange(4, 9))]
    article = f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}</p>" for p in body[1:])
    top, bottom = f'<div class="{name()}">{links(r.randrange(3, 8))}</div>', f'<div class="{name()}">{links(r.randrange(2, 5))}<p>&copy; {words(2, 4)}</p></div>'
    return f'<html><body>{top}<div class="{name()}"><div class="{name()}">{article}</div></div>{bottom}</body></html>', body


def test_own_grammar(committee):
    r, hits, wanted, wrong = random.Random(8), 0, 0, 0
    for _ in range(80):
        html, body = own_page(r)
        got = kept(committee, html)
        hits += len(set(got) & set(body))
        wanted += len(set(body))
        wrong += len(set(got) - set(body))
    assert hits / wanted > 0.75 and wrong / wanted < 0.03


def test_pages_as_sites_write_them(committee):
    blog = '<html><body><div id="masthead"><a href="/">My blog</a></div><div class="entry-content"><h1>How to grow beans</h1><p>Beans like warm soil and a place in the sun, and they do not mind if the soil is poor, as long as it drains well.</p><p>Sow them two centimetres deep once the nights are mild and water them in the morning.</p></div><div id="secondary"><h3>Recent Posts</h3><ul><li><a href="/a">Roses</a></li><li><a href="/b">Tulips</a></li></ul></div><div id="colophon"><p>Powered by <a href="x">Press</a></p></div></body></html>'
    assert [t.split()[0] for t in kept(committee, blog)] == ["How", "Beans", "Sow"]
    thread = '<html><body><nav><a href="/">Home</a></nav><article><h1>A walk in the hills</h1><p>We left at dawn and walked along the ridge until the sun was high over the valley and the mist had gone.</p><p>At noon we rested by the old chapel and shared bread and cheese with a shepherd and his two dogs.</p></article><div id="disqus_thread"><div><b>tom</b>: nice walk!</div><div><b>ann</b>: I was there last year, lovely.</div></div><footer>&copy; me</footer></body></html>'
    assert [t.split()[0] for t in kept(committee, thread)] == ["A", "We", "At"]
    other = '<html><body><div class="kopf"><a href="/">Zeitung</a></div><div class="navigation-leiste"><ul><li><a href="/p">Politik</a></li><li><a href="/w">Wirtschaft</a></li></ul></div><div class="inhalt"><h1>Neue Brücke eröffnet</h1><p>Die neue Brücke über den Fluss ist am Samstag nach drei Jahren Bauzeit eröffnet worden, und hunderte Menschen kamen zum Fest am Ufer.</p></div><div class="fusszeile"><a href="/i">Impressum</a><a href="/d">Datenschutz</a></div></body></html>'
    got = [t.split()[0] for t in kept(committee, other)]
    assert "Neue" in got and not {"Zeitung", "Politik", "Wirtschaft", "ImpressumDatenschutz"} & set(got)
