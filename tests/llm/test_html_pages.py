"""The parser's time and hand-written pages by exact text."""

import time

import pytest

from paperloom.llm import dom, html_extraction

T = "Die Sonne schien über den Feldern, und der Wind trug den Geruch von Heu herüber."
U = "The committee met on Tuesday to discuss the proposal, which had been delayed twice. Members agreed to publish a summary before the end of the month."
V = "Researchers measured the flow of the river at nine points. They found that it had slowed by a third since the dam was built, and that fish had begun to leave."

PAGES = {
    "style names": (f'<div class="css-1"><div class="css-2"><div class="css-3">{U}</div><div class="css-3">{V}</div></div></div>', [U, V]),
    "boxes in boxes": (f'<div class="css-1"><div class="css-2"><div class="css-3"><div class="css-9">{U}</div></div><div class="css-3"><div class="css-9">{V}</div></div></div></div>', [U, V]),
    "tables and fonts": (f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>About</a></td><td><font size=5>River slows down</font><br><br>{U}<br><br>{V}</td></tr></table>", [f"River slows down {U} {V}"]),
    "fonts and open paragraphs": (f"<table border=0><tr><td width=100><a href=/a>Home</a> <a href=/b>Links</a></td><td><font size=+2><b>River news</b></font><p>{U}<p>{V}</td></tr></table>", ["River news", U, V]),
    "main": (f"<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><h1>River</h1><p>{U}</p><p>{V}</p></main><aside><h3>More</h3><ul><li><a href=/x>One thing</a></li></ul></aside><footer>&copy; 2020 Site</footer>", ["River", U, V]),
    "paragraphs alone": (f"<p>{U}</p><p>{V}</p>", [U, V]),
    "lists": (f"<article><h1>Steps</h1><p>{U}</p><ol><li>Take the water.</li><li>Boil it for ten minutes.</li></ol><p>{V}</p></article><div class=share><a href=/t>Tweet</a> <a href=/f>Post</a></div>", ["Steps", U, "Take the water.", "Boil it for ten minutes.", V]),
    "notice": (f'<div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree.</p><button>OK</button></div><section class="story"><h1>River</h1><p>{U}</p><p>{V}</p></section>', ["River", U, V]),
    "spans": (f'<div><span class="a1">{U}</span></div><div><span class="a1">{V}</span></div>', [U, V]),
    "advert inside": (f'<article><h1>Sommer</h1><p>{T}</p><div class="ad">Kaufen Sie jetzt die neue Uhr. Nur heute.</div><p>{T} {T}</p></article>', ["Sommer", T, f"{T} {T}"]),
    "sections": (f'<div class="wrapper"><section class="c7"><div><h1>River</h1></div><div><p>{U}</p></div><div><p>{V}</p></div></section></div>', ["River", U, V]),
    "entities and spaces": (f"<article><p>Fish &amp; chips,\n\t&eacute;t&eacute;&nbsp;long. {U}</p></article>", [f"Fish & chips, été long. {U}"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(name):
    body, want = PAGES[name]
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"
    assert html_extraction.extract_pages([page], html_extraction.trained())[0].split("\n\n") == want


HOSTILE = {
    "unclosed quotes": '<a b="x ',
    "tags without end": "<a b ",
    "nested boxes": "<div>",
    "angles": "<",
    "mixed quotes": "<a b=\"'x ",
    "comments": "<!--",
    "declarations": "<!x ",
    "items": "<li><span>",
    "raw ends": "<script></script ",
    "ends of nothing": "<i></b>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_broken_markup_is_read_in_linear_time(name):
    piece = HOSTILE[name]

    def took(n):
        page = piece * (n // len(piece))
        began = time.process_time()
        dom.parse(page)
        return time.process_time() - began

    small, large = min(took(100_000) for _ in range(3)), took(800_000)
    assert large < 0.2 + 20 * small  # eight times the text; quadratic time would be 64


def test_open_limits_do_not_slow_paragraphs():
    page = "<p><button>" + "<div>" * 50_000 + "x"
    began = time.process_time()
    assert len(dom.parse(page).nodes) == 50_003
    assert time.process_time() - began < 10


def test_quotes_without_an_end_cost_their_tag_alone():
    page = dom.parse('<p>one</p><a href="x <p>two</p>')
    assert [" ".join(t for _, t in b) for b in page.blocks] == ["one", "two"]
    page = dom.parse("<p title='a>b'>three</p><b>it's</b>")
    assert ["".join(t for _, t in b) for b in page.blocks] == ["three", "it's"]


def test_long_and_empty_pages(spark):
    long = "<article>" + f"<p>{U}</p>" * 4000 + "</article>"
    table = spark.createDataFrame([(1, "u", long), (2, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(table).collect()}
    assert got[2] == "" and got[1].split("\n\n") == [U] * 4000
    assert html_extraction.extract_main_text(table.limit(0)).count() == 0
