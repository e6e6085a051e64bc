"""Pages with known main text, and what each step of the method is there for."""

import time

import pytest

from contactloom.llm import html

PROSE = "This is a sentence of the story that goes on for some time and has few tags in it, as prose does. "
MENU = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12))
#: no element or class name tells what is content here
BARE = f"<html><body><div><ul>{MENU}</ul></div><div><h2>A title</h2><p>{PROSE * 2}</p><p>{PROSE}<b>bold</b> end.</p><ul><li>one thing</li></ul><p>{PROSE * 2}</p></div><div><a>About</a> <a>Terms</a></div></body></html>"
WANT = "\n\n".join(["A title", (PROSE * 2).strip(), PROSE + "bold end.", "one thing", (PROSE * 2).strip()])


def test_ratios_find_the_region_without_names():
    assert html.main_text(BARE) == WANT


def test_threshold_decides(monkeypatch):
    monkeypatch.setattr(html, "_threshold", min)
    assert html.main_text(BARE) != WANT


def test_smoothing_decides(monkeypatch):
    lone = f"<div><a>x</a></div><div>{(PROSE * 2)[:150]}</div><div><a>y</a></div>" + f"<div><ul>{MENU}</ul></div>"
    page = f"<body><div><a>w</a></div><div><ul>{MENU}</ul></div>{lone}<div><p>{PROSE * 3}</p><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div><div><ul>{MENU}</ul></div></body>"
    want = "\n\n".join([(PROSE * 3).strip()] * 3)
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "_smoothed", lambda x: x)
    assert html.main_text(page) != want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><header><h1>Site</h1></header><nav>{MENU}</nav><main><article><header><h1>Head</h1></header><p>{PROSE}</p><form>mail <input></form><div class='ad-box ad'>Buy</div>"
         f"<section class=comments><p>{PROSE}</p></section></article></main><aside>{PROSE}</aside><footer>c</footer></body>", "Head\n\n" + PROSE.strip()),
        (f"<p>{PROSE}<p>Second &lt;b&gt; &#233;&nbsp;x<br>y<script>var a = '<p>no</p>';</script>", PROSE.strip() + "\n\nSecond <b> é x y"),
        (f"<div id=cookie-notice class=cookies>{PROSE}</div><article><p>a</p><table><tr><td>1<td>2</table></article>", "a\n\n1\n\n2"),
    ],
)
def test_gold_pages(page, want):
    assert html.main_text(page) == want


def test_deep_and_long_pages_take_time_in_proportion():
    start = time.time()
    assert html.main_text("<div>" * 20_000 + "deep " * 30) == ("deep " * 30).strip()
    assert html.main_text("<div>" * 2_000 + "<p>x y" * 20_000).count("x y") == 20_000
    assert len(html.main_text(f"<article><p>{PROSE * 20_000}</article>")) == len(PROSE) * 20_000 - 1
    assert time.time() - start < 10


def test_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None), (2, "v", "", 1)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract(d).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html.extract(d.limit(0)).count() == 0
