"""Hand-marked pages of layouts that the generator of training pages does not make: what is main, block by block."""

import pytest

from chronolake.llm import htmltext

P1, P2, P3 = "The harbour was quiet that morning, and the boats lay still.", "Nobody had seen the captain since Tuesday.", "In the end, the letter arrived by post; it was short."
NAV = "<nav><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a></nav>"
MENU = '<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">Archive</a></li><li><a href="/c">Contact</a></li></ul>'
FOOT = "<footer><p>&copy; 2024 Example Press. All rights reserved.</p></footer>"
ADS = '<div class="advert">Buy two lamps, get one free!</div>'
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One more</a></li><li><a href=/2>Another</a></li></ul></aside>'
SAID = '<div class="comments"><h3>2 comments</h3><div class="comment"><b>ann</b><p>Great piece, thanks for it.</p></div><div class="comment"><b>bob</b><p>I do not agree at all.</p></div></div>'
COOKIE = '<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>'
LAYOUTS = {
    "title, paragraphs, list": ("<article><h1>Title here</h1><p>" + P1 + "</p><p>" + P2 + "</p><ul><li>First item</li><li>Second item</li></ul></article>", ["Title here", P1, P2, "First item", "Second item"]),
    "code": ("<article><h1>How to</h1><p>" + P1 + "</p><pre>x = f(1)\ny = g(x)</pre><p>" + P2 + "</p></article>", ["How to", P1, "x = f(1) y = g(x)", P2]),
    "references": ("<article><h1>T &#x4e2d; &hellip;</h1><p>" + P1 + "</p></article>", ["T 中 …", P1]),
    "one link": ("<article><h1>Links</h1><p>" + P1 + '</p><p><a href="/x">Read the whole report here</a></p><p>' + P2 + "</p></article>", ["Links", P1, "Read the whole report here", P2]),
    "two in the body": ("<html><body><p>" + P1 + "</p><p>" + P2 + "</p></body></html>", [P1, P2]),
    "nav and footer around": (f"<html><body>{NAV}<article><h1>Title here</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body></html>", ["Title here", P1, P2]),
    "main with headings": (f"<body>{NAV}<main><h1>Guide</h1><h2>Start</h2><p>{P1}</p><h2>End</h2><p>{P2}</p></main>{FOOT}</body>", ["Guide", "Start", P1, "End", P2]),
    "definitions": (f"<article><h1>Terms</h1><dl><dt>Boat</dt><dd>A small ship.</dd><dt>Port</dt><dd>A place for boats.</dd></dl><p>{P1}</p></article>", ["Terms", "Boat", "A small ship.", "Port", "A place for boats.", P1]),
    "table": (f"<article><h1>Prices</h1><p>{P1}</p><table><tr><th>Item</th><th>Price</th></tr><tr><td>Lamp</td><td>12</td></tr></table></article>", ["Prices", P1, "Item", "Price", "Lamp", "12"]),
    "quotation": (f"<article><h1>Said</h1><p>{P1}</p><blockquote><p>{P3}</p></blockquote><p>{P2}</p></article>", ["Said", P1, P3, P2]),
    "sidebar and comments": (f"<body>{MENU}<div class='post'><h1>Post</h1><p>{P1}</p><p>{P3}</p></div>{SIDE}{SAID}{FOOT}</body>", ["Post", P1, P3]),
    "advert inside": (f"<article><h1>Story</h1><p>{P1}</p>{ADS}<p>{P2}</p><p>{P3}</p></article>", ["Story", P1, P2, P3]),
    "cookie notice": (f"<body>{COOKIE}<div id='content'><h1>News</h1><p>{P1}</p><p>{P2}</p></div>{FOOT}</body>", ["News", P1, P2]),
    "long steps": ("<article><h1>Steps</h1><ol>" + "".join(f"<li>Step number {k}: turn the wheel.</li>" for k in range(8)) + "</ol></article>", ["Steps", *(f"Step number {k}: turn the wheel." for k in range(8))]),
    "nested divs": (f"<body><div><div>{MENU}</div><div><div><h1>Deep</h1><div><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div></div></div>{FOOT}</body>", ["Deep", P1, P2, P3]),
    "one paragraph": (f"<article><p>{P1}</p></article>", [P1]),
    "no wrapper, nav": (f"<body>{NAV}<h1>Bare</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>{FOOT}</body>", ["Bare", P1, P2, P3]),
    "caption": (f"<article><h1>Photo</h1><figure><img src=a.png><figcaption>The harbour at dawn.</figcaption></figure><p>{P1}</p><p>{P2}</p></article>", ["Photo", "The harbour at dawn.", P1, P2]),
    "many short paragraphs": ("<article><h1>Talk</h1>" + "".join(f"<p>Line {k} of it.</p>" for k in range(12)) + f"</article>{SAID}", ["Talk", *(f"Line {k} of it." for k in range(12))]),
    "comments in the article": (f"<article><h1>Report</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>{SAID}</article>", ["Report", P1, P2, P3]),
    "form and script": (f"<body><form class='search'><label>Search</label><input><button>Go</button></form><script>var a = '<p>no</p>';</script><article><h2>Part</h2><p>{P1}</p><p>{P2}</p></article></body>", ["Part", P1, P2]),
    "section with list between": (f"<section><h2>Needs</h2><p>{P1}</p><ul><li>Rope</li><li>Oil</li><li>Bread</li></ul><p>{P2}</p></section>", ["Needs", P1, "Rope", "Oil", "Bread", P2]),
}


@pytest.fixture(scope="module")
def model():
    return htmltext.trained()


#: What the trees get wrong: the first of two paragraphs with nothing around them, and an advert of a line in a short article.
WRONG = {"two in the body", "advert inside"}


@pytest.mark.parametrize("name", [pytest.param(n, marks=pytest.mark.xfail) if n in WRONG else n for n in LAYOUTS])
def test_layout(model, name):
    source, want = LAYOUTS[name]
    assert htmltext.main_texts(model, [source])[0].split("\n\n") == want
