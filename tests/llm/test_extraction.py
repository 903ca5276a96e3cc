"""Text of articles that markup around it must not take away."""

import pytest

from cascadia.llm import extraction

LONG = "A first paragraph of some length, with words. And more of them; it goes on."


@pytest.mark.parametrize("inside, want", [
    ('<p>One. <svg width="1"/></p><p>Two.</p>', ["One.", "Two."]),
    ('<p>One. <math/></p><p>Two.</p>', ["One.", "Two."]),
    ('<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>', ["So x=1 holds."]),
    ('<p>One.</p><script src="a.js"/><p>Two.</p>', ["One.", "Two."]),
    ('<p>One.</p><script src="a.js"/>var x;</script><p>Two.</p>', ["One.", "Two."]),
    ('<p>One.</p><script>var x = "<p>";</script><svg><text>no</text></svg><p>Two.</p>', ["One.", "Two."]),
    ('<p>One.</p><button>Press<p>Two.</p>', ["One.", "Press", "Two."]),
    ('<h2 id="related-work">Related work</h2><p>Two.</p>', ["Related work", "Two."]),
    ('<section id="discussion"><h2>Discussion</h2><p>Two.</p></section>', ["Discussion", "Two."]),
    ('<h2 id="search-algorithms">Search</h2><p class="legal-text">Two.</p>', ["Search", "Two."]),
    ('<div class="form-of-government"><p>Two.</p></div>', ["Two."]),
    ('<p aria-hidden="false">One.</p><p data-role="search" data-id="menu">Two.</p><p title="now hidden ">Three.</p>', ["One.", "Two.", "Three."]),
    ('<ul><li><a href="/a">First source</a></li><li><a href="/b">Second source</a></li></ul>', ["First source", "Second source"]),
    ('<div class="ad">Buy.</div><p hidden>No.</p><div id="comments"><p>Nice.</p></div><p>Two.</p>', ["Two."]),
])
def test_article_text_stays(inside, want):
    page = f"<html><body><nav>Home</nav><div class='related-posts'><p>Other page.</p></div><article><p>{LONG}</p>{inside}</article><footer>us</footer></body></html>"
    assert extraction.main_text(page).split("\n\n") == [LONG, *want]


def test_names_of_wrappers():
    assert extraction.main_text(f"<body><div class='with-sidebar'><div id='legal-text'><p>{LONG}</p><p>End.</p></div></div></body>") == f"{LONG}\n\nEnd."
    assert extraction.main_text(f"<body><p>{LONG}</p><div class='cookie-notice'>We use cookies.</div></body>") == LONG


FIRST, SECOND = "One paragraph of some length, with words. And more of them; it goes on and on.", "Another one, quite as long as that. It has commas, too; and it ends here."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Products</a></li></ul></nav>"


@pytest.mark.parametrize("body", [
    f"{MENU}<article><p>{FIRST}</p></article><article><p>{SECOND}</p></article><footer>us</footer>",
    f"{MENU}<main><article><p>{FIRST}</p></article><article><p>{SECOND}</p></article></main>",
    f"<div class='layout has-sidebar'><article><p>{FIRST}</p><p>{SECOND}</p></article><div class='sidebar'><p>Side text, not it.</p></div></div>",
    f"<div class='post with-comments'><p>{FIRST}</p><p>{SECOND}</p></div>",
    f"<div><a href='/'>Home</a> <a href='/b'>About</a></div><div><p>{FIRST}</p><p>{SECOND}</p></div><div><a href='/x'>Terms</a></div>",
    f"<table><tr><td><a href='/'>Home</a><br><a href='/2'>More</a></td><td><p>{FIRST}</p><p>{SECOND}</p></td></tr></table>",
    f"{MENU}<div><p>{FIRST}</p></div><div><p>{SECOND}</p></div><footer>us</footer>",
    f"<article><p>{FIRST}</p><p>{SECOND}</p></article><section class='comments'><article class='comment'><p>Nice post, I liked it, really. It is good, so good.</p></article></section>",
])
def test_whole_article_of_many_shapes(body):
    assert extraction.main_text(f"<html><body>{body}</body></html>") == f"{FIRST}\n\n{SECOND}"
