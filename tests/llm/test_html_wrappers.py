"""Articles inside wrappers with junk words, forms, and raw tags without an end."""

from __future__ import annotations

import pytest

from procura.llm.html_text import extract

TEXT = "words of the article go on and on here."


@pytest.mark.parametrize("page", [
    f"<body><div class='page has-sidebar'><p>{TEXT}</p></div></body>", f"<body><div class='content-with-share'><p>{TEXT}</p></div></body>",
    f"<body><div class='elementor-widget'><div><p>{TEXT}</p></div></div></body>", f"<body><div class='no-comments'><p>{TEXT}</p></div></body>",
    f"<body><form action='/x.aspx'><nav>menu</nav><div class='text'><p>{TEXT}</p></div></form></body>", f"<body><div class='widget'><article><p>{TEXT}</p></article></div><p><a href='/'>more</a></p></body>",
    f"<body><div title='The hidden truth'><p>{TEXT}</p></div></body>", f"<body><div class='layout has-sidebar'><p>{TEXT}</p></div></body>", f"<body><article><div class='related-work'><p>{TEXT}</p></div></article></body>",
    f"<body><p>{TEXT[:20]}<span class='advert'>BUY <b>NOW</b> <span>!</span></span>{TEXT[20:]}</p></body>".replace("of<", "of <"), f"<body><p><svg><svg><text>a</text></svg><text>b</text></svg>{TEXT}</p></body>", f"<body><p><math>words</math>{TEXT[5:]}</p></body>",
    f"<body><p hidden>no</p><p style='display: none'>no</p><p>{TEXT}</p></body>", f"<body><p><span class='share'>{TEXT}</p></body>",
    f"<body><svg/><p>{TEXT}</p></body>", f"<body><iframe src='x'/><p>{TEXT}</p><iframe></iframe></body>", f"<body><noscript><p>{TEXT}</p></body>", f"<body><video><p>{TEXT}</p><video>no</video></body>",
])
def test_article_is_kept(page):
    assert extract(page, None).replace("  ", " ") == TEXT


def test_junk_stays_junk():
    comments = "".join(f"<article class='comment-body'><p>said {i} at length</p></article>" for i in range(9))
    assert extract(f"<body><div><p>{TEXT}</p></div><div id='comments'>{comments}</div><form><p>sign up</p></form><script>x = 1</script></body>", None) == TEXT
    cards = "".join(f"<article><p>card {i}</p></article>" for i in range(9))
    assert extract(f"<body><div><p>{TEXT}</p></div><div class='related'>{cards}</div></body>", None) == TEXT
