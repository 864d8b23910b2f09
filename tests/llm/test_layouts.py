"""Layouts in which tags and classes alone would cut the article or keep what isn't it."""

import pytest

from tessellary.llm import html_extract

PARAGRAPHS = [f"Paragraph {k} has the words that an article goes on and on with, as articles do, until it ends." for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(PARAGRAPHS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div id=page><div class=intro><h1>Title</h1><p>lede</p></div><div class=body>{BODY}</div><div class=end><p>closing words.</p></div></div>", f"Title lede {TEXT} closing words."),
        (f"<article>{BODY}</article><div>between</div><article><p>a short one</p></article>", f"{TEXT} a short one"),
        (f"<article>{BODY}</article><aside><article>TEASER</article> SIDEBAR</aside>", TEXT),
        (f"<article>{BODY}<nav><article>CARD</article></nav><p>after</p></article>", f"{TEXT} after"),
        (f"<nav><ul><li><a href=x>Home</a></li></ul><article>{BODY}</article>", TEXT),
        (f"<form action=x><div><h1>Head</h1>{BODY}<label>Name</label><input value=a><button>Go</button></div></form>", f"Head {TEXT}"),
        (f"<form><article><h1>Head</h1>{BODY}</article></form>", f"Head {TEXT}"),
        (f"<article>{BODY}<form><p>Join our list, it is great</p><input></form><p>after</p></article>", f"{TEXT} after"),
        ("<h1>Contact</h1><p>Write to us whenever you like, we answer each letter.</p><form><p>Your name</p></form>", "Contact Write to us whenever you like, we answer each letter."),
        (f"<main><div><a href=a>One</a> <a href=b>Two</a></div><article>{BODY}</article></main>", TEXT),
    ],
)
def test_layouts(page, text):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == text


def test_clusters_decide_where_nothing_is_marked(monkeypatch):
    page = f"<body><div><a href=a>One</a><br><a href=b>Two</a></div><div>{BODY}</div><div>© 2020</div></body>"
    assert html_extract.main_text(page) == TEXT
    monkeypatch.setattr(html_extract, "smoothed", lambda values, sigma: [1.0 / (1 + v) for v in values])
    assert html_extract.main_text(page) != TEXT
