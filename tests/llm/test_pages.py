import pytest

from spanledger.llm import pages

LONG = "A first paragraph of the article with quite a few words in it."


@pytest.mark.parametrize("html,want", [
    (f"<article><p>{LONG}</p><script>var code = 1;</script><p>B</p></article>", f"{LONG}\nB"),
    (f"<article><p>{LONG} <button>Share</button></p></article>", LONG),
    (f"<article><p>{LONG} <button>Share</button>It goes on.</p></article>", f"{LONG} It goes on."),
    (f"<article><div>{LONG} <span class=share><ul><li>x</li></ul></span></div></article>", LONG),
    (f"<article><p>{LONG}<style>p {{ color: red }}</style> More.</p></article>", f"{LONG} More."),
    (f"<article>{LONG}<svg><title>icon</title><text>t</text></svg> More.</article>", f"{LONG} More."),
    (f"<article><p>{LONG}</p><noscript>Switch it on</noscript>Tail words.</article>", f"{LONG}\nTail words."),
    (f"<article><div>{LONG} <span class=share>x</div><div>Next</div></article>", f"{LONG}\nNext"),
    (f"<article><p>Spl<button>x</button>it {LONG}</p></article>", f"Split {LONG}"),
])
def test_text_of_noise_elements_stays_out(html, want):
    assert pages.main_text(html) == want


FIRST = "A first paragraph of the article with quite a few words in it, and some more."
SECOND = "Its second paragraph, which is long as well and ends here."
BODY, TEXT = f"<p>{FIRST}</p><p>{SECOND}</p>", f"{FIRST}\n{SECOND}"
REMARK = "A long remark on the social history of the town, which belongs to the article."
COMMENT = "<p>I have read this with joy and I would like to read more of it, dear author.</p>"


@pytest.mark.parametrize("html,want", [
    (f"<main><article>{BODY}</article><section class='comments'><ol class='comment-list'><li class='comment'><article class='comment-body'>{COMMENT}</article></li></ol></section></main>", TEXT),
    (f"<article>{BODY}</article><article class='comment'>{COMMENT}</article>", TEXT),
    (f"<div class='page no-sidebar'><div>{BODY}</div></div>", TEXT),
    (f"<div class='sidebar-left page'><div>{BODY}</div></div>", TEXT),
    (f"<form action=x><div class=nav><a>Home</a> <a>News</a></div><div>{BODY}</div><input name=q></form>", TEXT),
    (f"<article>{BODY}<p class='social history'>{REMARK}</p></article>", f"{TEXT}\n{REMARK}"),
    (f"<article>{BODY}<p class='legal-notes'>{REMARK}</p></article>", f"{TEXT}\n{REMARK}"),
    (f"<article>{BODY}<p class='social'>Share this</p></article>", TEXT),
    (f"<article>{BODY}<form><label>Your mail</label><p>Get the news</p></form></article>", TEXT),
    (f"<article>{BODY}<div class='newsletter'><p>Subscribe to our newsletter, which comes each morning and costs you nothing at all.</p></div></article>", TEXT),
])
def test_names_and_forms_are_one_signal(html, want):
    assert pages.main_text(f"<html><body>{html}</body></html>") == want


def test_paragraphs_are_found_without_the_word_list(monkeypatch):
    monkeypatch.setattr(pages, "NOISE_WORDS", frozenset())
    assert pages.main_text(f"<body><div class=nav><a>Home</a><a>News</a></div><div>{BODY}</div><footer>c</footer></body>") == TEXT
