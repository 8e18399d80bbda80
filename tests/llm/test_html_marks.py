import pytest
from lonetext.llm import html_text as ht

TREE = ht.trained()
BODY = "<article><h1>Head</h1><p>First part.</p></article>"
PAGES = {
    f'<div style="overflow:hidden">{BODY}</div>': "Head\nFirst part.",
    '<article><p title="hidden gems">Of the town.</p><p data-id=ad>Kept.</p></article>': "Of the town.\nKept.",
    "<article><p title='a class=ad b'>Quoted.</p></article>": "Quoted.",
    '<article><div class="content has-sidebar"><p>Kept.</p></div></article>': "Kept.",
    f'<div id="post-with-comments">{BODY}</div>': "Head\nFirst part.",
    '<article class="post no-comments"><p>Kept.</p></article>': "Kept.",
    f'<form id=aspnet>{BODY}</form>': "Head\nFirst part.",
    f'<div class="sidebar"><p>Some words here</p>{BODY}<p>Other words here</p></div>': "Head\nFirst part.",
    f'<div hidden>{BODY}</div>': "",
    f'{BODY}<div aria-hidden="true"><main><p>Not shown</p></main></div>': "Head\nFirst part.",
    f'{BODY}<aside><article>Read this too</article></aside>': "Head\nFirst part.",
    f'{BODY}<div id=comments><article class="comment-body">Great!</article></div>': "Head\nFirst part.",
    '<article><p>Text.</p><div class="site-footer">(c) we</div><div id="ad-3">Buy</div></article>': "Text.",
    "<article><p>Sum <math>x+y</math></p></article>": "Sum x+y",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_marks(page):
    assert ht.main_text(page, TREE) == PAGES[page]
