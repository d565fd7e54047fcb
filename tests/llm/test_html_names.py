import pytest

from tidewright.llm.html_text import main_text

PROSE = "The boats went out before it was light and came back with all that the nets could hold, and the whole town stood on the quay to see them."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article class='post category-news tag-politics'><p>{PROSE}</p><p>Fin</p></article>", f"{PROSE}\nFin"),
        (f"<div class='content has-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='no-comments social-science'><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<div class='widget'><article id=search><p>{PROSE}</p></article></div>", PROSE),
        (f"<form><article><p>{PROSE}</p></article></form>", PROSE),
        (f"<div class='sidebar'><main class='legal'><p>{PROSE}</p></main></div>", PROSE),
        (f"<main><p>{PROSE}</p><ol class='comment-list'><li><article><p>{PROSE} So I say.</p></article></ol></main>", PROSE),
        (f"<p>{PROSE}</p><div class='site-footer'><p>{PROSE} x</p></div><div id='relatedPosts'><p>{PROSE} y</p></div>", PROSE),
    ],
)
def test_names_mark_surroundings_only(page, text):
    assert main_text(page) == text
