"""Main text of pages in public markup: every article whole, no comment of a reader, no byline, nearly nothing else."""

import public_pages
from siltstone.llm import html_extract


def test_pages_in_public_markup():
    model = html_extract.by_name(html_extract.trained())
    want = [public_pages.TITLE, *public_pages.TEXTS]
    others = 0
    for name, page in public_pages.PAGES.items():
        got = html_extract.main_text(page, model).split("\n")
        assert [x for x in got if x in want] == want, name
        assert not any(said in x for x in got for said in public_pages.SAID) and not any("Ann Li" in x for x in got), name
        others += len(got) - len(want)
    assert others <= 1  # of 100 blocks and more that aren't the article's
