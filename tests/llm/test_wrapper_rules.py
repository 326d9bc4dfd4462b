"""What wrappers decide: names of classes, many kinds of children, shared paragraphs, and the order of pages."""

from __future__ import annotations

import json
import random

import pytest

from longleaf.llm import wrapper


def whole(pages: list[str]) -> list:
    out = None
    for p in pages:
        w = wrapper.fold(wrapper.parse(p))
        out = w if out is None else wrapper.merge(out, w)
    return out


def extracted(pages: list[str]) -> list[str]:
    where = wrapper.known(json.dumps(wrapper.article(whole(pages))))
    return [wrapper.extract_page(p, where) for p in pages]


def words(kind: str, i: int, n: int = 30) -> str:
    return " ".join(f"{kind}{i}x{j}" for j in range(n))


@pytest.mark.parametrize("name", ["share-price", "related-work", "social-policy", "notice-period", "comment-on-law", "menu-engineering", "cookie-recipe", "banner-year", "ad-hoc", "side-effects"])
@pytest.mark.parametrize("tag", ["p", "section", "div"])
def test_a_word_of_a_class_is_no_sign(name, tag):
    page = f'<article><h1>T</h1><p>body one two</p><{tag} class="{name}">kept</{tag}></article>'
    assert wrapper.extract_page(page, None) == "T\n\nbody one two\n\nkept"


@pytest.mark.parametrize("name", ["share", "share-buttons", "js-share", "social_links", "related-posts", "article__share", "ad", "ad-slot-3", "adverts", "cookie-notice", "newsletter-signup box", "comments", "comment-list", "main-menu", "promo1"])
def test_a_class_of_such_words_alone_is(name):
    assert wrapper.extract_page(f'<article><h1>T</h1><p>body one two</p><div class="{name}"><p>gone</p></div></article>', None) == "T\n\nbody one two"


@pytest.mark.parametrize("kinds", [10, 300, 1500])
def test_other_kinds_of_children_hide_no_template_text(kinds):
    many = lambda i: "".join(f'<p class="k{chr(97 + i)}{chr(97 + j // 676)}{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}">u{i} {j}</p>' for j in range(kinds))
    pages = [f'<div class="x"><h1>Title {i}</h1><p>{words("s", i)}</p>{"<p class=line>Join us now</p>" if i % 2 == 0 else ""}{many(i)}</div>' for i in range(8)]
    assert extracted(pages) == ["\n\n".join([f"Title {i}", words("s", i), *(f"u{i} {j}" for j in range(kinds))]) for i in range(8)]


@pytest.mark.parametrize("n", [3, 7])
def test_a_paragraph_that_a_few_pages_share_stays(n):
    pages = [f'<div class="s"><h1>Title {i}</h1><p>{words("a", i)}</p><p>A paragraph of the series.</p><p>{words("b", i)}</p></div>' for i in range(n)]
    assert all("A paragraph of the series." in t for t in extracted(pages))


def test_marks_that_are_wrong_or_missing():
    """Twelve hosts whose pages mark nothing, a box of links, or the terms as their content: the text is the story's blocks, which no page alone tells."""
    alone = 0
    for h in range(12):
        kind = h % 3
        top, end = (("<div>", "</div>"), ('<div class="content">', "</div>"), ("<div>", "</div>"))[kind]
        terms = f'<div class="{"main-content" if kind == 2 else "z"}"><p>Terms of host {h} {words("t", h, 60)}</p><p>All of it is free.</p></div>'
        rng = random.Random(h)
        stories = [[f"Title {h} {i}", *(words(f"s{h}p{k}n", i, rng.randint(30, 60)) for k in range(rng.randint(2, 5)))] for i in range(10)]
        pages = [f'<html><body>{top}<a href="/">Home</a> <a href="/n">News</a> <a href="/w">World</a>{end}<div class="q{h}"><h1>{s[0]}</h1>{"".join(f"<p>{b}</p>" for b in s[1:])}</div>{terms}</body></html>' for s in stories]
        want = ["\n\n".join(s) for s in stories]
        assert extracted(pages) == want, (h, kind)
        alone += sum(wrapper.extract_page(p, None) != t for p, t in zip(pages, want, strict=True))
    assert alone >= 60  # of 120


def test_neither_order_nor_tasks_change_a_wrapper(spark):
    rng = random.Random(2)
    part = lambda i: rng.choice([f"<p>t{i} {rng.random()}</p>", f"<div class='d{rng.randint(0, 3)}'><p>x{i}</p><ul>{'<li>l</li>' * rng.randint(0, 3)}</ul></div>", "<h2>Same</h2>", "<hr>text", f"<section><p>{rng.random()}</p></section>"])
    pages = [f"<body><main>{''.join(part(i) for _ in range(rng.randint(0, 9)))}</main><p>End</p></body>" for i in range(40)]
    want = wrapper.dumps(whole(pages))
    for _ in range(10):
        rng.shuffle(pages)
        cuts = sorted(rng.sample(range(1, 40), 3))
        groups = [whole(pages[a:b]) for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        rng.shuffle(groups)
        out = groups[0]
        for g in groups[1:]:
            out = wrapper.merge(out, g)
        assert wrapper.dumps(out) == want == wrapper.dumps(wrapper.loads(want))
    rows = [(i, "http://h.org/", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["wrapper"] for n in (1, 3, 7) for r in wrapper.wrappers(df.repartition(n)).collect()} == {want}
