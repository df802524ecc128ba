"""Pages made of a known article and of junk around and inside it: the article comes out, and nothing else."""

import random

import pytest

from strandway.llm import html

SENTENCES = (
    "The committee met on Tuesday, and after a long debate, it adopted the plan.",
    "Several members, among them the treasurer, asked for more time.",
    "In the end, the vote was clear, and work begins in the spring.",
    "Costs, according to the report, stay within the budget.",
)
COMMENT = "I fully agree with this, even if the details are, to be honest, a bit thin. Another one, with commas, follows. And a third, for good measure."
NAMES = ["comments", "comment-list", "cookie-banner", "newsletter-signup", "reader-comments", "disqus_thread", "discussion", "responses", "sidebar", "related-posts", "userComments"]
BODY = "<h1>Plan adopted</h1>" + "".join(f"<p>{' '.join(SENTENCES)}</p>" for _ in range(3))
WANT = "Plan adopted " + " ".join(" ".join(SENTENCES) for _ in range(3))


def comments(kind, n):
    return {
        "paragraphs": f"<p>{COMMENT}</p>" * n,
        "one": f"<p>{COMMENT * n}</p>",
        "named": f'<div class="comment"><p>{COMMENT}</p></div>' * n,
        "articles": f"<article><p>{COMMENT}</p></article>" * n,
    }[kind]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["paragraphs", "one", "named", "articles"])
def test_comments_of_any_length_stay_out(name, kind):
    article, plain = f"<article>{BODY}</article>", f'<div class="post">{BODY}</div>'
    for n in (1, 2, 4, 10, 20, 60, 200):
        for attr in ("class", "id"):
            own = attr == "id" and name in html.SLUGS  # within an article that may be a section of it
            part = f'<div {attr}="{name}">{comments(kind, n)}</div>'
            pages = [article + part, part + article, plain + part, part + plain, f"<main>{article}{part}</main>", f"<main>{part}{article}</main>"]
            pages += [] if own else [f"<article>{BODY}{part}</article>", f"<main>{plain}{part}</main>"]
            for page in pages:
                assert html.main_text(f"<html><body>{page}</body></html>") == WANT, (n, attr, page[:60])


def test_unnamed_parts_outside_an_article_stay_out():
    for n in (1, 20, 200):
        assert html.main_text(f"<body><article>{BODY}</article><div>{comments('paragraphs', n)}</div></body>") == WANT
        assert html.main_text(f"<body><div>{comments('paragraphs', n)}</div><main>{BODY}</main></body>") == WANT


def test_names_do_not_count_where_nothing_is_left():
    for wrapper in ("sidebar", "login-page", "widget-area", "hidden-comments"):
        assert html.main_text(f'<body><div class="{wrapper}">{BODY}</div><footer>Some words, with commas, at the foot.</footer></body>') == WANT
    assert html.main_text(f'<body class="no-sidebar"><div class="page-with-sidebar"><article>{BODY}</article></div></body>') == WANT
    assert html.main_text(f"<body><nav>{BODY}</nav></body>") == "" and html.main_text("") == ""


def test_a_short_article_beside_a_longer_advert():
    advert = f'<div class="ad">{COMMENT}</div>'
    assert html.main_text(f"<body>{advert}<article><h1>Two words.</h1><p><b>Two words.<br></article></body>") == "Two words. Two words."


def test_an_index_of_links_is_no_article():
    teasers = "".join(f'<article><a href="/{i}">Another story, which is linked from here, number {i}</a></article>' for i in range(6))
    assert html.main_text(f'<body><div class="story">{BODY}</div>{teasers}</body>') == WANT


def test_random_pages():
    """The article in random wrappers, with junk of random names and lengths before, after and inside it."""
    rng = random.Random(11)
    for _ in range(300):
        junk = lambda: "".join(
            rng.choice([f'<div class="{rng.choice(NAMES)}">{comments(rng.choice(["paragraphs", "one", "named"]), rng.randrange(1, 40))}</div>', f"<aside>{COMMENT}</aside>", f"<form><p>{COMMENT}</p></form>", "<script>var x = '<p>';</script>", f'<nav><ul>{"<li><a href=x>Link</a></li>" * 5}</ul></nav>'])
            for _ in range(rng.randrange(0, 3))
        )
        inner = BODY.replace("</p><p>", f"</p>{junk()}<p>", 1) + junk()
        page = f"{junk()}<{(tag := rng.choice(['article', 'main', 'div']))}>{inner}</{tag}>{junk()}"
        for _ in range(rng.randrange(0, 3)):
            page = f'<div class="{rng.choice(["wrap", "page", "container", "layout"])}">{page}</div>'
        assert html.main_text(f"<body>{page}<footer>{COMMENT}</footer></body>") == WANT, page[:200]
