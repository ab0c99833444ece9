"""Names of classes that look like marks, around and inside articles of known text."""

import random

import pytest
from scholar_spark.llm.html import main_text

AROUND = ["widget-content widget", "page banner-on", "sidebar-right-layout", "social-network", "newsletter", "menu-open page"]
INSIDE = ["social-science", "market-share", "popular-mechanics", "cookie-recipe", "search-history", "legal-history", "disclaimer-history"]
PARTS = ["social-share", "share-buttons", "comment-list", "cookie-notice", "ad-slot-1", "related-posts", "newsletter-signup", "popular-posts", "ad-banner-top", "sidebar", "promo-holiday", "related-xyz"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


@pytest.mark.parametrize("seed", range(12))
def test_articles_come_out_whole(seed):
    rng = random.Random(seed)
    title, blocks = sentence(rng, 4), [sentence(rng, rng.randint(12, 60)) for _ in range(rng.randint(4, 9))]
    menu = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
    tail = "<div class='comments'><p>" + sentence(rng, 8) + "</p></div><footer>" + sentence(rng, 5) + "</footer>"
    for name in AROUND:
        body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
        assert main_text(f"<body>{menu}<div class='{name}'>{body}</div>{tail}</body>") == "\n".join([title, *blocks]), name
    inside = [rng.choice(INSIDE) if rng.random() < 0.5 else "" for _ in blocks]
    tags = [rng.choice(["p", "div"]) for _ in blocks]
    body = "".join(f"<{t} class='{n}'>{b}</{t}>" + (f"<div class='{rng.choice(PARTS)}'><a href=z>Read</a> {sentence(rng, 1)}</div>" if rng.random() < 0.3 else "") for t, n, b in zip(tags, inside, blocks))
    assert main_text(f"<body>{menu}<article><h1>{title}</h1>{body}</article>{tail}</body>") == "\n".join([title, *blocks])


@pytest.mark.parametrize("name", PARTS)
def test_parts_go(name):
    rng = random.Random(1)
    blocks = [sentence(rng, 30) for _ in range(4)]
    page = "<body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + f"<div class='{name}'><a href=x>Buy it now</a> and more</div></article></body>"
    assert main_text(page) == "\n".join(blocks)
