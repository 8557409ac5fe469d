"""Labelled pages for training the extractor: layouts written here, filled with
invented words by a seeded generator. ``data-y`` marks where the main text begins (1)
and what inside it is none (0); it holds for all below."""

from __future__ import annotations

import random

_SYLLABLES = "an be cor de el fa gor hi in jo ka lu men no or pe qui ra so ta un ver wi xe yo za".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high))).capitalize() + r.choice("....!?")


def _text(r: random.Random) -> str:
    if r.random() < 0.25:
        return _sentence(r, 1, 4)
    return " ".join(_sentence(r) for _ in range(r.randint(1, 9)))


def _paragraphs(r: random.Random) -> str:
    out = []
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.75:
            out.append(f"<p>{_text(r)}</p>")
        elif kind < 0.85:
            out.append(f"<h2>{_sentence(r, 1, 6)}</h2>")
        elif kind < 0.92:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, 2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.96:
            out.append(f"<blockquote><p>{_text(r)}</p></blockquote>")
        else:
            out.append(f"<p>{_text(r)} <a href=x>{_word(r)} {_word(r)}</a> {_text(r)}</p>")
    return "".join(out)


def _links(r: random.Random) -> str:
    if r.random() < 0.3:
        return " | ".join(f"<a href=/{k}>{_word(r)}</a>" for k in range(r.randint(2, 8)))
    return "<ul>" + "".join(f"<li><a href=/{k}>{_word(r)}</a></li>" for k in range(r.randint(2, 9))) + "</ul>"


def _around(r: random.Random, content: str) -> str:
    """A page's other parts before and after its content."""
    before = {
        "nav": f"<nav>{_links(r)}</nav>",
        "menu": f"<div class='{r.choice(['menu', 'nav-bar', 'top-menu', 'breadcrumbs', 'navigation'])}'>{_links(r)}</div>",
        "header": f"<header><h1>{_word(r)}</h1><p>{_sentence(r, 2, 8)}</p></header>",
        "masthead": f"<div id='{r.choice(['header', 'masthead', 'site-header', 'logo'])}'><p>{_sentence(r, 1, 6)}</p></div>",
        "ad": f"<div class='{r.choice(['ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-slot'])}'>{r.choice([_text(r), '<p>' + _text(r) + '</p>'])}</div>",
        "notice": f"<div class='{r.choice(['cookie-notice', 'notice', 'consent', 'alert', 'popup', 'warning'])}'><p>{_text(r)}</p><button>{_word(r)}</button></div>",
        "search": f"<form action=/s><label>{_word(r)}</label><input><p>{_sentence(r, 2, 8)}</p></form>",
    }
    after = {
        "aside": f"<aside><h3>{_sentence(r, 1, 3)}</h3><p>{_text(r)}</p>{_links(r)}</aside>",
        "sidebar": f"<div class='{r.choice(['sidebar', 'widget', 'related', 'recommended', 'side-column'])}'><h3>{_word(r)}</h3><p>{_text(r)}</p>{_links(r)}</div>",
        "comments": f"<{r.choice(['section', 'div'])} {r.choice(['id', 'class'])}='{r.choice(['comments', 'comment-list', 'discussion', 'replies', 'reader-comments'])}'><h3>{_word(r)}</h3>" + "".join(f"<div class=comment><p>{_text(r)}</p></div>" for _ in range(r.randint(1, 4))) + r.choice(["</section>", "</div>"]),
        "footer": f"<footer>{r.choice(['&copy; ' + _sentence(r), '<p>' + _text(r) + '</p>'])}{r.choice(['', _links(r)])}</footer>",
        "foot": f"<div id='{r.choice(['footer', 'copyright', 'site-footer', 'legal'])}'><p>{_sentence(r)}</p></div>",
        "share": f"<div class='{r.choice(['share', 'social', 'newsletter', 'subscribe'])}'><p>{_sentence(r, 2, 10)}</p></div>",
        "ad": before["ad"],
    }
    first = [v for v in before.values() if r.random() < 0.35]
    last = [v for v in after.values() if r.random() < 0.4]
    r.shuffle(first)
    if r.random() < 0.2:
        first.append(last.pop() if last else "")
    body = "".join([*first, content, *last])
    if r.random() < 0.3:
        body = f"<div class='{r.choice(['page', 'wrapper', 'container', 'layout'])}'>{body}</div>"
    return f"<html><head><title>{_sentence(r, 2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def _content(r: random.Random) -> str:
    inner = f"<h1>{_sentence(r, 2, 9)}</h1>" * (r.random() < 0.7) + _paragraphs(r)
    for _ in range(r.choice([0, 0, 1, 2])):
        cue = r.choice(["ad", "ad", "share", "related", "newsletter", "promo", "comments", "author-notice", "sidebar", "cookie-consent", "menu", "search-form"])
        piece = r.choice([_word(r), _sentence(r), f"<p>{_text(r)}</p>", f"<p>{_text(r)}</p>"])
        inner += f"<div class={cue} data-y=0>{piece}</div>" + f"<p>{_text(r)}</p>" * (r.random() < 0.5)
    if r.random() < 0.1:
        inner += f"<{r.choice(['aside', 'nav', 'form'])} data-y=0><p>{_text(r)}</p>"
        inner += "</" + inner.rsplit(" data-y=0>", 1)[0].rsplit("<", 1)[1] + ">"
    if r.random() < 0.25:
        inner += f"<footer data-y=0>{_sentence(r)}</footer>"
    kind = r.random()
    if kind < 0.4:
        return f"<article data-y=1>{inner}</article>"
    if kind < 0.5:
        return f"<main data-y=1>{inner}</main>"
    if kind < 0.6:
        return f"<main data-y=1><article>{inner}</article></main>"
    if kind < 0.85:
        name = r.choice(["content", "post", "entry-content", "article-body", "story", "main", "text", "post-body"])
        return f"<div {r.choice(['class', 'id'])}='{name}' data-y=1>{inner}</div>"
    if kind < 0.92:
        return f"<div data-y=1>{inner}</div>"
    return f"<table><tr><td data-y=1>{inner}</td></tr></table>"


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [_around(r, _content(r)) for _ in range(n)]
