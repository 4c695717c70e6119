"""Labelled web pages to train the extractor on: composed from parts with a fixed seed.

MARK stands in front of each text block that belongs to the article. Words are made of
random letters, so that only structure, attributes and punctuation can be learnt.
"""

from __future__ import annotations

import random

MARK = ""
PAGES, SEED = 160, 11


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(1, 11))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(1, 18)).capitalize() + r.choice([".", ".", ".", "?", "!", ""]) for _ in range(n))


def _paragraph(r: random.Random, mark: str = MARK) -> str:
    text = _sentences(r, r.choice([1, 1, 2, 4, 8])) if r.random() < 0.85 else " ".join([_words(r, 1)] * r.choice([2, 30, 200]))
    for tag in r.sample(["a href='/x'", "b", "em", "i", "span", "strong", "code"], r.choice([0, 0, 1, 2])):
        cut = text.split(" ")
        k = r.randrange(len(cut))
        cut[k] = f"<{tag}>{cut[k]}</{tag.split()[0]}>"
        text = " ".join(cut)
    return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p class='text'>{}</p>"]).format(mark + text)


def _article(r: random.Random) -> str:
    parts = [_paragraph(r) for _ in range(r.choice([0, 1, 2, 4, 9]))]
    title = MARK + _words(r, r.randint(1, 9))
    extra = [
        f"<ul>{''.join(f'<li>{MARK}{_sentences(r, 1)}</li>' for _ in range(3))}</ul>", f"<h2>{MARK}{_words(r, 3)}</h2>", f"<blockquote>{_paragraph(r)}</blockquote>", f"<pre>{MARK}{_words(r, 9)}</pre>",
        f"<table><tr><td>{MARK}{_words(r, 2)}</td><td>{MARK}{_words(r, 3)}</td></tr></table>", f"<figure><img src='a.png'><figcaption>{MARK}{_words(r, 6)}</figcaption></figure>", f"<ol><li>{MARK}{_words(r, 8)}</li></ol>",
        _ad(r), f"<div class='{r.choice(['share', 'social', 'related', 'newsletter', 'tags'])}'><a href='/s'>{_words(r, 1)}</a> <a href='/t'>{_words(r, 2)}</a></div>", f"<aside>{_sentences(r, 2)}</aside>", _form(r),
    ]
    for x in r.sample(extra, r.choice([0, 0, 1, 2, 3])):
        parts.insert(r.randint(0, len(parts)), x)
    head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2 class='title'>{title}</h2>"])
    if not parts and r.random() < 0.5:
        parts = [f"<p><b>{title}<br>"]
    body = head + "".join(parts)
    return r.choice([
        "<article>{}</article>", "<article>{}</article>", "<article class='post'>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='main'><div class='entry-content'>{}</div></div>",
        "<section class='story'>{}</section>", "<div id='article-body'>{}</div>", "<div class='wrap'><div class='post-body'>{}</div></div>", "<div>{}</div>",
    ]).format(body)


def _links(r: random.Random) -> str:
    return f"<ul>{''.join(f'<li><a href="/{k}">{_words(r, r.randint(1, 2))}{r.choice(["", "", ".", ","])}</a></li>' for k in range(r.randint(3, 8)))}</ul>"


def _nav(r: random.Random) -> str:
    return r.choice(["<nav>{}</nav>", "<nav>{}</nav>", "<div class='menu'>{}</div>", "<div id='navbar'>{}</div>", "<div class='breadcrumb'>{}</div>", "<header><nav>{}</nav></header>"]).format(_links(r))


def _ad(r: random.Random) -> str:
    return f"<div class='{r.choice(['ad', 'ad', 'ads', 'advert', 'promo', 'sponsored', 'banner'])}'>{_sentences(r, r.randint(1, 4))}</div>"


def _form(r: random.Random) -> str:
    return f"<form action='/q'><label>{_words(r, 3)}</label><p>{_sentences(r, 1)}</p><input name='q'><button>{_words(r, 1)}</button></form>"


def _comments(r: random.Random) -> str:
    one = [_paragraph(r, "") for _ in range(r.randint(1, 4))]
    return r.choice([
        f"<section class='comments'><h2>{_words(r, 2)}</h2>{''.join(f'<div class="comment">{p}</div>' for p in one)}</section>", f"<div id='comments'><ul class='commentlist'>{''.join(f'<li>{p}</li>' for p in one)}</ul></div>",
        f"<div class='comments-area'>{''.join(f'<article class="comment">{p}</article>' for p in one)}</div>", f"<div id='respond'>{one[0]}</div>",
    ])


def _footer(r: random.Random) -> str:
    text = f"&copy; {_words(r, 2)} &middot; {_sentences(r, r.randint(1, 4))}"
    return r.choice(["<footer>{}</footer>", "<footer>{}</footer>", "<footer><p>{}</p></footer>", "<div id='footer'><p>{}</p></div>", "<div class='copyright'>{}</div>"]).format(text)


def _page(r: random.Random) -> str:
    before = [f"<header><a href='/'>{_words(r, 2)}</a><p>{_sentences(r, 1)}</p></header>", _nav(r), f"<div class='{r.choice(['cookie-notice', 'notice', 'alert', 'consent'])}'><p>{_sentences(r, 2)}</p></div>", _ad(r)]
    side = r.choice(["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar-right'>{}</div>"]).format(f"<h3>{_words(r, 2)}</h3>{_links(r)}<p>{_sentences(r, 2)}</p>")
    after = [side, _comments(r), _form(r), _ad(r), f"<div class='related'>{_links(r)}</div>"]
    first = before[1:2] + before[3:] if r.random() < 0.3 else [x for x in before if r.random() < 0.6]
    last = [x for x in after if r.random() < 0.35]
    return f"<html><head><title>{_words(r, 4)}</title></head><body>{''.join(first)}{_article(r)}{''.join(last)}{_footer(r) if r.random() < 0.9 else ''}</body></html>"


def pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]
