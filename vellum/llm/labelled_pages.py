"""Labelled pages that the weights of :mod:`html_extract` are learned from, built by a rule: invented words in common page skeletons.

What lies between MAIN and END of a page is its main text, except for the parts of other kinds in it.
"""

from __future__ import annotations

from itertools import cycle, islice

MAIN, END = "<!--main-->", "<!--/main-->"
#: How page parts that are no main text are spelled: tag, and attribute with its value.
PARTS = {
    "menu": ["nav", "div class=menu", "ul id=nav", "div class=navbar", "div role=navigation", "div class=navigation", "div class=breadcrumb", "ol class=breadcrumbs", "div class=pagination", "div class=pager", "a class=skip"],
    "header": ["header", "div id=header", "div class=masthead", "div class=topbar", "div role=banner", "div id=logo", "div class=tagline"],
    "footer": ["footer", "div id=footer", "div role=contentinfo", "div class=copyright", "div class=colophon", "div class=legal"],
    "sidebar": ["aside", "div class=sidebar", "div id=rail", "div class=widget", "div role=complementary", "section class=related", "div class=recommended", "div class=recommendations", "div class=trending", "div class=popular", "div class=teaser", "div class=teasers"],
    "advert": ["div class=ad", "div class=ads", "div class=advert", "section class=advertisement", "div class=advertising", "div class=sponsored", "div class=sponsor", "div class=promo", "div class=promotion", "div class=banner", "ins class=adsbygoogle", "div class=adslot"],
    "notice": ["div class=cookie", "div id=cookies", "div class=consent", "div class=gdpr", "div class=notice", "div class=notification", "div class=alert", "div role=alert", "div role=dialog", "div class=modal", "div class=popup", "div class=overlay", "div class=paywall", "div class=disclaimer", "dialog", "div hidden"],
    "form": ["form", "fieldset", "div class=newsletter", "div class=subscribe", "div class=subscription", "div class=signup", "div role=search", "div class=search", "div class=login"],
    "comments": ["section id=comments", "div class=comment", "ol class=commentlist", "div id=disqus", "div class=replies", "div class=reply", "div class=respond", "div class=responses", "div class=discussion"],
    "share": ["div class=share", "ul class=social", "div class=sharing", "div class=toolbar"],
}
#: How the element is spelled that holds the whole main text, after "|" a narrower one in it; none: the page has no such element.
HOLDERS = ["article", "main", "div role=main", "div id=content", "div class=post", "div class=entry", "div itemprop=articleBody", "section class=story", "div id=main", "div class=article", "article class=post", "main|article", "div id=content|article", None, None, None]


def _words(n: int, seed: int) -> str:
    return " ".join("aeiou"[(seed + i) % 5] + "lmnrst"[(seed * 7 + i * i) % 6] + "aeiou"[(seed + i * 3) % 5] for i in range(n))


def _opened(spelling: str) -> str:
    tag, _, said = spelling.partition(" ")
    name, _, value = said.partition("=")
    return f"<{tag}>" if not said else f'<{tag} {name}="{value}">' if value else f"<{tag} {name}>"


def _part(kind: str, spelling: str, seed: int) -> str:
    links = "".join(f'<li><a href="/{i}">{_words(2, seed + i)}</a></li>' for i in range(6))
    inner = {
        "menu": f"<ul>{links}</ul>", "header": f'<h1><a href="/">{_words(3, seed)}</a></h1><p>{_words(5, seed)}</p><span>{_words(6, seed)}</span>', "footer": f'<p>{_words(8, seed)}</p><div>{_words(6, seed + 2)} <a href="/">{_words(2, seed + 1)}</a></div>',
        "sidebar": f"<h3>{_words(3, seed)}</h3><ul>{links}</ul><div>{_words(9, seed)}</div>", "advert": f"{_words(12, seed)} <a href='/'>{_words(3, seed)}</a>", "notice": f"<p>{_words(14, seed)}</p><button>{_words(1, seed)}</button>",
        "form": f"<label>{_words(3, seed)}</label><input><span>{_words(7, seed)}</span>", "comments": f"<h3>{_words(2, seed)}</h3><div><b>{_words(1, seed)}</b><p>{_words(15, seed)}</p></div>", "share": f"<span>{_words(1, seed)}</span>" + links,
    }[kind]
    tag = spelling.split(" ")[0]
    return f"{_opened(spelling)}{inner}</{tag}>"


def _main(seed: int, inside: list[str]) -> str:
    """An article with every usual kind of block; parts of other kinds stand in the middle."""
    rich = f"<ul><li>{_words(12, seed)}</li><li>{_words(9, seed)} <a href='/x'>{_words(2, seed)}</a></li></ul><ol><li>{_words(7, seed)}</li></ol><blockquote><p>{_words(15, seed)}</p></blockquote><section><div>{_words(18, seed)}</div></section><table><tr><th>{_words(2, seed)}</th><td>{_words(3, seed)}</td></tr></table><figure><figcaption>{_words(8, seed)}</figcaption></figure><pre>{_words(9, seed)}</pre><h3>{_words(4, seed)}</h3><h4>{_words(3, seed)}</h4><blockquote>{_words(14, seed)}</blockquote><div>{_words(24, seed)} <ins>{_words(1, seed)}</ins> <code>{_words(1, seed)}</code></div><dl><dt>{_words(2, seed)}</dt><dd>{_words(8, seed)}</dd></dl>"
    head = f"<h1>{_words(6, seed)}</h1>" if seed % 2 else f"<header><h1>{_words(6, seed)}</h1><span>{_words(3, seed)}</span></header>"
    return head + "".join(f"<p>{_words(30 + seed % 17, seed + k)} <a href='/y'>{_words(2, seed + k)}</a> <b>{_words(2, seed)}</b> <em>{_words(1, seed)}</em> {_words(20, seed)}</p>" for k in range(4)) + "".join(inside) + f"<h2>{_words(4, seed)}</h2>" + rich + f"<p>{_words(25, seed + 9)}</p>"


def labelled_pages(n: int = 96) -> list[str]:
    """``n`` pages: every spelling of a part comes up outside the main text, most of those that can stand in it also there."""
    turns = {kind: cycle(spelled) for kind, spelled in PARTS.items()}
    pages = []
    for i, holder in enumerate(islice(cycle(HOLDERS), n)):
        part = lambda kind, i=i: _part(kind, next(turns[kind]), i)
        inside = [part(k) for k in (("advert", "share"), ("sidebar", "form"), ("notice", "menu"), ("footer", "comments"))[i % 4]] if holder else []
        around = holder.split("|") if holder else ["div"] * (i % 3 > 0)
        # without any, text stands in the page itself
        start, end = "".join(map(_opened, around)), "".join(f"</{x.split(' ')[0]}>" for x in around[::-1])
        before, after = [part("notice"), part("header"), part("menu"), part("advert")], [part("share"), part("comments"), part("sidebar"), part("form"), part("footer")]
        loose = f"<div>{_words(4, i)} <a href='/z'>{_words(3, i)}</a></div><span>{_words(3, i)}</span><ul>" + f"<li><a href='/z'>{_words(2, i)}</a></li>" * 7 + "</ul>"
        if len(around) > 1:  # what stands in the wide holder beside the narrow one
            start, end = start.replace(_opened(around[1]), loose + _opened(around[1])), end.replace("</article>", "</article>" + loose)
        pages.append("<body>" + "".join(before) + loose + start + MAIN + (_main(i, inside) if around else f"{_words(90, i)}<br>{_words(60, i)}" + _main(i, [])) + END + end + loose + "".join(after) + "</body>")
    return pages
