"""Labelled web pages, made by rule: the content of each stands between ⟦ and ⟧ (often in several parts)."""

from __future__ import annotations

import random

_PARTS = "an be co du el fa gri ho in jo ka lu mer no ob pra qui ra sto tu un ver wo xi yar zen ing tion ly ed".split()
#: Class and id names of what isn't content, and names that look like them but stand on content.
_NAV = ["nav", "menu", "main-menu", "site-nav", "navbar", "breadcrumbs", "pagination", "toolbar"]
_HEAD = ["header", "masthead", "topbar", "site-header", "page-header"]
_SIDE = ["sidebar", "side-bar", "widget-area", "sidebar-right", "widgets"]
_NOTE = ["cookie-notice", "consent-banner", "alert", "notice", "gdpr-popup", "newsletter-signup", "paywall"]
_AD = ["ad", "ads", "ad-slot", "advert", "sponsored-links", "promo-box", "banner"]
_TALK = ["comments", "comment-list", "commentlist", "replies", "discussion", "disqus_thread"]
_MORE = ["related-posts", "related", "recommended-links", "share-buttons", "social", "tags"]
_FOOT = ["footer", "site-footer", "copyright", "legal-links"]
_MISLEADING = ["legal", "notice-board", "related-party", "side-effects", "advert-law", "tags-of-war", "share-holders", "header-note", "comment-free", "menu-of-the-day"]


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []

    def prose(self, low: int, high: int) -> str:
        """Words with elements inside a line."""
        r, text = self.r, self.words(low, high)
        for tag in ("b", "i", "em", "code", "span"):
            if r.random() < 0.08:
                text = f"<{tag}>{self.words(1, 4)}" + (f"</{tag}> " if r.random() < 0.8 else "") + text
        return text + (f"<br>{self.words(2, 9)}" if r.random() < 0.1 else "")

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choices(_PARTS, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
        text = " ".join(w + r.choice(("", "", "", "", ",", ".")) for w in made)
        return text[:1].upper() + text[1:] + "."

    def named(self, names: list[str]) -> str:
        kind = self.r.random()
        name = self.r.choice(names)
        extra = self.r.choice(("", " box", " clearfix", " col-3", " w-full"))
        return f' id="{name}"' if kind < 0.25 else f' class="{name}{extra}"' if kind < 0.85 else f" class={name}"

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(n)) + "</ul>"
        return " ".join(f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n))

    def teaser(self) -> str:
        return f'<div><h4><a href="/t">{self.words(2, 6)}</a></h4><p>{self.words(5, 18)}</p></div>'

    # ------------------------------------------------------------ what isn't content

    def boilerplate(self, kind: str) -> None:
        r, put = self.r, self.out.append
        if kind == "nav":
            put(f"<nav>{self.links(3, 9)}</nav>" if r.random() < 0.5 else f"<div{self.named(_NAV)}>{self.links(3, 9)}</div>" if r.random() < 0.7 else f"<div>{self.links(3, 9)}</div>")
        elif kind == "head":
            inner = f"<div>{self.words(1, 5)}</div>" + (f"<p>{self.words(3, 9)}</p>" if r.random() < 0.4 else "")
            put(f"<header>{inner}</header>" if r.random() < 0.5 else f"<div{self.named(_HEAD)}>{inner}</div>" if r.random() < 0.7 else f"<div><div>{inner}</div></div>")
        elif kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + (self.links(2, 7) if r.random() < 0.5 else "".join(self.teaser() for _ in range(r.randint(1, 3))))
            put(f"<aside>{inner}</aside>" if r.random() < 0.5 else f"<div{self.named(_SIDE)}>{inner}</div>" if r.random() < 0.8 else f"<div><div>{inner}</div></div>")
        elif kind in ("ad", "note") and r.random() < 0.2:
            put(f"<p{self.named(['ad', 'advert', 'sponsored', 'promo', 'cookie-notice', 'newsletter-signup'])}>{self.words(4, 25)}</p>")
        elif kind == "note":
            put(f"<div{self.named(_NOTE)}>{self.words(5, 30)} <a href=/ok>{self.words(1, 2)}</a></div>" if r.random() < 0.8 else f'<div role="alert"><p>{self.words(5, 25)}</p></div>')
        elif kind == "ad":
            put(f"<div{self.named(_AD)}>" + (f"<p>{self.words(4, 30)}</p>" if r.random() < 0.5 else self.words(4, 25)) + "</div>")
        elif kind == "form":
            put(f"<form action=/q><label>{self.words(1, 4)}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2)}</button></form>")
        elif kind == "talk":
            said = lambda tag: f"<{tag} class=c><b>{self.words(1, 2)}</b><p>{self.words(6, 60)}</p></{tag}>"
            tag = r.choice(("div", "li", "article", "div"))
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(said(tag) for _ in range(r.randint(1, 6)))
            put(f"<section{self.named(_TALK)}>{inner}</section>" if r.random() < 0.5 else f"<div{self.named(_TALK)}>{inner}</div>")
        elif kind == "more":
            put(f"<div{self.named(_MORE)}>" + (self.links(2, 6) if r.random() < 0.6 else "".join(self.teaser() for _ in range(r.randint(1, 3)))) + "</div>")
        elif kind == "foot":
            inner = f"&copy; {self.words(2, 10)}" + (self.links(2, 5) if r.random() < 0.5 else "")
            put(f"<footer>{inner}</footer>" if r.random() < 0.5 else f"<div{self.named(_FOOT)}>{inner}</div>" if r.random() < 0.7 else f"<div>{inner}</div>")
        elif kind == "code":
            put(r.choice(("<script>var a = '<p>x</p>';</script>", "<style>p > a { color: red }</style>", "<!-- a note -->", "<noscript>turn it on</noscript>")))

    # ------------------------------------------------------------ content

    def rich(self) -> str:
        """Content whose mark-up is much of it: links, lists of links, code, nested elements, figures without words."""
        r = self.r
        link = lambda low, high: f'<a href="/{r.randint(0, 99)}">{self.words(low, high)}</a>'
        kind = r.randrange(6)
        if kind == 0:
            return f"<p>{self.words(2, 20)} {link(6, 20)} {self.words(2, 20)}</p>"
        if kind == 1:
            return "<p>" + " ".join(link(1, 1) for _ in range(r.choice((3, 5, 12, 40)))) + "</p>"
        if kind == 2:
            return "<ul>" + "".join(f"<li>{link(2, 8)}</li>" for _ in range(r.randint(3, 14))) + "</ul>"
        if kind == 3:
            return "".join(f"<p>{self.words(1, 3)} <code>{self.words(1, 1)}</code> <em>{self.words(1, 1)}</em> <b>{self.words(1, 2)}</b></p>" for _ in range(r.randint(2, 7)))
        if kind == 4:
            return "".join(f"<div><span>{self.words(1, 3)}</span></div>" for _ in range(r.randint(2, 8)))
        return "".join("<div><figure><div><div><img src=i></div></div></figure></div>" for _ in range(r.randint(1, 4)))

    def block(self, marked: bool = False) -> str:
        r = self.r
        if r.random() < (0.3 if marked else 0.04):
            return self.rich()
        kind = r.random()
        link = f' <a href="/x">{self.words(1, 3)}</a> {self.words(2, 9)}' if r.random() < 0.25 else ""
        if kind < 0.62:
            name = f' class="{r.choice(_MISLEADING)}"' if r.random() < 0.08 else ""
            return f"<p{name}>{self.prose(3, 90)}{link}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.70:
            return f"<h{r.choice('23')}>{self.words(1, 6)}</h2>"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li>{self.words(3, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote><p>{self.words(6, 40)}</p></blockquote>"
        if kind < 0.89:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.93:
            return f"<figure><img src=i><figcaption>{self.words(3, 14)}</figcaption></figure>"
        name = f' class="story {r.choice(_MISLEADING)}"' if r.random() < 0.5 else ""
        return f"<div{name}><div><p>{self.words(8, 60)}</p></div></div>"

    def page(self) -> str:
        r, out = self.r, self.out
        out.append(f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 8)}</title></head><body>')
        wrap = r.choice(("", "", "<div id=page>", "<div><div class=wrap>"))
        out.append(wrap)
        for kind, share in (("code", 0.4), ("note", 0.3), ("head", 0.6), ("nav", 0.8), ("ad", 0.4), ("side", 0.3), ("form", 0.2), ("ad", 0.1)):
            if r.random() < share:
                self.boilerplate(kind)
        mark = r.choice((("", ""), ("", ""), ("<div class=content>", "</div>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div role="main">', "</div>"), ("<main>", "</main>")))
        title = f"<h1>{self.words(1, 9)}</h1>"
        plain = lambda: "".join(f"<p>{self.words(8, 50)}</p>" for _ in range(r.randint(1, 3)))
        beside = mark[0] not in ("", "<div class=content>") and r.random() < 0.5
        if beside:
            out.append(f"<div><div>{plain()}</div></div>")
        if mark[0] == "<main><article>" and r.random() < 0.5:
            out.append(f"<main>⟦{title}⟧<article>⟦")
        else:
            out.append(f"{mark[0]}⟦{title}")
        blocks = r.choice((1, 2, 3, 5, 8, 14, 25))
        for k in range(blocks):
            out.append(self.block(mark[0] not in ("", "<div class=content>")))
            if k < blocks - 1 and r.random() < 0.1:
                out.append("⟧")
                self.boilerplate(r.choice(("ad", "ad", "note", "form", "more", "side", "code")))
                out.append("⟦")
        out.append("⟧")
        if r.random() < 0.2:
            self.boilerplate("more")
        out.append(mark[1])
        if beside and r.random() < 0.5:
            out.append(f"<div>{plain()}</div>")
        for kind, share in (("more", 0.4), ("talk", 0.5), ("side", 0.4), ("form", 0.2), ("ad", 0.2), ("foot", 0.85), ("code", 0.3)):
            if r.random() < share:
                self.boilerplate(kind)
        out.append("</div>" * wrap.count("<div") + "</body></html>")
        return "".join(out)


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
