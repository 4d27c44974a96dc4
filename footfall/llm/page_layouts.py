"""Labelled web pages drawn by rule, for training the field of ``pages``: many layouts, invented words, marked main text."""

from __future__ import annotations

from random import Random

#: Stands in each block of main text of a drawn page.
MARK = "\ue000"
#: Words of class and id attributes by what they hold.
NAMES = {
    "main": "content post entry story article body text main page blog news reading",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs topnav links toc tabs pagination pager",
    "head": "header head masthead top brand logo banner site",
    "side": "sidebar side aside widget related recommended popular trending tags archive teaser more promo recent box",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion commercial adsbygoogle",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall banner privacy warning message",
    "form": "form search login signup subscribe newsletter contact register",
    "talk": "comments comment reply replies discussion respond response thread disqus reader readers commentlist feedback",
    "foot": "footer foot bottom copyright legal imprint credits colophon",
    "share": "share social sharing follow buttons",
}
ELEMENTS = {"menu": "nav", "head": "header", "side": "aside", "ad": "aside", "form": "form", "foot": "footer"}
SYLLABLES = "an be cor del eth fi gra hon il jor ka lun mar ne ost pri qua ren sol tur ul ver wen yil zor ü é ña".split()


def word(r: Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 4))) + r.choice(["", "", "", "", "", ",", "###", "%%%"] if r.random() < 0.1 else [""])


def words(r: Random, least: int, most: int) -> str:
    return " ".join(word(r) for _ in range(r.randint(least, most)))


def sentences(r: Random, most: int) -> str:
    return " ".join(words(r, 1, 18).capitalize() + r.choice("...?!") for _ in range(r.randint(1, most)))


def link(r: Random, text: str) -> str:
    return f'<a href="/{word(r)}">{text}</a>'


def named(r: Random, kind: str) -> str:
    """An attribute that tells what the element holds, or none."""
    chosen = r.sample(NAMES[kind].split(), r.choice([1, 1, 2]))
    return f' {r.choice(["class", "id", "class"])}="{r.choice("- _")[0].join(chosen)}"'


def boxed(r: Random, kind: str, inner: str, plain: bool) -> str:
    """``inner`` in an element of this kind; with ``plain`` it has no telling name."""
    if plain:
        return f"<div>{inner}</div>"
    if kind in ELEMENTS and r.random() < 0.5:
        return f"<{ELEMENTS[kind]}{named(r, kind) if r.random() < 0.4 else ''}>{inner}</{ELEMENTS[kind]}>"
    element = r.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"])
    return f"<{element}{named(r, kind)}>{inner}</{element}>"


def links(r: Random) -> str:
    items = [link(r, words(r, 1, 4)) for _ in range(r.randint(2, 9))]
    form = r.randrange(3)
    if form == 0:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return "".join(f"<li>{x}" for x in items) if form == 1 else f"<p>{r.choice([' | ', ' &middot; ', ' ']).join(items)}</p>"


def aside(r: Random, kind: str) -> str:
    """Content of a part that is no main text."""
    title = f"<h{r.randint(2, 5)}>{words(r, 1, 3)}</h2>" if r.random() < 0.4 else ""
    if kind == "menu":
        return links(r)
    if kind == "head":
        return r.choice([f"<h1>{link(r, words(r, 1, 3))}</h1>", f"<p>{words(r, 1, 6)}</p>", f"<div>{words(r, 1, 3)}</div><p>{words(r, 2, 8)}</p>"])
    if kind in ("side", "share"):
        return title + r.choice([links(r), links(r), f"<p>{sentences(r, 3)}</p>", f"<p>{sentences(r, 2)}</p>" + links(r)])
    if kind == "form":
        return title + f"<label>{words(r, 1, 3)}</label><input><p>{words(r, 2, 12)}</p><button>{words(r, 1, 2)}</button>"
    if kind == "talk":
        each = [f"<div{named(r, 'talk')}>" + f"<p>{words(r, 1, 2)}</p>" * r.randint(0, 1) + f"<p>{sentences(r, 6)}</p></div>" for _ in range(r.randint(1, 5))]
        return title + "".join(each)
    if kind == "foot":
        return r.choice([f"&copy; {words(r, 1, 4)} &middot; {sentences(r, 2)}", f"<p>&copy; {words(r, 1, 5)}</p>{links(r)}", f"<p>{sentences(r, 3)}</p>"])
    return r.choice([sentences(r, 2), f"<p>{sentences(r, 4)}</p>", title + f"<p>{sentences(r, 2)}</p>" + links(r)])


def body(r: Random) -> list[str]:
    """Elements of main text, each block marked."""
    out = []
    if r.random() < 0.85:
        out.append(f"<h{r.choice([1, 1, 2])}>{MARK}{words(r, 1, 14).capitalize()}</h1>")
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        form, text = r.random(), sentences(r, r.choice([1, 1, 3, 8, 15]))
        if form < 0.7:
            out.append(f"<p>{MARK}{text}</p>")
        elif form < 0.78:
            out.append(f"<p>{MARK}{words(r, 1, 2)}{r.choice(['.', ''])}</p>")
        elif form < 0.84:
            out.append(f"<h{r.randint(2, 4)}>{MARK}{words(r, 1, 8)}</h2>")
        elif form < 0.89:
            out.append("<ul>" + "".join(f"<li>{MARK}{words(r, 1, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif form < 0.92:
            out.append(f"<blockquote><p>{MARK}{text}</p></blockquote>")
        elif form < 0.94:
            out.append(f"<pre>{MARK}{text}</pre>")
        elif form < 0.96:
            out.append("<table>" + "".join(f"<tr><td>{MARK}{words(r, 1, 4)}</td><td>{MARK}{words(r, 1, 3)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            out.append(f"<p><b>{MARK}{words(r, 2, 9)}<br><p>{MARK}{text} {link(r, words(r, 1, 3))}</p>")
    return out


def drawn_page(r: Random) -> tuple[str, str]:
    """A page and the mark that its blocks of main text contain."""
    plain = r.random() < 0.15  # no telling names at all
    middle = body(r)
    for kind, chance in (("ad", 0.3), ("share", 0.2), ("side", 0.2), ("notice", 0.1), ("form", 0.1)):
        if r.random() < chance:
            middle.insert(r.randint(0, len(middle)), boxed(r, kind, aside(r, kind), False))
    if r.random() < 0.2:
        middle.append(boxed(r, "talk", aside(r, "talk"), False))
    text = "".join(middle)
    form = r.random()
    if plain or form < 0.1:
        text = f"<div>{text}</div>"
    elif form < 0.45:
        text = f"<article>{text}</article>"
    elif form < 0.55:
        text = f"<main>{text}</main>"
    elif form < 0.65:
        text = f"<main><article{named(r, 'main')}>{text}</article></main>"
    elif form < 0.7:
        text = f'<div role="main">{text}</div>'
    else:
        text = f"<{(e := r.choice(['div', 'div', 'section', 'td']))}{named(r, 'main')}>{text}</{e}>"
    before = [k for k, p in (("head", 0.5), ("menu", 0.8), ("notice", 0.3), ("ad", 0.5), ("form", 0.2), ("side", 0.2)) if r.random() < p]
    after = [k for k, p in (("share", 0.2), ("talk", 0.35), ("side", 0.4), ("form", 0.2), ("ad", 0.3), ("menu", 0.2), ("notice", 0.2), ("foot", 0.85)) if r.random() < p]
    parts = [*(boxed(r, k, aside(r, k), plain) for k in before), text, *(boxed(r, k, aside(r, k), plain) for k in after)]
    page = "".join(parts)
    if r.random() < 0.3:
        page = f'<div class="{r.choice(["wrapper", "page", "container", "site", "layout"])}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(r, 2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>", MARK
