"""Labelled pages for training the extractor: layouts drawn with a fixed seed, each element marked as article or not.

The mark is the attribute data-main, which the trainer reads and the extractor never sees as a feature.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ber ca do el fa gen ha in jo ka lu mi no or pa qui re sa tu un ve wo xi ya zu ing tion heit ment ción oux str ph".split()
_COMMON = "the of and to in is was der die und das ein le la de et les el que en los y con".split()
_MENU = "Home About Contact News Sport Login Register Shop Blog Archive Help Search Accueil Startseite Kontakt Inicio Impressum Privacy Terms".split()
_NOTICE = ["We use cookies to improve your experience.", "Accept all cookies", "Diese Website verwendet Cookies.", "Subscribe to our newsletter", "Sign up for updates", "Nous utilisons des cookies", "Este sitio usa cookies"]
_FOOT = ["© 2024 {w}", "All rights reserved.", "© {w}.example.org · {s}", "Terms of use", "Privacy policy", "Powered by {w}", "Contact us: {w}@example.com"]


def _word(r: random.Random) -> str:
    return r.choice(_COMMON) if r.random() < 0.3 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, least: int = 1, most: int = 22) -> str:
    words = [_word(r) for _ in range(r.randint(least, most))]
    if r.random() < 0.06:
        return " | ".join(words)
    return (" ".join(words)).capitalize() + r.choice([".", ".", ".", "!", "?", "", ",", " %%%"])


def _prose(r: random.Random) -> str:
    n = r.choice([1, 1, 1, 2, 3, 5, 9])
    return " ".join(_sentence(r, 1, 3 if r.random() < 0.2 else 22) for _ in range(n))


def _el(tag: str, inner: str, main: int | None = None, attrs: str = "") -> str:
    mark = "" if main is None else f' data-main="{main}"'
    return f"<{tag}{' ' + attrs if attrs else ''}{mark}>{inner}</{tag}>"


def _names(r: random.Random, names: str) -> str:
    n = r.choice(names.split())
    n = r.choice([n, n, f"{n}-{r.choice(['wrap', 'box', 'inner', 'block', 'area', 'main', 'list', '1'])}", f"{r.choice(['site', 'page', 'js', 'the', 'c'])}-{n}"])
    return f'{r.choice(["class", "class", "id"])}="{n}"'


def _links(r: random.Random, tag: str = "li") -> str:
    text = lambda: r.choice([r.choice(_MENU), _word(r), _word(r) + ",", _sentence(r, 1, 6)])
    return "".join(_el(tag, f'<a href="/{_word(r)}">{text()}</a>') for _ in range(r.randint(2, 9)))


def _menu(r: random.Random) -> str:
    inner = r.choice([lambda: _el("ul", _links(r)), lambda: _links(r, "span"), lambda: _el("div", _links(r, "div"))])()
    return r.choice([_el("nav", inner, 0), _el("div", inner, 0, _names(r, "nav menu navbar navigation topnav breadcrumb breadcrumbs toolbar")), _el("nav", inner, 0, _names(r, "menu main primary")), _el("div", inner, 0, 'role="navigation"')])


def _advert(r: random.Random) -> str:
    text = r.choice([_prose(r), _sentence(r), _sentence(r) + "\n" + _sentence(r), f'<a href="/x">{_sentence(r)}</a>'])
    return _el(r.choice(["div", "div", "aside", "section", "p"]), text if r.random() < 0.6 else _el("p", text), 0, _names(r, "ad ads advert advertisement banner sponsor sponsored promo promotion adbox"))


def _notice(r: random.Random) -> str:
    text = r.choice(_NOTICE) if r.random() < 0.6 else _prose(r)
    return _el(r.choice(["div", "div", "section", "aside"]), _el("p", text) if r.random() < 0.5 else text, 0, _names(r, "cookie cookies consent notice gdpr popup modal overlay alert banner newsletter subscribe paywall warning"))


_LABELS = "Advertisement|ADVERTISEMENT|Advertisements|Advertising|Sponsored|Sponsored content|Promoted|Anzeige|ANZEIGE|Werbung|Publicité|Publicidad|Anuncio|Ad|Story continues below advertisement".split("|")


def _label(r: random.Random) -> str:
    """What stands over or in the place of an advert, without a name that says so."""
    return _el(r.choice(["p", "p", "div"]), r.choice(_LABELS), 0)


def _hidden(r: random.Random) -> str:
    """Text that no reader sees."""
    how = r.choice(['style="display:none"', 'style="color:red; display: none"', "hidden", 'aria-hidden="true"', 'hidden="hidden"'])
    return _el(r.choice(["p", "p", "div", "section", "li", "h2"]), r.choice([_prose(r), _el("p", _prose(r)), _sentence(r)]), 0, how)


def _form(r: random.Random) -> str:
    return _el("form", f'<label>{_sentence(r, 1, 4)}</label><input type="text"><p>{_sentence(r)}</p><button>Send</button>', 0, r.choice(["", _names(r, "search login signup contact newsletter comment-form")]))


def _side(r: random.Random) -> str:
    inner = r.choice([_el("h3", _sentence(r, 1, 4)) + _el("ul", _links(r)), _el("p", _prose(r)), _el("div", _prose(r)), _el("h4", "Related") + _links(r, "p")])
    return r.choice([_el("aside", inner, 0), _el("aside", inner, 0, _names(r, "sidebar related widget")), _el(r.choice(["div", "section"]), inner, 0, _names(r, "sidebar side related widget recommended trending popular share social tags more-stories author-bio rail"))])


def _comments(r: random.Random) -> str:
    one = lambda: _el(r.choice(["div", "li", "article", "section"]), _el("p", _prose(r)) if r.random() < 0.6 else _prose(r), None, _names(r, "comment reply response comment-body"))
    inner = _el("h3", "Comments") + "".join(one() for _ in range(r.randint(1, 5)))
    return _el(r.choice(["div", "section", "ol", "aside"]), inner, 0, _names(r, "comments comment-list commentlist responses discussion disqus replies"))


def _head(r: random.Random) -> str:
    inner = _el(r.choice(["div", "h1", "p", "span", "h2"]), _sentence(r, 1, 5)) + (_menu(r) if r.random() < 0.4 else "") + (_el("p", _prose(r)) if r.random() < 0.4 else "")
    return r.choice([_el("header", inner, 0), _el("header", inner, 0, _names(r, "header masthead top")), _el("div", inner, 0, _names(r, "header masthead topbar logo branding page-header"))])


def _foot(r: random.Random) -> str:
    text = r.choice(_FOOT).format(w=_word(r), s=_sentence(r)) + r.choice(["", "\n" + _sentence(r)])
    inner = text if r.random() < 0.5 else _el("p", text) + (_el("p", _prose(r)) if r.random() < 0.4 else "") + (_el("ul", _links(r)) if r.random() < 0.4 else "")
    return r.choice([_el("footer", inner, 0), _el("footer", inner, 0, _names(r, "footer bottom colophon")), _el("div", inner, 0, _names(r, "footer foot bottom copyright legal"))])


def _article(r: random.Random) -> str:
    title = _el(r.choice(["h1", "h1", "h1", "h2"]), _sentence(r, 1, 10))
    parts = [_el("header", title) if r.random() < 0.15 else title] if r.random() < 0.9 else []
    for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25])):
        parts.append(
            r.choice(
                [lambda: _el("p", _prose(r))] * 12
                + [lambda: f"<p>{_prose(r)}", lambda: f"<p><b>{_prose(r)}<br>", lambda: _el("div", _prose(r)), lambda: _el("h2", _sentence(r, 1, 7)), lambda: _el("h3", _sentence(r, 1, 7))]
                + [lambda: _el("ul", "".join(_el("li", _sentence(r)) for _ in range(r.randint(1, 5)))), lambda: _el("blockquote", _el("p", _prose(r))), lambda: _el("blockquote", _prose(r))]
                + [lambda: _el("ol", "".join(_el("li", _sentence(r)) for _ in range(3))), lambda: _el("pre", _sentence(r)), lambda: _el("figure", "<img src=x>" + _el("figcaption", _sentence(r)))]
                + [lambda: _el("table", "".join(_el("tr", _el("td", _sentence(r, 1, 3)) * 2) for _ in range(3))), lambda: _el("p", f'{_sentence(r)} <a href="/{_word(r)}">{_sentence(r, 1, 5)}</a> {_sentence(r)}')]
                + [lambda: r.choice([_advert, _advert, _side, _notice, _form])(r), lambda: _label(r), lambda: _hidden(r)]
            )()
        )
    return "".join(parts)


def _plain(r: random.Random) -> str:
    """An article of a title, paragraphs and the like, that nothing but a nameless element may hold."""
    parts = [_el(r.choice(["h1", "h1", "h2"]), _sentence(r, 1, 10))] if r.random() < 0.85 else []
    parts += [r.choice([lambda: _el("p", _prose(r))] * 9 + [lambda: _el("h2", _sentence(r, 1, 7)), lambda: _el("ul", "".join(_el("li", _sentence(r)) for _ in range(3))), lambda: _label(r), lambda: _hidden(r)])() for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4, 7]))]
    return "".join(parts)


def _wrapped(r: random.Random) -> str:
    inner = _article(r)
    wrap = r.random()
    if wrap < 0.45:
        out = _el("article", inner, 1, r.choice(["", "", _names(r, "post article story entry")]))
        return out if r.random() < 0.7 else _el("main", out)
    if wrap < 0.6:
        return _el("main", inner, 1, r.choice(["", _names(r, "content main")]))
    return _el(r.choice(["div", "div", "section", "td"]), inner, 1, _names(r, "content article post entry story body post-content article-body entry-content text main"))


KINDS = {"full": 0.6, "few": 0.15, "bare": 0.15, "plain": 0.1}


def sample_page(r: random.Random, kind: str | None = None) -> str:
    """One page: an article among some of the other parts, in a plausible order.

    Kinds: full; few, with an article in a named element and hardly anything else; bare, an article that stands in the body
    itself; plain, one in a nameless element. The last two have few other parts and often none.
    """
    kind = kind or r.choices(list(KINDS), list(KINDS.values()))[0]
    if kind != "full":
        rare = lambda make, p: make(r) if r.random() < p else ""
        top, end = rare(_menu, 0.25) + rare(_head, 0.1) + rare(_notice, 0.05), rare(_foot, 0.3) + rare(_comments, 0.1) + rare(_hidden, 0.1)
        if kind == "few":
            return f"<html><body>{top}{_wrapped(r)}{end}</body></html>"
        inner = _plain(r)
        inner = _el(r.choice(["div", "div", "section", "center"]), inner, 1) if kind == "plain" else inner
        title = f"<head><title>{_sentence(r)}</title></head>" if r.random() < 0.5 else ""
        return f'<html>{title}<body{" data-main=1" if kind == "bare" else ""}>{top}{inner}{end}</body></html>'
    some = lambda make, p: make(r) if r.random() < p else ""
    body = some(_notice, 0.3) + some(_head, 0.5) + some(_menu, 0.75) + some(_advert, 0.5) + some(_side, 0.2)
    middle = _wrapped(r) + some(_hidden, 0.08) + some(_side, 0.35) + some(_comments, 0.35) + some(_form, 0.15) + some(_advert, 0.2)
    if r.random() < 0.4:
        middle = _el("div", middle, None, r.choice(["", _names(r, "wrapper container page layout row")]))
    return f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title></head><body>{body}{middle}{some(_notice, 0.1)}{some(_foot, 0.85)}</body></html>"


def sample_pages(n: int, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    return [sample_page(r) for _ in range(n)]
