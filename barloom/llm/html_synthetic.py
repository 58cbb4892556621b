"""Web pages with known article blocks, to train the block labeller on.

Layouts are drawn piece by piece: how the article is wrapped, and which menus,
headers, footers, sidebars, notices, adverts, forms, share bars and reader
comments stand around and inside it, with what names. Words are invented from
syllables, the same for article and boilerplate; boilerplate has stock phrases
as well, some of the time.
"""

from __future__ import annotations

_SYLLABLES = "the and er in on at en es re th nd ti ng is it or te ed de la que les ou ai der die und ein ich sch los del as por con ñ é ä ü a o".split()
#: Stock phrases of boilerplate, fixed values.
_PHRASES = (
    "Home|About us|Contact|Privacy policy|Terms of use|All rights reserved|Accept cookies|We use cookies on this site|Subscribe to our newsletter|Sign in|Log in|Register|Search|Share this|"
    "Follow us|Read more|Related articles|Advertisement|Sponsored|Leave a reply|Reply|Comments|Next|Previous|Menu|Skip to content|Impressum|Datenschutz|Kontakt|Startseite|Accueil|Mentions légales|"
    "Inicio|Aviso legal|Sitemap|Print|Tweet|Like|Tags|Categories|Archives|Copyright 2023|Powered by|Back to top|Buy now|Your email|Send|Cancel|Load more"
).split("|")


def _word(rng) -> str:
    return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 5)))


def _words(rng, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.integers(low, high + 1)))


def _sentence(rng, low=4, high=18) -> str:
    text = _words(rng, low, high)
    return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "!", "?"])


def _pick(rng, *options):
    return options[int(rng.integers(0, len(options)))]


def _named(rng, *names: str) -> str:
    """A class or id attribute with one of the names, perhaps among others."""
    if not names or rng.random() < 0.05:
        return ""
    name = _pick(rng, *names)
    name = _pick(
        rng, name, name, f"{name}-{_pick(rng, 'box', 'wrap', 'inner', 'area', 'block', 'container', 'main', 'top', 'left')}",
        f"{_pick(rng, 'site', 'page', 'js', 'c', 'm', 'module', 'widget')}-{name}", f"{_word(rng)} {name}", f"{name}{rng.integers(1, 9)}"
    )
    return f' {_pick(rng, "class", "class", "class", "id")}="{name}"'


def _line(rng, low=1, high=4) -> str:
    """Short boilerplate: a stock phrase or invented words."""
    return _pick(rng, *_PHRASES) if rng.random() < 0.4 else _words(rng, low, high)


def _list(rng, links=True) -> str:
    items = [f'<a href="/{i}">{_line(rng)}</a>' if links else _line(rng) for i in range(rng.integers(2, 8))]
    kind = rng.random()
    if kind < 0.7:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    if kind < 0.85:
        return _pick(rng, " ", " | ", "").join(items)
    return "".join(f"<div>{x}</div>" for x in items)


def _prose(rng) -> str:
    """A few sentences, as boilerplate holds them too."""
    return " ".join(_sentence(rng) for _ in range(rng.integers(1, 4)))


def _box(rng, *names: str, tags=("div", "div", "section", "p", "span")) -> str:
    """Text that only its names tell from the article."""
    tag = _pick(rng, *tags)
    text = _prose(rng) if rng.random() < 0.75 else _line(rng)
    name = _named(rng, *names) or f' class="{names[0]}"'
    inner = text if tag in ("p", "span") or rng.random() < 0.5 else f"<p>{text}</p>"
    if rng.random() < 0.25 and tag not in ("p", "span"):
        inner = f"<{_pick(rng, 'h2', 'h3', 'h4')}>{_line(rng)}</{_pick(rng, 'h2', 'h3', 'h4')}>" + inner
    return f"<{tag}{name}>{inner}</{tag}>"


def _menu(rng) -> str:
    return _pick(
        rng, f"<nav>{_list(rng)}</nav>", f"<nav{_named(rng, 'nav', 'menu', 'navbar', 'breadcrumb')}>{_list(rng)}</nav>",
        f"<div{_named(rng, 'nav', 'menu', 'navigation', 'navbar', 'breadcrumbs', 'toolbar')}>{_list(rng)}</div>",
        f"<ul{_named(rng, 'nav', 'menu', 'links', 'pagination')}><li>{_line(rng)}</li><li><a>{_line(rng)}</a></li></ul>",
        f'<div role="navigation">{_list(rng)}</div>'
    )


def _header(rng) -> str:
    inner = f"<h{_pick(rng, 1, 2, 3)}>{_line(rng)}</h2>" * (rng.random() < 0.4) + (
        f"<p>{_prose(rng)}</p>" if rng.random() < 0.4 else f"<div>{_line(rng)}</div>"
    ) + (_menu(rng) if rng.random() < 0.4 else "")
    return _pick(
        rng, f"<header>{inner}</header>", f"<header{_named(rng, 'header', 'masthead', 'site-header')}>{inner}</header>",
        f"<div{_named(rng, 'header', 'masthead', 'topbar', 'banner', 'logo')}>{inner}</div>", f'<div role="banner">{inner}</div>'
    )


def _footer(rng) -> str:
    inner = _pick(rng, f"&copy; {_word(rng)}.example &middot; {_prose(rng)}", f"<p>{_prose(rng)}</p>", _list(rng), f"<p>&copy; 2023 {_line(rng)}</p>{_list(rng)}", _prose(rng))
    return _pick(
        rng, f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<footer{_named(rng, 'footer', 'colophon')}>{inner}</footer>",
        f"<div{_named(rng, 'footer', 'copyright', 'legal', 'bottom')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>'
    )


def _aside(rng) -> str:
    inner = "".join(_pick(rng, f"<p>{_prose(rng)}</p>", f"<h3>{_line(rng)}</h3>", _list(rng), _prose(rng)) for _ in range(rng.integers(1, 4)))
    return _pick(
        rng, f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f"<aside{_named(rng, 'sidebar', 'related', 'widget')}>{inner}</aside>",
        f"<div{_named(rng, 'sidebar', 'related', 'widget', 'side', 'recommended', 'trending', 'popular', 'rail')}>{inner}</div>",
        f'<div role="complementary">{inner}</div>'
    )


def _notice(rng) -> str:
    return _box(
        rng, "notice", "cookie", "cookies", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "message", "warning",
        "disclaimer", "paywall", "toast", "cookie-notice", "cookie-banner"
    )


def _advert(rng) -> str:
    return _box(
        rng, "ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense", "banner-ad", "ad-slot", "dfp",
        "commercial", "partner", tags=("div", "div", "div", "section", "p", "aside", "ins")
    )


def _form(rng) -> str:
    fields = "".join(
        _pick(
            rng, f"<label>{_line(rng)}</label><input name=q>", f"<p>{_prose(rng)}</p>", f"<button>{_line(rng)}</button>",
            f"<select><option>{_word(rng)}<option>{_word(rng)}</select>", f"<textarea>{_prose(rng)}</textarea>",
            f"<legend>{_line(rng)}</legend>", _prose(rng), f"<input type=submit value=x> {_line(rng)}"
        )
        for _ in range(rng.integers(1, 5))
    )
    return _pick(
        rng, f"<form>{fields}</form>",
        f'<form action="/s"{_named(rng, "search", "newsletter", "login", "subscribe", "signup")}>{fields}</form>',
        f"<div{_named(rng, 'newsletter', 'subscribe', 'signup', 'search', 'login')}><p>{_prose(rng)}</p>{fields}</div>"
    )


def _comments(rng) -> str:
    one = lambda: _pick(rng, f"<p>{_prose(rng)}</p>", f"<div{_named(rng, 'comment', 'reply')}><b>{_word(rng)}</b><p>{_prose(rng)}</p></div>", f"<li{_named(rng, 'comment')}>{_prose(rng)}</li>", f"<div{_named(rng, 'comment-body', 'comment-text')}>{_prose(rng)}</div>", f"<article{_named(rng, 'comment')} ><p>{_prose(rng)}</p></article>")
    inner = f"<h3>{_line(rng)}</h3>" * (rng.random() < 0.5) + "".join(one() for _ in range(rng.integers(1, 6)))
    tag = _pick(rng, "div", "div", "section", "ol", "ul", "aside")
    name = _named(rng, "comments", "comment-list", "comments", "discussion", "responses", "disqus", "replies", "reader-comments") or ' class="comments"'
    return f"<{tag}{name}>{inner}</{tag}>"


def _share(rng) -> str:
    return f"<div{_named(rng, 'share', 'social', 'tags', 'byline-share', 'toolbar', 'meta-links', 'sharing')}>{_list(rng)}</div>"


_OUTSIDE = (_menu, _header, _footer, _aside, _notice, _advert, _form, _comments, _share)
_INSIDE = (_aside, _advert, _notice, _form, _share, _comments, _menu, _footer)


def page(rng) -> tuple[str, set[str]]:
    """(html, texts of its article blocks)."""
    article: set[str] = set()

    def text(low=1, high=5) -> str:
        out = " ".join(_sentence(rng) for _ in range(rng.integers(low, high))) if rng.random() < 0.85 else _sentence(rng, 1, 4)
        article.add(out)
        return out

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.62:
            own = text(1, 6) if rng.random() < 0.85 else text(1, 2)
            style = _pick(rng, "", "", "", "<b>", "<i>", "<span>")
            return _pick(rng, "<p>", "<p>", "<p>", "<p class='text'>") + style + own + _pick(
                rng, "</p>", "</p>", "</p>", "<br>", "", (style.replace("<", "</") if style else "") + "</p>"
            )
        if kind < 0.7:
            h = _pick(rng, "h2", "h3", "h4")
            own = _words(rng, 2, 7).capitalize()
            article.add(own)
            return f"<{h}>{own}</{h}>"
        if kind < 0.76:
            return f"<blockquote>{_pick(rng, '', '<p>')}{text(1, 3)}</blockquote>"
        if kind < 0.83:
            return _pick(rng, "<ul>", "<ol>") + "".join(f"<li>{text(1, 2)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>"
        if kind < 0.87:
            return f"<pre>{text(1, 2)}</pre>"
        if kind < 0.9:
            return f"<figure><img src=x><figcaption>{text(1, 2)}</figcaption></figure>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{text(1, 2)}</td><td>{text(1, 2)}</td></tr>" for _ in range(rng.integers(1, 3))) + "</table>"
        return f"<div>{text(1, 4)}</div>"

    heading = _pick(rng, _words(rng, 3, 10).capitalize(), _sentence(rng, 3, 9), _words(rng, 2, 6))
    body = []
    if rng.random() < 0.85:
        article.add(heading)
        h = f"<h1>{heading}</h1>"
        body.append(_pick(rng, h, h, h, h, f"<header>{h}</header>", f"<div class='title'>{h}</div>", f"<h1{_named(rng, 'title', 'headline', 'entry-title')}>{heading}</h1>"))
    count = int(_pick(rng, 1, *(rng.integers(2, 18) for _ in range(9)), rng.integers(18, 90)))
    inside = rng.random() < 0.45
    for k in range(count):
        body.append(paragraph())
        if inside and rng.random() < 0.12:
            body.append(_pick(rng, *_INSIDE)(rng))
    if inside and rng.random() < 0.25:
        body.append(_pick(rng, _comments, _share, _aside, _footer)(rng))
    inner = "".join(body)
    names = ("content", "post", "entry-content", "story", "article-body", "post-content", "main-content", "body-text", "article", "text", "page-content", "entry")
    wrapped = _pick(
        rng,
        f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article{_named(rng, *names)}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
        f"<div{_named(rng, *names)}>{inner}</div>", f"<div{_named(rng, *names)}>{inner}</div>", f"<section{_named(rng, *names)}>{inner}</section>", f'<div role="main">{inner}</div>', f"<div>{inner}</div>", inner,
        f"<table><tr><td{_named(rng, *names)}>{inner}</td></tr></table>",
    )
    before = "".join(_pick(rng, *_OUTSIDE)(rng) for _ in range(rng.integers(0, 4)))
    after = "".join(_pick(rng, *_OUTSIDE)(rng) for _ in range(rng.integers(0, 5)))
    if rng.random() < 0.5:
        before = _menu(rng) + before
    if rng.random() < 0.5:
        after += _footer(rng)
    whole = before + wrapped + after
    if rng.random() < 0.25:
        whole = f"<div{_named(rng, 'wrapper', 'page', 'container', 'site', 'layout')}>{whole}</div>"
    if rng.random() < 0.08:  # nothing but boilerplate
        whole, article = before + after + _menu(rng), set()
    head = f"<!DOCTYPE html><html><head><title>{heading}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
    return head + whole + _pick(rng, "</body></html>", "", "</body>"), article
