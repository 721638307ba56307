"""Labelled pages to learn from: invented articles in many layouts, built by rule from a seed.

No table labels pages, so the extractor learns from these.  A page is an article
(headline, paragraphs, lists, quotes, tables) with what sites put around it:
menus, headers, sidebars, notices, adverts, forms, comments, footers.  Content
pieces carry ``MARK`` in their text, which the trainer takes out again.
"""

from __future__ import annotations

import random

MARK = "\ue000"

_SYLLABLES = "an be ca de er fo ga he in ka le mo na or pa qu re sa te un va wi xo ya zu th st ing tion ment ung keit ción ado elle eau".split()
_SMALL = "the of and to in is it for on with as was de la el en los que un et le les des une der die das und ein zu von".split()

#: What pages say around articles. Fixed phrases of the trade, in four languages.
_SAYS = {
    "notice": "We use cookies to improve your experience.|By continuing you accept our cookie policy.|Wir verwenden Cookies, um diese Seite zu verbessern.|Este sitio utiliza cookies propias y de terceros.|Ce site utilise des cookies.|Please enable JavaScript to view this page.|You have 3 free articles left this month.|Accept all|Manage preferences",
    "foot": "© 2024 {w}. All rights reserved.|Copyright {w}|Alle Rechte vorbehalten.|Todos los derechos reservados.|Tous droits réservés.|Terms of service|Privacy policy|Impressum|Powered by {w}|© {w} · {s}|{s}",
    "form": "Subscribe to our newsletter|Enter your email address|Sign in|Password|Search this site|Suscríbase|Anmelden|S'abonner|Leave a reply|Your name",
    "share": "Share this|Tweet|Share on Facebook|Tags: {w}, {w}|Filed under {w}|Print|Teilen|Compartir|Partager",
    "advert": "Advertisement|Sponsored|Buy now and save 20%|{s}|{s}|Limited offer: {s}|Anzeige|Publicidad",
    "more": "Related articles|You may also like|Most read|Read more|{t}|{t}|{t}|{s}|Mehr zum Thema|Lo más leído|À lire aussi",
    "reader": "{s} {s}|{s}|Great post, thanks!|I disagree. {s} {s} {s}|@{w} {s}|{w} says:|Reply",
}
#: Names that sites give the parts of a page. Fixed values.
_NAMES = {
    "article": "post hentry article story entry blog-post article-wrapper news-item",
    "content": "content post-content entry-content article-body main-content body-text td-post-content story__body articleBody page-content text prose",
    "plain": "c1 x7 wrap container row col-8 box inner section-2 block grid a b z9 layout",
    "menu": "nav navbar main-menu site-navigation menu breadcrumb breadcrumbs topnav pagination",
    "top": "header site-header masthead top-bar page-header branding",
    "side": "sidebar widget-area secondary right-rail aside widget related related-posts recommended more-stories popular",
    "foot": "footer site-footer colophon bottom copyright page-footer legal",
    "advert": "ad ads advert ad-slot sponsored promo banner-ad advertisement adsbygoogle promoted",
    "notice": "cookie-banner cookie-notice consent gdpr-popup notice alert modal overlay paywall site-message",
    "form": "newsletter search-form subscribe login signup contact-form",
    "share": "share social-links tags post-meta sharing tag-list",
    "comments": "comments comment-list disqus_thread respond comment reader-comments discussion user-reviews replies",
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        # some sites name nothing: tags and texts must do; some have no telling tags
        self.named = rng.random() < 0.75
        self.tagged = rng.random() < 0.6

    def word(self) -> str:
        r = self.rng
        return r.choice(_SMALL) if r.random() < 0.35 else "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 2, 2, 3, 4))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(lo, hi)))

    def sentence(self) -> str:
        s = self.words(2, 18).capitalize()
        if self.rng.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        if self.rng.random() < 0.05:
            s += f" {self.rng.randint(1, 99999)}"
        return s + self.rng.choice(".....!?")

    def prose(self) -> str:
        r = self.rng
        n = r.choice((1, 1, 2, 3, 4, 6, 9))
        if r.random() < 0.08:  # one word, a row of cells, a number
            return r.choice((self.word().capitalize() + ".", " | ".join(self.word() for _ in range(r.randint(3, 20))), str(r.randint(1, 10**9)), self.words(1, 5)))
        text = " ".join(self.sentence() for _ in range(n))
        if r.random() < 0.15:
            text = text.replace(" ", f" <a href='/{self.word()}'>{self.word()}</a> ", 1)
        return text

    def said(self, kind: str) -> str:
        s = self.rng.choice(_SAYS[kind].split("|"))
        for key, make in (("{w}", self.word), ("{s}", self.sentence), ("{t}", lambda: self.words(3, 9).capitalize())):
            while key in s:
                s = s.replace(key, make(), 1)
        return s

    def box(self, kind: str, inside: str, tag: str = "div", sure: bool = False) -> str:
        """An element whose name tells its kind, if this site names things."""
        r = self.rng
        names = _NAMES[kind].split() if self.named or sure else _NAMES["plain"].split()
        name = r.choice(names) + r.choice(("", "", "", f"-{r.randint(1, 9)}", " " + r.choice(_NAMES["plain"].split())))
        how = r.choice((f'class="{name}"', f"class='{name}'", f'id="{name}"', f'class="{name}" data-x="{r.randint(1, 99)}"'))
        return f"<{tag} {how}>{inside}</{tag}>"

    def links(self, lo: int = 3, hi: int = 9) -> str:
        r = self.rng
        items = [f'<a href="/{self.word()}">{self.words(1, r.choice((1, 2, 7)))}</a>' for _ in range(r.randint(lo, hi))]
        return r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ul><li>" + "<li>".join(items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.9:
            head = MARK + r.choice((self.words(2, 9).capitalize(), self.sentence(), self.words(1, 20)))
            level = r.choice(("h1", "h1", "h1", "h2"))
            head = f"<{level}>{head}</{level}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        flow = r.choice(("p", "p", "p", "div", "br"))
        for _ in range(r.choice((1, 2, 4, 7, 12, 20))):
            kind = r.random()
            if kind < 0.06:
                out.append(f"<h2>{MARK}{self.words(1, 8).capitalize()}</h2>")
            elif kind < 0.12:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.prose()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.16:
                out.append(f"<blockquote><p>{MARK}{self.prose()}</p></blockquote>")
            elif kind < 0.18:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.2:
                out.append(f"<figure><img src='x'><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif kind < 0.22:
                out.append(f"<pre>{MARK}{self.words(2, 20)}</pre>")
            elif kind < 0.24:  # articles say such things too
                out.append(f"<p>{MARK}{self.said(r.choice(('foot', 'foot', 'notice', 'more', 'share', 'form')))}</p>")
            elif kind < 0.3:
                out.append(self.box("advert", self.said("advert"), sure=True))
            elif flow == "br":
                out.append(f"{MARK}{self.prose()}<br>{self.prose()}<br><br>")
            else:
                out.append(r.choice((f"<{flow}>{MARK}{self.prose()}</{flow}>", f"<{flow}><b>{MARK}{self.prose()}<br></{flow}>", f"<p>{MARK}{self.prose()}")))
        return "".join(out)

    def menu(self) -> str:
        x = self.links()
        return f"<nav>{x}</nav>" if self.tagged or self.rng.random() < 0.3 else self.box("menu", x)

    def top(self) -> str:
        x = f"<div>{self.words(1, 3)}</div>{self.rng.choice((self.menu(), self.said('form'), '<p>' + self.sentence() + '</p>'))}"
        return f"<header>{x}</header>" if self.tagged else self.box("top", x, sure=self.rng.random() < 0.5)

    def side(self) -> str:
        r = self.rng
        x = f"<h3>{self.said('more')}</h3>" + r.choice((self.links(), "".join(f"<p>{self.said('more')}</p>" for _ in range(r.randint(1, 4)))))
        return f"<aside>{x}</aside>" if self.tagged else self.box("side", x, sure=r.random() < 0.7)

    def foot(self) -> str:
        r = self.rng
        x = r.choice(("", self.links())) + "".join(r.choice((f"<p>{self.said('foot')}</p>", f"<div>{self.said('foot')}</div>", self.said("foot"))) for _ in range(r.randint(1, 3)))
        return f"<footer>{x}</footer>" if self.tagged or r.random() < 0.4 else self.box("foot", x)

    def notice(self) -> str:
        x = f"<p>{self.said('notice')} {self.rng.choice(('', self.sentence()))}</p><button>OK</button>"
        return f"<dialog>{x}</dialog>" if self.rng.random() < 0.1 else self.box("notice", x, sure=True)

    def form(self) -> str:
        r = self.rng
        x = f"<label>{self.said('form')}</label><input name=q>" + r.choice(("", f"<p>{self.said('form')}. {self.sentence()}</p>", "<select><option>a<option>b</select>"))
        return f"<form action=/x>{x}</form>" if r.random() < 0.7 else self.box("form", x, sure=True)

    def comments(self) -> str:
        r = self.rng
        each = "".join(self.box("comments", f"<b>{self.word()}</b><p>{self.said('reader')} {r.choice(('', self.prose()))}</p>", r.choice(("div", "li", "article")), sure=True) for _ in range(r.randint(1, 8)))
        return self.box("comments", f"<h3>{r.randint(1, 99)} Comments</h3>{each}{r.choice(('', self.form()))}", r.choice(("div", "section", "ol")), sure=True)


def page(rng: random.Random) -> str:
    """One labelled page."""
    p, r = _Page(rng), rng
    inside = p.article()
    after = [make() for make, chance in ((lambda: p.box("share", p.said("share"), sure=True), 0.3), (p.comments, 0.35), (p.side, 0.25), (p.form, 0.15)) if r.random() < chance]
    if r.random() < 0.12:  # an article's own last lines
        inside += f"<footer>{r.choice((p.said('share'), p.links(1, 4), p.said('foot')))}</footer>"
    within = r.random() < 0.4  # what follows the article stands in the same element
    if within:
        inside += "".join(after)
    shape = r.random()
    if p.tagged and shape < 0.6:
        inside = f"<{(tag := r.choice(('article', 'article', 'main', 'section')))}>{inside}</{tag}>"
    elif p.named and shape < 0.9:
        inside = p.box(r.choice(("article", "content")), inside, r.choice(("div", "div", "section", "td")))
    elif shape < 0.95:
        inside = p.box("plain", inside)
    if r.random() < 0.4:
        inside = p.box(r.choice(("plain", "content")), inside)
    if not within:
        inside += "".join(after)
    before = "".join(make() for make, chance in ((p.notice, 0.3), (p.top, 0.5), (p.menu, 0.6), (lambda: p.box("advert", p.said("advert"), sure=r.random() < 0.9), 0.4), (p.side, 0.15)) if r.random() < chance)
    below = "".join(make() for make, chance in ((p.side, 0.25), (lambda: p.box("advert", p.said("advert"), sure=True), 0.2), (p.form, 0.2), (p.foot, 0.8), (p.notice, 0.2)) if r.random() < chance)
    if r.random() < 0.08:  # pages of the table days: links in one cell, the text in another
        cells = [f"<td>{p.links()}</td>", f"<td>{inside}</td>", f"<td>{r.choice((p.said('more'), p.links(), p.said('advert')))}</td>"]
        inside = f"<table><tr>{''.join(cells[: r.choice((2, 3))] if r.random() < 0.7 else [cells[1], cells[0]])}</tr></table>"
    whole = before + inside + below
    if r.random() < 0.2:
        whole = p.box("plain", whole)
    return f"<!DOCTYPE html><html><head><title>{p.words(2, 6)}</title><style>p{{}}</style></head><body>{whole}" + r.choice(("</body></html>", ""))
