"""HTML to leaf blocks: runs of text between block boundaries, with what their ancestors say.

A small tree builder in one pass over the page: tags, attributes, raw text,
comments and implied ends as browsers read them, in time linear in the page.
Only open elements are kept; each carries the features of its ancestors, of
which there are a fixed number, so deep nesting costs no more than its depth.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

_BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html ins legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
BLOCK = frozenset(_BLOCKS.split()) - {"ins"}
#: Elements whose text is no part of the page's text.
UNSEEN = frozenset("audio button canvas head iframe math noembed noframes object script select style svg template textarea title video xmp".split())
#: Elements whose content isn't markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset("br img input hr wbr".split()) - {"wbr"}
#: An opening tag ends an open element of these, down to the scopes.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}

#: What words in class, id, role and similar attributes say. Fixed values.
HINTS = {
    "comments": "comment comments commentlist disqus reply replies respond discussion reader readers review reviews feedback",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap skip tabs toolbar",
    "side": "sidebar aside side rail widget widgets complementary related recommended recommend more popular trending teaser teasers",
    "foot": "footer foot bottom colophon contentinfo copyright legal imprint disclaimer",
    "top": "header masthead top topbar banner logo branding site",
    "advert": "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted outbrain taboola dfp gpt",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog paywall warning message toast announcement",
    "form": "form login signin signup subscribe subscription newsletter search register contact",
    "share": "share sharing social follow twitter facebook tags tag byline meta metadata author",
    "hidden": "hidden invisible offscreen",
    "article": "article post entry story blog hentry news",
    "content": "content body text main page prose markdown document parser output inner column",
}
_HINT = {w: h for h, words in HINTS.items() for w in words.split()}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_FAST = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)((?:[^<>\"'=]|=(?!\s*[\"'])|=\s*+\"[^\"<>]*+\"|=\s*+'[^'<>]*+')*+)>")
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_ATTR = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)?(\s*+=\s*+)?")
_PAIR = re.compile(r"([^\s/>=\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|([^\s/>=\"']++)")
_BARE = re.compile(r"[^\s>]*+")
_TELLING = frozenset("class id role aria-label itemprop data-testid".split())


def _told(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an opening tag; those of short tags are remembered."""
    return (_told_once if len(attributes) < 200 else _told_once.__wrapped__)(tag, attributes)


@lru_cache(maxsize=1 << 14)
def _told_once(tag: str, attributes: str) -> tuple[str, ...]:
    found = {f"in:{tag}"}
    for name, a, b, c, bare in _PAIR.findall(attributes):
        name = (name or bare).lower()
        value = a or b or c
        if name in _TELLING:
            found |= {f"says:{_HINT[w]}" for w in (w.lower() for w in _WORD.findall(value)) if w in _HINT}
            if name == "itemprop" and value.lower() == "articlebody":
                found.add("says:content")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.add("says:hidden")
    return tuple(sorted(found))


class Block:
    """text; characters in links; number of links; ancestors' features; the tag it is in; that element and the one around it."""

    __slots__ = ("text", "linked", "links", "above", "tag", "own", "around")

    def __init__(self, text, linked, links, above, tag, own, around):
        self.text, self.linked, self.links, self.above, self.tag, self.own, self.around = text, linked, links, above, tag, own, around


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed; those without text are left out."""
    out: list[Block] = []
    # open elements: tag, features of it and above, number
    stack: list[tuple[str, frozenset, int]] = [("#", frozenset(), 0)]
    count: Counter = Counter()
    number, at, n = 0, 0, len(html)
    text: list[str] = []
    links = linked = in_link = unseen = 0

    def flush() -> None:
        nonlocal links, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                tag, above, own = stack[-1]
                out.append(Block(words, linked, links, above, tag, own, stack[-2][2] if len(stack) > 1 else 0))
            text.clear()
        links = linked = 0

    def pop_to(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            tag = stack.pop()[0]
            count[tag] -= 1
            if tag in UNSEEN:
                unseen -= 1

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not unseen:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = _FAST.match(html, lt)
        if m:
            closing, name, attributes = m.groups()
            at = m.end()
        else:
            m = _NAME.match(html, lt + 1)
            if m is None:
                if html.startswith("<!--", lt):
                    if html.startswith((">", "->"), lt + 4):
                        at = html.find(">", lt) + 1
                        continue
                    ends = [i for i in (html.find("-->", lt + 4), html.find("--!>", lt + 4)) if i >= 0]
                    if not ends:
                        break
                    at = html.find(">", min(ends)) + 1
                elif html.startswith(("<!", "<?", "</"), lt):
                    at = html.find(">", lt) + 1
                    if not at:
                        break
                else:
                    add("<")
                    at = lt + 1
                continue
            closing, name = m.groups()
            at = start = m.end()
            while at < n and html[at] != ">":
                a = _ATTR.match(html, at)
                at = a.end()
                if a.group(2):
                    quote = html[at : at + 1]
                    at = html.find(quote, at + 1) + 1 if quote in ('"', "'") and quote else _BARE.match(html, at).end()
                    if not at:
                        at = n
                elif not a.group(0) and at < n and html[at] != ">":
                    at += 1
            if at >= n:
                break  # the page ends inside a tag
            attributes, at = html[start:at], at + 1
        name = name.lower()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                flush()
                if count[name]:
                    while True:
                        top = stack[-1][0]
                        pop_to(len(stack) - 1)
                        if top == name:
                            break
            elif name in UNSEEN and count[name]:
                while stack[-1][0] != name:
                    pop_to(len(stack) - 1)
                pop_to(len(stack) - 1)
            continue
        if name in _SPACE and name != "hr":
            if not unseen:
                text.append(" ")
            continue
        if name == "a":
            in_link = 1
            if not unseen:
                links += 1
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            if end is None:
                break
            at = html.find(">", end.end())
            at = n if at < 0 else at + 1
            continue
        if name in BLOCK:
            flush()
            in_link = 0
            if count["p"]:
                # an open paragraph ends where a block begins, unless something else stands between
                i = len(stack) - 1
                if stack[i][0] == "p":
                    pop_to(i)
            if name in _SIBLINGS and any(count[t] for t in _SIBLINGS[name][0]):
                same, scope = _SIBLINGS[name]
                i = len(stack) - 1
                while i and stack[i][0] not in same and stack[i][0] not in scope:
                    i -= 1
                if stack[i][0] in same:
                    pop_to(i)
            if name in VOID:
                continue
        elif name not in UNSEEN and name != "noscript" or name in VOID:
            if name not in VOID and name == "body":
                flush()
            continue
        if name == "noscript":
            continue
        number += 1
        above = stack[-1][1]
        told = _told(name, attributes)
        if not above.issuperset(told):
            above = above.union(told)
        stack.append((name, above, number))
        count[name] += 1
        if name in UNSEEN:
            unseen += 1
    flush()
    return out
