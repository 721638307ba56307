"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a chain of leaf blocks (``dom.blocks``).  A block's features are the
tags and telling names of its ancestors, and its text: length, links,
punctuation, stock words, the share of the page's text that stands in the same
element.  The chain has two states, article and rest; its transitions depend on
whether two neighbours stand in the same element.  It is trained by forward and
backward sums on labelled pages (``layouts.page``: no table labels pages) and
decoded by Viterbi.  Pages never meet: one pass, no shuffle.

The article's text is that of its blocks in page order, one line each, white
space collapsed, character references decoded.  Text of scripts, styles, buttons,
option lists, text areas, templates and embedded objects, comments of the markup
and attributes belong to no block.

Rows: null html is an empty page; a page without article has an empty text; a
page that isn't HTML is one block; repeated rows count each; null ids and urls stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.common import lean, small_batches
from caseloom.llm.dom import Block, blocks
from caseloom.llm.layouts import MARK, page

#: Labelled pages that are learnt, the seed of the first, and rounds of training.
PAGES = 900
SEED = 7
ROUNDS = 100
#: Pages of about one length that are summed together.
GROUP = 150
RATE = 0.15
DECAY = 1e-4

#: Stock words of what stands around articles, in four languages. Fixed values.
STOCK = {
    "rights": "copyright rights reserved rechte vorbehalten derechos reservados droits réservés impressum powered",
    "cookie": "cookie cookies consent gdpr javascript",
    "join": "subscribe newsletter sign login password email suscríbase anmelden abonner search",
    "share": "share tweet facebook tags print teilen compartir partager",
    "more": "related popular recommended also mehr leído lire",
    "reply": "reply comments comment says replies",
    "advert": "advertisement sponsored anzeige publicidad publicité",
    "legal": "privacy terms policy datenschutz privacidad",
}
_STOCK = {w: k for k, words in STOCK.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of a block that are looked at for stock words; the block's length counts in full.
LOOK = 200


def _step(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def features(chain: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    total = sum(len(b.text) for b in chain) or 1
    plain = Counter()
    same, about, many = Counter(), Counter(), Counter()
    for b in chain:
        same[b.around] += len(b.text) - b.linked
        many[b.around] += 1
        about[b.own] += 1
        plain[b.own] += len(b.text) - b.linked
    out = []
    for i, b in enumerate(chain):
        text, n = b.text, len(b.text)
        words = text.count(" ") + 1
        share = b.linked / n
        marks = sum(text.count(c) for c in ".!?,;:")
        last = text[-1]
        f = [
            *b.above,
            f"tag:{b.tag}",
            f"long:{_step(n, (4, 12, 25, 50, 100, 200, 400, 1000))}",
            f"linked:{_step(share, (0.01, 0.2, 0.5, 0.9))}",
            f"links:{_step(b.links, (1, 2, 4))}",
            f"marks:{_step(marks / words, (0.01, 0.08, 0.2, 0.5))}",
            f"around:{_step(same[b.around] / total, (0.02, 0.1, 0.3, 0.6, 0.9))}",
            f"beside:{_step(many[b.around], (2, 3, 5, 9, 20))}",
            f"own:{_step(plain[b.own] / total, (0.02, 0.1, 0.3, 0.6))}",
            f"place:{_step(i / len(chain), (0.02, 0.1, 0.3, 0.6, 0.9))}",
            f"share:{_step(n / total, (0.01, 0.05, 0.2, 0.5))}",
            "stops" if last in ".!?…\"”»" else "goes on",
            "capital" if text[0].isupper() else "no capital",
        ]
        if about[b.own] > 1:
            f.append("pieces")
        if "©" in text[:LOOK] or "(c)" in text[:LOOK]:
            f.append("stock:rights")
        told = {_STOCK[w] for w in _WORD.findall(text[:LOOK].lower()) if w in _STOCK}
        f += [f"stock:{k}" for k in told]
        if n < 60:
            f += [f"short stock:{k}" for k in told]
        if not any(x.startswith("says:") for x in b.above):
            f.append("says nothing")
        out.append(f)
    return out


def _together(chain: list[Block]) -> np.ndarray:
    """Of each block but the first: 0 in the same element as the one before, 1 around or inside it, 2 elsewhere."""
    out = np.full(max(len(chain) - 1, 0), 2)
    for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False)):
        if a.around == b.around:
            out[i] = 0
        elif a.own == b.around or b.own == a.around or a.own == b.own:
            out[i] = 1
    return out


class Field:
    """Weights of the chain: features x states, kinds of neighbours x states x states, first and last states."""

    def __init__(self, names: dict[str, int], weight: np.ndarray, step: np.ndarray, ends: np.ndarray):
        self.names, self.weight, self.step, self.ends = names, weight, step, ends

    def scores(self, chain: list[Block]) -> np.ndarray:
        out = np.zeros((len(chain), 2))
        for i, f in enumerate(features(chain)):
            known = [self.names[x] for x in f if x in self.names]
            out[i] = self.weight[known].sum(0)
        return out

    def decode(self, chain: list[Block]) -> list[bool]:
        """Viterbi: the likeliest states; ties go to the rest."""
        if not chain:
            return []
        score, kind, step, ends = self.scores(chain).tolist(), _together(chain).tolist(), self.step.tolist(), self.ends.tolist()
        a, b = score[0][0] + ends[0][0], score[0][1] + ends[0][1]
        back = []
        for (x, y), k in zip(score[1:], kind, strict=True):
            t = step[k]
            from_a, from_b = (a + t[0][0] >= b + t[1][0]), (a + t[0][1] >= b + t[1][1])
            back.append((not from_a, not from_b))
            a, b = x + (a + t[0][0] if from_a else b + t[1][0]), y + (a + t[0][1] if from_b else b + t[1][1])
        state = b + ends[1][1] > a + ends[1][0]
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def gradients(score, kind, size, truth, step, ends):
    """Log-likelihood of padded chains (pages x blocks x 2), and its gradients by scores, steps and ends."""
    n, m, _ = score.shape
    rows = np.arange(n)
    fore = np.empty((m, n, 2))
    fore[0] = score[:, 0] + ends[0]
    for i in range(1, m):
        fore[i] = score[:, i] + _log_sum(fore[i - 1][:, :, None] + step[kind[:, i - 1]], 1)
    aft = np.zeros((m, n, 2))
    for i in range(m - 1, -1, -1):
        at_end = (i == size - 1)[:, None]
        if i < m - 1:
            aft[i] = _log_sum(step[kind[:, i]] + (score[:, i + 1] + aft[i + 1])[:, None, :], 2)
        aft[i] = np.where(at_end, ends[1], aft[i])
    z = _log_sum(fore[size - 1, rows] + ends[1], 1)
    live = np.arange(m)[None, :] < size[:, None]
    p = np.exp(np.swapaxes(fore + aft, 0, 1) - z[:, None, None]) * live[:, :, None]
    gold = np.eye(2)[truth] * live[:, :, None]
    d_step, like = np.zeros_like(step), (score * gold).sum() + (gold[:, 0] * ends[0]).sum() + (gold[rows, size - 1] * ends[1]).sum() - z.sum()
    for i in range(1, m):
        on = live[:, i]
        pair = fore[i - 1][:, :, None] + step[kind[:, i - 1]] + (score[:, i] + aft[i])[:, None, :]
        expected = np.exp(pair - z[:, None, None]) * on[:, None, None]
        seen = gold[:, i - 1][:, :, None] * gold[:, i][:, None, :]
        for k in range(len(step)):
            d_step[k] += (seen - expected)[kind[:, i - 1] == k].sum(0)
        like += (seen * step[kind[:, i - 1]]).sum()
    d_ends = np.stack(((gold - p)[:, 0].sum(0), (gold - p)[rows, size - 1].sum(0)))
    return like, gold - p, d_step, d_ends


class _Group:
    """Chains of about one length, padded."""

    def __init__(self, chains: list, told: list, names: dict[str, int]):
        self.size = np.array([len(c) for c, _ in chains])
        n, m = len(chains), int(self.size.max())
        self.truth, self.kind = np.zeros((n, m), np.int64), np.full((n, max(m - 1, 1)), 2)
        # which features stand in which cells
        self.on = np.zeros((n * m, len(names)), np.float32)
        for i, ((c, t), fs) in enumerate(zip(chains, told, strict=True)):
            self.truth[i, : len(c)] = t
            self.kind[i, : len(c) - 1] = _together(c)
            for j, f in enumerate(fs):
                self.on[i * m + j, [names[x] for x in f if x in names]] = 1

    def gradients(self, weight, step, ends):
        score = (self.on @ weight.astype(np.float32)).astype(np.float64).reshape(*self.truth.shape, 2)
        _, d_score, d_step, d_ends = gradients(score, self.kind, self.size, self.truth, step, ends)
        return (self.on.T @ d_score.reshape(-1, 2).astype(np.float32)).astype(np.float64), d_step, d_ends


def train(pages: Iterable[tuple[list[Block], list[bool]]], rounds: int = ROUNDS) -> Field:
    """A field from chains and whether each block is the article's. Every feature that occurs at least twice is learnt."""
    chains = sorted(((c, t) for c, t in pages if c), key=lambda x: len(x[0]))
    told = [features(c) for c, _ in chains]
    often = Counter(x for page_ in told for f in page_ for x in f)
    names = {x: i for i, x in enumerate(sorted(x for x, n in often.items() if n > 1))}
    parts = [np.zeros((len(names), 2)), np.zeros((3, 2, 2)), np.zeros((2, 2))]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    groups = [_Group(chains[i : i + GROUP], told[i : i + GROUP], names) for i in range(0, len(chains), GROUP)]
    for r in range(1, rounds + 1):
        total = [np.zeros_like(p) for p in parts]
        for g in groups:
            for t, d in zip(total, g.gradients(*parts), strict=True):
                t += d
        for p, g, v, s in zip(parts, total, mean, square, strict=True):
            g = g / len(chains) - DECAY * p
            v += 0.1 * (g - v)
            s += 0.01 * (g * g - s)
            p += RATE * (v / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
    return Field(names, *parts)


def labelled(html: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page whose article carries MARK, and which those are; the marks are gone."""
    chain = blocks(html)
    truth = [MARK in b.text for b in chain]
    for b in chain:
        b.text = b.text.replace(MARK, "") or "-"
    return chain, truth


@functools.cache
def learnt(pages: int = PAGES, seed: int = SEED, rounds: int = ROUNDS) -> Field:
    """The field of the first ``pages`` labelled pages; trained once a driver."""
    return train((labelled(page(random.Random(f"{seed}-{i}"))) for i in range(pages)), rounds)


def extract(html: str | None, field: Field) -> str:
    """The article's text."""
    chain = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(chain, field.decode(chain), strict=True) if keep)


def _extracted(field: Field):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, field) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return work


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html); ``field``: another one than the learnt."""
    small_batches(pages.sparkSession)
    base = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return base.mapInArrow(lean(_extracted(field or learnt())), "page_id long, url string, text string, n_chars long")
