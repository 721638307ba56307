"""Outer contours of dark shapes in an image, in numpy.

A pixel is dark if its grey value is at most ``LEVEL``.  Dark pixels that touch
by a side or a corner are one shape; a shape that lies in a hole of another is
not outer.  The border of a shape is followed pixel by pixel, keeping to its
outside (Suzuki and Abe's border following), from its first pixel in reading
order and down its left side; only pixels at which the direction changes are
points of the contour.
"""

from __future__ import annotations

import numpy as np

# The threshold, the least area, and the weights of blue, green and red in 32768ths.
LEVEL = 150
MIN_AREA = 100
WEIGHTS = np.array([3735, 19235, 9798], np.int64)

#: Steps (down, right) from east, against the clock as seen with y downward.
_STEPS = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey values of an image row: bytes of blue, green, red and maybe alpha, which doesn't count; one channel is grey as it is."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0].astype(np.int64)
    return (pixels[:, :, :3].astype(np.int64) @ WEIGHTS + (1 << 14)) >> 15


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the runs of set pixels, in reading order."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    d = np.diff(wide, axis=1)
    row, first = np.nonzero(d == 1)
    return row, first, np.nonzero(d == -1)[1]


def _met(row: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch; reach 1: corners count."""
    width = int(last.max(initial=0)) + 2
    # of each run, the runs of the next row that end after it begins and begin before it ends
    lo = np.searchsorted(row * width + last, (row + 1) * width + first + 1 - reach)
    hi = np.searchsorted(row * width + first, (row + 1) * width + last + reach)
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    return a, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each reaches over the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def outer_starts(dark: np.ndarray) -> list[tuple[int, int]]:
    """The first pixel of each outer shape, the last found first."""
    height = dark.shape[0]
    # a frame of light pixels: its run in the first row is outside
    framed = np.pad(dark, 1)
    row, first, last = runs(framed)
    shape = labels(len(row), *_met(row, first, last, 1, height + 2))
    light = runs(~framed)
    ground = labels(len(light[0]), *_met(*light, 0, height + 2))
    width = framed.shape[1]
    at = np.flatnonzero(shape == np.arange(len(row)))
    # the light run that ends where the shape's first run begins
    west = np.searchsorted(light[0] * (width + 1) + light[2], row[at] * (width + 1) + first[at])
    keep = ground[west] == 0
    return [(int(r) - 1, int(c) - 1) for r, c in zip(row[at][keep][::-1], first[at][keep][::-1], strict=True)]


def follow(framed: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """(x, y) of the points of an outer border; ``framed`` has a row and a column of light pixels around the image."""
    y0, x0 = start[0] + 1, start[1] + 1
    first = None
    for back in range(1, 8):  # with the clock from the west
        s = (4 - back) % 8
        if framed[y0 + _STEPS[s][0], x0 + _STEPS[s][1]]:
            first = s
            break
    if first is None:
        return [(x0 - 1, y0 - 1)]
    end = (y0 + _STEPS[first][0], x0 + _STEPS[first][1])
    out, came, s, y, x = [], first ^ 4, first, y0, x0
    while True:
        for turn in range(1, 9):  # against the clock from where it came
            t = (s + turn) % 8
            to = (y + _STEPS[t][0], x + _STEPS[t][1])
            if framed[to]:
                break
        if t != came:
            out.append((x - 1, y - 1))
        if to == (y0, x0) and (y, x) == end:
            return out
        came, (y, x), s = t, to, (t + 4) % 8


def area(points: list[tuple[int, int]]) -> float:
    """Of the polygon."""
    x, y = np.array(points, np.int64).T
    return abs(int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def contours(dark: np.ndarray, least: float = MIN_AREA) -> list[tuple[float, list[tuple[int, int]]]]:
    """(area, points) of the outer contours whose area is ``least`` or more."""
    return contours_of([dark], least)[0]


#: Borders that are followed side by side; below, one after another.
FEW = 8


def follow_all(framed: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """``follow`` for many starts (row, column) of one image, a step of all at a time; points as arrays."""
    width = framed.shape[1]
    flat = framed.ravel()
    step = np.array([dy * width + dx for dy, dx in _STEPS])
    begin = (starts[:, 0] + 1) * width + starts[:, 1] + 1
    out: list = [None] * len(starts)
    around = flat[begin[:, None] + step[(4 - np.arange(1, 8)) % 8]]
    for k in np.flatnonzero(~around.any(axis=1)).tolist():
        out[k] = starts[k : k + 1, ::-1]
    live = np.flatnonzero(around.any(axis=1))
    s = (3 - around[live].argmax(axis=1)) % 8
    at, end, came = begin[live], begin[live] + step[s], s ^ 4
    who, where = [], []
    turns = np.arange(1, 9)
    while len(live) >= FEW:
        t = (s[:, None] + turns) % 8
        t = t[np.arange(len(t)), flat[at[:, None] + step[t]].argmax(axis=1)]
        to = at + step[t]
        turned = t != came
        who.append(live[turned])
        where.append(at[turned])
        go = (to != begin[live]) | (at != end)
        live, came, at, s, end = live[go], t[go], to[go], ((t + 4) % 8)[go], end[go]
    done = np.ones(len(starts), bool)
    done[live] = False
    if who:
        k, p = np.concatenate(who), np.concatenate(where)
        by = np.argsort(k, kind="stable")
        k, p = k[by], p[by]
        points = np.stack((p % width - 1, p // width - 1), 1)
        cut = np.searchsorted(k, np.arange(len(starts) + 1))
        for i in np.flatnonzero(done).tolist():
            if out[i] is None:
                out[i] = points[cut[i] : cut[i + 1]]
    for i in live.tolist():
        out[i] = np.array(follow(framed, tuple(starts[i].tolist())), np.int64)
    return out


def contours_of(images: list[np.ndarray], least: float = MIN_AREA) -> list[list[tuple[float, list[tuple[int, int]]]]]:
    """``contours`` of images of one width, stacked with a light row after each."""
    top = np.concatenate(([0], np.cumsum([len(x) + 1 for x in images])))
    width = images[0].shape[1]
    tall = np.zeros((int(top[-1]), width), bool)
    for y, x in zip(top.tolist(), images, strict=False):
        tall[y : y + len(x)] = x
    found: list = [[] for _ in images]
    starts = np.array(outer_starts(tall), np.int64).reshape(-1, 2)
    if len(starts):
        image = np.searchsorted(top, starts[:, 0], "right") - 1
        for i, p in zip(image.tolist(), follow_all(np.pad(tall, 1), starts), strict=True):
            p = p - (0, top[i])
            x, y = p.T
            a = abs(int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2
            if a >= least:
                found[i].append((a, [tuple(q) for q in p.tolist()]))
    return found
