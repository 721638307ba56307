"""Contours against flood fill and by hand; images through Spark's source."""

import struct
import zlib

import numpy as np
import pytest

from caseloom.functions import contours as c
from caseloom.plans import ingest


def flood(mask, corners):
    """Components by plain flood fill, in reading order of their first pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, own = [(int(y), int(x))], set()
        while todo:
            p = todo.pop()
            if p in own or not (0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]) or not mask[p]:
                continue
            own.add(p)
            seen[p] = True
            todo += [(p[0] + dy, p[1] + dx) for dy, dx in steps]
        out.append(own)
    return out


def outer(dark):
    framed = np.pad(dark, 1)
    outside = next(o for o in flood(~framed, False) if (0, 0) in o)
    return [own for own in flood(dark, True) if any((y + 1 + dy, x + 1 + dx) in outside for y, x in own for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))]


def spelt(points):
    """All pixels on the way from point to point."""
    out = []
    for (x, y), (x2, y2) in zip(points, points[1:] + points[:1]):
        n = max(abs(x2 - x), abs(y2 - y))
        assert n == 0 or ((x2 - x) in (0, n, -n) and (y2 - y) in (0, n, -n))
        out += [(x + i * np.sign(x2 - x), y + i * np.sign(y2 - y)) for i in range(n)] or [(x, y)]
    return {(int(a), int(b)) for a, b in out}


@pytest.mark.parametrize("seed", range(60))
def test_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    dark = rng.random(rng.integers(1, 22, 2)) < rng.choice([0.2, 0.45, 0.6, 0.8])
    want = outer(dark)
    found = [c.follow(np.pad(dark, 1), s) for s in c.outer_starts(dark)]
    assert len(found) == len(want)
    for points, own in zip(found, reversed(want)):
        # every pixel of the way belongs to the shape, and a polygon fill of it covers the shape's outline
        way = spelt(points)
        assert way <= {(x, y) for y, x in own}
        first = min(own)
        assert points[0] == (first[1], first[0]) or (first[1], first[0]) in way
        grown = np.zeros((dark.shape[0] + 2, dark.shape[1] + 2), bool)
        for y, x in own:
            grown[y + 1, x + 1] = True
        outside = next(o for o in flood(~grown, False) if (0, 0) in o)
        touch = {(x, y) for y, x in own if any((y + 1 + dy, x + 1 + dx) in outside for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        assert way == touch
        # Pick's theorem: twice the area of the border walk
        filled = {(y - 1, x - 1) for y in range(grown.shape[0]) for x in range(grown.shape[1]) if (y, x) not in outside}
        if len(own) > 2 and all(sum((y + dy, x + dx) in filled for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))) > 1 for y, x in filled):
            assert c.area(points) <= len(filled)


def test_by_hand():
    dark = np.zeros((30, 40), bool)
    dark[5:20, 10:25] = True
    dark[8:15, 13:20] = False
    dark[10:12, 15:17] = True  # in the hole: not outer
    dark[25, 30] = True
    (one,) = c.contours(dark)
    assert one == (14 * 14, [(10, 5), (10, 19), (24, 19), (24, 5)])
    assert [p for _, p in c.contours(dark, 0)][0] == [(30, 25)]
    assert c.contours(np.zeros((5, 5), bool)) == [] and c.contours(np.ones((11, 11), bool))[0][0] == 100
    assert c.contours(np.ones((11, 10), bool)) == []
    triangle = np.tril(np.ones((20, 20), bool))
    assert c.contours(triangle)[0] == (19 * 19 / 2, [(0, 0), (0, 19), (19, 19)])


def png(pixels):
    """A PNG file of 8-bit grey or colour."""
    h, w = pixels.shape[:2]
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    kind = 0 if pixels.ndim == 2 else 2
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_files(spark, tmp_path):
    base = np.full((60, 80, 3), 255, np.uint8)
    base[10:40, 20:50] = (200, 30, 40)
    base[50:55, 5:10] = 0  # small
    (tmp_path / "a.png").write_bytes(png(base))
    (tmp_path / "b.png").write_bytes(png(np.where(np.arange(50)[:, None] < 25, 150, 151).astype(np.uint8) * np.ones((1, 30), np.uint8)))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "d.png").write_bytes(png(base)[:40])
    pictures = ingest.images(spark, str(tmp_path))
    assert pictures.count() == 4
    got = {r.origin.rsplit("/", 1)[1]: r for r in ingest.graphs(pictures).collect()}
    assert set(got) == {"a.png", "b.png"}
    a = got["a.png"]
    assert (a.n, a.type, a.area, a.width, a.height) == (0, "graph", 29 * 29, 80, 60)
    assert [tuple(p) for p in a.coordinates] == [(20, 50), (20, 21), (49, 21), (49, 50)]
    assert [tuple(p) for p in got["b.png"].coordinates] == [(0, 50), (0, 26), (29, 26), (29, 50)]
    files = pictures.selectExpr("origin as path", "1 as n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in ingest.graphs_of_files(files, ingest.graphs(pictures)).collect()}
    assert len(rows["a.png"].graphs) == 1 and rows["a.png"].graphs[0].height == 60 and rows["c.pdf"].graphs == [] == rows["d.png"].graphs


def test_odd_rows(spark):
    ddl = "origin string, height int, width int, nChannels int, mode int, data binary"
    rows = [(None, 20, 20, 1, 0, bytes(400)), ("x", 20, 20, 1, 0, bytes(399)), ("y", None, 1, 1, 0, b"a"), ("z", 0, 0, 0, 0, b""), ("w", 20, 20, 4, 24, bytes(1600)), ("v", 1, 1, 3, 16, None)]
    got = ingest.graphs(spark.createDataFrame(rows, ddl)).collect()
    assert sorted((r.origin or "", r.area) for r in got) == [("", 361), ("w", 361)]
    assert ingest.graphs(spark.createDataFrame([], ddl)).collect() == []


def test_many_images_together_as_one_by_one(monkeypatch):
    import numpy as np

    from caseloom.functions import contours as c

    rng = np.random.default_rng(5)
    images = [rng.random((int(rng.integers(1, 30)), 23)) < d for d in np.linspace(0.02, 0.98, 60)]
    one = [[(c.area(p), p) for p in (c.follow(np.pad(x, 1), s) for s in c.outer_starts(x))] for x in images]
    monkeypatch.setattr(c, "follow", None)  # side by side, not border by border
    monkeypatch.setattr(c, "FEW", 1)
    assert c.contours_of(images, 0) == one
    monkeypatch.undo()
    assert c.contours_of(images, 0) == one
