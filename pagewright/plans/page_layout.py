"""Layout steps that depend on what was decided before: gutters, regions, reading order, lines, merged paragraphs.

They run on one page's boxes in memory; pages are dealt over the cluster. Boxes are
parallel lists x0, y0, x1, y1; results are indices into them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import namedtuple

Boxes = namedtuple("Boxes", "x0 y0 x1 y1")
NEAR = 1e-4


def rows(b: Boxes) -> list[list[int]]:
    """Rows from top to bottom, each from left to right. See ``operators.layout.page_rows``."""
    out: list[list[int]] = []
    floor = float("-inf")
    for i in sorted(range(len(b.y0)), key=lambda i: b.y0[i]):
        if b.y0[i] > floor:
            out.append([])
            floor = b.y1[i]
        out[-1].append(i)
    return [sorted(r, key=lambda i: (b.x0[i], b.x1[i])) for r in out]


def uncovered(b: Boxes, row: list[int], left: float, right: float) -> list[tuple[float, float]]:
    """Stretches of a row without a box; the one up to the right margin always counts."""
    out, reach = [], left
    for i in row:
        if b.x0[i] > reach:
            out.append((reach, b.x0[i]))
        reach = max(reach, b.x1[i])
    return [*out, (reach, right)]


def gutters(gaps: list[list[tuple[float, float]]]) -> list[tuple[float, float, int, int]]:
    """(left, right, first row, last row) of stretches that stay free over consecutive rows, by left edge.

    A stretch narrows to what it shares with the next row's, and may part into
    several; touching is sharing. One that shares nothing ends; what nothing shares
    begins anew.
    """
    closed: list[tuple[float, float, int, int]] = []
    held: list[tuple[float, float, int]] = []
    for k, row in enumerate(gaps):
        shared = [(i, j, max(l, a), min(r, z), f) for i, (l, r, f) in enumerate(held) for j, (a, z) in enumerate(row) if max(l, a) <= min(r, z)]
        goes_on, taken = {s[0] for s in shared}, {s[1] for s in shared}
        closed += [(*h, k - 1) for i, h in enumerate(held) if i not in goes_on]
        held = [s[2:] for s in shared] + [(*g, k) for j, g in enumerate(row) if j not in taken]
    closed += [(*h, len(gaps) - 1) for h in held]
    return sorted(closed, key=lambda c: c[0])


class Region:
    """Boxes between two gutters on consecutive rows."""

    def __init__(self, left: float, right: float, top: int):
        self.left, self.right, self.top, self.bottom = left, right, top, top
        self.boxes: list[int] = []
        self.below: list[Region] = []


def regions(b: Boxes) -> list[Region]:
    """All regions in reading order: a region, then those under it from left to right."""
    if not b.x0:
        return []
    page = rows(b)
    left, right = min(b.x0) - 1, max(b.x1) + 1
    cuts = gutters([uncovered(b, r, left, right) for r in page])
    on_row: list[list[tuple[float, float]]] = [[] for _ in page]
    for l, r, first, last in cuts:
        for k in range(first, last + 1):
            on_row[k].append((l, r))

    growing: dict[tuple[float, float], Region] = {}
    done: list[Region] = []
    for k, row in enumerate(page):
        lefts, rights = {g[0] for g in on_row[k]}, {g[1] for g in on_row[k]}
        edges = sorted(lefts | rights)
        for key in list(growing):
            # Both edges go on, and no gutter's edge lies strictly between them.
            if key[0] in rights and key[1] in lefts and bisect_right(edges, key[0]) >= bisect_left(edges, key[1]):
                growing[key].bottom = k
            else:
                done.append(growing.pop(key))
        starts = [g[0] for g in on_row[k][1:]]
        for i in row:
            g = bisect_left(starts, b.x0[i] + NEAR)
            key = (on_row[k][g][1], starts[g])
            growing.setdefault(key, Region(*key, k)).boxes.append(i)
    done += growing.values()

    root = Region(cuts[0][0] - 1, cuts[-1][1] + 1, -1)
    for r in done:
        edge = r.right - 2
        above = [(c.bottom, c.right, -n, c) for n, c in enumerate([root, *done]) if c.bottom < r.top and c.left <= edge <= c.right + NEAR]
        max(above, key=lambda a: a[:3])[3].below.append(r)
        r.boxes.sort(key=lambda i: b.y0[i])

    out: list[Region] = []
    stack = [root]
    while stack:
        r = stack.pop()
        out.append(r)
        stack += sorted(r.below, key=lambda c: c.left)[::-1]
    return out[1:]


class _Shelf:
    """Boxes of like height and top, from left to right; those that are taken are passed over."""

    def __init__(self):
        self.place: list[int] = []  # in the page's order from left to right
        self.left: list[float] = []
        self.after: list[int] = []  # the next one that may be free

    def add(self, place: int, left: float) -> None:
        self.after.append(len(self.place))
        self.place.append(place)
        self.left.append(left)

    def free_from(self, k: int) -> int:
        after, start = self.after, k
        while k < len(after) and after[k] != k:
            k = after[k]
        while start < len(after) and after[start] != k and start != k:
            after[start], start = k, after[start]
        return k

    def take(self, k: int) -> None:
        self.after[k] = k + 1


#: Heights of one class differ by less than this factor; a line takes heights up to it.
_CLASS = 1.5


def _class(height: float) -> int | None:
    return math.floor(math.log(height, _CLASS)) if height > 0 else None


def lines(b: Boxes) -> list[list[int]]:
    """Lines of a single column, by the top of their first box.

    A line starts at the left-most free box and takes, to the right, what stands at
    its first box's height; only the right edge moves along. Boxes are kept on shelves
    by class of height and by top, so that a line looks through the few shelves that can
    hold what it takes, from its edge on.
    """
    order = sorted(range(len(b.x0)), key=lambda i: (b.x0[i], b.y0[i]))
    shelves: dict[tuple[int | None, int], _Shelf] = {}
    where: list[tuple[_Shelf, int]] = []
    for place, i in enumerate(order):
        kind = _class(b.y1[i] - b.y0[i])
        shelf = shelves.setdefault((kind, 0 if kind is None else math.floor(b.y0[i] / _CLASS**kind)), _Shelf())
        where.append((shelf, len(shelf.place)))
        shelf.add(place, b.x0[i])
    out, taken = [], [False] * len(order)
    for start, i in enumerate(order):
        if taken[start]:
            continue
        taken[start] = True
        where[start][0].take(where[start][1])
        height, edge, line = b.y1[i] - b.y0[i], b.x1[i], [i]
        low, high = b.y0[i] - height * 0.5, b.y1[i] + height * 0.5
        near = []
        if height > 0:
            for kind in range(_class(height / _CLASS * (1 - 1e-9)), _class(height * _CLASS * (1 + 1e-9)) + 1):
                side = _CLASS**kind
                near += [shelves[kind, k] for k in range(math.floor(low / side), math.floor(high / side) + 1) if (kind, k) in shelves]
        elif (None, 0) in shelves:
            near = [shelves[None, 0]]
        at = [0] * len(near)
        place = start
        while True:
            best, chosen = len(order), -1
            for n, shelf in enumerate(near):
                k = max(at[n], bisect_left(shelf.left, edge - height), bisect_right(shelf.place, place))
                while (k := shelf.free_from(k)) < len(shelf.place):
                    j = order[shelf.place[k]]
                    other = b.y1[j] - b.y0[j]
                    if b.y0[j] >= low and b.y1[j] <= high and abs(height - other) <= min(height, other) * 0.5:
                        break
                    k += 1
                at[n] = k
                if k < len(shelf.place) and shelf.place[k] < best:
                    best, chosen = shelf.place[k], n
            if chosen < 0:
                break
            near[chosen].take(at[chosen])
            place = best
            taken[place] = True
            line.append(order[place])
            edge = b.x1[order[place]]
        out.append(line)
    return sorted(out, key=lambda line: b.y0[line[0]])


TOLERANCE = 1.2


def bodies(b: Boxes, order: list[int]) -> list[tuple[list[int], float | None]]:
    """Paragraph bodies with their line spacing. See ``operators.layout.paragraph_bodies``."""
    out: list[tuple[list[int], float | None]] = []
    l = r = h = bottom = 0.0
    space: float | None = None
    body: list[int] = []
    for i in order:
        gap, height = b.y0[i] - bottom, b.y1[i] - b.y0[i]
        if body and abs(l - b.x0[i]) <= h * TOLERANCE and abs(r - b.x1[i]) <= h * TOLERANCE and (space is None or gap < space + h * 0.5):
            l, r, h = (l + b.x0[i]) / 2, (r + b.x1[i]) / 2, (h + height) / 2
            space = gap if space is None else (space + gap) / 2
            body.append(i)
        else:
            if body:
                out.append((body, space))
            body, l, r, h, space = [i], b.x0[i], b.x1[i], height, None
        bottom = b.y1[i]
    return [*out, (body, space)] if body else out


def _ends_above(b: Boxes, i: int, above: tuple[list[int], float | None]) -> bool:
    """Whether box i can be the last line of the paragraph above it: aligned on the left, no longer, not too far."""
    last, space = above[0][-1], above[1]
    h = b.y1[last] - b.y0[last]
    fits = abs(b.x0[last] - b.x0[i]) <= h * TOLERANCE and b.x1[i] <= b.x1[last] + h * TOLERANCE
    return fits and not (space is not None and b.y0[i] - b.y1[last] > space + h * 0.5)


def _begins_below(b: Boxes, i: int, below: tuple[list[int], float | None]) -> bool:
    """Whether box i can be the first line of the paragraph below it: aligned or indented; reaching the right edge, or past it if that is one line."""
    first, space = below[0][0], below[1]
    h = b.y1[first] - b.y0[first]
    if not b.x0[first] - h * TOLERANCE <= b.x0[i] <= b.x0[first] + h * (1 + TOLERANCE):
        return False
    reaches = abs(b.x1[first] - b.x1[i]) <= h * TOLERANCE if len(below[0]) > 1 else b.x1[first] - h * TOLERANCE < b.x1[i]
    return reaches and not (space is not None and b.y0[first] - b.y1[i] > space + h * 0.5)


def paragraphs(b: Boxes, order: list[int]) -> list[list[int]]:
    """Paragraphs of a region's lines: bodies, with single lines taken in from the last to the first."""
    found = bodies(b, sorted(order, key=lambda i: b.y0[i]))
    for k in range(len(found) - 1, -1, -1):
        if len(found[k][0]) > 1:
            continue
        i = found[k][0][0]
        up = k > 0 and _ends_above(b, i, found[k - 1])
        down = k + 1 < len(found) and _begins_below(b, i, found[k + 1])
        if up and down:
            up = b.y0[i] - b.y1[found[k - 1][0][-1]] < b.y0[found[k + 1][0][0]] - b.y1[i]
        if up:
            found[k - 1][0].append(i)
        elif down:
            found[k + 1][0].insert(0, i)
        if up or down:
            del found[k]
    return [body for body, _ in found]
