"""Counting the points of a layout around its points, through boxes.

The points of a space are sorted into strips of equal size by x and those into boxes by y. All of a box that is nearer
than a distance counts at once, a box that is farther does not count, and only points of boxes in between are looked at.
Box distances are rounded as point distances are, so a box never hides a tie.
"""

from __future__ import annotations

import numpy as np

BOX = 64
MOST_POINTS = 1 << 22  # of all spaces together, as they are broadcast
CELLS = 1 << 20


class Boxes:
    """The points of one space; ``ids`` ascending."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.at = ids[order], at[order]
        n = len(ids)
        boxes = -(-n // BOX)
        strips = max(1, int(np.sqrt(boxes)))
        strip = np.empty(n, "int64")
        strip[np.argsort(self.at[:, 0], kind="stable")] = np.arange(n) * strips // max(n, 1)
        self.order = np.lexsort((self.at[:, 1], strip))
        self.start = np.arange(0, n, BOX)
        sorted_ = self.at[self.order]
        self.x, self.y = np.ascontiguousarray(sorted_[:, 0]), np.ascontiguousarray(sorted_[:, 1])
        self.low = np.minimum.reduceat(sorted_, self.start, axis=0)
        self.high = np.maximum.reduceat(sorted_, self.start, axis=0)
        self.size = np.diff(np.append(self.start, n))
        self.box = np.empty(n, "int64")
        self.box[self.order] = np.arange(n) // BOX

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places to places, with the bits of the block search."""
        d = self.at[a] - self.at[b]
        return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])

    def closer(self, centre: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per look-up: how many points but the centre come before ``other`` by (distance to ``centre``, id); arguments are places."""
        order = np.argsort(centre, kind="stable")  # look-ups around one point share its distances to the boxes
        out = np.zeros(len(centre), "int64")
        step = max(1, CELLS // max(len(self.size), 1))
        for lo in range(0, len(centre), step):
            part = order[lo : lo + step]
            out[part] = self._closer(centre[part], other[part])
        return out

    def _closer(self, centre, other):
        t = self.distance(centre, other)
        points, who = np.unique(centre, return_inverse=True)
        near, far = self._reach(points)
        whole = far[who] < t[:, None]
        out = whole.astype("float32") @ self.size.astype("float32") if len(self.ids) < 1 << 24 else whole @ self.size
        out = out.astype("int64") - whole[np.arange(len(t)), self.box[centre]]
        open_ = near[who] <= t[:, None]
        open_ &= ~whole
        line, box = np.divmod(np.flatnonzero(open_), len(self.size))
        size = self.size[box]
        ends = np.cumsum(size)
        place = np.repeat(self.start[box] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        x, y = (np.repeat(self.at[centre[line], axis], size) - v[place] for axis, v in enumerate((self.x, self.y)))
        line = np.repeat(line, size)
        x *= x
        y *= y
        x += y
        d, target = np.sqrt(x, out=x), t[line]
        before = d < target
        tie = np.flatnonzero(d == target)
        before[tie] = self.order[place[tie]] < other[line[tie]]
        before[self.order[place] == centre[line]] = False
        return out + np.bincount(line[before], minlength=len(t))

    def _reach(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of points to the nearest and farthest place of every box."""
        near, far = np.zeros((2, len(centre), len(self.size)))
        for axis in (0, 1):
            x = self.at[centre, axis][:, None]
            below, above = self.low[:, axis][None, :] - x, x - self.high[:, axis][None, :]
            gap = np.maximum(np.maximum(below, above), 0.0)
            near += gap * gap
            reach = np.maximum(-below, -above)
            far += reach * reach
        return np.sqrt(near), np.sqrt(far)
