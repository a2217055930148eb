"""Text boxes of images: joining neighbours on a line, and uniting boxes that touch."""

from __future__ import annotations

Box = tuple[str, int, int, int, int]  # text, left, top, width, height


def merge_adjacent(boxes: list[Box], gap: int = 20, drift: int = 5) -> list[Box]:
    """Boxes on one line become one box while the gap to the next is at most ``gap``.

    A box belongs to the first line whose first box has a top within ``drift``. Within a line boxes go from left to
    right; texts join without a separator; the joined box keeps the first top and the largest height.
    """
    lines: list[list[Box]] = []
    for box in boxes:
        line = next((x for x in lines if abs(x[0][2] - box[2]) <= drift), None)
        if line is None:
            lines.append([box])
        else:
            line.append(box)
    merged: list[Box] = []
    for line in lines:
        here: list[Box] = []
        for text, left, top, width, height in sorted(line, key=lambda b: b[1]):
            if here and left - (here[-1][1] + here[-1][3]) <= gap:
                t, x, y, _, h = here[-1]
                here[-1] = (t + text, x, y, left + width - x, max(h, height))
            else:
                here.append((text, left, top, width, height))
        merged += here
    return merged


def unite(boxes: list[tuple[int, int, int, int]], padding: int = 5) -> list[tuple[int, int, int, int]]:
    """(left, top, width, height) boxes, padded on all sides and united until none touch: (left, top, right, bottom), by top, then left."""
    areas = [(x - padding, y - padding, x + w + padding, y + h + padding) for x, y, w, h in boxes]
    while True:
        out: list[tuple[int, int, int, int]] = []
        for a in areas:
            k = next((i for i, b in enumerate(out) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]), None)
            if k is None:
                out.append(a)
            else:
                b = out[k]
                out[k] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        if len(out) == len(areas):
            return sorted(out, key=lambda b: (b[1], b[0]))
        areas = out
