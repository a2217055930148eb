"""Covering areas of images: coarse pixels, blur, or one colour. Images are height x width x 3 arrays."""

from __future__ import annotations

import numpy as np

Area = tuple[int, int, int, int]  # left, top, right, bottom


def _inside(image: np.ndarray, area: Area) -> Area | None:
    x1, y1, x2, y2 = max(0, area[0]), max(0, area[1]), min(image.shape[1], area[2]), min(image.shape[0], area[3])
    return (x1, y1, x2, y2) if x1 < x2 and y1 < y2 else None


def pixel(image: np.ndarray, area: Area, block_size: int = 10) -> np.ndarray:
    """The area sampled to one pixel for each block and enlarged again, nearest pixel both times."""
    out, box = image.copy(), _inside(image, area)
    if box is None:
        return out
    x1, y1, x2, y2 = box
    height, width = y2 - y1, x2 - x1
    block = max(1, block_size)
    rows, columns = max(1, height // block), max(1, width // block)
    pick = lambda n, m: ((np.arange(m) + 0.5) * n / m).astype(int)  # noqa: E731  centres of m cells over n
    small = out[y1:y2, x1:x2][pick(height, rows)][:, pick(width, columns)]
    out[y1:y2, x1:x2] = small[pick(rows, height)][:, pick(columns, width)]
    return out


def blur(image: np.ndarray, area: Area, radius: int = 15) -> np.ndarray:
    """The area blurred on its own, by three running means of the variance of a Gaussian of that radius."""
    out, box = image.copy(), _inside(image, area)
    if box is None:
        return out
    x1, y1, x2, y2 = box
    part = out[y1:y2, x1:x2].astype(float)
    half = max(1, int(round((np.sqrt(4 * max(1, radius) ** 2 + 1) - 1) / 2)))
    for axis in (0, 1) * 3:
        n = part.shape[axis]
        padded = np.concatenate([np.repeat(np.take(part, [0], axis), half + 1, axis), part, np.repeat(np.take(part, [n - 1], axis), half, axis)], axis)
        total = np.cumsum(padded, axis)
        part = (np.take(total, np.arange(n) + 2 * half + 1, axis) - np.take(total, np.arange(n), axis)) / (2 * half + 1)
    out[y1:y2, x1:x2] = np.clip(np.rint(part), 0, 255).astype(image.dtype)
    return out


def fill(image: np.ndarray, area: Area, fill_color: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """One colour, right and bottom edge included."""
    out = image.copy()
    box = _inside(image, (area[0], area[1], area[2] + 1, area[3] + 1)) if area[0] <= area[2] and area[1] <= area[3] else None
    if box is not None:
        out[box[1] : box[3], box[0] : box[2]] = fill_color
    return out


STYLES = {"pixel": pixel, "blur": blur, "fill": fill}


def cover(image: np.ndarray, areas: list[Area], style: str = "pixel", **options) -> np.ndarray:
    """Each area in turn."""
    if style not in STYLES:
        raise ValueError(f"unknown mosaic style: {style}")
    for area in areas:
        image = STYLES[style](image, area, **options)
    return image
