"""POLYGON and MULTIPOLYGON texts as numpy arrays, one by one or a batch at once."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PART = re.compile(r"\(((?:\s*\([^()]*\)\s*,?)+)\)")
_RING = re.compile(r"\(([^()]*)\)")
_N = r"[-+0-9.eE]++"
_USUAL_RING = rf"\(\s*+{_N}\s++{_N}(?:\s*+,\s*+{_N}\s++{_N})++\s*+\)\s*+"
_USUAL_PART = rf"\(\s*+{_USUAL_RING}(?:,\s*+{_USUAL_RING})*+\)\s*+"
_USUAL = re.compile(rf"(?i)\s*+(?:POLYGON\s*+{_USUAL_PART}|MULTIPOLYGON\s*+\(\s*+{_USUAL_PART}(?:,\s*+{_USUAL_PART})*+\)\s*+)")
_BLANKS = bytes(32 if c in b"(),POLYGNMUTIpolygnmuti\t\r\n\f\v" else c for c in range(256))
_SHAPE = {ord(c): None for c in "0123456789+-.eE \t\r\n\f\vPOLYGNMUTIpolygnmuti"}


def rings_of(wkt: str) -> list[list[np.ndarray]]:
    """The parts of a POLYGON or MULTIPOLYGON text, each a list of rings of (x, y); [] if it has none."""
    if not wkt or "POLYGON" not in wkt[:40].upper():
        return []
    parts = []
    for body in _PART.findall(wkt):
        rings = []
        for ring in _RING.findall(body):
            n, numbers = ring.count(",") + 1, ring.replace(",", " ").split()
            try:
                if len(numbers) == 2 * n:
                    points = np.array([*map(float, numbers)]).reshape(n, 2)
                else:  # heights, or not a ring of positions
                    points = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
            except ValueError:
                return []
            if points.ndim != 2 or points.shape[1] != 2 or len(points) < 3 or not np.isfinite(points).all():
                return []
            rings.append(points)
        parts.append(rings)
    return parts


@dataclass
class Rings:
    """Rings of a batch of texts: vertices one after the other, and each ring's size, text and part within the text."""

    xy: np.ndarray
    size: np.ndarray
    owner: np.ndarray
    part: np.ndarray
    texts: int

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @property
    def hole(self) -> np.ndarray:
        """Whether each ring isn't the first of its part."""
        if not len(self.size):
            return np.empty(0, dtype=bool)
        return ~np.append(True, (self.owner[1:] != self.owner[:-1]) | (self.part[1:] != self.part[:-1]))

    def follow(self) -> np.ndarray:
        """The vertex after each vertex, around its ring."""
        out = np.arange(1, len(self.xy) + 1)
        out[self.start + self.size - 1] = self.start
        return out


@lru_cache(maxsize=1 << 14)
def _shape(skeleton: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(points, part) of each ring, from a text's parentheses and commas."""
    parts = re.findall(r"\((?:\(,*\),?)+\)", skeleton)
    rings = [(len(r) - 1, k) for k, part in enumerate(parts) for r in re.findall(r"\(,*\)", part)]
    return tuple(n for n, _ in rings), tuple(k for _, k in rings)


def _numbers(texts: list[bytes]) -> np.ndarray | None:
    """All numbers of the texts, one after the other; None if one of them isn't finite or no number."""
    if not texts:
        return np.empty(0)
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([b" ".join(texts)], pa.large_binary()).cast(pa.large_string())))
    try:
        values = words.flatten().cast(pa.float64()).to_numpy()
    except pa.ArrowInvalid:
        return None
    return values if np.isfinite(values).all() else None


def parse_batch(wkts: Iterable[str | None]) -> Rings:
    """rings_of for all texts at once: shapes are looked up and numbers read in one array; unusual texts go through rings_of."""
    found: list[tuple[int, tuple, tuple, np.ndarray | None]] = []  # text, points and parts of its rings, vertices of unusual ones
    plain: list[bytes] = []
    wkts = list(wkts)
    for n, wkt in enumerate(wkts):
        if wkt and _USUAL.fullmatch(wkt):
            points, parts = _shape(wkt.translate(_SHAPE))
            if min(points) > 2:
                found.append((n, points, parts, None))
                plain.append(wkt.encode().translate(_BLANKS))
                continue
        if wkt and (rings := [(k, r) for k, part in enumerate(rings_of(wkt)) for r in part]):
            found.append((n, tuple(len(r) for _, r in rings), tuple(k for k, _ in rings), np.concatenate([r for _, r in rings])))
    values = _numbers(plain)
    if values is None or len(values) != 2 * sum(sum(points) for _, points, _, xy in found if xy is None):
        # something like 1.2.3 or 1e999 among them: the halves are read by themselves, down to the text with the fault
        if len(wkts) > 1:
            a, b = parse_batch(wkts[: len(wkts) // 2]), parse_batch(wkts[len(wkts) // 2 :])
            return Rings(*(np.concatenate([getattr(a, k), getattr(b, k) + (a.texts if k == "owner" else 0)]) for k in ("xy", "size", "owner", "part")), len(wkts))
        rings = [(k, r) for k, part in enumerate(rings_of(wkts[0])) for r in part]
        found, values = [(0, tuple(len(r) for _, r in rings), tuple(k for k, _ in rings), np.concatenate([r for _, r in rings]))] if rings else [], np.empty(0)
    one = lambda v: np.array(v, dtype=np.int64)
    owner = one([n for n, points, _, _ in found for _ in points])
    size, part = one([k for _, points, _, _ in found for k in points]), one([k for _, _, parts, _ in found for k in parts])
    odd = [xy for *_, xy in found if xy is not None]
    xy = values.reshape(-1, 2)
    if odd:
        usual = np.repeat([v is None for *_, v in found], [sum(points) for _, points, _, _ in found])
        xy = np.empty((len(usual), 2))
        xy[usual], xy[~usual] = values.reshape(-1, 2), np.concatenate(odd)
    return Rings(xy, size, owner, part, len(wkts))
