"""First places of many strings in one text, in one pass over it."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(codes: np.ndarray, widest: int):
    """(width, hashes of all windows of that width) for the powers of two up to widest, each made from the one before."""
    h, width, factor = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    while True:
        yield width, h
        if 2 * width > min(widest, len(codes)):
            return
        with np.errstate(over="ignore"):
            h, factor = h[: len(h) - width] * factor + h[width:], factor * factor
        width *= 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def first_places(text: str, wanted: list[str | None]) -> list[int | None]:
    """Where each of the wanted strings first stands in text, from 0; null for null and for what isn't there.

    A string is known by the hashes of its first and its last 2^k characters, which overlap or meet. The windows of each
    width that is asked for are sorted once, so the cost is that of some sorts of the text, not of a search for each string.
    Whatever hashes say is compared with the text.
    """
    found: dict[str, int | None] = {"": 0}
    by_width: dict[int, list[str]] = {}
    for s in {w for w in wanted if w}:
        if len(s) > len(text):
            found[s] = None
        else:
            by_width.setdefault(1 << (len(s).bit_length() - 1), []).append(s)
    for width, h in _windows(_codes(text), max(by_width, default=0)) if by_width else ():
        own = by_width.get(width)
        if not own:
            continue
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        ends = [list(_windows(_codes(s[:width] + s[-width:]), width))[-1][1][[0, width]] for s in own]
        low, high = (np.searchsorted(ranked, np.array([e[0] for e in ends]), side) for side in ("left", "right"))
        for s, (_, last), a, b in zip(own, ends, low, high):
            places = order[a:b]
            places = places[places <= len(text) - len(s)]
            places = places[h[places + len(s) - width] == last]
            found[s] = next((int(p) for p in places if text.startswith(s, p)), None)
    return [None if s is None else found[s] for s in wanted]
