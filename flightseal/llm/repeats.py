"""Repeated passages by suffix arrays and common-prefix interval trees.

Windows of `length` bytes are dealt by an anchor: the GRAM-byte piece of the
window with the smallest hash. Equal windows have equal anchors at equal
places, so each window of the corpus belongs to one anchor occurrence, whose
run of window starts and their bytes form its context. Contexts that are equal
as a whole are settled by their hashes. Where an anchor has several contexts,
their bytes are fetched and a suffix array with its common-prefix interval tree
yields the maximal repeats with all their occurrences.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import kept

LENGTH = 100
GRAM = 40
#: Bytes hashed at once; a longer text is cut into pieces that overlap by a window.
BUFFER = 1 << 20
_PLACE = 21  # bits that hold a place in a buffer


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    tables = kept("flightseal.llm.substring")
    if not tables:
        tables["up"] = _powers(_BASE, 2 * BUFFER)
        tables["down"] = _powers(pow(_BASE, -1, 1 << 64), 2 * BUFFER)
    return tables["up"], tables["down"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the `gram` bytes from each place."""
    up, down = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    return found


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of the `width` values from each place, by minima from both ends of blocks."""
    full = -len(values) % width
    blocks = np.concatenate([values, np.full(full, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor hash, anchor place, first window start and number of windows of all runs.

    bounds: ends of the texts in `data`; windows do not cross them.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    hashes = gram_hashes(raw, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    least = sliding_least((hashes & ~low) | places, length - gram + 1)
    valid = np.ones(len(least), bool)
    for end in bounds[:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    at = (least & low).astype(np.int64)
    starts = np.nonzero(valid)[0]
    anchors = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (np.diff(starts) != 1)
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(starts)))
    return hashes[anchors[first]], anchors[first], starts[first], count


class Seen:
    """Occurrences of keyed strings: (key, digest of the string, document, start, windows)."""

    FIELDS = (("key", np.uint64), ("digest", np.uint64), ("doc", np.int64), ("start", np.uint32), ("count", np.uint8))

    def __init__(self, *arrays):
        self.arrays = [np.asarray(a, kind) for a, (_, kind) in zip(arrays, self.FIELDS)]

    def __getattr__(self, name):
        return self.arrays[[n for n, _ in self.FIELDS].index(name)]

    def __len__(self):
        return len(self.arrays[0])

    def take(self, at) -> Seen:
        return Seen(*(a[at] for a in self.arrays))

    @classmethod
    def join(cls, parts) -> Seen:
        parts = list(parts) or [cls(*[[]] * len(cls.FIELDS))]
        return cls(*(np.concatenate(x) for x in zip(*(p.arrays for p in parts))))

    def settle(self) -> tuple[Seen, Seen]:
        """(sorted first occurrences of every string, the later ones). Equal (doc, start) are all first."""
        own = self.take(np.lexsort((self.start, self.doc, self.digest, self.key)))
        if not len(own):
            return own, own
        new = np.ones(len(own), bool)
        new[1:] = (own.key[1:] != own.key[:-1]) | (own.digest[1:] != own.digest[:-1])
        lead = np.nonzero(new)[0][np.cumsum(new) - 1]
        later = (own.doc != own.doc[lead]) | (own.start != own.start[lead])
        return own.take(new), own.take(later)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Spans of each document, with those that meet or overlap made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    change = np.append(True, doc[1:] != doc[:-1])
    lift = (np.cumsum(change) - 1) * (int(stop.max()) + 2)  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(stop + lift)
    new = np.append(True, (start + lift)[1:] > reach[:-1])
    last = np.append(np.nonzero(new)[0][1:] - 1, len(doc) - 1)
    return doc[new], start[new], (reach - lift)[last]


def maximal_repeats(texts: list[bytes], counts: list[int], length: int = LENGTH):
    """Yields (repeat length, text numbers, places): every maximal repeat of at least `length`
    bytes, with all its occurrences.

    Suffixes that start at one of the first counts[i] places of texts[i] are
    sorted into a suffix array with the common prefixes of neighbours. A scan
    with a stack visits the prefix intervals; an interval whose occurrences have
    unlike bytes to their left (a text's start is unlike any) cannot be extended.
    """
    widest = max(map(len, texts))
    number = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum([0, *counts[:-1]])
    place = np.arange(len(number)) - first[number]
    base = np.cumsum([0, *[len(t) for t in texts]])
    data = np.frombuffer(b"".join(texts) + bytes(widest), np.uint8)
    left = np.array([len(t) for t in texts])[number] - place
    at = base[number] + place
    rows = np.lib.stride_tricks.sliding_window_view(data, widest)[at]
    rows[np.arange(widest)[None, :] >= left[:, None]] = 0
    order = np.argsort(rows.view(f"S{widest}").ravel(), kind="stable")
    rows, number, place, left, at = rows[order], number[order], place[order], left[order], at[order]
    before = np.where(place > 0, data[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    unlike = rows[1:] != rows[:-1]
    common = np.where(unlike.any(1), unlike.argmax(1), widest)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    close = common >= length
    edges = np.flatnonzero(np.diff(np.concatenate([[0], close.view(np.int8), [0]])))
    common = common.tolist()
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):  # suffixes low..high share `length` bytes
        stack: list[tuple[int, int]] = []
        for i in range(low, high + 1):
            value, begin = (common[i] if i < high else 0), i
            while stack and stack[-1][0] > value:
                size, begin = stack.pop()
                if changes[i] != changes[begin]:
                    yield size, number[begin : i + 1], place[begin : i + 1]
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, begin))


def repeat_spans(key, doc, start, count, texts, length: int = LENGTH, batch: int = 1 << 18):
    """Spans of all occurrences but the first of the maximal repeats among texts with equal keys."""
    order = np.lexsort((start, doc, key))
    cuts, size = [0], 0
    for i, o in enumerate(order.tolist()):
        if size > batch and key[o] != key[order[i - 1]]:
            cuts.append(i)
            size = 0
        size += len(texts[o])
    found = []
    for low, high in zip(cuts, [*cuts[1:], len(order)]):
        part = order[low:high]
        if len(part) < 2:
            continue
        docs, starts = doc[part], start[part].astype(np.int64)
        for size, number, place in maximal_repeats([texts[o] for o in part], count[part].tolist(), length):
            d, s = docs[number], starts[number] + place
            lead = np.lexsort((s, d))[0]
            later = (d != d[lead]) | (s != s[lead])
            found.append((d[later], s[later], s[later] + size))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return merged(*(np.concatenate(x) for x in zip(*found)))
