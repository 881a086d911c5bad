"""Column-wise Burrows-Wheeler transform and common prefixes of a collection of strings.

Round t inserts, for every string of at least t symbols, the suffix of t symbols: its row follows from the rank of its
first symbol in the transform so far, and the common prefixes of the new row and of the one after it from the least value
between neighbouring rows of that symbol, one more. The transform and the prefixes are files, read from front to back and
written anew each round; a string ends in a mark of its own, marks ordered as the strings.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pandas as pd

from .common import SpanHasher

_HASHER = SpanHasher(seed=2_003)


class _Column:
    """A numpy array kept in a file, replaced each round."""

    def __init__(self, folder: str, name: str, dtype):
        self.path, self.dtype = os.path.join(folder, name), np.dtype(dtype)

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, dtype=self.dtype)

    def write(self, values: np.ndarray) -> None:
        values.astype(self.dtype, copy=False).tofile(self.path + ".new")
        os.replace(self.path + ".new", self.path)


def collection_bwt(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform (0 at a string's start, else symbol + 1), common prefix with the row before, and the rank of each transform entry.

    String j is data[offsets[j]:offsets[j + 1]], unsigned integers, not empty. Row r < n_strings is the empty suffix of string r; the
    row of a suffix one symbol longer is the rank of the row's entry.
    """
    length = np.diff(offsets)
    m, longest = len(length), int(length.max())
    most = int(data.max())
    symbol = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32
    codes = data.astype(symbol) + symbol(1)
    end = offsets[1:]
    folder = tempfile.mkdtemp(prefix="bcr-")
    try:
        bwt_file, lcp_file = _Column(folder, "bwt", symbol), _Column(folder, "lcp", np.uint16)
        bwt_file.write(codes[end - 1])
        lcp_file.write(np.zeros(m, dtype=np.uint16))
        live, at = np.arange(m), np.arange(m)
        for t in range(1, longest + 1):
            bwt, lcp = bwt_file.read(), lcp_file.read()
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(len(bwt), dtype=np.int64)
            rank[order] = np.arange(len(bwt))
            done = m - len(live)  # entries that are 0
            own = rank[at]
            row = own + (m - done)
            # neighbours of the same symbol in the transform, and the least common prefix on the way
            down = np.argsort(-at, kind="stable")
            before, after = np.maximum(own - 1, 0), np.minimum(own + 1, len(bwt) - 1)
            same_before = (own > 0) & (bwt[order[before]] == bwt[at])
            same_after = (own + 1 < len(bwt)) & (bwt[order[after]] == bwt[at])
            new_lcp = np.where(same_before, 1 + _least(lcp, np.where(same_before, order[before] + 1, at), at, down), 0)
            next_lcp = np.where(same_after, 1 + _least(lcp, np.minimum(at + 1, len(bwt) - 1), np.where(same_after, order[after], at), down), 0)
            n = len(bwt) + len(live)
            fresh = np.zeros(n, dtype=bool)
            fresh[row] = True
            new_bwt, out_lcp = np.empty(n, dtype=symbol), np.empty(n, dtype=np.uint16)
            new_bwt[~fresh], out_lcp[~fresh] = bwt, lcp
            longer = length[live] > t
            new_bwt[row] = np.where(longer, codes[np.where(longer, end[live] - t - 1, 0)], 0)
            out_lcp[row] = new_lcp
            follows = row + 1 < n
            out_lcp[row[follows] + 1] = next_lcp[follows]
            bwt_file.write(new_bwt)
            lcp_file.write(out_lcp)
            live, at = live[longer], row[longer]
        bwt, lcp = bwt_file.read(), lcp_file.read()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), dtype=np.int64)
    rank[order] = np.arange(len(bwt))
    return bwt, lcp, rank


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Least of values[low..high] of each pair; pairs are taken from the right, so that reduceat skips what lies between."""
    if not len(low):
        return np.empty(0, dtype=np.int64)
    low, high = low[down], np.maximum(low, high)[down]
    edges = np.stack([low, high + 1], axis=1).reshape(-1)
    padded = np.append(values, values[-1:])
    found = np.minimum.reduceat(padded, np.minimum(edges, len(values)))[::2]
    out = np.empty(len(low), dtype=np.int64)
    out[down] = found
    return out


def _blocked(data: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of blocks: for each string and each shift below ``block``, its consecutive blocks of so many bytes from there.

    Returns the blocks as numbers, equal for equal bytes, the offsets of the new strings, and the string and shift of each.
    """
    length = np.diff(offsets)
    count = np.maximum(length[:, None] - np.arange(block), 0) // block
    owner, shift = np.nonzero(count)
    count = count[owner, shift]
    new = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(offsets[owner] + shift - block * new[:-1], count) + block * np.arange(new[-1])
    prefix = _HASHER.prefix(data)
    number, _ = pd.factorize(_HASHER.spans(prefix, at, at + block))
    head = np.full(number.max() + 1, -1, dtype=np.int64)
    head[number[::-1]] = at[::-1]
    same = head[number]
    if any((data[at + k] != data[same + k]).any() for k in range(block)):  # two blocks with one hash
        number = np.unique(data[at[:, None] + np.arange(block)], axis=0, return_inverse=True)[1].reshape(-1)
    return number, new, owner, shift


def repeated_windows(data: np.ndarray, offsets: np.ndarray, width: int, place: np.ndarray, block: int = 1) -> list[np.ndarray]:
    """Starts, in each string, of the windows of ``width`` symbols that also stand at a smaller place.

    ``place`` (n_strings x 2) is a string's (document, position); a window's place is its string's with the start added. With
    ``block`` (a divisor of width) the transform is that of strings of blocks: equal windows are equal runs of width / block of
    them, and a string of n bytes costs n / block rounds.
    """
    if block > 1:
        number, new, owner, shift = _blocked(data, offsets, block)
        if not len(number):
            return [np.empty(0, dtype=np.int64) for _ in offsets[1:]]
        string, start = _repeats(number, new, width // block, place[owner], shift, block)
        string = owner[string]
    else:
        string, start = _repeats(data, offsets, width, place, np.zeros(len(offsets) - 1, dtype=np.int64), 1)
    order = np.lexsort((start, string))
    return np.split(start[order], np.searchsorted(string[order], np.arange(1, len(offsets) - 1)))


def _repeats(data: np.ndarray, offsets: np.ndarray, width: int, place: np.ndarray, shift: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """String and start (in bytes) of each window of ``width`` symbols that also stands at a smaller place."""
    _, lcp, rank = collection_bwt(data, offsets)
    length = np.diff(offsets)
    group = np.cumsum(lcp < width)
    row, live = np.arange(len(length)), np.arange(len(length))
    rows, owners, starts = [], [], []
    for t in range(1, int(length.max()) + 1):
        more = length[live] >= t
        live, row = live[more], rank[row[more]]
        if t >= width:
            rows.append(row)
            owners.append(live)
            starts.append(shift[live] + block * (length[live] - t))
    none = np.empty(0, dtype=np.int64)
    if not rows:
        return none, none
    g, owner, start = group[np.concatenate(rows)], np.concatenate(owners), np.concatenate(starts)
    doc, pos = place[owner, 0], place[owner, 1] + start
    order = np.lexsort((pos, doc, g))
    g, doc, pos = g[order], doc[order], pos[order]
    head = np.ones(len(g), dtype=bool)
    head[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[first]) | (pos != pos[first])
    return owner[order][later], start[order][later]
