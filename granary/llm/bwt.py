"""Collection Burrows-Wheeler transform and common prefixes, built column by column in files.

Round j inserts one symbol of every document that still has one: the one before its j last. The
transform is a file, with files of common prefixes, documents and starts beside it. A round reads
them once in order, block by block, and writes them anew: the number of times that a document's last symbol occurs before its place says where
the longer suffix goes, and the least common prefix since the symbol's last occurrence, plus one, is
its common prefix with the suffix before. End marks of different documents differ.

The number of rounds is the longest document's length plus one, and each rewrites what is there so
far, so this serves collections of short documents. An empty collection gives empty arrays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

END, SYMBOLS = 0, 257  # the end mark, and bytes plus one
BLOCK = 1 << 20
_NONE = np.iinfo(np.int32).max
_FILES = (("bwt", np.int16), ("lcp", np.int32), ("doc", np.int32), ("start", np.int32))


@dataclass
class Transform:
    """In the order of all suffixes: symbol before, common prefix with the one before, document, start."""

    bwt: np.ndarray
    lcp: np.ndarray
    doc: np.ndarray
    start: np.ndarray


class _Store:
    """One sequential file for each array, read and rewritten in blocks."""

    def __init__(self, folder: str):
        self.folder, self.turn, self.size = Path(folder), 0, 0

    def blocks(self, *names: str) -> Iterator[list[np.ndarray]]:
        for at in range(0, self.size, BLOCK):
            n = min(BLOCK, self.size - at)
            yield [np.fromfile(self.folder / f"{name}.{self.turn}", kind, n, offset=at * np.dtype(kind).itemsize) for name, kind in _FILES if name in names]

    def insert(self, at: np.ndarray, rows: dict[str, np.ndarray], changed: np.ndarray, lcp: np.ndarray) -> None:
        """Put rows before the old places `at` (sorted), after setting the common prefixes at `changed`."""
        for name, kind in _FILES:
            old, low = self.folder / f"{name}.{self.turn}", 0
            with (self.folder / f"{name}.{self.turn + 1}").open("wb") as out:
                for (values,) in self.blocks(name):
                    high = low + len(values)
                    if name == "lcp":
                        own = (changed >= low) & (changed < high)
                        values[changed[own] - low] = lcp[own]
                    own = (at >= low) & ((at < high) | (high == self.size))
                    np.insert(values, at[own] - low, rows[name][own]).astype(kind).tofile(out)
                    low = high
                if not self.size:
                    rows[name].astype(kind).tofile(out)
            old.unlink(missing_ok=True)
        self.turn, self.size = self.turn + 1, self.size + len(at)

    def whole(self, name: str) -> np.ndarray:
        return np.fromfile(self.folder / f"{name}.{self.turn}", dict(_FILES)[name])


def _scan(store: _Store, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes at `place` (sorted) with `symbol` before them: the rank of each among the symbol's
    occurrences, the common prefix with the occurrence before, and that of the next one with it."""
    wanted = {int(c): np.flatnonzero(symbol == c) for c in np.unique(symbol)}
    count, least = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, _NONE)
    gaps: dict[int, list[np.ndarray]] = {c: [] for c in wanted}
    rank, low = np.zeros(len(place), np.int64), 0
    for bwt, lcp in store.blocks("bwt", "lcp"):
        high = low + len(bwt)
        for c, asks in wanted.items():
            at = np.flatnonzero(bwt == c)
            if len(at):
                # Least common prefix from after the occurrence before up to each one.
                gap = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
                gap[0] = min(gap[0], least[c])
                gaps[c].append(gap)
                least[c] = int(lcp[at[-1] + 1 :].min(initial=_NONE))
            else:
                least[c] = min(least[c], int(lcp.min()))
            here = asks[(place[asks] >= low) & (place[asks] < high)]
            rank[here] = count[c] + np.searchsorted(at, place[here] - low)
            count[c] += len(at)
        low = high
    own, after = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for c, asks in wanted.items():
        gap = np.append(np.concatenate(gaps[c]).astype(np.int64) + 1, 0)
        gap[0] = 0  # the first suffix with this symbol
        own[asks], after[asks] = gap[rank[asks]], gap[rank[asks] + 1]
    return rank, own, after


def build(docs: list[bytes], folder: str | None = None) -> Transform:
    with tempfile.TemporaryDirectory(dir=folder) as work:
        store = _Store(work)
        texts = [np.frombuffer(d, np.uint8).astype(np.int16) + 1 for d in docs]
        left = np.array([len(t) for t in texts], np.int64)
        alive = place = np.arange(len(docs))
        before = lambda: np.array([texts[k][n - 1] if n else END for k, n in zip(alive.tolist(), left.tolist(), strict=True)], np.int16)
        # Round 0: the end marks, in the documents' order.
        symbol, none = before(), np.zeros(0, np.int64)
        store.insert(np.zeros(len(docs), np.int64), {"bwt": symbol, "lcp": np.zeros(len(docs)), "doc": alive, "start": left}, none, none)
        starts = np.zeros(SYMBOLS + 1, np.int64)  # where the suffixes of each first symbol begin
        starts[1:] = len(docs)
        while True:
            order = np.argsort(place, kind="stable")
            order = order[symbol[order] != END]
            alive, left, symbol, place = (x[order] for x in (alive, left, symbol, place))
            if not len(alive):
                break
            rank, lcp, after = _scan(store, place, symbol)
            order = np.lexsort((rank, symbol))
            alive, left, symbol, rank, lcp, after = (x[order] for x in (alive, left, symbol, rank, lcp, after))
            left = left - 1
            new = before()
            many = np.bincount(symbol, minlength=SYMBOLS)
            at = starts[symbol] + rank - (np.arange(len(alive)) - (np.cumsum(many) - many)[symbol])
            follows = at < starts[symbol + 1]  # an old suffix with this symbol comes next
            store.insert(at, {"bwt": new, "lcp": lcp, "doc": alive, "start": left}, at[follows], after[follows])
            starts = starts + np.concatenate(([0], np.cumsum(many)))
            place, symbol = starts[symbol] + rank, new
        return Transform(*(store.whole(name) for name, _ in _FILES))


def repeated_starts(docs: list[bytes], span: int, folder: str | None = None) -> list[np.ndarray]:
    """For each document, the sorted starts of its `span`-byte strings that start anywhere else too."""
    t = build(docs, folder)
    near = t.lcp >= span
    hit = near | np.append(near[1:], False) if len(near) else near
    order = np.lexsort((t.start[hit], t.doc[hit]))
    doc, start = t.doc[hit][order], t.start[hit][order]
    cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
    return [start[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
