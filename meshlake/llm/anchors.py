"""Anchors of fixed-length byte strings.

Every string of ``length`` bytes is assigned to the gram of ``gram`` bytes inside it with the least hash (the leftmost on ties). That depends on the
string's bytes alone, so equal strings have equal anchors at equal distances, wherever they are. Neighbouring strings share anchors:
the starts p of one anchor form a run, and there is about one run to every 80 bytes.
"""

from __future__ import annotations

import numpy as np

from .jaccard_join import _BASE, mixed

POSITION_BITS = 24
SLICE = 1 << 18


class Anchors:
    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(size, 2 * SLICE), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def runs(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Arrays doc, start (first string of the run), count (of strings), back (bytes from start to anchor), gram and span
        (64-bit hashes: of the anchor; of all bytes of the run's strings with back)."""
        parts, i, most = [], 0, (1 << POSITION_BITS) - 1
        while i < len(texts):
            if len(texts[i]) > most:
                for at in range(0, len(texts[i]) - self.length + 1, most - self.length + 1):
                    parts.append(self._runs([texts[i][at : at + most]], i, at))
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and len(texts[j]) <= most and (j == i or size + len(texts[j]) < SLICE):
                size += len(texts[j])
                j += 1
            parts.append(self._runs(texts[i:j], i, 0))
            i = j
        return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("doc", "start", "count", "back", "gram", "span")}

    def _runs(self, texts: list[bytes], first_doc: int, offset: int) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        n, k = len(data), self.gram
        if n < self.length:
            return {x: np.zeros(0, np.uint64 if x in ("gram", "span") else np.int64) for x in ("doc", "start", "count", "back", "gram", "span")}
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        gram = mixed((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        low = (gram & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while 2 * reach <= self.window:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (self.window - reach)], low[self.window - reach :])
        anchor = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        # Starts p whose string lies inside one document.
        valid = np.zeros(len(anchor) + 1, np.int32)
        held = sizes >= self.length
        np.add.at(valid, begin[held], 1)
        np.add.at(valid, begin[held] + sizes[held] - self.length + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        new = valid & np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]]
        stop = valid & np.r_[(anchor[1:] != anchor[:-1]) | ~valid[1:], True]
        start, last = np.flatnonzero(new), np.flatnonzero(stop)
        at = anchor[start]
        doc = np.searchsorted(begin, start, "right") - 1
        # A document boundary between two runs of one anchor cannot be: an anchor lies inside both strings.
        end = last + self.length
        span = mixed((sums[end] - sums[start]) * self.inverse[start] + mixed(((at - start) << 20 | (end - start)).astype(np.uint64)))
        return {"doc": doc + first_doc, "start": start - begin[doc] + offset, "count": last - start + 1, "back": at - start, "gram": gram[at], "span": span}
