"""Encode each distinct chunk of text once in a task and put the ids of whole texts together from that."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .bytewords import U64, Block, prefix_hashes, span_hashes


def cut_spans(block: Block, cut: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, starts, ends, hashes) of the runs of bytes between cuts.

    cut: whether byte i begins a new run (texts always do). kept: leaves out runs whose first byte isn't kept.
    """
    cut = cut.copy()
    cut[block.offsets[:-1][block.offsets[:-1] < len(block.data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(block.data))[: len(starts)]
    if kept is not None:
        use = kept[starts]
        starts, ends = starts[use], ends[use]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    return doc, starts, ends, span_hashes(prefix_hashes(block.data), starts, ends)


class ChunkCode:
    """encode: takes a list of distinct chunks (bytes), returns all their ids in one array and how many each has.

    limit: bytes that the table of known chunks may have before a block adds its own; chunks themselves aren't held.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 48 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.count, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the chunks in a row, and how many each has."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if 24 * (len(self.keys) + len(keys)) + 4 * len(self.ids) > self.limit:  # bounded memory: forget and begin again
            self._clear()
        if len(self.keys):
            slot = np.searchsorted(self.keys, keys)
            slot[slot == len(self.keys)] = 0
            missing = self.keys[slot] != keys
        else:
            missing = np.ones(len(keys), bool)
        if missing.any():
            raw = data.tobytes()
            ids, count = self.encode([raw[starts[i] : ends[i]] for i in first[missing]])
            at = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            merged = np.concatenate([self.keys, keys[missing]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.at, self.count = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
        slot = np.searchsorted(self.keys, keys)[inverse]
        times = self.count[slot]
        total = int(times.sum())
        index = np.arange(total) + np.repeat(self.at[slot] - (np.cumsum(times) - times), times)
        return self.ids[index], times
