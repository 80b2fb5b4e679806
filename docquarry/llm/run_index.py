"""Run-length index of many short texts: run-compressed Burrows-Wheeler transform, sampled run ends, matching statistics.

The texts are laid one after another, each closed by a separator that differs from every other separator, so no match
runs from one text into the next. Of the transform only its runs are kept, and of the suffix array only the entries at
the first and the last place of every run. That is enough to stream the matching statistics of the indexed text against
all its other suffixes: where a suffix is not the first of a run, its neighbour and match length follow from those one
byte to the left (the neighbour one further, the match one shorter); only at sampled places bytes are compared.

Texts are bytes without 0xFF, which UTF-8 never uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = 0xFF


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, past the end zeros, as native integers of the bytes' memory order."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), "<u8", buffer=padded, strides=(1,)).copy()


def _suffix_order(text: np.ndarray, to_separator: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; equal bytes up to the separators are ordered by the separators' places."""
    n = len(text)
    head = _words(text).byteswap()
    cut = to_separator < 8
    # What follows a separator says nothing: keep the bytes up to it.
    keep = (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (7 - to_separator[cut]).astype(np.uint64)))
    head[cut] &= keep
    order = np.argsort(head, kind="stable")
    sorted_head, sorted_cut = head[order], cut[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_head[1:] != sorted_head[:-1]) | sorted_cut[1:]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    open_places = order[np.repeat(size > 1, size)]
    reach = 8
    while len(open_places):
        key = rank[open_places] * (n + 1) + rank[open_places + reach]
        turn = np.argsort(key, kind="stable")
        places, key = open_places[turn], key[turn]
        old = rank[places]
        fresh, group = np.ones(len(places), bool), np.ones(len(places), bool)
        fresh[1:], group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        begins = np.flatnonzero(fresh)
        group_begin = np.maximum.accumulate(np.where(group, np.arange(len(places)), 0))
        size = np.diff(np.append(begins, len(places)))
        rank[places] = np.repeat(old[begins] + begins - group_begin[begins], size)
        open_places = places[np.repeat(size > 1, size)]
        reach *= 2
    order[rank] = np.arange(n)
    return order


@dataclass(frozen=True)
class RunIndex:
    """``heads``: byte of each run; ``begins``: its first place in the transform; ``first``, ``last``: suffixes at its ends."""

    text: np.ndarray
    to_separator: np.ndarray
    heads: np.ndarray
    begins: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def build(text: np.ndarray) -> RunIndex:
        """Index of ``text``, texts that each end in ``SEPARATOR``."""
        n = len(text)
        if n and text[-1] != SEPARATOR:
            raise ValueError("every text must be closed by a separator")
        closing = np.flatnonzero(text == SEPARATOR)
        to_separator = np.repeat(closing, np.diff(closing, prepend=-1)) - np.arange(n)
        order = _suffix_order(text, to_separator)
        before = text[order - 1]  # the place before the first text is the last separator
        edge = np.ones(n, bool)
        edge[1:] = (before[1:] != before[:-1]) | (before[1:] == SEPARATOR)  # separators are all different
        begins = np.flatnonzero(edge)
        ends = np.append(begins[1:], n) - 1 if n else begins
        return RunIndex(text, to_separator, before[begins], begins, order[begins], order[ends])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, inside their texts."""
        words = _words(self.text)
        bound = np.minimum(self.to_separator[a], self.to_separator[b])
        length = bound.copy()
        left, at = np.arange(len(a)), 0
        while len(left := left[bound[left] > at]):
            differ = words[a[left] + at] ^ words[b[left] + at]
            lowest = differ & (~differ + np.uint64(1))  # its lowest set bit lies in the first byte that differs
            found = differ != 0
            byte = (np.log2(lowest[found].astype(np.float64)).astype(np.int64)) // 8
            length[left[found]] = np.minimum(at + byte, bound[left[found]])
            left, at = left[~found], at + 8
        return length

    def statistics(self, below: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Per place of the text: match length with the neighbouring suffix above (or below), and that suffix's place.

        The larger of the two lengths is the longest match with any other suffix. The text is streamed from left to
        right between the sampled places.
        """
        n = len(self.text)
        if below:
            places, others = self.last[:-1], self.first[1:]
            open_end = self.last[-1:]
        else:
            places, others = self.first[1:], self.last[:-1]
            open_end = self.first[:1]
        lengths = self.common(places, others)
        places, others = np.concatenate([places, open_end]), np.concatenate([others, open_end])
        lengths = np.concatenate([lengths, np.zeros(len(open_end), np.int64)])
        turn = np.argsort(places)
        places, others, lengths = places[turn], others[turn], lengths[turn]
        spans = np.diff(np.append(places, n))
        since = np.arange(n) - np.repeat(places, spans)
        return np.maximum(np.repeat(lengths, spans) - since, 0), np.repeat(others, spans) + since

    def earliest(self, length: int) -> np.ndarray:
        """Per place: the first place in the text where its next ``length`` bytes begin; itself where none is earlier.

        Suffixes that share so many bytes are neighbours in suffix order: links to the neighbours are followed by
        doubling, in both directions.
        """
        place = np.arange(len(self.text))
        least = place.copy()
        for below in (False, True):
            lengths, others = self.statistics(below)
            link = np.where(lengths >= length, others, place)
            seen = place.copy()
            while True:
                np.minimum(seen, seen[link], out=seen)
                further = link[link]
                if np.array_equal(further, link):
                    break
                link = further
            least = np.minimum(least, seen)
        return least
