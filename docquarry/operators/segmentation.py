"""Words of unspaced Han text: the most probable path through the words of a dictionary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dictionary is held by every worker: it is counted first, and a larger one refused.
MAX_WORDS = 500_000
_HAN_FIRST, _HAN_LAST = 0x4E00, 0x9FFF

# Characters of text that are cut at a time; a longer text is taken alone.
_SLICE_CHARS = 100_000
# A path's cost (in 1e-9) and number of words share an integer; longer stretches are cut one by one.
_COUNT_BITS = 12
_LONGEST = 300
# Entries of a table of all next states; larger dictionaries look them up in a sorted list.
_TABLE_MAX = 1 << 22


class Dictionary:
    """Costs of words, and for every beginning of a word that it is one."""

    def __init__(self, words: list[tuple[str, int]]):
        total = sum(n for _, n in words) or 1
        self.cost = {w: round(math.log(total / n) * 1e9) for w, n in words}
        # A character that begins no word costs as much as a word seen half a time.
        self.unknown = round(math.log(2 * total) * 1e9)
        self.beginnings = {w[:i] for w in self.cost for i in range(1, len(w) + 1)}
        self._number_beginnings()

    def _number_beginnings(self) -> None:
        """Every beginning as a state, the empty one first, and the steps from one to the next by a character."""
        place = {"": 0}
        for beginning in sorted(self.beginnings, key=len):
            place[beginning] = len(place)
        letters = sorted({b[-1] for b in self.beginnings})
        # Characters without a number stand for no step.
        self._letter = np.full(_HAN_LAST - _HAN_FIRST + 1, -1, np.int32)
        number = {c: i for i, c in enumerate(letters)}
        for c, i in number.items():
            if _HAN_FIRST <= ord(c) <= _HAN_LAST:
                self._letter[ord(c) - _HAN_FIRST] = i
        self._width = max(len(letters), 1)
        steps = [(-1, 0), *sorted((place[b[:-1]] * self._width + number[b[-1]], place[b]) for b in self.beginnings)]
        self._keys = np.array([k for k, _ in steps], np.int64)
        self._next = np.array([s for _, s in steps], np.int32)
        self._table = None
        if len(place) * self._width <= _TABLE_MAX:
            self._table = np.zeros(len(place) * self._width, np.int32)
            self._table[self._keys[1:]] = self._next[1:]
        self._step_cost = np.full(len(place), -1, np.int64)
        for word, cost in self.cost.items():
            self._step_cost[place[word]] = (cost << _COUNT_BITS) + 1

    def _follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states reached by one more character; 0 where there is none."""
        if self._table is not None:
            return np.where(letter >= 0, self._table[state * np.int32(self._width) + letter], 0)
        key = state.astype(np.int64) * self._width + letter
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((letter >= 0) & (self._keys[at] == key), self._next[at], 0)

    def _cut(self, run: str) -> list[int]:
        """Ends of the cheapest words that make up ``run``: least sum of costs, then fewest words, then the longest first word."""
        best: list[tuple[int, int]] = [(0, 0)] * (len(run) + 1)
        ahead = [0] * len(run)
        for at in range(len(run) - 1, -1, -1):
            found = None
            end = at + 1
            while end <= len(run) and (end == at + 1 or run[at:end] in self.beginnings):
                cost = self.cost.get(run[at:end], self.unknown if end == at + 1 else None)
                if cost is not None:
                    rest = best[end]
                    way = (cost + rest[0], rest[1] + 1)
                    if found is None or way <= found:  # of equal ways the later one has the longer word
                        found, ahead[at] = way, end
                end += 1
            best[at] = found
        return ahead

    def _words_at(self, letter: np.ndarray, han: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every length the places where a word of this length begins, with its cost; each Han character is a word."""
        at = np.flatnonzero(han).astype(np.int32)
        state = self._follow(np.zeros(len(at), np.int32), letter[at])
        known = self._step_cost[state]
        found = [(at, np.where(known >= 0, known, (self.unknown << _COUNT_BITS) + 1))]
        while len(at):
            live = (state > 0) & (at + len(found) < len(letter))
            at = at[live]
            state = self._follow(state[live], letter[at + len(found)])
            cost = self._step_cost[state]
            word = (state > 0) & (cost >= 0)
            found.append((at[word], cost[word]))
        return found

    def _word_starts(self, chars: np.ndarray, han: np.ndarray) -> np.ndarray:
        """Marks of the characters that begin a word, by the cheapest paths through all runs of Han characters.

        The runs are cut first where no word reaches across; such stretches are independent of each other and are solved
        side by side, from their ends, one place of all stretches at a time.
        """
        n = len(chars)
        letter = np.full(n, -1, np.int32)
        letter[han] = self._letter[chars[han] - _HAN_FIRST]
        found = self._words_at(letter, han)
        across = np.zeros(n + 2, np.int32)
        for length, (at, _) in enumerate(found[1:], 2):
            across[at + 1] += 1
            across[at + length] -= 1
        first = han & (np.cumsum(across[:n]) == 0)
        starts = np.flatnonzero(first)
        marks = np.zeros(n, bool)
        marks[starts] = True
        if not len(starts):
            return marks
        last = np.flatnonzero(han & np.append(first[1:] | ~han[1:], True))
        sizes = last + 1 - starts
        ahead = np.zeros(n, np.int32)
        for start, end in zip(starts[sizes > _LONGEST].tolist(), (last[sizes > _LONGEST] + 1).tolist()):
            ahead[start:end] = np.array(self._cut(chars[start:end].astype("<u4").tobytes().decode("utf-32-le"))) + start
        left = np.full(n, -1, np.int32)  # places behind this one in its stretch
        places = np.flatnonzero(han)
        left[places] = np.repeat(last, sizes) - places
        left[places[np.repeat(sizes > _LONGEST, sizes)]] = -1
        self._solve(found, left, ahead)
        at, end = starts, last + 1
        while len(at):
            marks[at] = True
            at = ahead[at]
            going = at < end
            at, end = at[going], end[going]
        return marks

    @staticmethod
    def _solve(found: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, ahead: np.ndarray) -> None:
        """Where the first word of the cheapest path from every place ends, for the places with ``left`` of at least 0."""
        n = len(left)
        order = np.flatnonzero(left >= 0).astype(np.int32)
        if not len(order):
            return
        order = order[np.argsort(left[order].astype(np.int16), kind="stable")]
        ways = np.zeros(n, np.int32)
        for at, _ in found:
            ways[at] += 1
        # All words, those of one place together and by length, the places by how many follow in their stretch.
        ends = np.cumsum(ways[order], dtype=np.int32)
        slot = np.zeros(n, np.int32)
        slot[order] = ends - ways[order]
        cost, target = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], np.int32)
        free = slot.copy()
        for length, (at, costs) in enumerate(found, 1):
            short = left[at] >= 0
            at = at[short]
            cost[free[at]], target[free[at]] = costs[short], at + length
            free[at] += 1
        best = np.zeros(n + 1, np.int64)
        steps = np.concatenate([[0], np.cumsum(np.bincount(left[order]))])
        for behind, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist())):
            here = order[a:b]
            each = ways[here]
            begin, stop = slot[here[0]], ends[b - 1]
            inner, place = target[begin:stop], here.repeat(each)
            # What follows the last word of a stretch belongs to another one.
            way = cost[begin:stop] + np.where(inner - place <= behind, best[inner], 0)
            best[here] = np.minimum.reduceat(way, slot[here] - begin)
            taken = way == best[place]
            # Of equal ways the last one, which has the longest word, stays.
            ahead[place[taken]] = inner[taken]

    def cut(self, run: str) -> tuple[str, ...]:
        """The words of a run of Han characters."""
        return tuple(self.spaced(run).split())

    def spaced(self, text: str) -> str:
        return self.spaced_all([text])[0]

    def spaced_all(self, texts: list[str | None]) -> list[str | None]:
        """The texts with blanks around the words of their Han runs; null stays null."""
        out: list[str | None] = []
        held: list[str | None] = []
        size = 0
        for text in texts:
            if held and size + len(text or "") > _SLICE_CHARS:
                out += self._spaced_slice(held)
                held, size = [], 0
            held.append(text)
            size += len(text or "") + 1
        return out + self._spaced_slice(held) if held else out

    def _spaced_slice(self, texts: list[str | None]) -> list[str | None]:
        # A line feed behind every text keeps the runs of neighbours apart.
        chars = np.frombuffer("".join([(t or "") + "\n" for t in texts]).encode("utf-32-le"), "<u4")
        han = (chars >= _HAN_FIRST) & (chars <= _HAN_LAST)
        if not han.any():
            return list(texts)
        room = 1 + self._word_starts(chars, han).astype(np.int64)
        place = np.cumsum(room) - 1
        # The last character of a run has a blank behind it, like the others have one before.
        behind = np.concatenate([[0], np.cumsum(han[:-1] & ~han[1:])])
        place += behind
        spaced = np.full(place[-1] + 1, 0x20, "<u4")
        spaced[place] = chars
        whole = spaced.tobytes().decode("utf-32-le")
        stops = place[np.cumsum([len(t or "") + 1 for t in texts]) - 1].tolist()
        return [None if t is None else whole[a:b] for t, a, b in zip(texts, [0, *[s + 1 for s in stops]], stops)]


def segment_words(df: DataFrame, text_col: str, dictionary: DataFrame) -> DataFrame:
    """``df`` with the words of Han runs in ``text_col`` set apart by blanks, so that the text can be indexed and asked like others.

    ``dictionary`` has ``word`` and ``n`` (occurrences in some reference text, at least 1), at most ``MAX_WORDS`` rows of it. Null
    texts stay null; without a dictionary every character is a word. Other characters stay as they are.
    """
    words = dictionary.filter((F.length("word") > 0) & (F.col("n") > 0)).groupBy("word").agg(F.max("n").alias("n"))
    held = words.limit(MAX_WORDS + 1).collect()
    if len(held) > MAX_WORDS:
        raise ValueError(f"a dictionary holds at most {MAX_WORDS} words")
    shared = df.sparkSession.sparkContext.broadcast([(r.word, r.n) for r in held])
    built: list[Dictionary] = []

    @F.arrow_udf("string")
    def spaced(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Dictionary(shared.value))
        return pa.array(built[0].spaced_all(texts.to_pylist()), pa.string())

    return df.withColumn(text_col, spaced(F.col(text_col)))
