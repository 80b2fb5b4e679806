"""Byte-level BPE by prefix sharing.

Encoding rests on one property of byte pair encoding: whatever stands after it, the encoding of a
prefix is determined, so "the last token of the encoding of this prefix" is a state that can be
handed on from prefix to prefix. The distinct pieces of many texts form a trie. Walking it depth
first (that is, over the sorted pieces, with a stack that is cut back to the common prefix) computes
the state of a shared prefix once. The next state is the one token that ends at the new byte and may
stand after the state at its start; two tokens may stand together when undoing their merges, latest
first, never meets a merge across their border that would have come earlier.

Texts are cut into pieces by the tokenizer's pattern after its special tokens have been taken out.
Decoding joins the bytes of the tokens; bytes that are no UTF-8 become replacement characters.

Defined results: null text is encoded as empty, an empty text has no ids, a null id list decodes to
the empty string, ids outside the vocabulary are left out in decoding; texts are never cut. Tables
are held once per Python worker, the pieces kept between batches are bounded in number.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import lists

KEPT_PIECES = 150_000  # per Python worker; beyond it the pieces not met since the store was last full are dropped
KEPT_PAIRS = 100_000
GROUP_CHARS = 1_000_000  # texts whose pieces are looked up together

# Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for the standard library's faster matcher. Its classes differ from the pattern's for a few characters:
# numbers that are no digits, and separators that Unicode does not count as white space. Texts with one of these, with
# unassigned characters or with any beyond the basic plane take the pattern itself. Only alternatives that cannot begin
# alike have changed places.
_PLAIN_PIECES = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SPECIAL_CASES = re.compile(
    "[\x1c-\x1f" + "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) in ("Nl", "No", "Cn", "Cs"))
    + "\U00010000-\U0010ffff]"
)


def pieces_of(text: str) -> list[str]:
    """The pattern's pieces, which make up the text."""
    return _FULL_PIECES.findall(text) if _SPECIAL_CASES.search(text) else _PLAIN_PIECES.findall(text)


_FULL_PIECES = regex.compile(PIECES)


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _tables(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens") or []}


def _token_bytes(ids: dict[str, int], specials: dict[str, int]) -> list[bytes]:
    alphabet, table = byte_alphabet(), [b""] * (max([*ids.values(), *specials.values()]) + 1)
    for token, i in ids.items():
        table[i] = bytes(alphabet[c] for c in token)
    for token, i in specials.items():
        table[i] = token.encode()
    return table


class Decoder:
    """The bytes of every token."""

    def __init__(self, path: str, bytes_of: list[bytes] | None = None):
        if bytes_of is None:
            ids, _, specials = _tables(path)
            bytes_of = _token_bytes(ids, specials)
        self.bytes_of = bytes_of

    def decode(self, ids: np.ndarray) -> str:
        table, end = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids.tolist() if 0 <= i < end]).decode("utf-8", "replace")


class PairEncoder:
    """Tables of one vocabulary file and the pieces encoded so far."""

    def __init__(self, path: str, with_specials: bool = True):
        ids, merges, specials = _tables(path)
        specials = specials if with_specials else {}
        bytes_of = _token_bytes(ids, specials)
        # A token's rank is the place of its merge; single bytes come before all merges.
        self.rank = {ids[c]: -1 for c in ids if len(c) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for place, (left, right) in enumerate(merges):
            whole = ids[left + right]
            self.rank[whole], self.halves[whole] = place, (ids[left], ids[right])
            self.merged[ids[left], ids[right]] = whole
        self.ends: dict = {}  # tokens spelled backwards: byte -> node, None -> token
        for i in self.rank:
            node = self.ends
            for b in reversed(bytes_of[i]):
                node = node.setdefault(b, {})
            node[None] = i
        self.size = {i: len(bytes_of[i]) for i in self.rank}
        self.special = specials
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.together: dict[int, bool] = {}  # by left * width + right
        self.width = len(bytes_of)
        self.decoder = Decoder(path, bytes_of)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the store before it was last full

    def may_follow(self, left: int, right: int) -> bool:
        """True when encoding the bytes of both gives these two tokens."""
        rank, halves, merged = self.rank, self.halves, self.merged
        # Merges made on each side at or after these places are undone so far. A merge across the border of
        # the opened tokens would have happened if it came before both of the merges undone last; at the
        # same place the left one comes first, as pairs are merged from left to right.
        left_limit = right_limit = len(rank)
        while True:
            across = merged.get((left, right))
            if across is not None:
                place = rank[across]
                if place < left_limit and place <= right_limit:
                    return False
            if left not in halves and right not in halves:
                return True
            if rank[left] > rank[right]:
                left_limit, left = rank[left], halves[left][1]
            else:
                right_limit, right = rank[right], halves[right][0]

    def encode_pieces(self, fresh: list[str]) -> None:
        """Encode pieces that are not known yet, in the depth-first order of their trie."""
        ends, size, width, together, may_follow = self.ends, self.size, self.width, self.together, self.may_follow
        if len(together) > KEPT_PAIRS:
            together.clear()
        path, before = [None], b""  # path[i]: last token of the encoding of the first i bytes
        coded = sorted((piece.encode(), piece) for piece in fresh)
        for word, piece in coded:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, start = ends, end
                while start > 0:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        raise ValueError(f"no token ends at byte {end} of a piece")
                    token = node.get(None)
                    if token is None:
                        continue
                    if start == 0:
                        break
                    pair = path[start] * width + token
                    stands = together.get(pair)
                    if stands is None:
                        stands = together[pair] = may_follow(path[start], token)
                    if stands:
                        break
                path.append(token)
            before = word
            tokens, at = [], len(word)
            while at:
                tokens.append(path[at])
                at -= size[path[at]]
            self.known[piece] = np.array(tokens[::-1], np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids one after the other, and the number of ids of each text."""
        flat: list[bytes] = []
        for first, last in _groups(texts):
            parts = [self._parts(text) for text in texts[first:last]]
            if len(self.known) > KEPT_PIECES:
                self.known, self.before = {}, self.known
            known, before = self.known, self.before
            fresh = set().union(*parts) - known.keys()
            for piece in fresh & before.keys():
                known[piece] = before[piece]
            self.encode_pieces(list(fresh - before.keys() - self.special.keys()))
            for token in fresh & self.special.keys():
                known[token] = np.array([self.special[token]], np.int32).tobytes()
            flat += [b"".join(map(known.__getitem__, part)) for part in parts]
        return np.frombuffer(b"".join(flat), np.int32), [len(ids) // 4 for ids in flat]

    def _parts(self, text: str) -> list[str]:
        """Pieces and special tokens. No piece spells a special token: those have letters and other signs, pieces one kind."""
        if self.cut is None or not self.cut.search(text):
            return pieces_of(text)
        parts: list[str] = []
        for i, stretch in enumerate(self.cut.split(text)):
            parts.extend([stretch] if i % 2 else pieces_of(stretch))
        return parts


def _groups(texts: list[str]):
    """Ranges of texts of about GROUP_CHARS together; a longer text is a range of its own."""
    first = chars = 0
    for i, text in enumerate(texts):
        if i > first and chars + len(text) > GROUP_CHARS:
            yield first, i
            first, chars = i, 0
        chars += len(text)
    if first < len(texts):
        yield first, len(texts)


@lru_cache(maxsize=2)
def encoder(path: str, with_specials: bool = True) -> PairEncoder:
    """The encoder of a vocabulary file, once per process. The file is installed on every machine.

    Without specials their strings in a text are ordinary text.
    """
    return PairEncoder(path, with_specials)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _arrow_ids(model: PairEncoder, texts: pa.Array) -> pa.Array:
    ids, sizes = [np.zeros(0, np.int32)], []
    for start in range(0, len(texts), 1000):
        some, lengths = model.encode([t or "" for t in texts.slice(start, 1000).to_pylist()])
        ids.append(some)
        sizes += lengths
    return lists(np.concatenate(ids), sizes, pa.int32())


def _arrow_texts(model: Decoder, rows: pa.Array) -> pa.Array:
    flat, offsets = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    return pa.array((model.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])), pa.string(), size=len(rows))


def encode(text: Column, path: str) -> Column:
    """The ids of each whole text, as ``array<int>``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return _arrow_ids(encoder(path), texts)

    return bpe_encode(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each id list."""

    @F.arrow_udf(T.StringType())
    def bpe_decode(rows: pa.Array) -> pa.Array:
        return _arrow_texts(decoder(path), rows)

    return bpe_decode(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(text: Column, path: str) -> Column:
    """A struct of the ``ids`` of each whole text and the text ``decoded`` from them, in one Python worker."""

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]))
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        model = encoder(path)
        ids = _arrow_ids(model, texts)
        return pa.StructArray.from_arrays([ids, _arrow_texts(model.decoder, ids)], ["ids", "decoded"])

    return bpe_round_trip(text)
