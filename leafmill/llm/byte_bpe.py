"""Backtracking byte-pair encoder for a public rank file.

A text is first cut into the pre-token units that byte-level BPE never merges across.  Each distinct unit
is then encoded once per worker:

* an Aho-Corasick automaton over all vocabulary byte strings finds, for every byte, the longest token that
  starts there;
* tokens are placed left to right, longest first.  A token may follow another only if the pair is
  *compatible*: encoding the two byte strings together gives just these two tokens.  An incompatible token
  is shortened to its next longest vocabulary prefix; if none is left the encoder backs up one token.
  Every position is given up at most once, so the work is linear in the bytes of the unit.

A sequence whose neighbouring pairs are all compatible is the one sequence that the merge rules produce, so
the ids are exact, not an approximation.

Decoding uses one byte string with all tokens back to back and an offset table into it.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import regex

#: The public pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNITS = regex.compile(PATTERN)
#: Pieces up to this length are remembered; longer ones are hardly ever seen twice.
_REMEMBER = 40
#: Remembered pieces per worker; the memory is emptied when it is full.
_CAPACITY = 300_000


def read_ranks(data: bytes) -> list[bytes]:
    """Token byte strings by id from the lines `base64 rank` of a rank file."""
    pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines()) if a]
    tokens = [b""] * len(pairs)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


class BacktrackingEncoder:
    """Exact ids of a byte-level BPE vocabulary, and the way back."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self._automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self._automaton.add_word(t.decode("latin-1"), (len(t), i))
        self._automaton.make_automaton()
        self._prefix = self._next_prefixes()
        self._split, self._pairs = self._merge_tables()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._memory: dict[str, bytes] = {}  # by unit
        self._spaced: dict[str, bytes] = {}  # by piece after a space
        self._cuts = self._safe_cuts()
        # decoding
        self.table = b"".join(tokens)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    # ---- tables

    def _next_prefixes(self) -> list[int]:
        """For each token the longest other token that begins it, or -1."""
        out = []
        ids = self.ids
        for t in self.tokens:
            found = -1
            for n in range(len(t) - 1, 0, -1):
                found = ids.get(t[:n], -1)
                if found >= 0:
                    break
            out.append(found)
        return out

    def _merge_tables(self):
        """The two parts each token is merged from, and the pair -> token lookup.

        The parts of a token are the only two-token split whose parts have lower ids and are compatible
        under the merges of lower rank, so they follow from the ranks alone.
        """
        tokens, ids = self.tokens, self.ids
        self._split, self._pairs = split, pairs = [(i, i) for i in range(len(tokens))], {}
        for i, t in enumerate(tokens):
            left = self._prefix[i]
            while left >= 0:
                right = ids.get(t[len(tokens[left]) :], -1)
                if left < i and 0 <= right < i and self._valid_pair(left, right, i):
                    split[i] = (left, right)
                    pairs[left, right] = i
                    break
                left = self._prefix[left]
        return split, pairs

    def _valid_pair(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank under `limit` joins bytes across the border of tokens a and b.

        Both tokens are taken apart step by step, the later merge first; at each step the two tokens that
        touch the border must not be a merge that comes before the ones already undone.
        """
        split, pairs = self._split, self._pairs
        while True:
            joined = pairs.get((a, b), -1)
            if 0 <= joined < limit:
                return False
            if a > b:
                limit = a
                a = split[a][1]
                if a == limit:
                    limit = b + 1
                    b = split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 400_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self._valid_pair(a, b, 1 << 31)
        return known

    def _safe_cuts(self) -> dict[int, str]:
        """For `str.translate`: a line end after each Han character (U+4E00..U+9FFF) where a cut is safe.

        A token spans the cut after a character only if it has, before the first byte of another character,
        bytes that agree with the end of this one.  After all other Han characters no merge can cross, so
        the parts of a pre-token are encoded on their own, and short parts are seen again and again.
        """
        whole, partial = set(), set()
        for t in self.tokens:
            for k in range(1, len(t)):
                if t[k] < 0x80 or t[k] >= 0xC0:
                    (whole if k >= 3 else partial).add(t[max(0, k - 3) : k])
        han = ((i, chr(i)) for i in range(0x4E00, 0xA000))
        return {i: c + "\n" for i, c in han if not ({c.encode()} & whole or {c.encode()[1:], c.encode()[2:]} & partial)}

    # ---- encoding

    def encode_unit(self, unit: bytes) -> list[int]:
        """Ids of one pre-token."""
        known = self.ids.get(unit)
        if known is not None:
            return [known]
        n = len(unit)
        longest = [-1] * n
        length = [0] * n
        for end, (size, token) in self._automaton.iter(unit.decode("latin-1")):
            start = end - size + 1
            if size > length[start]:
                length[start], longest[start] = size, token
        tokens, prefix, compatible = self.tokens, self._prefix, self.compatible
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        position, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = position + len(tokens[token])
                if open_[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    position = end
                    token = longest[end] if end < n else -1
                    break
                shorter = prefix[token]
                if shorter >= 0:
                    token = shorter
                    continue
                open_[position] = 0
                out.pop()
                token = last
                position -= len(tokens[last])
                break
        return out

    def _packed(self, piece: str) -> bytes:
        """The ids of a piece as packed 32-bit integers."""
        memory = self._memory
        units = _UNITS.findall(piece)
        found = list(map(memory.get, units))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    parts = units[k].translate(self._cuts).split("\n") if units[k] > "\u4e00" or " \u4e00" < units[k] < "!" else [units[k]]
                    found[k] = b"".join([memory.get(p) or self._learned(p) for p in parts if p])
        return b"".join(found)

    def _learned(self, unit: str) -> bytes:
        ids = _pack(self.encode_unit(unit.encode("utf-8")))
        if len(unit) <= _REMEMBER:
            if len(self._memory) >= _CAPACITY:
                self._memory.clear()
            self._memory[unit] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers.

        A space before a character that is no white space always opens a pre-token, so a text without other
        kinds of spacing can be cut there with `str.split`, and the many pieces seen before cost one
        dictionary look-up each.
        """
        if _SPACING.search(text):
            return self._packed(text)
        parts = text.split(" ")
        spaced = self._spaced
        found = list(map(spaced.get, parts))
        found[0] = self._packed(parts[0])
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    part = parts[k]
                    found[k] = ids = self._packed(" " + part)
                    if len(part) <= _REMEMBER:
                        if len(spaced) >= _CAPACITY:
                            spaced.clear()
                        spaced[part] = ids
        return b"".join(found)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text or "")) // 4

    def decode(self, ids) -> str:
        table, offsets = self.table, self.offsets
        return b"".join(table[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


_SPACING = regex.compile(r" (?:\s|[\x1c-\x1f\x85]|$)")


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_ENCODERS: dict[int, BacktrackingEncoder] = {}


def encoder_of(data: bytes) -> BacktrackingEncoder:
    """The encoder of a rank file, built once per worker process."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = BacktrackingEncoder(read_ranks(data))
    return _ENCODERS[key]
