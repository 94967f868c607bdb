"""Byte-level BPE by prefix dynamic programming, and the pre-tokens it works on.

For every prefix of a byte string there is exactly one token that can end its
encoding.  ``Prefixes`` stores those last tokens: the next one is the token t
ending there whose predecessor, the stored last token of the prefix before t,
may stand beside it.  Appending bytes only adds entries, an edit recomputes
entries from the edit on until they agree with the old ones again, and the
encoding is read off from the end.

Whether two tokens may stand beside each other is a property of the pair (the
bytes of both, encoded together, give just these two) and is remembered.

``splitter`` applies a vocabulary's split pattern to a text; ``pretokens`` does
so for many texts at once and remembers what was encoded.
"""
from __future__ import annotations

import base64
import re

import regex

#: White space as the split pattern means it (fixed value).
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters for which the standard library's classes differ from \p{L} and \p{N}.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1\\xa7\\xa8\\xab\\xb0\\xb4\\xb7\\xbb\\xbf-\\u017f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]*")


def splitter(pattern: str):
    """A function that lists the pre-tokens of a text, by ``pattern`` read with Unicode white space."""
    exact = regex.compile(pattern.replace("[^\\s", "[^" + _SPACE).replace("\\s", "[" + _SPACE + "]").replace("\\S", "[^" + _SPACE + "]"))
    plain = re.compile(pattern.replace("[^\\s\\p{L}\\p{N}]", "(?:[^\\s\\w]|_)").replace("\\p{L}", "[^\\W\\d_]").replace("\\p{N}", "\\d"))

    def split(text: str) -> list[str]:
        return (plain if _PLAIN.fullmatch(text) else exact).findall(text)

    return split


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Tokens by bytes and by id, and which pairs of tokens may stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._alone: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used for single pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merge(self.tokens[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class Prefixes:
    """Last tokens of all prefixes of a byte string; ``last[i]`` belongs to the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        ranks = v.ranks
        for begin in range(max(0, end - v.longest), end):
            token = ranks.get(data[begin:end])
            if token is not None and (v.fits(last[begin - 1], token) if begin else v.alone(token)):
                return token
        raise ValueError("no token can end a prefix")

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last(self.data, self.last, end))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Replaces bytes and returns how many entries were computed anew.

        An entry depends on the ``longest`` bytes and entries before it, so
        once that many entries agree with the old ones, all later ones do.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        self.last = old[:begin]
        agree, at = 0, begin
        while at < len(self.data) and agree < self.vocabulary.longest:
            token = self._last(self.data, self.last, at + 1)
            self.last.append(token)
            agree = agree + 1 if at >= begin + len(new) and old[at - shift] == token else 0
            at += 1
        self.last += old[at - shift :] if at < len(self.data) else []
        return at - begin

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


def encode_sorted(vocabulary: Vocabulary, pieces: list[str]) -> list[tuple[str, list[int]]]:
    """Ids of many strings: in sorted order each one appends to the prefix it shares with the last."""
    get, pairs, fits, tokens, longest = vocabulary.ranks.get, vocabulary._pairs, vocabulary.fits, vocabulary.tokens, vocabulary.longest
    out, before, last = [], b"", []
    for piece in sorted(pieces):
        data = piece.encode()
        shared, most = 0, min(len(data), len(before))
        while shared < most and data[shared] == before[shared]:
            shared += 1
        del last[shared:]
        for end in range(shared + 1, len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = get(data[begin:end])
                if token is not None:
                    if begin:
                        left = last[begin - 1]
                        ok = pairs.get(left << 32 | token)
                        if ok is None:
                            ok = fits(left, token)
                    else:
                        ok = vocabulary.alone(token)
                    if ok:
                        last.append(token)
                        break
            else:
                raise ValueError("no token can end a prefix")
        ids, at = [], len(data)
        while at:
            ids.append(last[at - 1])
            at -= len(tokens[last[at - 1]])
        out.append((piece, ids[::-1]))
        before = data
    return out
