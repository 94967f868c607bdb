"""Pre-tokens of many texts at once, and a table that remembers their ids.

The split pattern knows four kinds of characters: letters, digits, white space
and the rest.  For texts of ASCII and accented Latin letters the kind of each
byte is a table entry, so all pre-token boundaries of a piece of the corpus
follow from a few numpy passes.  Other texts take the pattern itself.

Each pre-token is hashed to 64 bits and looked up in an open-addressing table
held by the worker; only unknown ones go to the encoder.  An entry keeps its
bytes and counts only for spans of the same bytes; others of that hash are
looked up by another hash.  The table has a fixed size and starts anew when it
is half full.
"""
from __future__ import annotations

import numpy as np

from artscan.llm import textkit
from artscan.llm.bpe import splitter

#: The split pattern whose meaning ``cut`` reproduces (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_END, _LETTER, _DIGIT, _SPACE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Bytes that only texts outside ASCII and U+00C0 to U+017F have.
_FOREIGN = np.zeros(256, dtype=bool)
_FOREIGN[0xC0:] = True
_FOREIGN[0xC2] = True
_FOREIGN[[0xC3, 0xC4, 0xC5]] = False


def foreign(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts that ``cut`` can't take: with characters beyond the plain ones, or the two signs among them."""
    odd = _FOREIGN[buffer]
    signs = np.flatnonzero(buffer[:-1] == 0xC3)
    odd[signs] |= (buffer[signs + 1] == 0x97) | (buffer[signs + 1] == 0xB7)
    return np.logical_or.reduceat(odd, starts[:-1])


def cut(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every pre-token, and for each text the index of its first."""
    kind = _KIND[buffer]
    kind[starts[1:] - 1] = _END
    opens = np.ones(len(kind), dtype=bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[starts[:-1]] = True
    # White space before something: its last character goes with what follows if it is a blank, else it stands alone.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
    opens[last] = True
    opens[last[buffer[last] == 32] + 1] = False
    # Contractions: an apostrophe that begins a pre-token, directly before letters.
    at = np.flatnonzero((buffer == 39) & opens)
    at = at[at + 2 < len(buffer)]
    at = at[kind[at + 1] == _LETTER]
    one, two = buffer[at + 1], buffer[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    at, size = at[short | long], np.where(short, 2, 3)[short | long]
    opens[at + 1] = False
    rest = at + size
    opens[rest[kind[rest] == _LETTER]] = True
    all_opens = np.flatnonzero(opens)
    begin = all_opens[kind[all_opens] != _END]
    end = np.append(all_opens[1:], len(buffer))[kind[all_opens] != _END]
    return begin, end, np.searchsorted(begin, starts)


class Memo:
    """Hash of a pre-token to its bytes and its run of ids."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.slots = np.zeros(1 << bits, dtype=np.int32)
        self.count, self.used = 0, 0
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.bytes_used = 0
        self.room = textkit.padded(1 << 20)
        self.from_byte, self.to_byte = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        return ((h + np.uint64(turn) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for unknown ones."""
        out = np.full(len(h), -1, dtype=np.int32)
        left = np.arange(len(h))
        turn = 0
        while len(left):
            slot = self._slot(h[left], turn)
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            left = left[~hit & (key != 0)]
            turn += 1
        return out

    def add(self, h: np.ndarray, pieces: list[bytes], runs: list) -> None:
        """Adds distinct unknown hashes with their bytes and ids."""
        sizes = np.fromiter(map(len, runs), dtype=np.int32, count=len(runs))
        entry = np.arange(self.count, self.count + len(h), dtype=np.int32)
        total = int(sizes.sum())
        while self.count + len(h) > len(self.begin):
            self.begin, self.size, self.from_byte, self.to_byte = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.size, self.from_byte, self.to_byte))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.begin[entry] = self.used + np.cumsum(sizes) - sizes
        self.size[entry] = sizes
        self.flat[self.used : self.used + total] = np.concatenate([np.asarray(r, dtype=np.uint32) for r in runs]) if runs else 0
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        if self.bytes_used + len(raw) + 8 > len(self.room):
            grown = textkit.padded(2 * (self.bytes_used + len(raw)))
            grown[: self.bytes_used] = self.room[: self.bytes_used]
            self.room = grown
        self.room[self.bytes_used : self.bytes_used + len(raw)] = raw
        self.to_byte[entry] = self.bytes_used + np.cumsum([len(p) for p in pieces])
        self.from_byte[entry] = self.to_byte[entry] - [len(p) for p in pieces]
        self.bytes_used += len(raw)
        self.count += len(h)
        self.used += total
        left, turn = np.arange(len(h)), 0
        while len(left):
            slot = self._slot(h[left], turn)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            won = self.keys[slot] == h[left]
            self.slots[slot[won]] = entry[left[won]]
            left = left[~won]
            turn += 1

    def holds(self, entry: np.ndarray, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the entries have the bytes of these spans."""
        return textkit.same_spans(self.room, self.from_byte[entry], self.to_byte[entry], buffer, begin, end)

    def runs(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in order, and the number of ids of each."""
        size = self.size[entry].astype(np.int64)
        end = np.cumsum(size)
        shift = np.repeat(self.begin[entry] - (end - size), size)
        return self.flat[np.arange(end[-1] if len(end) else 0) + shift], size


class Encoder:
    """Texts to ids by any function that encodes a list of pre-tokens."""

    def __init__(self, encode_many, pattern: str = PATTERN):
        self.encode_many, self.memo = encode_many, Memo()
        self.split, self.plain = splitter(pattern), pattern == PATTERN

    def _entries(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: bytes) -> np.ndarray:
        """Entries of the pre-tokens; those that share a hash with other bytes are tried by the next one."""
        out, left, lane = np.zeros(len(begin), dtype=np.int32), np.arange(len(begin)), 0
        while len(left):
            a, b = begin[left], end[left]
            h = textkit.span_hashes(buffer, a, b, lane)
            entry = self.memo.find(h)
            unknown = np.flatnonzero(entry < 0)
            if len(unknown):
                new, place = np.unique(h[unknown], return_index=True)
                if self.memo.count + len(new) > 1 << (self.memo.bits - 1):
                    self.memo = Memo(max(self.memo.bits + (lane > 0), int(2 * len(new) - 1).bit_length()))
                    return self._entries(buffer, begin, end, whole)
                pieces = [whole[a[i] : b[i]] for i in unknown[place]]
                self.memo.add(new, pieces, self.encode_many([p.decode() for p in pieces]))
                entry[unknown] = self.memo.find(h[unknown])
            same = self.memo.holds(entry, buffer, a, b)
            out[left[same]] = entry[same]
            left, lane = left[~same], lane + 1
        return out

    def encode(self, column):
        """Yields (ids, first id of each text) per piece of a string column."""
        for at, buffer, starts in textkit.pieces(column):
            odd = foreign(buffer, starts) if self.plain else np.ones(len(starts) - 1, dtype=bool)
            begin, end, first = cut(buffer, starts)
            if odd.any():
                keep = ~np.repeat(odd, np.diff(first))
                begin, end = begin[keep], end[keep]
                first = np.concatenate(([0], np.cumsum(np.diff(first) * ~odd)))
            whole = buffer.tobytes()
            entry = self._entries(buffer, begin, end, whole)
            ids, size = self.memo.runs(entry)
            cuts = np.concatenate(([0], np.cumsum(size)))[first]
            if not odd.any():
                yield ids, cuts
                continue
            parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            for i in np.flatnonzero(odd):
                pieces = self.split(whole[starts[i] : starts[i + 1] - 1].decode())
                runs = dict(zip(known := list(dict.fromkeys(pieces)), self.encode_many(known)))
                parts[i] = np.concatenate([np.asarray(runs[p], dtype=np.uint32) for p in pieces]) if pieces else np.zeros(0, dtype=np.uint32)
            yield np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
