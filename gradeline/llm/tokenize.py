"""Token ids of many texts with a tokenizers file, each distinct unit encoded once per worker.

Texts lie end to end as bytes. Array operations find the pre-tokens of plain stretches (ASCII and Latin letters to
U+023F), hash each, and look its ids up in a table. What is new is encoded by the library, many units in one text:
pre-tokens don't influence each other, so the ids are cut apart again where the file's own marks show the borders.

Plain rules don't cover all: an apostrophe may begin a contraction, marks may combine, special tokens are sought in raw
text. A piece that holds such a sign is one unit, which the library encodes as a text. Pieces end where no token can
cross: a byte-level pre-token takes a single blank between visible characters as its first one, and a tokenizer that
drops white space ends its pre-tokens there.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import regex

from .common import remembered

#: Units that one worker remembers; beyond it the memory starts anew. Results don't depend on it.
REMEMBERED = 1_200_000
#: Slots of the table, a power of two; and the longest unit in bytes that is remembered.
SLOTS, LONGEST = 1 << 21, 48
#: Bytes of text that are worked on at a time; arrays over them take some fifty times as much. A longer text is cut at a blank.
TOGETHER = 1 << 18
#: Units that the library encodes as one text.
JOINED = 256
#: Fixed: the pre-tokens of the byte-level tokenizers.
BLANK_KEPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The character by which a byte-level vocabulary writes each byte: visible Latin-1 as itself, the rest from U+0100 on.
_visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_hidden = [b for b in range(256) if b not in _visible]
BYTES = {b: chr(b) for b in _visible} | {b: chr(256 + i) for i, b in enumerate(_hidden)}

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Class of each byte: plain ASCII, or ODD. Continuation bytes belong to a lead byte, whose pair says more.
_class = np.full(256, ODD, np.uint8)
for _b in range(33, 127):
    _class[_b] = LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else OTHER
_class[[9, 10, 13, 32]] = SPACE
#: Bytes that make a piece odd: controls, the apostrophe and leads of characters from U+0240 on.
_odd = np.zeros(256, bool)
_odd[[*range(9), 11, 12, *range(14, 32), 39, 127, *range(201, 256)]] = True
#: Class of the characters of two bytes, by lead (0xC2 to 0xC8) and continuation.
_pair = np.full((7, 64), ODD, np.uint8)
for _c in range(0xA1, 0x240):
    _s = chr(_c)
    _plain = regex.fullmatch(r"\p{L}", _s) and regex.fullmatch(r"\p{L}", _s.lower())
    _pair[(_c >> 6) - 2, _c & 63] = LETTER if _plain else OTHER if regex.fullmatch(r"\p{P}|\p{S}", _s) else ODD

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C13)
_sign = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
with np.errstate(over="ignore"):
    _power = np.cumprod(np.full(64, _STEP))
_CUT = re.compile(rb"[!-~] (?=[!-~])")


class UnitMemory:
    """Ids per hashed unit: an open-addressing table of slots into one flat array. No unit has more ids than bytes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key, self.entry, self.n, self.used = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        slot = (h & _U(SLOTS - 1)).astype(np.int64)
        key = self.key[slot]
        out = np.where(key == h, self.entry[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            key = self.key[slot[left]]
            same = key == h[left]
            out[left[same]] = self.entry[slot[left[same]]]
            left = left[~same & (key != 0)]
        return out

    def add(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entries for units with these ids, end to end."""
        n, k = self.n, len(lengths)
        while len(self.start) < n + k:
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        while len(self.flat) < self.used + len(values):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(values)] = values
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + k] = lengths
        self.n, self.used = n + k, self.used + len(values)
        return np.arange(n, n + k)

    def register(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Puts distinct new hashes into the table."""
        slot, todo = (h & _U(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.key[s] == 0
            self.key[s[free]] = h[todo[free]]
            placed = self.key[s] == h[todo]
            self.entry[s[placed]] = entries[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)


class PieceEncoder:
    """encode(texts) gives all ids end to end and the number of ids of each text; a null text has none."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.blank_kept = spec["pre_tokenizer"]["type"] == "ByteLevel"
        assert all(t["content"].startswith("<|") for t in spec["added_tokens"])
        vocab = spec["model"]["vocab"]
        #: The ids that show a border between joined units: that of a line end alone, or of what ends a word.
        self.border = np.zeros(max(vocab.values()) + 1 + len(spec["added_tokens"]), bool)
        self.border[[vocab[BYTES[10]]] if self.blank_kept else [i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.memory = UnitMemory()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.large_string()), end)

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same of an Arrow column; end is an id that is put after each text's own."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n, counts, parts = len(texts), np.zeros(len(texts), np.int64), []
        if not n:
            return np.zeros(0, np.uint32), counts
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
        at, to = 0, 0
        while at < n:
            while to < n and (to == at or off[to + 1] - off[at] <= TOGETHER):
                to += 1
            if off[to] - off[at] <= TOGETHER:
                ids, counts[at:to] = self._encode(raw[off[at] : off[to]], off[at : to + 1] - off[at], end)
            else:
                ids, counts[at] = self._long(raw[off[at] : off[to]], end)
            parts.append(ids)
            at = to
        return np.concatenate(parts), counts

    def _long(self, b: np.ndarray, end: int | None) -> tuple[np.ndarray, int]:
        """One long text, cut at blanks between visible characters."""
        data, at, parts = b.tobytes(), 0, []
        while at < len(data):
            cut = _CUT.search(data, at + TOGETHER)
            to = cut.start() + 1 if cut else len(data)
            parts.append(self._encode(b[at:to], np.array([0, to - at]), None)[0])
            at = to
        ids = np.concatenate(parts if end is None else [*parts, np.array([end], np.uint32)])
        return ids, len(ids)

    def _units(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units start, which of them are odd pieces, and which are white space."""
        n = len(b)
        kind, odd = _class[b], _odd[b]
        lead = np.flatnonzero((b >= 0xC2) & (b <= 0xC8))
        after = np.minimum(lead + 1, n - 1)
        kind[lead] = kind[after] = _pair[b[lead] - 0xC2, b[after] & 63]
        odd[lead] |= kind[lead] == ODD
        odd[:-1] |= (b[:-1] == ord("<")) & (b[1:] == ord("|"))
        first = np.zeros(n + 1, bool)
        first[off] = True
        space = kind == SPACE
        start = first[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        piece = first[:-1].copy()
        if self.blank_kept:
            # the last of white space stands alone, and a blank goes with what follows it, so that no unit starts there
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
            blank = last & (b == 32)
            start[1:] &= ~(blank[:-1] & ~first[1:-1])
            start |= last
            visible = ~space & ~(odd & (b < 32))
            visible[lead[kind[lead] == ODD]] = visible[after[kind[lead] == ODD]] = False
            visible[self._wide_space(b)] = False
            if n > 2:
                piece[1:-1] |= blank[1:-1] & visible[:-2] & visible[2:] & ~first[1:-2]
        else:
            start |= kind == DIGIT
            piece |= space
        pos = np.flatnonzero(odd)
        is_odd = np.zeros(n, bool)
        if len(pos):
            begins = np.flatnonzero(piece)
            which = np.unique(np.searchsorted(begins, pos, "right") - 1)
            low, high = begins[which], np.append(begins, n)[which + 1]
            step = np.zeros(n + 1, np.int8)
            step[low] += 1
            step[high] -= 1
            start &= np.cumsum(step[:-1], dtype=np.int8) == 0
            start[low] = is_odd[low] = True
        at = np.flatnonzero(start)
        return at, is_odd[at], space[np.append(at[1:], n) - 1] & ~is_odd[at]

    @staticmethod
    def _wide_space(b: np.ndarray) -> np.ndarray:
        """All bytes of characters that may be white space and take three bytes, and of some that aren't."""
        lead = np.flatnonzero((b == 0xE1) | (b == 0xE2) | (b == 0xE3))
        lead = lead[lead + 2 < len(b)]
        second, third = b[lead + 1], b[lead + 2]
        quotes = (b[lead] == 0xE2) & (second == 0x80) & (third >= 0x8B) & (third != 0xA8) & (third != 0xA9) & (third != 0xAF)
        lead = lead[~quotes & (((b[lead] == 0xE1) & (second <= 0xA0)) | ((b[lead] == 0xE2) & (second <= 0x81)) | ((b[lead] == 0xE3) & (second == 0x80)))]
        return np.concatenate([lead, lead + 1, lead + 2])

    def _encode(self, b: np.ndarray, off: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        memory, k = self.memory, len(off) - 1
        if memory.n > REMEMBERED:
            memory.clear()
        if len(b):
            at, odd, white = self._units(b, off)
            size = np.diff(np.append(at, len(b)))
            place = np.minimum(np.arange(len(b)) - np.repeat(at, size), 63)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(_sign[b] * _power[place], at) + size.astype(np.uint64) * _STEP
                h = (h ^ h >> _U(30)) * _U(0xBF58476D1CE4E5B9)
                h = (h ^ h >> _U(27)) * _U(0x94D049BB133111EB)
                h ^= h >> _U(31)
            h[h == 0] = 1
            if not self.blank_kept:
                keep = ~white
                at, size, h, odd, white = at[keep], size[keep], h[keep], odd[keep], white[keep]
            entry, registered = self._entries(b, at, size, h, odd | white)
            units = np.diff(np.append(np.searchsorted(at, off[:-1]), len(at)))
        else:
            entry, units, registered = np.zeros(0, np.int64), np.zeros(k, np.int64), (memory.n, memory.used)
        if end is not None:
            entry = np.insert(entry, np.cumsum(units), memory.add(np.array([end], np.uint32), np.array([1]))[0])
            units = units + 1
        length = memory.length[entry]
        ends = np.cumsum(length, dtype=np.int64)
        ids = memory.flat[np.repeat(memory.start[entry] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        marks = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(units)])]
        memory.n, memory.used = registered  # what follows isn't remembered
        return ids, np.diff(marks)

    def _entries(self, b: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        """The entry of each unit, and where the memory of those that are remembered ends."""
        memory = self.memory
        short = size <= LONGEST
        entry = memory.find(h)
        entry[~short] = -1
        new, where = np.unique(h[(entry < 0) & short], return_index=True)
        where = np.flatnonzero((entry < 0) & short)[where]
        if len(new):
            memory.register(new, self._learn(b, at[where], size[where], alone[where]))
            missing = np.flatnonzero((entry < 0) & short)
            entry[missing] = memory.find(h[missing])
        registered = memory.n, memory.used
        if len(where := np.flatnonzero(~short)):
            entry[where] = self._learn(b, at[where], size[where], alone[where])
        return entry, registered

    def _learn(self, b: np.ndarray, at: np.ndarray, size: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Entries of new units. Those that stand alone are texts by themselves, the others are joined."""
        out = np.zeros(len(at), np.int64)
        for together in (False, True):
            which = np.flatnonzero(alone != together)
            for i in range(0, len(which), JOINED):
                some = which[i : i + JOINED]
                texts = [b[a : a + s].tobytes().decode("utf-8", "replace") for a, s in zip(at[some].tolist(), size[some].tolist())]
                values, lengths = self._joined(texts) if together else self._alone(texts)
                out[some] = self.memory.add(values, lengths)
        return out

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(texts)
        return np.array([x for own in ids for x in own], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.whole(["\n".join(texts)])[0], np.uint32)
        borders = np.flatnonzero(self.border[ids])
        if self.blank_kept:
            lengths = np.diff(np.concatenate([[-1], borders, [len(ids)]])) - 1
            ids = np.delete(ids, borders)
        else:
            lengths = np.diff(np.concatenate([[-1], borders]))
        return (ids, lengths) if len(lengths) == len(texts) and lengths.sum() == len(ids) else self._alone(texts)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizers file."""
    return remembered(("encoder", path), lambda: PieceEncoder(path))
