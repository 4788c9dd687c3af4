"""Byte-level BPE encoding of whole texts, a column at a time, with a memo of units.

A *unit* is a stretch of text between two cuts.  Cuts lie where the pre-tokeniser's
pattern always ends a piece and scans on without memory of what came before:

* before a space that follows a non-blank character;
* between a letter, digit, mark or apostrophe and a line feed, and after that line
  feed before another one of those;
* between runs of letters, of digits and of other ASCII marks, but for the
  places after an apostrophe (it may begin a contraction) and inside the string
  of an added token.

Letters here are A-Z, a-z and the two-byte ones up to U+027F; next to any other
character only the first rule cuts.  So the ids of a text are the ids of its
units, one after the other, exactly.

Cuts are found on the UTF-8 bytes of a column at once, and each unit is looked
up by a 64-bit hash, its first and its last eight bytes in an open-addressing
table of numpy arrays; only units that the table lacks become Python strings, and
the library encodes them.  A worker keeps its table from task to task, in two
generations of at most ``memo`` units (about 60 bytes each): when the young one
is full it becomes the old one, and what is met again moves back.  Units of more
than ``longest`` bytes are asked for each time.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .wordhash import U64, mix, power_tables, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text looked at at once.
CHUNK = 1 << 20
_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _FEED, _BLANK = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[39] = _APOSTROPHE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0xC3:0xCA] = _LETTER
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31, 32]] = _BLANK
_CLASS[10] = _FEED
#: Whether a cut lies between two classes.
_CUTS = np.zeros((7, 7), bool)
_CUTS[_LETTER, [_DIGIT, _MARK, _APOSTROPHE, _FEED]] = True
_CUTS[_DIGIT, [_LETTER, _MARK, _APOSTROPHE, _FEED]] = True
_CUTS[_MARK, [_LETTER, _DIGIT, _FEED]] = True
_CUTS[_APOSTROPHE, [_DIGIT, _FEED]] = True
_CUTS[_FEED, [_LETTER, _DIGIT, _MARK, _APOSTROPHE]] = True
_CUTS = _CUTS.reshape(-1)
#: Blank characters of several bytes, as numbers of their last three bytes.
_WIDE_BLANKS = np.asarray(sorted(int.from_bytes(chr(c).encode().rjust(3, b"\0")[-3:]) for c in range(128, 0x3001) if chr(c).isspace()), np.int64)
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_LOW = np.asarray([(1 << 8 * k) - 1 for k in range(9)], U64)  # masks of so many bytes
_encoders: dict[str, "UnitEncoder"] = {}


def _solid_end(u: bytes) -> bool:
    """Whether a unit ends in a letter, digit or mark that the classes above know."""
    return 32 < u[-1] < 127 or (len(u) > 1 and 0xC3 <= u[-2] <= 0xC9 and u[-1] >= 0x80 and u[-2:] not in (b"\xc3\x97", b"\xc3\xb7"))


def _cut_mask(data: np.ndarray) -> np.ndarray:
    """Whether a cut lies before each byte, from the bytes alone; data begins with a unit."""
    kind = _CLASS[data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = wide[(data[wide] >= 0xC3) & (data[wide] <= 0xC9)]
        lead = lead[lead + 1 < len(data)]
        sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]
        kind[lead + 1] = _LETTER
        kind[sign] = kind[sign + 1] = _OTHER  # the signs of multiplication and division
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUTS[kind[:-1] * np.uint8(7) + kind[1:]]
    feed = np.flatnonzero(kind[:-1] == _FEED)
    cut[feed + 1] &= cut[feed]
    space = np.flatnonzero(data[1:] == 32) + 1
    before = kind[space - 1]
    solid = (before != _BLANK) & (before != _FEED)
    odd = np.flatnonzero((before == _OTHER) & (data[space - 1] >= 0x80))
    if len(odd):
        p = space[odd]
        lead = np.where(p >= 3, data[np.maximum(p - 3, 0)], 0)
        two, three = data[p - 2].astype(np.int64) << 8 | data[p - 1], lead.astype(np.int64) << 16
        solid[odd] = ~(np.isin(two, _WIDE_BLANKS) | np.isin(two | three, _WIDE_BLANKS))
    cut[space] = solid
    return cut


class _Table:
    """Ids of units: slots of an open-addressing table point at entries, entries at stretches of one pool."""

    def __init__(self, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.mask = (1 << max(4, (3 * most).bit_length())) - 1
        self.slot = np.zeros(self.mask + 1, np.int32)
        self.keys = np.empty((3, most), U64)
        self.begin, self.size = np.empty(most, np.int64), np.empty(most, np.int32)
        self.pool = np.empty(4 * most, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each unit (a column of hash, head, tail), or -1."""
        h, head, tail = keys
        out = np.full(len(h), -1, np.int32)
        at = (h & U64(self.mask)).astype(np.int64)
        todo, entry = None, self.slot[at] - 1
        while True:
            e = np.maximum(entry, 0)
            mine = (h if todo is None else h[todo], head if todo is None else head[todo], tail if todo is None else tail[todo])
            same = (entry >= 0) & (self.keys[0][e] == mine[0]) & (self.keys[1][e] == mine[1]) & (self.keys[2][e] == mine[2])
            if todo is None:
                out[same] = entry[same]
            else:
                out[todo[same]] = entry[same]
            more = np.flatnonzero((entry >= 0) & ~same)
            if not len(more):
                return out
            todo = more if todo is None else todo[more]
            at[todo] = (at[todo] + 1) & self.mask
            entry = self.slot[at[todo]] - 1

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Enter distinct units that are not here yet; there must be room."""
        k, n = len(size), self.n
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(ids), "<u4")])
        self.keys[:, n : n + k], self.size[n : n + k] = keys, size
        self.begin[n : n + k] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.used = n + k, self.used + len(ids)
        number, at, todo = np.arange(n + 1, n + k + 1, dtype=np.int32), (keys[0] & U64(self.mask)).astype(np.int64), np.arange(k)
        while len(todo):
            free = todo[self.slot[at[todo]] == 0]
            self.slot[at[free]] = number[free]  # of several that want one slot the last gets it
            todo = todo[self.slot[at[todo]] != number[todo]]
            at[todo] = (at[todo] + 1) & self.mask


def _stretches(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[begin : begin + size] of each, one after the other."""
    upto = np.cumsum(size, dtype=np.int64)
    return pool[np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


class UnitEncoder:
    """Ids as the tokenizers library gives them without added begin and end tokens."""

    def __init__(self, tokenizer_path: str, memo: int = 1 << 18, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.longest = longest
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in tokens]
        self.splits = self._byte_level() and not any(min(a, default=0) <= 32 for a in self.added) and not any(t.lstrip or t.rstrip or t.normalized or t.single_word for t in tokens)
        self.young, self.old = _Table(memo), _Table(16)
        # A token stands for so many bytes: those of its string, where every byte is written as one character.
        self.width = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[number] = len(token)
        for number, t in self.tokenizer.get_added_tokens_decoder().items():
            self.width[number] = len(t.content.encode())

    def _byte_level(self) -> bool:
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        return state.get("normalizer") is None and state["model"].get("type") == "BPE" and not state["model"].get("dropout") and pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not pre.get("add_prefix_space", True)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids, about a MB of text in a call, as its results are many times larger than ids."""
        out, held, size = [], [], 0
        for k, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size > 1 << 18 or k + 1 == len(texts):
                out += [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)]
                held, size = [], 0
        return out

    def _new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and how many each has.

        Units that begin with a space, or with any ASCII character above it, and end in a letter or mark are joined before
        they are encoded, with line feeds where there is no space, as cuts lie at all those places; which ids are whose
        follows from the bytes that they stand for.
        """
        if not units:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        joins = [k for k, u in enumerate(units) if 32 <= u[0] < 127 and _solid_end(u)]
        groups = [joins[k : k + 512] for k in range(0, len(joins), 512)] + [[k] for k in sorted(set(range(len(units))).difference(joins))]
        got: list = [None] * len(units)
        texts = [[units[k] if units[k][0] == 32 else b"\n" + units[k] for k in g] if len(g) > 1 else [units[g[0]]] for g in groups]
        for group, text, ids in zip(groups, texts, self._ask([b"".join(t).decode() for t in texts])):
            if len(group) == 1:
                got[group[0]] = ids
                continue
            at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(t) for t in text])) + 1
            for k, t, a, b in zip(group, text, [0, *at.tolist()], at.tolist()):
                got[k] = ids[a + (t[0] == 10) : b]
        return np.concatenate(got), np.asarray([len(g) for g in got], np.int64)

    def _chunk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each unit of a chunk has, and, if wanted, the ids."""
        size = ends - starts
        power, inverse = power_tables(len(data))
        total = _VALUE[data]
        total *= power[: len(data)]
        np.cumsum(total, out=total)
        h = total[ends - 1]
        inner = starts > 0
        h[inner] -= total[starts[inner] - 1]
        del total
        h *= inverse[starts]
        h ^= size.astype(U64) << U64(48)
        keys = np.empty((3, len(size)), U64)
        keys[0] = mix(h)
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        keys[1] = words[starts] & _LOW[np.minimum(size, 8)]
        keys[2] = np.where(size > 8, words[np.maximum(ends - 8, 0)], 0)
        short = size <= self.longest
        entry = self.young.find(keys)
        lacks = np.flatnonzero((entry < 0) & short)
        if len(lacks):
            _, first = np.unique(keys[0][lacks], return_index=True)
            first = lacks[np.sort(first)]
            if self.young.n + len(first) > self.young.most:
                self.old, self.young = self.young, _Table(self.young.most)
                entry = np.full(len(size), -1, np.int32)
                lacks = np.flatnonzero(short)
                _, first = np.unique(keys[0][lacks], return_index=True)
                first = lacks[np.sort(first)][: self.young.most]
            had = self.old.find(keys[:, first])
            again, new = first[had >= 0], first[had < 0]
            had = had[had >= 0]
            self.young.add(keys[:, again], _stretches(self.old.pool, self.old.begin[had], self.old.size[had]), self.old.size[had])
            raw = data.tobytes()
            self.young.add(keys[:, new], *self._new([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]))
            entry[lacks] = self.young.find(keys[:, lacks])
        left = np.flatnonzero(entry < 0)  # long ones, those beyond the table's size, and those whose hash another one has
        n, begin, pool = self.young.size[entry].astype(np.int64), self.young.begin[entry], self.young.pool
        if len(left):
            raw = data.tobytes()
            ids, many = self._new([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())])
            n[left], begin[left] = many, self.young.used + np.cumsum(many) - many
            pool = np.concatenate([pool[: self.young.used], ids]) if want else pool
        return n, _stretches(pool, begin, n) if want else None

    def _encode(self, column, want: bool) -> tuple[np.ndarray, np.ndarray]:
        data, offs = text_bytes(column)
        at = np.zeros(len(offs), np.int64)  # ids before each text
        parts: list[np.ndarray] = []
        done = lo = 0
        if not self.splits:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offs.tolist(), offs[1:].tolist())]
            for k, t in enumerate(texts):
                got = self._ask([t])[0] if t else np.zeros(0, "<u4")
                parts += [got] if want else []
                at[k + 1] = at[k] + len(got)
            return np.concatenate(parts) if parts else np.zeros(0, "<u4"), at
        reach = max(map(len, self.added), default=0) + 4  # a cut this near to a chunk's end isn't sure
        while lo < len(data):
            span = CHUNK
            while True:
                hi = min(len(data), lo + span)
                part = data[lo:hi]
                cut = _cut_mask(part)
                raw = part.tobytes() if self.added else b""
                for a in self.added:
                    k = raw.find(a)
                    while k >= 0:
                        cut[k + 1 : k + len(a)] = False
                        k = raw.find(a, k + 1)
                first, last = np.searchsorted(offs, [lo, hi])
                cut[offs[first:last] - lo] = True
                cut[0] = True
                if hi == len(data):
                    stop = hi - lo
                    break
                sure = np.flatnonzero(cut[: len(cut) - reach])
                if len(sure) > 1:
                    stop = int(sure[-1])
                    break
                span *= 2
            if span > CHUNK and stop > CHUNK:  # a unit longer than a chunk: by itself
                starts = np.flatnonzero(cut[:stop])
                stop = int(starts[1]) if len(starts) > 1 else stop
                ids = self._ask([part[:stop].tobytes().decode()])[0]
                starts, n = np.zeros(1, np.int64), np.asarray([len(ids)])
            else:
                starts = np.flatnonzero(cut[:stop])
                n, ids = self._chunk(part[:stop], starts, np.append(starts[1:], stop), want)
            if want:
                parts.append(ids)
            first, last = np.searchsorted(offs, [lo, lo + stop])
            before = np.concatenate([[0], np.cumsum(n)])
            at[first:last] = done + before[np.searchsorted(starts, offs[first:last] - lo)]
            done, lo = done + int(before[-1]), lo + stop
        at[np.searchsorted(offs, len(data)) :] = done
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), at

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts of an Arrow string column, and where each text's begin; none for null and empty texts."""
        return self._encode(column, True)

    def counts(self, column) -> np.ndarray:
        """How many ids each text has."""
        return np.diff(self._encode(column, False)[1])


def encoder(tokenizer_path: str) -> UnitEncoder:
    """This process's encoder of a vocabulary, kept from task to task."""
    if tokenizer_path not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_path] = UnitEncoder(tokenizer_path)
    return _encoders[tokenizer_path]
