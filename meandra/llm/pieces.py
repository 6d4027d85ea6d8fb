"""SentencePiece encoding and decoding by weighted finite-state transducers.

The model file is compiled once: the normaliser (a transducer given as a double-array trie with the
strings it writes, then white space to meta symbols), the pieces (a trie, the transducer from
characters to ids), user-defined pieces, which are cut out first, and byte fallback (one arc a byte
for characters without a piece). A word composed with them is a lattice: states are (position, last piece), arcs
are pieces. The answer is its shortest path in the tropical semiring (min, +).

Arc weights follow the model's kind. A unigram model gives -log p of the piece. A BPE model has
no path weights of its own: its result is the one segmentation in which every two neighbours
are what merging would make of their joined characters. So an arc weighs 0 if the pair (last
piece, piece) keeps this, else infinity, and one finite path is left.

Words repeat, and no piece of a BPE or unigram vocabulary spans the start of a word, so lattices
are solved for each distinct word of a batch once, with a bounded cache between batches. The words
of a batch are solved together: arcs of all words are found by hashes of their characters in the
trie, then one step for each position takes every word's state on.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.llm.common import as_bytes, release, short

META = "▁"
#: Piece types and model kinds of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words of a generation, of which a task remembers two; a longer word than LONG characters is not remembered, nor shortened.
CACHE, LONG = 1 << 17, 64
#: Pairs of pieces that a worker remembers at most (nine bytes each, in slots of which at least a quarter is used), and characters whose lattices are solved together.
PAIRS, TOGETHER = 1 << 20, 1 << 17
_NONE, _START = -(1 << 40), -1
#: Of a slot that holds nothing; below any number in use.
_FREE = -128
_BASE = 0x9E3779B97F4A7C15
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Rules:
    """The rewriting part of a normaliser: at each place the longest rule that fits, else the character as it is."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.plain = re.compile("[%s]*" % "".join(re.escape(chr(c)) for c in range(1, 128) if self._first_byte_free(c)))

    def _first_byte_free(self, byte: int) -> bool:
        """Whether no rule begins with this byte."""
        at = self._next(self.units[0]) ^ byte
        return at >= len(self.units) or self.units[at] & 0x800000FF != byte

    @staticmethod
    def _next(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """(bytes read, what they become) of the longest rule at a place; (0, None) without one."""
        units, node, best = self.units, self._next(self.units[0]), (0, None)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._next(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return best

    def apply(self, text: str) -> list[str]:
        """What each rule or character becomes, in order; a stretch that no rule can begin in stays in one piece."""
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            n, new = self.longest(data, at)
            if new is not None:
                out.append(new.decode("utf-8", "replace"))
                at += n
                continue
            lead = data[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            out.append(data[at : at + n].decode("utf-8", "replace"))
            at += n
        return out


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool
    rules: Rules | None = None
    squeeze: bool = False
    ids: dict[str, int] = field(repr=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.user = {p: struct.pack("<i", i) for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == USER}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=lambda p: (-len(p), p)))) + ")") if self.user else None
        # the piece trie, flat: each prefix of a piece, with its id or -1
        self.trie = {p[:i]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.types.index(UNKNOWN)
        self.floor = min(self.scores, default=0.0) - 10
        # runs of meta symbols may be pieces, but no piece goes on with one after another character
        self.splits = not any(re.search(f"[^{META}]{META}", p) for p in self.ids)
        self._pairs: dict[int, dict[int, bool]] = {}
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pair_slots = _Slots(np.int8)
        self._find: _Slots | None = None
        unknown = " \u2047 ".encode()
        self._out = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if t == CONTROL else unknown if i == self.unknown else p.replace(META, " ").encode() for i, (p, t) in enumerate(zip(self.pieces, self.types))]

    @classmethod
    def load(cls, data: bytes) -> PieceModel:
        pieces, scores, types, kind, dummy, rules, squeeze = [], [], [], UNIGRAM, True, None, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                types.append(f.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if not f.get(5, 1):
                    raise ValueError("models that do not escape white space are not supported")
                dummy, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                rules = Rules(f[2]) if f.get(2) else None
        if kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        return cls(pieces, scores, types, kind, dummy, rules, squeeze)

    # -- normaliser ---------------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        """The text after the normaliser's rules, spaces squeezed if the model says so, a prefix, and meta symbols for spaces.

        User-defined pieces are no matter of the rules.
        """
        parts = [text]
        if self.rules is not None:
            parts = []
            for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if k % 2 or self.rules.plain.fullmatch(part):
                    parts.append(part)
                else:
                    parts += self.rules.apply(part)
        text = "".join(parts)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (META if self.dummy_prefix and text else "") + text.replace(" ", META)

    # -- arcs ---------------------------------------------------------------------------------
    def merge(self, text: str) -> list[int]:
        """Pieces that greedy merging leaves of a short string: the law that arcs obey. Only called for pairs."""
        parts = list(text)
        while True:
            best, at = -_INF, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their characters are merged."""
        after = self._pairs.setdefault(a, {})
        known = after.get(b)
        if known is None:
            known = after[b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def _weight(self, last: int, piece: int) -> float:
        if self.kind == UNIGRAM:
            return -self.scores[piece]
        return 0.0 if last < 0 or self._fits(last, piece) else _INF

    # -- composition and shortest path --------------------------------------------------------
    def _lone_path(self, word: str) -> tuple[int, ...] | None:
        """The shortest path under 0/infinity weights, with one state a position.

        The characters up to a position have one segmentation whose neighbours all fit, so the
        first piece that reaches it at finite cost is the state there. None if that leads nowhere.
        """
        n, ids, find, pairs = len(word), self.ids, self.trie.get, self._pairs
        if word in ids:
            return (ids[word],)
        last: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            here = last[i]
            if here is None:
                continue
            after = pairs.get(here) if here >= 0 else None
            if after is None:
                after = pairs.setdefault(here, {}) if here >= 0 else None
            for j in range(i + 1, n + 1):
                k = find(word[i:j])
                if k is None:
                    break
                if k < 0 or last[j] is not None:
                    continue
                if after is not None:
                    fits = after.get(k)
                    if not (self._fits(here, k) if fits is None else fits):
                        continue
                last[j], back[j] = k, i
            if last[i + 1] is None and word[i] not in ids:
                last[i + 1], back[i + 1] = -2 - ord(word[i]), i
        if last[n] is None:
            return None
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(reversed(out))

    def _path(self, word: str) -> tuple[int, ...]:
        """Tropical shortest path through the lattice of `word`; characters without a piece stay -1 - code point."""
        n = len(word)
        # states at each position: last piece -> (cost, position before, last piece before)
        states: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
        states[0][-1] = (0.0, -1, -1)
        ids, trie = self.ids, self.trie
        for i in range(n):
            here = states[i]
            if not here:
                continue
            if self.kind == UNIGRAM and len(here) > 1:
                # weights do not look back: the cheapest state stands for all
                low = min(here, key=lambda k: (here[k][0], k))
                here = {low: here[low]}
            arcs = []
            for j in range(i + 1, n + 1):
                k = trie.get(word[i:j])
                if k is None:
                    break
                if k >= 0:
                    arcs.append((j, k))
            if word[i] not in ids:
                arcs.append((i + 1, -2 - ord(word[i])))
            for last, (cost, _, _) in here.items():
                for j, k in arcs:
                    step = -self.floor if self.kind == UNIGRAM and k < 0 else 0.0 if k < 0 else self._weight(last, k)
                    if step == _INF:
                        continue
                    old = states[j].get(k)
                    if old is None or cost + step < old[0]:
                        states[j][k] = (cost + step, i, last)
        if not states[n]:
            raise ValueError(f"no path through {word!r}")
        at, last = n, min(states[n], key=lambda k: (states[n][k][0], k))
        out: list[int] = []
        while at:
            out.append(last)
            _, at, last = states[at][last]
        return tuple(reversed(out))

    def _word(self, word: str) -> bytes:
        return self._packed((self.kind == BPE and self._lone_path(word)) or self._path(word))

    def _packed(self, path: Iterable[int]) -> bytes:
        """Ids of a path as bytes; characters without a piece become byte pieces, or one unknown piece for a run of them."""
        out: list[int] = []
        for k in path:
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-2 - k).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def _table(self) -> _Slots:
        """The id of each prefix of a piece by its hash, -1 where it is no piece."""
        if self._find is None:
            names = list(self.trie)
            sums, down = _sums("".join(names))
            ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
            starts = np.concatenate(([0], ends[:-1]))
            self._find = _Slots(np.int32)
            self._find.add((sums[ends] - sums[starts]) * down[starts], np.fromiter(self.trie.values(), np.int32, len(names)))
        return self._find

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fits() for many pairs; what is worked out is kept."""
        keys = (a * len(self.pieces) + b).astype(np.uint64)
        fits = self._pair_slots.of(keys)
        if (new := fits == _FREE).any():
            fresh = np.unique(keys[new])
            if self._pair_slots.count + len(fresh) > PAIRS:
                fresh = np.unique(keys)
                self._pair_slots = _Slots(np.int8)
            n, pieces = len(self.pieces), self.pieces
            self._pair_slots.add(fresh, np.fromiter((self.merge(pieces[x // n] + pieces[x % n]) == [x // n, x % n] for x in fresh.tolist()), np.int8, len(fresh)))
            fits = self._pair_slots.of(keys)
        return fits == 1

    def _solve(self, words: list[str]) -> list[bytes]:
        """The lattices of many words at once, as _lone_path() solves one: the words' packed ids."""
        joined = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        starts = ends - size
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word_of = np.repeat(np.arange(len(words)), size)
        stop = ends[word_of]
        sums, down = _sums(joined)
        table = self._table()
        # arcs: where a prefix of a piece begins, one character more is tried
        at, length, arcs = np.arange(len(codes)), 1, []
        while len(at):
            h = (sums[at + length] - sums[at]) * down[at]
            piece = table.of(h).astype(np.int64)
            known, whole = piece != _FREE, piece >= 0
            arcs.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                arcs.append((at[~whole], np.ones(int((~whole).sum()), np.int64), -2 - codes[at[~whole]]))
            at = at[known]
            length += 1
            at = at[at + length <= stop[at]]
        start, long, piece = (np.concatenate(x) for x in zip(*arcs))
        # a node for each place between characters of a word; arcs in the order of their place in it
        place = start - starts[word_of[start]]
        order = np.argsort(place, kind="stable")
        start, long, piece, place = start[order], long[order], piece[order], place[order]
        source = start + word_of[start]
        target = source + long
        last = np.full(len(codes) + len(words), _NONE)
        back = np.zeros(len(last), np.int64)
        first = starts + np.arange(len(words))
        last[first] = _START
        cuts = np.searchsorted(place, np.arange(int(place.max()) + 2)) if len(place) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            a, t = last[source[lo:hi]], target[lo:hi]
            go = np.flatnonzero((a != _NONE) & (last[t] == _NONE))
            a, k = a[go], piece[lo:hi][go]
            both = np.flatnonzero((a >= 0) & (k >= 0))
            go = np.delete(go, both[~self._fit(a[both], k[both])]) if len(both) else go
            last[t[go]] = piece[lo:hi][go]
            back[t[go]] = source[lo:hi][go]
        # a word that is a piece is that piece
        whole = (place == 0) & (long == size[word_of[start]]) & (piece >= 0)
        last[target[whole]] = piece[whole]
        back[target[whole]] = source[whole]
        # all words' paths backwards, a piece of each at a time
        end = first + size
        reached = last[end] != _NONE
        now, who, found = end[reached], np.flatnonzero(reached), []
        while len(now):
            on = now != first[who]
            now, who = now[on], who[on]
            found.append((who, last[now]))
            now = back[now]
        who = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
        path = np.concatenate([k for _, k in found]) if found else np.empty(0, np.int64)
        turn = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        order = np.lexsort((-turn, who))
        who, path = who[order], path[order]
        cuts = np.searchsorted(who, np.arange(len(words) + 1)).tolist()
        plain = np.ones(len(words), bool)
        plain[who[path < 0]] = False
        packed = path.astype("<i4").tobytes()
        out = []
        for i, (lo, hi, sure) in enumerate(zip(cuts[:-1], cuts[1:], (plain & reached).tolist())):
            out.append(packed[4 * lo : 4 * hi] if sure else self._packed(path[lo:hi].tolist()) if reached[i] else self._packed(self._path(words[i])))
        return out

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of these words; short ones are remembered, those not met for long are dropped."""
        if len(self._words) > CACHE:
            self._older, self._words = self._words, {}
        known, older, asked = self._words, self._older, set(words) - self.user.keys()
        fresh = asked.difference(known)
        if older:
            known.update((w, older[w]) for w in fresh if w in older)
            fresh.difference_update(known)
        fresh = list(fresh)
        extra: dict[str, bytes] = {}
        if self.kind == UNIGRAM:
            found = map(self._word, fresh)
            for w, ids in zip(fresh, found):
                (known if len(w) <= LONG else extra)[w] = ids
        else:
            lo = 0
            while lo < len(fresh):
                hi, chars = lo, 0
                while hi < len(fresh) and (hi == lo or chars + len(fresh[hi]) <= TOGETHER):
                    chars += len(fresh[hi])
                    hi += 1
                for w, ids in zip(fresh[lo:hi], self._solve(fresh[lo:hi])):
                    (known if len(w) <= LONG else extra)[w] = ids
                lo = hi
        return known if not extra and not self.user else known | extra | self.user

    def forget(self) -> None:
        """Drop what was worked out for words: workers outlive their tasks. Pairs of pieces stay, in bounded arrays."""
        self._words.clear()
        self._older.clear()
        self._pairs.clear()

    def words(self, text: str) -> list[str]:
        """Parts of a normalised text that are solved alone: user-defined pieces, and the words between them."""
        if self.cut is not None:
            own = self.user
            return [w for part in self.cut.split(text) if part for w in ([part] if part in own else self._plain_words(part))]
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if not self.splits:
            return [text] if text else []
        return _WORD.findall(text)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for an empty one."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode_bytes() of each text, in groups of some hundred thousand words that are looked up together."""
        out: list[bytes] = []
        held: list[list[str]] = []
        count = 0
        for i, text in enumerate(texts):
            held.append(self.words(self.normalise(text)))
            count += len(held[-1])
            if count > CACHE // 4 or i == len(texts) - 1:
                known = self._learn(itertools.chain.from_iterable(held))
                out += [b"".join(map(known.__getitem__, words)) for words in held]
                held, count = [], 0
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one."""
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int | None]) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8 (bad bytes become U+FFFD), one dummy space taken off.

        An id that is not in the model reads as the unknown piece does; a null one as nothing.
        """
        try:
            if ids and not 0 <= min(ids) <= max(ids) < len(self._out):
                raise TypeError
        except TypeError:
            ids = [i if 0 <= i < len(self._out) else self.unknown for i in ids if i is not None]
        text = b"".join([self._out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if (self.dummy_prefix or self.squeeze) and text.startswith(" ") else text


class _Slots:
    """Small numbers by 64-bit key, for many keys at once: a key is at its slot or in one of the next, before the first free one."""

    def __init__(self, kind: type) -> None:
        self.count, self._bits, self._kind = 0, 10, kind
        self._empty()

    def _empty(self) -> None:
        n = 1 << self._bits
        self._keys, self._values = np.zeros(n, np.uint64), np.full(n, _FREE, self._kind)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, _FREE where there is none."""
        at = self._slot(keys)
        out = self._values[at]
        off = np.flatnonzero((self._keys[at] != keys) & (out != _FREE))
        at, keys = at[off], keys[off]
        while len(off):
            at = (at + 1) & (len(self._keys) - 1)
            out[off] = found = self._values[at]
            on = (self._keys[at] != keys) & (found != _FREE)
            off, at, keys = off[on], at[on], keys[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not in yet, with numbers other than _FREE."""
        self.count += len(keys)
        if 2 * self.count > len(self._keys):
            held = self._values != _FREE
            keys, values = np.concatenate((self._keys[held], keys)), np.concatenate((self._values[held], values))
            self._bits = (4 * self.count - 1).bit_length()
            self._empty()
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self._values[at] == _FREE)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self._keys[at[put]], self._values[at[put]] = keys[put], values[put]
            keys, values, at = (np.delete(x, put) for x in (keys, values, at))
            at = (at + 1) & (len(self._keys) - 1)


def _sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that hash any span of a text's characters, and the factors that move a span's sum to its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    codes = (codes ^ (codes << np.uint64(13))) * np.uint64(0xC2B2AE3D27D4EB4F)
    up, down = _powers(1 << max(10, len(codes).bit_length()))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64))), down


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


#: A word with the meta symbols before it; at the end of a text, meta symbols alone.
_WORD = re.compile(f"{META}*[^{META}]+|{META}+")


@lru_cache(maxsize=4)
def model_of(data: bytes) -> PieceModel:
    """The compiled model, once for each Python worker."""
    return PieceModel.load(data)


def read_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; tasks get them with their code (under 2 MB for public models)."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError("the model file is larger than 16 MB")
    return data


def encode(docs: DataFrame, data: bytes) -> DataFrame:
    """`docs` with ids array<int> (null text: null; empty text: empty). Replaces a column of that name.

    Whole texts are encoded, however long. Repeated rows come back repeated; rows without a doc_id are coded like any.
    """
    rows = docs.drop("ids")
    at = rows.columns.index("text")
    names = rows.columns + ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in short(batches):
            texts = batch.column(at).to_pylist()
            coded = iter(model.encode_many([t for t in texts if t is not None]))
            ids = [None if t is None else np.frombuffer(next(coded), "<i4") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names)
        model.forget()
        release()

    return rows.mapInArrow(run, rows.withColumn("ids", F.expr("cast(null as array<int>)")).schema)


def decode(rows: DataFrame, data: bytes) -> DataFrame:
    """`rows` with text made from ids (null ids: null text; see PieceModel.decode for bad ids). Replaces a column of that name.

    Repeated rows come back repeated.
    """
    kept = rows.drop("text")
    at = kept.columns.index("ids")
    names = kept.columns + ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in short(batches):
            texts = [None if i is None else model.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return kept.mapInArrow(run, kept.withColumn("text", F.lit(None).cast("string")).schema)


def round_trips(docs: DataFrame, data: bytes) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row: encoded and decoded again in one pass; null texts have null in all but doc_id.

    One process codes and checks a text, so a task holds one model and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in short(batches):
            texts = batch.column(1).to_pylist()
            coded = iter(model.encode_many([t for t in texts if t is not None]))
            ids = [None if t is None else np.frombuffer(next(coded), "<i4") for t in texts]
            same = [None if t is None else model.decode(i.tolist()) == t for t, i in zip(texts, ids)]
            n = [None if i is None else len(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])
        model.forget()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def digests(docs: DataFrame, data: bytes) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, round_trip) for every row: ids encoded and decoded again.

    ids_sha256: of the ids as little-endian 32-bit integers. round_trip: the decoded text equals
    the text. A null text has null in all three; an empty one has no ids and equals itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in short(batches):
            n, sha, same = [], [], []
            texts = [None if raw is None else raw.decode("utf-8", "replace") for raw in as_bytes(batch.column(1))]
            coded = iter(model.encode_many([t for t in texts if t is not None]))
            for text in texts:
                if text is None:
                    n.append(None), sha.append(None), same.append(None)
                    continue
                packed = next(coded)
                n.append(len(packed) // 4)
                sha.append(hashlib.sha256(packed).hexdigest())
                same.append(model.decode(np.frombuffer(packed, "<i4").tolist()) == text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "round_trip"])
        model.forget()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
