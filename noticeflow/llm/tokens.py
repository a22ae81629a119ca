"""Token ids by the ``tokenizers`` library: texts are cut where pre-tokens part, and each distinct piece is encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together, and bytes that remembered pieces may take in a worker.
TOGETHER, MEMORY = 2_000_000, 64_000_000
#: Words of 64 bits that hold a remembered piece, padded with zeros; longer ones are encoded each time they come.
_WORDS = 3


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE, _PUNCT = _table(b" \t\n\v\f\r"), _table(b".,!?;:")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_LATIN = _table(bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)))  # after C3: the letters from À to ÿ
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: UTF-8 of white space beyond ASCII, two and three bytes as one number.
_WIDE_SPACES = (0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)


#: Where long texts may be cut.
_CUT = re.compile(rb"[A-Za-z](?= )")


def _wide_space_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII ends before each place."""
    a, b, c = (np.where(at >= i, data[at - i], 0).astype(np.int32) for i in (3, 2, 1))
    return np.isin(b << 8 | c, _WIDE_SPACES) | np.isin(a << 16 | b << 8 | c, _WIDE_SPACES)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[i], begins[i] + 1, ... (sizes[i] of them) for each i in turn."""
    through = np.cumsum(sizes)
    return np.repeat(begins - (through - sizes), sizes) + np.arange(through[-1] if len(through) else 0)


class _Memory:
    """Pieces and their ids in arrays, sorted by a hash of the piece; pieces are compared whole."""

    def __init__(self, dtype: np.dtype):
        self.hashes, self.keys = np.zeros(0, np.uint64), np.zeros((0, _WORDS), np.uint64)
        self.begins, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.keys, self.begins, self.sizes, self.ids))

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of pieces, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.keys[at] == keys).all(axis=1), at, -1)

    def add(self, hashes: np.ndarray, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        hashes, keys, sizes = np.concatenate([self.hashes, hashes]), np.concatenate([self.keys, keys]), np.concatenate([self.sizes, sizes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.keys, self.begins, self.sizes, self.ids = hashes[order], keys[order], begins[order], sizes[order], np.concatenate([self.ids, ids])


class Encoder:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    Fits tokenizers whose pre-tokens cross neither from a non-space to a space nor from a letter to one of . , ! ? ; :
    (texts are cut there), and whose added tokens are matched as they stand (texts are cut around them).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens with stripping, word bounds or normalisation are not supported")
        self.added = {x.encode(): i for x, i in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_at = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        self.tokenizer.encode_special_tokens = True  # pieces hold no added token: what looks like one after lower-casing is text
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65_536 else "<u4")
        plain = [self._ids([x])[0].tolist() for x in ("the", " The", "\nthe")]
        self.folds = plain[0] == plain[1] == plain[2]  # case and white space make no difference
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or that begin with white space
        if self.folds:
            self.marks[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        else:
            spaces = {self.tokenizer.id_to_token(int(self._ids([c])[0][0]))[0] for c in " \t\n\v\f\r"}
            self.marks[[i for x, i in vocabulary.items() if x[0] in spaces]] = True
        self.forget()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null is empty."""
        return next(self.encode_column(pa.array([text], pa.string())))

    def forget(self) -> None:
        """Give back the memory of pieces."""
        self.known = [_Memory(self.dtype), _Memory(self.dtype)]  # those of long standing, and recent ones

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column in turn; null is empty. About ``TOGETHER`` bytes are worked on at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
        data = memoryview(texts.buffers()[2] or b"")
        held, size = [], 0
        for part in self._parts(data, offsets, special):
            held.append(part)
            size += part[2] - part[1]
            if size >= TOGETHER and part[3]:
                yield from self._joined(held, data)
                held, size = [], 0
            elif size >= TOGETHER:  # a long text goes on: its ids so far replace its parts
                *whole, rest = self._joined([*held[:-1], (*part[:3], True, part[4])], data)
                yield from whole
                held, size = [(part[0], 0, 0, False, rest)], 0
        yield from self._joined(held, data)

    def _parts(self, data: memoryview, offsets: list[int], special: bool) -> Iterator[tuple]:
        """(text, start, end, is its last, ids of an added token or none) in order."""
        for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
            for hit in self.added_at.finditer(data, a, b) if special else ():
                yield from self._cut(data, k, a, hit.start(), False)
                yield k, 0, 0, False, np.array([self.added[hit.group()]], self.dtype)
                a = hit.end()
            yield from self._cut(data, k, a, b, True)

    def _cut(self, data: memoryview, k: int, a: int, b: int, last: bool) -> Iterator[tuple]:
        """A span in parts of at most about ``TOGETHER`` bytes, cut before a space that follows an ASCII letter."""
        while b - a > TOGETHER:
            hit = _CUT.search(data, a + TOGETHER // 2, b)
            if hit is None or hit.end() >= b:
                break
            yield k, a, hit.end(), False, None
            a = hit.end()
        yield k, a, b, last, None

    def _joined(self, parts: list[tuple], data: memoryview) -> Iterator[np.ndarray]:
        ids, sizes = self._encode_parts(np.frombuffer(b"".join(data[a:b] for _, a, b, _, _ in parts), np.uint8), np.array([b - a for _, a, b, _, _ in parts]))
        at, now = 0, []
        for (_, _, _, last, given), n in zip(parts, sizes.tolist()):
            now.append(ids[at : at + n] if given is None else given)
            at += n
            if last:
                yield now[0] if len(now) == 1 else np.concatenate(now)
                now = []

    def _encode_parts(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that lie one after another in ``data``, and how many each has."""
        ends = np.cumsum(lengths)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(lengths), np.int64)
        first = np.zeros(len(data) + 1, bool)
        first[ends - lengths] = True
        first = first[:-1]
        space = _SPACE[data]
        after_space = np.concatenate([[True], space[:-1]])
        stops = np.flatnonzero(_PUNCT[data] & ~first)
        before = data[stops - 1]
        stops = stops[_LETTER[before] | (_LATIN[before] & (data[np.maximum(stops - 2, 0)] == 0xC3))]
        if self.folds:
            starts = ~space & (first | after_space)
            starts[stops] = True
            starts, place = np.flatnonzero(starts), np.cumsum(~space, dtype=np.int32)
            owned, starts, data = np.searchsorted(starts, ends), place[starts] - 1, data[~space]
            if not ((data == 0xCC) | (data == 0xCD)).any():  # no combining marks that could join with a lower-case letter only
                data = _LOWER[data]
        else:
            starts = space & ~after_space
            wide = np.flatnonzero(starts[1:] & (data[:-1] >= 0x80)) + 1
            starts[wide[_wide_space_ends(data, wide)]] = False
            starts |= first
            starts[stops] = True
            starts = np.flatnonzero(starts)
            owned = np.searchsorted(starts, ends)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes = pieces.indices.to_numpy()
        sizes, flat = self._lookup(pieces.dictionary)
        counts, begins = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        through = np.concatenate([[0], np.cumsum(counts)])[owned]
        return flat[_spread(begins, counts)], np.diff(through, prepend=0)

    def _lookup(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct pieces, and the ids one after another; new pieces are encoded and remembered."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        data, lengths = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.diff(bounds)
        short = lengths <= 8 * _WORDS
        keys = np.zeros((len(pieces), 8 * _WORDS), np.uint8)
        rows, some = np.flatnonzero(short), lengths[short]
        keys[np.repeat(rows, some), _spread(np.zeros(len(rows), np.int64), some)] = data[_spread(bounds[:-1][short], some)]
        keys = keys.view(np.uint64)
        hashes = lengths.astype(np.uint64)
        for k in range(_WORDS):
            hashes = (hashes ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        sizes, begins, source = np.full(len(pieces), -1), np.zeros(len(pieces), np.int64), np.zeros(0, self.dtype)
        for known in self.known:
            at = known.find(hashes, keys)
            hit = np.flatnonzero((at >= 0) & short & (sizes < 0))
            own = known.sizes[at[hit]]
            sizes[hit], begins[hit] = own, len(source) + np.cumsum(own) - own
            source = np.concatenate([source, known.ids[_spread(known.begins[at[hit]], own)]])
        new = np.flatnonzero(sizes < 0)
        if len(new):
            own, ids = self._encode_new(pieces.take(pa.array(new)), data, bounds[new], bounds[new + 1])
            sizes[new], begins[new] = own, len(source) + np.cumsum(own) - own
            source = np.concatenate([source, ids])
            keep = np.flatnonzero(short[new] & (data[bounds[new]] != 0))  # zeros pad
            self._remember(hashes[new[keep]], keys[new[keep]], own[keep], ids[_spread((np.cumsum(own) - own)[keep], own[keep])])
        return sizes, source[_spread(begins, sizes)]

    def _remember(self, *new: np.ndarray) -> None:
        old, recent = self.known
        recent.add(*new)
        if len(recent.hashes) > max(50_000, len(old.hashes) // 4):
            if old.nbytes() + recent.nbytes() > MEMORY:
                self.known = [recent, _Memory(self.dtype)]  # what did not come for long is forgotten
            else:
                order = np.argsort(recent.begins, kind="stable")
                old.add(recent.hashes[order], recent.keys[order], recent.sizes[order], recent.ids)
                self.known[1] = _Memory(self.dtype)

    def _encode_new(self, pieces: pa.BinaryArray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of pieces ``data[a:b]``. Pieces whose ids show their bounds are encoded in one text."""
        if self.folds:  # words of letters only
            wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
            plain = np.concatenate([[0], np.cumsum(_LETTER[data])])
            wide, plain = wide[b] - wide[a], plain[b] - plain[a]
            alike = plain == b - a
            strings = pieces.cast(pa.string()).to_pylist()
            for i in np.flatnonzero(~alike & (wide + plain == b - a)).tolist():
                alike[i] = strings[i].isalpha()
            separator = " "
        else:  # one white-space character first, and none at the end
            alike = (b - a > 1) & _SPACE[data[a]] & ~_SPACE[data[np.minimum(a + 1, len(data) - 1)]]
            alike[alike] = (data[b[alike] - 1] < 0x80) | ~_wide_space_ends(data, b[alike])
            strings, separator = pieces.cast(pa.string()).to_pylist(), ""
        sizes, parts = np.zeros(len(a), np.int64), []
        for k in range(0, len(a), 4096):
            part = k + np.flatnonzero(alike[k : k + 4096])
            ids = self._ids([separator.join([strings[i] for i in part.tolist()])])[0] if len(part) else np.zeros(0, self.dtype)
            marks = np.flatnonzero(self.marks[ids])
            if len(marks) == len(part):
                sizes[part] = np.diff(marks, prepend=-1) if self.folds else np.diff(marks, append=len(ids))
                parts.append((part, ids))
            else:
                alike[part] = False
        rest = np.flatnonzero(~alike)
        each = self._ids([strings[i] for i in rest.tolist()])
        sizes[rest] = [len(x) for x in each]
        parts.append((rest, np.concatenate([np.zeros(0, self.dtype), *each])))
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(sizes.sum(), self.dtype)
        for part, ids in parts:
            out[_spread(begins[part], sizes[part])] = ids
        return sizes, out

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Encoder(path)
    return _loaded[path]
