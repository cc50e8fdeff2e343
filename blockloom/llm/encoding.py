"""Token ids of texts by a ``tokenizer.json``, a few megabytes of text at a time.

A byte-level tokenizer never joins a space to what stands before it, unless that is white space too. So a text can be
cut before each space that follows another character, and equal pieces have equal ids. Arrow numbers the distinct
pieces of a slice, only pieces that are new to the worker go to the tokenizer, and the ids of all pieces are gathered
from one array. Texts that hold the string of an added token go to the tokenizer whole, as do all texts of tokenizers
of another kind, so the ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.

Memory: a slice holds at most ``ENCODED_BYTES`` of text, or one piece that is longer; long texts are cut between pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

SLICE_BYTES = 1 << 22
#: Text that is encoded at once: its cuts, numbers and ids take some twenty times its bytes.
ENCODED_BYTES = 1 << 20
#: A worker's memory of encoded pieces; it is emptied when full and changes no result.
KNOWN_PIECES = 600_000
#: Bytes that end a white space character of more than one byte, or come next to last in it.
MAY_BE_SPACE = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A, 0xA0])
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
SIGN = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
BREAK = SIGN | np.isin(np.arange(256), [10, 32])
#: Latin letters, with or without a space before them: one part for the tokenizer's model.
WORD = re.compile("\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

# The characters that stand for the bytes of a byte-level tokenizer's texts.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN_BYTES = {b: b for b in SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}
SHOWN_SPACE = chr(SHOWN_BYTES[32])

_encoders: dict[str, Encoder] = {}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each text in them, without a copy."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a new piece may begin, whatever stands around it.

    That is at a space or line feed behind a character that surely is no white space, at a sign behind a Latin letter,
    and behind a line feed that is alone.
    """
    at = np.flatnonzero(BREAK[data])
    at = at[at >= 2]
    this, one, two = data[at], data[at - 1], data[at - 2]
    solid = (one > 32) & ~((one >= 128) & MAY_BE_SPACE[two])
    letter = LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
    new = np.where(SIGN[this], letter, solid)
    feeds = at[(this == 10) & solid] + 1
    feeds = feeds[feeds < data.size]
    behind = data[feeds]
    mark = np.zeros(data.size, bool)
    mark[at[new]] = True
    mark[feeds[(behind > 32) & (behind < 128)]] = True
    return np.flatnonzero(mark)


def segments(data: np.ndarray, offsets: np.ndarray, size: int = ENCODED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The borders of segments of at most about ``size`` bytes, and the text that each belongs to; no empty ones."""
    if data.size == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    borders, owners = [], []
    lengths = np.diff(offsets)
    done = 0
    for i in np.flatnonzero(lengths > size):
        held = done + np.flatnonzero(lengths[done:i])
        borders.append(offsets[held])
        owners.append(held)
        at, end = int(offsets[i]), int(offsets[i + 1])
        starts = [at]
        while end - at > size:
            found, reach = np.zeros(0, np.int64), size
            while not found.size and at + reach < end + size:
                found, reach = cuts(data[at:min(at + reach, end)]), reach * 2
            if not found.size:
                break
            at += int(found[-1])
            starts.append(at)
        borders.append(np.array(starts))
        owners.append(np.full(len(starts), i))
        done = i + 1
    held = done + np.flatnonzero(lengths[done:])
    borders += [offsets[held], offsets[-1:]]
    owners.append(held)
    return np.concatenate(borders), np.concatenate(owners)


def slices(borders: np.ndarray, size: int = ENCODED_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of segments of about ``size`` bytes, as first segment and end."""
    cut = np.flatnonzero(np.diff(borders[:-1] // size)) + 1
    ends = [*cut.tolist(), borders.size - 1]
    yield from zip([0, *ends[:-1]], ends)


class Encoder:
    """Encodes texts, remembering the ids of pieces between spaces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their numbers."""
        found = self._ids([p.decode() for p in pieces])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.number), int(lengths.sum())
        while self.used + total > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(found) > self.first.size:
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.ids[self.used:self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        self.first[n:n + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + len(found)] = lengths
        self.used += total
        self.number.update(zip(pieces, range(n, n + len(found))))
        return np.arange(n, n + len(found))

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        tokenize, found = self.model.tokenize, []
        for p in pieces:
            if p.isascii():
                shown = p.replace(" ", SHOWN_SPACE) if p[p[0] == " ":].isalpha() else None
            else:
                shown = p.encode().decode("latin-1").translate(SHOWN_BYTES) if WORD.fullmatch(p) else None
            found.append(shown and [t.id for t in tokenize(shown)])
        others = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _slice(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice, and how many each segment has."""
        mark = np.zeros(data.size + 1, bool)
        mark[cuts(data)] = True
        mark[borders] = True
        starts = np.flatnonzero(mark)
        pieces = pa.Array.from_buffers(pa.binary(), starts.size - 1, [
            None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) + len(names) > KNOWN_PIECES:
            self._forget()
        numbers = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        if new.size:
            numbers[new] = self._learn([names[i] for i in new])
        numbers = numbers[coded.indices.to_numpy()]
        lengths = self.length[numbers]
        upto = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.first[numbers] - upto + lengths, lengths) + np.arange(upto[-1])]
        return ids, np.add.reduceat(lengths, np.searchsorted(starts, borders[:-1]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        if not self.cuts:
            return self._whole(texts)
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if special.any():  # runs of texts of one kind
            edges = [0, *(np.flatnonzero(np.diff(special)) + 1).tolist(), len(texts)]
            parts = [(self._whole if special[a] else self._cut)(texts[a:b]) for a, b in zip(edges, edges[1:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._cut(texts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = buffers(texts)
        borders, owners = segments(data, offsets)
        counts = np.zeros(len(texts), np.int64)
        parts = [np.zeros(0, np.uint32)]
        for a, b in slices(borders) if owners.size else ():
            ids, lengths = self._slice(data[borders[a]:borders[b]], borders[a:b + 1] - borders[a])
            parts.append(ids)
            np.add.at(counts, owners[a:b], lengths)
        return np.concatenate(parts), counts


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive runs of whole texts, each of about ``size`` bytes or one longer text."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size) | (lengths[:-1] > size)) + 1
    for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
        if stop > start:
            yield texts[start:stop]


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id behind those of each text, as little-endian 32-bit integers, and the borders of texts."""
    upto = np.concatenate([[0], np.cumsum(counts + 1)])
    stream = np.empty(int(upto[-1]), "<u4")
    ends = np.zeros(stream.size, bool)
    ends[upto[1:] - 1] = True
    stream[ends] = end_id
    stream[~ends] = ids
    return stream, upto
