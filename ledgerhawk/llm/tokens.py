"""Piece-wise encoding with the public tokenizers, shared by operators 2, 7 and 10.

Both tokenizers never build a token across a blank that begins a new word, so
a text is cut there and each distinct piece is encoded once and looked up
afterwards.  All of it works on whole Arrow batches: piece borders, 64-bit
piece hashes and the gathering of ids are array operations.  Memory is bounded
by ``Pieces.limit``; a forgotten piece is encoded again, so ids never depend
on what is remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once.
SLICE = 3_000_000
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, 1 << 14, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:start + length]``; spans are
    ascending, disjoint and not empty."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(len(starts), np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)
    if total == len(data):
        got = _BYTE[data]
    else:
        got = _BYTE[data[place + np.repeat(starts, lengths)]]
    got = got * _PLACE[place & (len(_PLACE) - 1)]
    far = place >= len(_PLACE)
    if far.any():
        got[far] = mix(got[far] + (place[far] >> 14).astype(np.uint64))
    return mix(np.add.reduceat(got, begin) + lengths.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each row (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` text bytes (a longer row stands alone)."""
    _, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def byte_cuts(data: np.ndarray) -> np.ndarray:
    """Byte-level BPE: a blank before a visible character begins a piece.
    Bytes that may begin a blank of several bytes are not cut before."""
    nxt = data[1:]
    visible = (nxt > 32) & (nxt != 0xC2) & (nxt != 0xE1) & (nxt != 0xE2) & (nxt != 0xE3)
    return np.flatnonzero((data[:-1] == 32) & visible)


def marker_cuts(data: np.ndarray) -> np.ndarray:
    """Word markers: a run of blanks begins a piece (not after a byte that may
    end a literal marker)."""
    return np.flatnonzero((data[1:] == 32) & (data[:-1] != 32) & (data[:-1] != 0x81)) + 1


class Pieces:
    """Ids of distinct pieces.  ``encode`` takes pieces (bytes) and returns
    (flat ids, ids per part of them, the part of each piece)."""

    def __init__(self, cuts: Callable, encode: Callable, limit: int = 1_500_000):
        self.cuts, self.encode, self.limit = cuts, encode, limit
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray, place: np.ndarray) -> None:
        """Remember new pieces; ``keys`` ascending and unknown so far."""
        at = (len(self.ids) + np.cumsum(count) - count)[place]
        count = count[place]
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.count = np.insert(self.count, where, count)
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each piece, and pieces per row."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        begins = np.zeros(len(data), bool)
        begins[self.cuts(data)] = True
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        per_row = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
        return starts, per_row

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and ids per row."""
        starts, per_row = self.split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(per_row), np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        hashes, first, inverse = np.unique(span_hash(data, starts, lengths), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, hashes)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == hashes[known]
        if not known.all():
            if len(self.keys) > self.limit:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            raw, where = data.tobytes(), first[new]
            todo = [raw[s:s + n] for s, n in zip(starts[where].tolist(), lengths[where].tolist())]
            self.add(hashes[new], *self.encode(todo))
            slot = np.searchsorted(self.keys, hashes)
        count = self.count[slot][inverse]
        total = int(count.sum())
        shift = self.at[slot][inverse] - (np.cumsum(count) - count)
        ids = self.ids[np.repeat(shift, count) + np.arange(total, dtype=np.int64)]
        ends = np.append(0, np.cumsum(count))
        border = np.append(0, np.cumsum(per_row))
        return ids, ends[border[1:]] - ends[border[:-1]]


def byte_bpe(path: str, limit: int = 1_500_000) -> Pieces:
    """Pieces of a byte-level BPE file of the tokenizers library.  As in the
    library, a special token's string in a text gives that token; a run of
    blanks before it is one piece with it, since the text ends there for the
    words before."""
    import json
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, special = file["model"]["vocab"], file["added_tokens"]
    for t in special:
        if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
            raise ValueError(f"special token {t['content']!r} reaches over blanks")
    special = [t["content"].encode() for t in special]

    def cuts(data: np.ndarray) -> np.ndarray:
        at = byte_cuts(data)
        for s in special:
            head = s[:2]  # more texts are kept whole than need be, never fewer
            if len(head) == 2 and len(at):
                second = data[np.minimum(at + 2, len(data) - 1)]
                at = at[(data[at + 1] != head[0]) | (second != head[1])]
            elif len(at):
                at = at[data[at + 1] != head[0]]
        return at

    width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: one per letter of its spelling
    for token, i in vocab.items():
        width[i] = len(token)

    def spell(pieces: list[bytes]):
        """Pieces that all begin with a blank may follow one another in one text."""
        ids = np.array(tok.encode(b"".join(pieces).decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(p) for p in pieces])) + 1
        return ids, np.diff(ends, prepend=0)

    def encode(pieces: list[bytes]):
        plain = [p[:1] == b" " and not any(s in p for s in special) for p in pieces]
        alone = [i for i, p in enumerate(plain) if not p]
        joined = [i for i, p in enumerate(plain) if p]
        made = [tok.encode(pieces[i].decode(), add_special_tokens=False).ids for i in alone]
        made = [(np.array(ids, np.uint32), [len(ids)]) for ids in made]
        made += [spell([pieces[i] for i in joined[at:at + 1024]]) for at in range(0, len(joined), 1024)]
        count = np.concatenate([n for _, n in made])
        place = np.empty(len(pieces), np.int64)
        place[alone + joined] = np.arange(len(pieces))
        return np.concatenate([ids for ids, _ in made]), count, place

    return Pieces(cuts, encode, limit)


def marked_words(path: str, limit: int = 1_500_000) -> Pieces:
    """Pieces of a sentencepiece model whose tokens never cross a word marker;
    rows are given with one blank before (the marker put before a text)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if mark in p.lstrip(mark)]
    if crossing:
        raise ValueError(f"tokens cross a word marker: {crossing[:3]}")
    lone = [sp.piece_to_id(mark)]

    def encode(pieces: list[bytes]):
        texts = [p[1:].decode() for p in pieces]
        got = [i if t else lone for t, i in zip(texts, sp.encode(texts, num_threads=1))]
        flat = np.fromiter((i for x in got for i in x), np.uint32)
        return flat, np.array([len(x) for x in got], np.int64), np.arange(len(got))

    return Pieces(marker_cuts, encode, limit)


_KEPT: dict[tuple, Pieces] = {}


def kept(kind: Callable, path: str, **options) -> Pieces:
    """One table for all tasks of a Python worker."""
    key = (kind.__name__, path, *sorted(options.items()))
    if key not in _KEPT:
        _KEPT[key] = kind(path, **options)
    return _KEPT[key]
