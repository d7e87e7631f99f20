"""Simple-8b token files: 64-bit words, each a selector and as many equal-width ids as fit.

The top four bits of a word select how many ids its low 60 bits hold and how wide they are. Selector 15 is the
escape: the word holds nothing itself and the next word is one raw 64-bit id. Ids are coded in blocks of
BLOCK; each block starts at a word of its own, listed in the file's block offsets, so blocks decode
independently of each other and all of them at once.

A file image, little-endian: magic, block size, counts of documents, ids, blocks and words (unsigned 64-bit);
per document its id (signed 64-bit), a byte that is 1 where the id is null, its number of ids (unsigned 64-bit);
per block the offset of its first word (unsigned 64-bit); the words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LFS8B001"
BLOCK = 1024
#: Ids in a word and their width in bits, by selector; the ids of the last word of a block may be fewer.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE = 15
HEAD = struct.Struct("<8sQQQQQ")


_SHORT = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def bit_widths(ids: np.ndarray) -> np.ndarray:
    if not ids.size or ids.max() < 1 << 16:
        return _SHORT[ids.astype(np.uint16)]
    return sum((_SHORT[(ids >> np.uint64(16 * k)).astype(np.uint16)] + np.uint8(16 * k)) * (ids >> np.uint64(16 * k) > 0) * (ids >> np.uint64(16 * k) < 1 << 16) for k in range(4)).astype(np.uint8)


def _choices(width: np.ndarray) -> np.ndarray:
    """The densest selector that fits from each place on; width: blocks x (BLOCK + 60), zero past a block's end."""
    n = width.shape[1] - 60
    best = np.full((width.shape[0], n), ESCAPE, np.uint8)
    top, have = width, 1
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        while have < count:
            step = min(have, count - have)
            top = np.maximum(top[:, : top.shape[1] - step], top[:, step:])
            have += step
        np.copyto(best, np.uint8(selector), where=top[:, :n] <= WIDTHS[selector])
    return best


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (uint64) -> words (uint64), offset of each block's first word and the end."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    if blocks:
        size[-1] = len(ids) - (blocks - 1) * BLOCK
    best = _choices(bit_widths(padded))
    counts = np.array([*COUNTS, 0, 1], np.int64)
    # The places where words begin: all blocks step together, a word at a time.
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    starts_row, starts_at, picks = [], [], []
    while len(row):
        pick = best[row, at[row]]
        starts_row.append(row)
        starts_at.append(at[row])
        picks.append(pick)
        at[row] += counts[pick]
        row = row[at[row] < size[row]]
    if not picks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    row, place, pick = map(np.concatenate, (starts_row, starts_at, picks))
    order = np.argsort(row * BLOCK + place, kind="stable")
    row, place, pick = row[order], place[order], pick[order]
    wide = np.where(pick == ESCAPE, 2, 1)
    first = np.cumsum(wide) - wide
    words = np.zeros(int(wide.sum()), np.uint64)
    words[first] = pick.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(pick == selector)
        if len(mine):
            values = padded[row[mine, None], place[mine, None] + np.arange(count)]
            shifts = (np.arange(count) * bits).astype(np.uint64)
            words[first[mine]] |= np.bitwise_or.reduce(values << shifts, axis=1)
    raw = np.flatnonzero(pick == ESCAPE)
    words[first[raw] + 1] = padded[row[raw], place[raw]]
    offsets = np.zeros(blocks + 1, np.uint64)
    np.cumsum(np.bincount(row, weights=wide, minlength=blocks).astype(np.uint64), out=offsets[1:])
    return words, offsets


def _skip_raw(words: np.ndarray) -> np.ndarray:
    """Which words carry a selector; a word after an escape is raw."""
    escape = (words >> np.uint64(60)) == ESCAPE
    if not escape.any():
        return np.ones(len(words), bool)
    # Within a run of words that look like escapes, every other one is real.
    place = np.arange(len(words))
    run_start = np.maximum.accumulate(np.where(escape & ~np.r_[False, escape[:-1]], place, -1))
    real = escape & ((place - run_start) % 2 == 0)
    return ~np.r_[False, real[:-1]]


def decode_words(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of the blocks whose words these are."""
    carries = np.ones(len(words), bool)
    if ((words >> np.uint64(60)) == ESCAPE).any():
        for a, b in zip(offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), strict=True):
            carries[a:b] = _skip_raw(words[a:b])
    head = np.flatnonzero(carries)
    pick = (words[head] >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 0, 1], np.int64)[pick]
    block = np.searchsorted(offsets[1:].astype(np.int64), head, side="right")
    before = np.cumsum(counts) - counts
    first_of_block = np.searchsorted(block, np.arange(len(offsets) - 1))
    place = before - before[first_of_block][block] + block * BLOCK
    out = np.zeros((len(offsets) - 1) * BLOCK + 60, np.uint64)
    for selector, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(pick == selector)
        if len(mine):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            values = (words[head[mine], None] >> shifts) & np.uint64((1 << bits) - 1)
            at = place[mine, None] + np.arange(count)
            inside = at < (block[mine, None] + 1) * BLOCK
            out[at[inside]] = values[inside]
    raw = np.flatnonzero(pick == ESCAPE)
    out[place[raw]] = words[head[raw] + 1]
    return out[:n_ids]


def write_image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode_blocks(ids.astype(np.uint64))
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    head = HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(offsets) - 1, len(words))
    return b"".join((head, names.astype("<i8").tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """-> ids of documents, how many token ids each has, all token ids."""
    magic, block, n_docs, n_ids, n_blocks, n_words = HEAD.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token file of this format")
    at = HEAD.size
    parts = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(image, kind, n, at))
        at += parts[-1].nbytes
    names, null, lengths, offsets, words = parts
    docs = [None if x else int(d) for d, x in zip(names, null, strict=True)]
    return docs, lengths.astype(np.int64), decode_words(words, offsets, n_ids)
