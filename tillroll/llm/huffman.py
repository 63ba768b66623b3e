"""Canonical length-limited Huffman codes over whole numbers, vectorised both ways.

Documents are byte-aligned bit streams, most significant bit first, cut into blocks of BLOCK ids. The bit offset of each
block is kept, so any block decodes alone; decoding steps through all blocks side by side, one table look-up for each.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits of vocabularies that it leaves room for; the decoder's table has 2**LIMIT entries at most then.
LIMIT = 18
BLOCK = 256


def limit_for(n_ids: int) -> int:
    """The longest code in bits: LIMIT, or more if so many ids need it."""
    return max(LIMIT, (n_ids - 1).bit_length() + 1)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code length of each id under the limit by package-merge; 0 for ids that don't occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = limit or limit_for(len(ids))
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        is_leaf.append(place < len(leaves))
    take = 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= 1
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for each value of the next bits, and how many bits: those of the longest code."""
    ids = np.flatnonzero(lengths)
    bits = int(lengths.max(initial=1))
    order = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.int64)
    n = int(spans.sum())
    symbol[:n] = np.repeat(order, spans)
    length[:n] = np.repeat(lengths[order], spans)
    return symbol, length, bits


def encode(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bit streams of documents that follow each other in ids, sizes[i] ids for the i-th.

    Returns the bytes of all streams, the byte at which each begins (and the end), the bit offset of each block within
    its document, and the number of blocks of each document.
    """
    width = lengths[ids].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(width)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n_bits = before[first[1:]] - before[first[:-1]]
    starts = np.concatenate([[0], np.cumsum((n_bits + 7) // 8)])
    blocks = (sizes + BLOCK - 1) // BLOCK
    at_block = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    offsets = (before[at_block] - np.repeat(before[first[:-1]], blocks)).astype(np.int64)
    if not len(ids):
        return b"", starts, offsets, blocks
    place = before[:-1] + np.repeat(8 * starts[:-1] - before[first[:-1]], sizes)
    word, room = place >> 6, 64 - (place & 63) - width
    value = codes[ids].astype(np.uint64)
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[new]] = np.bitwise_or.reduceat(high, new)
    spill = np.flatnonzero(room < 0)
    out[word[spill] + 1] |= value[spill] << (64 + room[spill]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(starts[-1])], starts, offsets, blocks


#: Blocks that are decoded side by side: many enough to spread a step's cost, few enough to stay in the cache.
SIDE_BY_SIDE = 4096


def decode(stream: bytes, bit: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of blocks that begin at these ascending bits of the stream and hold count (1 to BLOCK) ids each."""
    out = [np.zeros(0, np.int32)]
    for k in range(0, len(bit), SIDE_BY_SIDE):
        some = slice(k, k + SIDE_BY_SIDE)
        low = int(bit[k]) >> 3
        high = int(bit[k + SIDE_BY_SIDE]) // 8 + 1 if k + SIDE_BY_SIDE < len(bit) else len(stream)
        out.append(_decode(np.frombuffer(stream, np.uint8, min(high, len(stream)) - low, low), bit[some] - 8 * low, count[some], table))
    return np.concatenate(out)


def _decode(octets: np.ndarray, bit: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    symbol, length, bits = table
    wide = np.uint32 if bits <= 25 else np.uint64  # a window holds a code wherever in its first byte that begins
    size = np.dtype(wide).itemsize
    octets = np.concatenate([octets, np.zeros(8, np.uint8)]).astype(wide)
    window = np.zeros(len(octets) - size + 1, wide)
    for k in range(size):
        window |= octets[k : k + len(window)] << wide(8 * (size - 1 - k))
    room, mask = 8 * size - bits, (1 << bits) - 1
    longest_first = np.argsort(-count, kind="stable")
    at, left = bit[longest_first].astype(np.int64), count[longest_first]
    out = np.zeros((int(left.max(initial=0)), len(left)), np.int32)
    active = np.searchsorted(-left, -np.arange(len(out)), "left")  # blocks with more than so many ids
    for k, n in enumerate(active.tolist()):
        now = at[:n]
        peek = window[now >> 3] >> (room - (now & 7)).astype(wide) & wide(mask)
        out[k, :n] = symbol[peek]
        now += length[peek]
    back = np.empty_like(longest_first)
    back[longest_first] = np.arange(len(back))
    rows = out.T[back]
    return rows[np.arange(rows.shape[1]) < count[:, None]]
