"""Sets of hashed word shingles, the subset signatures by which two similar sets meet, and parity bitmaps.

Let a set have size a, another b, and s = a + b.  At 85 % they link when 100 |A n B| >= 85 |A u B|, that is
|A n B| >= ceil(85 s / 185), so they differ in at most d(s) = s - 2 ceil(85 s / 185) elements.  Cut the hash
range into g = d + 1 + x parts: at least 1 + x parts hold the same elements in both.  The elements of one part are a
*subset of fixed expected size* (about 5), and its hash is a signature.  As linked sets share 1 + x signatures, each may
disregard its x most frequent ones: of those shared, the rarest is among neither's.  So what many sets have in common (a
frequent line or passage) makes no candidates.  A part without elements counts as one disregarded; a set with
more than x such parts gives them signatures too, and disregards none.

Sizes are cut into classes so that linked sets lie in one class or in neighbours; a set of class k emits the
signatures of scheme k (partner not larger in class) and of scheme k + 1.  The last two bits of a signature tell the
scheme: 0 and 1 for even and odd k, 2 for an entry of the inverted lists.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from quadmill.llm import words as W

_TAG = np.uint64(0xA24BAED4963EE407)
_OTHER = np.uint64(0xC6BC279692B5C323)
_EMPTY = np.uint64(0x9FB21C651E98DF25)
_LIST = np.uint64(0xC2B2AE3D27D4EB4F)
_CODE = np.uint64(3)
#: The largest set for which size classes are prepared: 2^40 shingles.
LARGEST = 1 << 40


@lru_cache(maxsize=16)
def class_bounds(percent: int, largest: int = LARGEST) -> np.ndarray:
    """The first size of each class: a set of one class can only link with its own and the next classes."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-100 * bounds[-1] // percent)))
    return np.array(bounds, np.int64)


def most_different(s: int, percent: int) -> int:
    """The most elements in which two linked sets of total size at most s can differ."""
    return max(t - 2 * -(-percent * t // (100 + percent)) for t in range(max(s - 4, 0), s + 1))


@lru_cache(maxsize=16)
def schemes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, spare) of every scheme; no parts where sets up to that class only link when equal."""
    bounds = class_bounds(percent)
    parts, spare = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    for k in range(len(parts)):
        d = most_different(2 * int(bounds[k + 1] - 1), percent)
        if d > 0:
            spare[k] = 1 + d // 4
            parts[k] = d + 1 + spare[k]
    return parts, spare


def classes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(class_bounds(percent), n, "right") - 1


def doc_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending: all of them, and n+1 offsets."""
    w = W.cut(column, lower=True)
    h = w.hashes()
    grams = W.ngrams(h, shingle)
    out, sizes = [], np.zeros(len(w.first) - 1, np.int64)
    for d in range(len(sizes)):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= shingle:
            x = np.sort(grams[a : b - shingle + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:  # fewer words: the whole sequence is the one element, apart from every longer one
            x = W.mix64(W.ngrams(h[a:b], int(b - a))[:1] + np.uint64(b - a))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def set_ids(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit identities of each set (0 for the empty set)."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = []
    for tag in (_TAG, _OTHER):
        ids = np.zeros(len(sizes), np.uint64)
        if len(full):
            ids[full] = W.mix64(np.add.reduceat(W.mix64(sets ^ tag), offsets[:-1][full]) + sizes[full].astype(np.uint64))
        out.append(ids)
    return out[0], out[1]


def _parts(sets: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets one after another, with so many parts each: the part of each element, where a part begins, and each set's parts that hold elements."""
    part = ((sets >> np.uint64(32)) * np.repeat(parts, sizes).astype(np.uint64)) >> np.uint64(32)
    new = np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1]))
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    edges = np.flatnonzero(new)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return part, edges, np.bincount(owner[edges], minlength=len(sizes))


def disregarded(sets: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """(sets, 2): how many signatures each set disregards of its scheme of even k, and of odd k."""
    sizes = np.diff(offsets)
    parts, spare = schemes(percent)
    kind = classes(sizes, percent)
    out = np.zeros((len(sizes), 2), np.int32)
    for k in (kind, kind + 1):
        full = _parts(sets, sizes, np.where(sizes > 0, parts[k], 0))[2]
        empty = parts[k] - full
        out[np.arange(len(sizes)), k % 2] = np.where(empty <= spare[k], spare[k] - empty, 0)
    return out


def subset_signatures(sets: np.ndarray, offsets: np.ndarray, k: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of scheme k[i] of each set i, and whose they are."""
    parts, spare = schemes(percent)
    sizes = np.diff(offsets)
    use = (sizes > 0) & (parts[k] > 0)
    if not use.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sets, who = sets[np.repeat(use, sizes)], np.flatnonzero(use)
    sizes, k = sizes[use], k[use]
    part, edges, full = _parts(sets, sizes, parts[k])
    owner = np.repeat(np.arange(len(sizes)), full)
    tag = W.mix64((k + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    found = W.mix64(np.add.reduceat(W.mix64(sets), edges) + part[edges] * _TAG + tag[owner])
    code = (k % 2).astype(np.uint64)
    keys, owners = [(found & ~_CODE) | code[owner]], [who[owner]]
    begins = np.cumsum(full) - full
    for i in np.flatnonzero(parts[k] - full > spare[k]).tolist():
        empty = np.setdiff1d(np.arange(parts[k[i]], dtype=np.uint64), part[edges[begins[i] : begins[i] + full[i]]], assume_unique=True)
        keys.append((W.mix64(empty * _EMPTY + tag[i]) & ~_CODE) | code[i])
        owners.append(np.full(len(empty), who[i]))
    return np.concatenate(keys), np.concatenate(owners)


def list_entries(x: np.ndarray, percent: int, spare: int) -> np.ndarray:
    """The entries of one set in the inverted lists: its least elements, of which linked sets share 1 + spare."""
    return (W.mix64(x[: len(x) - -(-percent * len(x) // 100) + 1 + spare] ^ _LIST) & ~_CODE) | np.uint64(2)


def bitmap(x: np.ndarray) -> bytes:
    """The parity of the elements that fall on each of 2^i bits (2 to 4 for each element): where two bitmaps differ in
    c bits, the sets differ in c elements at least."""
    bits = max(int(2 * len(x) - 1).bit_length(), 6)
    found = np.bincount((x & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(found.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """(rows, words) of bitmaps made as narrow as ``width`` words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits
