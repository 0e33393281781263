"""Hashes of words and of five-word shingles, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], _U)
_PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _BLANK[buf]
    edge = np.flatnonzero(blank[1:] < blank[:-1]) + 1
    starts = edge if blank[0] else np.concatenate(([0], edge))
    if not len(starts):
        return np.empty(0, _U), starts
    gaps = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, gaps)
    power = np.multiply.accumulate(np.full(int(gaps.max()), 0x5851F42D4C957F2D, _U))
    value = (buf[starts[0] :].astype(_U) + _U(1)) * power[place]
    value[blank[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all): words are runs without white space.

    The texts are hashed in pieces of some MB that end between words, so a long text takes no more memory.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, places, at = [], [], 0
    while at < len(buf):
        end = min(at + _PIECE, len(buf))
        while end < len(buf) and not _BLANK[buf[end - 1]]:
            more = np.flatnonzero(_BLANK[buf[end : end + _PIECE]])
            end = end + int(more[0]) + 1 if len(more) else min(end + _PIECE, len(buf))
        h, s = _piece(buf[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    places = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(places, begin)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their counts, shingles before each text and in all), sorted within each text.

    A text of fewer words than a shingle has is one shingle; a text without words has none.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    long = max(len(h) - WORDS + 1, 0)
    s = np.zeros(long, _U)
    for k in range(WORDS):
        s += h[k : k + long] * _STEP[k]
    whole = doc[:long] == doc[WORDS - 1 :] if long else np.zeros(0, bool)
    ids, owner = mix(s[whole]), doc[:long][whole]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        own = [mix(np.array([(h[at[d] : at[d + 1]] * _STEP[: n[d]]).sum() + _U(n[d])], _U))[0] for d in few]
        ids, owner = np.concatenate((ids, np.array(own, _U))), np.concatenate((owner, few))
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(ids)))
    return ids[first], counts, np.searchsorted(owner[first], np.arange(len(texts) + 1))


def jaccard(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of left[i] and right[i]; 1 for two texts without words."""
    n = len(left)
    ids, _, at = shingles([*left, *right])
    sizes = np.diff(at)
    pair = np.repeat(np.concatenate((np.arange(n), np.arange(n))), sizes)
    order = np.lexsort((ids, pair))
    ids, pair = ids[order], pair[order]
    # a text's shingles are distinct, so two equal neighbours are one of each side
    both = np.bincount(pair[1:][(ids[1:] == ids[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
    union = sizes[:n] + sizes[n:] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)
