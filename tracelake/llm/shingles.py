"""Word shingles as sets of 64-bit hashes, and fast similarity sketches of such sets.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case. A text of fewer words than a shingle has is one
shingle of all its words; one without words has the empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hash one worker remembers.
CACHE_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    return hashes_of(text.encode().lower().split())  # of bytes: A-Z alone change, the six ASCII blanks alone separate


def shingle_set(text: str, width: int) -> np.ndarray:
    """The text's distinct shingle hashes, ascending."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out ^ words[k : len(words) - width + 1 + k])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def fast_sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): `size` coordinates of 64 bits.

    In round i < size every element goes to a random coordinate with value i + u, u random in [0, 1); in round
    i >= size to coordinate i - size. A coordinate keeps its least value. Every coordinate is filled after 2 * size
    rounds at most, after about size * ln(size) / elements as a rule, when rounds end. Two sets agree in a coordinate
    with the probability of their Jaccard similarity, and the share of agreeing coordinates is as concentrated as
    for independent ones.
    """
    if not 0 < size <= 500:
        raise ValueError("a sketch has from 1 to 500 coordinates")
    least = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(hashes):
        return least
    n, first = len(hashes), 0
    missing = size
    while missing:
        # so many rounds at once that most of what is missing should be filled
        rounds = int(min(max(1, np.ceil(size * np.log(2 * missing + 1) / n)), max(1, size - first)))
        r = np.arange(first, first + rounds, dtype=np.uint64)
        if first < size:
            x = mix(hashes[None, :] + mix(r)[:, None])
            place = ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            key = np.sort((place << np.uint64(48) | r[:, None] << np.uint64(38) | mix(x) >> np.uint64(26)).ravel())
            best = key[np.concatenate(([True], key[1:] >> np.uint64(48) != key[:-1] >> np.uint64(48)))]
            at = (best >> np.uint64(48)).astype(np.int64)
            # values of earlier rounds are less, so rounds more or less change nothing that is filled
            least[at] = np.minimum(least[at], best & np.uint64((1 << 48) - 1))
        else:
            for place in np.flatnonzero(least == np.iinfo(np.uint64).max):
                x = mix(hashes + mix(np.uint64([size + place])))
                least[place] = np.uint64(size + place) << np.uint64(38) | (mix(x) >> np.uint64(26)).min()
        first += rounds
        missing = int((least == np.iinfo(np.uint64).max).sum())
    return mix(least)
