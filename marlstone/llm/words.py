"""Batches of texts as arrays of word codes: the vectorised base of the operators that work on words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The white space that separates words, besides the blank: tab, line feed, vertical tab, form feed, carriage return.
OTHER_SPACES = "\t\n\x0b\x0c\r"


def small_batches(batches, column: int, limit: int = 4_000_000):
    """The same rows in batches of about ``limit`` bytes of text at most (a longer text is a batch of its own), so that what
    is worked on at once doesn't grow with the length of the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)] if len(part) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.take(pa.array(np.arange(a, b)))  # a copy: some string kernels misread views


def split_words(texts: pa.Array, lower_ascii: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word in turn, places where each text's words start, one more than texts).

    Words are runs of anything but U+0020 and U+0009 to U+000D. A null text has no words.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower_ascii:
        texts = pc.ascii_lower(texts)
    for space in OTHER_SPACES:
        texts = pc.replace_substring(texts, space, " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    vocabulary = coded.dictionary.to_pylist()
    offsets = np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    if "" in vocabulary:  # what stands between two spaces
        none = vocabulary.index("")
        word = codes != none
        before = np.concatenate([[0], np.cumsum(word)])
        offsets, codes = before[offsets], codes[word]
    return vocabulary, codes, offsets.astype(np.int64)


def word_hashes(vocabulary: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w.encode("utf-8", "surrogatepass"), seed) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct hashes, ascending, of each text's runs of ``k`` words; a text of 1 to k-1 words has one, of all its words."""
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            own = np.zeros(1, dtype=np.uint64)
            for h in hashes[a:b]:
                own = own * np.uint64(0x9E3779B97F4A7C15) + h
            out.append(mix(own + np.uint64(int(b - a))))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
