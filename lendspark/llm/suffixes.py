"""Suffix arrays by induced sorting, and permuted common prefixes (numpy)."""

from __future__ import annotations

import numpy as np

from .textbytes import Prefix

#: Alphabets of up to so many symbols are induced bucket by bucket, vectorised.
SMALL_ALPHABET = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), else False (L)."""
    step = np.sign(np.diff(t.astype(np.int64)))
    telling = np.flatnonzero(step)
    at = np.searchsorted(telling, np.arange(len(step)))
    out = np.zeros(len(t), dtype=bool)
    known = at < len(telling)
    out[:-1][known] = step[telling[at[known]]] > 0
    out[-1] = True  # the sentinel
    return out


def _split(positions: np.ndarray, symbols: np.ndarray):
    """(symbol, positions of it in order), for each symbol."""
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(np.arange(len(symbols)), cuts):
        if len(part):
            yield int(symbols[part[0]]), positions[part]


def _induce_buckets(t: np.ndarray, sigma: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the order ``lms`` of the leftmost-smaller suffixes induces."""
    own: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c, p in _split(lms, t[lms]):
        own[c].append(p)
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def before(block: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        p = block[block > 0] - 1
        p = p[smaller[p] == kind]
        return p, t[p]

    def spread(blocks: list[np.ndarray], into: list[list[np.ndarray]], kind: bool) -> None:
        """What a bucket's blocks induce; what they add to the bucket itself comes in the next round."""
        done = 0
        while done < len(blocks):
            block = np.concatenate(blocks[done:])
            done = len(blocks)
            for s, p in _split(*before(block, kind)):
                into[s].append(p)

    for c in range(sigma):
        spread(larger[c], larger, False)
        spread(own[c], larger, False)
    less: list[list[np.ndarray]] = [[] for _ in range(sigma)]  # from right to left
    for c in range(sigma - 1, -1, -1):
        spread(less[c], less, True)
        if larger[c]:
            spread([np.concatenate(larger[c])[::-1]], less, True)
    parts = []
    last = np.array([len(t) - 1])
    for c in range(sigma):
        parts += larger[c] + [block[::-1] for block in reversed(less[c])]
    return np.concatenate([last, *parts]) if t[-1] == 0 else np.concatenate(parts)


def _induce_loop(t: np.ndarray, sigma: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for large alphabets, one suffix after the other."""
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    text, is_s, sa = t.tolist(), smaller.tolist(), [-1] * len(t)
    tail = ends.tolist()
    for p in reversed(lms.tolist()):
        tail[text[p]] -= 1
        sa[tail[text[p]]] = p
    head = (ends - counts).tolist()
    for i in range(len(sa)):
        p = sa[i] - 1
        if p >= 0 and not is_s[p]:
            sa[head[text[p]]] = p
            head[text[p]] += 1
    tail = ends.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and is_s[p]:
            tail[text[p]] -= 1
            sa[tail[text[p]]] = p
    sa[0] = len(text) - 1
    return np.array(sa, dtype=np.int64)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Of ``t``, whose symbols are 1 to sigma - 1 and whose last one is 0.

    Leftmost-smaller substrings are sorted by one induction and named; if names
    repeat, the string of names is sorted by this function itself; the order of
    its suffixes induces the whole array.
    """
    t = np.asarray(t, dtype=np.int64)
    if len(t) == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_buckets if sigma <= SMALL_ALPHABET else _induce_loop
    first = induce(t, sigma, smaller, lms)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    rank = np.zeros(len(t), dtype=np.int64)
    rank[lms] = np.arange(len(lms))
    end = np.minimum(np.append(lms[1:], len(t) - 1) + 1, len(t))
    names = Prefix(t).hashes(lms, end)[rank[ordered]]
    lengths = (end - lms)[rank[ordered]]
    new = np.concatenate([[0], np.cumsum((names[1:] != names[:-1]) | (lengths[1:] != lengths[:-1]))])
    if new[-1] + 1 < len(lms):
        reduced = np.zeros(len(lms), dtype=np.int64)
        reduced[rank[ordered]] = new
        ordered = lms[suffix_array(reduced, int(new[-1]) + 1)]
    return induce(t, sigma, smaller, ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position in the text: length of the common prefix with the suffix before it in ``sa``.

    A length is one less than that of the position before, unless the symbols
    before the two suffixes differ; only there symbols are compared.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = phi >= 0
    fresh = has & ((at == 0) | (phi == 0) | (t[at - 1] != t[np.maximum(phi, 1) - 1]))
    j = np.flatnonzero(fresh)
    length = np.zeros(len(j), dtype=np.int64)
    padded = np.concatenate([t.astype(np.uint16), np.full(8, 0, np.uint16)])
    words = np.ndarray(shape=(n + 4,), dtype="<u8", buffer=padded.tobytes(), strides=(2,))
    live = np.arange(len(j))
    while len(live):
        a, b = j[live] + length[live], phi[j[live]] + length[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        diff = words[a] ^ words[b]
        low = diff & (~diff + np.uint64(1))
        equal = np.where(diff == 0, 4, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 16)
        length[live] += equal
        live = live[equal == 4]
    reach = np.full(n, -1, dtype=np.int64)
    length = np.minimum(length, n - np.maximum(j, phi[j]))
    reach[j] = length + j
    return np.where(has, np.maximum(np.maximum.accumulate(reach) - at, 0), 0)
