"""Elias-Fano sequences and an n-gram trie of two levels on them, searched by whole arrays of queries.

A monotone sequence of n values below u keeps the lower log2(u / n) bits of each value packed, and the upper bits in
unary in a bit vector with a count of ones per word. ``select`` and ``find`` work on arrays of queries. ``Trie.save``
writes all parts to one file and ``Trie.load`` maps it into memory, so that a search touches only the pages it needs.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)


def _mask(bits: int) -> np.uint64:
    return _ALL if bits >= 64 else (_ONE << U(bits)) - _ONE


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) of each word."""
    at = np.zeros(len(word), U)
    k = k.astype(U)
    word = word.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & _mask(half)).astype(U)
        up = k >= low
        k = np.where(up, k - low, k)
        word = np.where(up, word >> U(half), word)
        at += np.where(up, U(half), U(0))
    return at.astype(np.int64)


class EliasFano:
    """A monotone sequence of unsigned 64-bit values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U)
        if bits and n:
            at = np.arange(n, dtype=U) * U(bits)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            part = values & _mask(bits)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U(bits) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, U)
        np.bitwise_or.at(high, place >> 6, _ONE << (place & 63).astype(U))
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.low_bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        rest = np.where(shift > U(0), self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return ((self.low[word] >> shift) | rest) & _mask(self.low_bits)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word])

    def _bucket(self, top: np.ndarray) -> np.ndarray:
        """How many values have upper bits below ``top``: the ones before the zero that ends the bucket before."""
        out = np.zeros(len(top), np.int64)
        some = top > 0
        k = top[some] - 1
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        past = k >= zeros[-1]
        word = np.minimum(np.searchsorted(zeros, k, "right") - 1, len(self.high) - 1)
        place = _select_in_word(~self.high[word], np.where(past, 0, k - zeros[word]))
        out[some] = np.where(past, self.n, word * 64 + place - k)
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U)
        return ((self._select1(i) - i).astype(U) << U(self.low_bits)) | self._low(i)

    def successor(self, v: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | None = None) -> np.ndarray:
        """Position of the first value that isn't below each of ``v``, among the positions [low, high); ``high`` (n if not
        given) if there is none."""
        v = np.asarray(v, U)
        top = (v >> U(self.low_bits)).astype(np.int64)
        begin, end = self._bucket(top), self._bucket(top + 1)
        stop = np.full(len(v), self.n) if high is None else np.asarray(high, np.int64)
        at, end = np.minimum(np.maximum(begin, low), stop), np.minimum(end, stop)
        want = v & _mask(self.low_bits)
        left = np.flatnonzero(at < end)
        while len(left):
            left = left[self._low(at[left]) < want[left]]
            at[left] += 1
            left = left[at[left] < end[left]]
        return at

    def find(self, v: np.ndarray) -> np.ndarray:
        """Position of a value equal to each of ``v``, or -1."""
        v = np.asarray(v, U)
        if not self.n:
            return np.full(len(v), -1)
        at = self.successor(v)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.select(inside) == v), at, -1)

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}


CHILD_BITS = 40


class Trie:
    """Contexts, pointers to their children, children relative to their context, and a code for each child.

    All children are one monotone sequence: a context's are stored above the last value of the context before. So a
    child can only be told from its context's range: ``pointers`` give the range, the value before it is what the child
    is relative to, and its successor is searched inside the range.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.children, self.codes = contexts, pointers, children, codes

    @classmethod
    def build(cls, context: np.ndarray, child: np.ndarray, codes: np.ndarray) -> Trie:
        """From pairs sorted by context, then child; children have ``CHILD_BITS`` bits."""
        uniq, first, n = np.unique(context, return_index=True, return_counts=True)
        last = child[first + n - 1] + U(1)
        base = np.concatenate([np.zeros(1, U), np.cumsum(last, dtype=U)])[:-1]
        pointers = np.append(first, len(context)).astype(U)
        return cls(EliasFano.build(uniq), EliasFano.build(pointers), EliasFano.build(np.repeat(base, n) + child + U(1)), codes)

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions [begin, end) of each context's children; none for a context that the trie doesn't hold."""
        rank = self.contexts.find(context)
        known = np.flatnonzero(rank >= 0)
        begin, end = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        begin[known] = self.pointers.select(rank[known]).astype(np.int64)
        end[known] = self.pointers.select(rank[known] + 1).astype(np.int64)
        return begin, end

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 if the trie doesn't hold it."""
        out = np.zeros(len(context), self.codes.dtype)
        begin, end = self.ranges(context)
        some = np.flatnonzero(begin < end)
        if len(some):
            begin, end = begin[some], end[some]
            base = np.where(begin > 0, self.children.select(np.maximum(begin - 1, 0)), U(0))
            want = base + child[some] + U(1)
            at = self.children.successor(want, begin, end)
            inside = np.flatnonzero(at < end)
            hit = inside[self.children.select(at[inside]) == want[inside]]
            out[some[hit]] = self.codes[at[hit]]
        return out

    def fan_out(self, context: np.ndarray) -> np.ndarray:
        """The number of children of each context."""
        begin, end = self.ranges(context)
        return end - begin

    def save(self, path: str) -> None:
        arrays, head, at = [self.codes], {"codes": [0, len(self.codes), str(self.codes.dtype)]}, self.codes.nbytes + -self.codes.nbytes % 8
        for name in ("contexts", "pointers", "children"):
            ef = getattr(self, name)
            for part, a in ef.parts().items():
                head[f"{name}.{part}"] = [at, len(a), str(a.dtype)]
                at += a.nbytes
                arrays.append(a)
            head[name] = [ef.n, ef.low_bits]
        raw = json.dumps(head).encode()
        with open(path, "wb") as f:
            f.write(len(raw).to_bytes(8, "little"))
            f.write(raw + b" " * (-len(raw) % 8))
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Trie:
        """Map a saved trie into memory."""
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        base = 8 + size + -size % 8
        whole = np.memmap(path, np.uint8, "r") if Path(path).stat().st_size > base else np.zeros(0, np.uint8)

        def array(name: str) -> np.ndarray:
            at, n, kind = head[name]
            kind = np.dtype(kind)
            return whole[base + at : base + at + n * kind.itemsize].view(kind)

        parts = [EliasFano(*head[n], array(f"{n}.low"), array(f"{n}.high"), array(f"{n}.ones")) for n in ("contexts", "pointers", "children")]
        return cls(*parts, array("codes"))
