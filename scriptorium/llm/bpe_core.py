"""Byte-pair merges by dynamic programming over prefixes.

A symbol sequence has one encoding whose neighbours all agree with the merge
order, so the encoding of a prefix ends in the one token t whose left neighbour,
the last token of the shorter prefix, may stand next to t. With the last token of
every prefix known, the token count of every prefix is one more than that of the
prefix before its last token. Many words are solved at once: position by
position, over all words that are long enough.
"""

from __future__ import annotations

import json

import numpy as np

from .textbytes import mix

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.int32(-1)
#: Words of more symbols are solved one by one.
LONG = 256


def byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class HashIndex:
    """uint64 keys -> int32 values by vectorised probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.depth = int(rank.max()) + 1 if len(slot) else 1
        self.keys = np.zeros((self.depth, size), np.uint64)
        self.values = np.full((self.depth, size), _NONE)
        self.keys[rank, slot] = keys[order]
        self.values[rank, slot] = values[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE)
        live = np.flatnonzero(self.values[0, slot] >= 0)
        for d in range(self.depth):
            at = slot[live]
            hit = self.keys[d, at] == keys[live]
            out[live[hit]] = self.values[d, at[hit]]
            if d + 1 == self.depth:
                break
            live = live[~hit & (self.values[d + 1, at] >= 0)]
            if not len(live):
                break
        return out


class MergeTable:
    """Merges over symbols; token i < base is symbol i, token base + r is made by merge r."""

    def __init__(self, merges: list[tuple[int, int]], base: int):
        self.base = base
        n = base + len(merges)
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.length = np.ones(n, np.int32)
        pair = np.array(merges, np.int64).reshape(-1, 2)
        self.left[base:], self.right[base:] = pair[:, 0], pair[:, 1]
        symbols: list[tuple[int, ...]] = [(i,) for i in range(base)]
        known: dict[tuple[int, ...], int] = {s: i for i, s in enumerate(symbols)}
        for t, (a, b) in enumerate(merges, base):
            symbols.append(symbols[a] + symbols[b])
            known.setdefault(symbols[t], t)
        self.symbols = symbols
        self.canonical = known
        self.length = np.array([len(s) for s in symbols], np.int32)
        self.longest = int(self.length.max())
        self.lengths = np.unique(self.length)
        self.power = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(self.power)):
                self.power[i] = self.power[i - 1] * _BASE
        self.value = mix(np.arange(1, base + 1, dtype=np.uint64))
        distinct = list(known)
        keys = np.zeros(len(distinct), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(distinct):
                h = 0
                for x in s:
                    h = (h * int(_BASE) + int(self.value[x])) & 0xFFFFFFFFFFFFFFFF
                keys[i] = h
            keys += np.array([len(s) for s in distinct], np.uint64)
        self.tokens = HashIndex(keys, np.array([known[s] for s in distinct], np.int32))
        self.pairs = HashIndex(
            (pair[:, 0].astype(np.uint64) << np.uint64(32)) | pair[:, 1].astype(np.uint64), np.arange(base, n, dtype=np.int32)
        )
        self.rank = {(int(a), int(b)): t for t, (a, b) in enumerate(merges, base)}

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays a pair when its symbols are encoded.

        The merges that made both tokens are undone from the latest back; if the
        pieces that touch at some time have an earlier merge than the one undone
        last, that merge would have joined them across the border.
        """
        ok = np.ones(len(first), bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            joined = self.pairs.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).astype(np.int64)
            crossed = (joined >= 0) & (joined < limit)
            ok[live[crossed]] = False
            # Undo the later merge; of equal ones the left token's comes last, as merges run from the left.
            undo_a = (a > b) & (a >= self.base)
            undo_b = ~undo_a & (b >= self.base)
            undo_a |= ~undo_b & (a >= self.base)
            go = ~crossed & (undo_a | undo_b)
            limit = np.where(undo_a, a, b + 1)
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_b, self.left[b], b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def solve(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, last): token count and last token of every prefix, a row for each word.

        flat holds the words' symbols one after another; columns beyond a word's size hold -1.
        """
        n, widest = len(sizes), int(sizes.max(initial=0))
        order = np.argsort(-sizes, kind="stable")
        counts = np.full((n, widest + 1), -1, np.int32)
        counts[:, 0] = 0
        last = np.full((n, widest + 1), -1, np.int32)
        prefix = np.zeros((n, widest + 1), np.uint64)
        begin = (np.cumsum(sizes) - sizes)[order]
        sorted_sizes = sizes[order]
        with np.errstate(over="ignore"):
            for i in range(1, widest + 1):
                active = int(np.searchsorted(-sorted_sizes, -i, "right"))
                prefix[:active, i] = prefix[:active, i - 1] * _BASE + self.value[flat[begin[:active] + (i - 1)]]
                todo = np.arange(active)
                for size in self.lengths:
                    if size > i or not len(todo):
                        break
                    size = int(size)
                    key = prefix[todo, i] - prefix[todo, i - size] * self.power[size] + np.uint64(size)
                    token = self.tokens.get(key)
                    possible = np.flatnonzero(token >= 0)
                    if size < i and len(possible):
                        rows = todo[possible]
                        possible = possible[self.compatible(last[rows, i - size], token[possible])]
                    if len(possible):
                        rows = todo[possible]
                        last[rows, i] = token[possible]
                        counts[rows, i] = counts[rows, i - size] + 1
                        todo = np.delete(todo, possible)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return counts[back], last[back]

    def _compatible_one(self, a: int, b: int) -> bool:
        """compatible() for one pair."""
        limit = len(self.left)
        while True:
            joined = self.rank.get((a, b), -1)
            if 0 <= joined < limit:
                return False
            if a > b and a >= self.base:
                limit, a = a, self.right_of[a]
            elif b >= self.base:
                limit, b = b + 1, self.left_of[b]
            elif a >= self.base:
                limit, a = a, self.right_of[a]
            else:
                return True

    def solve_one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, last) of one word, symbol by symbol: for words too long to be solved side by side."""
        if not hasattr(self, "by_text"):
            self.by_text = {"".join(map(chr, x)): t for x, t in self.canonical.items()}
            self.left_of, self.right_of = self.left.tolist(), self.right.tolist()
            self.pair_memory: dict[tuple[int, int], bool] = {}
        text = "".join(map(chr, symbols.tolist()))
        sizes, memory, known = self.lengths.tolist(), self.pair_memory, self.by_text
        counts, last = [0], [-1]
        for i in range(1, len(text) + 1):
            for size in sizes:
                token = known.get(text[i - size : i]) if size <= i else None
                if token is None:
                    continue
                if size < i:
                    pair = (last[i - size], token)
                    fits = memory.get(pair)
                    if fits is None:
                        if len(memory) > 1_000_000:
                            memory.clear()
                        fits = memory[pair] = self._compatible_one(*pair)
                    if not fits:
                        continue
                counts.append(counts[i - size] + 1)
                last.append(token)
                break
        return np.array(counts, np.int32), np.array(last, np.int32)

    def trace(self, last: np.ndarray, end: int) -> list[int]:
        """The tokens of the prefix of that length."""
        out, i = [], end
        while i > 0:
            t = int(last[i])
            out.append(t)
            i -= int(self.length[t])
        return out[::-1]


def load_table(path: str) -> tuple[MergeTable, dict, list[int]]:
    """(merges, symbol letters -> symbol, vocabulary id of each token) of a tokenizers file with BPE merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    letters = byte_letters()
    symbols = letters + ([x + suffix for x in letters] if suffix else [])
    index = {s: i for i, s in enumerate(symbols)}
    merges, names = [], list(symbols)
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((index[a], index[b]))
        index.setdefault(a + b, len(names))
        names.append(a + b)
    return MergeTable(merges, len(symbols)), {s: i for i, s in enumerate(symbols)}, [vocab.get(x, -1) for x in names]
