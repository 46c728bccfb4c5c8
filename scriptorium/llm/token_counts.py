"""Exact token counts of every prefix of a text by dynamic programming over a byte-level vocabulary.

The count of a prefix is the count at the start of its last piece plus the count
that the prefix program gives inside that piece. Pieces are solved once for each
distinct piece (``bpe_core``); a document's record is then its piece ends with
running counts, from which any truncation or budget question is answered.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .bpe_core import LONG, byte_letters, load_table
from .pretokens import code_points, cut_specials, piece_hashes, spaced_pieces
from .workdir import small_batches

#: Pieces of one worker's memory; beyond it the memory starts anew.
REMEMBERED = 400_000


class PrefixCounter:
    """Prefix counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        self.table, symbols, _ = load_table(path)
        self.symbol_of = np.array([symbols[x] for x in byte_letters()], np.int64)
        with open(path, encoding="utf-8") as f:
            self.specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.empty(0, np.uint64), np.empty(0, np.int64)

    def solve(self, pieces: list[str]) -> list[np.ndarray]:
        """For each piece the token count of every prefix, by bytes."""
        out = []
        encoded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if any(len(r) > LONG for r in encoded):
            return [self.table.solve_one(self.symbol_of[np.frombuffer(r, np.uint8)])[0] for r in encoded]
        for lo in range(0, len(pieces), 1000):
            raw = encoded[lo : lo + 1000]
            sizes = np.array([len(r) for r in raw])
            counts = self.table.solve(self.symbol_of[np.frombuffer(b"".join(raw), np.uint8)], sizes)[0]
            out += [c[: n + 1] for c, n in zip(counts, sizes)]
        return out

    def _last_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The token counts of byte ranges, solved together by size."""
        out = np.empty(len(starts), np.int64)
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        fits = int(np.searchsorted(sizes[order], LONG, "right"))
        for i in order[fits:]:
            out[i] = self.table.solve_one(self.symbol_of[data[starts[i] : ends[i]]])[0][-1]
        order = order[:fits]
        lo = 0
        while lo < len(order):
            # A part's matrices have at most about a million cells, or hold one piece.
            hi = lo + 1 + int(np.searchsorted(np.arange(2, len(order) - lo + 1) * sizes[order[lo + 1 :]], 1 << 20))
            part = order[lo:hi]
            n = sizes[part]
            flat = np.arange(n.sum()) + np.repeat(starts[part] - (np.cumsum(n) - n), n)
            counts = self.table.solve(self.symbol_of[data[flat]], n)[0]
            out[part] = counts[np.arange(len(part)), n]
            lo = hi
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, tuple]:
        """(tokens of each text, what records() needs)."""
        segments, owner, after = cut_specials(texts, self.specials)
        cps, offs = code_points(segments)
        starts, ends = spaced_pieces(cps, offs)
        distinct, first, inverse = np.unique(piece_hashes(cps, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = np.frombuffer("".join(segments).encode("utf-8", "surrogatepass"), np.uint8)
            byte_at = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))])
            values = self._last_counts(data, byte_at[starts[first[new]]], byte_at[ends[first[new]]])
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.values = np.insert(self.values, at[new], values)
        each = self.values[np.searchsorted(self.keys, distinct)][inverse]
        running = np.concatenate([[0], np.cumsum(each)])
        bounds = np.searchsorted(starts, offs)
        per_segment = running[bounds[1:]] - running[bounds[:-1]] + (after >= 0)
        counts = np.bincount(owner, per_segment, len(texts)).astype(np.int64)
        return counts, (segments, owner, after, offs, ends, running, bounds)

    def records(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(tokens of each text, piece ends in code points, exact counts of the prefixes that end there)."""
        counts, (_, owner, after, offs, ends, running, bounds) = self.totals(texts)
        at: list[list[np.ndarray]] = [[] for _ in texts]
        upto: list[list[np.ndarray]] = [[] for _ in texts]
        where = np.zeros(len(texts), np.int64)
        base = np.zeros(len(texts), np.int64)
        names = {i: len(s) for s, i in self.specials.items()}
        for k, i in enumerate(owner):
            lo, hi = bounds[k], bounds[k + 1]
            at[i].append(where[i] + ends[lo:hi] - offs[k])
            upto[i].append(base[i] + running[lo + 1 : hi + 1] - running[lo])
            where[i] += offs[k + 1] - offs[k]
            base[i] += running[hi] - running[lo]
            if after[k] >= 0:
                where[i] += names[int(after[k])]
                base[i] += 1
                at[i].append(where[i : i + 1].copy())
                upto[i].append(base[i : i + 1].copy())
        ends_at, exact = [np.concatenate(x) for x in at], [np.concatenate(x) for x in upto]
        for i, (text, p) in enumerate(zip(texts, ends_at)):
            # A prefix that ends in white space is cut into other pieces than the whole text is.
            keep = np.array([e == len(text) or not text[e - 1].isspace() for e in p.tolist()], bool)
            ends_at[i], exact[i] = p[keep], exact[i][keep]
        return counts, ends_at, exact

    def every_prefix(self, text: str) -> np.ndarray:
        """The token count of text[:p] for p from 0 to its length; each piece is solved once."""
        out = np.zeros(len(text) + 1, np.int64)
        segments, _, after = cut_specials([text], self.specials)
        names = {i: s for s, i in self.specials.items()}
        start = base = 0
        for segment, special in zip(segments, after.tolist()):
            name = names.get(special, "")
            whole = segment + name[:-1]  # a special string that isn't complete is ordinary text
            part = self._ordinary(whole)
            out[start : start + len(whole) + 1] = base + part
            start += len(segment) + len(name)
            base += int(part[len(segment)]) + bool(name)
            out[start] = base
        return out

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of every prefix of a text without special strings."""
        out = np.zeros(len(text) + 1, np.int64)
        if not text:
            return out
        cps, offs = code_points([text])
        starts, ends = spaced_pieces(cps, offs)
        pieces = [text[s:e] for s, e in zip(starts, ends)]
        base = 0
        # A prefix that ends in white space ends in one piece of all of that white space.
        white = {s: e for s, e in _white_runs(text)}
        solved = self.solve(pieces + [text[s:e] for s, e in white.items()])
        for (s, e), piece, counts in zip(zip(starts, ends), pieces, solved):
            at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])])
            inside = counts[at]
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                inside = np.array([0, 1, 2, 2][: len(piece)] + [int(counts[-1])])  # a contraction is one only when complete
            out[s + 1 : e + 1] = base + inside[1:]
            base += int(counts[-1])
        starts_at = dict(zip(starts.tolist(), range(len(pieces))))
        total = np.concatenate([[0], np.cumsum([int(c[-1]) for c in solved[: len(pieces)]])])
        for (s, e), counts in zip(white.items(), solved[len(pieces) :]):
            at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text[s:e]])])
            out[s + 1 : e + 1] = total[starts_at[s]] + counts[at][1:]
        return out


def _white_runs(text: str):
    from .pretokens import SPACE, classes

    cps, _ = code_points([text])
    white = np.concatenate([[False], classes()[cps] == SPACE, [False]])
    edges = np.flatnonzero(white[1:] != white[:-1])
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def counter(path: str) -> PrefixCounter:
    cache = tb.worker_cache()
    key = ("prefix_counter", path)
    if key not in cache:
        cache[key] = PrefixCounter(path)
    return cache[key]


def token_counts(docs: DataFrame, vocabulary: str, store: str = "totals") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs(doc_id, text, ...); whole texts, no special tokens added.

    ``vocabulary`` is a tokenizers file that every executor can open. With
    ``store="pieces"`` two arrays follow: prefix_end (code points) and
    prefix_tokens (exact count of the prefix that ends there), one entry a piece that
    doesn't end in white space, and the text's end;
    with ``store="all"`` prefix_tokens has the count of every prefix, from the
    empty one on, and prefix_end is 0, 1, 2...

    Null and empty texts have 0 bytes and 0 tokens. Strings of special tokens
    inside a text count as that one token, as the library has it by default.
    Repeated rows and null ids are kept as they are; other columns are ignored;
    an empty table gives an empty result.
    """
    if store not in ("totals", "pieces", "all"):
        raise ValueError(f"store: {store}")
    schema = "doc_id long, n_bytes long, n_tokens long"
    if store != "totals":
        schema += ", prefix_end array<long>, prefix_tokens array<long>"

    def count(batches):
        program = counter(vocabulary)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in tb.text_slices(column):
                part = column.slice(lo, hi - lo)
                sizes = np.diff(tb.text_buffer(part)[1])
                texts = [t or "" for t in part.to_pylist()]
                if store == "pieces":
                    counts, at, upto = program.records(texts)
                elif store == "all":
                    upto = [program.every_prefix(t) for t in texts]
                    at = [np.arange(len(x)) for x in upto]
                    counts = np.array([x[-1] for x in upto], np.int64)
                else:
                    counts = program.totals(texts)[0]
                columns = [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
                if store != "totals":
                    columns += [pa.array(x, pa.list_(pa.int64())) for x in (at, upto)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


def longest_prefix_within(counted: DataFrame, budget: int) -> DataFrame:
    """Adds cut_end (code points) and cut_tokens: the longest stored prefix of at most ``budget`` tokens; nothing is encoded anew."""
    fits = F.filter(F.arrays_zip("prefix_end", "prefix_tokens"), lambda x: x["prefix_tokens"] <= budget)
    best = F.array_max(F.transform(fits, lambda x: F.struct(x["prefix_end"].alias("e"), x["prefix_tokens"].alias("t"))))
    return counted.withColumn("cut_end", F.coalesce(best["e"], F.lit(0).cast("long"))).withColumn(
        "cut_tokens", F.coalesce(best["t"], F.lit(0).cast("long"))
    )
