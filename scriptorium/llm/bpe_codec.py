"""BPE encoding as a bounded-lookahead transducer, and decoding as a byte-to-text state machine.

The encoder holds a window of symbols. The merge list fixes how far to the right
of a token's end symbols may still change it (``sufficient_lookahead``); tokens
that end that far before the window's end are stable and leave it, so memory is
constant however long a word is. Words that fit a window are one window each, and
a batch's distinct words are solved together.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .bpe_core import LONG, MergeTable, byte_letters, load_table
from .pretokens import bare_pieces, code_points, cut_specials, piece_hashes
from .workdir import small_batches

#: Distinct words of one worker's memory; beyond it the memory starts anew.
REMEMBERED = 250_000


def sufficient_lookahead(table: MergeTable) -> int:
    """How many symbols to the right of a token's end can decide on it.

    A merge (a, b) is lost only if b's right part merges earlier with what follows:
    a chain (a, b), (b, c), (c, d) ... of ever earlier merges, or the same at the
    right edge of a part that b is made of. Taken from the earliest merge up, the
    reach of a token's right edge is the longest such chain, so one pass over the
    merge list gives the bound.
    """
    n = len(table.length)
    edge = np.zeros(n, np.int64)  # symbols that can decide whether the token's parts merge
    start = np.zeros(n, np.int64)  # reach of the merges so far that start with the token
    for t in range(table.base, n):
        a, b = int(table.left[t]), int(table.right[t])
        reach = max(int(edge[b]), int(start[b]))
        edge[t] = max(reach, int(edge[a]) - int(table.length[b]))
        start[a] = max(int(start[a]), int(table.length[b]) + reach)
        # What starts with t's right part may also break t's right edge later on.
        edge[t] = max(edge[t], start[b])
    return int(max(edge.max(initial=0), start.max(initial=0))) + table.longest


class Transducer:
    """Encodes a stream of symbols; push() returns the tokens that are stable, finish() the rest."""

    def __init__(self, table: MergeTable, lookahead: int | None = None):
        self.table = table
        self.lookahead = lookahead or sufficient_lookahead(table)
        self.window = 4 * self.lookahead
        self.held: list[int] = []

    def push(self, symbols) -> list[int]:
        out: list[int] = []
        for s in symbols:
            self.held.append(int(s))
            if len(self.held) >= self.window:
                out += self._emit(len(self.held) - self.lookahead)
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.held))

    def _emit(self, upto: int) -> list[int]:
        """The tokens of the window that end at ``upto`` or before."""
        if not self.held:
            return []
        last = self.table.solve_one(np.array(self.held, np.int64))[1]
        tokens, end = [], 0
        for t in self.table.trace(last, len(self.held)):
            end += int(self.table.length[t])
            if end > upto:
                break
            tokens.append(t)
        del self.held[: sum(int(self.table.length[t]) for t in tokens)]
        return tokens


class TextDecoder:
    """Bytes to text, a token at a time: an incomplete character waits, a broken one becomes U+FFFD."""

    def __init__(self):
        self.waiting = b""

    def push(self, piece: bytes) -> str:
        data = self.waiting + piece
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if need > back else 0
                break
            if byte < 0x80:
                break
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


class WordCodec:
    """Codec of a vocabulary file whose words end with a mark: texts are normalised (NFC, lower case), white space goes."""

    def __init__(self, path: str):
        self.table, symbols, self.ids = load_table(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.suffix = data["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([symbols[x] for x in letters], np.int64)
        self.final = np.array([symbols[x + self.suffix] for x in letters], np.int64)
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.strings = {i: s for s, i in data["model"]["vocab"].items()} | {i: s for s, i in self.specials.items()}
        self.bytes_of = {x: bytes([i]) for i, x in enumerate(letters)}
        self.lookahead = sufficient_lookahead(self.table)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.count, self.id_text, self.token_text = [], [], []

    @staticmethod
    def normalize(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case by letter, without regard to the word's end
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """The token ids of each word, a range of bytes."""
        out: list[list[int]] = [[]] * len(starts)
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        fits = int(np.searchsorted(sizes[order], min(LONG, 4 * self.lookahead)))
        lo = 0
        while lo < fits:
            # A part's matrices have at most about a million cells, or hold one word.
            hi = min(fits, lo + 1 + int(np.searchsorted(np.arange(2, fits - lo + 1) * sizes[order[lo + 1 : fits]], 1 << 20)))
            part = order[lo:hi]
            n = sizes[part]
            flat = np.arange(n.sum()) + np.repeat(starts[part] - (np.cumsum(n) - n), n)
            symbols = self.inner[data[flat]]
            last_at = np.cumsum(n) - 1
            symbols[last_at] = self.final[data[flat[last_at]]]
            for i, tokens in zip(part.tolist(), self._trace_all(self.table.solve(symbols, n)[1], n)):
                out[i] = tokens
            lo = hi
        for i in order[fits:].tolist():
            run = Transducer(self.table, self.lookahead)
            tokens = run.push(self.inner[data[starts[i] : ends[i] - 1]]) + run.push([self.final[data[ends[i] - 1]]])
            out[i] = [self.ids[t] for t in tokens + run.finish()]
        return out

    def _trace_all(self, last: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """The ids of many words at once, from their ends back."""
        ids, length = np.array(self.ids), self.table.length
        n = len(sizes)
        steps, at, rows = [], sizes.copy(), np.arange(n)
        who = []
        while len(rows):
            t = last[rows, at[rows]]
            steps.append(ids[t])
            who.append(rows)
            at[rows] -= length[t]
            rows = rows[at[rows] > 0]
        depth = np.zeros(n, np.int64)
        for r in who:
            depth[r] += 1
        first = np.cumsum(depth) - depth
        flat = np.empty(int(depth.sum()), np.int64)
        for k, (r, t) in enumerate(zip(who, steps)):
            flat[first[r] + depth[r] - 1 - k] = t
        flat_list = flat.tolist()
        return [flat_list[a : a + d] for a, d in zip(first.tolist(), depth.tolist())]

    def encode(self, texts: list[str]):
        """(numbers of the words in memory, words per segment, owner, special after each segment)."""
        segments, owner, after = cut_specials(texts, self.specials)
        segments = [self.normalize(s) for s in segments]
        cps, offs = code_points(segments)
        starts, ends = bare_pieces(cps, offs)
        distinct, first, inverse = np.unique(piece_hashes(cps, starts, ends), return_index=True, return_inverse=True)
        if len(self.slot) > REMEMBERED:
            self._forget()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.slot]
        if new:
            data = np.frombuffer("".join(segments).encode("utf-8", "surrogatepass"), np.uint8)
            byte_at = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))])
            at = first[new]
            for i, ids in zip(new, self.encode_words(data, byte_at[starts[at]], byte_at[ends[at]])):
                self.slot[keys[i]] = len(self.count)
                self.count.append(len(ids))
                self.id_text.append(" ".join(map(str, ids)))
                self.token_text.append(" ".join([self.strings[x] for x in ids]))
        words = np.array([self.slot[k] for k in keys], np.int64)[inverse]
        return words, np.searchsorted(starts, offs), owner, after

    def encode_ids(self, text: str) -> list[int]:
        words, bounds, _, after = self.encode([text])
        out: list[int] = []
        for k, special in enumerate(after.tolist()):
            for w in words[bounds[k] : bounds[k + 1]].tolist():
                out += [int(x) for x in self.id_text[w].split()]
            out += [special] if special >= 0 else []
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens' strings, joined by spaces."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def to_text(self, ids: list[int]) -> str:
        """Readable text: the tokens' bytes through the state machine, a space after each word."""
        machine, out = TextDecoder(), []
        special = {i: s for s, i in self.specials.items()}
        for i in ids:
            if i in special:
                out += [machine.finish(), special[i]]
                continue
            token = self.strings[i]
            ends = token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            out.append(machine.push(b"".join(self.bytes_of[c] for c in body)))
            out += [machine.finish(), " "] if ends else []
        return "".join([*out, machine.finish()]).rstrip(" ")


def codec(path: str) -> WordCodec:
    cache = tb.worker_cache()
    key = ("word_codec", path)
    if key not in cache:
        cache[key] = WordCodec(path)
    return cache[key]


def bpe_codec(docs: DataFrame, vocabulary: str, store: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text, ...).

    Ids are those of the library for this file without added special tokens; the
    decoded text joins the tokens' strings by spaces. The digests are of the ids
    (decimal, joined by one space) and of the decoded text in UTF-8. With
    ``store`` the columns ids array<int> and decoded string follow.

    Null and empty texts, and texts of white space, have no tokens and the digest
    of the empty text. Special strings inside a text are that token. Repeated rows
    and null ids are kept as they are; other columns are ignored; an empty table
    gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * store

    def run(batches):
        program = codec(vocabulary)
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            for lo, hi in tb.text_slices(column):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                words, bounds, owner, after = program.encode(texts)
                number, id_text, token_text = program.count, program.id_text, program.token_text
                words = words.tolist()
                counts, ids, decoded, k = [], [], [], 0
                for i in range(len(texts)):
                    n, left, right = 0, [], []
                    while k < len(owner) and owner[k] == i:
                        part = words[bounds[k] : bounds[k + 1]]
                        n += sum([number[w] for w in part])
                        left += [id_text[w] for w in part]
                        right += [token_text[w] for w in part]
                        if after[k] >= 0:
                            n += 1
                            left.append(str(after[k]))
                            right.append(program.strings[int(after[k])])
                        k += 1
                    counts.append(n)
                    ids.append(" ".join(left))
                    decoded.append(" ".join(right))
                columns = [
                    rows.slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if store:
                    columns += [pa.array([[int(y) for y in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
