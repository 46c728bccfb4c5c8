"""Near-duplicate passages across documents by compact windows.

Under one hash function all runs of shingles whose smallest hash lies at place c
form one window (l, c, r): they begin in l..c and end in c..r. The windows of a
text are the nodes of the Cartesian tree over its hashes; those of at least the
passage length number about 2 n / length. Two passages of similarity J have their
smallest hash in common with probability J under each function, so windows of
equal hash, joined over a few functions, find all similar passages; windows must
overlap around c by a passage's length. What is found is verified on the words
along its diagonal and the diagonals beside it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .bitmap import build_bitmap, keep_listed
from .workdir import discard, materialize, small_batches

_PLACE_BITS = 24
_PLACES = (1 << _PLACE_BITS) - 1
_TURN = 0x9E3779 | 1
#: Documents of one side of a cell in which pairs are verified.
_CELL = 48
#: Pairs of a cell that documents with few pairs share.
_PAIRS = 128


def compact_windows(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least ``least`` places inside the ranges starts..ends; r is inclusive.

    All ranges are split at their smallest hash at once, level by level. Places of
    equal hash are ordered by a permutation of the places, so repetitive texts
    split evenly too.
    """
    place = np.arange(len(hashes), dtype=np.uint64)
    turned = place * np.uint64(_TURN) & np.uint64(_PLACES)
    packed = np.append((hashes & ~np.uint64(_PLACES)) | turned, np.uint64(0))
    back = np.uint64(pow(_TURN, -1, 1 << _PLACE_BITS))
    found = []
    keep = ends - starts >= least
    s, e = starts[keep], ends[keep]
    while len(s):
        edges = np.stack([s, e], 1).ravel()
        low = np.minimum.reduceat(packed, edges)[::2]
        c = ((low & np.uint64(_PLACES)) * back & np.uint64(_PLACES)).astype(np.int64)
        found.append((s, c, e - 1))
        s2, e2 = np.stack([s, c + 1], 1).ravel(), np.stack([c, e], 1).ravel()
        keep = e2 - s2 >= least
        s, e = s2[keep], e2[keep]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _text_windows(column: pa.Array, size: int, functions: int, least: int):
    """For each slice of texts: first row, rows, and per function (number, document, value, l, c, r, shingles, starts)."""
    word = tb.whitespace_words()
    random = np.random.default_rng(23).integers(0, 1 << 63, (2, functions), dtype=np.uint64)
    for lo, hi in tb.text_slices(column):
        hashes, counts = tb.word_hashes(column.slice(lo, hi - lo), word)
        ends = np.cumsum(counts)
        parts = [tb.shingles(hashes[e - n : e], size) if n >= size else np.empty(0, np.uint64) for e, n in zip(ends.tolist(), counts.tolist())]
        sizes = np.array([len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        last = np.cumsum(sizes)
        first = last - sizes
        # Places are packed in 24 bits; longer slices (one very long text) are cut with an overlap below.
        for f in range(functions):
            value = tb.mix((flat ^ random[0, f]) * (random[1, f] | np.uint64(1)))
            for a, b, s, e in _cuts(first, last, least):
                l, c, r = compact_windows(value[a:b], s - a, e - a, least)
                l, c, r = l + a, c + a, r + a
                doc = np.searchsorted(last, c, "right")
                yield lo, hi, f, doc, value[c], l, c, r, flat, first, last


def _cuts(first: np.ndarray, last: np.ndarray, least: int):
    """Ranges of places that fit the packing: usually one of all; a longer text is cut with an overlap of eight passages."""
    total = int(last[-1]) if len(last) else 0
    if total <= _PLACES:
        yield 0, total, first, last
        return
    step = _PLACES - 8 * least
    for s, e in zip(first.tolist(), last.tolist()):
        for a in range(s, max(s + 1, e), step):
            b = min(e, a + _PLACES)
            yield a, b, np.array([a]), np.array([b])
            if b == e:
                break


def _values(size: int, functions: int, least: int):
    def run(batches):
        for batch in batches:
            for _, _, f, _, value, *_ in _text_windows(batch.column(0), size, functions, least):
                keys, n = np.unique(value + np.uint64(f), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["value", "n"])

    return run


def _range_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """The smallest hash of the ``width`` shingles from each place on."""
    smallest, held = tb.mix(flat), 1
    while held < width:
        step = min(held, width - held)
        smallest = np.minimum(smallest, np.append(smallest[step:], np.repeat(smallest[-1:], step))[: len(smallest)])
        held += step
    return smallest


def _around(flat: np.ndarray, smallest: np.ndarray, width: int, c: np.ndarray, base: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Smallest hashes of two ranges on each side of the places c, 16 bits each; 0 where a range leaves the document."""
    out = np.zeros(len(c), np.uint64)
    for i, at in enumerate((c + size + 1, c + size + 1 + width, c - size - width, c - size - 2 * width)):
        inside = (at >= base) & (at + width <= end)
        low = tb.mix(smallest[np.where(inside, at, 0)]) >> np.uint64(48) if len(flat) else np.zeros(len(c), np.uint64)
        out |= np.where(inside, np.maximum(low, np.uint64(1)), np.uint64(0)) << np.uint64(16 * i)
    return out


def _windows(size: int, functions: int, least: int):
    # A passage of ``least`` shingles has half of them on one side of a place, so both ranges of that side are inside it.
    width = max(1, (least // 2 - size) // 2)

    def run(batches):
        for batch in batches:
            ids, seen = batch.column(0), None
            for lo, hi, f, doc, value, l, c, r, flat, first, last in _text_windows(batch.column(1), size, functions, least):
                doc_ids = ids.slice(lo, hi - lo).cast(pa.int64()).take(pa.array(doc))
                base = first[doc]
                if seen is not flat:
                    seen, smallest = flat, _range_hashes(flat, width)
                # The shingle after the place, or before it at a text's end, makes the key.
                after = c + size < last[doc]
                beside = np.where(after, c + size, c - size)
                inside = beside >= base
                other = flat[np.where(inside, beside, 0)] if len(flat) else np.empty(0, np.uint64)
                key = tb.mix((value ^ np.uint64(f + 1)) * np.uint64(0x9E3779B97F4A7C15) + other + np.where(after, np.uint64(1), np.uint64(2)))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array((value + np.uint64(f)).view(np.int64)), pa.array(key.view(np.int64), mask=~inside), *(pa.array(x - base, pa.int32()) for x in (l, c, r)), pa.array(_around(flat, smallest, width, c, base, last[doc], size).view(np.int64))],
                    names=["doc_id", "value", "key", "l", "c", "r", "around"],
                )

    return run


def _longest(match: np.ndarray, percent: int) -> tuple[int, int]:
    """The longest range in which at most the share of places differs that the similarity allows."""
    # Of n places x may differ if (n - x) / (n + x) >= J.
    j = percent / 100
    allowed = (1 - j) / (1 + j)
    score = np.concatenate([[0.0], np.cumsum(np.where(match, allowed, allowed - 1))])
    best_after = np.maximum.accumulate(score[::-1])[::-1]
    # best_after falls from left to right: the last place that reaches each start's score.
    reach = len(score) - np.searchsorted(best_after[::-1], score - 1e-9, "left") - 1
    span = reach - np.arange(len(score))
    i = int(span.argmax())
    a, b = i, int(reach[i])
    while a < b and not match[a]:
        a += 1
    while b > a and not match[b - 1]:
        b -= 1
    return a, b


def _ranges(match: np.ndarray, least: int, percent: int):
    """Ranges of at least ``least`` places, the longest of each stretch first, in which few enough places differ."""
    todo = [(0, len(match))]
    while todo:
        s, e = todo.pop()
        if e - s < least or 100 * np.count_nonzero(match[s:e]) < percent * least:
            continue
        a, b = _longest(match[s:e], percent)
        a, b = a + s, b + s
        if b - a < least:
            continue
        yield a, b
        todo += [(s, a), (b, e)]


class _Text:
    """A document's shingles as numbers below ``numbers``."""

    def __init__(self, number: np.ndarray, numbers: int):
        self.number, self.numbers = number, numbers
        self.keys = None

    def places(self, of: np.ndarray, low: int, high: int) -> np.ndarray:
        """For each place of the text ``of`` the diagonal (that place less the place here) in low..high on which this text has its shingle.

        The one nearest to their middle if there are several; beyond high if there is none.
        """
        if self.keys is None:
            self.keys = np.sort((self.number << 32) | np.arange(len(self.number)))
            self.once = (np.diff(self.keys >> 32) > 0).all()
            if self.once:
                self.at = np.full(self.numbers, -1)
                self.at[self.number] = np.arange(len(self.number))
        place, none = np.arange(len(of)), high + 1
        if self.once:
            at = self.at[of]
            diagonal = place - at
            return np.where((at >= 0) & (diagonal >= low) & (diagonal <= high), diagonal, none)
        middle = (low + high) // 2
        first = np.searchsorted(self.keys, (of << 32) + np.maximum(place - middle, 0))
        out = np.full(len(place), none)
        for at in (first - 1, first):
            key = self.keys[np.clip(at, 0, len(self.keys) - 1)]
            diagonal = place - (key & 0xFFFFFFFF)
            good = (at >= 0) & (at < len(self.keys)) & (key >> 32 == of) & (diagonal >= low) & (diagonal <= high)
            good &= (out == none) | (np.abs(diagonal - middle) < np.abs(out - middle))
            out[good] = diagonal[good]
        return out

    def forget(self) -> None:
        self.keys = self.at = None


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _along(match: np.ndarray, x: np.ndarray, y: np.ndarray, shift: np.ndarray, least: int, percent: int):
    """(from, to, from in y, to in y) of the similar ranges of x whose place i stands for place i - shift[i] of y where match[i]."""
    for a, b in _ranges(match, least, percent):
        c, d = a - int(shift[a]), b - int(shift[b - 1])
        same = match[a:b].all() and (shift[a:b] == shift[a]).all()
        if same or (d - c >= least and _similar(x[a:b], y[c:d], percent)):
            yield a, b, c, d


def _near_diagonals(x: _Text, y: _Text, low: int, high: int, least: int, percent: int):
    """(from, to, from in y, to in y) of the similar passages on diagonals low..high: words may be put in or left out inside them."""
    near = y.places(x.number, low, high)
    hits = np.flatnonzero(near <= high)
    if 100 * len(hits) < percent * least:
        return
    lo, hi = int(hits[0]), int(hits[-1]) + 1
    near = near[lo:hi]
    if hi - lo == len(hits) and (near == near[0]).all():
        if hi - lo >= least:
            yield lo, hi, lo - int(near[0]), hi - int(near[0])
        return
    rest = near <= high
    for a, b, c, d in _along(rest.copy(), x.number[lo:hi], y.number, near - lo, least, percent):
        rest[a:b] = False
        yield a + lo, b + lo, c, d
    # What is too long by one side's count of edits may not be by the other's.
    left = np.flatnonzero(rest)
    if 100 * len(left) >= percent * least:
        place = left + lo - near[left]
        back, other = np.zeros(len(y.number), np.int64), np.zeros(len(y.number), bool)
        back[place], other[place] = -near[left], True
        for c, d, a, b in _along(other, y.number, x.number, back, least, percent):
            yield a, b, c, d


def passages(x: _Text, y: _Text, shifts: list[int], least: int, percent: int):
    """(from, to, from in y, to in y), in shingles, of the similar passages of two texts near the diagonals ``shifts``."""
    if 0 in shifts and np.array_equal(x.number, y.number):
        if len(x.number) >= least:
            yield 0, len(x.number), 0, len(x.number)
        return
    # So many words may be missing from one of two similar passages whose parts are too short by themselves.
    band = 2 * least * (100 - percent) // max(1, percent)
    shifts = sorted(shifts)
    cuts = [0, *[i for i in range(1, len(shifts)) if shifts[i] - shifts[i - 1] > band], len(shifts)]
    for lo, hi in zip(cuts, cuts[1:]):
        found = list(_near_diagonals(x, y, shifts[lo] - band, shifts[hi - 1] + band, least, percent))
        if not found:
            for shift in shifts[lo:hi]:
                a, b = max(0, shift), min(len(x.number), len(y.number) + shift)
                if b - a >= least:
                    match = x.number[a:b] == y.number[a - shift : b - shift]
                    found += [(s + a, e + a, c + a - shift, d + a - shift) for s, e, c, d in _along(match, x.number[a:b], y.number[a - shift : b - shift], np.zeros(b - a, np.int64), least, percent)]
        yield from found


def _joined(spans: list[tuple[int, int, int]]):
    """Overlapping (start, end, partner) as one, with the smallest partner."""
    now = None
    for s, e, q in sorted(spans):
        if now and s < now[1]:
            now = [now[0], max(now[1], e), min(now[2], q)]
        else:
            if now:
                yield now
            now = [s, e, q]
    if now:
        yield now


def _verify(size: int, least: int, percent: int):
    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        word = tb.whitespace_words()
        column = texts.column("text").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        grams = []
        for lo, hi in tb.text_slices(column):
            hashes, counts = tb.word_hashes(column.slice(lo, hi - lo), word)
            e = np.cumsum(counts)
            grams += [tb.shingles(hashes[j - n : j], size) if n >= size else np.empty(0, np.uint64) for j, n in zip(e.tolist(), counts.tolist())]
        distinct, number = np.unique(np.concatenate(grams), return_inverse=True) if grams else ((), np.empty(0, np.int64))
        ends = np.cumsum([len(g) for g in grams])
        rows: dict[int, list[_Text]] = {}
        for k, e, g in zip(texts.column("doc_id").to_pylist(), ends, grams):
            rows.setdefault(k, []).append(_Text(number[e - len(g) : e], len(distinct)))
        spans: dict[int, list[tuple[int, int, int]]] = {}
        last = None
        for a, b, shifts in sorted(zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "shifts"))), key=lambda p: (p[1], p[0])):
            if last != b:  # one document's table of places at a time
                for y in rows.get(last, ()):
                    y.forget()
                last = b
            for x, y in itertools.product(rows.get(a, ()), rows.get(b, ())):
                for s, e, c, d in passages(x, y, shifts, least, percent):
                    spans.setdefault(a, []).append((s, e + size - 1, b))
                    spans.setdefault(b, []).append((c, d + size - 1, a))
        out = [(k, *x) for k, v in spans.items() for x in _joined(v)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start_word", "end_word", "partner_id"), zip(*out) if out else ((),) * 4)})

    return run


def _meets(least: int):
    """Do two windows (l, c, r) and (l2, c2, r2) overlap around c by that many shingles?"""
    left = F.least(F.col("c") - F.col("l"), F.col("c2") - F.col("l2"))
    return left + F.least(F.col("r") - F.col("c"), F.col("r2") - F.col("c2")) + 1 >= F.lit(least)


def _pairs(shared: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b, shifts, top) of shared(doc_id, c, doc_id2, c2, top), without the shifts that known(a, b, shifts) has."""
    shift = F.when(F.col("doc_id") > F.col("doc_id2"), F.col("c") - F.col("c2")).otherwise(F.col("c2") - F.col("c"))
    pairs = shared.select(F.greatest("doc_id", "doc_id2").alias("a"), F.least("doc_id", "doc_id2").alias("b"), shift.alias("shift"), "top")
    pairs = pairs.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts"), F.min("top").alias("top"))
    if known is not None:
        before = known.select("a", "b", F.col("shifts").alias("before"))
        pairs = pairs.join(before, ["a", "b"], "left").withColumn("shifts", F.when(F.col("before").isNull(), F.col("shifts")).otherwise(F.array_except("shifts", "before"))).where("size(shifts) > 0")
    return materialize(pairs.select("a", "b", "shifts", "top"), "pairs")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """(doc_id, start_word, end_word, partner_id) of the passages of pairs(a, b, shifts, top) near their diagonals.

    Pairs that met under one document's keys lie together, split into a grid of
    bounded cells, so a text is sent to a cell once and not once a pair. Documents
    with few pairs share cells.
    """
    sides = [pairs.select("top", side).distinct().groupBy("top").agg(F.ceil(F.count("*") / _CELL).cast("int").alias(f"n_{side}")) for side in "ab"]
    grid = materialize(sides[0].join(sides[1], "top"), "grid")
    shared = F.pmod(F.xxhash64("top"), F.lit(1 + pairs.count() // _PAIRS))
    few = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    dealt = materialize(
        pairs.join(grid, "top").select(
            F.when(few, -1 - shared).otherwise(F.col("top")).alias("top"), F.pmod(F.hash("a"), "n_a").alias("i"), F.pmod(F.hash("b"), "n_b").alias("j"), "a", "b", "shifts"
        ),
        "dealt",
    )
    cell = ("cell_top", "cell_i", "cell_j")
    wanted = dealt.select(*[F.col(c.split("_")[1]).alias(c) for c in cell], F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = keep_listed(docs, build_bitmap(wanted.select("doc_id").distinct(), ["doc_id"]), [F.col("doc_id")])
    sent = wanted.join(texts, "doc_id").select(*cell, "doc_id", "text")
    found = sent.groupBy(*cell).cogroup(dealt.groupBy("top", "i", "j")).applyInArrow(
        _verify(size, least, percent), "doc_id long, start_word long, end_word long, partner_id long"
    )
    found = materialize(found, "found")
    discard(grid, dealt)
    return found


def _unexplained(rows: DataFrame, found: DataFrame, size: int, least: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of windows (and the tables that they read) to be verified where the comparison with a key's smallest document found no passage.

    A window's hash and the smallest hash of a range beside c make a second kind of
    key. A window without a passage meets one member of each of those, of the document
    whose windows are shared most on average, which of edited copies is the least
    edited one. So the work is linear in the windows.
    """
    part = F.explode(F.sequence(F.floor(F.col("start_word") / 64), F.floor((F.col("end_word") - size) / 64))).alias("part")
    spans = _merged(found.groupBy("doc_id", "start_word").agg(F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id")))
    spans = spans.select("doc_id", "start_word", "end_word", part).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.coalesce(F.exists("spans", lambda s: (s["start_word"] <= F.col("c")) & (F.col("c") <= s["end_word"] - size)), F.lit(False))
    ranges = F.explode(F.array(*[F.when(slot != 0, F.xxhash64("value", F.lit(i), slot)) for i in range(4) for slot in [F.expr(f"shiftright(around, {16 * i}) & 65535")]])).alias("near")
    place = ("doc_id", "c", "l", "r")
    unmet = rows.withColumn("part", F.floor(F.col("c") / 64)).join(spans, ["doc_id", "part"], "left").where(~inside)
    unmet = materialize(unmet.select(ranges, *place).where("near IS NOT NULL"), "unmet")
    members = rows.select(ranges, *place).where("near IS NOT NULL")
    members = keep_listed(members, build_bitmap(unmet.select("near").distinct(), ["near"]), [F.col("near")])
    members = materialize(members, "members")
    sizes = members.groupBy("near").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    sizes = materialize(sizes.select("near", "n"), "sizes")
    sized = members.join(sizes, "near")
    weights = materialize(sized.groupBy("doc_id").agg(F.avg("n").alias("weight")), "weights")
    one = F.struct(*place)
    ranked = sized.join(weights, "doc_id").groupBy("near").agg(F.max(F.struct("weight", F.hash("near", "doc_id").alias("h"), one.alias("m"))).alias("x"))
    pivots = materialize(ranked.select("near", *[F.col(f"x.m.{n}").alias(f"{n}2") for n in place]), "pivots")
    met = unmet.join(pivots, "near")
    met = met.where((F.col("doc_id") != F.col("doc_id2")) & _meets(least * percent // 100)).select("doc_id", "c", "doc_id2", "c2", F.col("doc_id2").alias("top"))
    return met, [unmet, members, sizes, weights, pivots]


def substring_dedup(docs: DataFrame, words: int = 50, size: int = 5, percent: int = 80, functions: int = 4) -> DataFrame:
    """doc_id, start_word, end_word, n_words, partner_id: the passages of docs(doc_id, text, ...) that other documents repeat.

    A passage has at least ``words`` words (counted from 0; end_word is the first
    word after it) and its set of shingles of ``size`` words is similar, by percent,
    to that of such a passage in the document partner_id, which may have words put in
    or left out. Overlapping
    passages of a document are one; partner_id is then the smallest of their
    partners. Groups of copies aren't expanded: every member is verified against
    the group's smallest doc_id, and windows for which that finds no passage against
    the most connected member of each of their finer groups. A
    passage is missed if under all functions its smallest hash, a shingle next to it or
    the ranges beside it are edited, or if no member that it meets is similar to it;
    how often depends on where the edits lie (tests/llm/test_ops.py holds cases).

    Words are runs of other than ASCII white space, A-Z taken as a-z. Null, empty and
    short texts have no passages. Passages repeated inside one document alone don't
    count, and rows that repeat a doc_id are the same document. Rows without doc_id
    are left out. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    least = words - size + 1
    values = docs.select("text").mapInArrow(_values(size, functions, least), "value long, n long")
    repeated = values.groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
    bitmap = materialize(build_bitmap(repeated, ["value"]), "repeated")
    windows = docs.mapInArrow(_windows(size, functions, least), "doc_id long, value long, key long, l int, c int, r int, around long")
    windows = keep_listed(windows, bitmap, [F.col("value")])
    rows = materialize(
        windows.select("doc_id", "value", "key", "l", "c", "r", "around"), "windows"
    )
    # The smallest document's own places of a key meet a place of the key's largest document.
    place = F.struct("doc_id", "c", "l", "r")
    tops = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("top"), F.max(place).alias("last")).where("top.doc_id < last.doc_id")
    tops = materialize(tops, "tops")
    other = F.when(F.col("doc_id") == F.col("top.doc_id"), F.col("last")).otherwise(F.col("top"))
    shared = rows.join(tops, "key").select(F.col("top.doc_id").alias("top"), "doc_id", "l", "c", "r", *[other[x].alias(f"{x}2") for x in ("doc_id", "c", "l", "r")])
    shared = shared.where(_meets(least * percent // 100))
    pairs = _pairs(shared)
    first = _verified(docs, pairs, size, least, percent)
    rest, read = _unexplained(rows, first, size, least, percent)
    more = _pairs(rest, pairs)
    discard(rows, tops, bitmap, *read)
    found = first.unionByName(_verified(docs, more, size, least, percent))
    discard(pairs, more)
    # At most one row for each word of a document is left before passages are joined.
    spans = found.groupBy("doc_id", "start_word").agg(F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id"))
    return _merged(spans)


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping passages of a document as one."""
    order = Window.partitionBy("doc_id").orderBy("start_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start_word") < reach, 0).otherwise(1))
    grouped = marked.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "passage").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
