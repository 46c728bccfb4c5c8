"""Sets of 3-grams over a Jaccard threshold, found by sketches that lose no pair.

A sketch holds a bit for each of some 1 to 2 n slots: whether the number of the
set's grams that fall there is odd. A gram that only one of two sets holds turns
one bit at most, so sketches differ in no more bits than the sets do in grams,
and a pair whose sketches differ in more than the threshold allows is none. What
is left is compared by its grams. Sketches are a few bytes for ten grams; grams
and texts are never listed, and only texts that stand in a left pair are moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.checkpoints import cut

#: Bits of the shortest and of the longest sketch; longer sets only leave more pairs to compare.
SHORTEST, LONGEST = 64, 1 << 16
#: Rows of a block up to which it isn't divided; beyond, blocks grow with the number of rows.
BLOCK, BLOCK_WITH_GRAMS = 1024, 256
_BATCH = 4 << 20
_STRIP, _WIDE = 64, 2048


def gram_codes(text: str) -> np.ndarray:
    """The distinct runs of three characters, ascending, as numbers of 21 bits a character: no two runs share one."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(a[:-2] << 42 | a[1:-1] << 21 | a[2:]) if len(a) > 2 else np.zeros(0, np.int64)


def sketch(grams: np.ndarray) -> bytes:
    width = SHORTEST
    while width < len(grams) and width < LONGEST:
        width *= 2
    h = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (h >> np.uint64(43)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(slot, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def over(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard of two sets, as ascending numbers, is over the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1) > threshold


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds Arrow batches by bytes for this session, unless it has a smaller bound."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(limit)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= _BATCH:
        conf.set(limit, _BATCH)
    return df


def sketched(texts: DataFrame) -> DataFrame:
    """(g, o, n, same, sketch) of texts(g, o, t) that have grams; same is a digest of the set, n its size."""
    kept = texts.schema.fields[:2]
    schema = T.StructType([*kept, T.StructField("n", T.IntegerType()), T.StructField("same", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, bits = [], [], []
            for text in batch.column(2):
                grams = gram_codes(text.as_py() or "")
                n.append(len(grams))
                same.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                bits.append(sketch(grams) if len(grams) else b"")
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(same, pa.binary()), pa.array(bits, pa.binary())], names=schema.names)
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    return small_batches(texts).mapInArrow(run, schema)


def with_grams(texts: DataFrame) -> DataFrame:
    """(id, grams) of texts(id, t), the grams as bytes of ascending numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gram_codes(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "grams"])

    return small_batches(texts).select("id", "t").mapInArrow(run, "id long, grams binary")


class _Rows:
    """Rows of a block by size, with their sketches as matrices of words, one for each width."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, waits: np.ndarray, bits: list[bytes], grams: list[bytes] | None):
        by = np.lexsort((ids, n))
        self.id, self.n, self.waits = ids[by], n[by].astype(np.int64), waits[by]
        self.bits = [bits[k] for k in by]
        self.grams = [grams[k] for k in by] if grams else None

    def only(self, which: np.ndarray) -> _Rows:
        at = np.flatnonzero(which)
        out = object.__new__(_Rows)
        out.id, out.n, out.waits, out.bits = self.id[at], self.n[at], self.waits[at], [self.bits[k] for k in at]
        out.grams = [self.grams[k] for k in at] if self.grams else None
        return out

    def matrices(self) -> list[tuple[int, np.ndarray]]:
        """(first row, words by rows); sizes ascend, so each width is one run of rows."""
        size, out = np.array([len(b) for b in self.bits]), []
        starts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(size)] if len(size) else []
        for a, b in zip(starts, starts[1:], strict=False):
            out.append((int(a), np.ascontiguousarray(np.frombuffer(b"".join(self.bits[a:b]), np.uint64).reshape(b - a, -1).T)))
        return out

    @classmethod
    def of(cls, cell: pa.Scalar) -> _Rows:
        v = cell.values
        field = lambda k: v.field(k).to_numpy(zero_copy_only=False)
        grams = v.field("grams").to_pylist() if v.type.get_field_index("grams") >= 0 else None
        return cls(field("id"), field("n"), field("waits").astype(bool), v.field("sketch").to_pylist(), grams)


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    """A sketch of half the width is the exclusive-or of its halves."""
    while len(words) > to:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def close(x: _Rows, y: _Rows, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y of all pairs that may be over the threshold; with ``same``, x is y and a pair comes once."""
    share = (1 - threshold) / (1 + threshold)
    for fx, wx in x.matrices():
        for fy, wy in y.matrices():
            if same and fy < fx:
                continue
            words = min(len(wx), len(wy))
            a, b = _folded(wx, words), _folded(wy, words)
            nx, ny = x.n[fx : fx + a.shape[1]], y.n[fy : fy + b.shape[1]]
            for i in range(0, len(nx), _STRIP):
                k = min(i + _STRIP, len(nx))
                low, high = np.searchsorted(ny, nx[i] * threshold - 1e-6), np.searchsorted(ny, nx[k - 1] / threshold + 1e-6, "right")
                for j in range(max(low, i) if same and fx == fy else low, high, _WIDE):
                    m = min(j + _WIDE, high)
                    differ = np.zeros((k - i, m - j), np.uint16 if words < 1000 else np.uint32)
                    for w in range(words):
                        differ += np.bitwise_count(a[w, i:k, None] ^ b[w, None, j:m])
                    p, q = np.nonzero(differ <= (nx[i:k, None] + ny[None, j:m]) * share + 1e-6)
                    p, q = p + fx + i, q + fy + j
                    if same:
                        p, q = p[q > p], q[q > p]
                    if len(p):
                        yield p, q


def blocks_of(sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """(g, bin, sub, m, rows): the m rows of a group whose sizes are alike, dealt into blocks.

    Sizes of a pair over the threshold lie in one bin or in neighbouring ones.
    """
    binned = sets.withColumn("bin", F.floor(F.log("n") / (math.log(1 / threshold) * (1 + 1e-9))))
    counts = cut(binned.groupBy("g", "bin").agg(F.count("*").alias("c")))
    slices = F.greatest(F.lit(1), F.least(F.ceil(F.col("c") / most), F.ceil(F.pow("c", F.lit(0.25)) * 0.45 * BLOCK / most)))
    fields = [c for c in ("id", "n", "waits", "sketch", "grams") if c in sets.columns]
    dealt = binned.join(counts, ["g", "bin"]).withColumn("sub", F.pmod(F.xxhash64("id"), slices))
    return cut(dealt.groupBy("g", "bin", "sub").agg(F.count("*").alias("m"), F.collect_list(F.struct(*fields)).alias("rows")))


def tiles_of(blocks: DataFrame) -> DataFrame:
    """(same, a, b): the rows of every two blocks that may hold a pair, a block with itself too."""
    keys = blocks.select("g", "bin", "sub", "m")
    near = keys.withColumn("bin_b", F.explode(F.array("bin", F.col("bin") + 1)))
    other = keys.select("g", F.col("bin").alias("bin_b"), F.col("sub").alias("sub_b"))
    pairs = near.join(other, ["g", "bin_b"]).withColumn("same", (F.col("bin") == F.col("bin_b")) & (F.col("sub") == F.col("sub_b")))
    pairs = pairs.where("(bin_b > bin OR sub_b >= sub) AND NOT (same AND m = 1)").drop("m")
    left = blocks.select("g", "bin", "sub", F.col("rows").alias("a")).hint("merge")
    right = blocks.select("g", F.col("bin").alias("bin_b"), F.col("sub").alias("sub_b"), F.col("rows").alias("b")).hint("merge")
    return pairs.join(left, ["g", "bin", "sub"]).join(right, ["g", "bin_b", "sub_b"]).select("same", "a", "b")


def _ids(*columns: np.ndarray, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def waiting(sets: DataFrame, threshold: float) -> DataFrame:
    """The ids of sets(id, g, n, sketch) that an earlier set of their group may be similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(*map(batch.column, range(3)), strict=True):
                x = _Rows.of(a)
                y = x if same.as_py() else _Rows.of(b)
                late_x, late_y = np.zeros(len(x.id), bool), np.zeros(len(y.id), bool)
                for p, q in close(x, y, threshold, same.as_py()):
                    late_x[p[x.id[p] > y.id[q]]] = True
                    late_y[q[y.id[q] > x.id[p]]] = True
                yield _ids(np.unique(np.concatenate([x.id[late_x], y.id[late_y]])), names="id")

    blocks = blocks_of(sets.withColumn("waits", F.lit(False)), threshold, BLOCK)
    return small_batches(tiles_of(blocks)).mapInArrow(run, "id long").distinct()


def freed(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j): pairs that may be similar, of a set that doesn't wait and a later one that does, of sets(id, g, n, sketch, waits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(*map(batch.column, range(3)), strict=True):
                x = _Rows.of(a)
                y = x if same.as_py() else _Rows.of(b)
                for u, v in ((x, y), (y, x))[: 1 if same.as_py() else 2]:
                    u, v = u.only(~u.waits), v.only(v.waits)
                    for p, q in close(u, v, threshold):
                        i, j = u.id[p], v.id[q]
                        yield _ids(i[i < j], j[i < j], names="i j")

    return small_batches(tiles_of(blocks_of(sets, threshold, BLOCK))).mapInArrow(run, "i long, j long").distinct()


def exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i < j: all similar pairs of sets(id, g, n, sketch, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(*map(batch.column, range(3)), strict=True):
                x = _Rows.of(a)
                y = x if same.as_py() else _Rows.of(b)
                codes = lambda rows, k: np.frombuffer(rows.grams[k], np.int64)
                for p, q in close(x, y, threshold, same.as_py()):
                    ok = np.array([x.id[k] != y.id[m] and over(codes(x, k), codes(y, m), threshold) for k, m in zip(p, q, strict=True)], bool)
                    i, j = x.id[p[ok]], y.id[q[ok]]
                    yield _ids(np.minimum(i, j), np.maximum(i, j), names="i j")

    blocks = blocks_of(sets.withColumn("waits", F.lit(False)), threshold, BLOCK_WITH_GRAMS)
    return small_batches(tiles_of(blocks)).mapInArrow(run, "i long, j long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs(i, j) whose texts(id, t) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            i, j, ti, tj = (batch.column(k) for k in range(4))
            ok = np.zeros(len(i), bool)
            for k in range(len(i)):
                if (now := i[k].as_py()) != last:  # pairs come by i
                    last, x = now, gram_codes(ti[k].as_py())
                ok[k] = over(x, gram_codes(tj[k].as_py()), threshold)
            yield pa.RecordBatch.from_arrays([i, j], names=["i", "j"]).filter(pa.array(ok))

    both = pairs.join(texts.select(F.col("id").alias("j"), F.col("t").alias("tj")), "j").join(texts.select(F.col("id").alias("i"), F.col("t").alias("ti")), "i")
    return small_batches(both.select("i", "j", "ti", "tj")).mapInArrow(run, "i long, j long").distinct()


def keep_listed(df: DataFrame, keys: DataFrame, names: list[str], bits: int = 26) -> DataFrame:
    """The rows of df whose key may be listed, by a broadcast filter of 2**bits bits at most; so rows that aren't don't move."""
    slot = F.pmod(F.xxhash64(*names), F.lit(1 << bits))
    page, place = F.bitmap_bucket_number(slot).alias("_page"), F.bitmap_bit_position(slot).alias("_place")
    pages = cut(keys.select(page, place).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits")))
    hit = F.expr("getbit(cast(conv(hex(substring(_bits, cast(_place div 8 AS int) + 1, 1)), 16, 10) AS bigint), cast(_place % 8 AS int)) = 1")
    return df.select("*", page, place).join(F.broadcast(pages), "_page").where(hit).select(*df.columns)
