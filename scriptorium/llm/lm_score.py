"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A word's probability is P(class | context) * P(word | class). A word's class is
read off its letters, so unseen words have one. P(class | context) is a softmax
over weights of hashed features of the words before: the word before and the two
words before together (n-grams), the word before that by itself (skip), each as
the word's hash and as its class alone. P(word | class) is the word's share of
its class in the training tokens, smoothed by 0.1.

The corpus is counted in one pass (words, and classes by context). The softmax
is trained on the counts of contexts by gradient steps: tasks compute the
gradient of their contexts, the sums move the weights. Frequent words, at most
``head`` of them by construction, go to the scoring tasks; all other words
are joined with their counts by shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .language_id import held_out
from .workdir import discard, materialize, small_batches

#: Classes of words; class 0 is the end of a text. A word's hash holds its class in the lowest bits.
CLASS_BITS = 5
CLASSES = 1 << CLASS_BITS
#: Bits of the word before and of the word before that in a context; the lowest are the word's class, the others its hash.
NEAR_BITS, FAR_BITS = 10, 8
CONTEXTS = 1 << NEAR_BITS + FAR_BITS
#: Hashed feature buckets.
BUCKETS = 1 << 14
END = np.uint64(0xE4D0F7E87A000000)
WORD, CONTEXT, SUMMARY = 0, 1, 2


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash with class of each token, offsets of the documents); each document closes with the end token."""
    data, offs = tb.text_buffer(column)
    starts, ends, counts = tb.word_spans(data, offs, tb.whitespace_words())
    whole = tb.hash_spans(data, starts, ends)
    # The class comes from the last two bytes, with A-Z as a-z, and whether the word is short.
    tail = tb.hash_spans(data, np.maximum(starts, ends - 2), ends)
    label = (tail % np.uint64(CLASSES - 1)).astype(np.uint64) + np.uint64(1)
    hashes = (whole & ~np.uint64(CLASSES - 1)) | label
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, code of the two words before it); before a text stand ends."""
    label = (tokens & np.uint64(CLASSES - 1)).astype(np.int64)
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    code = np.zeros(len(tokens), np.int64)
    for back, bits, at in ((1, NEAR_BITS, 0), (2, FAR_BITS, NEAR_BITS)):
        before = np.zeros(len(tokens), np.int64)
        before[back:] = (tokens[:-back] & np.uint64((1 << bits) - 1)).astype(np.int64)
        code |= np.where(place >= back, before, 0) << at
    return label, code


def _features(code: np.ndarray) -> np.ndarray:
    """Hashed feature buckets of contexts: bias, n-grams and skips of words and of classes."""
    near, far = code % (1 << NEAR_BITS), code >> NEAR_BITS
    one, two = near % CLASSES, far % CLASSES
    parts = [np.zeros_like(code), one, near, one + CLASSES * two, near + (two << NEAR_BITS), code, two, far]
    keys = np.stack([(p.astype(np.uint64) << np.uint64(4)) + np.uint64(i) for i, p in enumerate(parts)], 1)
    return (tb.mix(keys + np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)


def _log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits = weights[features].sum(1)
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def count_corpus(docs: DataFrame) -> DataFrame:
    """kind, key, n: counts of words (by hash) and of (context, class) pairs over all rows."""

    def count(batches):
        pending: dict[int, list[np.ndarray]] = {WORD: [], CONTEXT: []}
        size = 0

        def flush():
            for kind, parts in pending.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    m = len(keys[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, kind), pa.int32()), pa.array(keys[part].view(np.int64)), pa.array(n[part], pa.int64())], names=["kind", "key", "n"]
                    )

        for batch in batches:
            for lo, hi in tb.text_slices(batch.column(0)):
                tokens, bounds = _tokens(batch.column(0).slice(lo, hi - lo))
                label, code = _contexts(tokens, bounds)
                pending[WORD].append(tokens)
                pending[CONTEXT].append((code * CLASSES + label).view(np.uint64))
                size += len(tokens)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def train_classes(contexts: DataFrame, steps: int = 12, prior: float = 8.0) -> np.ndarray:
    """Weights (buckets x classes) by distributed gradient steps over the counted contexts (key, n).

    There are at most CONTEXTS of them, each with the counts of its classes in one
    row. A task sums the gradient (observed less expected counts) and the expected
    counts of its contexts in two arrays of fixed size, which are added over the
    tasks. The step is the gradient by a rate for each weight, one over its expected
    count and a prior and shared out among the features that fire together, at most
    1 in either direction.
    """
    spark = contexts.sparkSession
    weights = np.zeros((BUCKETS, CLASSES))
    label = F.col("key") % CLASSES
    parts = contexts.groupBy(F.shiftright("key", CLASS_BITS).alias("context")).agg(*[F.sum(F.when(label == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(CLASSES)])
    parts = materialize(parts.repartition(8, "context"), "contexts")
    share = _features(np.zeros(1, np.int64)).shape[1]
    for _ in range(steps):
        now = spark.sparkContext.broadcast(weights.astype(np.float32))

        def gradient(batches, now=now):
            w = now.value.astype(np.float64)
            sums = np.zeros((2, *w.shape))
            for batch in batches:
                context, *columns = (np.asarray(c) for c in batch.columns)
                counts = np.stack(columns, 1).astype(np.float64)
                for lo in range(0, len(context), 2048):
                    features = _features(context[lo : lo + 2048].astype(np.int64))
                    c = counts[lo : lo + 2048]
                    expected = c.sum(1, keepdims=True) * np.exp(_log_softmax(w, features))
                    for k in range(share):
                        np.add.at(sums[0], features[:, k], c - expected)
                        np.add.at(sums[1], features[:, k], expected)
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

        sums = np.zeros((2, *weights.shape))
        for row in parts.mapInArrow(gradient, "sums binary").toLocalIterator():
            sums += np.frombuffer(row["sums"], np.float32).reshape(sums.shape)
        now.unpersist()
        if not sums[1].any():
            break
        weights = weights + np.clip(sums[0] / (sums[1] + prior), -1, 1) / share
    discard(parts)
    return weights


def lm_score(docs: DataFrame, head: int = 1 << 20, steps: int = 12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each doc_id of docs(doc_id, text, ...).

    Learns from rows whose crc32 of the id as text, modulo 10, is not 0. Tokens are
    runs of other than ASCII white space with A-Z as a-z, and one end a text. With
    c a token's training count, N all and V distinct training tokens, base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))); score is the model's log10 probability,
    in which a class's words and its unknown word share it by c + 0.1 likewise.

    Null and empty texts are one end token. Rows that repeat a doc_id are scored
    together as one row, sums over both. Without training rows N and V are 0 and
    the model gives all classes the same probability. Other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialize(count_corpus(docs.where(~held_out(parts=10, part=0))), "counts")
    words = counted.where(F.col("kind") == WORD)
    by_class = words.groupBy((F.col("key").bitwiseAND(CLASSES - 1)).cast("int").alias("label")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_n[r["label"]], class_v[r["label"]] = r["n"], r["v"]
    train_tokens, distinct = int(class_n.sum()), int(class_v.sum())
    weights = train_classes(counted.where(F.col("kind") == CONTEXT).select("key", "n"), steps)

    # At most `head` words can have a count above N / head.
    least = train_tokens // head + 1
    frequent = words.where(F.col("n") > least).select("key", "n").toPandas().sort_values("key", kind="stable")
    frequent_keys = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent_keys)
    model = docs.sparkSession.sparkContext.broadcast(
        (frequent_keys[order], frequent["n"].to_numpy(np.int64)[order], weights.astype(np.float32), class_n + 0.1 * (class_v + 1))
    )

    run = uuid.uuid4().hex

    def score(batches):
        keys, counts, w, class_size = model.value
        logs = np.log10(counts + 0.1)
        cache = tb.worker_cache()
        if cache.get("lm_run") != run:  # one table a worker, not one a task
            table = np.empty((CONTEXTS, CLASSES), np.float32)
            for lo in range(0, CONTEXTS, 2048):
                p = _log_softmax(w.astype(np.float64), _features(np.arange(lo, lo + 2048, dtype=np.int64)))
                table[lo : lo + 2048] = p / np.log(10) - np.log10(class_size)
            cache["lm_run"], cache["lm_table"] = run, table.ravel()
        table = cache["lm_table"]
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in tb.text_slices(column):
                tokens, bounds = _tokens(column.slice(lo, hi - lo))
                n = hi - lo
                owner = np.repeat(np.arange(n), np.diff(bounds))
                label, code = _contexts(tokens, bounds)
                context = np.add.reduceat(table[code * CLASSES + label].astype(np.float64), bounds[:-1])
                at = np.minimum(np.searchsorted(keys, tokens), max(0, len(keys) - 1))
                hit = keys[at] == tokens if len(keys) else np.zeros(len(tokens), bool)
                known = np.bincount(owner[hit], minlength=n)
                base = np.bincount(owner[hit], logs[at[hit]], n)
                # The tail: a document's distinct other words with their number.
                rest = np.flatnonzero(~hit)
                order = np.lexsort((tokens[rest], owner[rest]))
                o, t = owner[rest][order], tokens[rest][order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(t)))
                doc = ids.slice(lo, n).cast(pa.int64())
                m = len(first)
                # A summary's key is spread over the word keys' range, so no partition gathers the summaries.
                spread = tb.mix(tokens[bounds[:-1]] + np.arange(n, dtype=np.uint64) + np.uint64(lo)) & ~np.uint64(CLASSES - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([doc, doc.take(pa.array(o[first]))]),
                        pa.array(np.concatenate([spread, t[first]]).view(np.int64)),
                        pa.array(np.concatenate([np.full(n, SUMMARY), np.full(m, WORD)]), pa.int32()),
                        pa.array(np.concatenate([np.diff(bounds), tf]), pa.int64()),
                        pa.array(np.concatenate([known, np.zeros(m, np.int64)]), pa.int64()),
                        pa.array(np.concatenate([base, np.zeros(m)])),
                        pa.array(np.concatenate([context, np.zeros(m)])),
                    ],
                    names=["doc_id", "key", "row_kind", "tf", "known", "base", "context"],
                )

    rows = docs.mapInArrow(score, "doc_id long, key long, row_kind int, tf long, known long, base double, context double")
    tail_counts = words.where(F.col("n") <= least).select("key", "n")
    is_word = F.col("row_kind") == WORD
    n = F.coalesce("n", F.lit(0))
    joined = rows.join(tail_counts, "key", "left").select(
        "doc_id",
        F.when(is_word, 0).otherwise(F.col("tf")).alias("n_tokens"),
        F.when(is_word, F.when(n > 0, F.col("tf")).otherwise(0)).otherwise(F.col("known")).alias("n_known"),
        F.when(is_word, F.col("tf") * F.log10(n + 0.1)).otherwise(F.col("base")).alias("base"),
        "context",
    )
    sums = joined.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "context")])
    size = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    return sums.select(
        "doc_id", held_out(parts=10, part=0).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * size).alias("base_score"), (F.col("base") + F.col("context")).alias("score"),
    )
