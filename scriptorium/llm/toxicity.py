"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic model of its words and of the words' first
bytes (inflected words share those); a document is toxic if
one of its sentences is, so the sentences combine by noisy-or,
1 - prod(1 - p). Only document labels train the weights, by gradient steps
through the noisy-or; the sentences that carry a document's score are then known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .language_id import held_out
from .workdir import discard, materialize, small_batches

#: Labelled documents that the fit reads at most (the smallest hashes of their ids).
SAMPLE = 20_000
#: Buckets of hashed words and word beginnings.
BUCKETS = 1 << 20
#: Sizes in bytes of the word beginnings that are features; None is the whole word.
BEGINNINGS = (None, 4, 5, 6, 7)


def _sentences(column: pa.Array, buckets: int):
    """(bucket of each feature, its sentence, document of each sentence); a sentence ends at . ! ? or a line's end.

    A word's beginnings are features only if the word is longer.
    """
    data, offs = tb.text_buffer(column)
    starts, ends, counts = tb.word_spans(data, offs, tb.alnum_words())
    hashed = tb.hash_prefixes(data, starts, ends, list(BEGINNINGS))
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".!?\n"]] = True
    stops = np.flatnonzero(stop[data])
    before = np.searchsorted(stops, starts)
    doc = np.repeat(np.arange(len(column)), counts)
    new = np.ones(len(starts), bool)
    new[1:] = (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    words, sentences = [], []
    with np.errstate(over="ignore"):
        for size, h in zip(BEGINNINGS, hashed):
            use = slice(None) if size is None else ends - starts > size
            words.append(((h[use] * np.uint64(2 * (size or 0) + 1) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
            sentences.append(sentence[use])
    return np.concatenate(words), np.concatenate(sentences), doc[new]


def _noisy_or(weights, bias, words, sentence, doc, n_docs):
    """(probability of each sentence, log(1 - p) summed by document)."""
    n = len(doc)
    logit = np.bincount(sentence, weights[words], n) + bias
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)


def _document_features(buckets: int):
    """For each document its label and distinct feature buckets, as (bucket, documents, toxic ones) summed over a batch."""

    def run(batches):
        for batch in batches:
            labels = batch.column(2).to_numpy()
            for lo, hi in tb.text_slices(batch.column(1)):
                words, sentence, doc = _sentences(batch.column(1).slice(lo, hi - lo), buckets)
                pairs = np.unique(doc[sentence] * buckets + words)
                at, where = np.unique(pairs % buckets, return_inverse=True)
                toxic = np.bincount(where, labels[lo:hi][pairs // buckets], len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(np.bincount(where, minlength=len(at)), pa.int64()), pa.array(toxic.astype(np.int64))], names=["bucket", "n", "n_toxic"]
                )

    return run


def _strong_sentences(buckets: int, strong: np.ndarray):
    """Rows (doc_id, toxic, n, features): a document's sentences that hold strong features, by their set of features; an empty set counts the others."""

    def run(batches):
        number = np.full(buckets, -1)
        number[strong] = np.arange(len(strong))
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in tb.text_slices(batch.column(1)):
                words, sentence, doc = _sentences(batch.column(1).slice(lo, hi - lo), buckets)
                small = number[words]
                pair = np.unique(sentence[small >= 0] * np.int64(buckets) + small[small >= 0])
                at, what = pair // buckets, pair % buckets
                total = np.bincount(doc, minlength=hi - lo)
                sets: dict[tuple, int] = {}
                cuts = np.flatnonzero(np.diff(at)) + 1
                for s, features in zip(at[np.concatenate([[0], cuts])] if len(at) else (), np.split(what, cuts)):
                    key = (int(doc[s]), *features.tolist())
                    sets[key] = sets.get(key, 0) + 1
                rest = total - np.bincount([d for d, *_ in sets], list(sets.values()), hi - lo).astype(np.int64)
                rows = [(ids[lo + d], labels[lo + d], n, f) for (d, *f), n in sets.items()]
                rows += [(ids[lo + d], labels[lo + d], int(rest[d]), []) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())))], names=["doc_id", "toxic", "n", "features"]
                )

    return run


def gradient_steps(labels: np.ndarray, doc: np.ndarray, count: np.ndarray, features: list, guess: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient steps with momentum on the documents' log-likelihood under the noisy-or.

    Row i stands for count[i] sentences of document doc[i] whose features are features[i].
    The weights are drawn towards ``guess``: words that others outshine keep it.
    """
    sentence = np.repeat(np.arange(len(doc)), [len(f) for f in features])
    words = np.concatenate([np.asarray(f, np.int64) for f in features]) if len(features) else np.empty(0, np.int64)
    w, bias = guess.copy(), -6.0
    speed, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[words], len(doc)) + bias, -30, 30)))
        none = np.exp(np.bincount(doc, count * np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
        # d loglik / d logit of a sentence: -p for a clean document, p * none / (1 - none) for a toxic one.
        g = count * p * np.where(labels > 0, none / np.maximum(1 - none, 1e-9), -1.0)[doc]
        grad = np.append(np.bincount(words, g[sentence], len(w)) - 0.02 * (w - guess), g.sum())
        speed = 0.9 * speed + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
        w += move[:-1]
        bias += move[-1]
    return w, float(bias)


def _fit_task(guess: np.ndarray, steps: int):
    def run(batches):
        rows = [b for b in batches]
        ids, toxic, count, features = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in range(4)) if rows else ((),) * 4
        # The order of the rows doesn't show in the sums.
        order = sorted(range(len(ids)), key=lambda i: (ids[i], tuple(features[i])))
        docs, doc = np.unique(np.asarray(ids, np.int64)[order], return_inverse=True)
        labels = np.zeros(len(docs))
        labels[doc] = np.asarray(toxic, float)[order]
        w, bias = gradient_steps(labels, doc, np.asarray(count, float)[order], [features[i] for i in order], guess, steps)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(w)), -1], pa.int64()), pa.array([*w, bias])], names=["number", "weight"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, steps: int = 100, min_docs: int = 4) -> tuple[dict[int, float], float]:
    """(weight of each bucket that has one, bias), from at most ``sample`` labelled documents that aren't held out.

    The sample is the rows with the smallest hashes of their ids, at most half of it
    for each label. Tasks find the features in parallel; those that occur in toxic
    documents far more often than chance would have it are kept (at most ``buckets``).
    One task then gets the sentences with kept features, as their numbers, and fits.
    """
    small_batches(docs.sparkSession)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    marked = materialize(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out()), "marked")
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # At most ``sample`` ids: their table may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = materialize(texts.join(F.broadcast(materialize(chosen, "chosen")), "doc_id"), "sample").select("doc_id", "text", "toxic")
    n, n_toxic = both.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return {}, (30.0 if n_toxic else -30.0)
    rate = n_toxic / n
    # More toxic documents than chance would put there, by five standard deviations.
    excess = (F.col("n_toxic") - F.col("n") * rate) / F.sqrt(F.greatest(F.col("n") * (rate * (1 - rate)), F.lit(1e-9)))
    counts = both.mapInArrow(_document_features(buckets), "bucket long, n long, n_toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    kept = counts.where((F.col("n_toxic") >= min_docs) & (excess > 5)).orderBy("bucket").toPandas()
    strong, in_all, in_toxic = (kept[c].to_numpy(np.int64) for c in ("bucket", "n", "n_toxic"))
    # Log-odds of a document with the feature are the first guess.
    odds = np.log((in_toxic + 8 * rate) / (in_all - in_toxic + 8 * (1 - rate))) - np.log(rate / (1 - rate))
    guess = np.clip(2 * odds, 0, 8)
    rows = both.mapInArrow(_strong_sentences(buckets, strong), "doc_id long, toxic int, n long, features array<int>")
    rows = rows.groupBy("doc_id", "features").agg(F.max("toxic").alias("toxic"), F.sum("n").alias("n")).where("n > 0").select("doc_id", "toxic", "n", "features")
    found = {r["number"]: r["weight"] for r in rows.repartition(1).mapInArrow(_fit_task(guess, steps), "number long, weight double").collect()}
    bias = found.pop(-1, -30.0)
    model = {int(strong[i]): w for i, w in found.items() if w}
    discard(marked)
    share = (sizes.get(1, 0), sizes.get(0, 0), min(sizes.get(1, 0), sample // 2), min(sizes.get(0, 0), sample // 2))
    if all(share):
        # The bias was learned at the sample's rate of toxic documents; shift it to the labels' rate.
        bias += float(np.log(share[0] / share[1]) - np.log(share[2] / share[3]))
    return model, bias


def score_toxicity(docs: DataFrame, model: dict[int, float], bias: float, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence, worst_score for each row of docs; worst_sentence counts from 0, null without words."""

    def score(batches):
        weights = np.zeros(buckets)
        weights[list(model)] = list(model.values())
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in tb.text_slices(column):
                words, sentence, doc = _sentences(column.slice(lo, hi - lo), buckets)
                hit = weights[words] != 0
                pair = np.unique(sentence[hit] * buckets + words[hit])
                p, log_none = _noisy_or(weights, bias, pair % buckets, pair // buckets, doc, hi - lo)
                total = -np.expm1(log_none)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                top = np.zeros(hi - lo)
                at = np.zeros(hi - lo, np.int64)
                if len(full):
                    top[full] = np.maximum.reduceat(p, first[full])
                    order = np.lexsort((np.arange(len(p)), -p, doc))
                    at[full] = order[first[full]] - first[full]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.clip(total, 0, 1)), pa.array(sizes, pa.int64()),
                        pa.array(at, pa.int64(), mask=sizes == 0), pa.array(top, pa.float64(), mask=sizes == 0),
                    ],
                    names=["doc_id", "score", "n_sentences", "worst_sentence", "worst_score"],
                )

    schema = "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double"
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence, worst_score for each row of docs(doc_id, text, ...).

    labels(doc_id, toxic) teach; labels of held-out ids (crc32 of the id as text,
    modulo 4, is 2), null labels and labels other than 0 and 1 don't. A document
    with several labels counts as toxic if one says so. Null and empty texts have no
    sentence and score 0. Without labels, or with one kind of them, every sentence
    scores the same. Repeated rows are each scored; other columns are ignored; an
    empty table gives an empty result.
    """
    model, bias = fit_toxicity(docs, labels, **options)
    return score_toxicity(docs, model, bias).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score"
    )
