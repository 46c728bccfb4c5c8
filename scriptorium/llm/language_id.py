"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector is the product
of its letters' vectors, each permuted by its place; a text's vector is the sum
of its n-grams' vectors and a language's prototype the sum of its texts' vectors.
A text is given the language whose prototype has the largest cosine with it. As
the cosine is linear in the text's n-grams but for the text's own length, which
is the same for all languages, each distinct n-gram meets the prototypes once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .pretokens import LETTER, classes, code_points
from .workdir import small_batches

UNDETERMINED = "und"
#: N-grams whose vectors are made at a time, and n-grams of which a worker keeps the products with the prototypes.
BLOCK, REMEMBERED = 256, 250_000


def held_out(column: str = "doc_id", parts: int = 4, part: int = 2):
    """Rows whose crc32 of the id as text leaves that remainder; learning leaves them out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


class Space:
    """The vectors of letters and n-grams."""

    def __init__(self, dimensions: int, n: int, seed: int = 11):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[cp] = np.random.default_rng([self.seed, cp]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[cp]

    def gram(self, cps) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place, cp in enumerate(cps):
            out = out * np.roll(self.letter(int(cp)), self.n - 1 - place)
        return out

    def grams(self, table: np.ndarray) -> np.ndarray:
        """The vectors of rows of n code points."""
        distinct, inverse = np.unique(table, return_inverse=True)
        inverse = inverse.reshape(table.shape)
        rolled = np.array([self.letter(int(c)) for c in distinct], np.int8).reshape(-1, self.dimensions)
        out = np.ones((len(table), self.dimensions), np.int8)
        for place in range(self.n):
            out *= np.roll(rolled, self.n - 1 - place, axis=1)[inverse[:, place]]
        return out


def _folded() -> np.ndarray:
    """Lower case of each letter, 32 (a gap) for all else."""
    cache = tb.worker_cache()
    if "folded" not in cache:
        table = np.full(0x110000, 32, np.uint32)
        letters = np.flatnonzero(classes() == LETTER)
        for cp in letters.tolist():
            low = chr(cp).lower()
            table[cp] = ord(low) if len(low) == 1 else cp
        cache["folded"] = table
    return cache["folded"]


def text_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams as rows of code points, number of each place's n-gram, its text, letters per text).

    Runs of other than letters are one gap; every text begins and ends with a gap; n-grams of gaps alone don't occur.
    """
    cps, offs = code_points([" " + t + " " for t in texts])
    folded = _folded()[cps]
    owner = np.repeat(np.arange(len(texts)), np.diff(offs))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep], owner[keep]
    letters = np.bincount(owner[folded != 32], minlength=len(texts))
    if len(folded) < n:
        return np.empty((0, n), np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), letters
    alphabet, code = np.unique(folded, return_inverse=True)
    size = len(alphabet)
    last = len(folded) - n + 1
    key = np.zeros(last, np.int64)
    for place in range(n):
        key = key * size + code[place : last + place]
    same = owner[:last] == owner[n - 1 :]
    if size**n <= 1 << 22:
        seen = np.zeros(size**n, bool)
        seen[key[same]] = True
        distinct = np.flatnonzero(seen)
        number = np.cumsum(seen)[key[same]] - 1
    else:
        distinct, number = np.unique(key[same], return_inverse=True)
    table = np.empty((len(distinct), n), np.uint32)
    rest = distinct
    for place in range(n - 1, -1, -1):
        table[:, place] = alphabet[rest % size]
        rest = rest // size
    return table, number, owner[:last][same], letters


def _texts(column: pa.Array):
    for lo, hi in tb.text_slices(column, tb.PIECE // 2):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _packed(table: np.ndarray) -> np.ndarray:
    """A number for each n-gram; exact up to three letters, a hash beyond."""
    out = np.zeros(len(table), np.uint64)
    for place in range(table.shape[1]):
        out = (tb.mix(out) if place > 2 else out) * np.uint64(1 << 21) + table[:, place]
    return out


class _Known:
    """The products of n-grams with the prototypes, in ascending order of the n-grams' numbers."""

    def __init__(self, space: Space, matrix: np.ndarray):
        self.space, self.matrix = space, matrix
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, len(self.matrix)))

    def products(self, table: np.ndarray) -> np.ndarray:
        if len(self.keys) > REMEMBERED:
            self._forget()
        keys = _packed(table)
        order = np.argsort(keys)
        asked = keys[order]
        at = np.searchsorted(self.keys, asked)
        new = np.ones(len(asked), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != asked[inside]
        if new.any():
            which = order[new]
            rows = [self.space.grams(table[which[i : i + BLOCK]]).astype(np.float64) @ self.matrix.T for i in range(0, len(which), BLOCK)]
            self.rows = np.insert(self.rows, at[new], np.concatenate(rows), axis=0)
            self.keys = np.insert(self.keys, at[new], asked[new])
        return self.rows[np.searchsorted(self.keys, keys)]


def fit_prototypes(docs: DataFrame, dimensions: int = 2048, n: int = 3) -> dict[str, np.ndarray]:
    """language -> unit prototype, from all rows of docs(text, lang) whose text and lang aren't null.

    A task sums its rows' vectors by language, so what reaches the shuffle is one
    vector for each task and language, and the driver gets one for each language:
    both are bounded by the number of languages, not by the rows.
    """
    small_batches(docs.sparkSession)

    def bundle(batches):
        space = Space(dimensions, n)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, texts in _texts(batch.column(0)):
                table, number, owner, _ = text_grams(texts, n)
                names = sorted(set(langs[lo:hi]))
                which = np.array([names.index(x) for x in langs[lo:hi]])[owner]
                counts = np.bincount(which * len(table) + number, minlength=len(names) * len(table)).reshape(len(names), -1)
                for at in range(0, len(table), BLOCK):
                    part = counts[:, at : at + BLOCK].astype(np.float64) @ space.grams(table[at : at + BLOCK]).astype(np.float64)
                    for name, row in zip(names, part):
                        sums[name] = sums.get(name, 0) + np.rint(row).astype(np.int64)
        for name, row in sums.items():
            if isinstance(row, np.ndarray):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(row, pa.int64())], names=["lang", "dim", "value"]
                )

    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = labelled.mapInArrow(bundle, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    vectors: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", "v.value").collect():
        v = np.array(row["value"], np.float64)
        norm = np.linalg.norm(v)
        if norm:
            vectors[row["lang"]] = v / norm
    return vectors


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs(doc_id, text, ...); only the text decides.

    score is the best language's share of the positive cosines, 0 to 1. A text that
    is null or has no letter, or any text if no language was learned, gets ``und``
    and 0; of equal cosines the alphabetically first language wins.
    """
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else 1
    matrix = np.array([prototypes[x] for x in names], np.float64).reshape(len(names), dimensions)
    schema = "_row_id long, _lang string, _score double"
    small_batches(docs.sparkSession)

    def predict(batches):
        known = _Known(Space(dimensions, n), matrix)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in _texts(batch.column(1)):
                table, number, owner, letters = text_grams(texts, n)
                weights = known.products(table)
                sims = np.stack([np.bincount(owner, weights[number, j], len(texts)) for j in range(len(names))], 1) if names else np.zeros((len(texts), 1))
                best = sims.argmax(1)
                positive = np.maximum(sims, 0)
                total = positive.sum(1)
                score = np.where(total > 0, positive.max(1) / np.where(total > 0, total, 1), 0.0)
                known_text = (letters > 0) & bool(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()),
                        pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known_text)], pa.string()),
                        pa.array(np.where(known_text, np.clip(score, 0, 1), 0.0)),
                    ],
                    names=["_row_id", "_lang", "_score"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(predict, schema).select(
        F.col("_row_id").alias("doc_id"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def language_id(docs: DataFrame, dimensions: int = 2048, n: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang, ...).

    Prototypes are learned from all rows that aren't held out (crc32 of the id as
    text, modulo 4, is 2), hold a text and have a language; predictions see the text
    alone. Rows with a null doc_id count as not held out. Repeated rows are each
    predicted; other columns are ignored; an empty table gives an empty result.
    """
    learn = docs.where(~held_out())
    prototypes = fit_prototypes(learn, dimensions, n)
    return predict_language(docs, prototypes, n).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known_language(docs: DataFrame, languages: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """docs without the rows whose language is undetermined, isn't one of ``languages`` or scores less than ``min_score``.

    All columns stay. Rows of one doc_id share the best of their scores; rows
    without doc_id have no identity to decide on and stay if they hold a letter.
    """
    prototypes = fit_prototypes(docs.where(~held_out()))
    verdict = predict_language(docs, prototypes)
    passed = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)
    if languages is not None:
        passed &= F.col("lang_pred").isin(languages)
    good = verdict.where(passed & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.join(good, "doc_id", "left_semi").select(*docs.columns)
    unknown = docs.where(F.col("doc_id").isNull() & F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\p{L}")))
    return known.unionByName(unknown)
