"""Near-duplicate documents by MinHash with tensored banding.

A document's signature is split into small collections of ``rows`` min-hashes.
A table key combines a pair of collections, so ``collections`` of them give
collections * (collections - 1) / 2 tables of 2 * rows min-hashes each, where
separate tables would need the square of that work. Documents that share a
table key are candidates; candidates are confirmed on their full shingle sets.

Copies (equal sets) first collapse to a class. In each bucket of a table every
member is compared with a pivot, the member that shares most collections with
others; the links found so join classes to components. Members that their pivot's
component doesn't hold are then compared with all members of the pivot's group
that lie in other components, in blocks of a bounded size whose tasks return the
links alone. So no candidate link is lost, no pairs are written out, and a group
of near copies costs about one comparison a member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .bitmap import build_bitmap, keep_listed
from .components import connected_components
from .workdir import discard, materialize, small_batches

SIGNATURE = "doc_id long, n_shingles long, digest string, parts array<long>"


def _signer(shingle: int, rows: int, collections: int):
    def sign(batches):
        word = tb.whitespace_words()
        random = np.random.default_rng(7)
        flip = random.integers(0, 1 << 63, rows * collections, dtype=np.uint64)
        odd = random.integers(0, 1 << 63, rows * collections, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in tb.text_slices(texts):
                sets = tb.shingle_sets(texts.slice(lo, hi - lo), shingle, word)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                parts = np.zeros((len(sets), collections), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for c in range(collections):
                        h = np.full(len(full), np.uint64(c + 1))
                        for k in range(c * rows, (c + 1) * rows):
                            h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ flip[k]) * odd[k], at))
                        parts[full, c] = h
                lists = [parts[i].view(np.int64) if n else np.empty(0, np.int64) for i, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "parts"],
                )

    return sign


def _set_maker(shingle: int):
    def make(batches):
        word = tb.whitespace_words()
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi in tb.text_slices(texts):
                sets = tb.shingle_sets(texts.slice(lo, hi - lo), shingle, word)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "grams"]
                )

    return make


def full_sets(docs: DataFrame, listed: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, grams): the sorted distinct shingle hashes of listed documents (and a few others), made once a document."""
    texts = keep_listed(docs.select("doc_id", "text"), build_bitmap(listed, ["doc_id"]), [F.col("doc_id")])
    return materialize(texts.mapInArrow(_set_maker(shingle), "doc_id long, grams array<long>"), "sets")


def confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").withColumn("n", F.size(F.array_intersect("ga", "gb")))
    return both.where((F.col("n") > 0) & (100 * F.col("n") >= percent * (F.size("ga") + F.size("gb") - F.col("n")))).select("a", "b")


def _block_comparer(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        ids, comps = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        grams = table.column("grams").combine_chunks()
        bounds, flat_all = np.asarray(grams.offsets), np.asarray(grams.values)
        inner, outside = np.flatnonzero(~outer), np.flatnonzero(outer)
        links: list[tuple[int, int]] = []
        if len(inner) and len(outside):
            sizes = (bounds[1:] - bounds[:-1])[inner].astype(np.int64)
            flat = np.concatenate([flat_all[bounds[i] : bounds[i + 1]] for i in inner])
            owner = np.repeat(np.arange(len(inner)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for x in outside:
                mine = flat_all[bounds[x] : bounds[x + 1]]
                lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(inner))
                near = (100 * both >= percent * (len(mine) + sizes - both)) & (both > 0) & (comps[inner] != comps[x])
                links += [(max(int(ids[x]), int(y)), min(int(ids[x]), int(y))) for y in ids[inner[near]]]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def compare_groups(sets: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between members(pivot, doc_id, component, pivot_component, n_shingles) of a group in different components.

    Only members outside their pivot's component can have links that aren't known
    yet. They are dealt to rows and the group's members to columns of a grid whose
    cells hold about ``block`` shingles of each, so a group with few such members
    is sent to one row of cells: its work is linear in its members.
    """
    outside = F.col("component") != F.col("pivot_component")
    groups = members.groupBy("pivot").agg(
        F.count("*").alias("n"), F.count_if(outside).alias("open"), F.ceil(F.sum("n_shingles") / block).cast("int").alias("wide"),
        F.ceil(F.sum(F.when(outside, F.col("n_shingles"))) / block).cast("int").alias("tall"),
    )
    groups = materialize(groups.where("n > 1 AND open > 0").select("pivot", "wide", "tall"), "grids")
    split = members.join(groups, "pivot")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    rows = split.where(outside).select("pivot", "doc_id", "component", F.lit(True).alias("outer"), F.pmod(F.hash("doc_id"), "tall").alias("i"), every("wide").alias("j"))
    rows = rows.unionByName(split.select("pivot", "doc_id", "component", F.lit(False).alias("outer"), F.pmod(F.hash("doc_id"), "wide").alias("j"), every("tall").alias("i")))
    cells = rows.join(sets, "doc_id").select("pivot", "i", "j", "doc_id", "component", "outer", "grams")
    found = materialize(cells.groupBy("pivot", "i", "j").applyInArrow(_block_comparer(percent), "a long, b long"), "links")
    discard(groups)
    return found


def minhash_dedup(
    docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 3, collections: int = 16, block: int = 64_000
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    Words are runs of other than ASCII white space, A-Z taken as a-z. A set holds
    the distinct shingles of ``shingle`` words; a shorter text is one shingle.
    Two documents are linked if 100 * intersection >= percent * union; component_id
    is the smallest doc_id reachable. A pair at 0.8 shares no table key with
    probability 0.0002 by the defaults.

    Null, empty or blank texts have an empty set and are linked with nothing. A row
    without doc_id is kept, with a null component_id. Rows that repeat a doc_id
    belong to one component, since they carry one identity. Other columns are
    ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signer(shingle, rows, collections), SIGNATURE), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # Classes of equal sets, each with the signature of its smallest id.
    classes = materialize(
        full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("parts", "doc_id").alias("parts"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")),
        "classes",
    )
    # As tables, what is joined has an exchange of its own: adaptive execution can split the rows of a hot key.
    several = classes.where("copies > 1").select("digest", F.col("doc_id").alias("b"))
    copies = full.select(F.col("doc_id").alias("a"), "digest").join(several, "digest").where("a <> b").select("a", "b").distinct()
    links = materialize(copies, "copies")
    leaders = classes

    # Collections that some other class shares; only pairs of those can make a shared table key.
    exploded = leaders.select("doc_id", F.posexplode("parts").alias("slot", "part"))
    shared = exploded.groupBy("slot", "part").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "shared")
    buckets = materialize(
        exploded.join(shared, ["slot", "part"])
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("slot", "part"))).alias("p"), F.sum("n").alias("weight"))
        .where("size(p) > 1")
        .select(
            "doc_id", "weight",
            F.explode(F.expr("flatten(transform(sequence(1, size(p) - 1), i -> transform(sequence(i + 1, size(p)), j -> xxhash64(p[i - 1], p[j - 1]))))")).alias("key"),
        ),
        "buckets",
    )
    tops = buckets.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("top"), F.count("*").alias("n")).where("n > 1")
    pivots = materialize(tops.select("key", (-F.col("top.minus")).alias("pivot")), "pivots")
    groups = materialize(buckets.join(pivots, "key").where("doc_id <> pivot").select("pivot", "doc_id").distinct(), "groups")
    used = [classes, shared, buckets, pivots, groups, links]
    components = None
    if not groups.isEmpty():
        pairs = groups.select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b")).distinct()
        sets = full_sets(docs, groups.select("doc_id").union(groups.select("pivot")).distinct(), shingle)
        found = materialize(confirm(sets, pairs, percent), "links")
        links = links.unionByName(found)
        first = materialize(connected_components(links, "a", "b"), "components")
        known = first.select(F.col("node").alias("doc_id"), "component")
        members = (
            groups.join(known, "doc_id", "left")
            .join(known.select(F.col("doc_id").alias("pivot"), F.col("component").alias("pivot_component")), "pivot", "left")
            .join(classes.select("doc_id", "n_shingles"), "doc_id")
            .select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("pivot_component", "pivot").alias("pivot_component"), "n_shingles")
        )
        members = materialize(members, "members")
        more = compare_groups(sets, members, percent, block)
        used += [found, first, members, more, sets]
        if not more.isEmpty():
            links = links.unionByName(more)
        else:
            components = first
    if components is None:
        components = materialize(connected_components(links, "a", "b"), "components")
    out = signed.select("doc_id", "n_shingles").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    result = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
    discard(*[t for t in used if t is not components])
    return result


#: The same components by a join on all shingles, for the query's two-word shingles at 80 percent.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
