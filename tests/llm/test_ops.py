"""Each operator against a brute-force version or a held-out check, and on the edge cases that all of them define."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import decontaminate as decon
from scriptorium.llm.bpe_codec import TextDecoder, Transducer, WordCodec, bpe_codec
from scriptorium.llm.chat_format import format_chats
from scriptorium.llm.decontaminate import decontaminate
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.language_id import keep_known_language, language_id
from scriptorium.llm.lm_score import lm_score
from scriptorium.llm.minhash_dedup import minhash_dedup
from scriptorium.llm.substring_dedup import compact_windows, substring_dedup
from scriptorium.llm.token_counts import PrefixCounter, longest_prefix_within, token_counts
from scriptorium.llm.toxicity import fit_toxicity, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Columns whose names the operators use inside.
CLASH = ["n", "words", "component", "norm", "key", "value", "rank", "pos", "token", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "er", "in", "Qu", "é", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


EDGES = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, "  \t\n", None, "s"), (4, "One", "en", None), (5, "one", "en", "s"), (6, passage(1, 80), "en", "s"), (7, passage(1, 80), "fr", "s"),
    (8, passage(1, 80).replace(" ", "\n\n"), "en", "s"), (9, passage(2, 20000), "en", "s"), (10, "x" * 30000, "en", "s"), (11, passage(1, 78) + " zz", "en", "s"), (11, passage(1, 78) + " zz", "en", "s"),
    (None, passage(3, 30), "en", "s"), (12, "12 345 !!", "en", "s"), (13, passage(4, 60) + " " + passage(5, 70), "fr", "s"), (14, passage(6, 55) + " " + passage(5, 70), "fr", "s"),
]


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def components(texts, size, percent):
    sets = {k: {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := words(t)) else set() for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def test_minhash(docs, edges, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, sizes = components(texts, 2, 80)
    got = by_id(minhash_dedup(docs, shingle=2))
    assert {k: r.component_id for k, r in got.items()} == want and {k: r.n_shingles for k, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    rows = minhash_dedup(edges).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) and got[None].component_id is None and got[None].kept
    assert [got[k].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8, 11)] == [1, 2, 3, 4, 4, 6, 6, 6, 6] and got[1].n_shingles == 0 and got[5].n_shingles == 1
    assert minhash_dedup(empty).count() == 0


def test_minhash_finds_what_the_pivot_is_too_far_from(spark):
    """A group of copies with ever more edits: links beside the pivot's must be found too."""
    r = random.Random(5)
    base = passage(9, 150).split()
    rows = []
    for k in range(60):
        w = list(base)
        for i in r.sample(range(150), r.choice([2, 5, 8, 11, 14])):
            w[i] = f"edit{r.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    got = by_id(minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2))
    assert {k: x.component_id for k, x in got.items()} == components(dict(rows), 2, 80)[0]


def test_exact(edges, empty):
    rows = exact_dedup(edges, hash_all=True).collect()
    groups = collections.defaultdict(list)
    for k, t, *_ in EDGES:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(k)
    for r in rows:
        g = next((t, v) for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)[1]
        assert r.group_size == len(g) and r.keep_id == min((k for k in g if k is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    lazily = {r.doc_id: r.text_sha256 for r in exact_dedup(edges).collect()}
    assert lazily[6] is not None and len(rows) == len(EDGES) and exact_dedup(empty).count() == 0


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 5, "user", "hi"),
        (5, 0, "user", "same"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "x"), (7, None, None, None), (8, 0, "user", "a<|im_end|>b"), (9, 1, "user", "t1"), (9, 1, "system", "t0"),
    ] + [(10, i, "user", f"turn {i}") for i in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "place", "h1", "n_turns")})
    got = collections.defaultdict(dict)
    for r in format_chats(df).collect():
        got[r.conv_id][r.part] = r
    assert sorted(got) == [2, 3, 5, 7, 8, 9, 10]
    assert got[2][0].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and got[2][0].n_turns == 3
    assert "a<im_end|>b" in got[8][0].rendered and got[9][0].rendered.index("t0") < got[9][0].rendered.index("t1")
    assert sorted(got[10]) == [0, 1, 2] and got[10][0].n_turns == 2500 and got[10][2].rendered.startswith("<|im_start|>user\nturn 2048<")
    assert format_chats(df.limit(0)).count() == 0


def test_token_counts(docs, edges, empty):
    lib = Tokenizer.from_file(BYTE)
    for df in (docs, edges.where("doc_id IS NOT NULL")):
        for r in df.join(token_counts(df, BYTE), "doc_id").collect():
            assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert token_counts(empty, BYTE).count() == 0 and token_counts(edges, BYTE).count() == len(EDGES)


def test_every_prefix(spark):
    lib, program, r = Tokenizer.from_file(BYTE), PrefixCounter(BYTE), random.Random(3)
    parts = ["a", "the", "'re", "'s", "'", " ", "  ", "\n", "\t", "1", "é", "..", "　", "<|endoftext|>", "<|endo", "日本", "😀", "'V", "İ"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert program.every_prefix(text).tolist() == want
        n, at, upto = program.records([text])
        assert n[0] == want[-1] and all(want[a] == u for a, u in zip(at[0], upto[0])) and (not text or at[0][-1] == len(text))
    df = spark.createDataFrame([(1, "hello wonderful tokens")], "doc_id long, text string")
    cut = longest_prefix_within(token_counts(df, BYTE, store="all"), 2).first()
    assert cut.cut_tokens == 2 and len(lib.encode("hello wonderful tokens"[: cut.cut_end]).ids) == 2


def test_bpe(docs, edges, empty):
    lib = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, edges.where("doc_id IS NOT NULL")):
        for r in df.join(bpe_codec(df, WORD), "doc_id").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert bpe_codec(empty, WORD).count() == 0


def test_transducer_and_decoder():
    lib, program, r = Tokenizer.from_file(WORD), WordCodec(WORD), random.Random(4)
    for _ in range(6):
        word = "".join(r.choice(["a", "e", "th", "in", "ing", "er", "s", "é"]) for _ in range(500))
        data = word.encode()
        run = Transducer(program.table)
        out, most = [], 0
        for s in [*program.inner[list(data[:-1])], program.final[data[-1]]]:
            out += run.push([s])
            most = max(most, len(run.held))
        assert [program.ids[t] for t in out + run.finish()] == lib.encode(word, add_special_tokens=False).ids and most <= run.window
    assert program.to_text(program.encode_ids("Été  à <|endoftext|> l'eau 😀")) == "été à <|endoftext|>l ' eau 😀"
    machine = TextDecoder()
    assert "".join([machine.push(bytes([b])) for b in "aé日😀".encode()]) + machine.finish() == "aé日😀"
    assert TextDecoder().push(b"\xffa") == "�a"


def test_language(spark, docs, edges, empty):
    got = docs.join(language_id(docs), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    got = by_id(language_id(edges))
    assert [got[k].lang_pred for k in (1, 2, 3, 12)] == ["und"] * 4 and got[1].score == 0 and got[6].lang_pred in ("en", "fr")
    assert language_id(empty).count() == 0 and {r.lang_pred for r in language_id(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = keep_known_language(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8, 9, 10, 11, 11, 13, 14]


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    grams = collections.defaultdict(set)
    for k, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams[tuple(w[i : i + n])].add(k)
    out = {}
    for k, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [decon.BROADCAST_BYTES, -1])
def test_decontamination(spark, edges, empty, monkeypatch, most):
    """Also with an index that is too large for a broadcast; rows of one doc_id, or of none, count together."""
    monkeypatch.setattr(decon, "BROADCAST_BYTES", most)
    p = passage(1, 80)
    items = [(1, " ".join(p.split()[10:30])), (2, "one"), (3, None), (4, "!!"), (5, " ".join(p.split()[10:30]).upper()), (11, "x" * 30000), (12, "zz"), (20, "ÉTÉ one"), (21, "345 12"), (22, "ΑΣ Β one two"), (23, "a b a b")]
    data = [r[:2] for r in EDGES] + [
        (30, "été One, ÉTÉ one; 345, 12"), (31, p[:100] + "." + p[100:]), (32, "K one"), (33, "ΑΣ'Β one two"), (34, "ΑΣ.Β one two"), (35, "ΑΣ Β one two"), (36, "a b a b a b"), (36, "zz"), (None, "ΑΣ.Β ONE Two"), (None, None),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    got = {r.doc_id: r for r in decontaminate(df, table).collect()}
    once = [k for k, n in collections.Counter(k for k, _ in data).items() if n == 1]
    want = brute_contamination([r for r in data if r[0] in once], items)
    assert {k: tuple(got[k])[1:] for k in once} == want and len(got) == len({k for k, _ in data})
    for k in {None, 11, 36}:
        rows = [brute_contamination([r], items)[k] for r in data if r[0] == k]
        assert got[k].n_words == max(r[0] for r in rows) and got[k].contaminated == any(r[4] for r in rows) and got[k].n_hit >= max(r[1] for r in rows)
    assert [got[k].n_hit for k in (33, 34, 35)] == [4, 4, 4]
    assert decontaminate(empty, table).count() == 0 and not any(r.contaminated for r in decontaminate(df, table.limit(0)).collect())


def test_lm(docs, edges, empty):
    for df in (docs, edges.where("doc_id IS NOT NULL AND doc_id <> 11")):
        texts = {r.doc_id: [*words(r.text), None] for r in df.collect()}
        counts = collections.Counter()
        for k, w in texts.items():
            if zlib.crc32(str(k).encode()) % 10:
                counts.update(w)
        n, v = sum(counts.values()), len(counts)
        for k, r in by_id(lm_score(df)).items():
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in texts[k])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(texts[k]), sum(counts[w] > 0 for w in texts[k]), n) and abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and r.score < 0
    held = [r for r in lm_score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score(empty).count() == 0


def test_lm_score_by_formula(spark):
    """score as the sum over tokens of log10 P(class | context) + log10 P(word | class), word by word."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.llm import lm_score as lm

    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["the", "a", "dog", "cat", "runs", "Sits", "é", "zz"]) + r.choice(["", "", "s"]) for _ in range(r.randint(0, 12)))) for k in range(60)] + [(60, None), (61, "unseen thing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t or "" for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    token = lambda w: int(lm._tokens(pa.array([w]))[0][0]) if w else int(lm.END)
    coded = lambda t: [token(w) for w in words(t)] + [int(lm.END)]
    counts, contexts = collections.Counter(), collections.Counter()

    def before(tokens, i):
        near = tokens[i - 1] % (1 << lm.NEAR_BITS) if i else 0
        return near + ((tokens[i - 2] % (1 << lm.FAR_BITS) if i > 1 else 0) << lm.NEAR_BITS)

    for t in train:
        tokens = coded(t)
        counts.update(tokens)
        contexts.update((before(tokens, i), x % lm.CLASSES) for i, x in enumerate(tokens))
    table = spark.createDataFrame([(c * lm.CLASSES + k, n) for (c, k), n in contexts.items()], "key long, n long")
    weights = lm.train_classes(table)

    def class_chances(context):
        logits = [sum(weights[f, k] for f in lm._features(np.array([context]))[0]) for k in range(lm.CLASSES)]
        return [math.exp(x) / sum(map(math.exp, logits)) for x in logits]

    total = sum(n * math.log(class_chances(c)[k]) for (c, k), n in contexts.items())
    assert total > 0.8 * sum(contexts.values()) * math.log(1 / lm.CLASSES)  # the steps raise the likelihood
    got = by_id(lm.lm_score(df))
    for k, t in rows:
        tokens, want = coded(t), 0.0
        for i, x in enumerate(tokens):
            mine = [(w, n) for w, n in counts.items() if w % lm.CLASSES == x % lm.CLASSES]
            want += math.log10(class_chances(before(tokens, i))[x % lm.CLASSES])
            want += math.log10((counts[x] + 0.1) / (sum(n for _, n in mine) + 0.1 * (len(mine) + 1)))
        assert abs(got[k].score - want) < 1e-4 * max(1, abs(want)), (k, got[k].score, want)


def test_windows():
    import numpy as np

    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 62, 400, dtype=np.uint64) << np.uint64(1)
    ranges = [(0, 150), (150, 152), (152, 400)]
    got = sorted(zip(*(x.tolist() for x in compact_windows(h, np.array([a for a, _ in ranges]), np.array([b for _, b in ranges]), 20))))
    want = set()
    for a, b in ranges:
        for c in range(a, b):
            lo, hi = c, c
            while lo > a and h[lo - 1] > h[c]:
                lo -= 1
            while hi + 1 < b and h[hi + 1] > h[c]:
                hi += 1
            if hi - lo + 1 >= 20:
                want.add((lo, c, hi))
    assert got == sorted(want)
    assert len(compact_windows(np.zeros(5000, np.uint64), np.array([0]), np.array([5000]), 46)[0]) > 0


def test_substring(spark, docs, edges, empty):
    spans = collections.defaultdict(list)
    for r in substring_dedup(docs).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    seen = collections.defaultdict(set)
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    for k, w in texts.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    for k, w in texts.items():
        for i in range(len(w) - 49):
            assert len(seen[tuple(w[i : i + 50])]) < 2 or any(s <= i and i + 50 <= e for s, e in spans[k])
    got = {r.doc_id: r for r in substring_dedup(edges).collect()}
    assert sorted(got) == [6, 7, 8, 11, 13, 14] and (got[13].start_word, got[13].end_word, got[13].partner_id) == (60, 130, 14) and got[14].n_words == 70
    assert substring_dedup(empty).count() == 0


def spans_of(df):
    spans = collections.defaultdict(list)
    for r in substring_dedup(df).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    return spans


def test_substring_variants(spark):
    """Texts with one edit each are similar to the unedited one alone, which isn't the smallest doc_id."""
    rows = []
    for g in range(6):
        text = [f"g{g}w{i}" for i in range(56)]
        for v in range(9):
            edited = [*text[: 5 * v + 7], f"g{g}v{v}", *text[5 * v + 8 :]]
            rows.append((100 * g + v, " ".join([*(f"a{g}x{v}y{i}" for i in range(40)), *edited, *(f"b{g}x{v}y{i}" for i in range(40))])))
        rows.append((100 * g + 50, " ".join(text)))
    spans = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    missed = [k for k, _ in rows if not spans[k]]
    assert len(missed) <= 1, missed


def test_substring_copies_of_variant(spark):
    """Equal variants that their key's smallest document doesn't explain are all reported."""
    text = [f"w{i}" for i in range(56)]
    edit = lambda at: [*text[:at], f"v{at}", *text[at + 1 :]]
    rows = [(0, " ".join(edit(12)))] + [(k, " ".join([*(f"a{k}y{i}" for i in range(40)), *edit(40), *(f"b{k}y{i}" for i in range(40))])) for k in range(1, 6)]
    spans = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(spans[k] for k in range(1, 6)), spans


def test_substring_inserted_word(spark):
    """One word put into the middle leaves both halves too short for a passage of their own."""
    rows = []
    for g, n in enumerate((60, 80, 95) * 3):
        text = [f"g{g}w{i}" for i in range(n)]
        for v, body in enumerate((text, [*text[: n // 2], "more", *text[n // 2 :]])):
            rows.append((10 * g + v, " ".join([*(f"a{g}x{v}y{i}" for i in range(30)), *body, *(f"b{g}x{v}y{i}" for i in range(30))])))
    spans = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    wide = [k for k, t in rows if [(s, e) for s, e in spans[k]] != [(30, len(t.split()) - 30)]]
    assert len(wide) <= 2, (wide, spans)


def test_substring_twice_in_smallest(spark):
    """A passage that stands twice in the smallest document is reported for both places."""
    rows = []
    for g in range(12):
        text = " ".join(f"g{g}w{i}" for i in range(60))
        fill = [" ".join(f"{part}{g}x{i}" for i in range(30)) for part in "abcde"]
        rows.append((10 * g, " ".join([fill[0], text, fill[1], text, fill[2]])))
        rows.append((10 * g + 1, " ".join([fill[3], text, fill[4]])))
    spans = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(sorted(spans[10 * g]) == [(30, 90), (120, 180)] and spans[10 * g + 1] == [(30, 90)] for g in range(12)), spans


def sentence_score(sentence, model, bias):
    """Logistic model of a sentence's words and word beginnings, one by one."""
    import pyarrow as pa

    from scriptorium.llm import toxicity as tx

    buckets = set()
    for word in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", sentence):
        buckets |= set(tx._sentences(pa.array([word]), tx.BUCKETS)[0].tolist())
    return 1 / (1 + math.exp(-(sum(model.get(b, 0.0) for b in buckets) + bias)))


def test_toxicity_scores():
    """Gradient steps and scores against the formulas, sentence by sentence in plain Python."""
    import numpy as np

    from scriptorium.llm.toxicity import gradient_steps

    labels, doc, count = np.array([1.0, 0.0, 1.0]), np.array([0, 0, 1, 1, 2]), np.array([1.0, 3.0, 2.0, 1.0, 4.0])
    features, guess = [[0], [], [1], [], [0, 1]], np.array([2.0, 0.5])

    def likelihood(w):
        none = [1.0] * 3
        for d, n, f in zip(doc, count, features):
            none[d] *= (1 - 1 / (1 + math.exp(-(sum(w[i] for i in f) + w[2])))) ** n
        return sum(math.log(1 - x if t else x) for x, t in zip(none, labels)) - 0.01 * sum((a - b) ** 2 for a, b in zip(w, guess))

    w, bias = gradient_steps(labels, doc, count, features, guess, 400)
    now = [*w, bias]
    assert likelihood(now) > likelihood([2.0, 0.5, -6.0])
    for i in range(3):
        for move in (-0.05, 0.05):
            other = list(now)
            other[i] += move
            assert likelihood(other) < likelihood(now) + 1e-3


def test_toxicity(spark, edges, empty):
    r = random.Random(2)
    bad = ["scum", "idiot"]
    rows, labels = [], []
    for k in range(400):
        sentences = [passage(1000 + k * 9 + i, 8) for i in range(6)]
        toxic = k % 3 == 0
        if toxic:
            at = r.randrange(6)
            sentences[at] = sentences[at] + " you " + r.choice(bad)
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = got_docs = by_id(toxicity(docs, marks))
    wrong = [k for k, _, t in labels if got[k].predicted != t]
    assert len(wrong) <= 8 and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    for k, t in rows[:30:3]:
        assert any(b in t.split(".")[got[k].worst_sentence] for b in bad)
    got = toxicity(edges, marks).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got) and all(r.predicted == (r.score >= 0.3) for r in got)
    several = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity(edges, several).collect()) and len(toxicity(edges, several).collect()) == len(EDGES)
    model, bias = fit_toxicity(docs, marks)
    plain = {k: 1 - math.prod(1 - sentence_score(t, model, bias) for t in re.split("[.!?\n]", text) if re.search("[0-9A-Za-z\x80-\U0010ffff]", t)) for k, text in rows[:60]}
    assert all(abs(plain[k] - got_docs[k].score) < 1e-9 for k in plain)
    assert toxicity(empty, marks).count() == 0 and max(r.score for r in toxicity(edges, marks.limit(0)).collect()) < 1e-6
