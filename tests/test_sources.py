"""Readers, writers, edges and streams."""

import json
import time

from scriptorium.sources import edges, io
from scriptorium.streaming.incremental import run_increment


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n', encoding="utf-8")
    got = io.read_jsonl(spark, str(p), "a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, "é"), (2, None)]
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_documents_and_csv(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"k1": {"a": 1},\n "k2": {"a": 2}}')
    assert sorted((r.key, r.value.a) for r in io.read_json_map(spark, str(tmp_path / "m.json"), "struct<a:int>").collect()) == [("k1", 1), ("k2", 2)]
    (tmp_path / "c.csv").write_text('id,t\n1,"a ""q""\nb"\n')
    assert io.read_csv(spark, str(tmp_path / "c.csv"), "id int, t string").first().t == 'a "q"\nb'


def test_env(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\n\nA=1=2\nB\n C = x\n")
    assert sorted(tuple(r) for r in io.read_env(spark, str(tmp_path / ".env")).collect()) == [("A", "1=2"), ("C", "x")]


def test_retries_and_pages():
    waits, tries = [], []

    def call():
        tries.append(1)
        raise OSError("x")

    try:
        io.retried(call, sleep=waits.append)
    except OSError:
        pass
    assert (len(tries), waits) == (3, [2, 5])
    assert len(list(io.paged(lambda p: (["r"] * 30, 1000)))) == 150
    assert len(list(io.paged(lambda p: (["r"] * 30, 45) if p == 1 else (["r"] * 15, 45)))) == 45


def test_update_and_resolve(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(1, None, "n")], "id int, v string, w string")
    assert sorted(tuple(r) for r in io.update_by_key(a, new, "id").collect()) == [(1, "x", "n"), (2, "y", "k")]
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, o int, org string")
    found, failed = io.resolve_first(a.select("id"), hits, "id", "o")
    assert [(r.id, r.org) for r in found.collect()] == [(1, "a")] and [r.id for r in failed.collect()] == [2]


def test_edges(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three")], "id int, t string")
    cache = spark.createDataFrame([(1, 2, 1, "ok"), (3, -1, -1, "err")], "id int, grounded int, natural int, reason string")
    got = {r.id: (r.grounded, r.natural) for r in edges.judge(rows.where("t <> 'bad'"), cache, "id", "t", lambda t: (1, 0, t)).collect()}
    assert got == {1: (2, 1), 3: (1, 0)}
    made = edges.generate_rows(rows.where("t <> 'bad'"), lambda t: [{"q": t}, {"q": t + "!"}], "t", ["q"], ["id"])
    assert sorted((r.id, r.q) for r in made.collect()) == [(1, "one"), (1, "one!"), (3, "three"), (3, "three!")]
    vec = edges.embed(rows, "id", "t", lambda ts: [[3.0, 4.0] for _ in ts]).first().embedding
    assert [round(x, 4) for x in vec] == [0.6, 0.8]


def test_increment(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "id string, v int", "id", lambda df: df, str(tmp_path / "out"), str(tmp_path / "ck"))
    for n, ids in enumerate((["a", "b"], ["b", "c"])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": n}) for i in ids))
        run_increment(*args).awaitTermination()
        time.sleep(0.1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
