"""Rules on small literals, with results worked out by hand."""

import datetime
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.functions import cleaning, formats, tablefix
from tidemill.operators import changes, documents, fulltext, geo, index, metrics, neighbours, retrieve, sessions, substrings
from tidemill.plans import tables
from tidemill.sources import files, keyset, statements
from tidemill.storage import cut, work_folder
from tidemill.streaming import changesets, expiry, feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "shown"), [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1024**4, "1.0 TB"), (1024**5 * 3, "3.0 PB")])
def test_sizes(spark, n, shown):
    assert one(spark, formats.size_text(F.lit(n).cast("long"))) == shown


@pytest.mark.parametrize(("s", "shown"), [(0.5, "500ms"), (1.0, "1.0s"), (59.5, "59.5s"), (61.0, "1m 1s"), (3599.0, "59m 59s"), (3661.0, "1h 1m")])
def test_durations(spark, s, shown):
    assert one(spark, formats.duration_text(F.lit(s))) == shown


def test_query_cost(spark):
    got = lambda q, n: tuple(one(spark, c) for c in formats.cost_of_query(F.lit(q), F.lit(n)))
    assert got("select a from t order by a", 1) == ("high", ["add a limit"])
    assert got("select a from t join u order by a", 1)[0] == "medium"  # the later rule overrules
    assert got("select distinct a from t join u", 10**6)[0] == "high"
    assert got("select * from t limit 1", 1) == ("low", ["name the columns"])


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "k int, s string, v int")
    keys = lambda w: [r["k"] for r in documents.find(df, w, sort=["k"]).collect()]
    assert keys({"s": {"$ne": "a"}}) == [2, 3]
    assert keys({"v": {"$exists": False}}) == keys({"v": None}) == [1]
    assert keys({"s": {"$nin": ["b"]}}) == [1, 3]
    assert keys({"$not": {"v": {"$gt": 5}}}) == [1, 2]
    assert keys({"$and": [{"v": {"$gte": 5}}, {"v": {"$lte": 5}}]}) == [2]
    with pytest.raises(ValueError):
        documents.condition({"v": {"$near": 1}})
    assert [r["k"] for r in documents.find(df, sort=["-v"]).collect()] == [3, 2, 1]


def test_pipeline_stages(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "k int, tags array<string>")
    got = documents.pipeline(df, [{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}, "ks": {"$addToSet": "$k"}}}, {"$sort": {"_id": 1}}])
    assert [tuple(r) for r in got.collect()] == [("x", 2, [1, 2]), ("y", 1, [1])]
    assert documents.pipeline(df, [{"$group": {"_id": None, "most": {"$max": "$k"}}}]).first()["most"] == 2
    with pytest.raises(ValueError):
        documents.pipeline(df, [{"$merge": {}}])


def test_filters_in_arrays_and_documents(spark):
    rows = [(1, [("a", 3, ["x"]), ("b", 9, ["y", "z"])], [80, 90], ("Ulm", [1, 2])), (2, [("a", 9, [])], [70], ("Bonn", None)), (3, [], [], None), (4, None, None, ("Ulm", [2]))]
    df = spark.createDataFrame(rows, "id int, items array<struct<name:string,qty:int,tags:array<string>>>, scores array<int>, home struct<city:string,codes:array<int>>")
    ids = lambda spec: sorted(r["id"] for r in documents.find(df, spec).collect())
    assert ids({"items": {"$elemMatch": {"name": "a", "qty": {"$gt": 5}}}}) == [2]
    assert ids({"items.qty": {"$gt": 5}, "items.name": "b"}) == [1] and ids({"items.qty": 9}) == [1, 2] and ids({"items.0.qty": 3}) == [1]
    assert ids({"items.tags": "z"}) == [1] and ids({"home.city": "Ulm"}) == [1, 4] and ids({"home.codes": {"$in": [2, 7]}}) == [1, 4]
    assert ids({"scores": {"$elemMatch": {"$gte": 80, "$lt": 85}}}) == [1] and ids({"scores": {"$gte": 80, "$lt": 75}}) == []
    assert ids({"scores": 70}) == [2] and ids({"scores": [80, 90]}) == [1] and ids({"scores": {"$all": [90, 80]}}) == [1] and ids({"scores": {"$size": 0}}) == [3]
    assert ids({"scores": {"$ne": 70}}) == [1, 3, 4] and ids({"scores": {"$nin": [70, 80]}}) == [3, 4] and ids({"$nor": [{"id": 1}, {"scores": 70}]}) == [3, 4]
    for bad in ({"id": {"$elemMatch": {"$gt": 1}}}, {"scores": {"$near": 1}}, {"items.none": 1}):
        with pytest.raises(ValueError):
            documents.find(df, bad)


def test_unwind_bucket_and_facets(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 5.0), (2, [], 15.0), (3, None, 25.0), (4, ["c"], None)], "id int, tags array<string>, v double")
    run = lambda *stages: sorted((tuple(r) for r in documents.pipeline(df, list(stages)).collect()), key=repr)
    assert run({"$unwind": "$tags"}, {"$project": {"id": 1, "tags": 1}}) == [(1, "a"), (1, "b"), (4, "c")]
    assert run({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "at"}}, {"$project": {"id": 1, "tags": 1, "at": 1}}) == [(1, "a", 0), (1, "b", 1), (2, None, None), (3, None, None), (4, "c", 0)]
    assert run({"$unwind": "$v"}, {"$project": {"id": 1}}) == [(1,), (2,), (3,)]
    assert run({"$bucket": {"groupBy": "$v", "boundaries": [0, 10, 20], "default": "other"}}) == [("0", 1), ("10", 1), ("other", 2)]
    assert run({"$match": {"v": {"$lt": 20}}}, {"$bucket": {"groupBy": "$v", "boundaries": [0, 10, 20], "output": {"top": {"$max": "$v"}}}}) == [(0, 5.0), (10, 15.0)]
    with pytest.raises(Exception, match="no bucket for 25"):
        run({"$match": {"v": {"$gt": 20}}}, {"$bucket": {"groupBy": "$v", "boundaries": [0, 10, 20]}})
    assert run({"$facet": {"n": [{"$count": "n"}], "ids": [{"$match": {"v": {"$lt": 10}}}, {"$project": {"id": 1}}]}}) == [("ids", '{"id":1}'), ("n", '{"n":4}')]
    assert run({"$project": {"x": {"a": "$id", "b": "$v"}}}, {"$replaceRoot": {"newRoot": "$x"}}, {"$unset": "b"}) == [(1,), (2,), (3,), (4,)]
    for bad in ({"$unwind": {"path": "$tags", "odd": 1}}, {"$bucket": {"groupBy": "$v", "boundaries": [3, 1]}}, {"$merge": "x"}):
        with pytest.raises(ValueError):
            run(bad)


def test_lookup_null_matches_null(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([(None, "n"), (2, "two")], "f int, s string")
    assert {r["k"]: len(r["m"]) for r in documents.lookup(a, b, "k", "f", "m").collect()} == {1: 0, None: 1}


def test_json_safe_and_copy(spark):
    df = spark.sql("select named_struct('at', timestamp_ntz'2024-01-02 03:04:05', 'in', array(named_struct('t', timestamp_ntz'2024-01-01 00:00:00'))) as d, cast(1.5 as decimal(5,2)) as p, cast(null as string) as s")
    assert documents.json_safe(df).first()["d"].asDict(True) == {"at": "2024-01-02T03:04:05", "in": [{"t": "2024-01-01T00:00:00"}]}
    assert files.copy_ready(df, ["p", "s"]).first().asDict() == {"p": "1.50", "s": None}


def test_changes_in_order(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    ops = [(1, 1, "insert", "x"), (2, 1, "delete", None), (2, 2, "insert", "new"), (3, 1, "update", "c"), (4, 1, "update", "no"), (5, 1, "upsert", "u"), (5, 2, "delete", None), (6, 1, "insert", None)]
    got = changes.apply_changes(t, spark.createDataFrame(ops, "k int, seq int, op string, v string"), "k")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a"), (2, "new"), (3, "c"), (6, None)]
    inc = spark.createDataFrame([(1, "z", 1), (9, "p", 1), (9, "q", 2)], "k int, v string, seq int")
    assert {r["k"]: r["v"] for r in changes.insert_ignore(t, inc, "k", "seq").collect()} == {1: "a", 2: "b", 3: None, 9: "p"}
    up = changes.upsert(t, inc, "k", "seq")
    assert {r["k"]: r["v"] for r in up.collect()} == {1: "z", 2: "b", 3: None, 9: "q"}
    assert {r["k"]: r["v"] for r in changes.upsert(up, inc, "k", "seq").collect()} == {r["k"]: r["v"] for r in up.collect()}
    assert changes.delete_many(t, F.col("v") == "a").count() == 2
    assert tuple(changes.update_counts(t, F.col("k") <= 2, {"v": F.lit("a")}).first()) == (2, 1, 0)


def test_chunks(spark):
    text = " ".join(f"w{i}." if i % 7 == 6 else f"w{i}" for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    w = sorted(map(tuple, index.windows(docs, 100, 20).collect()))
    rebuilt = [x for d, k, t in w if d == 1 for x in (t.split() if k == 0 else t.split()[20:])]
    assert rebuilt == text.split() and {d for d, _, _ in w} == {1, 4}
    s = sorted(map(tuple, index.sentences(docs, 100, 20).collect()))
    assert all(len(t.split()) <= 100 for _, _, t in s) and {d for d, _, _ in s} == {1, 4}
    assert {x for _, _, t in s for x in t.split()} == set(text.split()) | {"one"}


def test_embedding(spark):
    docs = spark.createDataFrame([(1, 0, "a fine day"), (2, 0, None), (3, 0, "bad")], "doc_id long, chunk_id int, text string")
    v = np.array([r["vector"] for r in index.embed(docs, index.hash_embedder()).orderBy("doc_id").collect()])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1])

    def picky(texts):
        if "bad" in texts:
            raise ValueError("no")
        return np.ones((len(texts), 2))

    got = {r["doc_id"]: (r["vector"], r["error"]) for r in index.embed(docs, picky).collect()}
    assert got[3] == (None, "no") and got[1] == ([1.0, 1.0], None)


def test_hybrid_extremes(spark):
    s = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id long, id long, score double, rank int")
    k = spark.createDataFrame([(1, 11, 1.0, 1), (1, 12, 0.5, 2)], "query_id long, id long, score double, rank int")
    ids = lambda a: [r["id"] for r in retrieve.hybrid(s, k, 5, a).orderBy("rank").collect()]
    assert ids(1.0)[:2] == [10, 11] and ids(0.0)[:2] == [11, 12]


def test_keyword_index_gives_what_a_scan_gives(spark, monkeypatch):
    rng = np.random.default_rng(9)
    part = lambda n: "".join(rng.choice(list("abÄß.x😀"), n))
    texts = [(i, " ".join([*(part(int(rng.integers(1, 7))) for _ in range(int(rng.integers(0, 30)))), *["hot"] * (i % 3 > 0)])) for i in range(120)]
    texts += [(500, None), (501, ""), (502, " \n\t "), (None, "hot"), (503, "hot\u00a0x\x0bend"), (504, "long" * 5000 + "needle" + "y" * 5000)]
    asked = [(i, " ".join(part(int(rng.integers(1, 5))) for _ in range(6))) for i in range(30)]
    asked += [(100, "hot HOT ab"), (101, "needle"), (102, ""), (103, None), (104, " "), (105, "nowhere"), (106, "t\u00a0x x\x0bend"), (107, "gnee dlex ngne"), (108, "😀")]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    monkeypatch.setattr(substrings, "SHARD_TEXTS", 16)
    monkeypatch.setattr(substrings, "PART_SHARDS", 3)
    monkeypatch.setattr(substrings, "GATHERED", 50)
    monkeypatch.setattr(substrings, "COUNTED", 7)
    got = lambda df: sorted(map(tuple, df.collect()))
    built = substrings.build(t)
    want = got(retrieve.keyword(q, t.where("id is not null"), 5))
    assert got(substrings.search(q, built, 5)) == want and {r[0] for r in want} >= {100, 101, 106, 107}
    brute = []
    for i, query in asked:
        words = (query or "").lower().split(" ") if i != 106 else ["t\u00a0x", "x", "end"]
        words = [w for w in words if w]
        scores = sorted((-round(sum(w in text.lower() for w in words) / len(words), 6), j) for j, text in texts if text and j is not None and words)
        brute += [(i, j, -n, rank) for rank, (n, j) in enumerate(scores[:5], 1) if n]
    assert want == sorted(brute)
    monkeypatch.setattr(substrings, "TEXTS_AT_ONCE", 7)
    assert got(substrings.search(q, built, 5)) == want
    none = substrings.build(t.limit(0))
    assert got(substrings.search(q, none, 5)) == [] and got(substrings.search(q.limit(0), built, 5)) == []
    # rows that share an id are one text
    twice = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha")], "id long, text string")
    assert got(substrings.search(spark.createDataFrame([(1, "alp bet")], "query_id long, query string"), substrings.build(twice), 5)) == [(1, 1, 1.0, 1), (1, 2, 0.5, 2)]


def test_a_shard_of_the_keyword_index_is_gathered_in_one_pass(monkeypatch):
    """Words and short runs with their texts from rows shard by shard; rows that share an id are one text."""
    monkeypatch.setattr(substrings, "KEYS", 3)
    rows = [(0, 7, "ab abc\tab"), (0, 9, "b\x0bx😀"), (0, 7, "q"), (0, 8, ""), (4, 5, "ab"), (4, 2**40, "ab c")] + [(5, i, "hot" if i % 2 else "b") for i in range(20)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[a:b], strict=True)], ["shard", "id", "text"]) for a, b in ((0, 2), (2, 9), (9, 26))]
    got = [(r["key"], r["short"], r["shard"], tuple(sorted(r["ids"]))) for b in substrings.gather(iter(batches)) for r in b.to_pylist()]
    want = {}
    for shard, i, text in rows:
        for w in re.split(r"[ \t\x0b]", text):
            for key, short in [(w, False), *((w[a : a + n], True) for n in (1, 2) for a in range(len(w) - n + 1))]:
                if key:
                    want.setdefault((key, short, shard), set()).add(i)
    assert sorted(got) == sorted((*k, tuple(sorted(v))) for k, v in want.items())


def test_keyword_index_reads_little_for_few_words(spark, tmp_path):
    import shutil

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    built = substrings.build(docs, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "zq7")], "query_id long, query string")
    once = built.table("parts").where("not short and length(key) between 7 and 9").groupBy("key").count().orderBy("key").first()["key"]
    q = q.union(spark.createDataFrame([(2, once)], q.schema))
    want = sorted(map(tuple, substrings.search(q, built, 10).collect()))
    assert want == sorted(map(tuple, retrieve.keyword(q, docs, 10).collect())) and want
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "index" / "postings").rglob("*.parquet"))
    whole = size()
    found = substrings.matches(spark.createDataFrame([(0, "zq7"), (1, once)], "t long, term string"), built)
    needed = {r[0] for r in found.select(substrings._folder("key")).collect()}
    for folder in (tmp_path / "index" / "postings").glob("_folder=*"):
        if int(folder.name.split("=")[1]) not in needed:
            shutil.rmtree(folder)
    # the folders that no word leads to are not read, and those left are few
    assert sorted(map(tuple, substrings.search(q, built, 10).collect())) == want and size() < whole / 10


def test_long_query_tables_go_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8)).round(3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choice(words, 12))) for i in range(50)]
    asked = [(i, " ".join(rng.choice(words, 3))) for i in range(40)]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    built = fulltext.build(t.withColumnRenamed("id", "doc_id"))
    run = lambda: [sorted(map(tuple, df.collect())) for df in (retrieve.semantic(v.withColumnRenamed("id", "query_id"), v, 5, 0.1), retrieve.keyword(q, t, 4), fulltext.search(q, built, 4))]
    whole = run()
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(retrieve, "TEXTS_AT_ONCE", 9)
    monkeypatch.setattr(fulltext, "TEXTS_AT_ONCE", 9)
    assert run() == whole and all(whole)
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.1}
    assert {r[:2] for r in whole[0]} == want
    for i, query in asked:
        share = sorted(((-round(sum(w in text for w in query.split()) / 3, 6), j) for j, text in texts))
        assert [(r[1], r[2]) for r in sorted(whole[1], key=lambda r: r[3]) if r[0] == i] == [(j, -n) for n, j in share[:4] if n]


def test_text_files_are_of_bounded_size(spark, monkeypatch):
    rows = [("hot" if i % 10 else "cold", f"{i:099d}" if i % 3 else "same" * 24 + "abc") for i in range(3000)]
    path = work_folder(spark, "texts")
    files.write_texts(spark.createDataFrame(rows, "doc string, value string"), path, "doc", 10_000)
    good, bad = files.read_texts(spark, f"{path}/doc=*/*")
    texts = [r["text"] for r in good.collect()]
    assert bad.count() == 0 and max(map(len, texts)) < 20_000 and len(texts) > 20
    assert sorted(x for t in texts for x in t.splitlines()) == sorted(v for _, v in rows)
    # the query's own files
    seen, plain = [], files.read_texts
    monkeypatch.setattr(files, "read_texts", lambda s, folder: (seen.append(folder), plain(s, folder))[1])
    monkeypatch.setattr(tables, "FILE_BYTES", 20_000, raising=False)
    got = {r["doc_id"]: r["n_docs"] for r in tables.text_dir_ingest(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got == {f"d{r['d']}": r["count"] for r in docs.groupBy((F.col("doc_id") % 8).alias("d")).count().collect()}
    assert plain(spark, seen[0])[0].count() > 8


def test_rows_without_direction_take_no_place_of_a_hit(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [-1.0, 0.0])], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in retrieve.semantic(q, v, 2, 0.1).collect())
    assert got == [(7, 1, 0), (7, 2, 1), (9, 1, 6)]


def test_a_scan_of_all_vectors_needs_one_python_worker_a_task(spark, monkeypatch):
    """Vectors stay packed up to the task that compares them, and it makes a bounded number of scores at once."""
    monkeypatch.setattr(neighbours, "SCAN", -1)
    monkeypatch.setattr(retrieve, "SCORES", 500)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(_clustered(200).tolist())], "id long, vector array<float>")
    packed, kind = neighbours._packed(v)
    found = neighbours._search(cut(packed), kind, 5, 0.1, 0.95)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    s = _cosines(v.collect())
    want = {(i, int(j)) for i in range(200) for j in np.lexsort((np.arange(200), -s[i]))[:5] if s[i, j] >= 0.1}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want
    most, add = [0], retrieve.Best.add
    best = retrieve.Best(3, 2)
    for at in range(0, 40, 4):
        add(best, np.arange(at, at + 4), np.tile(np.arange(at, at + 4, dtype=float)[:, None], 3), 0.0, 6)
        most[0] = max(most[0], best.size)
    best.settle()
    assert most[0] <= 6 and best.id.tolist() == [39, 38] * 3 and best.q.tolist() == [0, 0, 1, 1, 2, 2]


def _cosines(rows):
    x = np.array([r["vector"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    return s


def test_similar_vectors_of_all(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = {(r["query_id"], r["id"]): r["score"] for r in neighbours.similar_all(v, 5, 0.1).collect()}
    rows = v.collect()
    s = _cosines(rows)
    exact = [(rows[i]["id"], rows[j]["id"]) for i in range(len(rows)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.1]
    assert np.mean([p in found for p in exact]) >= 0.9
    at = {r["id"]: i for i, r in enumerate(rows)}
    assert all(abs(s[at[a], at[b]] - c) < 1e-5 for (a, b), c in found.items())


def _clustered(n, dims=16, seed=0):
    """Vectors around as many centres as there are tens of them."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((max(n // 20, 1), dims))
    return (c[rng.integers(len(c), size=n)] + 0.25 * rng.standard_normal((n, dims))).astype(np.float32)


def test_similarity_search_grows_below_the_square(spark, monkeypatch):
    """Comparisons over three sizes, and what the search finds against all pairs."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    work = []
    for n in (900, 2700, 8100):
        x = _clustered(n)
        v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vector array<float>")
        packed, kind = neighbours._packed(v)
        search = neighbours.fit(cut(packed), kind, 5, 0.1, 0.95)
        assert search.depth <= neighbours.SCAN * len(search.centres)
        home = cut(retrieve.top(neighbours.compare(search.homes, search.homes, 5, 0.1, kind), "query_id", 5).drop("rank"))
        visits = neighbours.visits(search, home, 5, 0.1).select("cell").unionByName(search.homes.select("cell"))
        each = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(search.homes.groupBy("cell").agg(F.count(F.lit(1)).alias("h")), "cell")
        work.append(each.agg(F.sum(F.col("q") * F.col("h"))).first()[0] + n * len(search.centres))
        if n == 2700:
            got = {(r["query_id"], r["id"]) for r in neighbours.similar_all(v, 5, 0.1).collect()}
            s = _cosines([{"vector": r} for r in x.astype(float)])
            true = {(i, int(j)) for i in range(n) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.1}
            assert len(got & true) / len(true) >= 0.9
    assert all(b < a * 3**1.6 for a, b in zip(work, work[1:], strict=False)), work


def test_similar_vectors_among_many_copies(spark, monkeypatch):
    """A third of all vectors are one; others have none, no length, or a copy or two. All are scanned, so nothing is missed."""
    monkeypatch.setattr(neighbours, "SCAN", -1)
    rng = np.random.default_rng(2)
    x = [[1.0, 2.0, 3.0, 4.0]] * 300 + rng.standard_normal((500, 4)).tolist() + [[2.0, 4.0, 6.0, 8.0], [0.0] * 4, None]
    x += x[400:420]
    rows = [(i, v) for i, v in enumerate(x)]
    got = neighbours.similar_all(spark.createDataFrame([*rows, rows[5], rows[350], (None, [1.0, 1.0, 1.0, 1.0])], "id long, vector array<double>"), 4, 0.2).collect()
    live = [{"id": i, "vector": v} for i, v in rows if v and any(v)]
    s = _cosines(live)
    want = {(live[i]["id"], live[j]["id"], k + 1) for i in range(len(live)) for k, j in enumerate(np.lexsort((np.arange(len(live)), -s[i]))[:4]) if s[i, j] >= 0.2}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want and len({(r["query_id"], r["rank"]) for r in got}) == len(want)
    assert neighbours.similar_all(spark.createDataFrame([], "id long, vector array<float>"), 4, 0.2).count() == 0


def test_places_across_the_date_line(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(rng.uniform(-180, 180)), float(rng.uniform(-85, 85))) for i in range(1500)] + [(5000, 179.99, 10.0), (5001, -179.99, 10.0)]
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    q = p.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in geo.near_many(q, p, 900_000.0, 10_000).collect()}
    want = set()
    for i, lon, lat in pts:
        if i % 20 == 0:
            for j, lo, la in pts:
                a = np.sin(np.radians(la - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(la)) * np.sin(np.radians(lo - lon) / 2) ** 2
                if 2 * geo.EARTH_M * np.arcsin(np.sqrt(min(1, a))) <= 900_000:
                    want.add((i, j))
    assert got == want


def _metres(lon1, lat1, lon2, lat2):
    r = np.radians
    a = np.sin((r(lat2) - r(lat1)) / 2) ** 2 + np.cos(r(lat1)) * np.cos(r(lat2)) * np.sin((r(lon2) - r(lon1)) / 2) ** 2
    return np.round(2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(1, a))), 3)


@pytest.mark.parametrize(("cell", "most"), [(256, None), (8, None), (8, 50_000.0)])
def test_nearest_places_without_a_bound(spark, monkeypatch, cell, most):
    """A dense city, a third of all points at one place, poles and the open sea; centres in and far from all of these."""
    monkeypatch.setattr(geo, "CELL", cell)
    rng = np.random.default_rng(6)
    pts = [(i, 13.4 + 0.05 * float(rng.standard_normal()), 52.5 + 0.03 * float(rng.standard_normal())) for i in range(900)]
    pts += [(1000 + i, -0.1, 51.5) for i in range(600)] + [(2000 + i, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for i in range(300)] + [(3000, 0.0, 90.0), (3001, 77.0, -90.0), (3002, 180.0, 0.0), (3003, -180.0, 0.0)]
    q = [(i, *p[1:]) for i, p in enumerate(pts[::60])] + [(500, -150.0, -40.0), (501, 13.4, 52.5), (502, -0.1, 51.5), (503, 10.0, 90.0), (504, 179.9, 0.1), (505, None, 1.0)]
    p = spark.createDataFrame([*pts, (9000, None, 1.0), (None, 1.0, 1.0)], "id long, lon double, lat double")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in geo.near_many(spark.createDataFrame(q, "query_id long, lon double, lat double"), p, most, 7).collect()}
    ids, lon, lat = (np.array(c) for c in zip(*pts, strict=True))
    want = {}
    for i, a, b in q[:-1]:
        m = _metres(a, b, lon, lat)
        order = [j for j in np.lexsort((ids, m))[:7] if most is None or m[j] <= most]
        want |= {(i, k + 1): (int(ids[j]), -float(m[j])) for k, j in enumerate(order)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 0.0015 for k in want)


def test_a_centre_meets_few_points_of_a_dense_city(spark, monkeypatch):
    """A centre far out has the whole city beyond it, and still only meets a few leaves."""
    monkeypatch.setattr(geo, "CELL", 16)
    rng = np.random.default_rng(7)
    pts = [(i, 13.4 + 0.05 * float(rng.standard_normal()), 52.5 + 0.03 * float(rng.standard_normal())) for i in range(4000)]
    seen = []
    top = geo.top
    monkeypatch.setattr(geo, "top", lambda df, *a: (seen.append(df.count()), top(df, *a))[1])
    q = spark.createDataFrame([(1, 13.4, 52.5), (2, 14.4, 52.5), (3, -100.0, -30.0)], "query_id long, lon double, lat double")
    assert geo.near_many(q, spark.createDataFrame(pts, "id long, lon double, lat double"), None, 5).count() == 15
    assert seen[0] < 3 * 40 * 16


@pytest.mark.parametrize("hub", [10_000, 3])
def test_links_are_followed_from_each_start(spark, monkeypatch, hub):
    """More starts than a set has, a hub that most nodes link to and that links to many, loops, null ends, unknown and repeated starts."""
    monkeypatch.setattr(sessions, "HUB", hub)
    monkeypatch.setattr(sessions, "TOGETHER", 50)
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (500, 2))] + [(i, 1000) for i in range(0, 400, 2)] + [(1000, i) for i in range(0, 400, 7)] + [(5, 5)]
    starts = [*range(0, 300, 2), 1000, 7777]
    go = {}
    for a, b in edges:
        go.setdefault(a, set()).add(b)
    want = set()
    for s in starts:
        depth, front = {s: 0}, {s}
        for d in range(1, 4):
            front = {b for a in front for b in go.get(a, ())} - depth.keys()
            depth |= dict.fromkeys(front, d)
        want |= {(s, n, d) for n, d in depth.items()}
    e = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "a long, b long")
    got = [tuple(r) for r in sessions.expand(e, spark.createDataFrame([(s,) for s in [*starts, 4, None]], "node long"), 3).collect()]
    assert set(got) == want and len(got) == len(want)
    assert sessions.expand(e.limit(0), spark.createDataFrame([(1,)], "node long"), 3).collect() == [(1, 1, 0)]
    assert sessions.expand(e, spark.createDataFrame([], "node long"), 3).count() == 0


def test_tables_are_repaired():
    assert tablefix.split_numbers("$ 1,234 12.5 % (56) 789") == ["12.5 %", "$ 1,234", "($ 56)", "789"]
    assert tablefix.split_numbers("12.5 % 12.5 %") == ["12.5 %", "5 %", "12"]  # the rule leaves repeats to the patterns after
    assert tablefix.split_numbers("$1.96 ($  2.50 ) 12%") == ["$1.96", "$ 2.50", "12%"] and tablefix.split_numbers("( 2.50 )") == ["($ 2.50)"] and tablefix.split_numbers("") == [""] and tablefix.split_numbers("n/a x") == ["n/a"]
    assert tablefix.join_decimals(["$ 1", "96", "x", "$ 2", "1", "96", "12"]) == ["$ 1.96", "x", "$ 2", "1.96", "12"]
    assert tablefix.fix_row("| Revenue | $ 1 | 96 | (241) |") == "| Revenue | $ 1 | $ 96 | ($ 241) |  |"  # both are money by the label before decimals are joined
    assert tablefix.fix_row("| Per unit | $ 1 | 96 |") == "| Per unit | $ 1.96 |  |  |  |"
    assert tablefix.fix_row("| 12 | 13 |") == "" and tablefix.fix_row("| Assets |") == "| **Assets** |"
    assert tablefix.fix_row("| **Assets** |") == "| **Assets** |"
    assert tablefix.fix_row("| Total revenue | nan | nan |") == "| **Total revenue** |"
    assert tablefix.fix_row("| GROSS PROFIT | n/a | |") == "| **GROSS PROFIT** |"
    assert tablefix.fix_row("| Margin | 7 | 56.5 | 1,234 |") == "| Margin | 56.5 % | 1,234 |  |  |"
    assert tablefix.fix_row("| Diluted shares | 914.2 | 120,000 |") == "| Diluted shares | 914.2 | 120,000 |  |  |"
    assert tablefix.fix_row("| Net sales | 914.2 |") == "| Net sales | $ 914.2 |  |  |  |"
    assert tablefix.fix_row("| Employees | 12,000 |") == "| Employees | 12,000 |  |  |  |"
    assert tablefix.fix_row("| Common stock issued | 1,200 |") == "| Common stock issued | 1,200 |  |  |  |"
    assert tablefix.fix_header("| Item | 2024 | 2023 |") == "| Item | 2024 | 2023 |" and tablefix.fix_header("|  | 2024 | 2024 | 2023 |") == "|  | 2024 | 2023 |"
    assert tablefix.fix_header("|| Three Months Ended June 30, 2024 2023 |") == "|  | Three Months Ended June 30, <br/>2024 | Three Months Ended June 30, <br/>2023 |"
    assert tablefix.is_header("| Year ended | June 30, 2024 |", "") and not tablefix.is_header("| Mayor payroll | 1,200 |", "") and not tablefix.is_header("| March sales | 1,200 |", "")
    assert tablefix.fix_text("short | text") == "short | text" and tablefix.fix_text(None) is None
    assert tablefix.is_separator("|---|:--:|") and not tablefix.is_separator("| a | b |")


def test_cleaning(spark):
    assert one(spark, cleaning.markdown_to_text(F.lit("## Head\n| a |  | b |\n|---|---|\n\n\n\n**bold** *it* `code`  x"))) == "Head\na | b\n--- | ---\n\nbold it code x"
    assert one(spark, cleaning.clean_nan(F.lit("| NaN | 1 | nan word\nbanana"))) == "| | 1 | word\nbanana"
    assert one(spark, cleaning.currency_text(F.lit("(241)"), F.lit(None).cast("string"))) == "($ 241)" and one(spark, cleaning.currency_text(F.lit(" 1,234 "), F.lit("Total cost"))) == "$ 1,234"
    values = ["(241)", "1,234", "1.96", "12,345", "1,234.50", "(99)", "12.345.6", "$ 5", "5 %", "x", ",", "0", "250.75"]
    labels = ["Net revenue", "Weighted average shares", "Depreciation", "Basic", "Growth rate", "S,G&A cost", ""]
    got = spark.createDataFrame([(v, w) for v in values for w in labels], "v string, w string").select("v", "w", cleaning.is_money(F.col("v"), F.col("w")).alias("m")).collect()
    assert [(r["v"], r["w"]) for r in got if r["m"] != tablefix.is_money(r["v"], r["w"])] == [] and {r["m"] for r in got} == {True, False}
    assert one(spark, cleaning.currency_text(F.lit("1,234"), F.lit("Common stock issued"))) == "1,234" and one(spark, cleaning.currency_text(F.lit("56"), F.lit("Net revenue"))) == "$ 56"
    sheet = spark.createDataFrame([(1, " a\n\n b|c", None), (2, None, "nan"), (3, None, " ")], "row long, `x|y` string, z string")
    assert [r["line"] for r in cleaning.markdown_lines(sheet, "row").orderBy("part", "row").collect()] == ["| **x\\|y** | **z** |", "| --- | --- |", "| a<br>b\\|c |   |", "|   |   |", "|   |   |"]
    assert "\n".join(r["line"] for r in cleaning.text_lines(sheet, "row", "s").orderBy("part", "row").collect()) == "Sheet: s\nDimensions: 3 rows × 2 columns\n\nCOLUMNS: x|y | z\n" + "-" * 17 + "\n  a |   b|c\n\nnan\n"
    assert [r["line"] for r in cleaning.text_lines(sheet.where("row > 9"), "row", "s").collect()] == ["Sheet 's' contains no data."]
    assert cleaning.column_names(["\n a\xa0 b ", "", "x" * 60]) == ["a b", "Column_2", "x" * 47 + "..."]
    assert one(spark, cleaning.header_like(F.array(F.lit("nan"), F.lit("a"), F.lit("")))) is True
    assert one(spark, cleaning.markdown_row(F.array(F.lit("a|b"), F.lit(None).cast("string")))) == "| a\\|b |   |"


def test_formulas(spark):
    rows = [("SELECT SUM(revenue) FROM sales",), ("SELECT 1",), (None,), (" ",), ("select id from users u join nowhere n",), ("select 1 from nope",), ("select 1 from sales",)]
    got = [r["error"] for r in metrics.validate(spark.createDataFrame(rows, "formula string"), {"sales": ["revenue"], "users": ["id"]}).collect()]
    assert got == [None, "no table", "empty formula", "empty formula", None, "unknown table nope", "no known column of sales"]


def test_lists_of_unequal_length(spark):
    df = spark.createDataFrame([([1, 2], ["a"])], "ids array<int>, texts array<string>")
    with pytest.raises(Exception, match="unequal"):
        sessions.zip_lists(df, "ids", "texts").collect()


def test_bad_text_files_are_set_aside(spark, tmp_path):
    (tmp_path / "a.txt").write_text("good é")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.md").write_text("other")
    good, bad = files.read_texts(spark, str(tmp_path))
    assert [tuple(r) for r in good.collect()] == [("a.txt", "good é")] and [r["doc_id"] for r in bad.collect()] == ["b.txt"]


def test_envelope(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    assert sorted(r["a"] for r in files.read_envelope(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_feed_ignores_late_and_repeated_changes(spark):
    path = work_folder(spark, "changes")
    schema = "k long, seq long, op string, v string"
    for i, rows in enumerate([[(1, 5, "upsert", "a"), (2, 1, "upsert", "b")], [(1, 3, "upsert", "late"), (2, 2, "delete", None)], [(1, 5, "upsert", "again"), (2, 1, "upsert", "late"), (3, 9, "upsert", "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    stream = feeds.folder_stream(spark, f"{path}/*", schema, 1)
    got = feeds.apply_feed(stream, spark.createDataFrame([(7, "kept")], "k long, v string"), "k")
    assert {r["k"]: r["v"] for r in got.collect()} == {1: "a", 3: "c", 7: "kept"}


def test_a_second_run_adds_nothing(spark):
    path, out, state = (work_folder(spark, x) for x in ("in", "out", "state"))
    spark.range(10).write.parquet(path)
    for _ in range(2):
        feeds.drain(feeds.folder_stream(spark, path, "id long"), path=out, state=state)
        assert spark.read.schema("id long").parquet(out).count() == 10


def test_plans_have_no_full_products(spark):
    from tidemill import registry

    for name in ("lookup_join", "hybrid_search", "revenue_by_key", "latest_per_key", "agg_pipeline"):
        text = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text, name


def test_dates_and_decimals_survive_a_round_trip(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), Decimal("1.25"))], "t timestamp_ntz, d decimal(10,2)")
    assert files.by_json(df).collect() == df.collect()


def test_a_batch_that_runs_again_changes_nothing(spark):
    """Batches by hand, as a restarted stream gives them: the last one twice, with a new object for the table each time."""
    path, schema = work_folder(spark, "versions"), "k long, v string"
    made = lambda: changesets.ChangeSets(spark, path, spark.createDataFrame([], schema).schema, "k")
    made().start(spark.createDataFrame([(7, "start"), (8, "other")], schema))

    def apply(number, rows):
        t, new = made(), spark.createDataFrame(rows, schema)
        parts = t.touched(new, number)
        t.put(changes.upsert(t.now(number, parts).join(new.select("k"), "k", "left_semi"), new.withColumn("seq", F.lit(number)), "k", "seq"), number)

    for number, rows in ((0, [(1, "a")]), (1, [(2, "b"), (7, "new")]), (1, [(2, "b"), (7, "new")])):
        apply(number, rows)
    assert {r["k"]: r["v"] for r in made().now().collect()} == {1: "a", 2: "b", 7: "new", 8: "other"}
    apply(1, [(2, "other try")])  # what the first try of batch 1 wrote for key 7 goes
    assert {r["k"]: r["v"] for r in made().now().collect()} == {1: "a", 2: "other try", 7: "start", 8: "other"}


@pytest.mark.parametrize("part_bytes", [1 << 28, 20_000])
def test_change_sets_write_what_changes(spark, monkeypatch, part_bytes):
    """Batches of random keys: what is written follows the batch, whatever the table's size; folds and splits keep every row; a batch runs again."""
    monkeypatch.setattr(changesets, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(5)
    path, schema = work_folder(spark, "sets"), "k long, v long"
    t = changesets.ChangeSets(spark, path, spark.createDataFrame([], schema).schema, "k")
    t.start(spark.range(20_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")))
    want = {r["k"]: r["v"] for r in t.now().collect()}
    assert len(want) == 20_000 and (len(t.live(t.listing(), None)) > 3) == (part_bytes < 1 << 28)
    whole, written = t._bytes([path]), 0
    for number in range(5):
        keys = rng.choice(25_000, 100, replace=False).tolist()
        rows, gone = [(k, number * 1000 + k) for k in keys[:80]], keys[80:]
        for again in range(2 if number == 3 else 1):
            before = {p: {k: set(v) for k, v in own.items()} for p, own in t.listing().items()} if again == 0 else before
            t.put(spark.createDataFrame(rows if again or number != 3 else rows[:5], schema), number, spark.createDataFrame([(k, 0) for k in gone], schema))
        now = t.listing()
        assert all(number in ns or set(ns) <= before.get(p, {}).get(kind, set()) for p, own in now.items() for kind, ns in own.items())
        written += sum(t._bytes([f"{path}/_part=p{p}/changes={number}"]) for p, own in now.items() if number in own["changes"])
        want |= dict(rows)
        for k in gone:
            want.pop(k, None)
        assert {r["k"]: r["v"] for r in t.now().collect()} == want
    assert written < whole or part_bytes < 1 << 28
    monkeypatch.setattr(changesets, "SHARE", 0.0)  # every batch folds what it touches
    t.put(spark.createDataFrame([(1, 1)], schema), 5)
    assert {r["k"]: r["v"] for r in t.now().collect()} == want | {1: 1}
    assert {r["k"]: r["v"] for r in t.now(5).collect()} == want
    assert any(5 in own["base"] for own in t.listing().values())


def test_feeds_go_on_after_a_restart(spark):
    path, out, state = (work_folder(spark, x) for x in ("in", "out", "state"))
    schema = "k long, seq long, op string, v string"
    start = spark.createDataFrame([(7, "kept")], "k long, v string")
    for i, rows in enumerate([[(1, 1, "upsert", "a"), (2, 2, "upsert", "b")], [(1, 3, "delete", None), (3, 4, "insert", "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        got = feeds.apply_feed(feeds.folder_stream(spark, path, schema, 1), start, "k", out, state)
        assert {r["k"]: r["v"] for r in got.collect()} == ({1: "a", 2: "b", 7: "kept"}, {2: "b", 3: "c", 7: "kept"})[i]


def test_documents_sent_again_take_the_place_of_the_first(spark):
    path, out = work_folder(spark, "in"), work_folder(spark, "points")
    long, short = " ".join(f"w{i}" for i in range(1000)), "now short"
    for i, rows in enumerate([[(1, long), (2, "stays")], [(1, short), (3, "gone soon")], [(3, " ")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/w={i}")
    points = feeds.index_feed(feeds.folder_stream(spark, f"{path}/*", "doc_id long, text string", 1), out)
    assert sorted((r["doc_id"], r["text"]) for r in points.collect()) == [(1, short), (2, "stays")]


def test_events_sent_again_count_once(spark):
    path, out = work_folder(spark, "in"), work_folder(spark, "out")
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i)) for i in range(5)]
    for k in range(2):
        spark.createDataFrame(rows[: 5 - k], "id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{path}/w={k}")
    feeds.drain(feeds.once(feeds.folder_stream(spark, f"{path}/*", "id long, ts timestamp_ntz", 1), ["id"], "ts", "1 hour"), path=out)
    assert sorted(map(tuple, spark.read.schema("id long, ts timestamp_ntz").parquet(out).collect())) == rows


def test_postings_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "b a a c; a"), (2, "xx yy xx"), (3, ""), (4, None), (2, "xx")], "doc_id long, text string")
    got = index.postings(docs, lengths=True)
    assert sorted(map(tuple, got.collect())) == [("xx", 2, 1, 1, True), ("xx", 2, 2, 3, True), ("yy", 2, 1, 3, False)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 30, 10_000])
def test_full_text_search_scores_all_that_can_be_among_the_best(spark, monkeypatch, block):
    """The k best by the formula, for one index and several query tables; most blocks are never scored."""
    monkeypatch.setattr(fulltext, "BLOCK_DOCS", block)
    monkeypatch.setattr(fulltext, "FIRST", 1)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(words[: 300 if i % 3 else 20], int(rng.integers(0, 60))))) for i in range(200)] + [(500, None), (501, "x " * 50), (502, "rare words of one text, W7")]
    built = fulltext.build(spark.createDataFrame(texts, "doc_id long, text string"))
    toks = {i: [t for t in re.split(r"[^\w]+", (t or "").lower()) if 2 <= len(t) <= 15] for i, t in texts}
    toks = {i: t for i, t in toks.items() if t}
    mean, df = np.mean([len(t) for t in toks.values()]), Counter(x for t in toks.values() for x in set(t))

    def score(q, t):
        tf = Counter(t)
        return sum(np.log(1 + (len(toks) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in set(q) if tf[x])

    for queries in ([(1, "w1 w2 w290 w291"), (2, "rare words w7 w7"), (3, "nothing"), (4, None)], [(9, " ".join(words[::7]))]):
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in fulltext.search(spark.createDataFrame(queries, "query_id long, query string"), built, 5).collect()}
        want = {}
        for q, text in queries:
            ranked = sorted((-round(s, 5), i) for i, t in toks.items() if (s := score((text or "").split(), t)) > 0)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(ranked)}
        assert got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 2e-5 for k in want)
        assert sum(got[k][0] != want[k][0] for k in want) <= 1  # rounding may turn two around
    empty = fulltext.build(spark.createDataFrame([], "doc_id long, text string"))
    assert fulltext.search(spark.createDataFrame([(1, "w1")], "query_id long, query string"), empty, 5).count() == 0


def test_full_text_search_has_more_tasks_for_more_postings_and_not_larger_ones(spark, monkeypatch):
    """Two words that all documents have: a task sorts a bounded number of postings, in the build and in a search."""
    most = 500
    monkeypatch.setattr(fulltext, "POSTINGS", most, raising=False)
    monkeypatch.setattr(fulltext, "HITS", most, raising=False)
    monkeypatch.setattr(fulltext, "BLOCK_DOCS", 20)
    built = fulltext.build(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("both words"), F.repeat(F.lit(" both"), (F.col("id") % 7).cast("int"))).alias("text")))
    written = built.table("postings").groupBy(F.input_file_name()).count().toPandas()["count"]
    assert written.sum() == 6000 and written.max() <= 2 * most
    got = fulltext.search(spark.createDataFrame([(1, "both words"), (2, "words")], "query_id long, query string"), built, 3)
    assert re.search(r"hashpartitioning\(block#\d+L, 12\)", got._jdf.queryExecution().executedPlan().toString())
    mean, idf = 2 + np.mean([i % 7 for i in range(3000)]), np.log(1 + 0.5 / 3000.5)
    score = lambda i, counts: round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (2 + i % 7) / mean)) for tf in counts), 5)
    want = [sorted((-score(i, counts(i)), i) for i in range(3000))[:3] for counts in (lambda i: (1 + i % 7, 1), lambda _: (1,))]
    assert [(r["query_id"], -r["score"], r["id"]) for r in got.orderBy("query_id", "rank").collect()] == [(q, *x) for q, found in zip((1, 2), want, strict=True) for x in found]


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(20,0)"])
def test_full_text_search_keeps_the_kind_of_the_ids(spark, monkeypatch, kind):
    """Ids that rows share are one hit with the sum of their scores; no id, no hit; a query's rows are one query."""
    monkeypatch.setattr(fulltext, "BLOCK_DOCS", 2)
    made = {"string": "'d' || i", "date": "date_add(date'2020-01-01', i)"}.get(kind, f"cast(i as {kind})")
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "one two"), (3, "two"), (None, "one two"), (4, "zero")], "i int, text string")
    built = fulltext.build(docs.selectExpr(f"{made} as doc_id", "text"))
    got = fulltext.search(spark.createDataFrame([(7, "one"), (7, "ONE two"), (None, "two")], "query_id long, query string"), built, 3)
    assert got.schema["id"].dataType.simpleString() == kind
    rows = got.orderBy("rank").collect()
    ids = [r[0] for r in docs.where("i is not null").selectExpr(f"{made} as d", "i").distinct().orderBy("i").collect()]
    assert [(r["query_id"], r["id"]) for r in rows] == [(7, i) for i in ids[:3]] and abs(rows[0]["score"] - 2 * rows[1]["score"]) < 2e-5


def test_chunks_in_tokens(spark):
    """No chunk has more tokens than asked for; all text is in them in order; sentences stay whole where they fit."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    n = lambda x: len(own.encode(x, add_special_tokens=False).ids)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts += ["One. Two!  Three?\n\nFour five six seven eight nine ten eleven. Twelve", "x" * 900, "é你好" * 200, "a b c " * 300 + ". " + "d e. " * 50, "... !!! ???", "", None, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((12, 4), (64, 0), (512, 100)):
        got: dict[int, list[str]] = {}
        for r in index.token_sentences(docs, path, size, overlap).orderBy("doc_id", "chunk_id").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        for i, text in enumerate(texts):
            spans, done = index.token_chunks(text or "", lambda x: own.encode(x, add_special_tokens=False).offsets, size, overlap), 0
            chunks = [text[a:b] for a, b in spans]
            assert chunks == got.get(i, []) and all(n(c) <= size for c in chunks)
            starts = [a for a, _ in own.encode(text or "", add_special_tokens=False).offsets]
            for a, b in spans:
                assert not text[done:a].strip() and b > done  # nothing is left out, each goes on
                assert sum(a <= x < done for x in starts) <= overlap
                done = b
            assert not (text or "")[done:].strip()
            for sentence in re.findall(r"[^.!?\n]+[.!?\n]+", text or ""):
                if overlap and n(sentence) < size // 2 and sentence.strip():
                    assert any(sentence in c for c in chunks)


def test_requests_are_checked(spark):
    rows = [(1, "semantic", 10, 0.0, 0.7), (2, "other", 0, 0.0, 0.7), (3, "keyword", 0, 0.0, 0.7), (4, "hybrid", 101, 2.0, 0.7), (5, "hybrid", 100, 1.5, 3.0), (6, "hybrid", 1, 1.0, -0.1), (7, None, 1, 0.0, 0.0), (8, "hybrid", None, 0.0, 0.0)]
    got = {r["query_id"]: r["error"] for r in retrieve.checked(spark.createDataFrame(rows, "query_id long, method string, limit int, threshold double, alpha double")).collect()}
    limit = "limit is not from 1 to 100"
    assert got == {1: None, 2: "unknown method", 3: limit, 4: limit, 5: "threshold is not from 0 to 1", 6: "alpha is not from 0 to 1", 7: "unknown method", 8: limit}


def test_terms_are_found_within_words_of_any_length(spark):
    find = retrieve.Finder(["ab", "b", "long", "é"])
    assert set(find("xaby longé")) == {0, 1, 2, 3} and set(find("")) == set() and set(find("a b")) == {1}
    assert set(find("x" * 1_000_000 + "long")) == {2} and not find.known.keys() & {b"x" * 1_000_000 + b"long"}


def test_searches_have_no_nested_loops_over_data(spark):
    from tidemill import registry

    for name in ("semantic_search", "keyword_search", "hybrid_search", "rerank"):
        text = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_computed_values(spark):
    df = spark.sql("select 1 as k, 2.0D as a, 3.0D as b, cast(null as double) as n, timestamp_ntz'2024-03-05 06:07:08' as t, 'x' as s")
    value = lambda e: df.select(documents.expression(e).alias("v")).first()["v"]
    assert value({"$multiply": ["$a", "$b", 2]}) == 12 and value({"$add": ["$a", "$n"]}) is None and value({"$ifNull": ["$n", 7.0]}) == 7
    assert value({"$dateToString": {"format": "%Y-%m-%dT%H:%M o'clock 100%%", "date": "$t"}}) == "2024-03-05T06:07 o'clock 100%"
    assert value({"$cond": {"if": {"$gt": ["$a", "$b"]}, "then": "$a", "else": {"$subtract": ["$b", "$a"]}}}) == 1
    assert value({"$concat": ["$s", "-", {"$toUpper": "$s"}]}) == "x-X" and value({"$literal": "$s"}) == "$s"
    assert value({"p": "$a", "q": {"$eq": ["$n", None]}}).asDict() == {"p": 2.0, "q": True}
    for bad in ({"$max": {"$nope": "$a"}}, {"$add": ["$a"], "$abs": "$a"}, {"$dateToString": {"format": "%q", "date": "$t"}}):
        with pytest.raises(ValueError):
            documents.expression(bad)
    got = documents.pipeline(df, [{"$group": {"_id": None, "m": {"$max": {"$multiply": ["$a", "$b"]}}}}, {"$project": {"m": 1, "t": {"$add": ["$m", 1]}}}]).first()
    assert (got["m"], got["t"]) == (6.0, 7.0)
    with pytest.raises(ValueError):
        documents.pipeline(df, [{"$group": {"_id": None, "m": {"$median": "$a"}}}])
    assert documents.find(df, {"s": {"$not": {"$regex": "^y"}}}).count() == 1


@pytest.mark.parametrize(("fan", "count", "apart"), [(3, 200, 1), (4, 200, 977), (1024, 100_000, 86_399_977)])
def test_many_changes_of_a_key_are_composed_level_by_level(spark, monkeypatch, fan, count, apart):
    """A third of the operations, or nearly all, are of one key; their numbers are far apart."""
    monkeypatch.setattr(changes, "FAN", fan)
    rng = np.random.default_rng(11)
    start = {k: f"s{k}" for k in range(6)}
    kinds = rng.choice(["insert", "update", "delete", "upsert", "none"], count).tolist()
    ops = [(int(rng.integers(0, 12)) if n % (3 if count < 1000 else 50) == 1 else 0, n * apart - 7, kinds[n], f"v{n}") for n in range(count)]
    now, n = dict(start), dict.fromkeys(changes.KINDS, 0)
    for k, _, op, v in ops:
        if op == "upsert" or (op == "insert" and k not in now) or (op == "update" and k in now):
            now[k] = v
        elif op == "delete" and k in now:
            del now[k]
        else:
            continue
        n[op] += 1
    t, c = spark.createDataFrame(list(start.items()), "k int, v string"), spark.createDataFrame(ops, "k int, seq long, op string, v string")
    lo, levels = changes._levels(c, "seq")
    for level in range(levels):  # what is composed as one list
        own = c.select("k", changes._place("seq", lo, level).alias("at")).distinct().groupBy("k", F.floor(F.col("at") / fan)).count()
        assert own.agg(F.max("count")).first()[0] <= fan
    assert {r["k"]: r["v"] for r in changes.apply_changes(t, c, "k").collect()} == now
    assert changes.change_counts(t, c, "k").first().asDict() == {"inserted": n["insert"], "updated": n["update"], "deleted": n["delete"], "upserted": n["upsert"]}
    assert changes.apply_changes(t, c.limit(0), "k").count() == 6 and changes.change_counts(t, c.limit(0), "k").first()["deleted"] == 0


def test_update_that_matches_nothing_adds_a_row(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    add = lambda k: sorted(map(tuple, changes.update_many(t, F.col("k") == k, {"v": F.lit("z")}, {"k": k, "v": "new"}).collect()))
    assert add(1) == [(1, "z")] and add(2) == [(1, "a"), (2, "new")]
    assert tuple(changes.delete_counts(t, F.col("k") > 0).first()) == (1, 0)


def test_names_are_unique(spark):
    rng = np.random.default_rng(3)
    names = [str(rng.choice(["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b", "b_1", "c.tar.gz", "a_0.txt", "_.x"])) for _ in range(120)]
    got = [r["unique"] for r in changes.unique_names(spark.createDataFrame(list(enumerate(names)), "n long, name string"), "name", "n", spread=16).orderBy("n").collect()]
    taken, want = set(names), []
    seen = set()
    for x in names:
        if x in seen:
            stem, dot, ext = x.rpartition(".")
            stem, ext = (stem, dot + ext) if dot else (x, "")
            k = 1
            while f"{stem}_{k}{ext}" in taken:
                k += 1
            x = f"{stem}_{k}{ext}"
            taken.add(x)
        seen.add(x)
        want.append(x)
    assert got == want and len(set(got)) == len(got)


def test_names_are_unique_where_a_stem_is_hot(spark):
    """Many arrivals of one name, and many numbers that files brought for it: in blocks, with gaps, and with leading ones."""
    names = ["a.txt"] * 700 + [f"a_{m}.txt" for m in (*range(1, 40), 41, 43, *range(100, 300), 5000)] + ["a_7.txt"] * 5
    rng = np.random.default_rng(8)
    rng.shuffle(names)
    got = [r["unique"] for r in changes.unique_names(spark.createDataFrame(list(enumerate(names)), "n long, name string"), "name", "n", spread=8).orderBy("n").collect()]
    brought, want, seen, free = set(names), [], set(), {}
    for x in names:
        if x in seen:
            k = free.get(x, 1)
            while f"{x[:-4]}_{k}.txt" in brought:
                k += 1
            free[x], x = k + 1, f"{x[:-4]}_{k}.txt"
        seen.add(x)
        want.append(x)
    assert got == want and len(set(got)) == len(got)


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": true, "c d": "x"}, "l": ["p", "q"]}',), ("broken",), (None,)], "j string")
    hits = lambda c: [r["v"] for r in df.select(c.alias("v")).collect()]
    assert hits(documents.json_equals("j", "$.a.b", True))[0] is True and hits(documents.json_equals("j", "a.c d", "x"))[0] is True
    assert hits(documents.json_equals("j", "a.none", None)) == [True, True, True] and not hits(documents.json_equals("j", "$.a.b", "True"))[0]
    assert hits(documents.json_has("j", "$.l", "q")) == [True, False, False] and hits(documents.json_has("j", "$", "l")) == [True, False, False] and not hits(documents.json_has("j", "$.a", "l"))[0]


def test_values_are_bound(spark):
    from tidemill.sources import statements

    df = {"_t": spark.createDataFrame([(1, "it's"), (2, ":a $1 ?")], "k int, v string")}
    run = lambda q, values: [tuple(r) for r in statements.run(spark, q, df, values).collect()]
    assert run("select k from _t where v = :v", {"v": "it's"}) == run("select k from _t where v = %(v)s", {"v": "it's"}) == run("select k from _t where v = ?", ["it's"]) == [(1,)]
    assert run("select k, ':a $1 ?' = v from _t where k = $2 and k > $1 -- $3", [1, 2]) == [(2, True)]


def test_exports(spark):
    df = spark.createDataFrame([(1, "tab\there", 1.5), (2, "line\nend \\t \\\\n \\", None), (None, None, 0.25), (3, "", 2.0)], "k int, s string, d double")
    for form in ("text", "binary"):
        path = work_folder(spark, "export")
        files.export(df, path, form)
        assert sorted(map(repr, files.exported(spark, path, form, df.schema).collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        files.export(df, work_folder(spark, "export"), "other")


def test_compaction_keeps_rows_and_place(spark):
    path = work_folder(spark, "a table 1+1")
    spark.range(1000).withColumn("p", F.col("id") % 2).repartition(8).write.partitionBy("p").parquet(path)
    files_of = lambda p: spark.read.parquet(f"{path}/p={p}").select("_metadata.file_path").distinct().count()
    assert files.compact(spark, path, order=["id"], partition={"p": "1"}) == 8
    assert (files_of(0) > 1, files_of(1)) == (True, 1) and spark.read.parquet(path).count() == 1000
    assert [r["id"] for r in spark.read.parquet(f"{path}/p=1").collect()] == list(range(1, 1000, 2))
    assert files.compact(spark, path) == 8 and files.compact(spark, path) == 0
    assert files_of(0) == 1 and sorted(r["id"] for r in spark.read.parquet(path).where("p = 0").collect()) == list(range(0, 1000, 2))


def test_compaction_leaves_large_files_alone_and_ends_what_broke_off(spark, monkeypatch):
    import os

    path = work_folder(spark, "table")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    spark.range(200_000, 201_200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(12).write.mode("append").parquet(path)
    sizes = lambda: {f: os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")}
    before = sizes()
    large, small = max(before, key=before.get), min(before.values())
    assert files.compact(spark, path, 5 * small) == 12
    after = sizes()
    assert after[large] == before[large] and len(after) in (3, 4, 5) and not before.keys() - {large} & after.keys()
    assert sorted(r["id"] for r in spark.read.parquet(path).select("id").collect()) == list(range(201_200))
    # a break when all is certain, but nothing has moved yet
    real = files.bins
    spark.range(201_200, 201_300).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(3).write.mode("append").parquet(path)
    jvm_list = spark.read.text
    monkeypatch.setattr(type(spark.read), "text", lambda *a, **b: (_ for _ in ()).throw(OSError("broken off")))
    with pytest.raises(OSError):
        files.compact(spark, path, 100 * small)
    monkeypatch.undo()
    assert files.bins is real and jvm_list
    files.compact(spark, path, 100 * small)
    assert sorted(r["id"] for r in spark.read.parquet(path).select("id").collect()) == list(range(201_300)) and "_compact" not in os.listdir(path)


def test_files_are_packed_by_best_fit():
    got = files.bins({"a": 60, "b": 50, "c": 40, "d": 50, "e": 10, "f": 99, "g": 100}, 100)
    assert sorted(map(sorted, got)) == [["a", "c"], ["b", "d"]] and files.bins({"a": 60, "b": 50}, 100) == [] and files.bins({}, 100) == []


def test_views_of_the_user_stay(spark):
    spark.range(3).createOrReplaceTempView("orders_view")
    one_row = spark.range(1).withColumn("x", F.lit(5))
    assert statements.run(spark, "SELECT x FROM orders_view", {"orders_view": one_row, "other_view": one_row}).first()["x"] == 5
    assert metrics.evaluate({"orders_view": one_row}, {"m": "SELECT max(x) FROM orders_view WHERE x > 1"}).first()["value"] == 5.0
    assert spark.table("orders_view").count() == 3 and not spark.catalog.tableExists("other_view")
    spark.catalog.dropTempView("orders_view")


def _database(path, rows):
    import sqlite3

    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE IF NOT EXISTS events (seq INTEGER PRIMARY KEY, kind TEXT, value REAL)")
        c.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    c.close()


def test_tables_are_read_by_key(spark, tmp_path):
    """Ranges of a table's own keys, in pages; several addresses, one without rows; names that are none are refused."""
    rows = [(i * i, f"k{i % 3}", i / 4 if i % 5 else None) for i in range(1, 1001)]
    for name, part in (("a", rows[:700]), ("b", rows[700:]), ("c", [])):
        _database(tmp_path / name, part)
    at = ",".join(str(tmp_path / n) for n in "abc")
    df = keyset.read(spark, "seq long, value double, kind string", at, "events", "seq", page="7", range="100")
    assert sorted(map(tuple, df.collect())) == [(s, v, k) for s, k, v in rows]
    assert df.rdd.getNumPartitions() == 8 + 4 + 1
    sizes = [n for n in df.rdd.glom().map(len).collect() if n]
    assert max(sizes) == 100
    assert keyset.read(spark, "kind string", at, "events", "seq").where("kind = 'k1'").count() == 334
    with pytest.raises(Exception, match="no plain name"):
        keyset.read(spark, "seq long", at, "events; DROP TABLE events", "seq").collect()


def test_streams_go_on_from_a_key(spark, tmp_path):
    """What is added between runs comes once, after restarts too; an address may get its first rows later."""
    a, b = tmp_path / "a", tmp_path / "b"
    out, state = work_folder(spark, "out"), work_folder(spark, "state")
    _database(a, [(i, "x", 1.0) for i in range(1, 51)])
    _database(b, [])
    for step, (path, seqs) in enumerate([(None, []), (a, range(51, 60)), (b, [5, 7]), (None, []), (b, [8])]):
        if path:
            _database(path, [(i, "y", 2.0) for i in seqs])
        feeds.drain(keyset.stream(spark, "seq long, kind string", f"{a},{b}", "events", "seq", page="4", range="10"), path=out, state=state)
        got = sorted(tuple(r) for r in spark.read.schema("seq long, kind string").parquet(out).collect())
        want = [(i, "x") for i in range(1, 51)] + [(i, "y") for p, s in [(a, range(51, 60)), (b, [5, 7]), (None, []), (b, [8])][:step] if p for i in s]
        assert got == sorted(want)


def test_sessions_end_when_nothing_comes(spark):
    """A session ends, is reported and goes; it may begin again; the next run goes on with those still open."""
    path, out, state = (work_folder(spark, x) for x in ("in", "out", "state"))
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    waves = [[("a", 0), ("b", 5), ("a", 20), (None, 7)], [("c", 200), ("a", 90)], [("a", 300), ("c", 210)], [("d", 1000)], [("a", 1010)], [("d", 1300), ("a", 20)], [("d", 1301)]]
    schema, before = "k string, t timestamp", spark.conf.get(expiry.PROVIDER)
    try:
        for i, rows in enumerate(waves):
            spark.createDataFrame([(k, at(s)) for k, s in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
            feeds.drain(expiry.ended_sessions(feeds.folder_stream(spark, f"{path}/*", schema, 1), "k", "t", 60, "150 seconds"), path=out, state=state)
    finally:
        spark.conf.set(expiry.PROVIDER, before)
    got = sorted((r["k"], int((r["first_used"] - at(0)).total_seconds()), int((r["last_used"] - at(0)).total_seconds()), r["n"]) for r in spark.read.schema("k string, first_used timestamp, last_used timestamp, n long").parquet(out).collect())
    # a's 300 came before the watermark, at 50 then, had passed its end at 150; the last 20 is behind the watermark; d is still open
    assert got == [("a", 0, 300, 4), ("a", 1010, 1010, 1), ("b", 5, 5, 1), ("c", 200, 210, 2)]


def test_metrics_are_registered_and_evaluated(spark):
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    reg = spark.createDataFrame([("old", "SELECT 1 FROM t", "me")], "name string, formula string, created_by string").withColumn("created_at", now)
    new = spark.createDataFrame([("old", "x", "you", 1), ("n", "first", "a", 1), ("n", "second", "b", 2)], "name string, formula string, created_by string, seq int")
    got = metrics.register(reg, new, F.expr("timestamp_ntz'2024-02-02 00:00:00'"), "seq")
    assert got.columns == reg.columns and {(r["name"], r["formula"], r["created_at"].month) for r in got.collect()} == {("old", "SELECT 1 FROM t", 1), ("n", "first", 2)}
    assert metrics.by_name(got, "n").first()["created_by"] == "a"
    t = spark.range(10).toDF("x")
    values = metrics.evaluate({"t": t}, {"sum": "SELECT SUM(x) FROM t", "some": "select count(*) from t where x > 6", "part": "select extract(year from date'2020-01-01') from t limit 1"})
    assert {r["name"]: r["value"] for r in values.collect()} == {"sum": 45.0, "some": 3.0, "part": 2020.0}


def test_lines_of_tables_that_come_again_are_repaired_once():
    """20,000 tables of few different lines took over ten seconds; what is remembered is what the rules give."""
    import time

    head = "Three Months Ended June 30 and what follows it in the report of the year, as a table with some rows of values\n|  | 2024 | 2023 |\n|--|--|\n"
    rows = [f"| Item {k} | {k * 7} | $ 1 | 96 | (241) |" for k in range(50)]
    began = time.process_time()
    got = [tablefix.fix_text(head + "\n".join(rows[i % 45 : i % 45 + 5])) for i in range(20_000)]
    assert time.process_time() - began < 4
    assert got[0].split("\n")[3:] == [tablefix.fix_row(r) for r in rows[:5]] and got[0].split("\n")[1:3] == ["|  | 2024 | 2023 |", "|---|---|---|"]
    long = "| Year ended | " + "x" * 500 + " |"
    assert tablefix.fix_text(long + "\n| Revenue | $ 1 | 96 |").split("\n") == [tablefix.fix_header(long), tablefix.fix_row("| Revenue | $ 1 | 96 |")]


def test_profile_of_tables_of_several_files(spark, tmp_path):
    """The query agrees with its SQL however many files a table is in; the profile has their number."""
    import shutil

    import duckdb

    from tidemill.operators import profiles
    from tidemill.plans import tables

    con = duckdb.connect()
    for t in tables._TABLES:
        if t in ("documents", "pages"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t in ('documents', 'pages') else ''}'")
    got = tables.db_profile(spark, str(tmp_path))
    assert got.columns == [d[0] for d in con.execute(tables.SQL["db_profile"]).description]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(tables.SQL["db_profile"]).fetchall())
    assert [r["n_files"] for r in profiles.database_profile(spark, {t: f"{tmp_path}/{t}.parquet" for t in ("documents", "nation")}).collect()] == [3, 1]


def most_rows_at_once(spark, df, monkeypatch):
    """The most rows that a task, run here over one batch of all rows, turns into Python's own objects before it gives some on."""
    got: list[int] = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: got.extend(b.num_rows for b in run(iter(self.toArrow().combine_chunks().to_batches()))) or self)
    df()
    return max(got)


def test_workers_take_short_pieces(spark, monkeypatch):
    """Batches of 10,000 texts stood in a worker several times over; results come a short piece of a batch at a time."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("One two. Three four.").alias("text"), F.lit("x").alias("path"), F.encode(F.lit("x" * 100), "utf-8").alias("content"))
    assert most_rows_at_once(spark, lambda: index.sentences(docs, 2, 0), monkeypatch) <= 512  # two chunks each
    assert most_rows_at_once(spark, lambda: index.postings(docs), monkeypatch) <= 4 * 256
    assert most_rows_at_once(spark, lambda: index.embed(docs.select("doc_id", "text"), index.hash_embedder()), monkeypatch) <= 256
    assert most_rows_at_once(spark, lambda: tablefix.parse_all(docs, lambda name, data: (name, "")), monkeypatch) <= 256
    wide = docs.limit(100).withColumn("content", F.encode(F.repeat(F.lit("x"), 1 << 20), "utf-8"))
    assert most_rows_at_once(spark, lambda: tablefix.parse_all(wide, lambda name, data: (name, "")), monkeypatch) <= 4


def test_chunks_in_tokens_by_remembered_pieces():
    """As through the library whole, for texts of odd white space and added tokens too, and in a part of the time."""
    import random
    import time

    import public_tokenizers as P

    tokens, chance = index.Tokens(P.path("byte_bpe_50k.json")), random.Random(4)
    whole = lambda x: tokens.tokenizer.encode(x, add_special_tokens=False).offsets
    signs = [*"ab'sé1 \n\n.!?  \t\x85\x1c　你-", "'re", " the", "<|endoftext|>"]
    for k in range(600):
        text = "".join(chance.choices(signs[: None if k % 5 == 0 else -1], k=chance.randint(0, 150)))
        for size, overlap in ((5, 2), (40, 10)):
            assert index.token_chunks(text, tokens, size, overlap) == index.token_chunks(text, whole, size, overlap), text
    text = " ".join(f"This is sentence {k % 50} of a text of many." for k in range(20_000))
    began = time.process_time()
    fast = index.token_chunks(text, tokens, 512, 100)
    between = time.process_time()
    assert fast == index.token_chunks(text, whole, 512, 100) and 2 * (between - began) < time.process_time() - between


def test_centres_at_one_place_are_searched_once(spark, monkeypatch):
    """A thousand centres at two places meet the points of two; a centre of two places has the best of both, repeated rows count once."""
    from tidemill.operators import geo

    asked, cuts = spark.range(1000).select(F.col("id").alias("query_id"), (F.col("id") % 2).cast("double").alias("lon"), F.lit(5.0).alias("lat")), {}
    real = geo.cut
    monkeypatch.setattr(geo, "cut", lambda df, what: cuts.setdefault(what, []).append(real(df, what)) or cuts[what][-1])
    points = spark.range(3000).select("id", (F.col("id") % 50).cast("double").alias("lon"), (F.col("id") % 40).cast("double").alias("lat"))
    got = geo.near_many(asked.union(asked).union(spark.createDataFrame([(0, 1.0, 5.0)], "query_id long, lon double, lat double")), points, None, 3)
    assert max(df.count() for df in cuts["front"]) < 2 * 3000 and cuts["front"][0].count() == 2
    rows = points.crossJoin(spark.createDataFrame([(0.0,), (1.0,)], "p double")).select("id", "p", (-F.round(geo.distance("p", F.lit(5.0), "lon", "lat"), 3)).alias("score")).collect()
    best = {p: sorted((-r["score"], r["id"]) for r in rows if r["p"] == p)[:3] for p in (0.0, 1.0)}
    want = {q: best[float(q % 2)] for q in range(1, 1000)} | {0: sorted(best[0.0] + best[1.0])[:3]}
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert found == want
