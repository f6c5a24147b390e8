"""Operators against brute force, exact round trips and held-out accuracy; nulls, empty and long texts, repeats."""

import datetime
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import bpe, common, fingerprints, langid, licenses, neardup, packing, quality, queries, shards, sql, urlgraph, warc
from tidemill.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string"
ODD = [None, "", " \n\t ", "a", "Der Fluß!", "x" * 3000, "word " * 4000, "tab\tand\x0bvt\x1cfs　wide  nbsp", "é é 你好 \U0001f600\U0001f600", "  two  spaces\n\n\nlines \r\n", "it's we'll I'd 12345 1a2b3c ٠١"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, True, "clash") for i, t in texts], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_is_what_the_library_gives(spark):
    import base64

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab \néth'1　!e") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [r["text"] for r in documents(spark).select("text").collect()][:80]
    codec = bpe.codec(path, P.PATTERN)
    for t in texts:
        assert codec.encode(t) == own.encode_ordinary(t), t
        assert codec.decode(codec.encode(t)) == t.encode()
    got = {r["doc_id"]: r for r in bpe.round_trip(table(spark, enumerate(ODD)), path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.encode(table(spark, enumerate(ODD)), path, P.PATTERN)
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(ids, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(ODD)}


def test_empty_tables_and_clashing_columns(spark):
    """Every operator of one table: no row in, no row out; columns named as those that it makes itself do no harm."""
    path, words = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
    names = ["n_tokens", "ids", "data", "shard", "_h", "_n", "depth", "fingerprint", "_run", "line", "licence", "lang_pred", "score", "_use", "length", "_salt", "piece", "kept", "__text", "__row", "__words", "_text", "_id"]
    docs = table(spark, [(1, "Released under the MIT License."), (2, None), (2, None), (3, "word " * 60), (3, "")])
    more = docs.select("doc_id", "text", "lang", *[F.lit("clash").alias(n) for n in names])
    model = langid.fit(more)
    run = {
        "bpe": lambda d: bpe.round_trip(d, path, P.PATTERN), "shards": lambda d: shards.assign(d, 100), "fingerprints": fingerprints.against_next, "licenses": licenses.scan,
        "langid": lambda d: langid.predict(d, model), "packing": lambda d: packing.pack(d, words), "neardup": lambda d: neardup.near_duplicates(d, 3, 0.85), "quality": quality.judge,
        "accepted language": lambda d: langid.accepted(d, model), "accepted quality": quality.accepted, "distinct": neardup.distinct_documents,
    }
    for name, f in run.items():
        assert f(more.limit(0)).count() == 0, name
        plain, got = f(docs.select("doc_id", "text")), f(more)
        if name == "shards":  # whole rows count
            assert got.count() == 5
        elif name.startswith(("accepted", "distinct")):
            assert got.columns == more.columns and got.count() == plain.count(), name
        else:
            assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) or name == "packing", name
    assert langid.fit(more.limit(0)).langs == []


@pytest.mark.parametrize("limit", [1, 500, 20_000, 10**9])
def test_shards_fit_and_split_only_where_needed(spark, limit):
    docs = documents(spark).unionByName(table(spark, [(10**6, None), (10**6 + 1, ""), (None, "null id")]), allowMissingColumns=True)
    rows = shards.assign(docs, limit).collect()
    assert len(rows) == docs.count()
    own = defaultdict(int)
    for r in rows:
        own[r["shard"]] += r["n_bytes"]
        assert len(r["shard"]) == r["depth"]
    for r in rows:
        assert own[r["shard"]] == r["shard_bytes"]
        assert own[r["shard"]] <= limit or r["depth"] == shards.BITS
        if r["depth"]:
            assert sum(n for s, n in own.items() if s.startswith(r["shard"][:-1])) > limit
    assert shards.assign(docs.limit(0), limit).count() == 0


@pytest.mark.parametrize("send", [shards.SEND, 0])
def test_shards_are_written_as_they_are_assigned(spark, monkeypatch, send):
    monkeypatch.setattr(shards, "SEND", send)
    monkeypatch.setattr(common, "COLD_ROWS", 20)
    docs = documents(spark).unionByName(table(spark, [(None, None), (None, "null id")] + [(7, f"row {i} of one id") for i in range(100)]), allowMissingColumns=True)
    docs = docs.withColumn("_row", F.lit("clash")).withColumn("_h", F.lit(1)).withColumn("shard", F.lit("replaced")).withColumn("_at", F.lit(None).cast("string"))
    path = common.new_folder(spark, "test")
    shards.write(docs, path, 30_000)
    back = spark.read.parquet(path)
    rest = [c for c in docs.columns if c != "shard"]
    assert sorted(map(repr, back.select(rest).collect())) == sorted(map(repr, docs.select(rest).collect()))
    got = shards.read(spark, path, docs.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, shards.assign(docs.drop("shard"), 30_000).select(got.columns).collect()))
    assert all(r["shard_bytes"] <= 30_000 or r["depth"] == shards.BITS for r in got.collect()) and got.select("shard").distinct().count() > 10
    shards.write(docs.limit(0), common.new_folder(spark, "test"), 30_000)


def test_fingerprints_against_a_plain_loop(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None), (-4, ""), (-3, "short"), (-3, "short"), (10**6, "x" * 5000)], "doc_id long, text string"))
    got = sorted(fingerprints.against_next(docs).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        r = got[k]
        f, fe, fn = map(fingerprints.fingerprint, (t, e, n))
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (fingerprints.read(r["fingerprint"]), fingerprints.read(r["edited_fingerprint"])) == (f, fe)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.containment(f, fe), fingerprints.containment(f, fn))
    long = [r for r in got if r["n_chars"] > 2000 and r["doc_id"] != 10**6]
    assert np.mean([r["near_edited"] > 0.35 for r in long]) > 0.95
    one = fingerprints.against_next(spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.against_next(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "int", "string"])
def test_fingerprints_of_other_ids_and_of_many_rows_with_one(spark, kind):
    rng = random.Random(4)
    name = (lambda i: None if i is None else f"k{i:05d}") if kind == "string" else lambda i: i
    ids = [None] * 300 + [7] * 300 + list(range(20, 120))
    rows = [(name(i), None if n % 97 == 0 else " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n % 40)), "x") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, fingerprint string").repartition(3)
    got = fingerprints.against_next(df)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"], r["h"], r["t"]) for r in hashed), key=lambda r: (r[0], r[1] or 0 if kind != "string" else r[1] or "", *r[2:]))
    want = []
    for k, (_, i, _, t) in enumerate(order):
        n = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.show(fingerprints.fingerprint(t)), fingerprints.show(fingerprints.fingerprint(e))))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)
    # no run is much longer than others, though two ids hold most rows
    if kind == "int":
        sizes = [r["count"] for r in fingerprints.in_order(df, "doc_id", "text").where("not _ahead").groupBy("_run").count().collect()]
        assert max(sizes) < 150


def test_chunk_boundaries_move_little_after_an_edit():
    rng = random.Random(3)
    a = bytes(rng.randrange(97, 123) for _ in range(20_000))
    b = b"INSERTED" + a
    ca, cb = ({x[s:e] for s, e in fingerprints.chunks(x)} for x in (a, b))
    assert len(ca & cb) > 0.97 * len(ca)
    sizes = [e - s for s, e in fingerprints.chunks(a)]
    assert sum(sizes) == len(a) and max(sizes) <= fingerprints.LARGEST and min(sizes[:-1]) >= fingerprints.SMALLEST
    h = fingerprints.gear(np.frombuffer(a, np.uint8))
    for i in (0, 5, 31, 32, 1000):
        assert h[i] == sum(int(fingerprints.GEAR[a[i - d]]) << d for d in range(min(i + 1, 32))) % 2**32


def test_licenses(spark):
    rows = [(1, "Text.\nreleased UNDER the MIT license\nmore"), (2, None), (3, ""), (4, "Permission. This work is licensed under the GNU General Public License, version 3. And so it goes on and on here."), (5, "nothing of the kind"), (6, "All rights reserved."), (6, "All rights reserved.")]
    got = sorted((r["doc_id"], r["line"], r["licence"], round(r["score"], 3)) for r in licenses.scan(table(spark, rows)).collect())
    assert got == [(1, 1, "MIT", 1.0), (4, 0, "GPL-3.0", 1.0), (6, 0, "All-Rights-Reserved", 1.0), (6, 0, "All-Rights-Reserved", 1.0)]
    # every line against every template, without the bounds
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for r in documents(spark).collect():
        for at, line in enumerate(r["text"].split("\n")):
            words = licenses.normal(line)
            plain = max((licenses.dice(licenses.bigrams(words), b), n) for n, _, b in s.templates)[0] if words else 0
            if plain >= 0.8:
                assert any(m[0] == at and abs(m[2] - plain) < 1e-12 for m in s.scan(r["text"]))


def test_licences_across_lines_several_a_line_and_whole(spark):
    apache, mit = licenses.full_texts()["Apache-2.0"], licenses.full_texts()["MIT"]
    rows = [
        (1, "Intro.\nLicensed under the Apache License,\nVersion 2.0.\nmore"),
        (2, "Released under the MIT License. All rights reserved. Licensed under CC BY-NC 4.0. All rights reserved."),
        (3, "some words before\n\n" + mit + "\nsome words after\nAll rights reserved."),
        (4, "one line with " + " ".join(apache.split()) + " and then: Released under the MIT License."),
        (5, "of the and of the " * 3000),
        (6, mit.replace("sublicense", "rent").replace("Software", "Program", 3)),
    ]
    got = [(r["doc_id"], r["line"], r["licence"], r["score"]) for r in licenses.scan(table(spark, rows)).orderBy("doc_id").collect()]
    assert [x for x in got if x[0] < 5] == [
        (1, 1, "Apache-2.0", 1.0), (2, 0, "MIT", 1.0), (2, 0, "All-Rights-Reserved", 1.0), (2, 0, "CC-BY-NC-4.0", 1.0), (2, 0, "All-Rights-Reserved", 1.0),
        (3, 2, "MIT", 1.0), (3, len(mit.split("\n")) + 3, "All-Rights-Reserved", 1.0), (4, 0, "Apache-2.0", 1.0), (4, 0, "MIT", 1.0),
    ]
    assert [(x[0], x[2]) for x in got if x[0] >= 5] == [(6, "MIT")] and 0.8 < got[-1][3] < 1
    # on lines of words of short notices: what is found, against all stretches that are like a notice
    notices = {"x": "a b c d", "y": "c d e f g", "z": "h i"}
    s = licenses.Scanner(notices, 0.8)
    rng = random.Random(9)
    for _ in range(200):
        w = [rng.choice("abcdefghi") for _ in range(rng.randrange(2, 16))]
        found = s.scan("\n".join(w))
        like = {(i, n): d for i in range(len(w)) for j in range(i + 2, len(w) + 1) for n, t in notices.items() if (d := licenses.dice(licenses.bigrams(w[i:j]), licenses.bigrams(t.split()))) >= 0.8}
        assert bool(found) == bool(like) and all((line, n) in like and score >= 0.8 for line, n, score in found)
    # each whole licence is found as itself
    s = licenses.Scanner([*licenses.TEMPLATES.items(), *licenses.full_texts().items()], 0.8)
    for name, text in licenses.full_texts().items():
        assert [m[1:] for m in s.scan(text)] == [(name, 1.0)]
    # the best stretch against all stretches
    rng = random.Random(4)
    s = licenses.Scanner({"x": "a b c d a b e", "y": "c d e"}, 0.8)
    for _ in range(300):
        w = [rng.choice("abcdef") for _ in range(14)]
        plain = max(licenses.dice(licenses.bigrams(w[i:j]), b) for i in range(13) for j in range(i + 2, 15) for _, _, b in s.templates)
        got = s.scan("\n".join(w))
        assert bool(got) == (plain >= 0.8)
    # a stretch that would be best with words of the next notice
    s = licenses.Scanner({"x": "a b c d e f g", "y": "f h i j k l m n o p"}, 0.8)
    assert [m[1] for m in s.scan("a b c d e f h i j k l m n o p")] == ["x", "y"]


FOREIGN = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej Deklaracji",
}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs, ~held)
    assert set(model.langs) == {"en", "fr", "de", "es"} and 4 <= len(model.langs) <= 4 * langid.CENTROIDS
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang", held.alias("h"), "n_chars"), "doc_id").where("h").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["n_chars"] > 200]) > 0.98
    assert np.mean([r["rejected"] for r in got]) < 0.02
    odd = {r["doc_id"]: r for r in langid.predict(table(spark, enumerate(ODD + ["12 34 !!", "你好" * 300])), model).collect()}
    for i in (0, 1, 2, len(ODD)):
        assert (odd[i]["lang_pred"], odd[i]["score"], odd[i]["rejected"]) == ("und", 0.0, True)
    assert odd[len(ODD) + 1]["rejected"] and odd[3]["lang_pred"] != "und"
    assert langid.fit(docs.limit(0)).predict("text") == ("und", 0.0, True)
    assert langid.predict(docs.limit(0), model).count() == 0
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() > 950


def test_language_is_that_of_the_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang_pred", F.lit("clash")).withColumn("_lang", F.lit(1))
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        # counts in a plain loop, cosines without the operator's functions
        letters = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in r["text"].lower().encode())
        b = (" " + " ".join(letters.split(" ")) + " ").encode("latin-1")
        b = b" " + b" ".join(b.split()) + b" "
        c = np.zeros(langid.DIMS)
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            c[(((x << 16 | y << 8 | z) * 2654435761) % 2**32) >> 20] += 1
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * model.idf
        cos = [float(np.dot(v, k) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(k, k))) for k in model.centroids.astype(float)]
        lang, score, rejected = got[r["doc_id"]]
        assert abs(score - max(cos)) < 1e-4 and max(s for s, n in zip(cos, model.langs, strict=True) if n == lang) > max(cos) - 1e-5
        assert rejected == (1 - score > model.farthest[lang][min(langid.CLASSES - 1, int(np.log2(c.sum() + 1)))])


def test_language_is_learned_whatever_the_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for df in (docs.withColumn("doc_id", F.lit(None).cast("long")), docs.union(docs).union(docs).withColumn("doc_id", F.lit(7).cast("long"))):
        model = langid.fit(df, sample=50)
        assert set(model.langs) == {"en", "fr", "de", "es"}
        got = langid.predict(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("n > 200").collect()
        assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_rejects_what_is_in_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    good = quality.accepted(docs)
    rng = random.Random(2)
    odd = [*FOREIGN.values(), " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(80))]
    odd += ["for (int i = 0; i < n; i++) { if (buf[i] == 0xff) { ptr->next = malloc(sizeof(struct node)); memset(ptr, 0, sizeof(*ptr)); } } " * 4, "你好世界" * 100]
    # one row with a wrong label changes nothing
    for df in (good, good.union(spark.createDataFrame([(10**9, FOREIGN["it"], "es")], docs.schema))):
        model = langid.fit(df)
        assert all(model.predict(t)[2] for t in odd)
        assert langid.accepted(good, model).count() >= 0.995 * good.count()


def test_packing_places_all_pieces(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    special = ["hello <|startoftext|> world", "<|endoftext|>", "a<|endoftext|>b <|STARTOFTEXT|>", "<|endoftext|> " + "word " * 5000]
    own = [(10**6 + i, x) for i, x in enumerate(ODD + special)] + [(5, "twice"), (5, "twice"), (None, "no id"), (None, "no id")]
    docs = documents(spark).select("doc_id", "text").unionByName(table(spark, own).select("doc_id", "text")).withColumn("_salt", F.lit("clash")).withColumn("length", F.lit(-1)).withColumn("_at", F.lit(0))
    rows = packing.pack(docs, path).collect()
    # every piece: where it starts, how long it is, which ids it has
    want = Counter()
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[r["doc_id"], k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert packing.pack(docs.limit(0), path).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.randrange(1, 60)
        counts = Counter(rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 120)))
        used, seen = defaultdict(list), defaultdict(set)
        for length, rank, n, first, each, offset in packing.plan(counts, cap):
            for r in range(rank, rank + n):
                assert r not in seen[length]
                seen[length].add(r)
                used[first + (r - rank) // each].append((offset + length * ((r - rank) % each), length))
        assert {k: len(v) for k, v in seen.items()} == dict(counts)
        for s in used.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= cap
        bins = []  # best-fit decreasing, piece by piece
        for length in sorted(counts.elements(), reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= length]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= length
            else:
                bins.append(cap - length)
        assert len(used) == len(bins)


def test_url_parts_and_rules(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    rows = [(1, "http://A.Example.NET/en/x?q", "net"), (2, "https://x.example.net?en/", None), (3, None, "h"), (4, "no scheme", ""), (5, "ftp://example.com/de/#a", ""), (6, "http://notexample.com/de/", ""), (7, "http://Ä.org/fr/ \n", ""), (7, "http://Ä.org/fr/ \n", "")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1)), rules).collect())
    assert got[0] == (1, "a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][1:4] == ("x.example.net", "", None) and got[2] == (3, "", "", None, "allow") and got[3] == (4, "", "", None, "allow")
    assert got[4] == (5, "example.com", "/de/", "example.com/de/", "block") and got[5][3:] == (None, "allow")
    assert got[6] == got[7] == (7, "Ä.org", "/fr/ \n", "org/fr/", "allow")


def test_trust_and_distrust_follow_links(spark):
    rules = {"bad.com/": "block", "good.org/": "allow"}
    rows = [("http://bad.com/1", ""), ("http://good.org/1", '<a href="https://friend.io/x">'), ("http://friend.io/", ""), ("http://spam.io/", "<a HREF='http://bad.com/'><a href=\"//BAD.com/z\">"), ("http://lone.io/", "<a href='/local'>"), ("http://www.bad.com.io/", "")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in urlgraph.judge(pages, rules).collect()}
    assert got == {"bad.com": "block", "good.org": "allow", "friend.io": "allow", "spam.io": "block", "lone.io": "allow", "www.bad.com.io": "allow"}


def test_distrust_does_not_depend_on_how_many_link(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "good.org/": "allow", "part.com/de/": "block"}
    ten = "".join(f'<a href="http://bad{k}.net">' for k in range(10))  # blocked by a host-wide rule, not crawled
    rows = [(f"http://farm{i}.io/", ten) for i in range(100)]
    rows += [("http://crawled.net/1", ""), ("http://one.io/", "<a href=//crawled.net/>"), ("http://two.io/", "<a href=//crawled.net/>")]
    rows += [("http://mixed.io/", "<a href=//crawled.net/><a href=//good.org/><a href=//other.io/>"), ("http://rule.io/", "<a href='http://example.net/en/x'>")]
    rows += [("http://path.io/", "<a href='http://part.com/de/x'>"), ("http://path2.io/", "<a href='http://part2.com/de/x'>")]
    rows += [("http://good.org/1", '<a href="http://friend.io/">'), ("http://friend.io/", "<a href=//crawled.net/>")]
    chain = ["http://c0.io/", *(f"http://c{k}.io/" for k in range(1, 6)), "http://crawled.net/"]  # 0.85 ** 4 is above 0.5, ** 5 is not
    rows += [(u, f"<a href='{v}'>") for u, v in itertools.pairwise(chain)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in urlgraph.judge(pages, rules).collect()}
    want = {f"farm{i}.io": "block" for i in range(100)} | {"crawled.net": "block", "one.io": "block", "two.io": "block", "mixed.io": "allow", "rule.io": "allow"}
    want |= {"path.io": "block", "path2.io": "allow", "good.org": "allow", "friend.io": "allow"} | {f"c{k}.io": "allow" if k < 2 else "block" for k in range(6)}
    assert got == want


def test_very_long_pages_of_links(spark):
    """Links are found to the end of a page; what looks like a link but is none, or never ends, is passed over."""
    filler = "<p>href = no link // href='" * 40_000 + "x" * 300_000
    rows = [("http://a.io/", filler + "'><a href='http://bad.com/x'>" + "<a href=" * 50_000), ("http://b.io/", filler + "'>" + "<a href='//bad.com/y'>" * 20_000), ("http://c.io/", filler), ("http://bad.com/", "")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in urlgraph.judge(pages, {"bad.com/": "block"}).collect()}
    assert got == {"a.io": "block", "b.io": "block", "c.io": "allow", "bad.com": "block"}


def test_urls_by_sql(spark):
    """The query's SQL over a linked graph: cycles, several links, hosts without links out, parent domains, uncrawled targets."""
    import duckdb

    rng = random.Random(10)
    hosts = [f"{a}{i}.{b}" for i in range(8) for a, b in (("h", "io"), ("b", "net"), ("o", "org"), ("e", "example.com"))] + ["io", "x.h1.io", "example.com", "www.example.net"]
    rows = []
    for i in range(300):
        links = "".join(f"<a href={q}{s}//{rng.choice(hosts + ['far.net', 'far.io'])}{rng.choice(['', '/', '/fr/x', '/de/', '/en/y?z'])}{q}>" for q, s in [(rng.choice("\"'"), rng.choice(["", "http:", "HTTPS:"])) for _ in range(rng.randrange(4))])
        rows.append((i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/fr/', '/de/a', '/en/'])}", None if i % 50 == 0 else links))
    rows += [(1000, None, "x"), (1001, "no scheme", None), (1000, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = sorted(map(repr, (tuple(r) for r in urlgraph.judge(pages, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())))
    assert got == sorted(map(repr, con.execute(sql.urls()).fetchall()))
    assert len({r["host"] for r in urlgraph.judge(pages, queries.URL_RULES).where("rule is null and verdict = 'block'").collect()}) >= 1
    assert urlgraph.judge(pages.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("cold", [256, 3])
def test_host_scores_settle_as_a_plain_loop_does(spark, monkeypatch, cold):
    """Also with hosts that most link to, or that link to most, dealt in parts."""
    monkeypatch.setattr(common, "COLD_ROWS", cold)
    rng = random.Random(8)
    names = [f"h{i}.io" for i in range(60)]
    ruled = {h: ("allow" if i % 2 else "block") for i, h in enumerate(names[:12])}
    pairs = [(a, b) for a in names for b in {*rng.sample(names, 4), names[20]} | ({*names[:40]} if a == names[30] else set()) if a != b]
    pages = spark.createDataFrame([(i, f"http://{a}/", f"<a href='http://{b}/'>") for i, (a, b) in enumerate(pairs)], "page_id long, url string, html string")
    named = pages.select(*(c.alias(n) for c, n in zip(urlgraph.parts(F.col("url")), ("host", "path"), strict=True)), "html")
    rules = {f"{h}/": v for h, v in ruled.items()}
    links = urlgraph.edges(named, "host", "html", rules)
    counts = [(h, 1, int(ruled.get(h) == "allow"), int(ruled.get(h) == "block")) for h in names]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlgraph.host_scores(spark.createDataFrame(counts, "host string, n long, allowed long, blocked long"), links).collect()}
    for k, kind, ends in ((0, "allow", lambda h: [a for a, b in pairs if b == h]), (1, "block", lambda h: [b for a, b in pairs if a == h])):
        s = dict.fromkeys(names, 0.0)
        for _ in range(300):
            s = {h: float(ruled[h] == kind) if h in ruled else 0.85 * (np.mean([s[x] for x in ends(h)]) if ends(h) else 0) for h in names}
        assert max(abs(got[h][k] - s[h]) for h in names) < 1e-5


def brute_duplicates(texts, k, num, den):
    def grams(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    g = {i: grams(t) for i, t in texts}
    up = {i: i for i in g}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in g.items():
        for x in s:
            holders[x].append(i)
    both = Counter(p for v in holders.values() for p in itertools.combinations(sorted(v), 2))
    for (a, b), c in both.items():
        if den * c >= num * (len(g[a]) + len(g[b]) - c):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: (len(g[i]), top(i)) for i in g}


def chain(rng, n, words=60):
    """Texts of which each is a few words from the last: long chains and many of one origin."""
    base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(words)]
    out, now = [], list(base)
    for i in range(n):
        own = list(now if i % 2 else base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(words)] = "new" + str(rng.randrange(10**6))
        now = own
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "threshold", "block"), [(3, 0.85, 256), (3, 0.85, 8), (5, 0.8, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, k, threshold, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(k + block)
    texts = [t for n in (40, 25, 12) for t in chain(rng, n)] + ODD + ["Exact Copy of words", "exact copy OF  words", "one", "one", "two words", "two  words"]
    texts += [r["text"] for r in documents(spark).collect()]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows), k, threshold).collect()}
    want = brute_duplicates(sorted(rows), k, round(threshold * 100), 100)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lonely text here now"), (3, None), (4, ""), (2, "A B C D")]
    got = sorted(map(tuple, neardup.near_duplicates(table(spark, rows), 3, 0.85).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=repr)
    kept = neardup.distinct_documents(table(spark, rows), 3, 0.85)
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted([(1, "a b c d"), (3, None), (4, ""), (None, "a b c d"), (None, "lonely text here now")], key=repr)
    assert kept.columns == table(spark, []).columns
    assert neardup.near_duplicates(table(spark, []), 3, 0.85).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(300, 340)] + [(1, 1), (None, 3)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    want = {x: top(x) for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


@pytest.mark.parametrize("order", ["ascending", "random", "star"])
def test_components_take_logarithmic_rounds(spark, monkeypatch, order):
    n = 5000
    at = list(range(n))
    if order == "random":
        random.Random(6).shuffle(at)
    pairs = [(0, i) for i in range(1, n)] if order == "star" else list(itertools.pairwise(at))
    steps, plain = [], common.Scratch.cut
    monkeypatch.setattr(common.Scratch, "cut", lambda self, df, what="cut": (steps.append(what), plain(self, df, what))[1])
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert got.count() == n and got.where("label != 0").count() == 0
    assert steps.count("down") <= 2 * 13  # steps along pointers: 2 log2 n


def test_near_duplicates_of_any_ids_and_very_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(long), " ".join(long[:-50]), " ".join(long[:40_000])] + chain(rng, 12) + ["Same text of words", None, "", "same text of WORDS"]
    rows = list(enumerate(texts))
    want = brute_duplicates(rows, 3, 85, 100)
    for kind in ("int", "string", "date"):
        name = {"int": lambda i: i, "string": lambda i: f"d{i:03d}", "date": lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)}[kind]
        df = spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 3, 0.85).collect()}
        assert got == {name(i): (n, name(c), c == i) for i, (n, c) in want.items()}
        assert {r["doc_id"] for r in neardup.distinct_documents(df, 3, 0.85).collect()} == {name(c) for _, c in want.values()}
    more = spark.createDataFrame([("x", "one of two texts"), ("x", "one of two texts"), (None, "no id here"), ("y", "One of TWO texts")], "doc_id string, text string")
    got = sorted(map(tuple, neardup.near_duplicates(more, 3, 0.85).collect()), key=repr)
    assert got == sorted([("x", 2, "x", True)] * 2 + [("y", 2, "x", False), (None, 1, None, True)], key=repr)


def test_near_duplicates_leave_other_columns_alone(spark):
    names = ["kept_id", "__kept", "bucket", "rep", "hub", "label", "size", "_text", "n", "_set", "_part"]
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b c d", "y"), (3, "other words are here", "z")], "doc_id long, text string, v string")
    df = df.select("doc_id", "text", *[F.col("v").alias(n) for n in names])
    kept = neardup.distinct_documents(df, 3, 0.85)
    assert kept.columns == df.columns and {(r["doc_id"], r["rep"]) for r in kept.collect()} == {(1, "x"), (3, "z")}


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "COLD_ROWS", 10)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.join_groups(rows, groups, "key", "id", 1000)
    assert sorted((r["id"], r["key"], r["n"], r["least"]) for r in got.collect()) == [(i, 0 if i % 3 == 0 else i, 334 if i % 3 == 0 else 1, 0 if i % 3 == 0 else i) for i in range(1000)]


def test_sketches_of_pairs_at_the_threshold_pass_the_bound():
    rng = np.random.default_rng(7)
    for threshold in (0.8, 0.85):
        t = neardup.bands(threshold) * neardup.BAND
        least, misses, apart = neardup.least_equal(t, threshold), 0, 0
        for _ in range(300):
            x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
            both = round(600 * 2 * threshold / (1 + threshold))
            a, b = np.unique(x[:600]), np.unique(x[600 - both : 1200 - both])
            same = (np.frombuffer(neardup.short(a, t), "<u2") == np.frombuffer(neardup.short(b, t), "<u2")).sum()
            misses += same < least
            c = np.unique(x[400:1000])
            apart += (np.frombuffer(neardup.short(a, t), "<u2") == np.frombuffer(neardup.short(c, t), "<u2")).sum() < least
        assert (misses, apart) == (0, 300)


def test_sketch_estimates_the_similarity():
    rng = np.random.default_rng(2)
    for size, both in ((3, 2), (40, 30), (400, 300), (4000, 1000)):
        x = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        a, b = np.unique(x[:size]), np.unique(x[size - both : 2 * size - both])
        sa, sb = neardup.sketch(a, 1000), neardup.sketch(b, 1000)
        assert (sa != neardup.FULL).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sa == sb).mean() - true) < 0.12 if size < 10 else abs((sa == sb).mean() - true) < 0.06


def test_quality(spark):
    prose = " ".join(f"the word{i} of text{i} is" for i in range(30))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, prose), (101, prose.replace(" ", "*** ")), (102, "\n".join(["the same line of the text is here"] * 12)), (103, (prose + "!! ").replace(" ", "!! ")), (104, prose), (104, prose)]
    got = [r.asDict() for r in quality.judge(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    for r, (_i, t) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda x: x[0]), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if g[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cov))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cov) > 50 * len(w))
    kept = sorted(r["doc_id"] for r in got if r["kept"])
    assert kept == [100, 104, 104]
    out = quality.accepted(table(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == kept and out.columns == table(spark, []).columns
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text


def test_warc_round_trip(spark):
    long = "<p>" + "zü" * 200
    rows = [(5, "http://a/\r\nb", long), (3, "http://b", long), (9, None, long), (3, "http://b", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "n", long)] + [(100 + i, f"http://h/{i}", f"<html>page {i % 50} " + "same words " * 40) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    made = warc.write(pages)
    back = warc.read(made).collect()
    assert len(back) == len(rows) and sum(r["records"] for r in made.collect()) == len(rows)
    html = defaultdict(set)
    for i, _, h in rows:
        html[i].add((h or "").encode())
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h.encode()] = min(i, first.get(h.encode(), i))
    for r in back:
        (p,) = html[r["page_id"]]
        revisit = p in first and first[p] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"]) == (len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response")
        assert r["refers_to"] == (first[p] if revisit else None) and r["payload"] == (None if revisit else p)
    uri = made.collect()[0]["archive"].removeprefix("file://")
    assert any(open(r["archive"].removeprefix("file://"), "rb").read(4) == b"\x5d\x2a\x4d\x18" for r in made.collect()), uri
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    now = docs
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, now, "/root/testdata/sf0.01")
        assert after.columns == docs.columns, name
        if name == "quality":
            bad = after.join(labels.where("quality = 0"), "doc_id").count()
            lost = now.join(labels.where("quality = 1"), "doc_id").join(after, "doc_id", "left_anti").where("size(split(text, '[ \\n]+')) > 60").count()
            assert (bad, lost) == (0, 0)
        if name == "language":
            assert after.count() >= 0.99 * now.count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in now.collect()]
            want = {c for _, c in brute_duplicates(rows, 5, 80, 100).values()}
            assert {r["doc_id"] for r in after.collect()} == want
        now = after
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert packed.select("doc_id").distinct().count() == now.count()


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, and the empty table, through all stages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.orderBy(F.desc(F.length("text"))).limit(1).select((F.col("doc_id") + 10**7).alias("doc_id"), F.repeat("text", 5).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (None, "no id " * 5, "xx", "s", 1)], docs.schema)
    every = docs.union(docs.limit(20)).union(odd).union(long)
    for n in ("bands", "__kept", "kept_id", "__text", "__row", "_salt", "length", "label", "size", "hub"):
        every = every.withColumn(n, F.lit("clash"))
    (tmp_path / "some").mkdir()
    every.write.parquet(str(tmp_path / "some/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    plain = corpus_pipeline.run(spark, SF)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    assert ids(got) - {r["doc_id"] for r in long.collect()} == ids(plain)
    assert got.groupBy("doc_id", "piece").count().where("count > 1").count() == 0
    (tmp_path / "none").mkdir()
    every.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
