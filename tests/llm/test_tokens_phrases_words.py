"""Token files, phrase collocations and spelling variants against the library and plain loops."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import collocations, common, queries, tokenfiles, variants

SF = "/root/testdata/sf0.001"
BYTES = P.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t ", "a", "Der Fluß!", "x" * 3000, "word " * 4000, "tab\tand\x0bvt\x1cfs　wide  nbsp", "é é 你好 \U0001f600\U0001f600", "  two  spaces\n\n\nlines \r\n",
    "it's we'll I'd 12345 1a2b3c ٠١", "a<|endoftext|>b", "\x00", "a\x00 b\x00", "\n", "\nx", " x", "x\n", "x \n", "Ġa Ċb", "a\n \nb \n c\t \td\n\t",
]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, monkeypatch, name):
    monkeypatch.setattr(tokenfiles, "MEMO", 500)  # words come and go
    own, lib = tokenfiles.Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert own.by_words == (name == "byte_bpe_50k.json")
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab  \n\néth'1　\t!e\x00\xa0Ġ\x85") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r["text"] or "" for r in documents(spark).collect()]
    for at in range(0, len(texts), 211):
        some = texts[at : at + 211]
        for t, ids in zip(some, own.encode(some), strict=True):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def expected(rows, end=2):
    """(id, start, n, crc) in order of the ids; rows with one id as a multiset."""
    lib, at, out = Tokenizer.from_file(BYTES), 0, []
    for key, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_hold_documents_in_order(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + list(enumerate(ODD, 10**6)) + [(-5, "first")]
    random.Random(1).shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({n: F.lit("clash") for n in ("_id", "_text", "_row", "part", "start", "n_tokens", "lang")})
    folder = tokenfiles.write(table, BYTES, end_id=2)
    got = sorted(map(tuple, tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(sorted(docs))
    # what the files are: tokens of two bytes one after another, where each document begins, and the ids beside
    parts = tokenfiles.manifest(spark, folder).orderBy("part").collect()
    assert len(parts) > 1
    raw, starts, keys = b"", [], []
    for p in parts:
        assert (p["first_document"], p["first_token"]) == (len(keys), len(raw) // 2)
        path = f"{folder.removeprefix('file://')}/part-{p['part']:06d}"
        head = open(f"{path}.idx", "rb").read()
        assert tokenfiles.HEADER.unpack(head[: tokenfiles.HEADER.size]) == (b"TOKENIDX", 1, 2, p["documents"])
        own = np.frombuffer(head, "<i8", offset=tokenfiles.HEADER.size)
        starts += (own[:-1] + len(raw) // 2).tolist()
        keys += pa.ipc.open_file(f"{path}.ids").read_all()["id"].to_pylist()
        data = open(f"{path}.bin", "rb").read()
        assert own[-1] == p["tokens"] == len(data) // 2
        raw += data
    assert keys == sorted(keys) and starts == [r[1] for r in got]
    assert not [f for f in pa.fs.LocalFileSystem().get_file_info(pa.fs.FileSelector(folder.removeprefix("file://"))) if f.base_name.startswith(".part")]
    one = tokenfiles.Part(folder, parts[0]["part"])
    whole = {r["doc_id"]: r["ids"] for r in tokenfiles.read(spark, folder, tokens=True).collect()}
    at = one.offsets(0, one.documents)
    for i, key in enumerate(one.ids(0, one.documents).to_pylist()):
        assert one.tokens(at[i], at[i + 1]).tolist() == whole[key]
    one.mapped = None  # as where files are not local: by ranges
    assert one.tokens(3, 9).tolist() == np.frombuffer(raw, "<u2")[3:9].tolist()


def test_token_files_of_odd_ids(spark, monkeypatch):
    """A third of the rows have one id, some none; ids may be texts; many blocks a file; the empty table."""
    monkeypatch.setattr(tokenfiles, "BLOCK", 7)
    rows = [(5, f"text {i}") for i in range(100)] + [(None, "no id"), (None, None)] + [(i, f"other {i}") for i in range(200)]
    folder = tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTES, end_id=2)
    got = sorted((tuple(r) for r in tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None] + sorted(k for k, _ in rows if k is not None)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((k, n, c) for k, _, n, c in expected(rows))
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:], strict=False))
    named = spark.createDataFrame([("b", "x"), ("a", "y z"), (None, "w")], "name string, body string")
    back = tokenfiles.read(spark, tokenfiles.write(named, BYTES, end_id=2, id_col="name", text_col="body"), "string").orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, "a", "b"]
    empty = tokenfiles.write(named.limit(0), BYTES, id_col="name", text_col="body")
    assert tokenfiles.read(spark, empty, "string").count() == 0 and tokenfiles.manifest(spark, empty).count() == 0
    wide = tokenfiles.write(spark.createDataFrame([(1, "x")], "doc_id int, text string"), BYTES, end_id=70_000)
    assert tokenfiles.Part(wide, tokenfiles.manifest(spark, wide).first()["part"]).dtype.itemsize == 4
    assert tokenfiles.read(spark, wide, "int", tokens=True).first()["ids"][-1] == 70_000


def phrases(rows, most=3, least=10, best=2000, share=50):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for p in re.split("[.,;:!?\x0a-\x0d]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found, longer, own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, Counter(), []
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        for p, a in found.items():
            if p not in longer or 100 * longer[p] < share * a:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize(("every", "held", "bits"), [(16, 200_000, 1 << 26), (2, 50, 64)])
def test_phrases_against_a_plain_loop(spark, monkeypatch, every, held, bits):
    """Chunks long and short, sums given on often, a bit map that is full."""
    monkeypatch.setattr(collocations, "EVERY", every)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "MAP_BITS", bits)
    rng = random.Random(5)
    rows = [(r["lang"], r["text"]) for r in documents(spark).collect()][:60]
    rows += [(None, "The cat. The dog the dog THE dog" * 7), ("en", None), ("en", ""), ("en", " \t "), ("en", "a b c d e f g h. " * 30), ("en", "...,,"), ("x", "a a a a a a a a a a a a a a"), ("x", "b\x1ca  c\td É É ÉÀ " * 40), ("en", "1 2 3 4 5 6 7 8 9 10 " * 1000)]
    rows += [("mix", " ".join(rng.choice("ab.cd,e\tf é") for _ in range(400))) for _ in range(20)] * 3
    df = spark.createDataFrame([(t, g, 1, "clash") for g, t in rows], "text string, lang string, n int, chunk string")
    for most, least, best in ((3, 10, 2000), (4, 3, 7), (2, 5, 50)):
        assert sorted(map(tuple, collocations.mine(df, most, least, best).collect())) == phrases(rows, most, least, best)
    assert collocations.mine(df.limit(0)).count() == 0


def test_each_different_word_of_a_batch_is_looked_at_once():
    """What is counted in a block is its different words and phrases, not each of their places."""
    texts = ["a b a b c", "a b a b", "x", "b a b c"] * 50
    batch = pa.record_batch([pa.array(["en"] * 200), pa.array(texts), pa.array([0, 2, 0, 0] * 50, pa.int32()), pa.array([1, 2, 3, 4] * 50, pa.int64())], ["lang", "chunk", "context", "n"])
    (block,) = collocations.blocks(batch)
    assert sorted(block.known.to_pylist()) == [b".", b"a", b"b", b"c", b"x"] and len(set(collocations.mixed_bytes(block.known))) == 5
    want = defaultdict(int)
    for text, context, n in [("a b a b c", 0, 1), ("a b a b", 2, 2), ("x", 0, 3), ("b a b c", 0, 4)]:
        words = text.split()
        for k in range(1, 6):
            for i in range(min(len(words) - k + 1, len(words) - context)):
                want[k, " ".join(words[i : i + k]).encode()] += 50 * n
    got = [((k, p), n) for k, found, total in collocations.phrases(block, np.r_[block.whole, False], 5) for p, n in zip(found.to_pylist(), total.tolist(), strict=True)]
    assert dict(got) == want and len(got) == len(want)


def test_phrase_arithmetic_is_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 3_000_000_019
    found = [("x", 0, "", 10**12), ("x", 1, "a", big * 7 + 3), ("x", 1, "b", big * 5), ("x", 2, "a b", big * 4 + 1), ("x", 1, "c", big), ("x", 2, "b c", big // 3)]
    df = spark.createDataFrame(found, "lang string, words int, phrase string, n long")
    real = collocations.counts
    try:
        collocations.counts = lambda *_: df
        got = {r["phrase"]: r["score"] for r in collocations.mine(spark.createDataFrame([("x", "a")], "lang string, text string")).collect()}
    finally:
        collocations.counts = real
    a, b = big * 4 + 1, big // 3
    assert got == {"a b": 10**6 * a * a // ((big * 7 + 3) * big * 5), "b c": 10**6 * b * b // (big * 5 * big)}


def test_a_chunk_is_the_same_wherever_it_stands():
    """Each phrase begins in one chunk, before the words that the next one shares; a passage gives the same chunks in any text."""
    rng = random.Random(2)
    passage = [rng.choice("abcdefgh").encode() * rng.randrange(1, 4) for _ in range(400)]
    for overlap in (1, 2, 3):
        seen = []
        for _ in range(2):
            words = [rng.choice("xyz").encode() for _ in range(rng.randrange(50))] + passage + [b"."] + [b"q"] * rng.randrange(20)
            made = list(collocations.chunks(words, overlap))
            assert sum(([*c.split(b" ")][: len(c.split(b" ")) - k] for c, k in made), []) == words
            assert all(a.split(b" ")[-k:] == b.split(b" ")[:k] for (a, k), (b, _) in zip(made, made[1:], strict=False))
            seen.append({c for c, _ in made})
        assert sum(len(c.split(b" ")) for c in seen[0] & seen[1]) > 300


def neighbours(words):
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            holes[i, x].add(w)
            if x in words:
                near[w].add(x)
                near[x].add(w)
    for g in holes.values():
        for a in g:
            near[a] |= g - {a}
    return near


@pytest.mark.parametrize("levels", [24, 2])
def test_near_words_against_all_edits(spark, monkeypatch, levels):
    """Short and very long words, repeated signs, words within one another, null, empty and repeated rows."""
    monkeypatch.setattr(variants, "LEVELS", levels)
    rng = random.Random(1)
    words = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(1, 8))) for _ in range(600)} | {"x" * 80, "x" * 79, "x" * 81, "y" + "x" * 79, "x" * 40 + "z" + "x" * 40, "ab" * 40, "ab" * 40 + "a", "ab" * 150, "ab" * 150 + "c"}
    near = neighbours(words)
    got = [tuple(r) for r in variants.near_pairs(spark.createDataFrame([(w,) for w in [*words, None, "", "ab", "ab"]], "word string")).collect()]
    assert set(got) == {tuple(sorted((a, b))) for a in near for b in near[a]} and len(got) == len(set(got))
    assert variants.near_pairs(spark.createDataFrame([], "word string")).count() == 0


def test_variants_against_a_plain_loop(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [(None, "spelling spelling"), (1, None), (2, ""), (3, "Spelling SPELLING ÀÉàé× ÷" * 3), (4, "x" * 500 + " ok"), (5, "spelling " * 60), (5, "speling spellings " * 6), (6, "naïve-naïve" * 4)]
    for spoil in (199, None):
        c = Counter()
        for key, text in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = lower(w)
                h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
                c[w[: h % len(w)] + w[h % len(w) + 1 :] if spoil and h % spoil == 0 else w] += 1
        known = {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}
        near, form = neighbours(known), {}
        for w, n in known.items():
            if near[w] and known[best := min(near[w], key=lambda x: (-known[x], x))] >= 5 * n:
                form[w] = best

        def root(w, form=form):
            while w in form:
                w = form[w]
            return w

        df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, word string, n long")
        got = [tuple(r) for r in variants.group(variants.words(df, spoil=spoil)).collect()]
        assert sorted(got) == sorted((w, form.get(w), root(w), n, len(near[w]), known[form[w]] if w in form else None) for w, n in known.items())
    assert variants.group(variants.words(df.limit(0))).count() == 0


def test_long_chains_of_forms_end_at_one_root(spark):
    chain = [("a" * (6 + i), 5 ** (12 - i)) for i in range(12)]  # each is near the one before, five times as frequent
    got = {r["word"]: r for r in variants.group(spark.createDataFrame([*chain, (None, 4), ("zzzzzz", 9), ("zzzzzz", 1)], "word string, n long")).collect()}
    assert {r["root"] for w, r in got.items() if w != "zzzzzz"} == {"aaaaaa"} and got["zzzzzz"]["n"] == 10 and got["zzzzzz"]["form"] is None
    assert all(got[b[0]]["form"] == a[0] and got[b[0]]["form_n"] == a[1] for a, b in zip(chain, chain[1:], strict=False))


@pytest.mark.parametrize("name", ["op12_collocations", "op13_variants"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from tidemill.llm import sql

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({sql.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_op11_against_the_library(spark):
    got = sorted((tuple(r) for r in queries.op11_tokens(spark, SF).collect()), key=lambda r: r[1])
    assert got == expected(sorted((r["doc_id"], r["text"]) for r in documents(spark).collect()))


def test_nothing_is_left_but_the_result(spark, tmp_path):
    """Of a run of the pipeline, in the shared folder."""
    import os

    import corpus_pipeline

    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    rows = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
    assert len(left) == 1 and left.pop().startswith("packing-") and rows.count() > 0
