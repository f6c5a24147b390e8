"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: t coordinates. In each of the first t rounds every shingle falls into a hashed bin; a bin
keeps its smallest (round, hash). Round t + j gives bin j the smallest hash of all shingles, so after
2t rounds every coordinate is filled; most sets fill all in two or three rounds, where the work stops.
Equal coordinates have the probability of the Jaccard similarity, with its concentration bounds.

Documents with equal shingle sets are one class from the start, so thousands of exact copies cost one
sketch. Classes that agree on all coordinates of a band share a bucket. In each bucket every class is
compared with the one of the smallest id (no pairs among the others), first with the one that it shares
most buckets with, then with those that it is still apart from. Buckets that after this hold several
components are compared in blocks of bounded size, all against those outside the main component, so that
no link is lost; a block only emits links that join what was apart. Texts only move for pairs whose sketches
agree on about as many coordinates as the threshold asks for, and links are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, components, cut, free, join_groups, numbered, only, release, remember, short_batches, tasks, whole_numbers

#: Coordinates of a band.
BAND = 5
#: Most that the chance may be of a pair just at the threshold sharing no band, and again of its sketches agreeing on too little.
MISS = 1e-6
#: Members of one block, and shingles of all of them, about (a longer text is a block with others' shingles beside it).
BLOCK = 256
BLOCK_SHINGLES = 1 << 22
#: Partners that one copy of a hub's text meets: fewer than a block, since each copy costs one text alone.
PARTNERS = 64
#: Ids of documents to verify that may be sent to all executors (8 bytes each); more are joined by a shuffle.
SEND = 1_000_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**BAND))


def least_equal(t: int, threshold: float) -> int:
    """Coordinates, of t, that two sketches agree on at least, but for a chance of MISS, where the similarity is the threshold."""
    below = accumulate(math.comb(t, k) * threshold**k * (1 - threshold) ** (t - k) for k in range(t + 1))
    return sum(1 for p in below if p <= MISS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Words whose hashes a Python worker remembers at most, about 200 bytes each.
REMEMBERED = 100_000


class Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()
remember("words", _words.clear)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles. Words: stretches without ASCII white space, A-Z
    lower-cased. Fewer words than k: the whole sequence is the one shingle; no word: none."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = min(n, k)
    s = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : n - m + 1 + j])
    return np.unique(s)


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    out = np.full(t, FULL)
    for i in range(2 * t):
        h = mix(s + np.uint64((0xA0761D6478BD642F * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64(0xFFFFFFFFFF))
        if i < t:
            np.minimum.at(out, ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if (out != FULL).all():
            break
    return out


def short(s: np.ndarray, t: int) -> bytes:
    """The sketch with 16 bits of each coordinate: unlike coordinates look alike once in 65536 times."""
    return (mix(sketch(s, t)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def sketches(docs: DataFrame, k: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_a, set_b, sketch): set_a and set_b are 128 bits that name the shingle set."""
    t = bands(threshold) * BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            n, one, two, made = [], [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), k)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                one.append((d >> 64) - (1 << 63))
                two.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                made.append(short(s, t) if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

        release()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def _groups(rows: DataFrame, schema: str, start: Callable, meet: Callable) -> DataFrame:
    """Rows (g1, g2, g3, role, ...) group by group in one pass, those of role 1 first; what meet yields for each row.

    Only members of role 1, a block at most, are held: meet(group, row, held) gets each row with those before it that it is to be
    compared with, which are none for role 1 unless g2 = g3, the group of a block with itself. start() makes what a group keeps.
    """
    dealt = rows.repartition(tasks(rows.sparkSession), "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", F.desc("role"))
    width = len(schema.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        now, held, group = None, [], None
        for batch in batches:
            out: list[tuple] = []
            *first, last = batch.columns  # the last one is large
            for g1, g2, g3, role, *row in zip(*(c.to_pylist() for c in first), (x.as_py() for x in last), strict=True):
                key = (g1, g2, g3)
                if key != now:
                    now, held, group = key, [], start()
                mine = (key, role, *row)
                found, kept = meet(group, mine, held if role == 0 or key[1] == key[2] else [])
                out += found
                if role == 1:
                    held.append(kept)
            cols = list(zip(*out, strict=True)) or [[]] * width
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in schema.split(", ")])

        release()

    return dealt.mapInArrow(run, schema)


def _links(s: Scratch, members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) in groups. members: (g1, g2, g3, role, id, label).

    In a group each of role 0 is compared with each of role 1; where g2 = g3 those of role 1 are compared with each other too.
    Pairs with equal labels, or joined in the group before, are not compared. A group has at most about two blocks of members.
    """
    spark = docs.sparkSession
    num, den = round(threshold * 1000), 1000
    t = bands(threshold) * BAND
    least = least_equal(t, threshold)
    schema = "g1 long, g2 long, g3 long, role long, id long, label long"

    def alike(group: set, row: tuple, held: list) -> tuple[list, tuple]:
        """Members that may have a link, by sizes and sketches, each once."""
        key, role, i, label, size, sketch = row
        own = np.frombuffer(sketch, "<u2")
        found = []
        for other, entry, other_label, other_size, other_own in held:
            small, large = min(size, other_size), max(size, other_size)
            if label != other_label and den * small >= num * large and int((own == other_own).sum()) >= least:
                for x in (other, i):
                    if x not in group:
                        group.add(x)
                        found.append(entry if x == other else (*key, role, i, label))
        return found, (i, (*key, role, i, label), label, size, own)

    with_sketch = members.join(classes.select(F.col("rep").alias("id"), "size", "sketch"), "id").select("g1", "g2", "g3", "role", "id", "label", "size", "sketch")
    close = s.cut(_groups(with_sketch, schema, set, alike), "close")
    if close.isEmpty():
        return s.cut(docs.sparkSession.createDataFrame([], "a long, b long"), "links")
    needed = close.select("id").distinct()
    # only texts that are compared move: by sending their ids out while these are few, else by a join
    needed = F.broadcast(needed) if needed.count() <= SEND else needed
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).join(needed, "id", "left_semi")
    rows = close.join(texts, "id").select("g1", "g2", "g3", "role", "id", "label", "_text")

    def same(up: dict, row: tuple, held: list) -> tuple[list, tuple]:
        """Links that join what is not joined in the group yet."""

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        _, _, i, label, text = row
        a = shingles(text, k)
        found = []
        for j, other_label, b in held:
            p, q = top(label), top(other_label)
            if p == q or den * min(len(a), len(b)) < num * max(len(a), len(b)):
                continue
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = int((a[at] == b).sum())
            if den * both >= num * (len(a) + len(b) - both):
                found.append((i, j))
                up[p] = q
        return found, (i, label, a)

    links = s.cut(_groups(rows, "a long, b long", dict, same), "links")
    s.drop(close)
    return links


def _relabel(df: DataFrame, column: str, labels: DataFrame | None) -> DataFrame:
    """Replace the values of a column by their labels, where they have one."""
    if labels is None:
        return df
    named = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(named, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_label", column)).drop("_node", "_label")


def _merged(s: Scratch, labels: DataFrame | None, links: DataFrame, total: int) -> DataFrame:
    """The labels after the links, whose ends are nodes, have joined components."""
    if labels is None:
        return components(links, s)
    if links.isEmpty():
        return labels
    again = components(_relabel(_relabel(links, "a", labels), "b", labels), s)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    new = again.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    moved = join_groups(labels, s.cut(sizes.join(new, "label", "left"), "sizes"), "label", "node", total).select("node", F.coalesce("_to", "label").alias("label"))
    return s.cut(moved.unionByName(again.join(labels, "node", "left_anti")), "labels")


def _blocks(n: str, weight: str, members: int) -> Column:
    """Blocks of so many members for n with so many shingles in all."""
    return F.ceil(F.greatest(F.col(n) / members, F.col(weight) / BLOCK_SHINGLES)).cast("long")


def _stars(stars: DataFrame, labels: DataFrame | None, total: int) -> DataFrame:
    """Members for stars(hub, rep, size), but for pairs with one label: a hub's partners are dealt over several groups."""
    hubs = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).withColumn("hub_label", F.col("hub"))
    dealt = join_groups(stars, _relabel(hubs, "hub_label", labels), "hub", "rep", total)
    dealt = _relabel(dealt.withColumn("label", F.col("rep")), "label", labels).where("label != hub_label")
    dealt = dealt.withColumn("g2", F.pmod(F.xxhash64("rep", F.lit(5)), _blocks("n", "weight", PARTNERS)))
    zero = F.lit(-1).cast("long").alias("g3")
    leaves = dealt.select(F.col("hub").alias("g1"), "g2", zero, F.lit(0).cast("long").alias("role"), F.col("rep").alias("id"), "label")
    heads = dealt.select(F.col("hub").alias("g1"), "g2", zero, F.lit(1).cast("long").alias("role"), F.col("hub").alias("id"), F.col("hub_label").alias("label")).distinct()
    return leaves.unionByName(heads)


def _mixed(shared: DataFrame, labels: DataFrame, total: int, s: Scratch) -> DataFrame:
    """Members for buckets that hold several components; of buckets with the same members one is enough."""
    left = s.cut(_relabel(shared.where("n > 2").withColumn("label", F.col("rep")), "label", labels), "left")
    mixed = left.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "rep").alias("main"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(2))).alias("y"),
    ).where("lo != hi")
    one = mixed.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "main")).alias("b")).select("b.*", "n")
    inside = s.cut(join_groups(left.drop("n"), one, "bucket", "rep", total).withColumn("in_main", F.col("label") == F.col("main")), "mixed")
    of = lambda what, cond: F.sum(F.when(cond, what).otherwise(0))
    counts = inside.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), of(1, F.col("in_main")).alias("n_main"), of(1, ~F.col("in_main")).alias("n_other"),
        of(F.col("size"), F.col("in_main")).alias("w_main"), of(F.col("size"), ~F.col("in_main")).alias("w_other"),
    )
    counts = counts.select("bucket", "n", _blocks("n_main", "w_main", BLOCK).alias("mains"), _blocks("n_other", "w_other", BLOCK).alias("others"))
    dealt = join_groups(inside.drop("n"), counts, "bucket", "rep", total)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))))
    # g2: a block of others; g3: the block it meets, others from 0 up, of the main component from -1 down
    meet = lambda g2, g3, role: F.struct(g2.cast("long").alias("g2"), g3.cast("long").alias("g3"), F.lit(role).cast("long").alias("role"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    met = F.when(F.col("in_main"), F.transform(upto("others"), lambda o: meet(o, -1 - F.col("own"), 0))).otherwise(
        F.concat(
            F.transform(upto("mains"), lambda m: meet(F.col("own"), -1 - m, 1)),
            F.transform(upto("others"), lambda o: meet(F.least(o, "own"), F.greatest(o, "own"), 1)),
        )
    )
    role = F.when((F.col("at.g3") > F.col("at.g2")) & (F.col("own") == F.col("at.g3")), F.lit(0).cast("long")).otherwise(F.col("at.role"))
    return dealt.withColumn("at", F.explode(met)).select(F.col("bucket").alias("g1"), "at.g2", "at.g3", role.alias("role"), F.col("rep").alias("id"), "label")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Linked: Jaccard similarity of the distinct k-word shingles >= threshold (to three decimals), checked on
    full sets. component_id is the smallest id reachable; kept means that it is the document's own. Null
    and empty texts, and texts without a word, are linked with nothing. Rows that share an id are one
    document with several texts. Rows without an id only count as exact copies, and component_id is null
    for those that copy no row with an id. Ids may be of any type that can be sorted. Further columns do not
    matter. The empty table gives no rows.
    """
    if not whole_numbers(docs, id_col):
        inner, ids = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
        got = near_duplicates(inner, k, threshold)
        name = lambda c: ids.select(F.col("_n").alias(f"_{c}"), F.col("_id").alias(c))
        got = got.withColumnsRenamed({"doc_id": "_doc_id", "component_id": "_component_id"}).join(name("doc_id"), "_doc_id", "left")
        sizes = got.groupBy("_component_id").agg(F.count(F.lit(1)).alias("n")).join(name("component_id"), "_component_id")
        some = join_groups(got.where("_component_id is not null"), sizes, "_component_id", "_doc_id", got.count())
        none = got.where("_component_id is null").withColumn("component_id", F.lit(None).cast(ids.schema["_id"].dataType))
        return some.select("doc_id", "n_shingles", "component_id", "kept").unionByName(none.select("doc_id", "n_shingles", "component_id", "kept"))
    with Scratch(docs.sparkSession) as s, short_batches(docs.sparkSession):
        rows = s.cut(sketches(docs, k, threshold, id_col, text_col), "sketches")
        full = rows.where("n_shingles > 0")
        classes = s.cut(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")), "classes")
        b = bands(threshold)
        total = classes.count() * b
        bucket = F.expr(f"explode(transform(sequence(0, {b - 1}), j -> xxhash64(j, substring(sketch, j * {2 * BAND} + 1, {2 * BAND}))))")
        slots = classes.where("rep is not null").select("rep", "size", bucket.alias("bucket"))
        buckets = s.cut(slots.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
        shared = s.cut(join_groups(slots, buckets, "bucket", "rep", total), "buckets")

        # each class against the first of each of its buckets
        stars = shared.where("rep != hub").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("in_common"), F.first("size").alias("size"))
        stars = s.cut(stars, "stars")
        nearest = stars.groupBy("rep").agg(F.max_by(F.struct("hub", "size"), F.struct("in_common", -F.col("hub"))).alias("h")).select("rep", "h.*")
        labels = None
        others = stars.join(nearest.select("rep", F.col("hub").alias("_met")), "rep").where("hub != _met").select("hub", "rep", "size")
        for some in (nearest, others):
            labels = _merged(s, labels, _links(s, _stars(some, labels, total), classes, docs, k, threshold, id_col, text_col), total)
        labels = _merged(s, labels, _links(s, _mixed(shared, labels, total, s), classes, docs, k, threshold, id_col, text_col), total)

        named = _relabel(classes.select("set_a", "set_b", "n", F.col("rep").alias("component_id")), "component_id", labels)
        # the two halves of the set's name as one key
        key = F.struct("set_a", "set_b").alias("_set")
        found = join_groups(full.select("doc_id", "n_shingles", key), named.select(key, "n", "component_id"), "_set", "doc_id", rows.count())
        none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        every = found.select("doc_id", "n_shingles", "component_id").unionByName(none)
        return cut(every.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))), "components")


def distinct_documents(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, the one with the smallest id, with all their columns.

    Of rows that repeat that id one stays. Rows without an id cannot be told apart: all of them stay, unless
    each copies a row that has one. Columns may have any names. The empty table gives no rows.
    """
    key = free(docs, "kept_id")
    kept = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, threshold).where("kept")
    counts = cut(kept.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("_n")), "kept")
    once, more = (counts.where(cond).select(key) for cond in (f"_n = 1 or `{key}` is null", f"_n > 1 and `{key}` is not null"))
    # texts only move where the ids that stay are too many to be sent out
    small = counts.count() <= SEND
    at = lambda ids: docs.join(F.broadcast(ids) if small else ids, docs[id_col].eqNullSafe(ids[key]), "left_semi")
    # only rows whose id repeats meet again, if there are any
    return at(once) if more.isEmpty() else at(once).unionByName(at(more).dropDuplicates([id_col]))
