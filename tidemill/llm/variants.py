"""Spelling variants: words one edit apart, found by walking a trie level by level as joins.

The words' trie is a table of edges (node, sign, child, rest): a node is the hash of its prefix, and rest has a bit for each number
of signs that words below the child still have, so a walk that cannot end at the length it needs is left at once. Every word walks
its own path without a join; from each place in its second half a state (word, position, node, edits) leaves it by one edit: another
sign, or its own sign left out. States then meet the edges of their nodes, one level a join, and those that end where a word
ends are neighbours. Edits in the first half are the second half's in a trie of the reversed words, so no state starts near
the root, where a few nodes would have all words. An added sign is one left out, seen from the other word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, cut, short_batches

RUN = "[A-Za-zÀ-ÿ]"
#: Words that a counting task holds before it gives their sums on.
HELD = 300_000
#: Levels that are walked one by one; what is still on its way then, in very long words, looks its only possible end up.
LEVELS = 24
#: The last bit of rest stands for this many signs or more.
LAST = 62


def words(docs: DataFrame, least_signs: int = 6, least_count: int = 5, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z in lower case, of least_signs code points and least_count occurrences at least.

    spoil makes misspellings to find: where it divides h, the crc32 of '<id>:<run>', code point h % length of the run is left out. An id
    that is null is the empty string there. Null and empty texts have no words; repeated rows count each.
    """
    run_of = re.compile(f"{RUN}{{{least_signs},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                # bytes.lower() only knows A-Z
                found = Counter(run_of.findall((text.as_py() or "").encode().lower().decode()))
                if spoil:
                    key = key.as_py()
                    base = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for w in [w for w in found if zlib.crc32(w.encode(), base) % spoil == 0]:
                        n, at = found.pop(w), zlib.crc32(w.encode(), base) % len(w)
                        if len(w) > least_signs:
                            total[w[:at] + w[at + 1 :]] += n
                total.update(found)
                if len(total) > HELD:
                    yield out()
        yield out()

    with short_batches(docs.sparkSession):
        found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return cut(found.where(F.col("n") >= least_count), "words")


def _upto(t: str, n: Column) -> Column:
    return F.substring(F.col(t), F.lit(1), n)


def _node(t: str, n: Column) -> Column:
    """The node of the first n signs; the tries of both directions are one table."""
    return F.xxhash64("back", _upto(t, n))


def _sign(t: str, at: Column) -> Column:
    return F.substring(F.col(t), at + 1, F.lit(1))


def _ends(left: Column) -> Column:
    """Whether words below the child have left more signs."""
    return F.call_function("shiftright", F.col("rest"), F.least(left, F.lit(LAST)).cast("int")).bitwiseAND(F.lit(1)) == 1


def near_pairs(vocabulary: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): the pairs of words(word, ...) that differ by exactly one code point inserted, deleted or replaced; each pair once.

    Equal words count once; null and empty ones have no neighbours. The work grows with the words' signs and the children of the nodes in
    their second halves, whatever the number of words that begin alike; a word of n signs has n prefixes, so its own part is of n squared bytes.
    """
    spark = vocabulary.sparkSession
    with Scratch(spark) as s:
        one = vocabulary.where("word != ''").select("word").distinct()
        both = one.select(F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("t")), F.struct(F.lit(1).alias("back"), F.reverse("word").alias("t")))).alias("x")).select("x.*")
        both = s.cut(both.withColumn("len", F.length("t")), "paths")
        shortest = both.agg(F.coalesce(F.min("len"), F.lit(1))).first()[0]
        # nobody leaves its path before the middle of the shortest word
        path = both.where(F.col("len") > shortest // 2).select("back", "t", "len", F.explode(F.sequence(F.lit(shortest // 2), F.col("len") - 1)).alias("i"))
        edges = path.select(_node("t", F.col("i")).alias("node"), _sign("t", F.col("i")).alias("sign"), _node("t", F.col("i") + 1).alias("child"), F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.col("len") - F.col("i") - 1, F.lit(LAST)).cast("int")).alias("bit"))
        edges = s.cut(edges.groupBy("node", "sign", "child").agg(F.bit_or("bit").alias("rest")), "edges")

        # q: signs of t behind the state; p, c: the edit, c for sign p or nothing for it
        own = both.select("back", "t", "len", F.explode(F.sequence(F.floor(F.col("len") / 2).cast("int"), F.col("len") - 1)).alias("p"))
        own = own.withColumn("node", _node("t", F.col("p")))
        after = (F.col("p") + 1).alias("q")
        # of equal signs in a row only the last is left out: the result is the same
        less = own.where(_sign("t", F.col("p")) != _sign("t", F.col("p") + 1)).where("len > 1").select("back", "t", "len", "p", F.lit("").alias("c"), after, "node")
        # pairs with another sign have one sign that is smaller
        other = own.withColumn("_own", _sign("t", F.col("p"))).join(edges, "node").where((F.col("sign") > F.col("_own")) & _ends(F.col("len") - F.col("p") - 1))
        states = s.cut(less.unionByName(other.select("back", "t", "len", "p", F.col("sign").alias("c"), after, F.col("child").alias("node"))), "states")
        done = []
        for level in range(LEVELS):
            done.append(states.where("q = len") if level < LEVELS - 1 else states)
            left = states.where("q < len").withColumn("sign", _sign("t", F.col("q")))
            if level == LEVELS - 1 or left.isEmpty():
                break
            on = left.join(edges, ["node", "sign"]).where(_ends(F.col("len") - F.col("q") - 1))
            states = s.cut(on.select("back", "t", "len", "p", "c", (F.col("q") + 1).alias("q"), F.col("child").alias("node")), "states")
        ended = done[0]
        for more in done[1:]:
            ended = ended.unionByName(more)
        turn = lambda x: F.when(F.col("back") == 1, F.reverse(x)).otherwise(x)
        found = ended.select(turn(F.col("t")).alias("a"), turn(F.concat(_upto("t", F.col("p")), "c", F.substring(F.col("t"), F.col("p") + 2, F.col("len")))).alias("b"))
        # nodes are hashes, so what they led to is looked up as a word
        pairs = found.join(one.select(F.col("word").alias("b")), "b", "left_semi")
        return (scratch.cut if scratch else cut)(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def group(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of vocabulary(word, n); rows that repeat a word are summed, null ones left out.

    form is the near word of largest n (ties: smallest in code-point order) where that is times the word's own n at least, else null;
    root is where forms lead to in the end, the word itself without any. Forms grow by times each, so there are no circles, and few steps.
    The empty table gives no rows.
    """
    spark = vocabulary.sparkSession
    with Scratch(spark) as s:
        counts = s.cut(vocabulary.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "counts")
        pairs = near_pairs(counts, s)
        n_of = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n"))
        known = s.cut(pairs.join(n_of("a"), "a").join(n_of("b"), "b"), "known")
        near = known.selectExpr("a word", "b other", "b_n other_n").union(known.selectExpr("b", "a", "a_n"))
        best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        formed = counts.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
        formed = formed.withColumn("form", F.when(F.col("form_n") >= times * F.col("n"), F.col("best.other")))
        formed = s.cut(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")), "forms")
        up = s.cut(formed.where("form is not null").select("word", F.col("form").alias("root")), "up")
        held = up
        while True:
            # each points to where its root points to, so a chain is done in as many rounds as its length has bits
            further = up.join(up.select(F.col("word").alias("_at"), F.col("root").alias("_to")), F.col("root") == F.col("_at"), "left")
            further = s.cut(further.select("word", F.coalesce("_to", "root").alias("root"), F.col("_at").isNotNull().alias("moved")), "up")
            s.drop(held)
            held, up = further, further.select("word", "root")
            if further.where("moved").isEmpty():
                break
        made = formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return cut(made, "variants")
