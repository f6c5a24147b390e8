"""Inserts, upserts, updates, deletes and mixed changes, each giving the table's new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the largest order. Partial sums at the map side, so a hot key costs no hot task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def first(df: DataFrame, key: str, order: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows there already win; of those that come in with one key the first."""
    new = first(incoming, key, F.col(order)).drop(order)
    return target.unionByName(new.join(target.select(key), key, "left_anti"))


def upsert(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that come in win, of those with one key the last."""
    new = latest(incoming, key, F.col(order)).drop(order)
    return target.join(new.select(key), key, "left_anti").unionByName(new)


def update_many(df: DataFrame, where: Column, changes: dict[str, Column], otherwise: dict[str, object] | None = None) -> DataFrame:
    """Set columns where the condition holds; where it is null nothing changes. Where no row matches, `otherwise` is added as a row, if given."""
    out = df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})
    if otherwise is None:
        return out
    row = df.sparkSession.range(1).select(*[F.lit(otherwise.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    matched = df.where(where).limit(1).select(F.lit(True).alias("_matched"))
    return out.unionByName(row.join(F.broadcast(matched), F.col("_matched"), "left_anti"))


def update_counts(df: DataFrame, where: Column, changes: dict[str, Column], upsert: bool = False) -> DataFrame:
    """(matched, modified, upserted) in one pass."""
    differs = F.lit(False)
    for c, v in changes.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    got = df.agg(F.count_if(where).alias("matched"), F.count_if(where & differs).alias("modified"))
    return got.withColumn("upserted", F.when(F.lit(upsert) & (F.col("matched") == 0), 1).otherwise(0).cast("long"))


def delete_many(df: DataFrame, where: Column) -> DataFrame:
    """Rows go where the condition holds; where it is null they stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_counts(df: DataFrame, where: Column) -> DataFrame:
    """(deleted, left) in one pass."""
    n = F.count_if(where)
    return df.agg(n.alias("deleted"), (F.count(F.lit(1)) - n).alias("left"))


#: Operations, or composed ones, of one key that are composed as one list at most.
FAN = 1024
KINDS = ("insert", "update", "delete", "upsert")


def _place(seq: str, lo: int | None, level: int) -> Column:
    """The stretch of sequence numbers that an operation is in at a level: each has FAN of those below it. Null numbers are the first."""
    own = F.coalesce(F.floor(F.col(seq)).cast("long") - F.lit(lo or 0) + 1, F.lit(0).cast("long"))
    return F.floor(own / FAN**level).cast("long")


def _levels(changes: DataFrame, seq: str) -> tuple[int | None, int]:
    """(smallest sequence number, levels until all numbers are one stretch)."""
    lo, hi = changes.agg(F.floor(F.min(seq)).cast("long"), F.floor(F.max(seq)).cast("long")).first()
    levels, reach = 1, FAN
    while lo is not None and reach <= hi - lo + 1:
        levels, reach = levels + 1, reach * FAN
    return lo, levels


def _folded(target: DataFrame, changes: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """(key, _now, _s): each key's row before, and the state after: here, row, and how many operations of each kind took effect.

    An operation is a pair of transitions, one from a key that is absent and one from a key that is there, with what took effect; such
    pairs compose to such pairs. They do so level by level over ever longer stretches of sequence numbers, of which one list never has
    more than FAN, however many operations a key has and however far apart their numbers are (but for equal numbers of one key).
    """
    cols = [c for c in target.columns if c != key]
    kind = row_type(target, cols)
    row = F.struct(*cols)
    begin = lambda here: F.struct(here.alias("here"), F.lit(True).alias("same"), F.lit(None).cast(kind).alias("row"), *[F.lit(0).cast("long").alias(k) for k in KINDS])
    pair = lambda absent, there: F.struct(absent.alias("absent"), there.alias("there"))

    def one(here: bool) -> Column:
        """The state that one operation leaves of a key that is there, or is not."""
        at = F.col(op)
        does = {"insert": (at == "insert") & F.lit(not here), "update": (at == "update") & F.lit(here), "delete": (at == "delete") & F.lit(here), "upsert": at == "upsert"}
        writes = does["insert"] | does["update"] | does["upsert"]
        return F.struct(((F.lit(here) & ~does["delete"]) | writes).alias("here"), (~writes & ~does["delete"]).alias("same"), F.when(writes, row.cast(kind)).alias("row"), *[does[k].cast("long").alias(k) for k in KINDS])

    def after(s: Column, f: Column) -> Column:
        g = F.when(s["here"], f["there"]).otherwise(f["absent"])
        return F.struct(g["here"].alias("here"), (s["same"] & g["same"]).alias("same"), F.when(g["same"], s["row"]).otherwise(g["row"]).alias("row"), *[(s[k] + g[k]).alias(k) for k in KINDS])

    known = changes.where(F.col(op).isin(*KINDS))
    lo, levels = _levels(known, seq)
    # of equal numbers the operation and the row decide, as they always did
    steps = known.select(key, _place(seq, lo, 0).alias("_at"), F.struct(F.col(seq).alias("seq"), F.col(op).alias("op"), row.alias("row")).alias("_by"), pair(one(False), one(True)).alias("_f"))
    for level in range(1, levels + 1):
        up = F.floor(F.col("_at") / FAN) if level < levels else F.lit(0)
        lists = steps.groupBy(key, up.cast("long").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", "_by", "_f"))).alias("_fs"))
        folded = F.aggregate("_fs", pair(begin(F.lit(False)), begin(F.lit(True))), lambda s, x: pair(after(s["absent"], x["_f"]), after(s["there"], x["_f"])))
        steps = lists.select(key, F.col("_up").alias("_at"), F.lit(None).cast(steps.schema["_by"].dataType).alias("_by"), folded.alias("_f"))
    joined = target.select(key, row.alias("_now")).join(steps.select(key, "_f"), key, "full")
    start = begin(F.col("_now").isNotNull())
    state = F.when(F.col("_f").isNull(), start).otherwise(after(start, F.col("_f")))
    return joined.select(key, F.col("_now").cast(kind).alias("_now"), state.alias("_s"))


def apply_changes(target: DataFrame, changes: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """Insert, update, delete and upsert operations in order of seq, as the state after them.

    changes has the target's columns, op and seq. An insert takes effect where the key is absent at that
    point, an update where it is present, a delete removes, an upsert always writes; others do nothing. All operations of a
    key are folded in order; keys do not meet each other.
    """
    s = F.col("_s")
    return _folded(target, changes, key, seq, op).where(s["here"]).select(key, F.when(s["same"], F.col("_now")).otherwise(s["row"]).alias("_r")).select(key, "_r.*")


def change_counts(target: DataFrame, changes: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """(inserted, updated, deleted, upserted): operations that took effect."""
    got = _folded(target, changes, key, seq, op).select("_s.*")
    return got.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(n) for k, n in zip(KINDS, ("inserted", "updated", "deleted", "upserted"), strict=True)])


def row_type(df: DataFrame, cols: list[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in cols) + ">"


def unique_names(files: DataFrame, name: str, order: str, spread: int = 4096) -> DataFrame:
    """Adds unique: the name, or for a name that came before `stem_n.ext` with the smallest n, in order of arrival, that no file brought
    with it.

    A hot name is numbered in parts of so many arrivals (order is a whole number): counts before, then within. The numbers
    that files brought leave stretches of free ones, and an arrival finds its stretch by a join on pieces of them, so neither the
    arrivals nor the brought numbers of one name meet in one place.
    """
    part = F.floor(F.col(order) / spread)
    sums = files.groupBy(name, part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sums.select(F.col(name).alias("_name"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.partitionBy(name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = files.withColumn("_part", part).withColumn("_own", F.row_number().over(Window.partitionBy(name, "_part").orderBy(order)))
    n = own.join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_part") == F.col("_p"))).withColumn("_n", F.col("_before") + F.col("_own") - 1).drop("_part", "_p", "_own", "_before", "_name")
    pattern = r"^(.*)_([1-9]\d{0,8})(\.[^.]*)?$"
    at = lambda k: F.regexp_extract(name, pattern, k)
    brought = files.select(F.concat(at(1), at(3)).alias("_of"), at(2).alias("_m")).where("_m != ''").select("_of", F.col("_m").cast("long").alias("_m")).distinct()
    # the i-th brought number m, counted from 0 within its name, has m - i - 1 free ones before it: from there on i + 1 are to be skipped
    block = F.floor(F.col("_m") / spread)
    inside = Window.partitionBy("_of", "_b").orderBy("_m")
    counted = brought.withColumn("_b", block)
    earlier = counted.groupBy("_of", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("_of").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = counted.withColumn("_i", F.row_number().over(inside)).join(earlier.drop("_c"), ["_of", "_b"])
    skips = ranked.select("_of", (F.col("_m") - F.col("_before") - F.col("_i")).alias("_from"), (F.col("_before") + F.col("_i")).alias("_skip"))
    skips = skips.groupBy("_of", "_from").agg(F.max("_skip").alias("_skip"))
    # arrivals and steps of a name in order of their place, in pieces: the last step at or before the arrival, by sums of maxima
    piece = lambda c: F.floor(F.col(c) / spread)
    rows = n.select(F.col(name).alias("_of"), (F.col("_n") - 1).alias("_x"), F.lit(None).cast("long").alias("_skip"), F.struct(*n.columns).alias("_row"), F.lit(1).alias("_last"))
    both = rows.unionByName(skips.select("_of", F.col("_from").alias("_x"), "_skip", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_last"))).withColumn("_piece", piece("_x"))
    tops = both.where("_row is null").groupBy("_of", "_piece").agg(F.max("_skip").alias("_top"))
    pieces = both.select("_of", "_piece").distinct().join(tops, ["_of", "_piece"], "left")
    pieces = pieces.withColumn("_under", F.max("_top").over(Window.partitionBy("_of").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    within = F.max("_skip").over(Window.partitionBy("_of", "_piece").orderBy("_x", "_last").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_within", within).where("_row is not null").withColumnRenamed("_of", "_name")
    found = found.join(pieces.withColumnRenamed("_piece", "_p"), F.col("_name").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_p")))
    up = F.coalesce(F.greatest("_within", "_under"), F.lit(0))
    out = found.select("_row.*", up.alias("_up"))
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, 1, F.length(name) - F.length(dot))
    numbered = F.concat(stem, F.lit("_"), F.col("_n") + F.col("_up"), dot)
    return out.withColumn("unique", F.when(F.col("_n") == 0, F.col(name)).otherwise(numbered)).drop("_n", "_up")
