"""A table that a stream keeps as change sets: a batch writes the rows of the keys that it changes, and nothing else.

Keys are dealt by a hash into parts, folders _part=<first bits of the hash>. A part holds base=N, all its rows as of batch N, and
changes=M for later batches M that touched it; of a key the rows of its newest batch count. When a part's changes have become a share of
its base, they are folded into a new base, so a byte that changes is written about 1 / share times more; a part that has grown beyond
its bytes is split on further bits then. What there is comes from the folders' listing, and everything shows by a rename, so
a batch that runs again, in the same process or after a restart, finds what it found before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Share of a part's base that its changes may have.
SHARE = 0.5
#: Bytes beyond which a part is split when it is folded.
PART_BYTES = 256 << 20
#: Batches before the newest that can still run again.
OLDER = 2


class ChangeSets:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.stored = StructType([*schema.fields]).add("_batch", "long").add("_none", "boolean")

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def listing(self) -> dict[str, dict[str, list[int]]]:
        """Part -> its bases and changes, ascending."""
        found: dict[str, dict[str, list[int]]] = {}
        for s in self.fs.globStatus(self._at(f"{self.path}/_part=*/*=*")) or []:
            part, (kind, _, n) = s.getPath().getParent().getName().partition("=")[2].removeprefix("p"), s.getPath().getName().partition("=")
            found.setdefault(part, {"base": [], "changes": []})[kind].append(int(n))
        return {p: {k: sorted(v) for k, v in own.items()} for p, own in found.items()}

    @staticmethod
    def live(listing: dict[str, dict[str, list[int]]], before: int | None) -> dict[str, tuple[int | None, list[int]]]:
        """Part -> (its base, changes after it), as it was before a batch; a part that was split by then is not among them."""
        seen = lambda ns: [n for n in ns if before is None or n < before]
        there = {p for p, own in listing.items() if seen(own["base"])} | {""}
        out = {}
        for p in there:
            if not any(q != p and q.startswith(p) for q in there):
                own = listing.get(p, {"base": [], "changes": []})
                base = max(seen(own["base"]), default=None)
                out[p] = base, [n for n in seen(own["changes"]) if base is None or n > base]
        return out

    def part(self, parts) -> Column:
        """The one of the parts that a row's key belongs to."""
        bits = F.lpad(F.bin(F.xxhash64(self.key)), 64, "0")
        by_depth: dict[int, list[str]] = {}
        for p in parts:
            by_depth.setdefault(len(p), []).append(p)
        return F.coalesce(*[F.lit("") if d == 0 else F.when(F.substring(bits, 1, d).isin(ps), F.substring(bits, 1, d)) for d, ps in sorted(by_depth.items())])

    def _folders(self, part: str, base: int | None, later: list[int]) -> tuple[list[str], list[str]]:
        at = f"{self.path}/_part=p{part}"
        return [] if base is None else [f"{at}/base={base}"], [f"{at}/changes={n}" for n in later]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def _rows(self, live: dict[str, tuple[int | None, list[int]]]) -> DataFrame:
        """The rows of parts, with those that say that a key has none."""
        bases, later = (sum(x, []) for x in zip(*(self._folders(p, *own) for p, own in live.items()), strict=True)) if live else ([], [])
        if not later:
            return self._read(bases)
        changed = self._read(later)
        newest = changed.groupBy(F.col(self.key).alias("_key")).agg(F.max("_batch").alias("_newest"))
        same = F.col(self.key).eqNullSafe(F.col("_key"))
        kept = self._read(bases).join(newest, same, "left_anti")
        return kept.unionByName(changed.join(newest, same & (F.col("_batch") == F.col("_newest"))).select(*self.stored.names))

    def touched(self, keys: DataFrame, batch: int) -> set[str]:
        """The parts that rows belong to: as many as the table has at most."""
        parts = self.live(self.listing(), batch)
        return set(parts) if len(parts) == 1 else {r[0] for r in keys.select(self.part(parts)).distinct().collect()}

    def now(self, before: int | None = None, parts: set[str] | None = None) -> DataFrame:
        """The table, or the given parts of it, as it was before a batch, or as it is."""
        live = {p: own for p, own in self.live(self.listing(), before).items() if parts is None or p in parts}
        return self._rows(live).where("not _none").select(*self.schema.names)

    def _bytes(self, paths: list[str]) -> int:
        return sum(self.fs.getContentSummary(self._at(p)).getLength() for p in paths)

    def _write(self, df: DataFrame, kind: str, batch: int, parts: set[str]) -> None:
        """df's rows by their _part, as folders of that kind; parts without a row get an empty one."""
        hidden = f"{self.path}/.new-{kind}-{batch}"
        self.fs.delete(self._at(hidden), True)
        df.withColumn("_part", F.concat(F.lit("p"), F.col("_part"))).write.partitionBy("_part").parquet(hidden)
        made = {s.getPath().getName().partition("=")[2].removeprefix("p"): s.getPath() for s in self.fs.globStatus(self._at(f"{hidden}/_part=*")) or []}
        for p in parts | set(made):
            folder = f"{self.path}/_part=p{p}"
            self.fs.mkdirs(self._at(folder))
            if p in made:
                self.fs.rename(made[p], self._at(f"{folder}/{kind}={batch}"))
            else:
                self.fs.mkdirs(self._at(f"{folder}/{kind}={batch}"))
        self.fs.delete(self._at(hidden), True)

    def put(self, rows: DataFrame, batch: int, emptied: DataFrame | None = None) -> None:
        """All rows of the keys that this batch changes; emptied: keys that have none any more."""
        listing = self.listing()
        for p, own in listing.items():  # what an earlier try of this batch, or of a later one, left
            for kind, ns in own.items():
                for n in [n for n in ns if n >= batch]:
                    self.fs.delete(self._at(f"{self.path}/_part=p{p}/{kind}={n}"), True)
        parts = self.live(listing, batch)
        mark = lambda df, none: df.withColumns({"_batch": F.lit(batch).cast("long"), "_none": F.lit(none)})
        out = mark(rows, False)
        if emptied is not None:
            out = out.unionByName(mark(emptied.select(self.key), True), allowMissingColumns=True)
        self._write(out.select(*self.stored.names, self.part(parts).alias("_part")), "changes", batch, set())
        self.fold(batch)
        self._clear(batch)

    def fold(self, batch: int) -> None:
        """Parts whose changes are a share of their base or more get a new one; the large among them are split."""
        live = self.live(self.listing(), batch + 1)
        folds, into = {}, []
        for p, (base, later) in live.items():
            old, new = map(self._bytes, self._folders(p, base, later))
            if later and new >= SHARE * old:
                folds[p] = base, later
                more = max(0, min(60 - len(p), math.ceil(math.log2(max(old + new, 1) / PART_BYTES))))
                into += [p + format(i, f"0{more}b") for i in range(1 << more)] if more else [p]
        if folds:
            # a key without rows stays known as long as its part is not folded
            kept = self._rows(folds).where("not _none")
            self._write(kept.withColumn("_part", self.part(into)), "base", batch, set(into))

    def _clear(self, batch: int) -> None:
        """Remove what no batch that can still run again reads."""
        listing = self.listing()
        needed = [self.live(listing, b) for b in range(batch - OLDER + 1, batch + 2)]
        for p, own in listing.items():
            used = [x[p] for x in needed if p in x]
            for kind, ns in own.items():
                for n in ns:
                    if n < batch and not any(n == base or (kind == "changes" and n in later) for base, later in used):
                        self.fs.delete(self._at(f"{self.path}/_part=p{p}/{kind}={n}"), True)

    def start(self, df: DataFrame) -> None:
        """df as batch -1, if the table has none yet."""
        if not self.listing():
            self.put(df, -1)
