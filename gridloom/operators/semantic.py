"""Comparing and deduplicating records by what they say, whatever the order of their parts.

A record is a set of entries: a path and a value. Its fingerprint is a digest
over the entries' digests in order of their paths, so that neither
the order of the entries nor how the record was stored matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Profiles: the columns that are left out of a comparison, in addition to those that are left out in any.
PROFILES = {"strict": (), "migration": ("id", "path"), "deduplication": ("id", "path", "modified", "read", "store")}


def entries(df: DataFrame, columns: list[str] | None = None, profile: str = "strict") -> Column:
    """The entries of a row, sorted by path: path, digest and length (of the value's UTF-8). Nulls have none; arrays have an entry for each item, numbered by their order of digest, so that their order does not matter."""
    if profile not in PROFILES:
        raise ValueError(f"profile: {', '.join(PROFILES)}")
    kinds = dict(df.dtypes)
    taken = [c for c in columns or df.columns if c not in PROFILES[profile]]

    def one(path: Column, value: Column) -> Column:
        text = value.cast("string").cast("binary")
        return F.struct(path.alias("path"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"))

    def of(c: str) -> Column:
        if kinds[c].startswith("array"):
            said = F.array_sort(F.transform(F.col(c), lambda x: one(F.lit(c), x)))
            return F.coalesce(F.transform(said, lambda x, i: F.struct(F.concat(F.lit(f"{c}/"), F.format_string("%08d", i)).alias("path"), x["digest"].alias("digest"), x["length"].alias("length"))), F.array().cast("array<struct<path:string,digest:string,length:bigint>>"))
        return F.when(F.col(c).isNull(), F.array().cast("array<struct<path:string,digest:string,length:bigint>>")).otherwise(F.array(one(F.lit(c), F.col(c))))

    return F.array_sort(F.flatten(F.array(*(of(c) for c in taken))))


def fingerprint(found: Column) -> Column:
    """The digest of entries: of the lines `path length digest`."""
    return F.sha2(F.array_join(F.transform(found, lambda e: F.concat_ws(" ", e["path"], e["length"].cast("string"), e["digest"])), "\n").cast("binary"), 256)


def differences(source: DataFrame, destination: DataFrame, key: str, *, columns: list[str] | None = None, profile: str = "strict", most: int | None = None) -> DataFrame:
    """Entries that differ: key, path, kind (MissingFromDestination, UnexpectedInDestination or Changed), source_length and destination_length; no values.

    Records meet by their key, which is unique on each side; one that a side lacks
    lacks all its entries there. most: so many differences, the first by key and
    path, with truncated telling whether there are more; only they pass one
    task, each task sorts out its own first.
    """
    side = lambda df, n: df.select(F.col(key).alias("_k"), entries(df.drop(key), columns, profile).alias(n))
    both = side(source, "s").join(side(destination, "d"), "_k", "full_outer").where(~F.col("s").eqNullSafe(F.col("d")))
    none = F.array().cast("array<struct<path:string,digest:string,length:bigint>>")
    pair = both.select("_k", F.coalesce("s", none).alias("s"), F.coalesce("d", none).alias("d"))
    # both sides' entries in one list by path: at most two of a path, the source's first
    tagged = F.array_sort(F.concat(F.transform("s", lambda e: F.struct(e["path"].alias("path"), F.lit(0).alias("side"), e["digest"].alias("digest"), e["length"].alias("length"))), F.transform("d", lambda e: F.struct(e["path"].alias("path"), F.lit(1).alias("side"), e["digest"].alias("digest"), e["length"].alias("length")))))
    each = pair.select("_k", F.explode(tagged).alias("e")).groupBy("_k", "e.path").agg(*(F.max(F.when(F.col("e.side") == i, F.col("e"))).alias(n) for i, n in enumerate("sd")))
    kind = F.when(F.col("d").isNull(), "MissingFromDestination").when(F.col("s").isNull(), "UnexpectedInDestination").when((F.col("s.digest") != F.col("d.digest")) | (F.col("s.length") != F.col("d.length")), "Changed")
    found = each.select(F.col("_k").alias(key), "path", kind.alias("kind"), F.col("s.length").alias("source_length"), F.col("d.length").alias("destination_length")).where("kind is not null")
    if most is None:
        return found.withColumn("truncated", F.lit(False))
    taken = found.orderBy(key, "path").limit(most + 1)
    numbered = taken.withColumns({"_n": F.row_number().over(Window.orderBy(key, "path")), "_all": F.count("*").over(Window.partitionBy())})
    return numbered.where(F.col("_n") <= most).withColumn("truncated", F.col("_all") > most).drop("_n", "_all")


def first_of_each(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The first row of each digest, by the order, which tells rows apart; rows without a digest all stay."""
    known = df.where(F.col(digest).isNotNull())
    first = known.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"))
    kept = known.join(first, digest).where(F.struct(*order) == F.col("_first")).drop("_first")
    return kept.select(*df.columns).unionByName(df.where(F.col(digest).isNull()))


class DedupIndex:
    """A table of digests that only grows: what a later run finds in it is not new. The first writer of a digest wins."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def digests(self) -> DataFrame:
        """Digests and the run that brought each: those of runs that ended, others have no mark."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], "digest string, run string")
        return self.spark.read.schema("digest string, run string").parquet(self.path)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def add(self, df: DataFrame, digest: str, order: list[str], run: str) -> DataFrame:
        """The rows of df that are new, one a digest; their digests are in the index afterwards. A run that is repeated gives its rows again."""
        named = first_of_each(df, digest, order)
        known = self.digests()
        taken = known.where(F.col("run") != run).select(F.col("digest").alias("_d"))
        new = named.join(taken, F.col(digest) == F.col("_d"), "left_anti")
        done = known.where(F.col("run") == run).limit(1).count()
        if not done:
            new.where(F.col(digest).isNotNull()).select(F.col(digest).alias("digest"), F.lit(run).alias("run")).write.mode("append").parquet(self.path)
        mine = self.digests().where(F.col("run") == run).select(F.col("digest").alias("_d"))
        return named.join(mine, F.col(digest) == F.col("_d"), "left_semi").unionByName(named.where(F.col(digest).isNull()))


def merge(stores: dict[str, DataFrame], order: list[str], *, columns: list[str] | None = None, profile: str = "deduplication", deduplicate: bool = True) -> DataFrame:
    """Rows of several stores as one, with store and fingerprint; of equal ones the first by store (in the order given) and then by `order`."""
    labelled = [df.withColumns({"store": F.lit(name), "_at": F.lit(k), "fingerprint": fingerprint(entries(df, columns, profile))}) for k, (name, df) in enumerate(stores.items())]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
    return (first_of_each(all_, "fingerprint", ["_at", *order]) if deduplicate else all_).drop("_at")
