"""A content search that can be stopped and taken up again."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents


class ResumableSearch:
    """A search over ranges of a key, of which each is written when it is done.

    In `folder`, which all executors share, stand the plan (bounds of the ranges,
    a fingerprint of the source, a signature of the query) and a folder of results for
    each range; Spark's commit of a range is what marks it done, so that a run
    that dies loses at most the range it was at. A search that is taken up over
    a changed source, or with another query, is refused.
    """

    def __init__(self, df: DataFrame, key: str, fields: list[str], terms: list[str], folder: str, *, match_all: bool = False, ranges: int = 16) -> None:
        self.spark, self.key, self.folder = df.sparkSession, key, folder.rstrip("/")
        self.source = df.select(key, *[f for f in fields if f != key])
        self.find = lambda part: documents.search(part, fields, terms, match_all)
        kind = df.schema[key].dataType.simpleString()
        query = hashlib.sha256(json.dumps([fields, sorted({documents.folded(t.strip()) for t in terms if t.strip()}), match_all, key, kind]).encode()).hexdigest()
        source = self._fingerprint()
        if not self._exists("plan"):
            bounds = self.source.agg(F.percentile_approx(key, F.lit([k / ranges for k in range(1, ranges)]), 10_000).alias("b")).first()["b"] if ranges > 1 else []
            # bounds as text, each once, so that no range is empty for a repeated key
            edges = list(dict.fromkeys(str(x) for x in bounds or []))
            plan = json.dumps({"query": query, "source": source, "bounds": edges})
            self.spark.createDataFrame([(plan,)], "value string").coalesce(1).write.text(f"{self.folder}/plan")
        self.plan = json.loads(self.spark.read.text(f"{self.folder}/plan").first()["value"])
        if self.plan["query"] != query:
            raise ValueError("the search in this folder is of another query")
        if self.plan["source"] != source:
            raise ValueError("the search in this folder is over a changed or different source")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _fingerprint(self) -> str:
        """Of all rows, whatever their order: their number, and the sums of two hashes."""
        row = F.struct("*")
        sums = [F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)"))]
        found = self.source.agg(F.count("*").alias("n"), *(s.alias(f"s{k}") for k, s in enumerate(sums))).first()
        return hashlib.sha256(f"{found[0]} {found[1]} {found[2]}".encode()).hexdigest()

    @property
    def ranges(self) -> int:
        return len(self.plan["bounds"]) + 1

    def _range(self, k: int) -> DataFrame:
        bound = lambda x: F.lit(x).cast(self.source.schema[self.key].dataType)
        edges, c = self.plan["bounds"], F.col(self.key)
        part = self.source.where(c >= bound(edges[k - 1])) if k else self.source
        upto = c < bound(edges[k]) if k < len(edges) else None
        if upto is None:
            return part
        return part.where(upto | c.isNull()) if k == 0 else part.where(upto)

    def position(self) -> int:
        """The number of ranges that are done."""
        return next((k for k in range(self.ranges) if not self._exists(f"range-{k:06d}")), self.ranges)

    def run(self, most: int | None = None) -> bool:
        """Search the next ranges, `most` at most; whether all are done then."""
        first = self.position()
        for k in range(first, min(self.ranges, first + most) if most is not None else self.ranges):
            self.find(self._range(k)).write.mode("overwrite").parquet(f"{self.folder}/range-{k:06d}")
        return self.position() == self.ranges

    def results(self) -> DataFrame:
        """What has been found in the ranges that are done."""
        found = self.find(self.source.limit(0)).schema
        done = self.position()
        return self.spark.read.schema(found).parquet(*(f"{self.folder}/range-{k:06d}" for k in range(done))) if done else self.spark.createDataFrame([], found)

    def checkpoint(self) -> str:
        """Position, source and query as one text, which check() compares."""
        return base64.urlsafe_b64encode(json.dumps([self.position(), self.plan["source"], self.plan["query"]]).encode()).decode().rstrip("=")

    def check(self, checkpoint: str) -> int:
        """The position of a checkpoint of this source and query; any other is refused."""
        try:
            position, source, query = json.loads(base64.urlsafe_b64decode(checkpoint + "=" * (-len(checkpoint) % 4)))
        except (ValueError, TypeError) as e:
            raise ValueError("not a checkpoint") from e
        if source != self.plan["source"]:
            raise ValueError("the checkpoint is of a changed or different source")
        if query != self.plan["query"]:
            raise ValueError("the checkpoint is of another query")
        return position
