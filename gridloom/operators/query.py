"""A query over records as one operator: filter, projection, order, limits with flags, and pages by token."""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a message that a projection has if it names none. Fixed values.
MESSAGE_FIELDS = ["id", "folder", "kind", "subject", "sender", "received", "sent", "has_attachments", "is_read"]


def source_fingerprint(df: DataFrame) -> str:
    """Of the files that a table is read from (name, size, time of change) and of its columns; of its plan where it has no files."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    told = []
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append([f, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([told or df.semanticHash(), df.schema.simpleString()]).encode()).hexdigest()


def message_filter(columns: list[str], *, folder: str | None = None, descendants: bool = False, kind: str | None = None, subject: str | None = None, sender: str | None = None, since=None, before=None, attachments: bool | None = None, read: bool | None = None) -> Column:
    """The conditions on messages that are given, all of them: a folder (with those below it, a path with /), a kind, fragments of subject and sender (or sender_address) in any case, received or else sent from `since` to before `before`."""
    if since is not None and before is not None and since > before:
        raise ValueError("since: not later than before")
    out = F.lit(True)
    if folder:
        own = F.col("folder") == folder
        out = out & (own | F.startswith("folder", F.lit(folder.rstrip("/") + "/")) if descendants else own)
    if kind:
        out = out & (F.col("kind") == kind)
    if subject:
        out = out & F.contains(F.upper("subject"), F.lit(subject.upper()))
    if sender:
        named = [F.coalesce(F.contains(F.upper(c), F.lit(sender.upper())), F.lit(False)) for c in ("sender", "sender_address") if c in columns]
        out = out & (named[0] | named[1] if len(named) > 1 else named[0])
    time = F.coalesce("received", "sent")
    if since is not None:
        out = out & (time >= F.lit(since))
    if before is not None:
        out = out & (time < F.lit(before))
    for name, wanted in (("has_attachments", attachments), ("is_read", read)):
        if wanted is not None:
            out = out & (F.col(name) == wanted)
    return F.coalesce(out, F.lit(False))


@dataclass
class Page:
    """rows of a page; whether more match; whether the scan ended before all rows were looked at; the token of the next page."""

    rows: DataFrame
    has_more: bool
    scan_limit_reached: bool
    token: str | None


@dataclass
class RecordQuery:
    """where, columns and keys (name, descending) of a query; `size` results at most; of `most_scanned` rows, the first by `scan_order`, if it is given.

    Nulls come last in either direction. Keys must tell rows apart.
    """

    where: Column | None
    keys: list[tuple[str, bool]]
    columns: list[str] = field(default_factory=lambda: list(MESSAGE_FIELDS))
    size: int = 1000
    most_scanned: int | None = None
    scan_order: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        low = [c.strip().lower() for c in self.columns]
        if not low or not all(low) or len(set(low)) < len(low):
            raise ValueError("columns: some, none of them twice or blank")
        if self.size <= 0 or (self.most_scanned is not None and self.most_scanned <= 0):
            raise ValueError("limits: more than 0")
        if self.most_scanned is not None and not self.scan_order:
            raise ValueError("a limit of rows to look at needs their order")
        if not self.keys:
            raise ValueError("keys: one at least")

    def signature(self, df: DataFrame) -> str:
        told = [source_fingerprint(df), str(self.where), self.columns, self.keys, self.most_scanned, self.scan_order]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()

    def _beyond(self, df: DataFrame, after: list) -> Column:
        """Strictly after the values of a row, nulls last."""
        beyond, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(self.keys, after, strict=True):
            c = F.col(name)
            v = F.lit(value).cast(df.schema[name].dataType)
            later = F.lit(False) if value is None else ((c < v) if descending else (c > v)) | c.isNull()
            beyond = beyond | (equal & later)
            equal = equal & (c.isNull() if value is None else (c == v))
        return F.coalesce(beyond, F.lit(False))

    def run(self, df: DataFrame, token: str | None = None) -> Page:
        """The page after a token, or the first. A token of another source, filter, projection, order or limit is rejected."""
        signature, after = self.signature(df), None
        if token is not None:
            try:
                of, after = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
            except (ValueError, TypeError) as e:
                raise ValueError("not a continuation token") from e
            if of != signature:
                raise ValueError("the token is of another query or source")
        reached = False
        rows = df
        if self.most_scanned is not None:
            reached = df.limit(self.most_scanned + 1).count() > self.most_scanned
            if reached:
                rows = df.orderBy(*self.scan_order).limit(self.most_scanned)
        if self.where is not None:
            rows = rows.where(self.where)
        if after is not None:
            rows = rows.where(self._beyond(df, after))
        order = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in self.keys]
        # the page is at most `size` rows, so that its end may come to the driver
        ends = rows.select(*(c for c, _ in self.keys)).orderBy(*order).limit(self.size + 1).tail(2)
        found = rows.orderBy(*order).limit(self.size).select(*self.columns)
        more = len(ends) > 0 and rows.select(F.lit(1)).limit(self.size + 1).count() > self.size
        last = ends[-2] if more and len(ends) > 1 else None
        if not more:
            return Page(found, False, reached, None)
        plain = lambda v: v.isoformat() if isinstance(v, datetime.date) else str(v) if isinstance(v, decimal.Decimal) else v
        made = json.dumps([signature, [plain(v) for v in last]]).encode()
        return Page(found, True, reached, base64.urlsafe_b64encode(made).decode().rstrip("="))
