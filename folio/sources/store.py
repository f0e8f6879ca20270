"""The paper store: Parquet tables under one root on any Hadoop file system.

Layout (every write goes to its own ``batch=N`` folder with overwrite, so a
replayed batch rewrites the same files instead of adding a copy)::

    root/papers/batch=N/                 inserted rows (O5)
    root/log/step=S/batch=N/             status-log rows (O19), S orders steps in a batch
    root/raw/batch=N/                    the batch's uploads, content-addressed bytes among them (O4)
    root/result/batch=N/                 Documents with their result key (O6)
    root/base/v=K/papers, v=K/summary    inserted rows and log summaries up to there, by bucket
    root/base/v=K/included               the batches that base K holds
    root/_work/batch=N/<name>/           intermediate tables of batch N

``scan_papers`` (O3) is the fold (O20) of the newest base with the inserts
and log rows after it. No row is ever updated in place. A base keeps inserted
rows and *mergeable* log summaries (with the keys that order them, also of ids
that have no paper yet), so it makes no difference when compactions run: late
rows, late registrations and attempts fold as they would without them.

Key index: a base is partitioned by a bucket of the paper's id, as many as keep
about ``rows_per_bucket`` papers each; where that is few, there are no more than one
for ``ROWS_PER_FOLDER`` papers (or 256), as each is a folder, and the papers lie in them
in order of their id. A content hash gives the id, so lookups by
id and by hash both name their buckets, and files of other buckets are pruned
before the scan; a batch of keys reads the buckets that it has keys in. Files
after the base carry Parquet Bloom filters on their keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import intake, lifecycle
from folio.schemas import PAPERS, STATUS_LOG, SUMMARY, UNTIL, UPLOAD

# Every upload of a batch; the last three columns are NULL for rejected ones.
RAW = T.StructType(
    [
        *[f for f in UPLOAD.fields if f.name != "content"],
        T.StructField("reject_reason", T.StringType(), True),
        T.StructField("content_hash", T.StringType(), True),
        T.StructField("raw_key", T.StringType(), True),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def _with(schema: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    for name, dtype in extra:
        out = out.add(name, dtype, True)
    return out


INSERTS_SCHEMA = _with(PAPERS, ("batch", T.LongType()))
LOG_COLUMNS = [*STATUS_LOG.fieldNames(), UNTIL.name]
LOG_SCHEMA = _with(STATUS_LOG, (UNTIL.name, UNTIL.dataType), ("batch", T.LongType()), ("step", T.IntegerType()))
BUCKET = "bucket"
MOST_DIGITS = 4
#: Beyond 16 ** FREE_DIGITS buckets a folder should have so many papers at least.
ROWS_PER_FOLDER, FREE_DIGITS = 4_096, 2


Ranges = list[tuple[int, int]]  # closed ranges of batch numbers


def _merge(ranges: Ranges) -> Ranges:
    """Disjoint ranges with neighbours joined."""
    out: Ranges = []
    for lo, hi in sorted(ranges):
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _holds(ranges: Ranges, n: int) -> bool:
    return any(lo <= n <= hi for lo, hi in ranges)


def bucket_of(paper_id: Column, digits: int) -> Column:
    """The base's partition of a paper: the first hex digits of a hash of its id, which need not be one itself."""
    return F.substring(F.sha2(paper_id, 256), 1, digits)


def digits_for(rows: int, rows_per_bucket: int) -> int:
    """Hex digits of the buckets of a base of so many papers."""
    wanted = math.ceil(math.log(max(1, rows / rows_per_bucket), 16))
    worth = math.floor(math.log(max(1, rows / ROWS_PER_FOLDER), 16))
    return min(MOST_DIGITS, max(1, wanted), max(FREE_DIGITS, worth))


def _blooms(*columns: str) -> dict[str, str]:
    """Parquet options for Bloom filters of adaptive size."""
    out = {"parquet.bloom.filter.adaptive.enabled": "true"}
    return out | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


class PaperStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -------------------------------------------------------- file system --
    #
    # An unreachable file system is an error, never an empty store: only
    # "not found" reads as absent.

    def _fs_path(self, path: str):
        """Hadoop ``(Path, FileSystem)`` for ``path`` (any scheme the cluster supports)."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, sub: str) -> bool:
        p, fs = self._fs_path(f"{self.root}/{sub}")
        return bool(fs.exists(p))

    def size(self, sub: str) -> int:
        """Bytes of the files in a folder."""
        p, fs = self._fs_path(f"{self.root}/{sub}")
        return int(fs.getContentSummary(p).getLength())

    def make(self, sub: str) -> None:
        """An empty folder, for a stream that starts before the first write to it."""
        p, fs = self._fs_path(f"{self.root}/{sub}")
        fs.mkdirs(p)

    def _children(self, sub: str, prefix: str) -> list[int]:
        """Numeric values of ``prefix=N`` folders under ``sub`` (a directory listing, not a scan)."""
        if not self.exists(sub):
            return []
        p, fs = self._fs_path(f"{self.root}/{sub}")
        names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
        values = [n.split("=", 1)[1] for n in names if n.startswith(prefix + "=")]
        return sorted(int(v) for v in values if v.isdigit())

    def _batches(
        self, sub: str, after: int | None = None, before: int | None = None, exclude: int | None = None, held: Ranges = ()
    ) -> list[int]:
        """The committed ``batch=N`` folders of ``sub`` in the window that no base holds.

        A folder is committed once its write job left ``_SUCCESS`` in it; one
        still being written is not read and not compacted. The numbers come
        from a one-level listing, and only folders outside ``held`` are probed.
        """
        return [
            b
            for b in self._children(sub, "batch")
            if (after is None or b > after)
            and (before is None or b < before)
            and b != exclude
            and not _holds(held, b)
            and self.exists(f"{sub}/batch={b}/_SUCCESS")
        ]

    def _read(self, table: str, schema: T.StructType, folders: list[str]) -> DataFrame:
        """Only these folders of ``table``; ``basePath`` keeps ``batch`` and ``step`` as columns."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    # --------------------------------------------------------------- reads --

    def _folders(self, table: str, held: dict | None = None, **window) -> dict[tuple[str, int], list[int]]:
        """``(table, step) -> committed batches`` not in ``held`` (tables without steps have step -1)."""
        held = held or {}
        if table == "log":
            steps = {s: f"log/step={s}" for s in self._children("log", "step")}
        else:
            steps = {-1: table}
        return {(table, s): self._batches(sub, held=held.get((table, s), []), **window) for s, sub in steps.items()}

    def _scan(self, table: str, schema: T.StructType, folders: dict[tuple[str, int], list[int]]) -> DataFrame:
        sub = {k: table if k[1] < 0 else f"{table}/step={k[1]}" for k in folders}
        return self._read(table, schema, [f"{sub[k]}/batch={b}" for k, batches in folders.items() for b in batches])

    def inserts(self, held: dict | None = None, **window) -> DataFrame:
        return self._scan("papers", INSERTS_SCHEMA, self._folders("papers", held, **window))

    def log(self, held: dict | None = None, **window) -> DataFrame:
        return self._scan("log", LOG_SCHEMA, self._folders("log", held, **window))

    # ---------------------------------------------------------- compaction --
    #
    # A base is ``base/v=K/papers``, ``base/v=K/summary`` and
    # ``base/v=K/included`` (which batches of ``papers`` and of each log step
    # it holds, as ranges).
    # Reads take the newest complete base and every committed folder it does
    # not hold, so a batch or a later step that commits during or after a
    # compaction is read on top of the base, and writers that number their
    # batches in different ranges are never cut off.

    def _base(self, before: int | None = None, exclude: int | None = None) -> tuple[int, dict[tuple[str, int], Ranges]]:
        """``(version, held)`` of the newest usable base, ``(0, {})`` if none.

        A base is usable for a window if every batch it holds lies in it
        (all ``< before``; not ``exclude``).
        """
        for v in reversed(self._children("base", "v")):
            if not self.exists(f"base/v={v}/included/_SUCCESS"):
                continue  # an interrupted compaction
            held: dict[tuple[str, int], Ranges] = {}
            for r in self.spark.read.parquet(f"{self.root}/base/v={v}/included").collect():
                held.setdefault((r.tbl, r.step), []).append((r.lo, r.hi))
            every = [r for ranges in held.values() for r in ranges]
            if before is not None and any(hi >= before for _, hi in every):
                continue
            if exclude is not None and _holds(every, exclude):
                continue
            return v, held
        return 0, {}

    def _digits(self, version: int) -> int:
        """Hex digits of the base's buckets, from the name of any of its folders."""
        p, fs = self._fs_path(f"{self.root}/base/v={version}/papers")
        names = (st.getPath().getName() for st in fs.listStatus(p))
        return next((len(n) - len(BUCKET) - 1 for n in names if n.startswith(f"{BUCKET}=")), 0)

    def base_table(self, version: int, table: str, buckets: list[str] | None = None) -> DataFrame:
        """``papers`` or ``summary`` of a base, only these buckets if given (files of others are not listed for the scan)."""
        schema = _with(PAPERS if table == "papers" else SUMMARY, (BUCKET, T.StringType()))
        if not version:
            return self.spark.createDataFrame([], schema).drop(BUCKET)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/base/v={version}/{table}")
        if buckets is not None:
            df = df.where(F.col(BUCKET).isin(buckets) if buckets else F.lit(False))
        return df.drop(BUCKET)

    def _buckets(self, version: int, ids: DataFrame) -> list[str] | None:
        """The buckets that ``ids`` (paper_id) fall in, at most all there are; None if the base has none."""
        digits = self._digits(version) if version else 0
        if not digits:
            return None
        return [r[0] for r in ids.select(bucket_of(F.col("paper_id"), digits)).distinct().collect()]

    def scan_papers(
        self,
        before: int | None = None,
        exclude: int | None = None,
        only: DataFrame | None = None,
        key: str = "content_hash",
        with_attempts: bool = False,
    ) -> DataFrame:
        """O3: current ``papers``.

        ``before=N``: as of the start of batch N. ``exclude=N``: everything
        except batch N's own writes, which is what a replay of batch N must
        see (several streams may write to one store under their own batch
        numbers). ``only``: just the papers whose ``key`` (``content_hash`` or
        ``id``) is in that DataFrame, e.g. the hashes of one upload batch:
        only their buckets of the base are read, and the rest is probed with a
        semi-join against the batch, instead of folding the whole store.
        ``with_attempts``: see ``lifecycle.apply_summary``.
        """
        version, held = self._base(before, exclude)
        inserts = self.inserts(held, before=before, exclude=exclude).select(*PAPERS.fieldNames())
        log = self.log(held, before=before, exclude=exclude).select(*LOG_COLUMNS)
        if only is None:
            inserts = self.base_table(version, "papers").unionByName(inserts)
            return lifecycle.fold_status(inserts, log, with_attempts, self.base_table(version, "summary"))
        # The ids come from the small batch itself (a stored paper's id is
        # derived from its hash), so all tables are probed with a side whose
        # size the planner knows, not with the result of a join.
        named = intake.paper_id(F.col("content_hash")) if key == "content_hash" else F.col("id")
        ids = only.select(named.alias("paper_id")).where(F.col("paper_id").isNotNull()).distinct()
        buckets = self._buckets(version, ids)
        inserts = self.base_table(version, "papers", buckets).unionByName(inserts)
        summary = self.base_table(version, "summary", buckets)
        return lifecycle.fold_status(
            inserts.join(ids.withColumnRenamed("paper_id", "id"), "id", "left_semi"),
            log.join(ids, "paper_id", "left_semi"),
            with_attempts,
            summary.join(ids, "paper_id", "left_semi"),
        )

    def paper(self, paper_id: str | None = None, content_hash: str | None = None) -> DataFrame:
        """One current paper; its key is a literal that prunes buckets, files and row groups."""
        if paper_id is None:
            paper_id = self.spark.range(1).select(intake.paper_id(F.lit(content_hash))).first()[0]
        version, held = self._base()
        buckets = self._buckets(version, self.spark.createDataFrame([(paper_id,)], "paper_id string"))
        inserts = self.inserts(held).select(*PAPERS.fieldNames())
        own = self.base_table(version, "papers", buckets).unionByName(inserts).where(F.col("id") == F.lit(paper_id))
        log = self.log(held).select(*LOG_COLUMNS).where(F.col("paper_id") == F.lit(paper_id))
        summary = self.base_table(version, "summary", buckets).where(F.col("paper_id") == F.lit(paper_id))
        return lifecycle.fold_status(own, log, base=summary)

    def compact(self, rows_per_bucket: int = 1 << 20) -> int:
        """Merge every folder committed so far into a new base; returns its version.

        Exactly the listed folders are merged and recorded (run one compaction
        at a time).
        """
        version, held = self._base()
        new_papers, new_log = self._folders("papers", held), self._folders("log", held)
        inserts = self._scan("papers", INSERTS_SCHEMA, new_papers).select(*PAPERS.fieldNames())
        inserts = self.base_table(version, "papers").unionByName(inserts)
        log = self._scan("log", LOG_SCHEMA, new_log).select(*LOG_COLUMNS)
        summary = lifecycle.summarise_log(log, self.base_table(version, "summary"))
        # From the files' footers.
        rows = inserts.count()
        digits = digits_for(rows, rows_per_bucket)
        target = f"{self.root}/base/v={version + 1}"
        for df, table, key in ((inserts, "papers", "id"), (summary, "summary", "paper_id")):
            bucketed = df.withColumn(BUCKET, bucket_of(F.col(key), digits))
            dealt = bucketed.repartition(BUCKET).sortWithinPartitions(BUCKET, key)
            dealt.write.mode("overwrite").partitionBy(BUCKET).options(**_blooms(key)).parquet(f"{target}/{table}")
        held_rows = []
        for key in held.keys() | new_papers.keys() | new_log.keys():
            new = new_papers.get(key, []) + new_log.get(key, [])
            held_rows += [(*key, lo, hi) for lo, hi in _merge(held.get(key, []) + [(b, b) for b in new])]
        included = self.spark.createDataFrame(held_rows, "tbl string, step int, lo long, hi long")
        included.coalesce(1).write.mode("overwrite").parquet(f"{target}/included")
        return version + 1

    def uploads(self, batch: int) -> DataFrame:
        """The uploads of a batch as ``write_raw`` took them (``schemas.RAW``); reading keys reads no bytes."""
        return self._read("raw", _with(RAW, ("batch", T.LongType())), [f"raw/batch={batch}"]).drop("batch")

    def raw(self) -> DataFrame:
        """Content-addressed bytes: a row for each accepted upload, so bytes sent twice may be there twice."""
        every = self._scan("raw", _with(RAW, ("batch", T.LongType())), self._folders("raw"))
        return every.where(F.col("content_hash").isNotNull()).select("content_hash", "raw_key", "length", "content", "batch")

    def raw_content(self, content_hash: str) -> DataFrame:
        """One object by key: the filter is pushed to Parquet, whose Bloom filters
        and statistics leave out the row groups that do not have the hash."""
        return (
            self.raw()
            .where(F.col("content_hash") == F.lit(content_hash))
            .select("content_hash", "raw_key", "content")
            .limit(1)
        )

    def documents(self, batch: int | None = None) -> DataFrame:
        if batch is not None:
            return self.spark.read.parquet(f"{self.root}/result/batch={batch}")
        folders = [f"{self.root}/result/batch={b}" for b in self._batches("result")]
        if not folders:
            raise FileNotFoundError(f"{self.root}/result")
        return self.spark.read.option("basePath", f"{self.root}/result").parquet(*folders)

    def work(self, batch: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_work/batch={batch}/{name}")

    # -------------------------------------------------------------- writes --

    def append_papers(self, rows: DataFrame, batch: int) -> None:
        """Insert rows of one batch (replay-safe: the batch folder is overwritten)."""
        out = rows.select(*PAPERS.fieldNames()).write.mode("overwrite").options(**_blooms("id", "content_hash"))
        out.parquet(f"{self.root}/papers/batch={batch}")

    def append_log(self, rows: DataFrame, batch: int, step: int) -> None:
        if UNTIL.name not in rows.columns:
            rows = rows.withColumn(UNTIL.name, F.lit(None).cast(UNTIL.dataType))
        out = rows.select(*LOG_COLUMNS).write.mode("overwrite").options(**_blooms("paper_id"))
        out.parquet(f"{self.root}/log/step={step}/batch={batch}")

    def write_raw(self, classified: DataFrame, batch: int) -> DataFrame:
        """The classified uploads of one batch, bytes of the accepted ones included, in one
        pass over the scan that brings them; returns the written rows.

        The write is a narrow job: no bytes cross an exchange, and nothing else reads
        them. Keys, deduplication and inserts read the key columns back from here.
        As in a put before a commit, objects whose rows are never inserted are harmless: they are
        addressed by content. Not partitioned by a hash prefix: with thousands of write
        tasks that would make one small file per object.
        """
        out = classified.select(*RAW.fieldNames()).write.mode("overwrite").options(**_blooms("content_hash"))
        out.parquet(f"{self.root}/raw/batch={batch}")
        return self.uploads(batch)

    def write_documents(self, docs: DataFrame, batch: int) -> None:
        """One row per Document with its ``result_key`` (and its JSON text)."""
        docs.write.mode("overwrite").parquet(f"{self.root}/result/batch={batch}")

    def export_json(self, batch: int, path: str) -> None:
        """Documents of one batch as JSON lines (``{"result_key": ..., "document": {...}}``).

        The Document text is written as produced (HTML-safe, omit-empty), one
        line per document, next to its key.
        """
        docs = self.documents(batch)
        line = F.concat(
            F.lit('{"result_key":"'), F.col("result_key"), F.lit('","document":'), F.col("json"), F.lit("}")
        )
        docs.select(line.alias("value")).write.mode("overwrite").text(path)

    def write_work(self, df: DataFrame, batch: int, name: str) -> DataFrame:
        """Write an intermediate table and read it back: a lineage cut that survives executor loss."""
        path = f"{self.root}/_work/batch={batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

