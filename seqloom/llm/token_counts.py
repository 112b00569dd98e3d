"""Token counts: rollups by source, language and tokenizer version that are maintained by deltas.

A change has the row as it was and as it is: an insert has no ``before``, a delete no ``after``, a revision both, whatever of them it changes.
Its signed rows are added up by group before anything is shuffled. A batch is written aside and then renamed to its id, which fails where
that id is taken: of two writers of one batch one commits, and a commit that broke off leaves nothing that counts. Totals are the sum of all
committed deltas; ``compact`` puts them, with the ids they hold, into one table in their stead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shared import in_pieces, materialise, new_path, remove, space_words

KEYS = ("source", "lang", "tokenizer")
IMAGE = "struct<source:string,lang:string,tokenizer:string,tokens:bigint>"
#: Tokenizer versions that are plain SQL: runs of anything but white space, and runs of letters and digits.
VERSIONS = {"words-1": lambda text: F.size(space_words(text)).cast("long"), "alnum-1": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long")}


def image(source: Column, lang: Column, tokenizer: Column, tokens: Column) -> Column:
    return F.struct(source.alias("source"), lang.alias("lang"), tokenizer.alias("tokenizer"), tokens.alias("tokens")).cast(IMAGE)


def nothing() -> Column:
    return F.lit(None).cast(IMAGE)


def deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens) of a table of changes with columns ``before`` and ``after``.

    Null keys are a group of their own; null token counts add nothing; a change with neither image adds nothing; repeated rows are
    changes of their own (deliveries that may repeat belong under one batch id). Groups whose sums are zero are kept out."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("row")))).alias("x"))
    rows = signed.where("x.row IS NOT NULL").select("x.sign", "x.row.*")
    sums = rows.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    return sums.where("documents <> 0 OR tokens <> 0")


ROLLUP = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


class Rollup:
    """A rollup under a folder that the driver and all executors share, on a file system whose rename is atomic.

    ``batch=<id>`` holds a batch's deltas, ``base=<n>`` the totals of all batches that its ``ids`` name; the highest n counts. Compaction is
    for one writer at a time; batches may be committed meanwhile."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(n.removeprefix(kind) for n in names if n.startswith(kind))

    def _publish(self, source: str, target: str) -> bool:
        """Renames a folder; False if the target is there already."""
        jvm = self.spark._jvm
        one, two = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(one.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(one, two, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                remove(self.spark, source)
                return False
            raise
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        found = self._names("base=")
        if not found:
            return None, set()
        path = f"{self.path}/base={found[-1]}"
        return path, {r.id for r in self.spark.read.schema("id string").parquet(f"{path}/ids").collect()}

    def committed(self) -> list[str]:
        """Ids of the batches that are part of the totals."""
        return sorted(self._base()[1] | set(self._names("batch=")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the changes under the batch's id; False, and no work, if that id is committed already."""
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.' only")
        if batch in self.committed():
            return False
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(aside)
        return self._publish(aside, f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; groups that came to nothing are gone."""
        base, held = self._base()
        paths = [f"{base}/totals"] * bool(base) + [f"{self.path}/batch={b}" for b in self._names("batch=") if b not in held]
        if not paths:
            return self.spark.createDataFrame([], ROLLUP)
        rows = self.spark.read.schema(ROLLUP).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """One table for all batches committed so far; a base that another writer puts there first is left as it is."""
        base, held = self._base()
        batches = [b for b in self._names("batch=") if b not in held]
        aside, number = f"{self.path}/aside-{uuid.uuid4().hex}", int(base.rpartition("=")[2]) + 1 if base else 1
        if batches:
            rows = self.spark.read.schema(ROLLUP).parquet(*[f"{base}/totals"] * bool(base), *(f"{self.path}/batch={b}" for b in batches))
            sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            sums.where("documents <> 0 OR tokens <> 0").write.parquet(f"{aside}/totals")
            self.spark.createDataFrame([(b,) for b in sorted(held | set(batches))], "id string").coalesce(1).write.parquet(f"{aside}/ids")
            if not self._publish(aside, f"{self.path}/base={number:012d}"):
                return
        for b in self._names("batch="):
            if b in held or b in batches:
                remove(self.spark, f"{self.path}/batch={b}")
        if base and batches:
            remove(self.spark, base)


def vocabulary_counts(docs: DataFrame, path: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """docs with the number of tokens of each whole text under the tokenizer that a public vocabulary file holds (``.json``: tokenizers,
    ``.model``: sentencepiece); null counts as empty. The file must be where executors can read it."""
    keep = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            count = lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
        for batch in batches:
            for piece in in_pieces(batch, text):
                texts = [t or "" for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, pa.array(count(texts), pa.int64())], names=[*keep, name])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(name, "long"))


def inserts(docs: DataFrame, version: str, tokens: Column | None = None) -> DataFrame:
    """Changes that insert every row of docs with its count under a tokenizer version: one of VERSIONS, or any with its ``tokens``."""
    n = VERSIONS[version](F.col("text")) if tokens is None else tokens
    return docs.select(nothing().alias("before"), image(F.col("source"), F.col("lang"), F.lit(version), n).alias("after"))


#: Documents of fewer words are withdrawn by one of the query's batches and come back with the last.
LEAST_WORDS = 20


def digest(docs: DataFrame) -> DataFrame:
    """The rows of ``op3_token_counts``: all documents are inserted with counts estimated from their length, then revised to the counts of
    their whole texts, under two tokenizer versions; documents under LEAST_WORDS words are deleted and, after a compaction, inserted again;
    each batch is delivered twice. So the totals are those of all documents; null texts count as empty."""
    rollup = Rollup(docs.sparkSession, new_path(docs.sparkSession, "rollup"))
    guess = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    read = materialise(docs.select("source", "lang", guess.alias("guess"), *(n(F.col("text")).alias(v) for v, n in VERSIONS.items())), "read")
    for version in VERSIONS:
        row = lambda n: image(F.col("source"), F.col("lang"), F.lit(version), F.col(n))  # noqa: B023, E731
        for name, changes in (
            ("insert", read.select(nothing().alias("before"), row("guess").alias("after"))),
            ("revise", read.select(row("guess").alias("before"), row(version).alias("after"))),
            ("delete", read.where(F.col("words-1") < LEAST_WORDS).select(row(version).alias("before"), nothing().alias("after"))),
            ("restore", read.where(F.col("words-1") < LEAST_WORDS).select(nothing().alias("before"), row(version).alias("after"))),
        ):
            for _ in range(2):
                rollup.commit(f"{version}-{name}", changes)
            if name == "delete":
                rollup.compact()
    return rollup.totals()


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))"
SQL = rf"""
WITH d AS (SELECT source, lang, {_WORDS} AS w, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')) AS a FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS documents, CAST(sum(w) AS BIGINT) AS tokens FROM d GROUP BY ALL
UNION ALL
SELECT source, lang, 'alnum-1', count(*), CAST(sum(a) AS BIGINT) FROM d GROUP BY ALL
"""
