"""Token counts as delta-maintained rollups.

A change to the corpus is a set of signed rows: +1 for an inserted document, -1 for a deleted
one, and both for a revised count. A batch of changes is summed by (source, lang, version), written
aside and renamed to a folder named by the batch id. The rename succeeds once: committing a batch
again, also by a second writer, is a no-op, and a commit that was cut short leaves nothing. Deltas
are folded into a base, which holds the totals and the ids of its batches, so that reading the
totals costs the base and the few batches since.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import WORD, small_batches, text_or_empty

BPE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank file.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")
#: Deltas that are left beside the base before a commit folds them in.
PENDING = 16
#: A run of white space that is cut out of a text before the split pattern, which goes back over such runs, sees it.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=table, special_tokens={})


def tokens_of(text: str, encoding) -> int:
    """The number of tokens of a whole text, of any length.

    A run of white space is a piece of its own but for its last character, which goes with what
    follows; at the end of the text it is one piece. So long runs can be encoded apart.
    """
    total = at = 0
    for m in _RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, ranks_path: str = BPE_RANKS, version: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, source, lang, version, tokens.

    Null text has no token; nulls elsewhere stay null. Texts of any length are counted whole,
    repeated rows each; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "lang": batch["lang"], "version": version, "tokens": [tokens_of(t, encoding) for t in batch["text"]]})

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInPandas(run, "id string, source string, lang string, version string, tokens long")
    return counted.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def count_words(docs: DataFrame, version: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows for the plainest tokenizer, words between white space."""
    return docs.select(id_col, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("tokens"))


def signed(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed rows (source, lang, version, sign, tokens) of a change; revised is (rows before, rows after)."""
    parts = [(inserted, 1), (deleted, -1), *(((revised[0], -1), (revised[1], 1)) if revised else ())]
    rows = [df.select(*KEYS, F.lit(sign).alias("sign"), "tokens") for df, sign in parts if df is not None]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


class TokenRollup:
    """Totals by source, language and tokenizer version under `root`, a folder that all executors share.

    `batch=<id>` holds the delta of a batch, `base=<n>` folded totals with the ids of their
    batches; the base of the highest number counts. Null source, language or version is a key of
    its own; null token counts add nothing; rows repeated in a batch count as often as they stand
    there. A group whose documents and tokens are both back at zero is no longer reported.
    """

    def __init__(self, spark: SparkSession, root: str, pending: int = PENDING):
        self.spark, self.root, self.pending = spark, root.rstrip("/"), pending
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _folders(self, kind: str) -> list[str]:
        found = self._fs.listStatus(self._path()) if self._fs.exists(self._path()) else []
        return [n.split("=", 1)[1] for f in found if (n := f.getPath().getName()).startswith(f"{kind}=")]

    def _put(self, staged: str, name: str) -> bool:
        """Rename a folder that is complete into place; false if the name is taken."""
        if self._fs.exists(self._path(name)):
            return False
        conf, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        ways = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        ways[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE  # fails where the name exists
        try:
            self._hadoop.FileContext.getFileContext(self._path().toUri(), conf).rename(self._path(staged), self._path(name), ways)
        except Py4JJavaError:
            if not self._fs.exists(self._path(name)):
                raise
            return False
        return True

    def _base(self) -> int | None:
        return max(map(int, self._folders("base")), default=None)

    def _held(self, base: int | None) -> DataFrame:
        if base is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.root}/base={base}/batches")

    def _split(self, base: int | None) -> tuple[list[str], list[str]]:
        """The batches with a folder: those that the base does not hold, and those that it holds."""
        names = sorted(self._folders("batch"))
        if base is None or not names:
            return names, []
        found = self.spark.createDataFrame([(n,) for n in names], "batch string").join(self._held(base), "batch", "left_semi")
        held = {r["batch"] for r in found.collect()}  # names of folders, which folding keeps few
        return [n for n in names if n not in held], [n for n in names if n in held]

    def committed(self, batch: str) -> bool:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return self._fs.exists(self._path(f"batch={batch}")) or not self._held(self._base()).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sum the signed rows up and write them; false if the batch was committed before."""
        if self.committed(batch):
            return False
        tokens = F.coalesce("tokens", F.lit(0)).cast("long")
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * tokens).cast("long").alias("tokens"))
        staged = f"_staged/{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.root}/{staged}")
        done = self._put(staged, f"batch={batch}")
        if done and len(self._folders("batch")) > self.pending:
            self.fold()
        return done

    def totals(self) -> DataFrame:
        base = self._base()
        return self._sum(base, self._split(base)[0])

    def _sum(self, base: int | None, batches: list[str]) -> DataFrame:
        schema = "source string, lang string, version string, docs long, tokens long"
        parts = [f"{self.root}/batch={b}" for b in batches] + ([f"{self.root}/base={base}/totals"] if base is not None else [])
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def fold(self) -> None:
        """A new base of the totals so far. What it read stays for those who read it now; the next fold removes it."""
        base = self._base()
        batches, folded = self._split(base)
        if not batches:
            return
        staged = f"_staged/{uuid.uuid4().hex}"
        self._sum(base, batches).write.parquet(f"{self.root}/{staged}/totals")
        held = self._held(base).union(self.spark.createDataFrame([(b,) for b in batches], "batch string"))
        held.write.parquet(f"{self.root}/{staged}/batches")
        number = 0 if base is None else base + 1
        if self._put(staged, f"base={number}"):
            for name in [f"batch={b}" for b in folded] + [f"base={n}" for n in range(number - 1)]:
                self._fs.delete(self._path(name), True)
