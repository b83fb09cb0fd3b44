"""An inverted index of sequences of three characters, for searches of the kind "contains".

Every batch of texts is turned into postings where it is read: for each sequence the ids of its texts, so what is shuffled is as many lists as a batch has different sequences.
Postings are sorted by sequence, and a search reads the parts of the files that hold its own. It intersects its rarest sequences and looks at the
texts of what remains. Texts never move: what remains, ``FEW`` ids at most, is broadcast; where every sequence is more frequent than that, the texts are looked at where they lie. A search of one or two characters looks at the texts, which are kept in the searched form. Several forms of a text (flattened, normalised) are indexed under names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sequences that a search intersects.
RAREST = 3
#: Ids that travel to the texts at most.
FEW = 1 << 20
#: Between fields that are searched as one text; no search may hold it.
BETWEEN = "\x01"


def sequences(text: str) -> np.ndarray:
    """The different sequences of three characters of a text, as numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]) if len(codes) > 2 else codes[:0]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, id, text) -> (form, gram, n, ids): the postings of each batch."""
    for b in batches:
        forms = np.array(b.column("form").to_pylist(), object)
        texts, ids = b.column("text").to_pylist(), b.column("id").to_numpy()
        for form in sorted(set(forms.tolist())):
            mine = np.flatnonzero(forms == form)
            grams = [sequences(texts[i]) for i in mine.tolist()]
            if not any(len(g) for g in grams):
                continue
            owner = np.repeat(ids[mine], [len(g) for g in grams])
            flat = np.concatenate(grams)
            order = np.argsort(flat, kind="stable")
            kinds, first = np.unique(flat[order], return_index=True)
            at = np.append(first, len(flat)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(owner[order]))
            yield pa.RecordBatch.from_arrays([pa.array([form] * len(kinds)), pa.array(kinds), pa.array(np.diff(at).astype(np.int64)), lists], names=["form", "gram", "n", "ids"])


def joined(*fields: str) -> Column:
    """Several fields as one text; nulls are left out."""
    return F.concat_ws(BETWEEN, *fields)


class TextIndex:
    """The index in a folder that all executors share: ``postings`` (form, gram, n, ids) and ``texts`` (form, id, text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def build(self, rows: DataFrame, key: str, forms: dict[str, Column], parts: int | None = None) -> TextIndex:
        """Indexes ``rows`` under each form (a text column) by ``key`` (a long); null texts are left out."""
        texts = rows.select(F.col(key).cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(name).alias("form"), c.alias("text")) for name, c in forms.items()])).alias("t")).select("t.form", "id", "t.text").where("text IS NOT NULL AND id IS NOT NULL")
        texts.write.mode("overwrite").partitionBy("form").parquet(f"{self.path}/texts")
        lists = self.texts().select("form", "id", "text").mapInArrow(_listed, "form string, gram long, n long, ids array<long>")
        parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lists.repartitionByRange(parts, "form", "gram").sortWithinPartitions("form", "gram").write.mode("overwrite").parquet(f"{self.path}/postings")
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.schema("id long, text string, form string").parquet(f"{self.path}/texts")

    def postings(self, form: str, grams: list[int]) -> DataFrame:
        rows = self.spark.read.schema("form string, gram long, n long, ids array<long>").parquet(f"{self.path}/postings")
        return rows.where((F.col("form") == form) & F.col("gram").isin(grams))

    def matches(self, form: str, what: str) -> DataFrame:
        """(id,) of the texts that hold ``what``; all of them if it is empty."""
        texts, grams = self.texts().where(F.col("form") == form), sequences(what).tolist()
        if grams:
            counts = {r["gram"]: r["n"] for r in self.postings(form, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many rows as ``what`` has sequences
            if len(counts) < len(grams):
                return texts.select("id").limit(0)
            rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
            if counts[rarest[0]] > FEW:
                return texts.where(F.col("text").contains(what)).select("id").distinct()
            rarest = [g for g in rarest if counts[g] <= FEW]
            found = self.postings(form, rarest).select("gram", F.explode("ids").alias("id"))
            if len(rarest) > 1:
                found = found.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rarest))
            texts = texts.join(F.broadcast(found.select("id")), "id", "left_semi")  # FEW ids at most: each holds the rarest sequence
        return texts.where(F.col("text").contains(what)).select("id").distinct()
