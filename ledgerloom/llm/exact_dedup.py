"""Exact dedup: a tree merge of sorted digest runs.

Each input partition makes a sorted run of SHA-256 digests of its normalised texts. Runs then meet in
rounds of ``FAN`` (a binomial tree of log FAN exchanges at once): within every digest bucket the runs are
merged by Spark's external sort and collapsed as a stream, keeping for each digest the best row and the
count. Copies collapse inside their run before anything is shuffled, so a text that makes up a third of
all rows costs one entry per run. A second, independent hash and the length are compared wherever digests
are equal, at every level.

Nulls and empty texts are equal to each other and to texts of white space only. Repeated rows each get a
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, documents, lean, parts

#: Runs that meet in one exchange, and runs at the leaves.
FAN, RUNS = 16, 256
ENTRY = "bucket int, run int, digest binary, check long, size long, points int, doc_id long, copies long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, check, size (bytes normalised), points (code points of the original)."""
    bare = F.translate("text", BLANKS, "")
    return documents(docs).select("doc_id", F.unhex(F.sha2(bare, 256)).alias("digest"), F.xxhash64(bare).alias("check"), F.octet_length(bare).cast("long").alias("size"), F.length("text").alias("points"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each digest from rows in order of (bucket, run, digest, best first): the first, with the copies summed up.

    Rows of one digest must agree in the second hash and the length. The last digest of a batch is carried on.
    """
    carried: pa.Table | None = None
    for batch in batches:
        t = pa.table(batch) if carried is None else pa.concat_tables([carried, pa.table(batch)])
        if not t.num_rows:
            continue
        t = _first_of_each(t)
        carried = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).to_batches()
    if carried is not None:
        yield from carried.to_batches()


def _first_of_each(t: pa.Table) -> pa.Table:
    digest = np.frombuffer(b"".join(t.column("digest").to_pylist()), "S32")
    run, check, size, copies = (t.column(c).to_numpy() for c in ("run", "check", "size", "copies"))
    new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (run[1:] != run[:-1])])
    bad = np.flatnonzero(~new[1:] & ((check[1:] != check[:-1]) | (size[1:] != size[:-1])))
    if len(bad):
        ids = t.column("doc_id").take(pa.array([bad[0], bad[0] + 1])).to_pylist()
        raise ValueError(f"different texts share a digest: documents {ids}")
    at = np.flatnonzero(new)
    return t.take(pa.array(at)).set_column(t.schema.get_field_index("copies"), "copies", pa.array(np.add.reduceat(copies, at)))


def winners(docs: DataFrame) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    n = parts(docs.sparkSession)
    at = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    runs = digests(docs).select(at.alias("bucket"), (F.spark_partition_id() % RUNS).alias("run"), "digest", "check", "size", "points", "doc_id", F.lit(1).cast("long").alias("copies"))
    order = ["bucket", "run", "digest", F.desc("points"), F.asc_nulls_last("doc_id")]
    runs = runs.sortWithinPartitions(*order).mapInArrow(lean(_collapse), ENTRY)
    left = RUNS
    while left > 1:
        left = -(-left // FAN)
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int")).repartition(n, "bucket", "run")
        runs = runs.sortWithinPartitions(*order).mapInArrow(lean(_collapse), ENTRY)
    return runs.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Of equal texts the longest original, then the smallest doc_id stays."""
    best = winners(docs).withColumnRenamed("digest", "_digest")
    rows = digests(docs).select("doc_id", "digest")
    return rows.join(best, rows.digest == best._digest, "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
