"""A stored registry of documents that new uploads are registered against.

Four append-only tables below one folder, each dealt into buckets by the key it
is looked up with; a bucket is a folder, so a scan of known buckets reads no
other files:

- `names`: registered documents by (session_id, doc_id);
- `hashes`: what each registered document is worth as an earlier one, by hash;
- `bands`: the band keys of each distinct hash, by key;
- `replaced`: which document replaced which, by the older one's number.

A batch of uploads touches the buckets of its own names, hashes and keys. Rows
are written below the batch's number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import stem
from trawl.operators import versions as v
from trawl.operators.near_hashes import HOT_BAND, PRIOR, band_keys, nearest_earlier
from trawl.session import stage_table, with_session

_NAMES = "session_id string, doc_id string, file_hash string, reg bigint, filename string, hi bigint, lo bigint, version bigint, doc_first bigint, similarity double, matched_reg bigint, matched_name string, result string, supersedes array<string>, message string"
_PRIOR = "struct<doc_first:bigint,version:bigint,reg:bigint,doc_id:string,filename:string>"
_SCHEMAS = {
    "hashes": f"session_id string, hi bigint, lo bigint, prior {_PRIOR}",
    "bands": "session_id string, band bigint, hi bigint, lo bigint",
    "replaced": "session_id string, reg bigint, doc_id string, by bigint",
}
_KEYS = {"names": ["session_id", "doc_id"], "hashes": ["session_id", "hi", "lo"], "bands": ["session_id", "band"], "replaced": ["session_id", "reg"]}
_HASH = ["session_id", "hi", "lo"]
_BAND = ["session_id", "band"]


@dataclass
class Registered:
    """A batch's registered documents as of the batch, and a result per upload."""

    documents: DataFrame
    results: DataFrame


@dataclass
class RegistryStore:
    """``payload`` names further columns of the uploads that are kept, with their types."""

    spark: SparkSession
    path: str
    buckets: int = 64
    payload: str = ""
    max_distance: int = fv.MAX_HAMMING
    hot: int = HOT_BAND

    def _schema(self, table: str) -> str:
        return (_NAMES + (f", {self.payload}" if self.payload else "")) if table == "names" else _SCHEMAS[table]

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*_KEYS[table]), F.lit(self.buckets)).cast("int")

    def _table(self, table: str, before: int | None = None) -> DataFrame:
        """All rows, or those of earlier batches."""
        schema = f"{self._schema(table)}, batch bigint, bucket int"
        folder = f"{self.path}/{table}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(folder)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def touched(self, table: str, keys: DataFrame, batch: int) -> DataFrame:
        """Earlier rows in the buckets of some keys; other buckets are not read."""
        found = [r.bucket for r in keys.select(self._bucket(table).alias("bucket")).distinct().collect()]  # at most `buckets` rows
        return self._table(table, batch).filter(F.col("bucket").isin(found)).drop("batch", "bucket")

    def _append(self, table: str, rows: DataFrame, batch: int) -> None:
        placed = rows.withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": self._bucket(table)})
        placed.repartition("bucket").drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/batch={batch}")

    def register(self, uploads: DataFrame, batch: int) -> Registered:
        """Register uploads (session_id, reg, filename, file_hash, hi, lo, payload) that come after all stored ones.

        Gives what `versions.register` over all uploads gives for these; reading
        it back later, with statuses, is `documents`.
        """
        named = stage_table(with_session(uploads).withColumn("doc_id", stem(F.col("filename"))))
        names = stage_table(self.touched("names", named, batch).join(named.select("session_id", "doc_id").distinct(), ["session_id", "doc_id"], "left_semi"))
        file = ["session_id", "doc_id", "file_hash"]
        fresh = named.join(names.select(*file).distinct(), file, "left_anti")
        older = names.groupBy("session_id", "doc_id").agg(F.min("reg").alias("_first"), F.max("version").alias("_known"))
        rows = v.registered_documents(fresh.drop("doc_id")).join(older, ["session_id", "doc_id"], "left")
        rows = rows.withColumn("version", (F.col("version") + F.coalesce("_known", F.lit(0))).cast("bigint"))
        newest = rows.groupBy("session_id", "doc_id").agg(F.min("reg").alias("_own"))
        rows = rows.join(newest, ["session_id", "doc_id"]).withColumn("doc_first", F.coalesce("_first", "_own")).drop("_first", "_known", "_own")
        rows = stage_table(rows)

        inside = v.nearest_prior(rows, self.max_distance).select("reg", "distance", "prior")
        stored = rows.select("reg", *_HASH).join(self._nearest_stored(rows, batch), _HASH).select("reg", "distance", "prior")
        best = inside.unionByName(stored).groupBy("reg").agg(F.min(F.struct("distance", "prior")).alias("b")).select("reg", "b.distance", "b.prior")
        matched = stage_table(v.judged(rows, best))

        columns = [c.strip().split(" ")[0] for c in self._schema("names").split(",") if "<" not in c] + ["supersedes"]
        self._append("names", matched.select(*dict.fromkeys(columns)), batch)
        prior = F.struct("doc_first", "version", "reg", "doc_id", "filename").alias("prior")
        self._append("hashes", rows.select(*_HASH, prior), batch)
        self._append("replaced", v.replacements(matched).join(matched.select(F.col("reg").alias("by"), "session_id"), "by").select("session_id", "reg", "doc_id", "by"), batch)
        known = names.select(*file).distinct()
        again = v.exact_duplicates(fresh.drop("doc_id")).drop("first_reg").unionByName(named.join(known, file, "left_semi"), allowMissingColumns=True)
        duplicate = again.select(
            "reg", "filename", F.lit("duplicate").alias("result"), F.format_string(fv.MSG_EXACT_DUPLICATE, F.col("filename")).alias("message")
        )
        return Registered(matched, matched.select("reg", "filename", "result", "message").unionByName(duplicate))

    def _nearest_stored(self, rows: DataFrame, batch: int) -> DataFrame:
        """(session_id, hi, lo, distance, prior) of the closest stored document of each hash; appends the batch's new keys."""
        hashes = stage_table(rows.select(*_HASH).distinct().withColumn("id", F.monotonically_increasing_id()))
        keyed = stage_table(hashes.select(*_HASH, F.explode(band_keys(self.max_distance)).alias("band")))
        near = self.touched("bands", keyed, batch).join(keyed.select(*_BAND).distinct(), _BAND, "left_semi")
        near = stage_table(near.select(*_HASH).unionByName(hashes.select(*_HASH)).distinct())
        told = self.touched("hashes", near, batch).join(near, _HASH, "left_semi").groupBy(*_HASH).agg(F.min("prior").alias("prior"))
        told = stage_table(told.select(*_HASH, "prior.*", F.lit(-1).cast("bigint").alias("id"), F.lit(False).alias("asks"), F.lit(0).cast("bigint").alias("turn")))
        nothing = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in PRIOR]
        asking = hashes.select(*_HASH, *nothing, "id", F.lit(True).alias("asks"), F.lit(1).cast("bigint").alias("turn"))
        best = nearest_earlier(asking.unionByName(told), self.max_distance, self.hot)
        best = stage_table(hashes.join(best, "id").drop("id"))
        fresh = keyed.join(told.select(*_HASH), _HASH, "left_anti")
        self._append("bands", fresh.select(*_BAND, "hi", "lo"), batch)
        return best

    def documents(self, before: int | None = None) -> DataFrame:
        """The registry: what `versions.register` gives for all uploads, or for those of earlier batches."""
        names = self._table("names", before).drop("batch", "bucket")
        return v.with_status(names, self._table("replaced", before).select("reg", "doc_id", "by"))

    def compact(self, into: RegistryStore) -> None:
        """Write all batches as batch 0 of another, empty store, one file a bucket."""
        for table in _KEYS:
            rows = self._table(table).drop("batch", "bucket")
            into._append(table, rows, 0)
