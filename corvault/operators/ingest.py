"""Incremental ingest: identities, manifest, upsert, delete, and the counts around them.

Tables are plain Parquet.  A version of a table is a list of directories in a small numbered pointer
file, the last of which counts, so nothing is overwritten while it is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvault.functions import text as T


def plain_hash(c: Column) -> Column:
    """A content hash in any of its notations (prefix, capitals, dashes) as 64 small hex digits, else null."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"(?i)^(?:sha-?256[:=]?|0x)\s*", ""))
    bare = F.regexp_replace(bare, "[^0-9a-f]", "")
    return F.when(F.length(bare) == 64, bare)


def instant(c: Column) -> Column:
    """A time in ISO text with or without fraction, zone or the letter T, in UTC; null where it is none."""
    shaped = F.regexp_replace(F.trim(c), " ", "T")
    return F.coalesce(F.try_to_timestamp(shaped), F.try_to_timestamp(F.trim(c)))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; without an order, the one of the least hash, the same in every run."""
    w = Window.partitionBy(*keys).orderBy(*(order or (F.xxhash64(*(c for c in df.columns)),)))
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def chunk_key(doc_id: Column, kind: Column, source: Column, chunk_index: Column) -> Column:
    """The identity of a parent or plain chunk: its document id, else a hash of where it comes from."""
    made = F.concat(F.lit("auto_"), F.substring(F.sha2(F.concat_ws("::", kind, source, chunk_index.cast("string")), 256), 1, 16))
    return F.coalesce(F.when(doc_id != "", doc_id), made)


def child_key(parent_doc_id: Column, chunk_index: Column, *row: Column) -> Column:
    """The identity of a child: its parent and number; where either is missing, what there is and a hash of the row, so that no two such children meet."""
    told = F.when((parent_doc_id != "") & chunk_index.isNotNull(), F.concat(parent_doc_id, F.lit("_child_"), chunk_index.cast("string")))
    mark = F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("\1")) for c in row)), 256), 1, 16)
    made = F.concat(F.coalesce(F.nullif(parent_doc_id, F.lit("")), F.lit("unknown")), F.lit("_child_"), F.coalesce(chunk_index.cast("string"), F.lit("")), F.lit("_"), mark)
    return F.coalesce(told, made)


def embedding_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), text), 256)


def content_hashes(chunks: DataFrame, file_col: str = "file_path") -> DataFrame:
    """(file_path, content_hash): SHA-256 over the texts of a file's chunks in order, joined by an empty line.

    A chunk delivered again counts once (the earliest row), null text as empty.
    """
    first = latest(chunks, [file_col, "chunk_id"], F.col("row_id"))
    texts = F.array_sort(F.collect_list(F.struct("chunk_index", "row_id", F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n")
    return first.groupBy(file_col).agg(F.sha2(joined, 256).alias("content_hash"))


def new_or_changed(incoming: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys the manifest doesn't have; a null key is never known."""
    return incoming.join(manifest.select(*keys).distinct(), keys, "left_anti")


def precheck(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(wanted, present, missing, action): whether a run can be skipped, and if not, all of it is processed."""
    known = present.select(key).distinct().withColumn("known", F.lit(1))
    one = wanted.select(key).distinct().join(known, key, "left").agg(F.count("*").alias("wanted"), F.count("known").alias("present"))
    missing = F.col("wanted") - F.col("present")
    return one.select("wanted", "present", missing.alias("missing"), F.when(missing == 0, "skipped").otherwise("process").alias("action"))


def upsert(current: DataFrame, new: DataFrame, key: str, *newest: Column) -> DataFrame:
    """``current`` with the rows of ``new`` in place of rows of equal key; of equal keys in ``new`` the first in the order ``newest`` counts."""
    new = latest(new, [key], *newest)
    return new.unionByName(current.join(new.select(key), key, "left_anti"))


def deleted(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def estimate(files: DataFrame, size_col: str, source_col: str) -> DataFrame:
    """(records, documents, seconds): a thousand bytes make a record, every source at least one."""
    per = files.groupBy(source_col).agg(F.sum(size_col).alias("size")).select(F.greatest(F.lit(1), F.floor(F.col("size") / 1000)).alias("records"))
    total = per.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count("*").alias("documents"))
    return total.withColumn("seconds", F.col("records") * 0.1 + F.col("documents") * 0.5)


def free_names(names: DataFrame, name_col: str, *order: str, taken: DataFrame | None = None) -> DataFrame:
    """Every name once, in the order of arrival: a name that is taken gets the smallest free _1, _2, ... before its extension.

    ``taken`` (one column): names that are there before.  What a name may collide with are only names of its own stem and
    extension with a number or without, so each such family is settled on its own, in one task.
    """
    from collections.abc import Iterator

    import pandas as pd

    stem, ext = F.regexp_extract(name_col, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name_col, r"^(.*?)(\.[^.]*)?$", 2)
    family = F.concat(F.regexp_replace(stem, "(?:_[0-9]+)+$", ""), F.lit("\0"), ext)
    rows = names.withColumn("family_", family).withColumn("place_", F.struct(*order)).withColumn("there_", F.lit(False))
    columns = names.columns
    if taken is not None:
        there = taken.select(F.col(taken.columns[0]).alias(name_col)).withColumn("family_", family).withColumn("there_", F.lit(True))
        rows = rows.unionByName(there, allowMissingColumns=True)
    rows = rows.repartition("family_").sortWithinPartitions("family_", F.desc("there_"), "place_").drop("place_")

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[str] = set()
        last = None
        for pdf in parts:
            out = []
            for name, fam, there in zip(pdf[name_col], pdf["family_"], pdf["there_"]):
                if fam != last:
                    used, last, following = set(), fam, {}
                got = name
                if not there and name in used:
                    dot = name.rfind(".")
                    a, b = (name[:dot], name[dot:]) if dot >= 0 else (name, "")
                    n = following.get(name, 1)
                    while f"{a}_{n}{b}" in used:
                        n += 1
                    following[name] = n
                    got = f"{a}_{n}{b}"
                used.add(got)
                out.append(got)
            pdf = pdf.assign(free_name=out)
            yield pdf[~pdf["there_"]][[*columns, "free_name"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields)
    return rows.where(F.col(name_col).isNotNull()).mapInPandas(settle, schema + ", free_name string").unionByName(names.where(F.col(name_col).isNull()).withColumn("free_name", F.lit(None).cast("string")))


def mirrored_path(path: Column, root: str) -> Column:
    """Where the Markdown of a file goes: its path below ``root``, else below a directory named by a hash of its own directory."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    outside = F.concat(F.lit("_external_"), F.substring(F.sha1(folder), 1, 8), F.lit("/"), F.regexp_extract(path, "([^/]+)$", 1))
    return F.concat(F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(outside), F.lit(".md"))


def sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed; 0 keeps all."""
    return df if n <= 0 else df.orderBy(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))), 256), id_col).limit(n)


class Table:
    """A table of versions: a write adds one and then names it the current one in a new, numbered pointer.

    A pointer is written under another name and renamed, and none is deleted before a later one is there, so a
    writer that dies leaves the version before.  Rows are dealt to ``buckets`` by a hash of their key; an upsert
    or delete writes only the buckets that it touches, and the new version refers to the others where they are.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[int]:
        fs, at = self._fs()
        found = fs.globStatus(at(f"{self.path}/current-*.json")) or []
        return sorted(int(s.getPath().getName()[8:-5]) for s in found)

    def _state(self) -> dict | None:
        """The current version: its number, the columns of its buckets' key, and the folder of each bucket."""
        known = self._pointers()
        if not known:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/current-{known[-1]}.json").collect()))

    def version(self) -> int | None:
        known = self._pointers()
        return known[-1] if known else None

    def read(self) -> DataFrame | None:
        state = self._state()
        if state is None:
            return None
        schema = StructType.fromJson(state["schema"])
        folders = sorted(set(state["folders"].values()))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _put(self, df: DataFrame, key: str | None, kept: dict[str, str]) -> None:
        name = f"{self.path}/v-{uuid.uuid4().hex}"
        bucket = self._bucket(key) if key else F.lit(0)
        parted = df.withColumn("bucket_", bucket)
        parted = parted.repartition("bucket_") if key else parted
        parted.write.partitionBy("bucket_").parquet(name)
        fs, at = self._fs()
        made = {s.getPath().getName().partition("=")[2]: s.getPath().toString() for s in fs.globStatus(at(f"{name}/bucket_=*")) or []}
        known = self._pointers()
        state = {"key": key, "schema": json.loads(df.schema.json()), "folders": kept | made}
        no = (known[-1] if known else 0) + 1
        draft = at(f"{self.path}/_next-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(draft, at(f"{self.path}/current-{no}.json")):
            fs.delete(draft, False)
            raise RuntimeError("another writer was first; nothing is lost, run again")
        self._tidy()

    def _tidy(self) -> None:
        """Removes pointers older than the last ``keep``, and the folders that none of these names."""
        fs, at = self._fs()
        known = self._pointers()
        old, held = known[: -self.keep], set()
        for n in known[-self.keep :]:
            state = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/current-{n}.json").collect()))
            held |= {f.rpartition("/")[0] for f in state["folders"].values()}
        if not old:
            return
        for n in old:
            fs.delete(at(f"{self.path}/current-{n}.json"), False)
        for s in fs.globStatus(at(f"{self.path}/v-*")) or []:
            if s.getPath().toString() not in held:
                fs.delete(s.getPath(), True)

    def write(self, df: DataFrame, key: str | None = None) -> None:
        """A version of just these rows."""
        self._put(df, key, {})

    def append(self, df: DataFrame, key: str) -> None:
        """Adds rows as they are, without looking for equal keys."""
        now = self.read()
        self._merge(df, key, lambda old, new: new if old is None else old.unionByName(new), now)

    def upsert(self, new: DataFrame, key: str, *newest: Column) -> None:
        """Rows of equal key are replaced; of equal keys in ``new`` the first in the order ``newest`` counts.  Null keys are kept as rows of their own."""
        new = new.withColumn("null_", F.col(key).isNull())
        first = latest(new.where("not null_"), [key], *newest).unionByName(new.where("null_")).drop("null_")
        self._merge(first, key, lambda old, fresh: fresh if old is None else fresh.unionByName(old.join(fresh.select(key), key, "left_anti")), self.read())

    def _merge(self, new: DataFrame, key: str, join, now: DataFrame | None) -> None:
        state = self._state()
        if state is None or state["key"] != key:
            self.write(join(now, new), key)
            return
        touched = {str(r[0]) for r in new.select(self._bucket(key)).distinct().collect()}
        self._put(join(self._of(state, touched), new), key, {b: f for b, f in state["folders"].items() if b not in touched})

    def _of(self, state: dict, buckets: set[str]) -> DataFrame | None:
        folders = [f for b, f in state["folders"].items() if b in buckets]
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*folders) if folders else None

    def delete(self, gone: DataFrame, *keys: str) -> None:
        """Writes what is to go beside the versions first, then the table without it."""
        now, state = self.read(), self._state()
        if now is None:
            return
        gone = gone.select(*keys).distinct()
        gone.write.parquet(f"{self.path}/deleted-{uuid.uuid4().hex}")
        if state["key"] in keys:
            touched = {str(r[0]) for r in gone.select(self._bucket(state["key"])).distinct().collect()}
            old = self._of(state, touched)
            if old is not None:
                self._put(deleted(old, gone, list(keys)), state["key"], {b: f for b, f in state["folders"].items() if b not in touched})
        else:
            self.write(deleted(now, gone, list(keys)), state["key"])

    def clear(self) -> None:
        fs, at = self._fs()
        fs.delete(at(self.path), True)


def canonical(chunks: DataFrame) -> DataFrame:
    """Rows of chunk files with defaults filled in, one level spelling, and their collection and key."""
    kind = F.coalesce(T.chunk_kind(F.col("file_path")), F.lit("chunks"))
    collection = F.when(kind == "children", "child").otherwise("parent")
    key = F.when(kind == "children", child_key(F.col("doc_id"), F.col("chunk_index"), F.col("row_id"), F.col("source"), F.col("text"))).otherwise(chunk_key(F.col("doc_id"), kind, F.col("source"), F.col("chunk_index")))
    name = F.coalesce(F.when(F.trim("document_name") != "", F.col("document_name")), F.col("source"))
    return chunks.select(
        "row_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), "chunk_index", "source", F.coalesce("page", F.lit(0)).alias("page"), "chunk_type",
        name.alias("document_name"), F.regexp_replace("source", r"\.md$", "").alias("original_file_name"), T.level_of(F.col("classification"), F.col("file_path")).alias("level"),
        kind.alias("kind"), collection.alias("collection"), key.alias("id"), "file_path", "batch_no", "ts",
    )
