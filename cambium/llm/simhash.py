"""SimHash near-duplicates within two bits, by meet-in-the-middle ball hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cambium.llm.common import batched, durable, fresh, told_apart
from cambium.llm.components import connected_components
from cambium.llm.shingles import components, shingle_hashes

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, XXH64 with seed 42 of each shingle."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    count, raw = np.zeros(BITS, np.int64), np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        count += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a signed 64-bit SimHash of every whole text; null texts count as empty, empty ones have 0."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode(), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect what pairs within `radius` bits connect, from one row (fp, rep) a distinct fingerprint.

    Two fingerprints within 2r bits share a variant within r of both. Every fingerprint is sent to its variants within
    half the radius (r = 1: 65 of them); one shuffle on the variant brings colliding ones together, at most 65 in a
    group as fingerprints are distinct, and each is linked with the first of its group after a check of the distance.
    All members of a group are within 2r of each other, so these stars connect what all pairs would.
    """
    if radius not in (0, 2):
        raise ValueError("radius: 0 or 2 bits")
    if radius == 0:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    sent = classes.select("fp", "rep", F.explode(ball).alias("flip")).select("fp", "rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    first = Window.partitionBy("variant").orderBy("fp")
    met = sent.select("fp", "rep", F.first("fp").over(first).alias("fp0"), F.first("rep").over(first).alias("rep0"))
    near = met.where("fp != fp0").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= radius)
    return near.select(F.col("rep").alias("a"), F.col("rep0").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for each row of docs; component: the smallest id reachable by links within `radius` bits.

    Nulls: a null or empty text has fingerprint 0 and links like any other; a row with a null id keeps its fingerprint
    and gets the component of that fingerprint, null if no row with an id has it. Rows repeated with the same id give
    one output row each. An empty table gives an empty table. Exact groups are first reduced to one class with their
    smallest id (partial aggregation), so a large group is one row in everything that follows.
    """
    prints = durable(fingerprints(docs, shingle, id_col, text_col))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    found = connected_components(links(classes.where("rep is not null"), radius))
    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(of_class, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each component of similar texts (see `shingles`): that of its smallest doc_id.

    A row counts by id and text, so unlike texts under one doc_id both stay; of one component, the least text hash. Rows
    with a null doc_id can't be named by a component: all of them stay. Rows that repeat both id and text leave one.
    Only texts that go are shuffled, and those that share their slot of a bitmap.
    """
    h, n, key = fresh("hash"), fresh("n"), F.xxhash64("doc_id", F.xxhash64("text"))
    named = docs.where("doc_id is not null")
    group = components(named.select(F.xxhash64("text").alias("h"), "text"), shingle).withColumnRenamed("h", h)
    rows = durable(named.groupBy("doc_id", F.xxhash64("text").alias(h)).agg(F.count("*").alias(n)).join(group, h))
    keep = rows.groupBy("component").agg(F.min(F.struct("doc_id", h)).alias("m")).select("m.doc_id", f"m.{h}", F.lit(True).alias("first"))
    touched = durable(rows.join(keep, ["doc_id", h], "left").where(F.col("first").isNull() | (F.col(n) > 1)).select("doc_id", h, F.coalesce("first", F.lit(False)).alias(n)))
    some, rest = told_apart(named, key, touched.select(F.xxhash64("doc_id", h).alias(h)))
    met = some.withColumn(h, F.xxhash64("text")).join(touched, ["doc_id", h], "left")
    stay = met.where(F.col(n).isNull()).unionByName(met.where(n).dropDuplicates(["doc_id", h])).select(docs.columns)
    return rest.unionByName(stay).unionByName(docs.where("doc_id is null"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
