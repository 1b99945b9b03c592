"""A Spark data source over directories of .npy arrays, one directory a chunk (S17): format "npy_chunks".

A chunk directory holds observations.npy (N, T) and valid_indices.npy (N, 2). Option `path` is a folder of chunk
directories on storage that driver and executors share; a chunk is one partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Chunk(InputPartition):
    def __init__(self, path: str, number: int) -> None:
        super().__init__(number)
        self.path, self.number = path, number


class ChunkReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if os.path.isfile(os.path.join(self.path, n, "observations.npy")))
        return [Chunk(os.path.join(self.path, n), i) for i, n in enumerate(names)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        values = np.load(os.path.join(partition.path, "observations.npy"), mmap_mode="r")
        places = np.load(os.path.join(partition.path, "valid_indices.npy"), mmap_mode="r")
        for at in range(0, len(values), 10_000):
            part, place = values[at : at + 10_000], places[at : at + 10_000]
            pct = np.where(np.isfinite(part), np.round(np.asarray(part, np.float64) * 100), -1).astype(np.int16)
            pct[np.asarray(part) >= 0.999] = 100
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(pct) + 1) * pct.shape[1]).astype(np.int32)), pa.array(pct.ravel(), mask=(pct < 0).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pct), partition.number, np.int32)), pa.array(np.asarray(place[:, 0], np.int32)), pa.array(np.asarray(place[:, 1], np.int32)), lists], ["chunk", "r", "c", "pct"])


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_chunks"

    def schema(self) -> str:
        return "chunk int, r int, c int, pct array<smallint>"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)
