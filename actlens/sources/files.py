"""Readers and writers for files: sample lists, tables with a tab between columns, token counts, activation stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, smiles): the lines of text files, in order of file name; a line's number is its index, without gaps, from 0. Only the line feed is cut off.

    Rows are numbered inside each block of a file by the reader; a running sum over the blocks (a row each) closes the gaps.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path, lineSep="\n").select("value", *at, F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    base = blocks.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    return lines.join(base, ["file", "start"]).select((F.col("id") + F.col("base")).alias("sample_idx"), F.col("value").alias("smiles"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(smiles, sample_idx): each distinct line with the number of its last occurrence."""
    return lines.groupBy("smiles").agg(F.max("sample_idx").alias("sample_idx"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nanValue="NaN")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes Parquet unless df is empty; whether it wrote."""
    if df.isEmpty():
        return False
    df.write.parquet(path)
    return True


def token_counts_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) from a JSON object {token: n}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,long>")).alias("token", "n"))


def write_acts(acts: DataFrame, path: str, sae_key: str) -> None:
    """Long activation store, a folder per model, sorted by sample inside files."""
    acts.withColumn("sae_key", F.lit(sae_key)).repartition("sample_idx").sortWithinPartitions("sample_idx", "feature", "token_idx").write.partitionBy("sae_key").mode("append").parquet(path)


def write_bins(bins: DataFrame, path: str) -> None:
    """The sparse bit map (sample_idx, feature, bins), a row per pair with a hit, sorted by sample inside files; pairs without a row are 0."""
    bins.repartition("sample_idx").sortWithinPartitions("sample_idx", "feature").write.mode("overwrite").parquet(path)


def chunk_number(name: Column) -> Column:
    """The first number in a chunk's name, to sort chunks by; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).cast("int")


def key_parts(key: Column) -> Column:
    """(layer, latents, k) of a model's key layer-latents-k."""
    part = F.split(key, "-")
    return F.struct(*(F.get(part, F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(("layer", "latents", "k"))))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """User's column names to the canonical ones; a missing column is an error."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}; there are {df.columns}")
    return df.withColumnsRenamed(names)


class H5Activations(DataSource):
    """spark.read.format("h5acts").load(path): (sample_idx, token_idx, feature, value) of a chunked column-compressed HDF5 store. One partition per chunk. Needs h5py."""

    @classmethod
    def name(cls) -> str:
        return "h5acts"

    def schema(self) -> str:
        return "sample_idx long, token_idx int, feature int, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _H5Reader(self.options["path"])


class _H5Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import h5py

        with h5py.File(self.path, "r") as f:
            names = sorted((g for g in f if g[1:].isdigit()), key=lambda g: int(g[1:]))
            first = 0
            out = []
            for g in names:
                out.append(InputPartition((g, first, int(f.attrs["num_features"]))))
                first += len(f[g]["molptr"])
            return out

    def read(self, partition):
        import h5py
        import numpy as np
        import pyarrow as pa

        group, first, n_features = partition.value
        with h5py.File(self.path, "r") as f:
            n, ptr, idx, val = (f[group][k][:] for k in ("molptr", "indptr", "indices", "data"))
        at = 0
        for i, own in enumerate(ptr.reshape(len(n), n_features + 1)):
            size = int(own[-1])
            feature = np.repeat(np.arange(n_features), np.diff(own))
            own = [pa.array(np.full(size, first + i)), pa.array(idx[at : at + size].astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(val[at : at + size].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(own, ["sample_idx", "token_idx", "feature", "value"])
            at += size


def last_line_wins(labels: DataFrame) -> DataFrame:
    """Of repeated (sample_idx, concept) rows the last by line number; for sources whose later rows replace earlier ones."""
    w = Window.partitionBy("sample_idx", "concept").orderBy(F.desc("line_no"))
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
