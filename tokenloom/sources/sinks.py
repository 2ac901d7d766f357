"""Writers for chunks, packed samples, prompts and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.prompt_files import PromptFiles
from tokenloom.staging import remove


def write_samples(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "errorifexists") -> None:
    """Write chunk or padded-sample rows as Parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_shards(df: DataFrame, path: str, num_shards: int, index: str) -> None:
    """Exact round-robin on disk: row n of ``index`` goes to the folder ``shard=n % num_shards``.

    Rows are dealt by shard number itself, so each shard is written by one task into one folder of its own and a
    loader reads nothing else. Within a shard rows stay in the order of ``index``.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    shard = F.pmod(F.col(index), F.lit(num_shards)).cast("int")
    placed = df.withColumn("shard", shard).repartitionById(num_shards, F.col("shard"))
    placed.sortWithinPartitions("shard", index).write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard of ``write_shards`` in the order it was written; the other folders are not opened."""
    return spark.read.parquet(path).where(F.col("shard") == shard)


def sample_id(id_column: Column, index: Column) -> Column:
    """The sample's id, or ``sample_NNN`` from its zero-based position."""
    return F.coalesce(id_column.cast("string"), F.format_string("sample_%03d", index))


def manifest(prompts: DataFrame, output_dir: str, id_column: str = "id") -> DataFrame:
    """``(id, output)``: where each prompt goes."""
    where = F.concat(F.lit(output_dir.rstrip("/") + "/"), F.col(id_column), F.lit(".prompt.txt"))
    return prompts.select(F.col(id_column).alias("id"), where.alias("output"))


def write_prompts(prompts: DataFrame, output_dir: str, id_column: str = "id",
                  prompt_column: str = "prompt", mode: str = "errorifexists") -> None:
    """Prompt table and manifest, the layout meant for large sets."""
    table = prompts.select(F.col(id_column).alias("id"), F.col(prompt_column).alias("prompt"))
    table.write.mode(mode).parquet(f"{output_dir}/prompts")
    manifest(prompts, output_dir, id_column).write.mode(mode).json(f"{output_dir}/manifest")


def write_prompt_files(prompts: DataFrame, output_dir: str, id_column: str = "id",
                       prompt_column: str = "prompt") -> int:
    """One ``{id}.prompt.txt`` per sample, and the manifest; returns the count.

    ``output_dir`` is a path or an address that Arrow's file systems know; files show up when all tasks are done, and a
    failed job leaves none. A null prompt fails the job. Ids that are null, repeat or could name a place outside the folder
    are refused before anything is written. Meant for small sets: into an existing folder files are moved one by one.
    """
    spark = prompts.sparkSession
    ids = prompts.select(F.col(id_column).cast("string").alias("id"))
    unsafe = ids.where(F.col("id").isNull() | F.col("id").rlike(r"[/\\\x00]") | (F.col("id") == "")).limit(1).collect()
    if unsafe:
        raise ValueError(f"not a file name: {unsafe[0].id!r}")
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"two samples have the id {repeated[0].id!r}")
    spark.dataSource.register(PromptFiles)
    seen = Observation()
    name = F.concat(F.col(id_column).cast("string"), F.lit(".prompt.txt")).alias("name")
    rows = prompts.select(name, F.col(prompt_column).alias("text")).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.format(PromptFiles.name()).mode("append").save(output_dir)
    manifest(prompts, output_dir, id_column).write.mode("overwrite").json(f"{output_dir}/manifest")
    return seen.get["rows"]


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, in files with the suffix that readers of JSON lines look for.

    Spark's writer names them ``.json``; each is renamed in place once the write has been committed.
    """
    df.write.json(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}l"))


def write_counted(df: DataFrame, path: str, counts: dict[str, Column] | None = None, required: bool = True) -> dict[str, int]:
    """Write ``df`` as Parquet and return its number of ``rows`` and the aggregates asked for, from the writing job itself.

    With ``required`` an empty result is removed again and fails, without having been scanned a second time.
    """
    seen = Observation()
    wanted = {"rows": F.count(F.lit(1)), **(counts or {})}
    df.observe(seen, *[c.alias(name) for name, c in wanted.items()]).write.parquet(path)
    found = seen.get
    if required and not found["rows"]:
        remove(df.sparkSession, path)
        raise ValueError("there are no rows to write")
    return {name: found[name] for name in wanted}
