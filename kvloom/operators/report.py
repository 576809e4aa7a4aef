"""Analysis of run records: flatten, derive, filter, group, pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records (JSON files in folders, one of which names the data set) with dataset and file."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name()).withColumn("dataset", F.element_at(F.split("file", "/"), -2))


def flatten(df: DataFrame, keep_arrays: bool = True) -> DataFrame:
    """Fields of structs as columns with dotted names, to any depth."""
    while True:
        structs = [f.name for f in df.schema.fields if f.dataType.typeName() == "struct"]
        if not structs:
            return df if keep_arrays else df.select(*[f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() != "array"])
        out = []
        for f in df.schema.fields:
            out += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}.{g}") for g in f.dataType.names] if f.name in structs else [F.col(f"`{f.name}`")]
        df = df.select(*out)


def by_substring(c: Column, names: list[str], other: str) -> Column:
    """The first of names that c contains."""
    out = None
    for n in names:
        out = F.when(c.contains(n), n) if out is None else out.when(c.contains(n), n)
    return out.otherwise(other) if out is not None else F.lit(other)


def _mark(mark: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in mark)


def head(c: Column, mark: str) -> Column:
    """What comes before the first mark (taken as it is, not as a pattern)."""
    return F.split(c, _mark(mark))[0]


def tail(c: Column, mark: str) -> Column:
    """What comes after the last mark."""
    return F.element_at(F.split(c, _mark(mark)), -1)


def fixed_up(c: Column, wrong: dict[str, str]) -> Column:
    """c with the values that wrong names replaced, as names that lost a digit when they were cut."""
    out = None
    for a, b in wrong.items():
        out = F.when(c == a, b) if out is None else out.when(c == a, b)
    return c if out is None else out.otherwise(c)


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.median(value).alias(f"median_{value}"))


def means(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"avg_{value}"))


def wide(df: DataFrame, row: str, column: str, names: list, value: str, how=F.median) -> DataFrame:
    """A row for each value of row, a column for each of names; naming them saves a pass over the data."""
    return df.groupBy(row).pivot(column, names).agg(how(value))


def unnest(df: DataFrame, array: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(array).alias("item")).select(*keep, "item.*")


def append_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))


def by_threads(df: DataFrame, value: str, algo: str = "algo", threads: str = "num_threads") -> DataFrame:
    """Median of a measure by operator and thread count, with the speed-up over one thread."""
    out = medians(df, value, algo, threads)
    one = out.where(F.col(threads) == 1).select(F.col(algo).alias("__a"), F.col(f"median_{value}").alias("__one"))
    return out.join(one, F.col(algo) == F.col("__a"), "left").select(algo, threads, f"median_{value}", (F.col("__one") / F.col(f"median_{value}")).alias("speedup"))


def by_epsilon(df: DataFrame, value: str, index: str = "index", epsilon: str = "epsilon") -> DataFrame:
    """Median of a measure by kind of index and its error."""
    return medians(df, value, index, epsilon)


def by_memory(df: DataFrame, value: str, algo: str = "algo", memory: str = "memory") -> DataFrame:
    """Median of a measure by operator and memory limit, the limit in MB."""
    return medians(df.withColumn("memory_mb", F.floor(F.col(memory) / (1 << 20))), value, algo, "memory_mb")


def to_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of at most `most` rows as Markdown; more rows are an error, as a report isn't a sample."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(cell(x) for x in r) + " |" for r in lines) + "\n"
