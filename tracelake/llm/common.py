"""What the operators share: saved tables, names for helper columns, memory, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.workspace import LOCAL_DIR, Workspace, shared_dir  # noqa: F401


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names as helper columns, with underscores added until no column has them (Spark's names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def release_memory() -> None:
    """Give freed memory back to the system, since Python workers stay for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work`, releasing memory at its end."""

    def worked(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release_memory()

    return worked


#: Keys with more rows than this, and than one in HOT_KEYS of all rows, are hot: fewer than HOT_KEYS can be.
HOT_ROWS, HOT_KEYS = 4_096, 100_000


def join_split(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """`big` joined to `small`, a saved table with a row a key; `n`, a column of `small` that goes, is the key's number of rows
    in `big`. how: inner, or left.

    No task gets all rows of a hot key: `small`'s rows of hot keys, if there are any, are broadcast, fewer than HOT_KEYS of
    them if `small` counts all of `big`'s `total` rows. The others meet by a shuffle.
    """
    bound = max(hot_rows, total // HOT_KEYS)
    hot = small.where(F.col(n) > bound).drop(n)
    if hot.isEmpty():
        return big.join(small.drop(n), on, how)
    rest = small.where(F.col(n) <= bound).drop(n)
    return big.join(F.broadcast(hot), on).unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
