"""Tables that are replaced as a whole: each state is written beside the ones before it, and one small file names what it consists of."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, root: str) -> tuple[Any, Any]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and contents of the last state that was committed; 0 and nothing before the first one."""
    path, store = _files(spark, root)
    folder = path(f"{root}/states")
    if not store.exists(folder):
        return 0, {}
    numbers = [int(s.getPath().getName().removesuffix(".json")) for s in store.listStatus(folder) if s.getPath().getName().endswith(".json")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{root}/states/{max(numbers):010d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, root: str, number: int, state: dict) -> None:
    """Make ``state`` the one with this number, if nobody else has. It is written in full under another name and then renamed, which either happens or does not."""
    path, store = _files(spark, root)
    draft, final = path(f"{root}/states/{uuid.uuid4().hex}.draft"), path(f"{root}/states/{number:010d}.json")
    out = store.create(draft, False)
    out.write(json.dumps(state).encode())
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(draft, final, plain)


def new_folder(root: str, name: str) -> str:
    return f"{root}/data/{name}-{uuid.uuid4().hex}"


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete what only states before the last ``keep`` ones refer to, and these states' files; how many folders were there?"""
    path, store = _files(spark, root)
    number, _ = latest(spark, root)
    states = {n: json.loads(spark.read.text(f"{root}/states/{n:010d}.json", wholetext=True).first()[0])
              for n in range(max(1, number - keep + 1), number + 1) if store.exists(path(f"{root}/states/{n:010d}.json"))}
    said = json.dumps(list(states.values()))
    gone = 0
    if store.exists(path(f"{root}/data")):
        for s in store.listStatus(path(f"{root}/data")):
            if s.getPath().getName() not in said:
                store.delete(s.getPath(), True)
                gone += 1
    for s in store.listStatus(path(f"{root}/states")):
        if s.getPath().getName().removesuffix(".json") not in {f"{n:010d}" for n in states}:
            store.delete(s.getPath(), True)
    return gone


def write_table(df: DataFrame, root: str) -> None:
    """Replace a table: readers see the old rows or the new ones, and a job that fails or a second writer at the same time leaves the old ones. The state before stays until
    the next write, for those who still read it."""
    spark = df.sparkSession
    number, _ = latest(spark, root)
    folder = new_folder(root, "rows")
    df.write.parquet(folder)
    commit(spark, root, number + 1, {"rows": folder.rsplit("/", 1)[1]})
    vacuum(spark, root, 2)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last state of ``write_table``."""
    number, state = latest(spark, root)
    if not number:
        raise FileNotFoundError(f"no table at {root}")
    return spark.read.parquet(f"{root}/data/{state['rows']}")
