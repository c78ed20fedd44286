"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import ensure_checkpoint_dir

_shipped: set[str] = set()
#: Rows sent to Python at once, where the session has Spark's own default: texts are long.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers (once per application), and keep the
    batches sent to them small unless the session has chosen a size."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="limnos-ship-"), "limnos_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back.

    Later jobs, also after a lost executor, start from the files.  Unlike a
    checkpoint, the table carries no constraints of the plan it came from; those
    pile up over the rounds of an iteration and fill the driver's memory."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system.

    Workers serve one stage after the other, and what one stage has freed stays with the process otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's
    if trim is not None:
        trim(0)


def crc_mod(column: str, modulo: int):
    """crc32 of the column as text, modulo ``modulo`` (NULL stays NULL)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulo


def vector_parts(counts, parts: int, kind: str = "<i8"):
    """A task's counts as (part, bytes) rows of equal length, for ``sum_parts``."""
    import pyarrow as pa

    step = len(counts) // parts
    return pa.RecordBatch.from_pydict({
        "part": pa.array(range(parts), pa.int32()),
        "counts": pa.array([counts[k * step:(k + 1) * step].astype(kind).tobytes() for k in range(parts)],
                           pa.binary())})


def sum_parts(rows: DataFrame, parts: int, length: int, kind: str = "<i8", tasks: int | None = None):
    """Element-wise sum of all tasks' vectors (part, counts); ``length`` values, whatever the input."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, kind)
                sums[part] = sums[part] + x if part in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array(
                [x.astype(kind).tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((parts, length // parts), kind)
    dealt = rows.select("part", "counts").repartition(tasks or parts, "part")
    for r in dealt.mapInArrow(run, "part int, counts binary").collect():
        out[r["part"]] += np.frombuffer(r["counts"], kind)
    return out.reshape(-1)


__all__ = ["crc_mod", "cut_lineage", "release_memory", "shared_dir", "ship", "sum_parts", "table", "vector_parts"]
