"""Places and helpers that the operators share: the cluster's shared folder, code shipping, Arrow maps."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words, as characters and as a Java/RE2 class.
WS = " \t\n\x0b\f\r"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset, a local session (as in tests) uses a folder of its own, and any other is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/weft-{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again; this cuts its lineage."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="weft-code-")) / "weftgraph_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def local_path(uri: str) -> str | None:
    """The path of a file:// or scheme-less uri, None for any other store."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def store(uri: str):
    """(pyarrow file system, path) of a uri in the shared folder."""
    from pyarrow import fs

    local = local_path(uri)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> None:
    """Writes the byte strings of parts to uri so that a reader sees the whole file or none."""
    files, path = store(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    files.move(temp, path)


def open_map(uri: str):
    """A read-only buffer over the file: memory-mapped on a local or mounted store, else read once."""
    import pyarrow as pa

    files, path = store(uri)
    if local_path(uri):
        with pa.memory_map(path) as m:
            return m.read_buffer() if m.size() else pa.py_buffer(b"")
    with files.open_input_file(path) as f:
        return pa.py_buffer(f.read())


def npz_bytes(**arrays) -> bytes:
    import numpy as np

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def arrow_columns(df: DataFrame, column: str, made: list, start, rows: int = 1024, without: tuple = ()) -> DataFrame:
    """df with the columns `made` (pairs of name and Spark type), which replace columns of these names, and without those
    named in `without`.

    In each task start() returns a function from an Arrow array of `column` to as many Arrow arrays as `made` names; it
    gets at most `rows` rows at a time. Every column crosses to Python once, and `column` back only if it is kept. Columns
    travel under other names, so theirs may clash in any way.
    """
    from pyspark.sql import types as T

    ship(df.sparkSession)
    names = [n for n, _ in made]
    gone = {n.lower() for n in (*names, *without)}
    fields = list(df.schema)
    place = next(i for i, f in enumerate(fields) if f.name.lower() == column.lower())
    kept = [i for i, f in enumerate(fields) if f.name.lower() not in gone]
    sent = sorted({*kept, place})
    back, at = [sent.index(i) for i in kept], sent.index(place)
    inner = df.toDF(*[f"_{i}" for i in range(len(fields))]).select(*[f"_{i}" for i in sent])
    out_names = [f"_{i}" for i in kept] + [f"made_{i}" for i in range(len(made))]

    def run(batches):
        import pyarrow as pa

        work = start()
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in back), *work(part.column(at))], names=out_names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(out_names, [fields[i].dataType for i in kept] + [t for _, t in made])])
    return inner.mapInArrow(run, schema).toDF(*[fields[i].name for i in kept], *names)
