"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results, not only speed: UTC instants everywhere.
_RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Driver-side only: skip PySpark's per-expression call-site capture (it
# costs milliseconds per Column built and only enriches error messages).
_DRIVER_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Settings for scale: AQE re-plans joins and coalesces shuffle partitions at
# runtime and splits skewed join partitions.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Writer options.  Posts hold their text several times (as text and title, and in
# raw_data), so what is written of them is packed: text files by gzip at a fast level,
# tables by zstd.
PACKED_TEXT = {"compression": "gzip", "zlib.compress.level": "THREE"}
PACKED_TABLE = {"compression": "zstd"}


def get_session(master: str | None = None, app: str = "postlake",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build or fetch a session with the engine's settings.

    ``master`` is only meant for local runs and tests; on a cluster the
    launcher decides it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_RESULT_CONF)
    conf.update(_SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting settings to an existing session."""
    for k, v in _RESULT_CONF.items():
        spark.conf.set(k, v)
    for k, v in list(_SCALE_CONF.items()) + list(_DRIVER_CONF.items()):
        try:
            spark.conf.set(k, v)
        except Exception:  # static on some deployments; the cluster decides
            pass
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for lineage cuts, stores and stream state.

    Read from ``spark.checkpoint.dir`` (the folder the cluster names).  Only
    when it is unset -- local runs and tests -- a folder under the system temp
    directory is created and registered, so every executor of a local session
    sees the same path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="postlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def free_names(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, each with a number behind if a column has it already
    (Spark names are case insensitive)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        free, n = name, 1
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def staged(df, name: str):
    """Write ``df`` once to the shared folder and read it back: for results that a
    plan uses several times.  The caller may drop the folder (``delete``)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, through Hadoop FS."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def make_folder(spark: SparkSession, path: str) -> str:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hpath)
    return path


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, so that all its files appear at once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(hpath) if s.isDirectory())


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for local filesystem helpers."""
    if p.startswith("file://"):
        return p[len("file://"):]
    if p.startswith("file:"):
        return p[len("file:"):]
    return p


def exists(spark: SparkSession, path: str) -> bool:
    """Path existence through Hadoop FS, so it works on any filesystem."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file atomically (write, then rename over) via Hadoop FS."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    tmp = jvm.org.apache.hadoop.fs.Path(path + f".tmp-{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    # One atomic rename over the old file: a crash leaves the old or the new
    # one, never none.
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    overwrite = jvm.java.lang.reflect.Array.newInstance(option, 1)
    overwrite[0] = next(x for x in option.getEnumConstants() if x.toString() == "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(tmp, target, overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    inp = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(inp, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        inp.close()
