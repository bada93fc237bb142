"""Session settings and the shared scratch folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names
(a distributed file system path visible to all executors). Only when it is
unset and Spark runs in local mode (tests, the bench) is a local folder
created and registered.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Settings the library relies on; all are standard Spark SQL options.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Further settings of local sessions (tests, the bench) only.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "casegrid", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**RECOMMENDED_CONF, **LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-visible scratch folder (``spark.checkpoint.dir``).

    Read from the session. If unset: in local mode create one under the system
    temp folder and register it; on a cluster refuse, since a machine-local
    folder is not visible to other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext          # absent under Spark Connect
    except Exception:  # noqa: BLE001
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    local = sc is not None and sc.master.startswith("local")
    if d:
        if not local and urlparse(d).scheme == "file":
            raise RuntimeError(f"spark.checkpoint.dir is {d}: a machine-local folder on a cluster")
        return (_plain_local(d) if local else d).rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    d = tempfile.mkdtemp(prefix="casegrid-ckpt-")
    # spark.checkpoint.dir is a core setting and cannot be changed at runtime;
    # registering the folder is enough, later calls find it through the context.
    sc.setCheckpointDir(d)
    return _plain_local(sc.getCheckpointDir() or d)


def _plain_local(uri: str) -> str:
    """``file:/x`` or ``file:///x`` -> ``/x``; other URIs unchanged."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme == "file" else uri


_scratch: list[str] = []


def delete_at_exit(path: str) -> str:
    """Have the scratch folder ``path`` deleted when the driver's Python ends."""
    if not _scratch:
        atexit.register(_delete_scratch)
    _scratch.append(path)
    return path


def _delete_scratch() -> None:
    sc = SparkContext._active_spark_context
    for path in _scratch:
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(_plain_local(path), ignore_errors=True)
        elif sc is not None and sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder, deleted when the driver ends."""
    return delete_at_exit(os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}"))


def input_bytes(spark: SparkSession, path: str) -> int | None:
    """Total size of the files under ``path`` (any Hadoop file system), or None."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(p).getLength())
    except Exception:  # noqa: BLE001 - no JVM handle: local paths only
        local = path.removeprefix("file:")
        if not os.path.exists(local):
            return None
        if os.path.isfile(local):
            return os.path.getsize(local)
        return sum(os.path.getsize(os.path.join(r, f))
                   for r, _, fs in os.walk(local) for f in fs)


def partitions_for(size_bytes: int | None, target_bytes: int = 256 * 1024 * 1024) -> int:
    """About ``target_bytes`` per shuffle partition, never below Spark's default 200."""
    return max(200, -(-size_bytes // target_bytes)) if size_bytes else 200


def _set_explicitly(spark: SparkSession, key: str, default: str) -> bool:
    """True if ``key`` came from spark-submit / defaults / the builder, or was
    changed at runtime."""
    try:
        if spark.sparkContext.getConf().contains(key):
            return True
    except Exception:  # noqa: BLE001 - no context handle: only runtime values are visible
        pass
    return spark.conf.get(key) != default


def size_shuffle_partitions(spark: SparkSession, path: str,
                            target_bytes: int = 256 * 1024 * 1024) -> int:
    """Set ``spark.sql.shuffle.partitions`` for an input of the size at ``path``
    (``partitions_for``), unless the user has set it. AQE coalesces the
    partitions of the small report stages. Returns the value in effect."""
    key = "spark.sql.shuffle.partitions"
    if _set_explicitly(spark, key, "200"):
        return int(spark.conf.get(key))
    n = partitions_for(input_bytes(spark, path), target_bytes)
    spark.conf.set(key, str(n))
    return n
