"""Helpers that several operators share: table access, scratch tables in the
cluster's shared folder, and vectorised word and shingle hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from casegrid.session import delete_at_exit

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)                       # odd, so invertible modulo 2**64
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, scheme included. Only a local-mode
    session without that setting (tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casegrid-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    return delete_at_exit(f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage,
    and a lost executor costs a read instead of the work before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def chunks(*columns: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts (one per column) have about ``limit`` bytes, of one row at least."""
    start = size = 0
    for i, row in enumerate(zip(*columns, strict=True)):
        n = sum(map(len, row))
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(columns[0]):
        yield start, len(columns[0])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds): every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of ``_P`` and of its inverse, grown to the longest step seen."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 4096)
            for name, p in (("up", _P), ("down", _P_INV)):
                a = np.full(size, p, _U)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64: sums of codes times rising
    powers give the hash of any stretch as a difference times a falling one."""
    return _Powers.upto(n)


# Space and \t \n \v \f \r part words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word count of every text) of UTF-8 texts; words are the
    runs between ASCII white space, with A-Z in lower case."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]              # the closing newline ends the last word
    up, down = _Powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * up[:-1], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U))
    return h, np.diff(np.searchsorted(begin, np.concatenate(([0], ends))))


def shingle_hashes(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words, number of them per text). A text of fewer
    words, but not none, has one: its whole word sequence."""
    h, n_words = word_hashes(texts)
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    length = np.minimum(n_words[owner], width)
    padded = np.concatenate((h, np.zeros(width, _U)))
    out = length.astype(_U)
    for j in range(width):
        term = mix(padded[at + j] + _U(j + 1))
        out = (out * _P) + np.where(length > j, term, _U(0))
    return mix(out), n


def distinct_shingles(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted inside each text, each once; number of them per text)."""
    h, n = shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def utf8(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def public_tokenizer(name: str) -> str:
    """The path of a vocabulary file of the installed public tokenizers, or of
    CASEGRID_TOKENIZERS if that names a folder."""
    folder = os.environ.get("CASEGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
