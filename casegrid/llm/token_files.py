"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with
separate control bytes.

A token file set is a folder with two tables:

- ``ranks``: (rank, id), ids by falling count in the corpus (ties by id), so the most
  frequent ids get the shortest codes;
- ``blocks``: rows of consecutive documents in ascending doc_id order, by (shard, block):
  the documents' ids and lengths, the control bytes (two bits a number: its length in
  bytes less one; four numbers a byte, lowest bits first) and the data bytes
  (little-endian, 1 to 4 a number).

Decoding looks the lengths of four numbers up by control byte, sums them to offsets and
masks the bytes gathered there; a second lookup turns ranks into ids.

Encoding splits a text at single spaces and encodes each distinct piece once per worker;
the byte-level pre-tokenizer never joins or looks across such a place (a space between
two characters that aren't white space). A text where that is not so is encoded whole.
An unseen piece of Latin letters, digits and ASCII punctuation is cut once more, into runs of each
and single line ends, which the pre-tokenizer parts, too; so a word costs the tokenizer one
call, whatever stands after it. A tokenizer of another kind (a normaliser, another
pre-tokenizer, added tokens that take in spaces or depend on neighbours) encodes every text whole.

Edge cases: null texts count as empty and hold the end id alone. Rows with one doc_id
follow each other by text hash; rows with a null doc_id come last. An empty table gives an empty
file set. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import CHUNK_BYTES, drop_path, scratch_path

#: Pieces that a worker remembers before it starts anew, and numbers in a block.
CACHE, BLOCK = 600_000, 1 << 18
#: A count above any text's: the text is encoded whole.
WHOLE = 1 << 40

# Byte lengths of the four numbers of each control byte; masks by code.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    x = np.ascontiguousarray(x, "<u4")
    code = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    padded = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    padded[:len(x)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = x.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``encode_numbers``."""
    width = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(width, dtype=np.int64) - width
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[width - 1]


# Runs that the byte-level pre-tokenizer parts: letters to U+024F, digits, ASCII punctuation but for
# the apostrophe (it may begin a contraction), a line end alone; a space belongs to what follows it.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
RUNS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
OF_RUNS = re.compile(rf"[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*")


class _Ids:
    """The ids of numbered pieces."""

    def __init__(self, dtype: np.dtype):
        self.ids, self.used = np.zeros(1 << 20, dtype), 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def room(self, size: int) -> None:
        """Make room for ``size`` pieces."""
        if size > len(self.begin):
            more = np.zeros(2 * size - len(self.begin), np.int64)
            self.begin, self.count = np.concatenate((self.begin, more)), np.concatenate((self.count, more))

    def put(self, at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Pieces ``at`` have ``ids``, ``n`` each."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(ids), self.ids.dtype)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin[at], self.count[at] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``at``, one after the other, the number of ids up to each one's end)."""
        count = np.maximum(self.count[at], 0)
        total = np.cumsum(count)
        return self.ids[np.arange(int(total[-1])) + np.repeat(self.begin[at] - total + count, count)], total


class _Runs(dict):
    """run -> its place; an unseen run gets the next one and is noted."""

    def __init__(self, dtype: np.dtype):
        super().__init__()
        self.known, self.new = _Ids(dtype), []

    def __missing__(self, run: str) -> int:
        place = self[run] = len(self)
        self.new.append(run)
        return place


class _Places(dict):
    """piece -> its place in the encoder's table; an unseen piece gets the next one."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.new, self.at = encoder, lead, [], []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = self.encoder.size
        self.encoder.size += 1
        self.new.append(piece)
        self.at.append(place)
        return place


class _Counts(dict):
    """piece -> its number of ids, or ``WHOLE`` if it isn't apart from its neighbours. An unseen
    piece counts 0 and is noted. ``old`` holds the counts from before the worker began anew;
    those still in use move over."""

    def __init__(self, old: dict[str, int]):
        super().__init__()
        self.old, self.new = old, []

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            self.new.append(piece)
            return 0
        self[piece] = n
        return n


class Encoder:
    """Ids of texts as little-endian bytes, through one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added, self.splits = self._kind()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.spaced = np.zeros(top + 1, bool)           # ids of tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.line_end = vocabulary.get("\u010a", -1)
        self._forget()
        self.runs = _Runs(self.dtype)
        self.counts = [_Counts({}), _Counts({})]

    def _kind(self) -> tuple[list[str], bool]:
        """The added tokens, and whether texts may be split at single spaces."""
        spec = json.loads(self.tokenizer.to_str())
        added, before = spec["added_tokens"], spec["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        apart = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        plain = spec["normalizer"] is None and not any(spec.get(k) for k in ("truncation", "padding"))
        return [t["content"] for t in added], bool(plain and byte_level and apart and not spec["model"].get("dropout"))

    def _forget(self) -> None:
        self.size = 0
        self.places = [_Places(self, ""), _Places(self, " ")]
        self.known = _Ids(self.dtype)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _encode_spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them per word) of words that each follow a space."""
        ids = self._encode([" " + " ".join(words)])[0]
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(words):
            return ids, np.diff(np.append(starts, len(ids)))
        each = self._encode([" " + w for w in words])
        return np.concatenate(each), np.array([len(e) for e in each])

    def _encode_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them per word) of words that follow no space."""
        ids = self._encode(["\n".join(words)])[0]
        edge = np.flatnonzero(ids == self.line_end)
        if len(edge) == len(words) - 1 and "\n" not in words:
            return np.delete(ids, edge), np.diff(np.concatenate(([-1], edge, [len(ids)]))) - 1
        each = self._encode(words)
        return np.concatenate(each), np.array([len(e) for e in each])

    def _encode_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encode_spaced`` of words that are made of runs, by their runs."""
        if len(self.runs) > CACHE:
            self.runs = _Runs(self.dtype)
        runs = RUNS.findall(" " + " ".join(words))
        at = np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs))
        new, self.runs.new = self.runs.new, []
        known = self.runs.known
        known.room(len(self.runs))
        lead = np.fromiter((r[0] == " " for r in new), bool, len(new))
        for spaced in (True, False):
            some = np.flatnonzero(lead == spaced)
            for i in range(0, len(some), 4096):
                part = [new[k] for k in some[i:i + 4096].tolist()]
                ids, n = self._encode_spaced([r[1:] for r in part]) if spaced else self._encode_lines(part)
                known.put(len(self.runs) - len(new) + some[i:i + 4096], ids, n)
        ids, total = known.gather(at)
        first = np.flatnonzero(np.fromiter((r[0] == " " for r in runs), bool, len(runs)))
        ends = np.append(total[first[1:] - 1], total[-1])
        return ids, np.diff(ends, prepend=0)

    def _learn(self) -> None:
        """Encode the pieces seen first since the last call. Pieces that aren't apart from
        their neighbours (empty, or with white space at an edge) get the count -1."""
        self.known.room(self.size)
        for places in self.places:
            new, at, places.new, places.at = places.new, np.array(places.at, np.int64), [], []
            runs = np.zeros(len(new), bool)
            if places.lead and new:
                runs = np.fromiter(map(bool, map(OF_RUNS.fullmatch, new)), bool, len(new))
                together = " ".join(new)
                for t in self.added:
                    if t in together:
                        runs &= [t not in p for p in new]
            if runs.any():
                self.known.put(at[runs], *self._encode_runs(list(compress(new, runs))))
            rest = np.flatnonzero(~runs).tolist()
            self.known.count[at[rest]] = -1
            apart = [k for k in rest if new[k] and not new[k][0].isspace() and not new[k][-1].isspace()]
            for i in range(0, len(apart), 4096):
                part = [new[k] for k in apart[i:i + 4096]]
                if places.lead:
                    ids, n = self._encode_spaced(part)
                else:
                    each = self._encode(part)
                    ids, n = np.concatenate(each), np.array([len(e) for e in each])
                self.known.put(at[apart[i:i + 4096]], ids, n)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts or not self.splits:
            return [e.tobytes() for e in self._encode(texts)]
        if self.size > CACHE:
            self._forget()
        first, rest = (p.__getitem__ for p in self.places)
        places, n = [], []
        for t in texts:
            head, *tail = t.split(" ")
            places.append(first(head))
            places.extend(map(rest, tail))
            n.append(1 + len(tail))
        self._learn()
        at = np.array(places, np.int64)
        starts = np.cumsum(n) - n
        whole = np.minimum.reduceat(self.known.count[at], starts) < 0
        ids, total = self.known.gather(at)
        ends = total[starts + n - 1]
        out = [ids[s:e].tobytes() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        odd = np.flatnonzero(whole).tolist()
        for i, e in zip(odd, self._encode([texts[i] for i in odd]), strict=True):
            out[i] = e.tobytes()
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of every text, without gathering them."""
        if not self.splits:
            return np.array([len(e) for e in self._encode(texts)], np.int64)
        for k, c in enumerate(self.counts):
            if len(c) > CACHE:
                c.old = {}
                self.counts[k] = _Counts(c)
        heads, rest = self.counts
        out, seen = [], []
        for t in texts:
            head, *tail = t.split(" ")
            out.append(heads[head] + sum(map(rest.__getitem__, tail)))
            seen.append((len(heads.new), len(rest.new)))
        new = self._count_new()
        i = j = 0
        for k, (i_end, j_end) in enumerate(seen):           # the pieces that counted 0 in this text
            if i < i_end or j < j_end:
                out[k] += sum(map(heads.__getitem__, new[0][i:i_end])) + sum(map(rest.__getitem__, new[1][j:j_end]))
                i, j = i_end, j_end
        odd = [k for k, n in enumerate(out) if n >= WHOLE]
        for k, e in zip(odd, self._encode([texts[k] for k in odd]), strict=True):
            out[k] = len(e)
        return np.array(out, np.int64)

    def _count_new(self) -> list[list[str]]:
        """Count the noted pieces, and return them."""
        noted = [c.new for c in self.counts]
        for spaced, counts in enumerate(self.counts):
            new, counts.new = list(dict.fromkeys(counts.new)), []
            apart = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
            counts.update(dict.fromkeys(new, WHOLE))
            for i in range(0, len(apart), 4096):
                part = apart[i:i + 4096]
                n = self._encode_spaced(part)[1].tolist() if spaced else [len(e) for e in self._encode(part)]
                counts.update(zip(part, n, strict=True))
        return noted


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document closed by ``end_id``, to ``path``."""
    spark = docs.sparkSession

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        n = np.zeros(0, np.int64)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
                    size += len(texts[j])
                    j += 1
                ids = [b + end for b in enc.encode(texts[i:j])]
                got = np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=len(n))
                got[:len(n)] += n
                n = got
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i:j].array, "text_hash": pdf["text_hash"].iloc[i:j].array,
                                    "ids": ids, "width": enc.dtype.itemsize})
                i = j
        if len(n):              # the task's counts of ids, in a row of width 0
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "text_hash": pd.array([None], "Int64"), "ids": [n.astype("<i8").tobytes()], "width": 0})

    raw_path = scratch_path(spark, "token-ids")
    schema = "doc_id long, text_hash long, ids binary, width int"
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
     .mapInPandas(tokens, schema).write.option("compression", "zstd").parquet(raw_path))
    written_rows = spark.read.schema(schema).parquet(raw_path)
    raw = written_rows.where("width > 0")

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["ids"]:
                n = np.frombuffer(b, "<i8")
                yield pd.DataFrame({"id": np.flatnonzero(n), "n": n[n > 0]})

    # the filter on width spares the pages of other rows
    counts = written_rows.where("width = 0").select("ids").mapInPandas(unpacked, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])     # a row per id of the vocabulary at most
    ids = found["id"].to_numpy(np.int64)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ids)), "id": ids}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, k, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal k, start, held, size
            numbers = ranks.value[np.concatenate([a for _, a in held])]
            lengths = [len(a) for _, a in held]
            control, data = encode_numbers(numbers)
            out = pd.DataFrame({"shard": [shard], "block": [k], "start": [start], "doc_ids": [[d for d, _ in held]],
                                "lengths": [lengths], "control": [control], "data": [data]})
            k, start, held, size = k + 1, start + len(numbers), [], 0
            return out

        for pdf in batches:
            for d, b, w in zip(pdf["doc_id"].astype("object"), pdf["ids"], pdf["width"], strict=True):
                a = np.frombuffer(b, f"<u{w}")
                held.append((None if pd.isna(d) else int(d), a))
                size += len(a)
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    (raw.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .mapInPandas(blocks, "shard int, block long, start long, doc_ids array<long>, lengths array<long>, control binary, data binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    drop_path(spark, raw_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the file set at ``path``, from
    its decoded ids: ``start`` counts the ids of all documents before it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    id_of = spark.sparkContext.broadcast(ids)
    sizes = blocks.select("shard", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    per_shard = dict(sorted((r["shard"], r["n"]) for r in sizes.collect()))          # a row per shard
    before = dict(zip(per_shard, np.cumsum([0, *per_shard.values()]).tolist(), strict=False))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = np.asarray(row.lengths, np.int64)
                found = id_of.value[decode_numbers(row.control, row.data, int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(found[e - m:e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                doc_ids = pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": doc_ids, "start": before[row.shard] + row.start + ends - n, "n_tokens": n, "ids_crc32": crc})

    return blocks.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
