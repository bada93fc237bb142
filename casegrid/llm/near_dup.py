"""MinHash-family near-duplicate removal with SetSketch registers.

Each document's shingle set gets ``BANDS * ROWS`` SetSketch registers: every
shingle emits points of a Poisson process (time, register); a register keeps its
least time, stored as a truncated integer on an exponential scale of base
``BASE``. Registers merge by maximum and collide the more often the more alike
two sets are. Bands of ``ROWS`` registers give candidate buckets; the joint
likelihood of two sketches (their sizes are known) rejects pairs whose
similarity is far below the threshold; the rest are confirmed on the full sets.

Documents of one set form a class; everything after the first pass works on
classes. Links are found in two steps that never expand a bucket to all pairs:

1. star: each member of a bucket against the bucket's least class;
2. rest: buckets whose members the star links left in different components are
   cut into blocks of bounded size; each pair of blocks is one group, in which
   pairs of different components are tested, best first, until every pair is
   linked, connected or refuted. Groups are streamed through vectorised steps; only
   confirmed links leave them.

A pair at the threshold itself shares no band with probability 9e-7; nothing else
is lost: no bucket, group or partner count is capped.

Edge cases: null or wordless texts have an empty set and are linked with nothing
(their component is their own id). Fewer words than the shingle width: the whole
sequence is the one shingle. Repeated rows stay rows and get the same component;
``kept`` is true for each row that carries the component's id. A null doc_id never
becomes a component id unless the component has no other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrid.llm.common import chunks, distinct_shingles, mix, utf8, written

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.2, 20.0, 255
#: Log-likelihood by which the threshold may fall short of the best estimate (6 standard errors).
SLACK = 18.0
#: Members and shingles of a block in the second step.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1_000_000
#: Pairs that one vectorised step looks at.
PAIRS = 1 << 18

_U = np.uint64


def registers(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row per text, of distinct hashes ``h`` (``n`` per text)."""
    least = np.full((len(n), REGISTERS), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(len(n)), n)
    t = np.zeros(len(h))
    step = 0
    while len(h):
        k = max(1, min(256, 8192 // len(h)))            # points of each element per round
        x = mix(h[:, None] + (np.arange(step + 1, step + k + 1, dtype=_U) * _U(0xD1B54A32D192ED03)))
        reg = ((x & _U(0xFFFFF)) * _U(REGISTERS) >> _U(20)).astype(np.int64)
        u = ((x >> _U(20)).astype(np.float64) + 0.5) * 2.0**-44
        at = t[:, None] + np.cumsum(-np.log(u), axis=1) / REGISTERS
        np.minimum.at(flat, (owner[:, None] * REGISTERS + reg).reshape(-1), at.reshape(-1))
        t = at[:, -1]
        step += k
        alive = t < least.max(axis=1)[owner]            # later points cannot lower a register
        h, t, owner = h[alive], t[alive], owner[alive]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, TOP).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def may_reach(na, nb, more, less, similarity: float) -> np.ndarray:
    """Whether the joint likelihood of two sketches lets their similarity reach the
    threshold. ``more`` / ``less``: registers of a above / below those of b."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def loglik(j):
        up = np.clip(_p(np.maximum(u - v * j, 0)), 1e-12, 1)
        down = np.clip(_p(np.maximum(v - u * j, 0)), 1e-12, 1)
        return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-12))

    best = np.full(np.shape(u), -np.inf)
    for j in np.linspace(0, 1, 41):
        best = np.maximum(best, loglik(np.minimum(j, top)))
    high = np.full(np.shape(u), -np.inf)
    for j in np.linspace(similarity, 1, 9):
        high = np.maximum(high, loglik(np.minimum(j, top)))
    return high >= best - SLACK


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct hashes."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, regs) per row; ``class`` is a 128-bit
    digest of the set, null where the set is empty."""
    schema = "doc_id long, text_hash long, n_shingles long, class binary, regs binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = utf8(pdf["text"])
            for i, j in chunks(texts):
                h, n = distinct_shingles(texts[i:j], shingle)
                starts = np.cumsum(n) - n
                full = n > 0
                digest = np.zeros((j - i, 2), ">u8")
                for c, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    sums = np.concatenate(([_U(0)], np.cumsum(mix(h ^ _U(salt)))))
                    digest[:, c] = mix(sums[starts + n] - sums[starts] + n.astype(_U))
                regs = registers(h, n)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[i:j].array, "text_hash": pdf["text_hash"].iloc[i:j].array,
                    "n_shingles": n,
                    "class": [d.tobytes() if f else None for d, f in zip(digest, full, strict=True)],
                    "regs": [r.tobytes() if f else None for r, f in zip(regs, full, strict=True)]})

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInPandas(run, schema))


def _bands(classes: DataFrame, *more: str) -> DataFrame:
    """A row per class and band; ``short`` is the first half of the class's digest, on which
    Spark aggregates by hash."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    short = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long")
    return (classes.select("class", short.alias("short"), "n_shingles", "regs", *more, band.alias("band"))
            .select("class", "short", "n_shingles", *more, "band",
                    F.xxhash64("band", F.expr(f"substring(regs, band * {ROWS} + 1, {ROWS})")).alias("bucket")))


def _texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text): one text of every class in ``wanted``."""
    rep = classes.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "rep.doc_id", "rep.text_hash")
    src = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_hash"), "text")
    found = src.join(rep, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("text_hash")))
    return found.select("class", "text").dropDuplicates(["class"])


def _star_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between each bucket's least class and its other members."""
    bands = _bands(classes)
    leaders = (bands.groupBy("bucket").agg(F.min("short").alias("lead"), F.max("short").alias("last"))
               .where("lead < last").select("bucket", "lead"))
    pairs = (bands.join(leaders, "bucket").where("short > lead").select("lead", F.col("class").alias("b")).distinct())
    named = _bands(classes).where("band = 0").select(F.col("short").alias("lead"), F.col("class").alias("a"))
    pairs = pairs.join(named, "lead").select("a", "b")
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    pairs = (pairs.join(side("a"), "a").join(side("b"), "b")
             .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["r_a"]), np.uint8).reshape(-1, REGISTERS)
                b = np.frombuffer(b"".join(pdf["r_b"]), np.uint8).reshape(-1, REGISTERS)
                ok = may_reach(pdf["n_a"], pdf["n_b"], (a > b).sum(1), (a < b).sum(1), percent / 100)
                yield pdf.loc[ok, ["a", "b"]]

    likely_pairs = written(pairs.mapInPandas(likely, "a binary, b binary"), "star-pairs")
    ends = likely_pairs.select(F.col("a").alias("class")).union(likely_pairs.select(F.col("b").alias("class")))
    texts = _texts_of(docs, classes, ends)
    text = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"t_{c}"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ta, tb = utf8(pdf["t_a"]), utf8(pdf["t_b"])
            keep = np.zeros(len(pdf), bool)
            for i, j in chunks(ta, tb):
                h, n = distinct_shingles(ta[i:j] + tb[i:j], shingle)
                cut = np.split(h, np.cumsum(n)[:-1])
                for k in range(i, j):
                    keep[k] = _alike(cut[k - i], cut[j - i + k - i], percent)
            yield pdf.loc[keep, ["a", "b"]]

    return written(likely_pairs.join(text("a"), "a").join(text("b"), "b").mapInPandas(confirm, "a binary, b binary"), "star-links")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(class, root) for every class in a link (a, b): the least class that links reach.

    Each round takes the least root among a class and its neighbours and then that root's
    own root, and is written; a round that changes nothing ends it. With ``rounds``, only
    so many are made: classes of one root are then connected, but not the reverse."""
    edges = written(links.union(links.select("b", "a")).where("a != b").distinct(), "edges")
    roots = edges.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("m")).select("class", F.least("class", "m").alias("root"))
    roots = written(roots, "roots")
    while rounds is None or rounds > 0:
        own = roots.select("class", "root", F.col("root").alias("was"))
        near = edges.join(roots.select(F.col("class").alias("b"), "root"), "b").select(F.col("a").alias("class"), "root", F.lit(None).cast("binary").alias("was"))
        step = own.union(near).groupBy("class").agg(F.min("root").alias("mid"), F.max("was").alias("was"))
        jump = roots.select(F.col("class").alias("mid"), F.col("root").alias("far"))
        new = written(step.join(jump, "mid", "left").select("class", F.coalesce("far", "mid").alias("root"), "was"), "roots")
        roots = new.select("class", "root")
        if rounds is None and new.where("was != root").isEmpty():
            break
        rounds = rounds and rounds - 1
    return roots


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut between groups; a group is bounded by its blocks."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(pdf) if not last.any() else int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held = pdf.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _pairs_to_test(pdf: pd.DataFrame, keys: list[str], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) of whole groups, with the number of equal registers: rows of
    different components and of the group's two blocks that collide first in the group's
    band and may reach the threshold."""
    regs = np.frombuffer(b"".join(pdf["regs"]), np.uint8).reshape(-1, REGISTERS)
    band, n = pdf["band"].to_numpy(np.int64), pdf["n_shingles"].to_numpy(np.int64)
    root = pd.factorize(pdf["root"].map(bytes))[0]
    block, x, y = (pdf[k].to_numpy(np.int64) for k in ("block", "x", "y"))
    group = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    end = np.searchsorted(group, group, side="right")
    partners = end - np.arange(len(group)) - 1
    total = np.cumsum(partners)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(group):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(start, stop), partners[start:stop])
        first = np.cumsum(partners[start:stop]) - partners[start:stop]
        j = i + 1 + np.arange(len(i)) - np.repeat(first, partners[start:stop])
        ok = (root[i] != root[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
        ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[ok], j[ok]
        for s in range(0, len(i), PAIRS // 8):
            p, q = i[s:s + PAIRS // 8], j[s:s + PAIRS // 8]
            same = regs[p] == regs[q]
            agree = same.reshape(len(p), BANDS, ROWS).all(2)
            ok = agree[np.arange(len(p)), band[p]] & (agree.argmax(1) == band[p])
            p, q, same = p[ok], q[ok], same[ok].sum(1)
            more = (regs[p] > regs[q]).sum(1)
            ok = may_reach(n[p], n[q], more, REGISTERS - same - more, percent / 100)
            found.append((p[ok], q[ok], same[ok]))
        start = stop
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of (band, bucket) dealt to pairs (x, y) of blocks of bounded size."""
    size = rows.groupBy("band", "bucket").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    cut = (rows.join(size.select("band", "bucket", blocks.alias("blocks")), ["band", "bucket"])
           .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (cut.withColumn("other", other)
            .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "blocks"))


def _rest_links(docs: DataFrame, classes: DataFrame, roots: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links between components that share a bucket."""
    labelled = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    bands = _bands(labelled, "root")
    mark = F.xxhash64("root")
    open_buckets = bands.groupBy("bucket").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo < hi").select("bucket")
    rows = written(bands.join(open_buckets, "bucket").drop("short"), "open-rows")
    keys = ["band", "bucket", "x", "y"]

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, keys):
            i, j, _ = _pairs_to_test(pdf, keys, percent)
            yield pdf.iloc[np.unique(np.concatenate((i, j)))][["band", "bucket", "class", "n_shingles", "root"]]

    regs = classes.select("class", "regs")
    some = written(grouped(_blocked(rows).join(regs, "class"))
                   .mapInPandas(hopeful, "band int, bucket long, class binary, n_shingles long, root binary").distinct(), "hopeful")
    texts = written(_texts_of(docs, classes, some).join(regs, "class"), "hopeful-texts")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, keys):
            i, j, same = _pairs_to_test(pdf, keys, percent)
            used = np.unique(np.concatenate((i, j)))
            raw = utf8(pdf["text"].iloc[used])
            sets: dict[int, np.ndarray] = {}
            for s, e in chunks(raw):
                h, n = distinct_shingles(raw[s:e], shingle)
                sets.update(zip(used[s:e].tolist(), np.split(h, np.cumsum(n)[:-1]), strict=True))
            root = pd.factorize(pdf["root"].map(bytes))[0].tolist()
            up = list(range(max(root, default=0) + 1))

            def top(c: int, up: list[int] = up) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            cls, out = pdf["class"].to_list(), []
            order = np.argsort(-same, kind="stable")
            for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                a, b = top(root[p]), top(root[q])
                if a != b and _alike(sets[p], sets[q], percent):
                    up[a] = b
                    out.append((cls[p], cls[q]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return written(grouped(_blocked(some).join(texts, "class")).mapInPandas(confirm, "a binary, b binary"), "rest-links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, survivor) per row of ``docs`` (doc_id, text):
    documents are linked where 100 * intersection >= ``percent`` * union of their sets
    of ``shingle``-word shingles; a component is what links reach. ``survivor`` marks the text of
    least (doc_id, text_hash) of each component, so one text also where ids are null or repeat."""
    rows = written(sketches(docs, shingle), "sketches")
    classes = written(rows.where("class is not null").groupBy("class").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("regs").alias("regs"),
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least")), "classes")
    star = _star_links(docs, classes, shingle, percent)
    rest = _rest_links(docs, classes, components(star, rounds=2), shingle, percent)
    roots = components(star.union(rest))
    least = (classes.join(roots, "class").groupBy("root").agg(F.min("least").alias("component"), F.min("rep").alias("first")))
    named = roots.join(least, "root").select("class", "component", "first")
    own = classes.join(named, "class", "left").select("class", F.coalesce("component", "least").alias("component_id"), F.coalesce("first", "rep").alias("first"))
    out = rows.drop("regs").join(own, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash",
                      (F.col("class").isNull() | F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).alias("survivor"))
