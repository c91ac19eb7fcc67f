"""Near-duplicate classes by HyperMinHash.

Of each document's shingle hashes, 128 buckets keep their least value as a 16-bit
register: the number of leading zeros and ten mantissa bits. Runs of four registers
are banding keys. Steps, all linear in the rows:

1. Documents with the same shingle set collapse into one, its representative.
2. In every band bucket each representative is paired with the least one. Pairs whose
   collision-corrected Jaccard estimate is five deviations too low go; the rest are
   confirmed on the full sets, and confirmed links form components.
3. Buckets that still hold several components are searched in blocks: registers of
   one block against those of another, across components only. Documents that have a
   promising partner come back with their texts, and full sets decide. Blocks have a
   bounded size; only confirmed links leave them, never the pairs that were tried.

Texts move only where a pair needs them: a bitmap of the wanted ids, of a fixed size,
picks them at the scan. Tables in between are removed after their last reader.

At a similarity of exactly 0.75 a pair misses all 32 bands with probability 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .idfilter import marked
from .shared import drop, settle, stash
from .shingles import mixed, shingle_sets

BUCKETS = 128
BAND = 4
MANTISSA = 10
EMPTY = 0xFFFF
PERCENT = 75
#: Rows of a block in which partners are searched; two blocks meet in one task.
BLOCK = 600
#: Rows with texts in work at a time.
SLICE = 500


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit HyperMinHash registers for each sorted set."""
    least = np.full((len(sets), BUCKETS), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(least, sets):
        back = s[::-1]  # of equal buckets the last assignment, the least value, stays
        row[(back & np.uint64(BUCKETS - 1)).astype(np.intp)] = back
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint16)
    code = (zeros << np.uint16(MANTISSA)) | np.maximum(0, (fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return np.where(least == np.iinfo(np.uint64).max, np.uint16(EMPTY), code)


def band_keys(regs: np.ndarray) -> list[np.ndarray]:
    """For each row the keys of its bands that aren't empty."""
    parts = regs.reshape(len(regs), -1, BAND)
    packed = np.zeros(parts.shape[:2], np.uint64)
    for j in range(BAND):
        packed = (packed << np.uint64(16)) | parts[:, :, j].astype(np.uint64)
    keys = mixed(mixed(packed) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64))
    full = (parts != EMPTY).any(axis=2)
    return [k[f].view(np.int64) for k, f in zip(keys, full)]


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two unrelated sets of these sizes that agree by chance.

    A bucket with load a has its least value in [x, x + w) with probability
    exp(-a x) - exp(-a (x + w)); for each number of leading zeros the cells are summed
    as a geometric series.
    """
    a, b = (np.asarray(x, np.float64)[..., None] / BUCKETS for x in (n, m))
    low = 0.5 ** np.arange(1, 54)
    w = low / (1 << MANTISSA)
    each = -np.expm1(-a * w) * -np.expm1(-b * w) * np.exp(-(a + b) * low) * np.expm1(-(a + b) * low) / np.expm1(-np.maximum(a + b, 1e-300) * w)
    return BUCKETS * each.sum(axis=-1)


def promising(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the corrected estimate of each pair of rows is at most five deviations below the threshold.

    ``left`` may be a single row. The correction only lowers an estimate, so it is
    worked out just for the pairs that would pass without it.
    """
    some = (left != EMPTY) | (right != EMPTY)
    used = np.maximum(1, some.sum(axis=-1))
    hits = ((left == right) & some).sum(axis=-1)
    t = percent / 100
    least = used * (t - 5 * np.sqrt(t * (1 - t) / used))
    good = (hits >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    spots = np.flatnonzero(good)
    good[spots] = hits[spots] - expected_collisions(n[spots], m[spots]) >= least[spots]
    return good


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what is worked out of a text takes several times its memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        regs = registers(sets)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in regs], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "digest", "regs"],
        )
    settle()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS))
            ids = np.repeat(batch.column("rep").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["key", "id"])


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs", "hub_regs"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "hub_n"))
            yield batch.select(["id", "hub"]).filter(pa.array(promising(left, right, n, m, percent)))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            hubs = batch.column("hub").to_pylist()
            at = {h: i for i, h in enumerate(hubs)}
            texts = batch.column("hub_text")
            of = dict(zip(at, shingle_sets([texts[i].as_py() for i in at.values()])))
            sets = shingle_sets(batch.column("text").to_pylist())
            yield batch.select(["id", "hub"]).filter(pa.array([alike(s, of[h], percent) for s, h in zip(sets, hubs)], pa.bool_()))
        settle()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group (key, i, j) of rows that come sorted by them; a group may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        by = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in by])) + 1)]
        columns = {c: np.array(t.column(c).to_pylist() + [None], object)[:-1] if c in ("regs", "text") else t.column(c).to_numpy() for c in t.column_names}
        for x, y in zip(cuts, cuts[1:]):
            yield {c: v[x:y] for c, v in columns.items()}
        held = t.slice(cuts[-1]).combine_chunks().to_batches()[0]
    if held is not None:
        yield {c: np.array(held.column(c).to_pylist() + [None], object)[:-1] if c in ("regs", "text") else held.column(c).to_numpy() for c in held.schema.names}


def _partners(regs: np.ndarray, n: np.ndarray, group: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a block pair with its promising partners further on, of other components; each pair once."""
    comp, side = group["component"], group["side"]
    within = group["i"][0] == group["j"][0]
    rows = np.arange(len(comp))
    for r in rows:
        other = np.flatnonzero((comp != comp[r]) & ((rows > r) if within else (side > side[r])))
        for o in np.array_split(other, max(1, len(other) // 1024)) if len(other) else ():
            good = o[promising(regs[r], regs[o], np.full(len(o), n[r]), n[o], percent)]
            if len(good):
                yield r, good


def _flag(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            regs = np.frombuffer(b"".join(group["regs"]), np.uint16).reshape(-1, BUCKETS)
            hit = np.zeros(len(regs), bool)
            for r, good in _partners(regs, group["n"], group, percent):
                hit[r] = True
                hit[good] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[c][hit]) for c in ("key", "id", "component")], names=["key", "id", "component"])

    return run


def _link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            sets = shingle_sets(group["text"].tolist())
            ids, comp = group["id"].tolist(), group["component"].tolist()
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            out = []
            for r, good in _partners(registers(sets), np.array([len(s) for s in sets]), group, percent):
                for o in good:
                    if (a := root(comp[r])) != (b := root(comp[o])) and alike(sets[r], sets[o], percent):
                        parent[max(a, b)] = min(a, b)
                        out.append((ids[r], ids[o]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["u", "v"])

    return run


def _in_blocks(rows: DataFrame, of: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of each key of ``of``, ``rows`` dealt and sorted so that any two rows of a key meet in one group (key, i, j) of at most about two blocks)."""
    sizes = stash(of.groupBy(F.col("key").alias("its_key")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, F.col("key") == F.col("its_key")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return sizes, out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _classes(texts: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(marks, classes) of ``texts`` (doc_id, text): (doc_id, n_shingles, digest, regs) of each row, and (digest, class)."""
    marks = stash(texts.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, regs binary"), "marks")
    known = marks.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = stash(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "reps")
    # A doc_id that repeats with other words represents several sets; links between those hold by the id itself.
    sketch = reps.select(F.col("rep").alias("id"), "n", "regs")
    bands = reps.select("rep", "regs").mapInArrow(_bands, "key long, id long")
    shared = bands.groupBy(F.col("key").alias("hub_key")).agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub != last")
    shared = stash(shared, "shared")  # as a table: of a join with an aggregate Spark can't split hot keys
    buckets = stash(bands.join(shared, F.col("key") == F.col("hub_key")).filter(F.col("id") != F.col("hub")).select("key", "id", "hub"), "buckets")
    hubs = sketch.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("regs").alias("hub_regs"))
    tried = buckets.select("id", "hub").distinct()
    near = stash(tried.join(sketch, "id").join(hubs, "hub").mapInArrow(_estimate(percent), "id long, hub long").distinct(), "near")
    picked = lambda ids: marked(texts.withColumnRenamed("doc_id", "id"), "id", ids)[0]
    needed = stash(picked(near.select(F.explode(F.array("id", "hub")).alias("id"))), "needed")
    hub_texts = needed.select(F.col("id").alias("hub"), F.col("text").alias("hub_text"))
    links = near.join(needed, "id").join(hub_texts, "hub").mapInArrow(_confirm(percent), "id long, hub long")
    first = stash(components(links.select(F.col("id").alias("u"), F.col("hub").alias("v"))), "first")
    drop(near, needed)

    # Buckets whose other rows still are of several components. All pairs with a bucket's hub have been tried, so it stays out.
    named = buckets.join(first, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = named.groupBy(F.col("key").alias("open_key")).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    open_keys = stash(open_keys, "open-keys")
    open_rows = stash(named.join(open_keys, F.col("key") == F.col("open_key")).select("key", "id", "component"), "open")
    drop(buckets, open_keys, shared)
    sizes, dealt = _in_blocks(open_rows.join(sketch, "id").select("key", "id", "component", "n", "regs"), open_rows, block)
    flagged = stash(dealt.mapInArrow(_flag(percent), "key long, id long, component long").distinct(), "flagged")
    drop(open_rows, sizes)
    wanted = stash(picked(flagged.select("id")), "wanted")
    more = flagged.join(wanted, "id").select("key", "id", "component", "text")
    sizes, dealt = _in_blocks(more, flagged, block)
    late = stash(dealt.mapInArrow(_link(percent), "u long, v long"), "late")
    drop(flagged, wanted, sizes)
    joined = late.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    merged = components(joined.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    merged = merged.select(F.col("node").alias("was"), F.col("component").alias("now"))
    own = reps.select("digest", "rep").join(first, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("was"))
    classes = stash(own.join(merged, "was", "left").select("digest", F.coalesce("now", "was").alias("class")), "classes")
    drop(reps, first, late)
    return marks, classes


def _judged(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and digest of each row."""
    out = marks.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "digest")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their 5-word shingle
    sets, of 64-bit hashes. A document without words links with nothing and is kept. Rows
    that repeat a doc_id are one document and share its class; rows with a null doc_id are
    kept, with a null component. Other columns are ignored, and an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(*_classes(texts, percent, block)).drop("digest")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = shingle_sets(batch.column("t").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array([_digest(s) for s in sets], pa.binary())], names=["id", "row", "digest"])
    settle()


def keep_one(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One document of each near-duplicate class, columns unchanged; documents without words all stay.

    Of rows that repeat a kept doc_id and its shingle set the one with the least text (and
    then the least values) stays. Rows that repeat a doc_id with another set are judged by
    that set's class. Rows with a null doc_id stay. Only rows that may go are shuffled.
    """
    names = docs.columns
    marks, classes = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, block)
    judged = _judged(marks, classes).filter("doc_id is not null")
    ids = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.count("*").alias("rows")).filter("not some or rows > 1")
    changes = stash(ids.select(F.col("doc_id").alias("id"), "some"), "changes")
    sets = judged.filter("kept").join(changes.filter("some").hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    kept = stash(sets.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_set")).distinct(), "kept")
    drop(marks, classes)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    maybe, sure = marked(rows.withColumnRenamed("text", "t"), "id", changes.select("id"))
    asked = maybe.join(changes.hint("merge"), "id", "left")
    alone = asked.filter("some is null").select("row")
    again = asked.filter("some").select("id", "t", "row")
    again = again.mapInArrow(_with_sets, T.StructType([again.schema["id"], again.schema["row"], T.StructField("digest", T.BinaryType())]))
    again = again.join(kept.hint("merge"), (F.col("id") == F.col("its_id")) & (F.col("digest") == F.col("its_set")), "left_semi")
    first = F.struct(F.col("row")["text"].alias("t"), F.to_json("row").alias("j"))
    one = again.groupBy("id", "digest").agg(F.min_by("row", first).alias("row")).select("row")
    return sure.select("row").unionByName(alone).unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in names])
