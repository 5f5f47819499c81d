"""Near-duplicate groups by b-bit MinHash: bands of full minima give candidates, packed low bits estimate their similarity,
full shingle sets confirm them, and confirmed links give components.

Texts with equal sets are one class from the start. Inside a band's bucket nobody is paired with everybody. First each class
is paired with one hub, the class nearest to the middle of a bucket that it shares most often. Once those links have merged classes,
the members of a bucket outside its largest component are paired with that component's hubs, and only who is still outside then is
compared with the others, in blocks that give no pairs but links. So whatever could link two components is looked at, while a group
that is one component costs a few comparisons per member, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.components import components
from gridlytics.llm.text import coded, hashes_of, mixed, rows_of, slices, texts_of, words_of

BANDS = 32
ROWS = 5  # minima to a band: a pair of similarity 0.8 shares none of 32 bands in 3 of a million cases
LOW_BITS = 2
HASHES = 320  # the first BANDS * ROWS make the bands, all of them the packed signature
LANES = 64 // LOW_BITS
SLACK = 5  # standard errors below the threshold at which a pair is still confirmed on its full sets

#: Classes of a side of a block that are compared at once, and shingles whose holders are counted at once.
BLOCK, WIDTH = 512, 4096

#: Ids up to which a filter of 16 bits an id picks the texts to confirm, 32 MB at most; more ids are joined with the texts' ids instead.
FILTERED_IDS = 1 << 24


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, and where each text's begin. Fewer words than `size` are one
    shingle; no word, none."""
    words, offsets = words_of(pc.ascii_lower(texts))
    distinct, codes = coded(words)
    word = mixed(hashes_of(distinct))[codes]
    counts, row = np.diff(offsets), rows_of(offsets)
    with np.errstate(over="ignore"):
        rolled, at = word.copy(), np.arange(len(word))
        ends = offsets[1:][row]
        for k in range(1, size):
            more = at + k < ends
            rolled[more] = mixed(rolled[more] * np.uint64(0x9E3779B97F4A7C15) + word[at[more] + k])
        keep = (at + size <= ends) | ((at == offsets[:-1][row]) & (counts[row] < size))
        # a short text's single shingle also says how many words it has
        short = counts[row] < size
        rolled[short] = mixed(rolled[short] + counts[row[short]].astype(np.uint64))
    rolled, row = rolled[keep], row[keep]
    order = np.lexsort((rolled, row))
    rolled, row = rolled[order], row[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (row[1:] != row[:-1])
    return rolled[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return made[:n] | np.uint64(1), made[n:]


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES x texts: 32-bit minima. Texts must not be empty."""
    out = np.zeros((HASHES, len(offsets) - 1), np.uint64)
    factors, terms = seeds(HASHES)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[k] = np.minimum.reduceat(sets * factors[k] + terms[k], offsets[:-1])
    return out >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    """texts x BANDS: hashes of the bands' minima and numbers."""
    out = np.zeros((low.shape[1], BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(low.shape[1], band + 1, np.uint64)
            for k in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[band * ROWS + k])
            out[:, band] = key
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """texts x words: the low bits of the minima, LOW_BITS each."""
    out = np.zeros((low.shape[1], -(-HASHES // LANES)), np.uint64)
    for k in range(HASHES):
        out[:, k // LANES] |= (low[k] & np.uint64((1 << LOW_BITS) - 1)) << np.uint64(k % LANES * LOW_BITS)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.reshape(-1).view(np.int64)))


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * 8), pa.py_buffer(values.astype("<u8"))]
    ).cast(pa.binary())


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets, offsets = shingles(texts_of(part.column("text")), size)
            counts = np.diff(offsets)
            full = np.flatnonzero(counts > 0)
            n = len(counts)
            keys, low = np.zeros((n, BANDS), np.uint64), np.zeros((n, -(-HASHES // LANES)), np.uint64)
            digest = np.zeros((n, 2), np.uint64)
            if len(full):
                begins = np.append(offsets[:-1][full], len(sets))
                least = minima(sets, begins)
                keys[full], low[full] = band_keys(least), packed(least)
                with np.errstate(over="ignore"):
                    digest[full, 0] = np.add.reduceat(mixed(sets), begins[:-1])
                    digest[full, 1] = np.add.reduceat(mixed(sets ^ np.uint64(0xD6E8FEB86659FD93)), begins[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts), _lists(digest), _lists(keys), _lists(low)], names=["id", "n", "digest", "bands", "low"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), _binary(*shingles(texts_of(part.column("text")), size))], names=["id", "members"])

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"))):
                one, two = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(two.as_buffer(), "<u8")
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * common >= threshold * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def similarity(one: Column, two: Column) -> Column:
    """The similarity that packed low bits suggest: equal lanes, less those equal by chance."""
    words = -(-HASHES // LANES)
    lanes = F.lit(int("01" * LANES, 2))
    differ = None
    for k in range(words):
        x = one[k].bitwiseXOR(two[k])
        bits = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(lanes))
        differ = bits if differ is None else differ + bits
    chance = 0.5**LOW_BITS
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    chance, sought = 0.5**LOW_BITS, threshold / 100
    equal = chance + (1 - chance) * sought
    return sought - SLACK * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def _plausible(threshold: int, x: str, y: str) -> Column:
    sizes = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) * 100 >= F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")) * threshold
    return sizes & (similarity(F.col(f"{x}.low"), F.col(f"{y}.low")) >= least_estimate(threshold))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among the given ones: by a filter that Spark builds, whose size follows the ids, so the rows are not shuffled.
    Beyond `FILTERED_IDS` they are, each text once: the filter would no longer be small enough to send."""
    ids = ids.select("id").distinct()
    n = ids.count()
    if n > FILTERED_IDS:
        return rows.join(ids, "id", "left_semi")
    size = max(1 << 16, 1 << math.ceil(math.log2(16 * max(n, 1))))
    places = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(size)) for s in range(3)])).alias("at"))
    words = places.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")
    ).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for x in (a, b, c):
            x = x.to_numpy(np.int64)
            out &= (sent.value[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(out)

    return rows.where(there(*[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(size)) for s in range(3)]))


def _confirmed(texts: DataFrame, pairs: DataFrame, threshold: int, size: int) -> DataFrame:
    """The pairs (`a`, `b`) whose full sets are similar enough, staged."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = storage.staged(among(texts, ids).mapInArrow(_sets(size), "id long, members binary"), "sets", "none")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("two")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("members").alias("one")), "a"
    )
    return storage.staged(both.select("a", "b", "one", "two").mapInArrow(_confirm(threshold), "a long, b long"), "links", "none")


def _split(shared: DataFrame, labels: DataFrame, heaviest: Column) -> DataFrame:
    """The members of buckets that hold several components: band, id, label, the bucket's largest component and its hub there."""
    labelled = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", "weight", F.coalesce("label", "id").alias("label")
    )
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("held"), heaviest)
    largest = F.max_by(F.struct("label", "hub"), F.struct("held", "label")).alias("largest")
    split = parts.groupBy("band").agg(largest, F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return labelled.join(split.select("band", F.col("largest.label").alias("main"), F.col("largest.hub").alias("hub")), "band").select(
        "band", "id", "label", "main", "hub"
    )


def _compared(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        outside = table["outside"].to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["members"]]
        counts = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        code, owner = code[times[code] > 1], owner[times[code] > 1]  # who else has no other holder is in no intersection
        code = np.unique(code, return_inverse=True)[1] if len(code) else code
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        place = np.where(outside, np.cumsum(outside), np.cumsum(~outside)) - 1
        common = np.zeros((int(outside.sum()), int((~outside).sum())), np.float32)
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, WIDTH):
            part = slice(*np.searchsorted(code, [first, first + WIDTH]))
            column, row = code[part] - first, owner[part]
            one, two = (np.zeros((n, WIDTH), np.float32) for n in common.shape)
            mine = outside[row]
            one[place[row[mine]], column[mine]] = 1
            two[place[row[~mine]], column[~mine]] = 1
            common += one @ two.T
        union = counts[outside][:, None] + counts[~outside][None, :] - common
        near = (100 * common >= threshold * union) & (labels[outside][:, None] != labels[~outside][None, :])
        x, y = np.nonzero(near)
        a, b = ids[outside][x], ids[~outside][y]
        pairs = np.stack([labels[outside][x], labels[~outside][y]], 1)
        first = np.unique(pairs, axis=0, return_index=True)[1] if len(x) else np.zeros(0, np.int64)  # one link joins two components
        return pa.table({"a": a[first].astype(np.int64), "b": b[first].astype(np.int64)})

    return run


def _between(texts: DataFrame, split: DataFrame, threshold: int, size: int) -> DataFrame:
    """Links between components that share a bucket: the members outside a bucket's largest component against all of those that lie in
    buckets with the same largest one, on their full sets, in blocks. A block counts all its intersections by matrix products and
    gives at most one link for two components."""
    groups = split.select("main", "id", "label").distinct()
    sizes = groups.groupBy("main").agg(
        F.ceil(F.count_if(F.col("label") != F.col("main")) / BLOCK).alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("columns")
    )
    groups = storage.staged(groups.join(sizes, "main"), "split", "none")
    sets = storage.staged(among(texts, groups.select("id")).mapInArrow(_sets(size), "id long, members binary"), "sets", "none")
    at = F.xxhash64("id")
    sides = groups.where("label <> main").select(
        "main", "id", "label", F.lit(True).alias("outside"), F.pmod(at, "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column")
    ).union(groups.select(
        "main", "id", "label", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(at, "columns").alias("column")
    ))
    blocks = sides.join(sets, "id").groupBy("main", "row", "column")
    return storage.staged(blocks.applyInArrow(_compared(threshold), "a long, b long"), "links", "none")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id of its group), kept (it has that id).

    Texts are lower-cased (A-Z) and cut into words at space and U+0009 to U+000D; two are linked if their sets of
    `size`-word shingles have a Jaccard similarity of `threshold` per cent or more. A text without words, or null, is linked with
    nothing and kept. Rows of equal ids count as one document. A row without an id is linked with nothing, has no
    component, and is kept. Ids are integers; only the two named columns are read; an empty table gives an empty result.
    """
    storage.bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = storage.staged(
        texts.mapInArrow(_signatures(size), "id long, n long, digest array<long>, bands array<long>, low array<long>"), "signatures"
    )
    full = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    digest = [F.col("digest")[0].alias("d0"), F.col("digest")[1].alias("d1"), "n"]
    classes = full.select("id", *digest).groupBy("d0", "d1", "n").agg(F.min("id").alias("rep"))
    # rows that share an id but not a text: their classes are one document's
    member = storage.staged(full.select("id", *digest).join(classes, ["d0", "d1", "n"]).select("id", "rep").distinct(), "members")
    reps = classes.select(F.col("rep").alias("id"), "d0", "d1", "n")
    alone = full.select("id", *digest, "bands", "low").join(reps, ["id", "d0", "d1", "n"], "left_semi").select("id", "n", "bands", "low")
    alone = storage.staged(alone, "classes")

    filed = alone.select("id", F.explode("bands").alias("band"))
    buckets = filed.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    together = storage.staged(filed.join(buckets, "band"), "together", "none")
    # the more classes share its bands, the nearer a class is to the middle of its group
    weights = together.groupBy("id").agg(F.sum("held").alias("weight"))
    shared = storage.staged(together.select("band", "id").join(weights, "id"), "shared", "none")
    low = alone.select("id", F.struct("n", "low").alias("s")).distinct()
    heaviest = F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub")

    def probable(pairs: DataFrame) -> DataFrame:
        both = pairs.join(low.select("id", F.col("s").alias("x")), "id").join(low.select(F.col("id").alias("hub"), F.col("s").alias("y")), "hub")
        likely = both.where(_plausible(threshold, "x", "y")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        return storage.staged(likely, "pairs", "none")

    # first each class meets the one hub that it shares most bands with
    hubs = shared.groupBy("band").agg(heaviest)
    led = (
        shared.join(hubs, "band").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("bands"))
        .groupBy("id").agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("hub"))
    )
    seen = probable(led)
    shared_ids = member.groupBy("id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    same_id = shared_ids.join(member, "id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = _confirmed(texts, seen, threshold, size).union(same_id)

    # then, in buckets that still hold several components, those outside the largest meet the hubs of the largest
    split = _split(shared, components(links), heaviest)
    strays = split.where("label <> main").select("id", "hub").distinct()
    again = storage.staged(probable(strays).join(seen, ["a", "b"], "left_anti"), "pairs", "none")
    seen, links = seen.union(again), links.union(_confirmed(texts, again, threshold, size))

    # at last those still outside meet everyone that they share a bucket with
    labels = components(links)
    more = _between(texts, _split(shared, labels, heaviest), threshold, size)
    final = labels if more.isEmpty() else components(links.union(more))

    group = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"))
    out = signed.select("id", "n").join(group, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80
) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group: that with the smallest id. Of rows with equal ids the one with the
    smallest text stays; rows without an id all do."""
    kept = near_duplicates(docs, id_col, text_col, size, threshold).where("kept").select(id_col).distinct()
    mark = next(name for k in range(len(docs.columns) + 1) if (name := f"_first{k}") not in docs.columns)
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    named = docs.where(F.col(id_col).isNotNull()).withColumn(mark, F.row_number().over(first)).where(F.col(mark) == 1).drop(mark)
    return named.join(kept, id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
