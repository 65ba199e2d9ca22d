"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

1. Each document becomes a set of word-shingle hashes, its MinHash minima, band keys over the full minima, and a
   signature that packs the low bits of the minima. Equal sets fall together first: one document speaks for them.
2. In each band bucket every member is tried against the bucket's least member: as many pairs as members.
   A pair goes on if the bit count of its packed signatures, corrected for chance agreement, allows the threshold.
3. Pairs that go on are confirmed by the exact intersection of their sets; links make components.
4. Buckets that still hold several components are compared in square blocks of bounded size; components that the
   signatures don't keep apart form clusters, and in each cluster the full sets decide, again in blocks.
   From either comparison only rows leave that join what was apart.
So no link between different texts is lost, and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import arrow_type, byte_rows, materialise, materialise_few, only
from archloom.llm.components import connected_components
from archloom.llm.hashing import U, digest, joined_texts, mix, scrambled, words_in


@dataclass(frozen=True)
class NearRules:
    shingle: int = 5
    #: linked if 100 * intersection >= min_pct * union
    min_pct: int = 85
    #: 192 minima: at similarity 0.85 a pair shares no band with probability 3e-7
    bands: int = 32
    rows: int = 6
    #: low bits kept of each minimum
    bits: int = 2
    #: standard deviations by which an estimate may fall short of the threshold
    sigmas: float = 6.0
    #: members of a bucket in one block; two blocks meet in a task, so pairs within a block alone are looked at from both sides
    block: int = 512
    #: full sets compared in one task
    set_block: int = 1024

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def most_mismatches(self) -> int:
        """Signature fields that may differ in a pair at the threshold, less chance agreement, with the margin."""
        chance = 0.5**self.bits
        j = self.min_pct / 100
        same = j + (1 - j) * chance
        return int(self.minima * (1 - same) + self.sigmas * np.sqrt(self.minima * same * (1 - same)) + 1)


RNG = np.random.default_rng(77)
MULTIPLIERS = tuple(RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1))
FIRST, SECOND = (RNG.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


Shingles = tuple[np.ndarray, np.ndarray]


def distinct(a: np.ndarray, b: np.ndarray) -> Shingles:
    """The distinct pairs, in the order of their first halves."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # first halves clash: the order of the second ones counts too
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~same
    return x[keep], y[keep]


def shared(x: Shingles, y: Shingles) -> int:
    """How many shingles two sets share."""
    if any((s[0][1:] == s[0][:-1]).any() for s in (x, y)):
        return len(set(zip(*(h.tolist() for h in x), strict=True)) & set(zip(*(h.tolist() for h in y), strict=True)))
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return int((x[1][i] == y[1][j]).sum())


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct shingle."""
    order = np.lexsort((b, a))
    fresh = np.zeros(len(order), dtype=np.int64)
    fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def shingle_sets(texts: list[bytes], size: int) -> list[Shingles]:
    """For each text its distinct shingles as 128 bits in two halves; fewer words than `size` make one shingle.

    Each half is a chain of mixing steps over its own 64 bits of the words' ids: no sum, so that no structure of words
    or of their order makes different shingles alike.
    """
    buffer, at = joined_texts(texts, lower=True)
    start, ids = words_in(buffer)
    cut = np.searchsorted(start, at)
    lanes = [scrambled(ids, lane) for lane in (0, 1)]

    def chained(words: list[np.ndarray]) -> np.ndarray:
        h = mix(words[0] + U(len(words)))
        for w in words[1:]:
            h = mix(h * MULTIPLIERS[0] + w)
        return h

    n = max(0, len(start) - size + 1)
    halves = [chained([lane[k : k + n] for k in range(size)]) for lane in lanes]
    out = []
    for l, r in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if r - l >= size:
            out.append(distinct(*(h[l : r - size + 1] for h in halves)))
        else:
            out.append(tuple(chained([lane[k : k + 1] for k in range(l, r)]) if r > l else lane[:0] for lane in lanes))
    return out


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima of a set under as many mixed orders; the set is taken in stretches, so memory stays bounded."""
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> U(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = FIRST[:n, None] * low[None, at : at + 2048]
        x ^= x >> np.uint32(15)
        x *= SECOND[:n, None]
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the minima, side by side in 64-bit words (as signed longs)."""
    per = 64 // bits
    fields = np.zeros(-(-len(values) // per) * per, dtype=np.uint64)
    fields[: len(values)] = values & np.uint32((1 << bits) - 1)
    shifts = (np.arange(per, dtype=np.uint64) * U(bits))[None, :]
    return (fields.reshape(-1, per) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(values: np.ndarray, rules: NearRules) -> np.ndarray:
    rows = values.reshape(rules.bands, rules.rows).astype(np.uint64)
    key = np.arange(1, rules.bands + 1, dtype=np.uint64) * MULTIPLIERS[-1]
    for k in range(rules.rows):
        key = mix(key + rows[:, k] * MULTIPLIERS[k])
    return key.view(np.int64)


def field_mask(bits: int) -> int:
    """One bit at the foot of each field, as a signed long."""
    return int(np.array([sum(1 << i for i in range(0, 64 // bits * bits, bits))], dtype=np.uint64).view(np.int64)[0])


def mismatches(x: Column, y: Column, rules: NearRules) -> Column:
    """Fields in which two packed signatures differ, by bit counts."""

    def one(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        folded = d
        for k in range(1, rules.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(F.lit(field_mask(rules.bits))))

    return F.aggregate(F.zip_with(x, y, one), F.lit(0), lambda a, n: a + n.cast("int"))


def signatures(docs: DataFrame, id_column: str, text_column: str, rules: NearRules) -> DataFrame:
    """(id, n, same, keys, sig): set size, 128 bits that name the whole set, band keys, packed signature."""
    kind, id_type = docs.schema[id_column].dataType.simpleString(), arrow_type(docs, id_column)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in byte_rows(batches, id_column, text_column):
            sets = shingle_sets(texts, rules.shingle)
            values = [minima(s[0], rules.minima) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, type=id_type),
                    pa.array([len(s[0]) for s in sets], type=pa.int64()),
                    pa.array([digest(s[0].tobytes() + s[1].tobytes()) for s in sets], type=pa.binary()),
                    pa.array([band_keys(v, rules) for v in values], type=pa.list_(pa.int64())),
                    pa.array([packed(v, rules.bits) for v in values], type=pa.list_(pa.int64())),
                ],
                names=["id", "n", "same", "keys", "sig"],
            )

    return docs.mapInArrow(sign, f"id {kind}, n long, same binary, keys array<long>, sig array<long>")


def full_sets(docs: DataFrame, id_column: str, text_column: str, rules: NearRules) -> DataFrame:
    kind, id_type = docs.schema[id_column].dataType.simpleString(), arrow_type(docs, id_column)
    halves = pa.list_(pa.int64())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in byte_rows(batches, id_column, text_column):
            sets = shingle_sets(texts, rules.shingle)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=id_type), *(pa.array([s[k].view(np.int64) for s in sets], type=halves) for k in (0, 1))], names=["id", "set", "more"])

    return docs.mapInArrow(make, f"id {kind}, set array<long>, more array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, id_column: str, text_column: str, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    involved = pairs.select(F.col("a").alias(id_column)).union(pairs.select("b")).distinct()
    sets = materialise(full_sets(docs.join(involved, id_column, "left_semi"), id_column, text_column, rules))
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / rules.set_block).alias("blocks"))
    placed = pairs.join(load, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
    members = placed.join(sets.select(F.col("id").alias("b"), "set", "more"), "b").select("a", "block", "b", "set", "more")
    first = load.join(sets.select(F.col("id").alias("a"), "set", "more"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "set", "more")
    # each set travels once a pair, a pivot's once a block of its pairs; it stands before them and is held while they pass
    together = members.unionByName(first).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: Shingles = (np.zeros(0), np.zeros(0))
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b"), batch.column("set"), batch.column("more"), strict=True):
                own = x.values.to_numpy(), y.values.to_numpy()
                if not b.is_valid:
                    pivot = tuple(h.copy() for h in own)
                    keep.append(False)
                    continue
                common = shared(pivot, own)
                keep.append(100 * common >= rules.min_pct * (len(pivot[0]) + len(own[0]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return together.mapInArrow(check, pairs.schema)


def in_blocks(members: DataFrame, key: str, block: int, attached: DataFrame):
    """members (key, rep, component) of keys with several components, grouped so that any two of a key meet in one
    group of at most two blocks; larger keys are split. `attached` adds what it has for each rep."""
    sizes = members.groupBy(key).agg(F.count("*").alias("_m"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    blocks = F.ceil(F.col("_m") / block).cast("int")
    placed = members.join(sizes.select(key, blocks.alias("_blocks")), key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    spread = placed.join(attached, "rep").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.withColumn("_i", F.least("own", "_other")).withColumn("_j", F.greatest("own", "_other")).drop("_blocks", "_other").groupBy(key, "_i", "_j")


class Forest:
    """Union of labels held in one array; join() gives one place for each group of others that was still apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        names, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.x, self.y, self.label = codes[: len(x)], codes[len(x) :], np.arange(len(names))

    def apart(self, i: int, js: np.ndarray) -> np.ndarray:
        return js[self.label[self.y[js]] != self.label[self.x[i]]]

    def join(self, i: int, js: np.ndarray) -> np.ndarray:
        js = self.apart(i, js)
        if len(js):
            others, first = np.unique(self.label[self.y[js]], return_index=True)
            self.label[np.isin(self.label, others)] = self.label[self.x[i]]
            js = js[first]
        return js


def sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the one or two blocks of a group."""
    own = part["own"].to_numpy()
    return np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())


def allowed(x: pd.DataFrame, y: pd.DataFrame, rules: NearRules) -> Iterator[tuple[int, np.ndarray]]:
    """For stretches of x: their offset and which pairs of different components the signatures allow."""
    sx, sy = (np.stack(p["sig"].to_numpy()).astype(np.int64).view(np.uint64) for p in (x, y))
    cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
    mask, most = np.array([field_mask(rules.bits)], dtype=np.int64).view(np.uint64)[0], rules.most_mismatches()
    step = max(1, (1 << 20) // len(y))
    for at in range(0, len(x), step):
        differ = np.zeros((len(sx[at : at + step]), len(y)), dtype=np.int32)
        for w in range(sx.shape[1]):
            d = sx[at : at + step, None, w] ^ sy[None, :, w]
            folded = d.copy()
            for k in range(1, rules.bits):
                folded |= d >> U(k)
            differ += np.bitwise_count(folded & mask)
        yield at, (differ <= most) & (cx[at : at + step, None] != cy[None, :])


def across(members: DataFrame, sigs: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) between components that some bucket holds together and the signatures allow: within a task only
    as many as join what was apart, so at most one less than there are components."""
    kind = members.schema["component"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        x, y = (part.iloc[i].reset_index(drop=True) for i in sides(part))
        cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
        forest, out = Forest(cx, cy), []
        for at, may in allowed(x, y, rules):
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                out += [(cx[at + i], c) for c in cy[forest.join(at + i, np.flatnonzero(may[i]))].tolist()]
        return pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(members, "key", rules.block, sigs).applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def settled(members: DataFrame, sigs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Confirmed links (a, b) between different components of a cluster, again only those that join what was apart.

    members: cluster, rep, component. A row of x marks its shingles; the marks under each set of y are summed.
    """
    kind = members.schema["rep"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        ix, iy = sides(part)
        x, y = (part.iloc[i].reset_index(drop=True) for i in (ix, iy))
        rx, ry = x["rep"].to_numpy(), y["rep"].to_numpy()
        sizes = np.array([len(s) for s in part["set"]])
        code = np.split(numbered(np.concatenate(part["set"].to_numpy()), np.concatenate(part["more"].to_numpy())), np.cumsum(sizes)[:-1])
        names = 1 + max(int(c.max()) for c in code)
        flat, sizes = np.concatenate([code[i] for i in iy]), sizes[iy]
        start = np.cumsum(sizes) - sizes
        forest, out = Forest(x["component"].to_numpy(), y["component"].to_numpy()), []
        for at, may in allowed(x, y, rules):
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                js = forest.apart(at + i, np.flatnonzero(may[i]))
                if not len(js):
                    continue
                own = code[ix[at + i]]
                marks = np.zeros(names, dtype=np.int32)
                marks[own] = 1
                common = np.add.reduceat(marks[flat], start)[js]
                good = 100 * common >= rules.min_pct * (len(own) + sizes[js] - common)
                out += [(rx[at + i], r) for r in ry[forest.join(at + i, js[good])].tolist()]
        return pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(members, "cluster", rules.set_block, sigs.join(sets, "rep")).applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: NearRules = NearRules()) -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id reachable over links, its own included), kept.

    Words are runs without ASCII white space, A-Z lower-cased. A text without words (or null) has an empty set and no
    links. Rows with the same id are one document, linked as any of their texts is; rows without id are
    linked with nothing and kept. An empty table gives an empty result; further columns are ignored.
    """
    docs = only(docs, id_column, text_column)
    named = docs.where(F.col(id_column).isNotNull())
    if not named.groupBy(id_column).count().where(F.col("count") > 1).limit(1).count():
        return _of_unique_ids(docs, id_column, text_column, rules)
    ordered = named.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).orderBy("id", F.md5("text"))
    rows = materialise(ordered.withColumn("row", F.monotonically_increasing_id()))  # written: the numbers must not change
    found = materialise(_of_unique_ids(rows, "row", "text", rules).select("row", "n_shingles", F.col("component_id").alias("group")))
    known = rows.select("row", "id").join(found, "row")
    first = known.groupBy("id").agg(F.min("group").alias("least"))
    groups = connected_components(known.join(first, "id").select(F.col("group").alias("a"), F.col("least").alias("b")).distinct())
    least = groups.select(F.col("id").alias("group"), F.col("component").alias("row")).join(rows.select("row", F.col("id").alias("component_id")), "row").select("group", "component_id")
    out = known.join(least, "group").select(F.col("id").alias(id_column), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(_of_unique_ids(docs.where(F.col(id_column).isNull()), id_column, text_column, rules))


def _of_unique_ids(docs: DataFrame, id_column: str, text_column: str, rules: NearRules) -> DataFrame:
    made = materialise(signatures(docs, id_column, text_column, rules))
    known = made.where(F.col("id").isNotNull())
    reps = materialise_few(known.where(F.col("n") > 0).groupBy("same").agg(F.min("id").alias("rep")))
    of = reps.select(F.col("rep").alias("id"), "same")
    speakers = materialise_few(known.join(of, ["id", "same"], "left_semi").select(F.col("id").alias("rep"), "keys", "sig"))

    sigs = speakers.select("rep", "sig")
    buckets = speakers.select(F.explode("keys").alias("key"), "rep")
    pivots = materialise_few(buckets.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("m")).where(F.col("m") > 1).select("key", "a"))
    held = materialise_few(buckets.join(pivots, "key"))  # plain scans on both sides, so that a skewed bucket is split at run time
    tried = held.where(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")).distinct()
    sig = lambda name, out: sigs.select(F.col("rep").alias(name), F.col("sig").alias(out))
    likely = tried.join(sig("b", "y"), "b").join(sig("a", "x"), "a").where(mismatches(F.col("x"), F.col("y"), rules) <= rules.most_mismatches()).select("a", "b")
    links = materialise_few(confirmed(materialise_few(likely), docs, id_column, text_column, rules))
    groups = connected_components(links)

    component = F.coalesce("component", "rep").alias("component")
    placed = held.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", component)
    clusters = connected_components(across(placed, sigs, rules))
    if clusters.limit(1).count():
        apart = placed.select("rep", "component").distinct().join(clusters.select(F.col("id").alias("component"), F.col("component").alias("cluster")), "component")
        apart = materialise_few(apart)
        sets = full_sets(docs.join(apart.select(F.col("rep").alias(id_column)), id_column, "left_semi"), id_column, text_column, rules)
        found = settled(apart, sigs, sets.withColumnRenamed("id", "rep"), rules)
        groups = connected_components(links.unionByName(found))
    # sets that were equal from the start hang on their speaker
    spoken = made.join(reps, "same", "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    placed = spoken.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return placed.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
