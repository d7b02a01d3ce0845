"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each document becomes its set of hashed five-word shingles, band keys and a sketch of one byte per MinHash.
   Documents with equal sets are one class, and only its smallest doc_id goes on.
2. Classes that share a band key are candidates. Pairs within a bucket are not listed: first each member meets
   only the bucket's smallest member. Large buckets that then still hold several components get further leaders, from
   components that had none. What is outside the largest component of a bucket is then compared with all of it inside
   tasks, in blocks; of these pairs only links that join components leave a task.
3. A candidate's sketches are compared batch by batch; once the posterior probability that the similarity reaches the
   threshold, given the matches so far, falls below MISS, it is dropped. Survivors are confirmed on full sets.
4. Connected components of the confirmed links give each document its component.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, attach, drop_ids, groups_of, materialise, operator, text_of, tidy
from .components import connected_components

#: Words in a shingle; MinHashes; those of them kept in the sketch; sizes at which the posterior is looked at.
SHINGLE, HASHES, SKETCH, LOOKS = 5, 192, 128, (16, 32, 64, 96, 128)
#: Probability of missing a pair at the threshold, for the banding and for each look at the sketch.
MISS = 1e-6
#: Members of a bucket that meet in one task, further leaders of larger buckets, and bytes of text hashed at once.
BLOCK, LEADERS, CHUNK = 1024, 4, 1 << 19

ALL, REST, OTHER = 0, 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_KEY = "word hash key 16"
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240501)
_MULTIPLIER = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_STEP = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def bands_for(similarity: float) -> tuple[int, int]:
    """(bands, rows): the longest bands of HASHES that miss a pair at the threshold with probability MISS at most."""
    rows = max(r for r in range(1, 17) if (1 - similarity**r) ** (HASHES // r) <= MISS or r == 1)
    return HASHES // rows, rows


def least_matches(similarity: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes go on only with m matches or more.

    With a uniform prior, the posterior of the similarity is Beta(m + 1, n - m + 1), and its mass above the threshold
    is a binomial sum. One-byte hashes also match by chance, which only lets more pairs go on.
    """
    above = lambda m, n: sum(comb(n + 1, j) * similarity**j * (1 - similarity) ** (n + 1 - j) for j in range(m + 1))
    return [(n, next(m for m in range(n + 1) if above(m, n) >= MISS)) for n in LOOKS]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    """SipHash of each word: without the structure by which sums over bytes collide."""
    return pd.util.hash_array(np.array(words, object), hash_key=_KEY, categorize=False)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lowered, and the number of words of each; long texts are
    taken in chunks cut between words."""
    hashes, sizes, held = [np.zeros(0, np.uint64)], [], []
    for text in texts:
        data, at, n = text.encode("utf-8", "surrogatepass").translate(_LOWER), 0, 0
        while at < len(data):
            gap = _SPACE.search(data, at + CHUNK)
            end = gap.start() if gap else len(data)
            words = data[at:end].split()
            held, n, at = held + words if held else words, n + len(words), end
            if len(held) * 8 > CHUNK:
                hashes.append(_hashed(held))
                held = []
        sizes.append(n)
    if held:
        hashes.append(_hashed(held))
    return np.concatenate(hashes), sizes


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of 1 to 4 words has one, one without words none.

    A hash has 64 bits: two sets of n shingles differ from what they are by a collision with a probability of n * n / 2**64.
    """
    hashes, sizes = word_hashes(texts)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += hashes[k : k + len(rolled)] * _STEP[k]
    rolled, out = mix(rolled), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        else:
            out.append(mix((hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else hashes[:0])
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketches) of sets that are not empty."""
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((HASHES, len(sets)), np.uint32)
    for k in range(HASHES):
        least[k] = np.minimum.reduceat((x ^ _FLIP[k]) * _MULTIPLIER[k], first)
    wide, keys = least.astype(np.uint64), np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(_BASE) + wide[b * rows + r])
        keys[:, b] = key
    return keys, ((least[:SKETCH] >> np.uint32(9)) & np.uint32(255)).astype(np.uint8).T


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, members (16 bytes that name the set), bands, sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups_of(batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if full:
                    for k, b, s in zip(full, *signatures([sets[k] for k in full], bands, rows), strict=True):
                        keys[k], sketch[k] = b.view(np.int64), s.tobytes()
                name = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "members", "bands", "sketch"],
                )
                at += len(sets)
        tidy()

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, "doc_id long, n_shingles long, members binary, bands array<long>, sketch binary")


def plausible(left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the rows of sketches that stay plausible through all looks."""
    live, matches, at = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in looks:
        matches = matches + (left[live, at:n] == right[live, at:n]).sum(1)
        go = matches >= least
        live, matches, at = live[go], matches[go], n
    return live


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set (bytes of the sorted hashes) of the documents in wanted (a column id), and perhaps of a few more.

    A filter of bounded size picks the documents in the scan, so that texts are not shuffled.
    """
    chosen = BitFilter(wanted, "id")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), *[p.alias(f"p{k}") for k, p in enumerate(chosen.probes(F.col("doc_id").cast("long")))]).where("id is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(chosen.holds(batch.column("p0").to_numpy(), batch.column("p1").to_numpy()))
            batch, at = batch.select(["id", "text"]).take(pa.array(known)), 0
            for texts in groups_of(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["id", "set"])
                at += len(texts)
        tidy()

    return materialise(rows.mapInArrow(run, "id long, set binary"))


def _confirmed(pairs: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    looks = least_matches(percent / 100)
    sketch = lambda x: heads.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    sized = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(plausible(left, right, looks)))

    survivors = materialise(sized.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long"))
    sets = _full_sets(docs, survivors.select(F.col("a").alias("id")).union(survivors.select("b")))

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if linked(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], percent)[0]:
                    good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    side = lambda c, s: sets.select(F.col("id").alias(c), F.col("set").alias(s))
    return materialise(survivors.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for a sorted set with each of others."""
    size = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))
    return 100 * both >= percent * (len(one) + size - both)


class Block:
    """Members of a bucket that meet in a task: rows of id, component, own, n_shingles. All meet each other (own is ALL), or
    those outside the largest component (REST) meet others (OTHER)."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.rows = rows.sort_values("id")
        self.percent, self.looks = percent, least_matches(percent / 100)
        self.ids, self.own, self.size = (self.rows[c].to_numpy() for c in ("id", "own", "n_shingles"))
        self.label = self.rows["component"].to_numpy().copy()
        self.sketch = np.frombuffer(b"".join(self.rows["sketch"]), np.uint8).reshape(-1, SKETCH)
        bands = np.stack(self.rows["bands"])
        self.earlier = bands[:, : int(np.argmax(bands[0] == self.rows["key"].iloc[0]))]

    def partners(self, seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the later ones in other components that stay plausible; labels may change between steps. A pair
        that shares an earlier band meets in that band's bucket, not here; with seen, pairs of two seen members are left out."""
        for k in range(len(self.ids)):
            if self.own[k] == ALL:
                rest = np.arange(k + 1, len(self.ids))
            elif self.own[k] == REST:
                rest = np.flatnonzero(self.own == OTHER)
            else:
                continue
            rest = rest[(self.label[rest] != self.label[k]) & (100 * np.minimum(self.size[rest], self.size[k]) >= self.percent * np.maximum(self.size[rest], self.size[k]))]
            if seen is not None and seen[k]:
                rest = rest[~seen[rest]]
            rest = rest[~(self.earlier[rest] == self.earlier[k]).any(1)]
            if len(rest):
                rest = rest[plausible(np.broadcast_to(self.sketch[k], (len(rest), SKETCH)), self.sketch[rest], self.looks)]
                if len(rest):
                    yield k, rest

    def met(self) -> pd.DataFrame:
        """The members that have a partner."""
        seen = np.zeros(len(self.ids), bool)
        for k, rest in self.partners(seen):
            seen[k] = seen[rest] = True
        return self.rows[seen]

    def joins(self) -> pd.DataFrame:
        """Confirmed links (a, b) that join components of this block, fewer than its members."""
        sets, out = [np.frombuffer(s, np.uint64) for s in self.rows["set"]], []
        for k, rest in self.partners():
            for x in rest[linked(sets[k], [sets[x] for x in rest], self.percent)]:
                if self.label[x] != self.label[k]:
                    out.append((max(self.ids[k], self.ids[x]), min(self.ids[k], self.ids[x])))
                    self.label[self.label == self.label[x]] = self.label[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _in_blocks(rows: DataFrame, work, schema: str) -> DataFrame:
    """work (rows of one key, i, j as pandas -> pandas) on each block; a partition's blocks pass one after the other."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        done = lambda: pa.RecordBatch.from_pandas(work(pd.concat(held))[arrow.names], arrow, preserve_index=False)
        for batch in batches:
            for k, block in batch.to_pandas().groupby(["key", "i", "j"], sort=False):
                if k != key and held:
                    yield done()
                    held = []
                key = k
                held.append(block)
        if held:
            yield done()
        tidy()

    # the rows are few but costly: a number given here keeps Spark from putting many blocks in one task
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _across(buckets: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within buckets (key, id, component, n).

    A bucket of up to BLOCK members is one block. Of a larger one the members outside its largest component are cut into
    parts of about BLOCK by the hash of their ids, and so are all members, and each pair of these parts meets in one task.
    First the sketches tell which members have a plausible partner in another component; only these meet again, with
    their full sets, and a task reports no more links than it has members, since a link within a component adds nothing.
    """
    sizes = buckets.groupBy("key", "component").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    main = materialise(sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), (F.first("n") - F.max("c")).alias("rest")))
    dealt = buckets.join(main, "key")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    small = dealt.where(F.col("n") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(ALL).alias("own"), "id", "component")
    large = dealt.where(F.col("n") > BLOCK)
    rest = large.where("component <> main").select("key", own("rest").alias("i"), every("n").alias("j"), F.lit(REST).alias("own"), "id", "component")
    others = large.select("key", every("rest").alias("i"), own("n").alias("j"), F.lit(OTHER).alias("own"), "id", "component")
    rows = small.union(rest).union(others).join(heads.select(F.col("doc_id").alias("id"), "sketch", "n_shingles", "bands"), "id")
    members = "key long, i int, j int, own int, id long, component long, n_shingles long, sketch binary, bands array<long>"
    near = materialise(_in_blocks(rows, lambda block: Block(block, percent).met(), members))
    sets = _full_sets(docs, near.select("id"))
    return materialise(_in_blocks(near.join(sets.dropDuplicates(["id", "set"]), "id"), lambda block: Block(block, percent).joins(), "a long, b long"))


def _heads(usable: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """One row of each class, with its smallest doc_id."""
    copies = materialise(attach(usable.select("members", "doc_id", "row"), classes.where("size > 1"), "members", "size", total).where("rep is not null"))
    first = copies.where("doc_id = rep").groupBy("members").agg(F.min("row").alias("row")).select("row")
    return drop_ids(usable, materialise(copies.select("row").join(first, "row", "left_anti")), "row")


@operator
def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is component_id) for each row.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct five-word shingles. Null
    and wordless texts have no set and no link. Rows that share a doc_id share a component, whatever their texts; a row
    without doc_id has none and is kept. Only doc_id and text are read, so other columns and their names do not matter.
    """
    signed = materialise(_signed(docs, *bands_for(percent / 100)).withColumn("row", F.monotonically_increasing_id()))
    total = signed.count()
    usable = signed.where("members is not null and doc_id is not null")
    classes = materialise(usable.groupBy("members").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    heads = _heads(usable, classes, total)
    twins = materialise(usable.groupBy("doc_id").agg(F.min("members").alias("lo"), F.max("members").alias("hi")).where("lo <> hi").select("doc_id"))

    bands = materialise(heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")).distinct())
    leaders = materialise(bands.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    shared = materialise(bands.join(leaders, "key"))
    links = _confirmed(shared.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), heads, docs, percent)
    if not twins.isEmpty():  # texts of one doc_id belong together
        met = usable.join(twins, "doc_id").select("doc_id", "members").distinct().join(classes, "members")
        links = materialise(links.union(met.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")))
    found = connected_components(links)

    def mixed(found: DataFrame, least: int) -> DataFrame:
        """key, id, n, component of buckets of more than least members that hold several components."""
        placed = shared.where(F.col("n") > least).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return materialise(placed.select("key", "id", "n", "component").join(materialise(keys), "key", "left_semi"))

    led = leaders.where(F.col("n") > BLOCK).select("key", F.col("leader").alias("id"))
    for _ in range(LEADERS):
        large = mixed(found, BLOCK)
        if large.isEmpty():
            break
        had = large.join(led, ["key", "id"]).select("key", "component").distinct()
        new = materialise(large.join(had, ["key", "component"], "left_anti").groupBy("key").agg(F.min_by(F.struct("id", "component"), "id").alias("l")).select("key", F.col("l.id").alias("leader"), F.col("l.component").alias("of")))
        met = large.join(new, "key").where(F.col("component") != F.col("of")).select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
        links = links.union(_confirmed(met, heads, docs, percent))
        led = materialise(led.union(new.select("key", F.col("leader").alias("id"))))
        found = connected_components(links)

    more = _across(mixed(found, 2), heads, docs, percent)
    if not more.isEmpty():
        found = connected_components(links.union(more))

    settled = materialise(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("members", "size", F.coalesce("component", "rep").alias("component_id")))
    grouped = attach(usable.select("members", "doc_id", "n_shingles"), settled, "members", "size", total).select("doc_id", "n_shingles", "component_id")
    rest = signed.where("members is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
