"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits. The bits are put into m groups,
correlated bits together. A fingerprint gets a threshold for each group, -1 (not probed) or
more, that sum to distance - m + 1: if it differed from another in more bits than the threshold in
every group, the differences would sum to more than `distance`. Which groups may differ how far is
chosen for each fingerprint by dynamic programming over estimated candidate counts, so that
values that are frequent are not probed. Probes meet the index in buckets (group, value); what
meets is verified on all 64 bits, and each bucket gives a spanning forest of its links, not its
pairs. Classes are the connected components of these links.

Null texts count as empty; texts without words have fingerprint zero and are linked like any
other. Equal fingerprints are one point, so copies and repeated rows cost nothing. The class is named
by its smallest doc_id; rows without doc_id take part and get the id of their class, null if there is
none. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folioquery.llm.common import share, whole_text
from folioquery.session import materialize

SHINGLE = 3
DISTANCE = 2
SEED = 42
BITS = 64
SAMPLE = 20_000  # fingerprints from which bit groups and candidate counts are estimated
BUCKET = 4096  # fingerprints of a bucket that one comparison takes from either side
UNIT = 200_000  # shingles hashed at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles, as an unsigned number."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), UNIT):
        parts = [joined[a:b] for a, b in zip(starts[at : at + UNIT], stops[at : at + UNIT], strict=True)]
        hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_hash, fp (the 64 bits as a long)."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), fp(whole_text()).alias("fp"))


class Partitioning:
    """Groups of bits, and the cost of probing a value of a group up to a threshold."""

    def __init__(self, sample: np.ndarray, total: int, groups: int, distance: int) -> None:
        """sample: uint64 fingerprints out of `total`"""
        self.distance = distance
        self.bits = self._group(sample, groups)
        self.scale = total / max(len(sample), 1)
        self.total = total
        self.counts = []
        for group in range(groups):
            values, counts = np.unique(self.project(sample, group), return_counts=True)
            self.counts.append((values, counts))
        # All ways to share distance - groups + 1, found by dynamic programming over the groups.
        self.budget = distance - groups + 1
        # Bit flips of a group's value by distance, the unchanged value first.
        self.flips = []
        for own in self.bits:
            masks = [[0]]
            for d in range(1, distance + 1):
                masks.append([sum(1 << i for i in c) for c in combinations(range(len(own)), d)])
            self.flips.append([np.array(m, np.int64) for m in masks])

    @staticmethod
    def _group(sample: np.ndarray, groups: int) -> list[list[int]]:
        """Greedy: each group starts with the most correlated pair left and grows by the strongest tie."""
        bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        tie = np.zeros((BITS, BITS))
        if len(bits) > 1:
            centred = bits - bits.mean(0)
            spread = np.sqrt((centred**2).sum(0))
            spread[spread == 0] = 1
            tie = np.abs(centred.T @ centred) / np.outer(spread, spread)
        np.fill_diagonal(tie, 0)
        left = list(range(BITS))
        sizes = [BITS // groups + (g < BITS % groups) for g in range(groups)]
        out = []
        for size in sizes:
            within = tie[np.ix_(left, left)]
            first, second = np.unravel_index(int(within.argmax()), within.shape)
            own = [left[first]] if size == 1 or first == second else [left[first], left[second]]
            rest = [b for b in left if b not in own]
            while len(own) < size:
                best = rest[int(tie[np.ix_(own, rest)].sum(0).argmax())]
                own.append(best)
                rest.remove(best)
            out.append(sorted(own))
            left = rest
        return out

    def project(self, fps: np.ndarray, group: int) -> np.ndarray:
        """The bits of a group, packed to the low end."""
        out = np.zeros(len(fps), np.int64)
        for i, bit in enumerate(self.bits[group]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
        return out

    def _known(self, group: int, values: np.ndarray) -> np.ndarray:
        keys, counts = self.counts[group]
        if not len(keys):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, counts[at], 0)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, group, threshold + 1]: keys probed plus candidates expected."""
        out = np.zeros((len(fps), len(self.bits), self.distance + 2))
        for group, own in enumerate(self.bits):
            values = self.project(fps, group)
            found = keys = 0.0
            for d in range(self.distance + 1):
                masks = self.flips[group][d]
                if d < 2:
                    found = found + sum(self._known(group, values ^ m) for m in masks)
                else:  # far rings grow as the number of their keys
                    found = found * (keys + len(masks)) / keys
                keys += len(masks)
                out[:, group, d + 1] = keys + found * self.scale + keys * self.total / 2.0 ** len(own)
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cheapest thresholds of each fingerprint that sum to the budget, and their cost."""
        costs = self.costs(fps)
        groups = len(self.bits)
        sums = self.budget + groups + 1  # thresholds shifted by one, so that they sum from 0
        best = np.full((len(fps), sums), np.inf)
        best[:, 0] = 0
        choice = np.zeros((groups, len(fps), sums), np.int64)
        for group in range(groups):
            after = np.full_like(best, np.inf)
            for t in range(min(self.distance + 2, sums)):
                cost = np.full_like(best, np.inf)
                cost[:, t:] = best[:, : sums - t] + costs[:, group, t][:, None]
                better = cost < after
                after = np.where(better, cost, after)
                choice[group][better] = t
            best = after
        picked = np.zeros((len(fps), groups), np.int64)
        at = np.full(len(fps), sums - 1)
        rows = np.arange(len(fps))
        for group in reversed(range(groups)):
            picked[:, group] = choice[group][rows, at] - 1
            at = at - picked[:, group] - 1
        return picked, best[:, -1]


def choose_partitioning(sample: np.ndarray, total: int, distance: int) -> Partitioning:
    """As many groups as cost the least on the sample."""
    tried = [Partitioning(sample, total, m, distance) for m in range(2, distance + 3)]
    return min(tried, key=lambda p: p.thresholds(sample)[1].sum() + len(sample) * len(p.bits))


def bucket_rows(points: DataFrame, partitioning: Partitioning, hot: DataFrame | None) -> DataFrame:
    """points(fp) -> part, value, fp, probe: index rows of every group, probe rows of the chosen keys."""
    sent = share(points.sparkSession, partitioning)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Partitioning = sent()
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            picked, _ = plan.thresholds(fps)
            for group in range(len(plan.bits)):
                values = plan.project(fps, group)
                columns = [(values, fps, np.full(len(fps), False))]
                for d in range(plan.distance + 1):
                    who = picked[:, group] >= d
                    masks = plan.flips[group][d]
                    columns.append(
                        (
                            (values[who][:, None] ^ masks[None, :]).ravel(),
                            np.repeat(fps[who], len(masks)),
                            np.full(int(who.sum()) * len(masks), True),
                        )
                    )
                value, fp, probe = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(value), group, np.int32)),
                        pa.array(value),
                        pa.array(fp.view(np.int64)),
                        pa.array(probe),
                    ],
                    ["part", "value", "fp", "probe"],
                )

    rows = points.select("fp").mapInArrow(spread, "part int, value long, fp long, probe boolean")
    if hot is None:
        return rows.select("*", F.lit(0).alias("x"), F.lit(0).alias("q"))
    # A hot bucket is a grid of sub-buckets: index slices by probe slices, each of bounded size.
    cut = rows.join(hot, ["part", "value"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    x = F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).cast("int")
    q = F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).cast("int")
    return cut.select("part", "value", "fp", "probe", x.alias("x"), q.alias("q"))


def forest(index: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within `distance`: each point with the least of its tree."""
    points = np.unique(np.concatenate([index, probes]))
    label = np.arange(len(points))
    at_x, at_q = np.searchsorted(points, index), np.searchsorted(points, probes)
    pairs = []
    step = max(1, 1_000_000 // len(index))
    for start in range(0, len(probes), step):
        near = np.bitwise_count(probes[start : start + step, None] ^ index[None, :]) <= distance
        q, x = np.nonzero(near)
        a, b = at_q[start + q], at_x[x]
        keep = a != b
        a, b = a[keep], b[keep]
        # Pairs of one tree are dropped at once, so that a dense bucket stays small in memory.
        apart = label[a] != label[b]
        if apart.any():
            pairs.append((a[apart], b[apart]))
            while True:
                before = label.copy()
                for u, v in pairs:
                    low = np.minimum(label[u], label[v])
                    np.minimum.at(label, u, low)
                    np.minimum.at(label, v, low)
                label = label[label]
                if (label == before).all():
                    break
            pairs = [(np.arange(len(label))[label != np.arange(len(label))], label[label != np.arange(len(label))])]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return points[moved], points[label[moved]]


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Spanning links (a, b) of every bucket of rows(part, value, x, q, fp, probe)."""
    keys = ["part", "value", "x", "q"]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def close(frame: pd.DataFrame) -> pa.RecordBatch | None:
            first = np.r_[True, (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(1)]
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(frame)]
            fp = frame["fp"].to_numpy().view(np.uint64)
            probe = frame["probe"].to_numpy()
            left, right = [], []
            probed = np.logical_or.reduceat(probe, starts)
            differ = np.maximum.reduceat(fp, starts) != np.minimum.reduceat(fp, starts)
            for i in np.flatnonzero(probed & differ):
                part, asks = fp[starts[i] : ends[i]], probe[starts[i] : ends[i]]
                if asks.all():
                    continue
                a, b = forest(part[~asks], part[asks], distance)
                left.append(a)
                right.append(b)
            if not left:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)], ["a", "b"]
            )

        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            # The last bucket may go on in the next batch.
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))
            if cut and (out := close(frame.iloc[:cut])) is not None:
                yield out
            held = frame.iloc[cut:]
        if held is not None and (out := close(held)) is not None:
            yield out

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> fp, root: the least point that each point reaches.

    Every round takes the least root among the neighbours and then the root of that root; rounds
    grow with the logarithm of the longest chain.
    """
    both = edges.union(edges.select("b", "a")).distinct().toDF("fp", "near")
    both = materialize(both, "simhash-edges")
    roots = materialize(both.groupBy("fp").agg(F.least(F.col("fp"), F.min("near")).alias("root")), "simhash-roots")
    while True:
        seen = both.join(roots.select(F.col("fp").alias("near"), "root"), "near").groupBy("fp").agg(F.min("root").alias("seen"))
        nearer = roots.join(seen, "fp").select("fp", "root", F.least("root", "seen").alias("step"))
        jump = roots.select(F.col("fp").alias("step"), F.col("root").alias("beyond"))
        moved = nearer.join(jump, "step").select("fp", F.least("step", "beyond").alias("new"), "root")
        moved = materialize(moved.select("fp", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), "simhash-roots")
        roots = moved.select("fp", "root")
        if moved.where("moved").isEmpty():
            return roots


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_hash, fp, root, component_id: rows with the class of their fingerprint."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    total = points.count()
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    partitioning = choose_partitioning(sample.view(np.uint64), total, distance)
    sizes = bucket_rows(points, partitioning, None).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > 2 * BUCKET).select("part", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("cuts"))
    hot = materialize(hot, "simhash-hot")
    edges = materialize(bucket_links(bucket_rows(points, partitioning, hot), distance), "simhash-links")
    roots = components(edges)
    known = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(known.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fingerprint, component_id; a row per document."""
    found = classes(docs, shingle, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each class, with all its columns: the one whose doc_id names the class.

    Different texts may share a doc_id; they stay apart by their class, and of texts of one class and id the one of
    the least hash stays, once. Rows without doc_id stay: they cannot be told apart by an id.
    """
    named = classes(docs, shingle, distance).where(F.col("doc_id") == F.col("component_id"))
    stay = named.groupBy(F.col("doc_id").alias("_stay"), "root").agg(F.min("text_hash").alias("_hash")).drop("root").distinct()
    own = docs.withColumn("_text_hash", F.xxhash64(whole_text()))
    kept = own.join(stay, (F.col("doc_id") == F.col("_stay")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
