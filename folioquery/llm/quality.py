"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The units are the characters of the text, white space as one blank, so that the model knows the
spelling and punctuation of trusted text and its counts stay small beside the corpus. An n-gram is
one number: twelve bits per character and its order on top; characters beyond fold into the
same 4094 classes by remainder. Counts are collected per task, summed by key, and the model is
built by joins: order by order, discounted counts plus the context's spare weight times the
probability of the shorter n-gram.

Scoring never sends the model anywhere whole. Documents are cut into blocks; each block asks the shards of
the model for its distinct n-grams, the shard answers with what it has, and answers and
documents meet again by block. Requests and answers are routed in rounds (`routing`). Perplexity is the exponential of the mean negative log probability.

Trusted text is split by a hash of the text: a quarter sets the thresholds and is never counted, since
counted text looks better than it is. A document is rejected if its perplexity is above the
quantile of the held-out trusted documents of its language. That of n documents is drawn to the quantile of all
by a weight of FEW documents, so that a language with few of them has no threshold by chance; null languages take
the quantile of all. Without trusted text nothing is rejected.

Null and empty texts have one unit, the end of the text. Equal texts have equal perplexity and
verdicts within a language. An empty table gives no rows. Of the documents doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.llm.common import blocks, pack_documents, slices, stable, text_bytes, unsqueeze, whole_text
from folioquery.llm.routing import ANSWER, REQUEST, answer_row, answered, homeward, outward, request_row, ways
from folioquery.session import materialize

ORDER = 4
QUANTILE = 0.995
FEW = 50  # held-out trusted documents of a language that weigh as much as those of all languages
FOLDS = 4
BITS = 12
EDGE = 1  # stands before a text and after it
SPACE = re.compile(r"\s+")
SHARE_BYTES = 32 << 20  # text per shard of the model


def units(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts, each with order-1 edges before and one after; text of each."""
    framed = [SPACE.sub(" ", t).strip() for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = 2 + codes % ((1 << BITS) - 2)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    out = np.full(len(codes) + order * len(framed), EDGE, np.int64)
    text = np.repeat(np.arange(len(framed)), sizes + order)
    begin = np.cumsum(sizes + order) - sizes - order
    within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(begin, sizes) + order - 1 + within] = codes
    return out, text


def windows(codes: np.ndarray, text: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each unit of a text (not at its front edges), and its text."""
    if len(codes) < order:
        return codes[:0], text[:0]
    n = len(codes) - order + 1
    key = np.zeros(n, np.int64)
    for i in range(order):
        key = key << BITS | codes[i : i + n]
    inside = text[order - 1 :] == text[:n]
    return key[inside], text[order - 1 :][inside]


def tagged(key: np.ndarray, order: int) -> np.ndarray:
    """The key with its order on top, so that n-grams of all orders share one column."""
    return key | np.int64(order) << 60


def shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """The last `order` units of longer keys."""
    return keys & ((np.int64(1) << BITS * order) - 1)


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, n): n-grams of the highest order in docs(text), summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for start, end in slices(texts):
                key, _ = windows(*units(texts[start:end], order), order)
                index, found = pd.factorize(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.bincount(index, minlength=len(found)))], ["key", "n"]
                )

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    """The key without its first unit."""
    return F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _context() -> Column:
    """The key without its last unit."""
    return F.shiftright("key", BITS)


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from its counts of counts (four numbers)."""
    found = {r["n"]: r["c"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n = [found.get(i, 0) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for i in range(3):
        d = i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5
        out.append(min(max(d, 0.05), i + 0.95))
    return out


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(text) -> (key, logp, spare): the model.

    `logp` of an n-gram is its interpolated log probability, `spare` of a context the log weight that
    it leaves to the shorter n-gram; each is null where the key only serves as the other.
    """
    highest = materialize(ngram_counts(docs, order), "quality-counts")
    by_order = {order: highest}
    for m in range(order - 1, 0, -1):
        # Continuation counts: how many different units come before.
        by_order[m] = materialize(
            by_order[m + 1].groupBy(_suffix(m + 1).alias("key")).agg(F.count(F.lit(1)).alias("n")), "quality-counts"
        )
    parts = []
    lower = None
    for m in range(1, order + 1):
        d1, d2, d3 = discounts(by_order[m])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = by_order[m].select("key", "n", cut.alias("cut"), _context().alias("context"))
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("spare"))
        joined = own.join(contexts, "context")
        if lower is None:
            below = F.lit(1.0 / (1 << BITS))
        else:
            joined = joined.withColumn("short", _suffix(m)).join(lower.select(F.col("key").alias("short"), F.col("p").alias("below")), "short")
            below = F.col("below")
        model = joined.select("key", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("spare") * below).alias("p"))
        lower = materialize(model, "quality-model")
        parts.append(lower.select(F.col("key").bitwiseOR(F.lit(m << 60)).alias("key"), F.log("p").cast("float").alias("logp"), F.lit(None).cast("float").alias("spare")))
        parts.append(contexts.select(F.col("context").bitwiseOR(F.lit((m - 1) << 60)).alias("key"), F.lit(None).cast("float").alias("logp"), F.log("spare").cast("float").alias("spare")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("key").agg(F.max("logp").alias("logp"), F.max("spare").alias("spare"))


def split_keys(steps: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """Rising keys, held as steps, by the key modulo n."""
    keys = np.cumsum(steps)
    way = keys % n
    order = np.argsort(way, kind="stable")
    found, first = np.unique(way[order], return_index=True)
    return {int(w): np.diff(own, prepend=0) for w, own in zip(found, np.split(keys[order], first[1:]), strict=True)}


def requests(docs: DataFrame, order: int, each: int) -> DataFrame:
    """(way, origin, crate): the distinct n-grams and contexts of each block, by the key modulo `each`."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches):
            keys = np.zeros(0, np.int64)
            for start, end in slices(texts):
                key, _ = windows(*units(texts[start:end], order), order)
                keys = np.union1d(keys, pd.unique(key))
            wanted = [np.zeros(1, np.int64)]  # the empty context
            for m in range(order, 0, -1):
                own = np.unique(shorter(keys, m))
                wanted.append(tagged(own, m))
                if m > 1:
                    wanted.append(tagged(np.unique(own >> BITS), m - 1))
            wanted = np.unique(np.concatenate(wanted))
            for way, own in split_keys(np.diff(wanted, prepend=0), each).items():
                yield request_row(way, block, own)

    return docs.select("doc_id", "text").mapInArrow(ask, REQUEST)


def answers(asked: DataFrame, model: DataFrame, shards: int, levels: int) -> DataFrame:
    """(origin, crate): keys that the model has with their two logs, in place of the keys asked for."""
    rows = model.select(F.pmod("key", F.lit(shards).cast("long")).alias("way"), "key", "logp", "spare")
    nothing = {"origin": "long", "crate": "binary"}
    rows = rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    both = rows.unionByName(asked.select("*", *(F.lit(None).cast(t).alias(n) for t, n in (("long", "key"), ("float", "logp"), ("float", "spare")))))
    # The rows of the model come before the requests of their shard.
    dealt = both.repartition(shards, "way").sortWithinPartitions("way", F.col("origin").isNotNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, table = None, [], None

        def found(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys = np.cumsum(steps)
            keys = keys[np.isin(keys, table[0], assume_unique=True)]
            at = np.searchsorted(table[0], keys)
            return np.diff(keys, prepend=0), table[1][at], table[2][at]

        for batch in batches:
            numbers = batch.column("way").to_numpy()
            asks = np.array(batch.column("origin").is_valid())
            # Runs of equal shard and kind.
            edges = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])])
            for start, end in zip(edges, np.r_[edges[1:], len(numbers)], strict=True):
                piece = batch.slice(start, end - start)
                if numbers[start] != shard:
                    shard, parts, table = numbers[start], [], None
                if not asks[start]:
                    parts.append([piece.column(n).to_numpy(zero_copy_only=False) for n in ("key", "logp", "spare")])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] + [np.zeros(0, np.float32)] * 2
                    order = np.argsort(table[0])
                    table = [c[order] for c in table]
                for origin, crate in zip(piece.column("origin").to_pylist(), piece.column("crate").to_pylist(), strict=True):
                    yield answer_row(origin, answered(unsqueeze(crate), levels, found))

    return dealt.mapInArrow(answer, ANSWER)


def log_probabilities(keys: np.ndarray, known: np.ndarray, logp: np.ndarray, spare: np.ndarray, order: int) -> np.ndarray:
    """log p of each n-gram: its own where the model has it, else spare weight and the shorter one."""

    def look(wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, values[at], np.nan)

    start = look(np.zeros(1, np.int64), spare)
    total = np.full(len(keys), (0.0 if np.isnan(start[0]) else start[0]) - BITS * np.log(2))
    for m in range(1, order + 1):
        own = shorter(keys, m)
        seen = look(tagged(own, m), logp)
        rest = look(tagged(own >> BITS, m - 1), spare) if m > 1 else np.zeros(len(keys))
        total = np.where(np.isnan(seen), total + np.nan_to_num(rest), seen)
    return total


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_units, perplexity; a row per document."""
    id_field = docs.schema["doc_id"].dataType
    docs = stable(docs.select("doc_id", "text"))  # read twice: both reads must see the same blocks
    each, levels = ways(max(1, -(-text_bytes(docs) // SHARE_BYTES)))
    asked = outward(requests(docs, order, each), each, levels, split_keys)
    found = homeward(answers(asked, model, each**levels, levels), each, levels)
    rows = pack_documents(docs).select("block", "docs", F.lit(None).cast("binary").alias("found"))
    rows = rows.unionByName(found.select(F.col("origin").alias("block"), F.lit(None).cast("binary").alias("docs"), F.col("crate").alias("found")))
    dealt = rows.repartition(4 * each**levels, "block").sortWithinPartitions("block", F.col("docs").isNotNull())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = to_arrow_type(id_field)
        current, parts = None, []
        for batch in batches:
            for block, packed, reply in zip(*(batch.column(n).to_pylist() for n in ("block", "docs", "found")), strict=True):
                if block != current:
                    current, parts = block, []
                if packed is None:
                    parts += [(np.cumsum(steps), logp, spare) for steps, logp, spare in unsqueeze(reply)]
                    continue
                if not parts:  # each block asks at least for the empty context, and every request is answered
                    raise RuntimeError(f"no answer for block {block}: the input changed between two reads")
                known = [np.concatenate(c) for c in zip(*parts, strict=True)]
                sort = np.argsort(known[0])
                known = [c[sort] for c in known]
                ids, texts = unsqueeze(packed)
                for start, end in slices(texts):
                    key, text = windows(*units(texts[start:end], order), order)
                    index, distinct = pd.factorize(key)
                    logs = log_probabilities(distinct, *known, order)[index]
                    n = np.bincount(text, minlength=end - start)
                    mean = -np.bincount(text, logs, end - start) / n
                    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts[start:end]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[start:end], id_type),
                            pa.array(np.array(hashes, np.uint64).view(np.int64)),
                            pa.array(n),
                            pa.array(np.exp(np.minimum(mean, 50))),
                        ],
                        ["doc_id", "text_hash", "n_units", "perplexity"],
                    )

    return dealt.mapInArrow(score, f"doc_id {id_field.simpleString()}, text_hash long, n_units long, perplexity double")


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(7), whole_text()), F.lit(FOLDS))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


#: The trusted ids filter the scan of the texts by a Bloom filter, so that only trusted texts are shuffled.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """docs(doc_id, text, lang, ...), labels(doc_id, quality, ...) ->
    doc_id, text_hash, lang, n_units, perplexity, threshold, kept; a row per document."""
    trusted = trusted_ids(labels)
    # The ids grow with the corpus, so they are never broadcast: one plan at every size.
    counted = docs.where(_fold() != 0).select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left_semi")
    with settings(docs.sparkSession, BLOOM):
        model = train(counted, order)
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), "lang", (_fold() == 0).alias("calibrates"))
    # Repeated rows of one document have the same score; one of them is joined.
    one = perplexities(docs, model, order).dropDuplicates(["doc_id", "text_hash"])
    same = rows["doc_id"].eqNullSafe(one["doc_id"]) & (rows["text_hash"] == one["text_hash"])
    judged = rows.join(one, same).select(rows["doc_id"], rows["text_hash"], "lang", "calibrates", "n_units", "perplexity")
    judged = materialize(judged, "quality-scores")
    held = judged.where("calibrates").join(trusted, "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    own = held.groupBy("lang").agg(limit.alias("own"), F.count(F.lit(1)).alias("n"))
    overall = held.agg(limit).first()[0]
    drawn = F.exp((F.col("n") * F.log("own") + FEW * F.log(F.lit(overall).cast("double"))) / (F.col("n") + FEW))
    own = own.where(F.col("lang").isNotNull()).select("lang", drawn.alias("own"))
    threshold = F.coalesce(F.col("own"), F.lit(overall).cast("double"))
    return judged.join(own, "lang", "left").select(
        "doc_id",
        "text_hash",
        "lang",
        "n_units",
        "perplexity",
        threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bad = judge(docs, labels, order, quantile).where("not kept")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang").alias("_lang"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang"))
    return docs.join(bad, same & (F.xxhash64(whole_text()) == F.col("_hash")), "left_anti")
