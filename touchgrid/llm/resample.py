"""Quality classifier by importance resampling.

Generative models over hashed n-grams (bags of words and word pairs in
``BUCKETS`` buckets): target text is what the labels call good, raw text is the
whole corpus.  A document's log weight is

    sum over its n-grams of (ln p_target - ln p_raw - offset),

p with ``SHRINK`` counts added to each bucket, at the scale of the smaller
text, so buckets with little data say little; the offset a gram stands for the
unknown scale of the two models and is fitted on held-out labels.  Gumbel noise
of scale one (a hash of doc_id and text) is added, and the ``k`` largest keys
are drawn; k is a number, or ``POSITIVE``: as many as have a weight over one.
The k-th key is found by histograms, not by a sort.  Rows equal in doc_id and
text have one key and are drawn together.

Toxic text is no matter of likeness to the target and has a step of its own
before the draw, ``screen_toxic``.  A bare word speaks for toxic text by the log
ratio of its shares of target and toxic documents (not occurrences, with half a
document added to each; a word in no toxic document says nothing), a document by
the sum of its two strongest words.  The threshold catches the most held-out
toxic documents that rejecting at most ``FALSE_ALARMS`` of the held-out good
ones allows.  What it rejects takes no part in the draw.

Labels: at most about ``LABEL_ROWS`` labelled doc_ids are used, chosen by a hash
of doc_id; that is the documented bound of the fit.  Raw counts, scores and the
draw cover all documents.

Nulls: a null text has no words, a log weight of zero and so a key of noise
alone; null labels are not used; a null doc_id draws its own noise.  Texts of
any length are read whole.  Rows of one key tie and go by doc_id, then text
hash.  Repeated label rows count as the worst of them; repeated documents each
give a row.  Without good, bad or toxic labels the part that needs them rejects
nothing.  Empty tables give no rows.  Other columns, whatever their names, stay
with their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .flat import ALNUM, LOWER, NOT_SPACE, flat, grams, slices, words
from .shared import written

BUCKETS = 1 << 20
LABEL_ROWS = 200_000
SHRINK = 30.0
FALSE_ALARMS = 0.01  # of held-out good documents, that the screen may reject at most
POSITIVE = "positive weights"
GOOD_COST = 20.0  # of rejecting a good document, against keeping a bad one
_CHUNK = 1 << 14
_GOOD, _JUNK, _TOXIC = 1, 2, 3


def label_sample(labels: DataFrame, bound: int = LABEL_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted doc_ids and classes of about ``bound`` labelled documents at most; negative classes are held out."""
    labels = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    kind = F.when(F.col("toxic") > 0, _TOXIC).when(F.col("quality") > 0, _GOOD).otherwise(_JUNK)
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) < 4
    rows = labels.filter(draw < F.lit(int((1 << 30) * min(1.0, bound / max(1, n))))).select("doc_id", F.when(held_out, -kind).otherwise(kind).alias("kind")).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    order = np.argsort(ids)
    return ids[order], np.array([r[1] for r in rows], np.int8)[order]


def _classes(ids: np.ndarray, kinds: np.ndarray, docs: pa.Array) -> np.ndarray:
    known = docs.fill_null(-(1 << 63)).to_numpy()
    if not len(ids):
        return np.zeros(len(known), np.int8)
    at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
    return np.where(ids[at] == known, kinds[at], 0).astype(np.int8)


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of words and pairs, and (bucket, document) of bare words."""
    buf, off = flat(column)
    buf = LOWER[buf]
    w = words(buf, off, NOT_SPACE)
    doc = w.doc
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    bucket = np.concatenate([w.hash, grams(w.hash, 2)[pair]]) % np.uint64(BUCKETS)
    bare = words(buf, off, ALNUM)
    return bucket.astype(np.int64), np.concatenate([doc, doc[pair]]), (bare.hash % np.uint64(BUCKETS)).astype(np.int64), bare.doc


def count_models(docs: DataFrame, ids: np.ndarray, kinds: np.ndarray) -> dict[str, np.ndarray]:
    """Bucket counts: ``raw`` and ``good`` of words and pairs; documents with a bare word, ``good_bare`` and ``toxic_bare``, and ``sizes``, how many good and toxic ones there are.

    A task keeps one array per model and sends its parts that are not zero;
    parts of one number meet and add up.  What reaches the driver is four
    arrays and two numbers, whose size is fixed.
    """
    held = docs.sparkSession.sparkContext.broadcast((ids, kinds))
    names = ("raw", "good", "good_bare", "toxic_bare", "sizes")

    def count(batches):
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                kind = _classes(*held.value, part.column("doc_id"))
                bucket, doc, bare, bare_doc = _features(part.column("text"))
                good, toxic = kind == _GOOD, kind == _TOXIC
                known = (good | toxic)[bare_doc]
                once = np.unique(bare_doc[known] * BUCKETS + bare[known])  # a document counts once for a word
                bare_doc, bare = once // BUCKETS, once % BUCKETS
                for i, found in enumerate((bucket, bucket[good[doc]], bare[good[bare_doc]], bare[toxic[bare_doc]])):
                    sums[i] += np.bincount(found, minlength=BUCKETS)
                sums[4, :2] += good.sum(), toxic.sum()
        out = [(i * (BUCKETS // _CHUNK) + c, part.tobytes()) for i, row in enumerate(sums) for c, part in enumerate(row.reshape(-1, _CHUNK)) if part.any()]
        yield _blobs(out)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(data, np.int64)
        yield _blobs([(c, x.tobytes()) for c, x in sums.items()])

    def _blobs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "data"])

    schema = "chunk int, data binary"
    parts = docs.mapInArrow(count, schema).repartitionById(32, F.col("chunk")).mapInArrow(add, schema).collect()
    out = np.zeros(len(names) * BUCKETS, np.int64)
    for r in parts:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["data"], np.int64)
    return dict(zip(names, out.reshape(len(names), BUCKETS), strict=True))


def evidence(target: np.ndarray, other: np.ndarray, shrink: float) -> np.ndarray:
    """ln of the shrunken ratio, both scaled to the smaller of the two texts."""
    a, b = float(target.sum()), float(other.sum())
    if not a or not b:
        return np.zeros(len(target), np.float32)
    least = min(a, b)
    return np.log((target * (least / a) + shrink) / (other * (least / b) + shrink)).astype(np.float32)


def toxic_evidence(models: dict[str, np.ndarray]) -> np.ndarray:
    """ln of the shares of good and toxic documents with a word; 0 for words in no toxic document or for good text."""
    good, toxic = models["sizes"][:2]
    if not good or not toxic:
        return np.zeros(BUCKETS, np.float32)
    ratio = np.log((models["good_bare"] + 0.5) / (good + 1.0)) - np.log((models["toxic_bare"] + 0.5) / (toxic + 1.0))
    return np.where(models["toxic_bare"] > 0, np.minimum(ratio, 0.0), 0.0).astype(np.float32)


def two_least(doc: np.ndarray, bucket: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Sum of the two least values of distinct buckets of each of ``n`` documents; those over zero say nothing."""
    says = table[bucket] < 0
    once = np.unique(doc[says] * BUCKETS + bucket[says])
    doc, value = once // BUCKETS, table[once % BUCKETS]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.searchsorted(doc, np.arange(n))
    nth = np.arange(len(doc)) - first[doc]
    return np.bincount(doc[nth < 2], weights=value[nth < 2], minlength=n).astype(np.float64)  # of nothing it counts whole numbers


def score_documents(docs: DataFrame, models: dict[str, np.ndarray], ids: np.ndarray, kinds: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, log_ratio, n_grams, worst, kind) of each document; log_ratio is the sum over its n-grams."""
    tables = (evidence(models["good"], models["raw"], SHRINK), toxic_evidence(models))
    held = docs.sparkSession.sparkContext.broadcast((tables, ids, kinds))

    def run(batches):
        (both, bare_table), ids, kinds = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                bucket, doc, bare, bare_doc = _features(part.column("text"))
                ratio = np.bincount(doc, weights=both[bucket], minlength=n)
                worst = two_least(bare_doc, bare, bare_table, n)
                kind = _classes(ids, kinds, part.column("doc_id"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(ratio), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(worst), pa.array(kind.astype(np.int32))], ["doc_id", "text_hash", "log_ratio", "n_grams", "worst", "kind"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, log_ratio double, n_grams long, worst double, kind int")


def fit_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold of least weighted error on held-out scores, in the middle of the gap; -inf without both classes."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cut = np.concatenate([[values[0] - 1.0], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cut) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cut) / len(bad)
    at = int(np.argmin(GOOD_COST * lost + kept))
    return float(cut[at])


def fit_screen(good: np.ndarray, toxic: np.ndarray, alarms: float = FALSE_ALARMS) -> float:
    """The threshold under which most toxic held-out scores lie, with at most a share ``alarms`` of the good; of equals the lowest, -inf without both classes."""
    if not len(good) or not len(toxic):
        return -np.inf
    good, toxic = np.sort(good), np.sort(toxic)
    highest = good[int(alarms * len(good))]  # below it are no more than the share
    values = np.unique(np.concatenate([good, toxic]))
    values = values[values <= highest]
    caught = np.searchsorted(toxic, values)
    best = values[int(np.argmax(caught))]
    under = np.concatenate([good[good < best], toxic[toxic < best]])
    return float((under.max() + best) / 2) if len(under) else -np.inf


def _rank() -> Column:
    """What rows are drawn by, ties in the key included."""
    return F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text_hash")


def kth_rank(keys: DataFrame, k: int, few: int = 10_000):
    """The rank of the k-th largest row, by histograms of ever narrower ranges of keys; None if there are no k rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # rows over the range
    while k > 0 and low is not None:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / 1024
        edges = [low + i * width for i in range(1024)] + [high] if low + width > low else [low, high]
        bins = inside.groupBy((F.width_bucket("key", F.lit(low), F.lit(high), F.lit(1024)) if len(edges) > 2 else F.lit(1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        else:
            return None
        stuck = (b["least"], b["most"]) == (low, high)
        low, high = b["least"], b["most"]
        if b["n"] <= few or low == high or stuck:
            border = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select(_rank().alias("rank"))
            return border.orderBy(F.desc("rank")).limit(k - above).agg(F.min("rank")).first()[0]
    return None


def screen_toxic(scores: DataFrame, threshold: float) -> DataFrame:
    """``scores`` with ``toxic``: whether its words speak for toxic text more strongly than the threshold allows."""
    return scores.withColumn("toxic", F.col("worst") < F.lit(threshold))


def draw(weighted: DataFrame, k: int) -> DataFrame:
    """``weighted(doc_id, text_hash, key, toxic, ...)`` with ``kept``: the k largest keys of rows that are not toxic."""
    allowed = ~F.col("toxic")
    last = kth_rank(weighted.filter(allowed), k)
    if last is None:
        return weighted.withColumn("kept", allowed & F.lit(k > 0))
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    tie = (doc > last["doc_id"]) | (doc == last["doc_id"]) & (F.col("text_hash") >= last["text_hash"])
    return weighted.withColumn("kept", allowed & ((F.col("key") > last["key"]) | (F.col("key") == last["key"]) & tie))


def resample(docs: DataFrame, labels: DataFrame, k: int | str = POSITIVE, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, text_hash, log_ratio, n_grams, worst, toxic, log_weight, key, kept) of each of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids, kinds = label_sample(labels, label_rows)
    scores = written(score_documents(docs, count_models(docs, ids, kinds), ids, kinds), "scores")
    # a labelled doc_id may have many rows: its worst scores count, so the driver gets one row a label at most
    mean = F.col("log_ratio") / F.greatest("n_grams", F.lit(1))
    held_out = scores.filter("kind < 0").groupBy("doc_id", "kind").agg(F.min(mean).alias("mean"), F.min("worst").alias("worst")).select("kind", "mean", "worst").collect()
    kind, means, worst = (np.array([r[i] for r in held_out]) for i in range(3))
    offset = fit_threshold(means[kind == -_GOOD], means[kind == -_JUNK])
    offset = 0.0 if offset == -np.inf else offset
    judged = bool((kind == -_JUNK).any() and (kind == -_GOOD).any())
    uniform = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scores = screen_toxic(scores, fit_screen(worst[kind == -_GOOD], worst[kind == -_TOXIC]))
    weighted = scores.withColumn("log_weight", F.col("log_ratio") - F.col("n_grams") * F.lit(offset))
    weighted = written(weighted.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).drop("kind"), "keys")
    if k == POSITIVE:
        k = weighted.filter((F.col("log_weight") >= 0) & ~F.col("toxic")).count() if judged else weighted.filter(~F.col("toxic")).count()
    return draw(weighted, k)


def keep_good(docs: DataFrame, labels: DataFrame, k: int | str = POSITIVE) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    drawn = resample(docs, labels, k).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(drawn["_id"]) & (F.xxhash64(docs["text"]) == drawn["_hash"])
    return docs.join(drawn, same, "left_semi")
