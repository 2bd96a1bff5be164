"""Operator 3: quality classifier by hierarchical empirical Bayes.

Document evidence: two logistic models (low quality; toxic) over hashed words, their beginnings and a few bins of text statistics, fitted
on a bounded sample of labelled documents and applied to all. A model's log odds less those of its training prior are a
document's log likelihood ratio. Site evidence: over all documents, expected bad counts are grouped by path (source and
language) and by host (source); a host's rate is shrunk towards the global one, a path's towards its host's, each by a
prior strength that method of moments gives from how much the rates differ beyond chance, so sparse sites lean on their
prior. A document's posterior has its path's rate as prior odds and its own evidence as likelihood ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, in_arrow, quoted, ranges, slices

HEADS = ("low", "toxic")
#: The fit's bound: at most so many labelled documents, those with the smallest hashes of their ids.
FIT_ROWS = 8000
#: Paths whose rates are told to all executors at once; more are joined by shuffle, a path's documents over SALTS tasks.
TOLD_SITES, SALTS = 100_000, 16
BITS = 18
SLICE_BYTES = 4 << 20
N_BINS = 64
STEMS = (5, 6, 7)
RESULTS = ("low_rate", "toxic_rate", "p_low", "p_toxic", "reject")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def featurize(texts: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts on end (distinct and sorted in each), and how many each has.

    Features are the words present and their beginnings of STEMS bytes, lower-cased, without the outer four marks a side
    and hashed to BITS bits (by the first and last eight bytes and the length), then bins of text statistics from 2**BITS
    on, nine levels each. All of a text counts. keep: only features whose flag is set.
    """
    cased = b" ".join([b" " * 8, *texts, b" " * 8])
    raw = cased.lower()
    data = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_starts = 9 + np.cumsum(sizes + 1) - sizes - 1
    inside = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    doc = np.searchsorted(text_starts, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    for _ in range(4):  # marks around the word
        starts = starts + (_EDGE[data[starts]] & (ends - starts > 1))
        ends = ends - (_EDGE[data[ends - 1]] & (ends - starts > 1))
    eights = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    length = ends - starts
    front = eights[starts]
    head = front & _KEEP[np.minimum(length, 8)]
    tail = np.where(length > 8, eights[np.maximum(ends - 8, 0)], np.uint64(0))
    whole = (head * _A) ^ (tail * _B) ^ length.astype(np.uint64)
    parts = []
    for salt, mixed in enumerate([whole, *((front & _KEEP[n]) * _B for n in STEMS)]):
        mixed = (mixed ^ (mixed >> np.uint64(32)) ^ np.uint64(salt << 40)) * _A
        number = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        has = np.ones(len(number), dtype=bool) if not salt else length >= STEMS[salt - 1]
        if keep is not None:
            has &= keep[number]
        parts.append(doc[has] << 32 | number[has])
    repeats = np.zeros(len(starts), dtype=bool)
    repeats[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    inner = lambda flags: (lambda c: c[text_starts + sizes] - c[text_starts])(upto(flags))
    at_least, some_words = np.maximum(sizes, 1), np.maximum(n_words, 1)
    ratios = [inner(_SYMBOL[data]) / at_least * 60, inner(_UPPER[np.frombuffer(cased, dtype=np.uint8)]) / at_least * 15, np.bincount(doc, weights=repeats, minlength=len(texts)) / some_words * 15, inner(_DIGIT[data]) / at_least * 30, np.log2(n_words + 1) / 1.6]
    for k, r in enumerate(ratios):  # level r has the features of all levels below too
        levels = np.minimum(np.ceil(r).astype(np.int64), 9)
        parts.append(np.repeat(np.arange(len(texts)), levels) << 32 | (ranges(np.zeros(len(texts), dtype=np.int64), levels) + 10 * k + (1 << BITS)))
    keys = np.unique(np.concatenate(parts))
    return keys & 0xFFFFFFFF, np.bincount(keys >> 32, minlength=len(texts))


def telling(flat: np.ndarray, row: np.ndarray, labels: np.ndarray, most: int = 4096, least: int = 4, evidence: float = 14.0) -> np.ndarray:
    """The words whose presence raises the label's odds: likelihood ratio statistic over `evidence`, the `most` strongest; all bins.

    Words that lower them are left out: a long document has many, which would outweigh what is wrong with it.
    """
    size = (1 << BITS) + N_BINS
    n, bad = max(1, len(labels)), max(1e-9, float(labels.sum()))
    df = np.bincount(flat, minlength=size).astype(np.float64)
    hit = np.bincount(flat, weights=labels[row], minlength=size)
    score = np.zeros(size)
    for seen, expected in ((hit, df * bad / n), (df - hit, df * (n - bad) / n), (bad - hit, (n - df) * bad / n), (n - bad - (df - hit), (n - df) * (n - bad) / n)):
        score += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    score[(df < least) | (hit * n <= df * bad)] = 0
    score[score < evidence] = 0
    chosen = np.argsort(-score, kind="stable")[:most]
    out = np.zeros(size, dtype=bool)
    out[chosen[score[chosen] > 0]] = True
    out[1 << BITS :] = True
    return out


def fit_logistic(features: list[np.ndarray], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive full-batch gradient steps over the telling features; the others' weights are zero."""
    size = (1 << BITS) + N_BINS
    sizes = np.array([len(x) for x in features], dtype=np.int64)
    flat = np.concatenate(features) if features else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(features)), sizes)
    kept = telling(flat, row, labels)[flat]
    flat, row = flat[kept], row[kept]
    used, flat = np.unique(flat, return_inverse=True)
    w, s = np.zeros(len(used)), np.full(len(used), 1e-8)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, s0 = np.log(prior / (1 - prior)), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(row, weights=w[flat], minlength=len(features))
        error = (labels - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / max(1, len(labels))
        g = np.bincount(flat, weights=error[row], minlength=len(used)) - decay * w
        s += g * g
        w += rate * g / np.sqrt(s)
        s0 += error.sum() ** 2
        bias += rate * error.sum() / np.sqrt(s0)
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w
    return weights, float(bias)


class Model:
    """Two logistic heads with their training priors' log odds."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray):
        self.heads = []
        for k in range(len(HEADS)):
            known = np.flatnonzero(labels[:, k] >= 0)
            y = labels[known, k].astype(np.float64)
            weights, bias = fit_logistic([features[i] for i in known.tolist()], y)
            prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
            self.heads.append((weights, bias, float(np.log(prior / (1 - prior))) if len(y) else bias))
        self.keep = np.any([weights != 0 for weights, _, _ in self.heads], axis=0)

    def evidence(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each head's log likelihood ratios."""
        flat, sizes = featurize(texts, self.keep)
        row = np.repeat(np.arange(len(texts)), sizes)
        return [bias - prior + np.bincount(row, weights=weights[flat], minlength=len(texts)) for weights, bias, prior in self.heads]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most `rows` labelled documents (doc_id, text) and labels (doc_id, quality, toxic).

    Null labels are left out head by head; without any labels the evidence is nil and nothing is rejected. Of documents
    with one id the one with the smallest features counts.
    """
    sample = labels.select("doc_id", "quality", "toxic").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, sizes = featurize([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            parts = np.split(flat.astype(np.uint32), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in parts], pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "features", "quality", "toxic"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    featured = joined.mapInArrow(run, "doc_id long, features binary, quality int, toxic int")
    one = featured.groupBy("doc_id", "quality", "toxic").agg(F.min("features").alias("features"))  # so no more than `rows` come
    none = lambda x: -1 if x is None else x
    got = sorted(one.collect(), key=lambda r: (r["doc_id"], none(r["quality"]), none(r["toxic"])))
    features = [np.frombuffer(r["features"], dtype=np.uint32).astype(np.int64) for r in got]
    marks = np.array([[-1 if r["quality"] is None else int(r["quality"] == 0), -1 if r["toxic"] is None else int(r["toxic"] == 1)] for r in got]).reshape(-1, 2)
    return Model(features, marks)


def with_evidence(docs: DataFrame, model: Model, names: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and, by the two names, the heads' log likelihood ratios of text (0 for a null or empty text)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight tables of 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            at = batch.schema.get_field_index
            texts = [x or b"" for x in batch.column(at("text")).cast(pa.binary()).to_pylist()]
            empty = np.array([not x for x in texts])
            new = [pa.array(np.where(empty, 0.0, e)) for e in shared.value.evidence(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), *new], names=[*keep, *names])

    needed = list(dict.fromkeys([*keep, "text"]))
    return in_arrow(docs.select(*(F.col(quoted(c)) for c in needed)), run, schema)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def site_rates(evidence: DataFrame, names: list[str], priors: list[float]) -> DataFrame:
    """source, lang, low_rate, toxic_rate: posterior rates of each path, from evidence(source, lang and the two names).

    priors: the log odds, by head, at which the evidence is turned into expected counts.
    """
    sums = [F.sum(_sigmoid(F.col(name) + prior)).alias(f"{h}_sum") for h, name, prior in zip(HEADS, names, priors, strict=True)]
    paths = durable(evidence.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), *(F.sum(f"{h}_sum").alias(f"{h}_host") for h in HEADS))
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"{h}_host").alias(h) for h in HEADS)).first()
    n = total["n"] or 0
    rates = {h: min(max((total[h] or 0.0) / n, 1e-4), 1 - 1e-4) if n else 0.5 for h in HEADS}

    def strength(df: DataFrame, bad: str, count: str, mean: Column) -> float:
        """Beta prior strength by method of moments: within-chance variance over what the rates vary beyond it."""
        r = F.col(bad) / F.col(count)
        s = df.agg(F.sum(count).alias("n"), F.sum(F.col(count) * (r - mean) ** 2).alias("q"), F.sum(mean * (1 - mean)).alias("v"), F.count(F.lit(1)).alias("k"), F.sum(F.col(count) * mean * (1 - mean)).alias("w")).first()
        if not s["n"] or s["k"] < 2:
            return 100.0
        beyond = max((s["q"] - s["v"]) / s["n"], 1e-9)
        return float(min(max(s["w"] / s["n"] / beyond - 1, 1.0), 1e6))

    for h in HEADS:
        m = strength(hosts, f"{h}_host", "host_n", F.lit(rates[h]))
        hosts = hosts.withColumn(f"{h}_host_rate", (F.col(f"{h}_host") + m * rates[h]) / (F.col("host_n") + m))
    both = paths.join(hosts, paths["source"].eqNullSafe(hosts["source"])).drop(hosts["source"])
    for h in HEADS:
        m = strength(both, f"{h}_sum", "n", F.col(f"{h}_host_rate"))
        both = both.withColumn(f"{h}_rate", F.least(F.greatest((F.col(f"{h}_sum") + m * F.col(f"{h}_host_rate")) / (F.col("n") + m), F.lit(1e-4)), F.lit(1 - 1e-4)))
    return durable(both.select("source", "lang", "low_rate", "toxic_rate"))


def classified(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, cut: float = 0.5, keep: list[str] | None = None, told_sites: int = TOLD_SITES) -> DataFrame:
    """docs (only its columns in keep, if given) with low_rate, toxic_rate, p_low, p_toxic, reject (either posterior over cut).

    docs has doc_id, text, source, lang and any others; each row is judged by itself, a null or empty text by its
    site alone. Null sources and languages are sites of their own. No labels: no evidence. No rows: no rows. An input
    column that bears a result's name is replaced.
    """
    docs = docs.drop(*RESULTS)
    kept = list(docs.columns if keep is None else [c for c in keep if c not in RESULTS])
    model = fit(docs, labels, rows)
    names = fresh(docs, "low_evidence", "toxic_evidence")
    scored = durable(with_evidence(docs, model, names, list(dict.fromkeys([*kept, "source", "lang"]))))  # texts are read once
    source, lang, salt = fresh(docs, "site_source", "site_lang", "site_salt")
    sites = site_rates(scored, names, [prior for _, _, prior in model.heads]).select(F.col("source").alias(source), F.col("lang").alias(lang), "low_rate", "toxic_rate")
    same = F.col("source").eqNullSafe(F.col(source)) & F.col("lang").eqNullSafe(F.col(lang))
    if sites.count() <= told_sites:
        joined = scored.join(F.broadcast(sites), same, "left")
    else:
        mine, every = scored.withColumn(salt, F.spark_partition_id() % SALTS), sites.withColumn(salt + "_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = mine.join(every, same & (F.col(salt) == F.col(salt + "_")), "left")
    posteriors = [_sigmoid(_logit(F.col(f"{h}_rate")) + F.col(name)).alias(f"p_{h}") for h, name in zip(HEADS, names, strict=True)]
    out = joined.select(*(F.col(quoted(c)) for c in kept), "low_rate", "toxic_rate", *posteriors)
    return out.withColumn("reject", (F.col("p_low") > cut) | (F.col("p_toxic") > cut))
