"""Toxicity: a linear classifier regularised by counterfactuals.

Features are words and word beginnings. All labelled rows are counted to choose features by their
association with the label; the weights are fitted with numpy on a bounded sample of labelled rows.
In every sampled sentence identity terms are swapped for their counterparts, and the squared change
of the score is a penalty, so that neutral mentions of a group don't move the score.

Defined results: null and empty texts score by the bias alone; without labelled rows of both kinds
every score is 0; a label other than 0 or 1 is ignored; with repeated or contradicting labels of an
id the largest counts; a null id joins no label; repeated documents are scored each; other columns
of the documents are kept by ``reject`` and ``score`` as asked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, dropped, frees, unused, written

#: Pairs of identity terms that are swapped for one another.
IDENTITY_PAIRS = [
    ("he", "she"), ("him", "her"), ("his", "hers"), ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"),
    ("male", "female"), ("father", "mother"), ("son", "daughter"), ("brother", "sister"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("black", "white"), ("african", "european"), ("asian", "american"), ("mexican", "canadian"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("islam", "christianity"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("old", "young"), ("deaf", "hearing"), ("blind", "sighted"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("homme", "femme"), ("hommes", "femmes"), ("mann", "frau"), ("männer", "frauen"),
]
SWAP = {a: b for p in IDENTITY_PAIRS for a, b in (p, p[::-1])}
STRIP = ".,;:!?\"'()[]{}|*«»“”„…-"
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

#: About so many labelled rows of each label are fitted, drawn with the probability that makes this their expected number.
SAMPLE_PER_LABEL = 20_000
#: At most so many features; each needs MIN_POSITIVE toxic rows that hold it.
N_FEATURES, MIN_POSITIVE, MIN_LOG_ODDS = 2048, 4, 1.0
#: Label counts up to this are sent to every task (16 bytes a row); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def terms(word: str) -> tuple[str, ...]:
    """The features of one raw word: the word without outer marks, and its beginnings."""
    w = word.strip(STRIP)
    return (f"={w}", *(f"^{w[:n]}" for n in PREFIXES if len(w) >= n)) if w else ()


def raw_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Model:
    """weights by feature; bias is None where there was nothing to learn."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None

    def scorer(self):
        """text -> score; remembers up to 300,000 words."""
        seen: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            if self.bias is None:
                return 0.0
            hit: set[str] = set()
            for w in raw_words(text):
                f = seen.get(w)
                if f is None:
                    if len(seen) > 300_000:
                        seen.clear()
                    f = seen[w] = tuple(x for x in terms(w) if x in self.weights)
                if f:
                    hit.update(f)
            z = self.bias + sum(self.weights[x] for x in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents that have a usable label and whose crc32 modulo 4 isn't 2."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.where(crc_mod(F.col("doc_id"), 4) != 2)
    x = docs.select("doc_id", "text").where(crc_mod(F.col("doc_id"), 4) != 2)
    small = labels.count() <= BROADCAST_LABELS
    return x.join(F.broadcast(y) if small else y, "doc_id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature, by label; at most 400,000 features at a time."""
    n: tuple[Counter, Counter] = (Counter(), Counter())
    seen: dict[str, tuple[str, ...]] = {}

    def flush():
        keys = list(n[1].keys() | n[0].keys())
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.record_batch({"feature": pa.array(k, pa.string()), "neg": pa.array([n[0][x] for x in k], pa.int64()), "pos": pa.array([n[1][x] for x in k], pa.int64())})
        n[0].clear()
        n[1].clear()

    for b in batches:
        for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            hit: set[str] = {""}  # counts the rows themselves
            for w in raw_words(text.as_py()):
                f = seen.get(w)
                if f is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    f = seen[w] = terms(w)
                hit.update(f)
            n[y].update(hit)
            if len(n[0]) + len(n[1]) > 400_000:
                yield from flush()
    yield from flush()


def _features(rows: DataFrame) -> tuple[list[str], int, int]:
    """The chosen features, and the numbers of clean and of toxic rows. What reaches the driver is bounded by N_FEATURES."""
    counts = rows.select("text", "toxic").mapInArrow(frees(_count), "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = written(counts.where(f"pos >= {MIN_POSITIVE} or feature = ''"), "features")
    total = counts.where("feature = ''").select("neg", "pos").first()
    if not total or not total["neg"] or not total["pos"]:
        return [], total["neg"] if total else 0, total["pos"] if total else 0
    n0, n1 = total["neg"], total["pos"]
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("neg") + 0.5) / (n0 + 1.0))
    best = counts.where("feature <> ''").withColumn("lo", odds).where(f"lo >= {MIN_LOG_ODDS}").orderBy((F.col("pos") * F.col("lo")).desc(), "feature").limit(N_FEATURES)
    out = [r["feature"] for r in best.select("feature").collect()]
    dropped(counts)
    return out, n0, n1


def _sparse(names: list[str]):
    index = {f: i for i, f in enumerate(names)}

    def ids(words: set[str]) -> list[int]:
        return sorted({index[f] for w in words for f in terms(w) if f in index})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [raw_words(t) for t in b.column("text").to_pylist()]
            swapped = [{SWAP.get(w.strip(STRIP), w) for w in x} for x in ws]
            yield pa.record_batch({"toxic": b.column("toxic"), "ids": pa.array([ids(x) for x in ws], pa.list_(pa.int32())), "swapped": pa.array([ids(x) for x in swapped], pa.list_(pa.int32()))})

    return rows


def fit_weights(x: list[list[int]], swapped: list[list[int]], y: np.ndarray, weight: np.ndarray, n: int, ridge: float = 1e-4, counterfactual: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Minimises the weighted log loss + ridge |w|^2 + counterfactual * mean (score change under the swap)^2, by Adam on full batches."""
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int64))
    (r, c), m = flat(x), len(x)
    changed = [i for i in range(m) if x[i] != swapped[i]]
    (ra, ca), (rb, cb) = flat([x[i] for i in changed]), flat([swapped[i] for i in changed])
    w, b = np.zeros(n), 0.0
    mom, var = np.zeros(n + 1), np.zeros(n + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], m) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(np.bincount(c, g[r], n) + 2 * ridge * w, g.sum())
        if changed:
            d = np.bincount(ra, w[ca], len(changed)) - np.bincount(rb, w[cb], len(changed))
            k = 2 * counterfactual * d / len(changed)
            grad[:n] += np.bincount(ca, k[ra], n) - np.bincount(cb, k[rb], n)
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        step = 0.1 * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels)
    names, n0, n1 = _features(rows)
    if not n0 or not n1:
        return Model()
    names = sorted(set(names) | {f"={w}" for w in SWAP})
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_LABEL / n1)).otherwise(min(1.0, SAMPLE_PER_LABEL / n0))
    # Which rows are taken follows from what they hold, not from how files lie.
    drawn = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) / (1 << 30)
    data = rows.where(drawn < share).select("text", "toxic").mapInArrow(frees(_sparse(names)), "toxic int, ids array<int>, swapped array<int>").toArrow()
    y = np.array(data["toxic"], float)
    k = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, n1 / max(k[1], 1), n0 / max(k[0], 1))
    w, b = fit_weights(data["ids"].to_pylist(), data["swapped"].to_pylist(), y, weight, len(names))
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-9}, b)


def score(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default) with the score in [0, 1] of each whole text. A kept column of the same name goes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            out = pa.array([s(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), out], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(frees(rows), schema)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns, whatever their names."""
    (name,) = unused(docs, "toxicity")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)
