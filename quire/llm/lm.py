"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts one of CLASSES word classes (the most frequent words, the end, and a class for
the rest) from the two classes before: score(w | a, b) = (A[a] + B[b]) . R[w] + bias[w]. Tasks train
copies of it in numpy on their own documents with shared noise samples; the copies are averaged,
weighted by tokens. The normaliser of every context pair is then exact and comes from one matrix
product, exp(A R') (exp(B R') exp(bias))', so that a token's log probability is a few table lookups.
A word of the rest class has the class's probability times its share of the class's training
tokens. As in base_score, all words never seen are one outcome of score, with the Good-Turing mass
of the class: score compares with base_score, but is no probability of the text. text_score is one:
there, words never seen share that mass by their spelling, a normalised model of bytes trained on
the distinct words, and none gets more than half of what a word seen once has.

Counts are of all training documents. Words above a count that at most HEAD words reach are sent to
every task; occurrences of the others meet their counts in a shuffle join on the word, where no
word is hot because the frequent ones never get there.

Defined results: a null text is an empty text, which is one end token; repeated rows are scored
each; a null id belongs to the training rows unless crc32 of the empty text says otherwise; without
training rows base scores are 0 a token; other columns are dropped.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

#: The end of a text. No word holds a line feed.
END = b"\n"
CLASSES, DIM, NOISE, BATCH = 1024, 20, 64, 8192
HEAD = 1 << 17
LOG_2 = float(np.log10(2))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case. bytes.split() parts at the six ASCII spaces."""
    return (text or b"").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n long) over all documents, ends included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush():
            keys = list(n)
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.record_batch({"word": pa.array(k, pa.binary()), "n": pa.array([n[x] for x in k], pa.int64())})
            n.clear()

        for b in batches:
            for t in b.column("text").to_pylist():
                n.update(tokens(t))
                n[END] += 1
                if len(n) > 1_000_000:
                    yield from flush()
        yield from flush()

    text = docs.select(F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The words above a count that at most ``most`` words reach, the most frequent first. The threshold comes from a histogram of a few hundred rows."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    left, low = most, None
    for r in sorted(counts.groupBy(level.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if r["count"] > left:
            break
        left, low = left - r["count"], r["b"]
    if low is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(level >= low).collect()), key=lambda x: (-x[1], x[0]))


def _bytes(words: list[bytes]) -> np.ndarray:
    """The bytes of all words, each word between ends; an end is 256."""
    x = np.frombuffer(END + END.join(words) + END, np.uint8).astype(np.int64)
    x[x == END[0]] = 256
    return x


class Spelling:
    """p(byte | the two before), interpolated with p(byte | the one before) and p(byte) in proportion to how often a context was seen; 256 begins and ends a word."""

    def __init__(self, triples: np.ndarray, n: np.ndarray):
        a, b, c = triples // 257**2, triples // 257 % 257, triples % 257
        one = np.bincount(c, n, 257) + 1.0
        two = np.bincount(b * 257 + c, n, 257**2).reshape(257, 257)
        two = (two + 20 * one / one.sum()) / (two.sum(1, keepdims=True) + 20)
        context, at = np.unique(a * 257 + b, return_inverse=True)
        seen = np.bincount(at, n, len(context))
        back = np.ones(257**2)
        back[context] = 20 / (seen + 20)
        by = np.argsort(triples)
        self.triples, self.back, self.two = triples[by], back, two
        self.own = (n / (seen[at] + 20))[by]

    @classmethod
    def of(cls, counts: DataFrame) -> Spelling:
        """Trained on every distinct word once: the forms that new words resemble."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for b in batches:
                if words := [w for w in b.column("word").to_pylist() if w != END]:
                    k, m = np.unique(cls._triples(words)[0], return_counts=True)
                    n.update(dict(zip(k.tolist(), m.tolist(), strict=True)))
            yield pa.record_batch({"k": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64())})

        got = counts.select("word").mapInArrow(rows, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        return cls(np.array(got["k"], np.int64), np.array(got["n"], float))

    @staticmethod
    def _triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The triples of all words, and where each word begins."""
        x = _bytes(words)
        a, b, c = np.append(256, x[:-2]), x[:-1], x[1:]
        a = np.where(b == 256, 256, a)
        starts = np.flatnonzero(b == 256)
        return (a * 257 + b) * 257 + c, starts

    def log10(self, words: list[bytes]) -> np.ndarray:
        """Of each word, which isn't empty, the log10 of its probability among all strings of bytes."""
        if not words:
            return np.zeros(0)
        k, starts = self._triples(words)
        at = np.minimum(np.searchsorted(self.triples, k), max(len(self.triples) - 1, 0))
        own = np.where(self.triples[at] == k, self.own[at], 0.0) if len(self.triples) else 0.0
        return np.add.reduceat(np.log10(own + self.back[k // 257] * self.two.ravel()[k % 257**2]), starts)


@dataclass
class Vocabulary:
    head: list[tuple[bytes, int]]
    n: int  # tokens in training
    v: int  # distinct tokens
    singles: int

    def __post_init__(self):
        self.classes = [w for w, _ in self.head if w != END][: CLASSES - 2]
        self.end, self.rest = len(self.classes), len(self.classes) + 1
        self.size = self.rest + 1
        n = dict(self.head)
        mass = np.array([*(n[w] for w in self.classes), n.get(END, 0)], float)
        self.n_rest = int(self.n - mass.sum())
        self.unigram = np.append(mass, self.n_rest) + 0.5
        self.unigram /= self.unigram.sum()
        self.unseen = (self.singles + 1) / (self.n_rest + self.singles + 2)

    def index(self) -> dict[bytes, int]:
        """word -> class; rest classes are left out."""
        return {w: i for i, w in enumerate(self.classes)}


@dataclass
class Parameters:
    a: np.ndarray  # of the last word
    b: np.ndarray  # of the word before
    r: np.ndarray  # of the predicted word
    bias: np.ndarray

    @classmethod
    def initial(cls, vocab: Vocabulary) -> Parameters:
        g = np.random.default_rng(7)
        x = lambda: g.normal(0, 0.1, (vocab.size, DIM))
        return cls(x(), x(), x(), np.log(vocab.unigram))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.a.ravel(), self.b.ravel(), self.r.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray, size: int) -> Parameters:
        k = size * DIM
        return cls(*(flat[i * k : (i + 1) * k].reshape(size, DIM) for i in range(3)), flat[3 * k :])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """log p(w | a, b) = x[a, w] + y[b, w] - log z[a, b], as (x, y, log z) with the bias in x."""
        x, y = self.a @ self.r.T + self.bias, self.b @ self.r.T
        mx, my = x.max(1, keepdims=True), y.max(1, keepdims=True)
        z = np.log(np.exp(x - mx) @ np.exp(y - my).T) + mx + my.T
        return x, y, z


def _scatter(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows of g."""
    by = np.argsort(ids, kind="stable")
    own, start = np.unique(ids[by], return_index=True)
    return own, np.add.reduceat(g[by], start, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; noise words are drawn once a batch and shared by its tokens."""

    def __init__(self, p: Parameters, vocab: Vocabulary, seed: int = 1, rate: float = 0.1):
        self.p, self.rate, self.g = p, rate, np.random.default_rng(seed)
        self.noise, self.log_noise = vocab.unigram, np.log(vocab.unigram * NOISE)
        self.cum = np.cumsum(vocab.unigram)
        self.acc = [np.full_like(x, 1e-8) for x in (p.a, p.b, p.r, p.bias)]

    def _step(self, k: int, ids: np.ndarray, grad: np.ndarray) -> None:
        own, g = _scatter(ids, grad)
        self.acc[k][own] += g * g
        (self.p.a, self.p.b, self.p.r, self.p.bias)[k][own] -= self.rate * g / np.sqrt(self.acc[k][own])

    def batch(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, len(w)
        noise = np.minimum(np.searchsorted(self.cum, self.g.random(NOISE)), len(self.cum) - 1)
        q, rw, rn = p.a[c1] + p.b[c2], p.r[w], p.r[noise]
        sig = lambda x: 1 / (1 + np.exp(-x))
        pos = (sig((q * rw).sum(1) + p.bias[w] - self.log_noise[w]) - 1) / n
        neg = sig(q @ rn.T + p.bias[noise] - self.log_noise[noise]) / n
        dq = pos[:, None] * rw + neg @ rn
        ids = np.concatenate([w, noise])
        self._step(2, ids, np.concatenate([pos[:, None] * q, neg.T @ q]))
        self._step(3, ids, np.concatenate([pos, neg.sum(0)]))
        self._step(0, c1, dq)
        self._step(1, c2, dq)


def _classes(texts: list[bytes | None], index: dict[bytes, int], vocab: Vocabulary) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text; of all tokens with their ends: class, the two classes before, and the place after each text."""
    rest, end, get = vocab.rest, vocab.end, index.get
    words = [tokens(t) for t in texts]
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    ids: list[int] = []
    for x in words:
        ids += [get(t, rest) for t in x]
        ids.append(end)
    w = np.array(ids, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    c1 = np.concatenate([[end], w[:-1]])
    c2 = np.concatenate([[end, end], w[:-2]])[: len(w)]
    if len(w):
        c1[starts] = end
        c2[starts] = end
        c2[starts[sizes > 1] + 1] = end
    return words, w, c1, c2, ends


def train(docs: DataFrame, vocab: Vocabulary) -> Parameters:
    """The average, weighted by tokens, of the copies that tasks train on their own documents, all documents once."""
    first = Parameters.initial(vocab)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters.of(first.flat().copy(), vocab.size)
        t, index, n, kept = Trainer(p, vocab), vocab.index(), 0, []
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 200):
                _, w, c1, c2, _ = _classes(texts[i : i + 200], index, vocab)
                n += len(w)
                kept.append(np.stack([c1, c2, w]))
                if sum(x.shape[1] for x in kept) < BATCH:
                    continue
                x = np.concatenate(kept, axis=1)
                for k in range(0, x.shape[1] - BATCH + 1, BATCH):
                    t.batch(*x[:, k : k + BATCH])
                kept = [x[:, x.shape[1] // BATCH * BATCH :]]
        if kept and (x := np.concatenate(kept, axis=1)).shape[1]:
            t.batch(*x)
        if n:
            v = p.flat()
            yield pa.record_batch({"i": pa.array(np.arange(len(v), dtype=np.int32)), "s": pa.array(v * n), "n": pa.array(np.full(len(v), float(n)))})

    text = docs.select(F.col("text").cast("binary").alias("text"))
    mean = text.mapInArrow(rows, "i int, s double, n double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("x"))
    flat = first.flat()
    got = mean.toArrow()
    flat[np.array(got["i"])] = np.array(got["x"])
    return Parameters.of(flat, vocab.size)


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score, text_score."""
    counts = written(count_words(training), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("s")).first()
    vocab = Vocabulary(head_words(counts), total["n"] or 0, total["v"], total["s"])
    p = train(training, vocab)
    floor = float(np.log10(vocab.n + vocab.v + 1))
    spelling = Spelling.of(counts)
    log_rest, log_unseen = float(np.log10((1 - vocab.unseen) / max(vocab.n_rest, 1))), float(np.log10(vocab.unseen))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, z = p.tables()
        index = vocab.index()
        base = {w: float(np.log10(c + 1)) - floor for w, c in vocab.head}
        # What a head word adds to the score beyond its class.
        more = {w: log_rest + float(np.log10(c)) for w, c in vocab.head if w not in index and w != END}
        for b in batches:
            ids, at, texts = b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                words, w, c1, c2, ends = _classes(texts[i : i + 500], index, vocab)
                lp = np.add.reduceat((x[c1, w] + y[c2, w] - z[c1, c2]) / np.log(10), np.append(0, ends[:-1]))
                out: list[tuple] = []
                for d, r, ws, s in zip(ids[i : i + 500], at[i : i + 500], words, lp.tolist(), strict=True):
                    n = Counter(ws)
                    n[END] += 1
                    known, bs = 0, 0.0
                    for t, k in n.items():
                        if t in base:
                            known, bs = known + k, bs + k * base[t]
                            s += k * more.get(t, 0.0)
                        else:
                            out.append((r, d, t, k, 0, 0.0, 0.0))
                    # A key that is no word and that no two rows share.
                    out.append((r, d, END + struct.pack("<q", r), known, known, bs, s))
                cols = [list(c) for c in zip(*out, strict=True)]
                # The spelling of the words that no task knows counts where the join finds them unseen.
                tail = [k for k, t in enumerate(cols[2]) if not t.startswith(END)]
                spelled = np.zeros(len(out))
                spelled[tail] = spelling.log10([cols[2][k] for k in tail])
                cols.append(spelled)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["row", "doc_id", "word", "n", "known", "base", "score", "spelled"])

    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = text.mapInArrow(rows, "row long, doc_id long, word binary, n long, known long, base double, score double, spelled double")
    tail = parts.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    own = F.length("word") > 0
    is_word = own & (F.substring(F.col("word"), 1, 1) != F.lit(END).cast("binary"))
    c = F.col("c")
    tail = tail.select(
        "row",
        "doc_id",
        "n",
        F.when(is_word, F.when(c.isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(is_word, F.col("n") * (F.log10(F.coalesce(c, F.lit(0)) + 1.0) - F.lit(floor))).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.col("n") * F.when(c.isNotNull(), F.lit(log_rest) + F.log10(c.cast("double"))).otherwise(F.lit(log_unseen))).otherwise(F.col("score")).alias("score"),
        # What a word adds beyond its part of score.
        F.when(is_word & c.isNull(), F.col("n") * (F.least(F.lit(log_unseen) + F.col("spelled"), F.lit(log_rest - LOG_2)) - F.lit(log_unseen))).otherwise(0.0).alias("more"),
    )
    out = tail.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("more").alias("more"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") + F.col("more")).alias("text_score"))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2
