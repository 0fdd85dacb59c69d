"""Corpus operators against brute force: small tables, edge cases, and the sf0.001 tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from oracles import same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, jaccard, linededup, lm, packing, pii, queries, repair, rules, topk, toxicity
from quire.llm.common import table
from quire.llm.encoding import ChunkEncoder

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(6000))
EDGE = [
    (1, "Some words.\nand a line, and more"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (5, LONG),
    (None, "no id here"),
    (6, "a"),
    (7, "a b c"),
    (8, "Été ÀÉ \x1c 中文 😀 <|endoftext|> don't  it's\r\nx"),
    (9, "aaaa" * 120 + " tail"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in EDGE], "doc_id long, text string, score string, word long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, word long")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().lower().split()


# ---- 1: personal data


PII = "Write Mr. John Smith or Mr. Smith, Mrs. Anna Smith, Mr. SMITH at A.Bc@Mail.org / a.bc@mail.org, call 988-555-2485 or +1 (988) 555-2485; ssn 123-45-6789; 4111 1111 1111 1111; Herr Пётр Иванов; password=abcd1234 from 10.0.0.1"


def luhn(n):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_pii_is_consistent(spark):
    out = pii.replace(spark.createDataFrame([(1, PII), (2, PII.replace("Write", "Ask"))], "doc_id long, text string"), "key", count="n").orderBy("doc_id").collect()
    t = out[0]["text"]
    assert out[0]["n"] == 13 and t.replace("Write", "Ask") == out[1]["text"]
    assert not re.search(r"John|Smith|SMITH|Anna|Mail|988|123-45|4111|Пётр|abcd1234|10\.0\.0\.1\b", t)
    a, b, c, d = re.search(r"Mr\. (\w+) (\w+) or Mr\. (\w+), Mrs\. \w+ (\w+)", t).groups()
    assert b == c == d and t.count(b.upper()) == 1
    x, y = re.search(r"at (\S+) / (\S+),", t).groups()
    assert x == y and x.endswith(".org")
    p, q = re.search(r"call ([\d-]+) or \+1 (\([\d]+\) [\d-]+);", t).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q)
    card = re.search(r"; (4\d{3}(?: \d{4}){3});", t)[1]
    assert luhn(card.replace(" ", "")) and re.search(r"Herr [А-Я][а-я]+ [А-Я][а-я]+;", t)
    assert pii.replace(spark.createDataFrame([(1, PII)], "doc_id long, text string"), "other").first()["text"] != t


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    """With a tiny space of surrogates, distinct values still get distinct ones."""
    small = pii.surrogate

    def crowded(u):
        return F.when(u["attempt"] < 2, F.concat(F.lit("s"), F.pmod(F.crc32(u["value"].cast("binary")), F.lit(3)).cast("string"))).otherwise(small(u))

    monkeypatch.setattr(pii, "surrogate", crowded)
    text = " and ".join(f"u{i}@mail{i}.org" for i in range(20))
    out = pii.replace(spark.createDataFrame([(1, text), (2, text), (3, None), (4, "plain")], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    got = out[0]["text"].split(" and ")
    assert len(set(got)) == 20 and out[1]["text"] == out[0]["text"] and out[2]["text"] is None and out[3]["text"] == "plain"


def pii_of(spark, *texts, key="key"):
    return [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).orderBy("doc_id").collect()]


def test_pii_persons(spark):
    (t,) = pii_of(spark, "Mr. John Q. Smith met Dr. John Smith. Later Smith and SMITH saw John; Mrs. van Berg, MR. SMITH and Dr. J. Smith left Smithfield and Bergen.")
    got = re.fullmatch(r"Mr\. (\w+) (\w)\. (\w+) met Dr\. (\w+) (\w+)\. Later (\w+) and (\w+) saw (\w+); Mrs\. van (\w+), MR\. (\w+) and Dr\. (\w)\. (\w+) left Smithfield and Bergen\.", t)
    john, q, smith, john2, *rest = got.groups()
    assert john == john2 == rest[3] and q != "Q" and rest[6] != "J" and rest[4] not in ("Berg", smith)
    assert {rest[0], rest[1], rest[2], rest[5], rest[7]} == {smith, smith.upper()}


def test_pii_check_digits(spark):
    def mod97(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    wrong = "DE88370400440532013000 4111111111111112 2024 10 12 1234 5678 9012"
    a, b, c, d = pii_of(spark, "DE89370400440532013000", wrong, "fe80::1ff:fe23:4567:890a and 2001:DB8:0:0:8:800:200C:417A", "+491701234567 and 06 12 34 56 78 and 030 1234567")
    assert re.fullmatch(r"DE\d{20}", a) and a != "DE89370400440532013000" and mod97(a) == 1 and b == wrong
    assert re.fullmatch(r"[0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4} and [0-9A-F]{4}(:[0-9A-F]{1,4}){7}", c) and "fe80" not in c and "2001" not in c
    assert re.fullmatch(r"\+\d{12} and \d\d \d\d \d\d \d\d \d\d and \d{3} \d{7}", d) and not re.search("1701234567|12 34 56|1234567", d)


def test_pii_distinct_and_coreferent(spark):
    """Over many documents: one surrogate per unit, and no two units with one surrogate."""
    mails = [f"{a}{i}@x{i % 7}.org" for i in range(300) for a in ("p", "q")]
    texts = [" ".join(mails[i : i + 40]) for i in range(0, 600, 20)]
    seen = defaultdict(set)
    for before, after in zip(texts, pii_of(spark, *texts), strict=True):
        for x, y in zip(before.split(), after.split(), strict=True):
            seen[x].add(y)
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == 600


def test_pii_keeps_columns(spark):
    names = ["known", "sha", "hits", "new", "persons", "pattern", "ms", "found", "u", "Text_"]
    docs = spark.createDataFrame([(1, "Mr. John Smith", *names)], ["doc_id", "text", *names])
    out = pii.replace(docs, "key")
    assert out.columns == docs.columns and list(out.drop("doc_id", "text").first()) == names


def test_pii_edges(spark, edge, none):
    out = pii.replace(edge, "key", count="n")
    assert out.columns == [*edge.columns, "n"] and sorted(map(str, out.drop("n").collect())) == sorted(map(str, edge.collect()))
    assert pii.replace(none, "key").count() == 0


# ---- 2: language model


def test_lm_counts_and_base(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, SF).collect()}
    tok = lambda t: [*words(t), b"\n"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tok(t))
    n, v = sum(c.values()), len(c)
    base = score = 0.0
    for i, t in docs:
        r, ws = got[i], tok(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        if held[i]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def test_lm_is_normalised():
    head = [(f"w{i}".encode(), 50 - i) for i in range(30)] + [(lm.END, 20)]
    v = lm.Vocabulary(sorted(head, key=lambda x: -x[1]), sum(n for _, n in head) + 7, 35, 3)
    x, y, z = lm.Parameters.initial(v).tables()
    p = np.exp(x[:, None, :] + y[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(-1), 1)


def test_lm_edges(spark, edge, none):
    rows = lm.score(edge, edge).collect()
    assert len(rows) == len(EDGE) and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in rows)
    assert lm.score(none, none).count() == 0
    assert lm.score(edge, none).agg(F.sum("base_score")).first()[0] == 0


def test_spelling_is_normalised():
    ws = [b"aba", b"abba", "été".encode(), b"cab"]
    k, n = np.unique(lm.Spelling._triples(ws)[0], return_counts=True)
    m = lm.Spelling(k, n.astype(float))
    for before in (b"", b"a", b"ab", b"zz"):
        # The words that begin so, split by the next byte, have what all that begin so have.
        p = 10 ** m.log10([before + bytes([x]) for x in range(256) if x != 10])
        ends = 10 ** m.log10([before + bytes([x]) + b"a" for x in range(256) if x != 10])
        assert p.sum() + ends.sum() < 1
    for a, b in ((256, 256), (256, 97), (97, 98), (122, 122)):
        t = (a * 257 + b) * 257 + np.arange(257)
        at = np.minimum(np.searchsorted(m.triples, t), len(m.triples) - 1)
        own = np.where(m.triples[at] == t, m.own[at], 0.0)
        assert np.isclose((own + m.back[t // 257] * m.two.ravel()[t % 257**2]).sum(), 1)


def test_lm_unseen_words_share_their_mass(spark):
    texts = ["the cat sat", "the dog sat", "the cow ran"] * 3 + [" ".join(f"w{i}" for i in range(1500))]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = ["w1499", "zzqx", "zzqxzzqx", "q", "é"]
    got = {r["doc_id"]: r["text_score"] for r in lm.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), training).collect()}
    # Each is one word of the rest class; only the first was seen, once.
    assert all(got[i] < got[0] for i in range(1, 5)) and got[2] < got[1]


# ---- 3: BPE


def test_bpe_is_tiktoken(spark, edge, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(t):
        ids = e.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = bpe.digests(bpe.encode(edge, path, P.PATTERN)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *expected(t)) for i, t in EDGE)
    assert bpe.digests(bpe.encode(none, path, P.PATTERN)).count() == 0
    own = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op3_bpe(spark, SF).collect())) == sorted((i, *expected(t)) for i, t in own)


# ---- 4 and 7: token ids


@pytest.mark.parametrize(("name", "byte_level"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_join_to_the_ids_of_texts(name, byte_level):
    g = np.random.default_rng(3)
    bits = ["the", "Word", "x", "été", "ÀB", "Σ", "don't", "'s", "42", "_", "...", ".", ",", "!", "&&&", "́", "中文", "\x1c", "\xa0", "\x01", "😀", "<|endoftext|>", " ", " ", "\n", "\t", "\r\n", "  ", "-"]
    texts = ["".join(g.choice(bits, g.integers(0, 14))) for _ in range(3000)] + [t for _, t in EDGE]
    enc = ChunkEncoder(P.path(name), byte_level)
    real = enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [r.ids for r in real]


def test_repair_round_trip():
    g = np.random.default_rng(5)
    for ids in (np.zeros(0, np.int64), np.array([7]), np.full(5001, 9), g.integers(0, 9, 20_000), np.tile(g.integers(0, 400, 300), 40)):
        rules_, lengths, symbols = repair.compress(ids, 49408)
        assert (repair.expand(symbols, rules_, 49408) == ids).all() and (len(ids) < 5001 or len(symbols) < len(ids))
        for i, n in enumerate(lengths):
            assert len(repair.expand(np.array([49408 + i], np.uint16), rules_, 49408)) == n
    parts = [g.integers(0, 20, n).astype("<u2") for n in (5, 0, 3000, 1, 800)]
    b = repair.Block(repair.pack_block([1, None, 3, 3, 9], [p.tobytes() for p in parts], 49408))
    assert b.doc_ids == [1, None, 3, 3, 9] and all((b.document(k) == p).all() for k, p in enumerate(parts))


def test_repair_output(spark, edge, none):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(repair.read(repair.write(edge, P.path("word_bpe_49k.json"), 49408)).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, text) in zip(got, sorted(EDGE, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert repair.read(repair.write(none, P.path("word_bpe_49k.json"), 49408)).count() == 0


def test_packing(spark, edge, none, docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op7_packing(spark, SF).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in docs:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(packing.encode(edge, P.path("byte_bpe_50k.json"))).select("doc_id").distinct().count() == 10
    assert packing.pack(packing.encode(none, P.path("byte_bpe_50k.json"))).count() == 0


def test_packing_prefers_neighbours():
    g = np.random.default_rng(1)
    docs = [g.integers(100 * (k % 3), 100 * (k % 3) + 100, 300) for k in range(12)]
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=1 << 16)
    idx = packing.Index(docs, np.log(1 + (12 - df + 0.5) / (df + 0.5)), 300)
    assert all({int(d) % 3 for d in np.argsort(-idx.scores(k), kind="stable")[:4]} == {k % 3} for k in range(12))
    first = packing.fill([300] * 12, idx)[0]
    assert {d % 3 for d, _, _ in first} == {0} and sum(n for _, _, n in first) == 1024


# ---- 5: lines


def brute_lines(rows, least=linededup.MIN_WORDS):
    seq = {k: [(i, x, len(x.encode().split())) for i, x in enumerate((t or "").split("\n")) if x.encode().split()] for k, (_, t) in enumerate(rows)}
    seen, cut = defaultdict(list), defaultdict(set)
    for k in seq:
        s = seq[k]
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += s[b][2]
                if n >= least:
                    seen[tuple(x[1] for x in s[a : b + 1])].append((k, a, b))
    for places in seen.values():
        for k, a, b in sorted(places)[1:]:
            cut[k] |= set(range(seq[k][a][0], seq[k][b][0] + 1))
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[k]), len(cut[k])) for k, (i, t) in enumerate(rows)]


def test_line_dedup(spark, edge, none):
    part = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    a, b, c, d = part(1, 30), part(2, 30), part(3, 30), part(4, 10)
    rows = [(1, f"x\n{a}\n{b}\n\n{c}\n{d}\nq"), (2, f"{a}\n{b}\n{c}\n{d}"), (3, f"{a}\nnew\n{b}"), (4, f"{c}\n\n{d}\ny"), (5, part(5, 60)), (6, f"z\n{part(5, 60)}\n{part(5, 60)}"), (7, part(6, 49)), (8, part(6, 49)), (9, None), (10, "")]
    out = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), deleted="n").orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == brute_lines(rows)
    assert sum(r["n"] for r in out) == 6
    got = linededup.dedup(edge)
    assert got.columns == edge.columns and got.count() == len(EDGE) and linededup.dedup(none).count() == 0


def test_line_dedup_keeps_columns(spark):
    names = ["_row", "row", "cut", "j", "i", "w", "r", "h1"]
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{line}", *names), (2, f"{line}\nb", *names)], ["doc_id", "text", *names])
    out = linededup.dedup(docs, deleted="n").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [f"a\n{line}", "b"] and list(out[1])[2:-1] == names and out[1]["n"] == 1


def test_line_dedup_over_documents(spark, docs):
    rows = sorted(docs)
    out = queries.op5_line_dedup(spark, SF).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["deleted_lines"]) for r in out] == brute_lines(rows)


# ---- 6: toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, sf)
    y = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    n = {(r["t"], r["p"]): r["count"] for r in got.where("held_out").join(y, "doc_id").groupBy(F.col("toxic").alias("t"), F.col("predicted").alias("p")).count().collect()}
    assert n[1, 1] > n.get((1, 0), 0) and n.get((0, 1), 0) < 0.05 * n[0, 0]
    assert got.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0


def test_counterfactuals_pull_swapped_terms_together():
    x, y = [[0], [0], [1], [0, 2], [1, 2]] * 20, np.array([1, 1, 0, 1, 0] * 20, float)
    swapped = [[1 - i if i < 2 else i for i in r] for r in x]
    free = toxicity.fit_weights(x, swapped, y, np.ones(100), 3, counterfactual=0.0)[0]
    held = toxicity.fit_weights(x, swapped, y, np.ones(100), 3, counterfactual=50.0)[0]
    assert abs(held[0] - held[1]) < 0.1 * abs(free[0] - free[1])


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    m = toxicity.train(edge, labels)
    out = toxicity.score(edge, m, "score")
    assert out.count() == len(EDGE) and out.where("score is null").count() == 0 and out.columns == ["doc_id", "text", "word", "score"]
    assert toxicity.train(none, labels).bias is None
    assert toxicity.reject(none, m).count() == 0 and toxicity.reject(edge, toxicity.Model()).count() == len(EDGE)


# ---- 8: rules


def test_rules_sql(spark):
    same_rows(spark, queries.op8_quality_rules, queries.ORACLES["op8_quality_rules"], SF)


def test_rules_edges(spark, edge, none):
    many = " ".join(f"a{i % 60} b{i % 60} c{i % 60}" for i in range(400))
    rows = spark.createDataFrame([*EDGE, (20, many), (21, "x y z x y z"), (22, "#### $$$ a")], "doc_id long, text string")
    for r in rules.measurements(rows, keep=("doc_id", "text")).collect():
        w = (r["text"] or "").encode().split()
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {k for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(rep))
    led = rules.ledger(rows)
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rules.ablations(led, "v1").collect()}
    bits = [r["failed"] & rules.mask("v1") for r in led.collect()]
    assert got == {n: (sum(b >> rules.RULES[n][0] & 1 for b in bits), sum(b == 1 << rules.RULES[n][0] for b in bits)) for n in rules.POLICIES["v1"]}
    assert rules.ledger(none).count() == 0


# ---- 9: Jaccard join


def brute_groups(rows, k=4, percent=85):
    sets = [(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())) for i, w in ((i, words(t)) for i, t in rows)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    least = {c: min((sets[i][0] for i in range(len(sets)) if comp[i] == c and sets[i][0] is not None), default=None) for c in set(comp)}
    return sorted(map(str, ((i, len(s), least[c] if s else i) for (i, s), c in zip(sets, comp, strict=True))))


def test_jaccard(spark, none):
    g = np.random.default_rng(2)
    base = [f"w{x}" for x in g.integers(0, 10**6, 120)]
    near = []
    for k in range(90):  # a chain: each differs from the one before in a few places
        base = [*base]
        base[(7 * k) % 120] = f"n{k}"
        near.append((100 + k, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(40))
    shared = [(300 + k, passage + " " + " ".join(f"s{k}x{i}" for i in range(30))) for k in range(80)]
    rows = [*EDGE, *near, *near[:3], *shared]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(rows)
    assert jaccard.groups(none).count() == 0


def test_jaccard_over_documents(spark, docs):
    assert sorted(str(tuple(r)) for r in queries.op9_jaccard_join(spark, SF).collect()) == brute_groups(docs)


def test_jaccard_near_copies_of_one_text(spark, monkeypatch):
    """A long list in blocks: copies that link with the text they were made from, and some only with one another."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    g = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(120):
        t = list(base)
        for i in g.choice(150, g.integers(1, 9), replace=False):
            t[i] = f"x{i}y{g.integers(0, 3)}"
        rows.append((k + 1, " ".join(t)))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(rows)


def test_parities_bound_the_overlap():
    g = np.random.default_rng(9)
    pruned = 0
    for n in (1, 5, 63, 64, 65, 200, 700):
        for _ in range(40):
            x = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
            y = np.unique(np.concatenate([g.choice(x, g.integers(0, len(x) + 1), replace=False), g.integers(0, 2**63, g.integers(0, n // 3 + 2)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            may = jaccard.may_link(len(x), jaccard.parities(x), len(y), jaccard.parities(y), 85)
            assert may or 100 * both < 85 * (len(x) + len(y) - both)
            pruned += not may
    assert pruned > 150


def test_jaccard_moves_few_sets(spark, monkeypatch):
    """Texts that share a passage but don't link: hardly a pair of them is left for whole sets to meet."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"s{k}x{i}" for i in range(40))) for k in range(25)] + [(90, passage), (91, passage + " end")]
    met, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "FREQUENT", 0)

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "_verify", counted)
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(rows)
    assert sum(met) <= 4


def test_t_occurrences():
    g = np.random.default_rng(8)
    for _ in range(30):
        pool = [np.unique(g.integers(0, 300, 40)) for _ in range(6)]
        sets = [np.unique(np.concatenate([g.choice(p, g.integers(28, len(p)), replace=False), g.integers(300, 900, g.integers(0, 6))])).astype(np.uint64) for p in pool for _ in range(8)]
        link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        comp = np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                if comp[a] != comp[b] and link(sets[a], sets[b]):
                    comp[comp == comp[a]] = comp[b]
        got = np.arange(len(sets))
        for a, b in jaccard.t_occurrences(sets, np.arange(len(sets)), 80):
            assert link(sets[a], sets[b])
            got[got == got[a]] = got[b]
        assert len(set(zip(comp.tolist(), got.tolist()))) == len(set(comp)) == len(set(got))


# ---- 10: top k


def test_topk_sql(spark):
    same_rows(spark, queries.op10_topk, queries.ORACLES["op10_topk"], SF)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.0, -1.0]), (8, [])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(v.where("id % 20 = 0"), v, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 0), (20, 1, 0, 0), (20, 2, 0, 0), (20, 3, 1, 0)]
    assert topk.top_k(v.limit(0), v, 3).count() == 0


def test_topk_search_is_exact():
    g = np.random.default_rng(4)
    c = np.floor(64 * np.concatenate([g.normal(0, 0.1, (700, 8)), np.tile(g.normal(0, 0.1, (1, 8)), (300, 1))]))
    ids = g.permutation(1000)
    large = g.integers(10**5, 10**6, (1000, 8)) * 64
    huge = g.integers(-(10**7), 10**7, (1000, 8)) * 64
    for c in (c.astype(np.int64), large, huge):
        i, j, s = topk.search(ids[:200], c[:200], ids, c, 20)
        for q in range(0, 200, 7):
            real = sorted((-sum(int(a) * int(b) for a, b in zip(c[q], c[k], strict=True)), int(ids[k])) for k in range(1000) if k != q)[:20]
            assert sorted((-int(x), int(ids[y])) for x, y in zip(s[i == q], j[i == q], strict=True)) == real
