"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, jaccard, linededup, lm, packing, pii, repair, rules, runs, shards, topk, toxicity
from .common import crc_mod, table, words

POLICY = "v1"
#: The Spark setting that holds the surrogates' key. What is set here for the test tables is no secret: a deployment sets its own.
PII_KEY_SETTING, DEMONSTRATION_KEY = "spark.quire.pii.key", "quire"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_SETTING, DEMONSTRATION_KEY)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), POLICY)
    base = F.col("failed").bitwiseAND(F.lit(rules.mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed")


_OP8 = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3) x),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from g) y where c > 1),
p as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) z group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 0) as ls from d),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
       cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
       cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
       cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
       cast(coalesce(p.n, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines
      from w join l on l.doc_id = w.doc_id left join p on p.doc_id = w.doc_id),
b as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
       + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 34 * n_lines then 8 else 0 end)
       + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
       + (case when n_words > 1000000 then 32 else 0 end) as f from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f & 3) <> 0 as base_failed, (f & 15) = 0 as kept,
 n_lines, cast(f as bigint) as failed from b
"""

def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), count="n_entities")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm.held_out(F.col("doc_id"))
    out = lm.score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "text_score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49408))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), deleted="deleted_lines")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)


_OP10 = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
 from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op11_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return shards.assign(rows, 24).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_OP11 = """
with d as (select doc_id, coalesce(text, '') as t from documents),
poly as (select list(list_reduce(range(0, 8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as tab from range(0, 256) r(b)),
c as (select doc_id, cast(strlen(t) + 8 as bigint) as size,
 cast(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast(('0x' || x) as bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as bigint) as text_crc32,
 cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 16)) as ubigint) as h from d, poly),
j as (select h, n, list_reduce(range(0, 64), lambda s, i: case when s.b >= n then s else
   {'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616, 'a': s.b,
    'b': cast(least(cast(n as double), floor((s.b + 1) * (cast(2147483648 as double) / (cast((((s.k * 2862933555777941757 + 1) % 18446744073709551616) >> 33) as double) + 1)))) as bigint)} end,
   {'k': cast(h as uhugeint), 'a': cast(-1 as bigint), 'b': cast(0 as bigint)}).a as s from (select distinct h from c) x, (select unnest([24, 25]) as n) y)
select doc_id, size, text_crc32, 'key' as law, cast(a.s as int) as shard,
 cast(row_number() over (partition by a.s order by doc_id, size, text_crc32) - 1 as bigint) as slot, cast(b.s as int) as grown_shard
from c join j a on a.h = c.h and a.n = 24 join j b on b.h = c.h and b.n = 25
"""


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = centroids.quantised(table(spark, sf_dir, "embeddings"), 64)
    return centroids.cluster(points, 16, 3).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12() -> str:
    near = "(select vec_id, rid, v, c, d from (select p.vec_id, p.rid, p.v, m.c, cast(list_sum(list_transform(list_zip(p.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from p, {m} m) x qualify row_number() over (partition by rid order by d, c) = 1)"
    step = """n{k} as materialized (select * from {near}),
u{k} as (select c, pos, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, 65)) as pos from n{k}) x group by c, pos),
m{k} as materialized (select m.c, coalesce(q.v, m.v) as v from m{j} m left join (select c, list(cast((s - ((s % n + n) % n)) // n as bigint) order by pos) as v from u{k} group by c) q on q.c = m.c)"""
    steps = ",\n".join(step.format(k=k, j=k - 1, near=near.format(m=f"m{k - 1}")) for k in (1, 2, 3))
    return f"""
with p as materialized (select vec_id, row_number() over () as rid, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
m0 as materialized (select cast(row_number() over (order by h, v) - 1 as int) as c, v from (select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h, v from p order by h, v limit 16) x),
{steps},
n4 as materialized (select * from {near.format(m="m3")})
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
 sha256(array_to_string(m3.v, ',')) as centroid_sha256 from n4 join m3 using (c)
"""


def planted(text: Column, doc_id: Column) -> Column:
    """The text, of one in ten documents with the words from one place on repeating a period; both follow from the id."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    found = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, found[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find(docs, keep=["doc_id"])
    # Of two runs the one with the greater length/period, compared by products; of equal ones the first stands first already.
    greater = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, x: F.when(greater(a, x), x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("r"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_bpe": op3_bpe,
    "op4_repair": op4_repair,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_topk": op10_topk,
    "op11_jump_hash": op11_jump_hash,
    "op12_ball_tree": op12_ball_tree,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": _OP8,
    "op10_topk": _OP10,
    "op11_jump_hash": _OP11,
    "op12_ball_tree": _op12(),
}
