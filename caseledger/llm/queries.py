"""The registered ``opN_*`` queries: thin wrappers with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger.llm import (language, mixing, near_vectors, neighbours, ngram_join, personal, phrases, pieces, quality,
                            token_counts, toxicity, urls, vector_codes)
from caseledger.llm.common import held_out, read_table
from caseledger.session import shared_dir


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    out = quality.score_quality(docs, quality.train(docs, read_table(spark, sf, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    out = language.identify(docs, language.learn_profiles(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = toxicity.train(docs, read_table(spark, sf, "labels"))
    out = toxicity.score_toxicity(docs, model, keep=("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "sentences")


def op4_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors.link_vectors(read_table(spark, sf, "embeddings"))


def op5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    out = pieces.encode(read_table(spark, sf, "documents"), pieces.load(), check="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join_similar(read_table(spark, sf, "documents"))


#: Epochs of any source at most, when as many tokens are drawn as there are.
MAX_EPOCHS = 2.0


def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mix = mixing.plan(read_table(spark, sf, "documents"), repetitions=MAX_EPOCHS)
    return mixing.draw(mix).select("doc_id", "source", "epoch", "block", "position", "n_tokens")


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(read_table(spark, sf, "pages"), urls.train(urls.labelled_urls(spark)))


def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings")
    return neighbours.search(neighbours.build(rows), rows.where(F.col("vec_id") % 100 == 0))


def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal.digest(personal.find_personal(read_table(spark, sf, "documents")))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.digest(vector_codes.compress(read_table(spark, sf, "embeddings")))


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 512


def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The cache starts empty, so that every run does its whole work."""
    import public_tokenizers
    cache = f"{shared_dir(spark).rstrip('/')}/token_counts/{uuid.uuid4().hex}"
    tokenizer = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    out = token_counts.count_tokens(read_table(spark, sf, "documents"), tokenizer, cache)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_near_vectors": op4_near_vectors,
    "op5_pieces": op5_pieces,
    "op6_ngram_join": op6_ngram_join,
    "op7_mix_sources": op7_mix_sources,
    "op8_url_filter": op8_url_filter,
    "op9_nearest": op9_nearest,
    "op10_personal_data": op10_personal_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_phrases": op13_phrases,
}
_VECTORS = """v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0)"""



def _codes_sql() -> str:
    """Two rounds and the last assignment, one after the other."""
    def nearest(b):
        return f"""select i, p, any_value(v.x) as x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x),
    lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint, 'e': b.e}}) as near from pv v join {b} b using (p) group by i, p"""

    def means(r):
        return f"""a{r} as materialized ({nearest(f'b{r}')}),
n{r} as (select p, e, list(case when s < 0 then (s - c + 1) // c else s // c end order by j) as x from (
  select p, near.e as e, j, sum(x[j])::bigint as s, count(*) as c from a{r}, w, range(1, 65536) g(j) where j <= w.w
  group by all) group by p, e),
b{r + 1} as materialized (select b.p, b.e, coalesce(n.x, b.x) as x from b{r} b left join n{r} n using (p, e))"""

    return f"""with kept as materialized (
  select row_number() over (order by vec_id, v) as i, * from (
    select vec_id, label, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) as v from embeddings
    where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0
      and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0)),
w as materialized (select len(v) // 16 as w from kept where i = 1),
pv as materialized (select i, p, v[p * w + 1:(p + 1) * w] as x from kept, w, range(16) r(p)),
b0 as materialized (select p, i - 1 as e, x from pv where i <= 64),
{means(0)},
{means(1)},
f as (select i, string_agg(lpad(lower(to_hex(near.e)), 2, '0'), '' order by p) as code, sum(near.d)::bigint as error
  from ({nearest('b2')}) group by i),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from b2)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256
from f join kept using (i), h"""


_PHRASES = """with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
w as (select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as t
  from w, range(1, 6) r(m) where len(w) >= m),
f as materialized (select lang, m, t, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
c as materialized (select lang, m, t, f as a, string_split(t, ' ') as w from f where m > 1 and f >= 100),
cuts as (select c.*, k, array_to_string(w[1:k], ' ') as lt, array_to_string(w[k + 1:m], ' ') as rt
  from c, range(1, 5) r(k) where k < m),
scored as (select x.lang, x.m, x.t, x.a, n.n, min({'s': (1000::hugeint * x.a * n.n) // (l.f::hugeint * r.f), 'k': k,
    'l': l.f, 'r': r.f}) as s
  from cuts x join n on n.lang = x.lang join f l on l.lang = x.lang and l.t = x.lt join f r on r.lang = x.lang and r.t = x.rt
  group by all),
inside as (select lang, a, array_to_string(w[i:i + s - 1], ' ') as t from c, range(2, 5) b(s), range(1, 5) p(i)
  where s < m and i + s - 1 <= m),
whole as (select lang, t, max(a) as a from inside group by all),
kept as (select s.* from scored s left join whole w on w.lang = s.lang and w.t = s.t
  where w.a is null or 100 * w.a < 100 * s.a)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by s.s desc, a desc, t) as rank, t as phrase, a::bigint as a,
    s.l::bigint as l, s.r::bigint as r, n, s.s::bigint as score from kept) where rank <= 2000"""

#: Where SQL states the whole result.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op13_phrases": _PHRASES,
    "op4_near_vectors": f"""with recursive {_VECTORS},
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from reach r join links l on l.a = r.a),
comp as (select a, min(c) as c from reach group by a),
deg as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, e.vec_id = c as kept
from embeddings e left join deg on deg.a = e.vec_id join comp on comp.a = e.vec_id""",
    "op6_ngram_join": """with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.g = b.g and a.doc_id <> b.doc_id
  group by all having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, c) as (select doc_id, doc_id from documents union select l.b, r.c from reach r join links l on l.a = r.a)
select s.doc_id, len(s.s)::bigint as n_shingles, c as component_id
from s join (select a, min(c) as c from reach group by a) on a = s.doc_id""",
    "op9_nearest": f"""with {_VECTORS},
d as (
  select q.vec_id as query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda x, y: x + y)) as score
  from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 100 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10""",
}
