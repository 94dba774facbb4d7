"""Queries over topic models and their coherence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import rounded, source_space
from steadymap.catalog.text import BOW_CTE, CTFIDF_CTE, corpus, document_count, token_lists
from steadymap.operators import topics, vectors
from steadymap.session import materialize

_TOP = f"""{CTFIDF_CTE},
lt as (select lang topic, term, sum(tf) c from bow join pre using (doc_id) group by 1, 2),
lc as (select topic, term, c/sum(c) over (partition by topic) * ln(n/sum(c) over (partition by term)) weight from lt, nd),
lw as (select * from (select topic, term, row_number() over (partition by topic order by round(weight, 9) desc, term) as k from lc) where k <= 10)"""


def _window_sql(size):
    return f"""with {_TOP}, ln as (select doc_id, len(tokens) l, least(len(tokens), {size}) s from pre),
oc as (select doc_id, unnest(tokens) term, generate_subscripts(tokens, 1) - 1 p from pre),
st as (select distinct doc_id, term, unnest(range(greatest(0, p - s + 1), least(p, l - s) + 1)) w
  from oc join ln using (doc_id) where term in (select term from lw)),
nw as (select sum(l - s + 1)::double n from ln),
n1 as (select term, count(*)::double c from st group by 1),
n2 as (select a.term t1, b.term t2, count(*)::double c from st a join st b on a.doc_id = b.doc_id and a.w = b.w group by 1, 2),
pr as (select x.topic, x.term t1, y.term t2, x.k k1, y.k k2, a.c c1, b.c c2, coalesce(n2.c, 0) c12, n
  from lw x join lw y on x.topic = y.topic join n1 a on a.term = x.term join n1 b on b.term = y.term
  left join n2 on n2.t1 = x.term and n2.t2 = y.term, nw),
m as (select *, ln((c12/n + 1e-12)/((c1/n)*(c2/n))) pmi, ln((c12/n + 1e-12)/((c1/n)*(c2/n)))/-ln(c12/n + 1e-12) npmi from pr)"""


def lang_topics(spark, sf):
    docs = materialize(token_lists(spark, sf))
    c = materialize(vectors.bow(docs))
    weights = vectors.class_tfidf(c, docs.select("doc_id", F.col("category").alias("topic")), document_count(c))
    return docs, materialize(vectors.top_words(weights, 10))


@query("coherence_umass", _window_sql(1000000000) + """
select topic, round(avg(ln((c12/n + 1e-12)/(c2/n))), 6) coherence from m where k1 > k2 group by 1""")
def coherence_umass(spark, sf):
    return rounded(topics.coherence_umass(*lang_topics(spark, sf)))


@query("coherence_uci", _window_sql(10) + "select topic, round(avg(pmi), 6) coherence from m where t1 <> t2 group by 1")
def coherence_uci(spark, sf):
    return rounded(topics.coherence_uci(*lang_topics(spark, sf)))


@query("coherence_npmi", _window_sql(10) + "select topic, round(avg(npmi), 6) coherence from m where t1 <> t2 group by 1")
def coherence_npmi(spark, sf):
    return rounded(topics.coherence_npmi(*lang_topics(spark, sf)))


@query("coherence_cv", _window_sql(110) + """, s as (select topic, t2, sum(npmi) s from m group by 1, 2),
w as (select m.topic, t1, sum(npmi*s)/sqrt(sum(npmi*npmi)*sum(s*s)) c from m join s on s.topic=m.topic and s.t2=m.t2 group by 1, 2)
select topic, round(avg(c), 6) coherence from w group by 1""")
def coherence_cv(spark, sf):
    return rounded(topics.coherence_cv(*lang_topics(spark, sf)))


def _mean(value, window, where):
    return f"(select avg(c) from ({_window_sql(window)} select topic, avg({value}) c from m where {where} group by 1))"


@query("model_quality", f"""select 'ctfidf' model_type, 4 n_topics, '' alpha_lda,
  round({_mean('ln((c12/n + 1e-12)/(c2/n))', 1000000000, 'k1 > k2')}, 6) coherence_u_mass,
  round((select avg(c) from ({_window_sql(110)}, s as (select topic, t2, sum(npmi) s from m group by 1, 2),
    w as (select m.topic, t1, sum(npmi*s)/sqrt(sum(npmi*npmi)*sum(s*s)) c from m join s on s.topic=m.topic and s.t2=m.t2 group by 1, 2)
    select topic, avg(c) c from w group by 1)), 6) coherence_c_v,
  round({_mean('pmi', 10, 't1 <> t2')}, 6) coherence_c_uci, round({_mean('npmi', 10, 't1 <> t2')}, 6) coherence_c_npmi, -1.0::double perplexity""")
def model_quality(spark, sf):
    """The quality row that a topic model's evaluation appends."""
    docs, words = lang_topics(spark, sf)
    return rounded(topics.evaluate(docs, words, "ctfidf", 4))


@query("space_tfidf", f"""with {BOW_CTE}, raw as (select doc_id, term, tf*log2(n/df) w from bow join dic using (term), nd),
tfidf as (select doc_id, w / sqrt(sum(w*w) over (partition by doc_id)) w from raw where w <> 0)
select doc_id, count(*)::bigint terms, round(sum(w * w), 6) length, round(max(w), 6) top from tfidf group by 1""")
def space_tfidf(spark, sf):
    """The tf-idf space by its name, summed up per document."""
    rows = topics.build_space("tfidf", token_lists(spark, sf)).select("doc_id", F.col("v.val").alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(rows.select("doc_id", F.size("w").cast("long").alias("terms"), total.alias("length"), F.array_max("w").alias("top")))


def _sparse(spark, sf):
    """Every document over the whole vocabulary."""
    docs = materialize(token_lists(spark, sf))
    c = materialize(vectors.bow(docs))
    terms = materialize(vectors.dictionary(c))
    rows = materialize(vectors.sparse_rows(c, terms).repartition("doc_id"))
    return docs, rows, terms, terms.count()


def _named(topic_terms, terms, n=10):
    return vectors.top_words(topic_terms.join(terms.select("term_id", "term"), "term_id"), n)


@query("lda")
def lda(spark, sf):
    _, rows, terms, width = _sparse(spark, sf)
    _, topic_terms, perplexity = topics.lda(rows, width, 5)
    return _named(topic_terms, terms).withColumn("perplexity", F.lit(float(perplexity)))


@query("lda_documents")
def lda_documents(spark, sf):
    _, rows, _, width = _sparse(spark, sf)
    docs, _, _ = topics.lda(rows, width, 5)
    return vectors.dense_rows(docs, 5)


@query("lsi")
def lsi(spark, sf):
    _, rows, terms, width = _sparse(spark, sf)
    _, topic_terms = topics.lsi(rows, width, 5)
    return _named(topic_terms, terms)


@query("lsi_quality", "select 5 topics, true ordered, true orthogonal, count(*)::bigint documents from documents")
def lsi_quality(spark, sf):
    """What has to hold for the leading directions: falling singular values, orthogonal columns of exactly that length."""
    _, rows, _, width = _sparse(spark, sf)
    docs, _, singular = topics.lsi_factors(rows, width, 5)
    pairs = [(i, j) for i in range(5) for j in range(i + 1)]
    off = [F.abs(F.sum(F.col(f"f{i}") * F.col(f"f{j}")) - (float(singular[i] ** 2) if i == j else 0.0)) <= 1e-6 * float(singular[0] ** 2) for i, j in pairs]
    fine = docs.agg(reduce(lambda a, b: a & b, off).alias("orthogonal"))
    ordered = bool((singular[1:] <= singular[:-1]).all())
    return fine.select(F.lit(5).alias("topics"), F.lit(ordered).alias("ordered"), "orthogonal", F.lit(corpus(spark, sf).count()).alias("documents"))


@query("nmf")
def nmf(spark, sf):
    _, rows, terms, width = _sparse(spark, sf)
    _, topic_terms, errors = topics.nmf(rows, width, 5)
    return _named(topic_terms, terms).withColumn("error", F.lit(errors[-1]))


@query("word2vec_docs")
def word2vec_docs(spark, sf):
    return topics.word2vec(token_lists(spark, sf), 16)


@query("embed")
def embed(spark, sf):
    return topics.embed(corpus(spark, sf))


@query("density_topics")
def density_topics(spark, sf):
    space = source_space(spark, sf)
    near = materialize(topics.knn(space.drop("label"), 15))
    radius = near.filter("r = 15").agg(F.percentile_approx("d", 0.3)).first()[0]
    return topics.topic_sizes(topics.density_topics(space, radius, min_size=5, near=near))
