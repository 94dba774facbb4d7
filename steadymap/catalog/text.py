"""Queries from documents to vector spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import rounded, table
from steadymap.functions.words import STOP_WORDS, accent_table
from steadymap.operators import text, vectors
from steadymap.session import materialize, share, spread

_MARKED, _PLAIN = accent_table()
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
TOKENS_CTE = f"""
tok as (select doc_id, lang, source, list_filter(regexp_extract_all(regexp_replace(
   translate(lower(text), '{_MARKED}', '{_PLAIN}'), '\\p{{Mn}}+', '', 'g'), '[\\p{{L}}_]+'),
   lambda x: length(x) between 2 and 15) tokens from documents),
pre as (select * from (select doc_id, lang, source, list_filter(tokens,
   lambda x: not list_contains([{_STOP}], x) and length(x) > 3) tokens from tok) where len(tokens) > 1)"""
BOW_CTE = TOKENS_CTE + """,
tk as (select doc_id, unnest(tokens) term from pre),
bow as (select doc_id, term, count(*)::bigint tf from tk group by 1, 2),
nd as (select count(distinct doc_id)::double n from bow),
dic as (select term, min(doc_id) fd, count(*)::bigint df, sum(tf)::bigint cf from bow group by 1)"""


def corpus(spark, sf, category="lang"):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col(category).alias("category"))
    return spread(docs, "doc_id")


def token_lists(spark, sf, category="lang"):
    return text.preprocess(corpus(spark, sf, category))


def counts(spark, sf):
    return materialize(vectors.bow(token_lists(spark, sf)))


def document_count(bow):
    return bow.select("doc_id").distinct().count()


@query("tokenize", f"""with {TOKENS_CTE}
select doc_id, len(tokens)::int n_tokens, md5(array_to_string(tokens, ' ')) digest from tok""")
def tokenize(spark, sf):
    out = text.tokenize(corpus(spark, sf))
    return out.select("doc_id", F.size("tokens").alias("n_tokens"),
                      F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("preprocess", f"""with {TOKENS_CTE}
select doc_id, lang as category, len(tokens)::int n_tokens, md5(array_to_string(tokens, ' ')) digest from pre""")
def preprocess(spark, sf):
    return token_lists(spark, sf).select("doc_id", "category", F.size("tokens").alias("n_tokens"),
                                         F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("lemmatize", f"""with {BOW_CTE},
lem as (select a.term form, b.term lemma from dic a join dic b on a.term = b.term || 's'),
lg as (select doc_id, unnest(tokens) form, generate_subscripts(tokens, 1) pos from pre)
select doc_id, count(*) filter (lemma is not null)::bigint changed,
  md5(string_agg(coalesce(lemma, lg.form), ' ' order by pos)) digest from lg left join lem on lem.form=lg.form group by doc_id""")
def lemmatize(spark, sf):
    docs = materialize(token_lists(spark, sf))
    terms = share(docs.select(F.explode("tokens").alias("form")).distinct())
    lemmas = terms.join(terms.select(F.concat("form", F.lit("s")).alias("form"),
                                     F.col("form").alias("lemma")), "form")
    out = text.lemmatize(docs.select("doc_id", "tokens", F.col("tokens").alias("before")), lemmas)
    changed = F.size(F.filter(F.zip_with("before", "tokens", lambda a, b: a != b), lambda x: x))
    return out.select("doc_id", changed.cast("long").alias("changed"),
                      F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("dictionary", f"""with {BOW_CTE}
select term, row_number() over (order by fd, term) - 1 term_id, df, cf from dic""")
def dictionary(spark, sf):
    return vectors.dictionary(counts(spark, sf))


@query("bow", f"""with {BOW_CTE}, ids as (select term, row_number() over (order by fd, term) - 1 term_id from dic)
select doc_id, term_id, tf from bow join ids using (term)""")
def bow(spark, sf):
    c = counts(spark, sf)
    return vectors.with_ids(c, vectors.dictionary(c))


@query("density_filter", f"""with {BOW_CTE}, sh as (select term, df/n as share, df/n >= 0.004 kept from dic, nd)
select sh.term, round(share, 6) as share, kept, coalesce(sum(case when kept then tf end), 0)::bigint kept_tokens,
  coalesce(sum(case when not kept then tf end), 0)::bigint dropped_tokens
from sh join bow using (term) group by sh.term, share, kept""")
def density_filter(spark, sf):
    c = counts(spark, sf)
    terms = share(vectors.density(c, document_count(c), 0.004))
    kept = vectors.keep_terms(c, terms).groupBy("term").agg(F.sum("tf").alias("kept_tokens"))
    rest = vectors.drop_terms(c, terms.filter("kept")).groupBy("term").agg(
        F.sum("tf").alias("dropped_tokens"))
    out = terms.join(kept, "term", "left").join(rest, "term", "left").fillna(
        0, ["kept_tokens", "dropped_tokens"])
    return rounded(out)


@query("tfidf", f"""with {BOW_CTE}, raw as (select doc_id, term, tf*log2(n/df) w from bow join dic using (term), nd)
select doc_id, term, round(w / sqrt(sum(w*w) over (partition by doc_id)), 6) w from raw where w <> 0""")
def tfidf(spark, sf):
    c = counts(spark, sf)
    return rounded(vectors.tfidf(c, document_count(c)))


CTFIDF_CTE = BOW_CTE + """,
pt as (select source topic, term, sum(tf) c from bow join pre using (doc_id) group by 1, 2),
ct as (select topic, term, c/sum(c) over (partition by topic) * ln(n/sum(c) over (partition by term)) weight from pt, nd),
tw as (select topic, term, weight, row_number() over (partition by topic order by round(weight, 9) desc, term) as rank from ct)"""


def topic_words(spark, sf, n):
    docs = materialize(token_lists(spark, sf, "source"))
    c = materialize(vectors.bow(docs))
    topics = docs.select("doc_id", F.col("category").alias("topic"))
    weights = vectors.class_tfidf(c, topics, document_count(c))
    return vectors.top_words(weights, n)


@query("ctfidf_topwords", f"""with {CTFIDF_CTE}
select topic, rank::int as rank, term word, round(weight, 6) weight from tw where rank <= 20""")
def ctfidf_topwords(spark, sf):
    return rounded(topic_words(spark, sf, 20))


@query("ctfidf_ngrams", f"""with {TOKENS_CTE}, lt as (select lang topic, tokens w from pre),
gr as (select topic, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k+1]))) term from lt),
pt as (select topic, term, count(*) c from gr group by 1, 2),
nd as (select count(*)::double n from pre where len(tokens) > 0),
ct as (select topic, term, c/sum(c) over (partition by topic) * ln(n/sum(c) over (partition by term)) weight from pt, nd),
rw as (select *, row_number() over (partition by topic order by round(weight, 9) desc, term) r from ct)
select topic, r::int as rank, term word, round(weight, 6) weight from rw where r <= 20""")
def ctfidf_ngrams(spark, sf):
    """The heaviest words and word pairs of every language."""
    docs = materialize(token_lists(spark, sf))
    # words and pairs are counted per language where they are read: neither lists of pairs nor counts per document are written
    c = materialize(vectors.bow(vectors.ngrams(docs, 1, 2).withColumnRenamed("category", "topic"), "topic"))
    weights = vectors.class_tfidf(c, None, docs.select("doc_id").distinct().count())
    return rounded(vectors.top_words(weights, 20))


@query("topic_word_pivot", f"""with {CTFIDF_CTE},
lt as (select lang topic, term, sum(tf) c from bow join pre using (doc_id) group by 1, 2),
lc as (select topic, term, c/sum(c) over (partition by topic) * ln(n/sum(c) over (partition by term)) weight from lt, nd),
lw as (select topic, term, row_number() over (partition by topic order by round(weight, 9) desc, term) as rank from lc)
select rank::int as rank, max(term) filter (topic='de') de, max(term) filter (topic='en') en,
  max(term) filter (topic='es') es, max(term) filter (topic='fr') fr from lw where rank <= 10 group by rank""")
def topic_word_pivot(spark, sf):
    docs = materialize(token_lists(spark, sf))
    c = materialize(vectors.bow(docs))
    topics = docs.select("doc_id", F.col("category").alias("topic"))
    weights = vectors.class_tfidf(c, topics, document_count(c))
    return vectors.word_table(vectors.top_words(weights, 10), ["de", "en", "es", "fr"])


@query("linear_combination", f"""with {CTFIDF_CTE},
dt as (select doc_id, ascii(term) % 5 topic, sum(tf)/sum(sum(tf)) over (partition by doc_id) p from bow group by 1, 2),
tt as (select ascii(term) % 5 topic, term, cf/sum(cf) over (partition by ascii(term) % 5) weight from dic),
t10 as (select * from (select *, row_number() over (partition by topic order by round(weight,9) desc, term) r from tt) where r <= 30)
select doc_id, term, round(sum(p*weight), 6) w from dt join t10 using (topic) group by 1, 2""")
def linear_combination(spark, sf):
    c = counts(spark, sf)
    topic = F.ascii("term") % 5
    per_doc = c.groupBy("doc_id", topic.alias("topic")).agg(F.sum("tf").alias("t"))
    total = c.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    doc_topics = per_doc.join(total, "doc_id").select("doc_id", "topic", (F.col("t") / F.col("n")).alias("p"))
    per_term = share(c.groupBy(topic.alias("topic"), "term").agg(F.sum("tf").alias("t")))
    topic_total = per_term.groupBy("topic").agg(F.sum("t").alias("n"))
    weights = per_term.join(topic_total, "topic").select(
        "topic", "term", (F.col("t") / F.col("n")).alias("weight"))
    heavy = vectors.top_words(weights, 30)
    topic_terms = weights.join(heavy.select("topic", F.col("word").alias("term")), ["topic", "term"], "left_semi")
    return rounded(vectors.linear_combination(doc_topics, topic_terms))


@query("linear_combination_whole", f"""with {BOW_CTE},
dt as (select doc_id, ascii(term) % 5 topic, sum(tf)/sum(sum(tf)) over (partition by doc_id) p from bow group by 1, 2),
tt as (select ascii(term) % 5 topic, term, cf/sum(cf) over (partition by ascii(term) % 5) weight from dic)
select doc_id, round(sqrt(sum(p*weight*p*weight)), 6) norm from dt join tt using (topic) group by 1""")
def linear_combination_whole(spark, sf):
    """Length of every document's combination over the whole vocabulary, without forming documents x vocabulary."""
    from steadymap.operators.topics import combined_space

    c = counts(spark, sf)
    topic = (F.ascii("term") % 5).alias("topic")
    total = c.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    doc_topics = c.groupBy("doc_id", topic).agg(F.sum("tf").alias("t")).join(total, "doc_id").select("doc_id", "topic", (F.col("t") / F.col("n")).alias("p"))
    per_term = c.groupBy(topic, "term").agg(F.sum("tf").alias("t"))
    per_topic = c.groupBy(topic).agg(F.sum("tf").alias("n"))
    weights = per_term.join(per_topic, "topic").select("topic", "term", (F.col("t") / F.col("n")).alias("weight"))
    space = combined_space(doc_topics, weights, 5)
    return rounded(space.select("doc_id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))


@query("dense_topic_rows", f"""with {BOW_CTE},
dt as (select doc_id, ascii(term) % 5 topic, sum(tf)::double p from bow group by 1, 2)
select b.doc_id, t.k::int topic, coalesce(p, 0.0)::double p
from (select distinct doc_id from bow) b cross join (select unnest(range(6)) k) t
left join dt on dt.doc_id=b.doc_id and dt.topic=t.k""")
def dense_topic_rows(spark, sf):
    c = counts(spark, sf).groupBy("doc_id", (F.ascii("term") % 5).alias("topic")).agg(
        F.sum("tf").cast("double").alias("p"))
    return vectors.dense_rows(c, 6).select("doc_id", F.posexplode("v").alias("topic", "p"))


@query("corpus_stats", f"""with {BOW_CTE}, ln as (select doc_id, sum(tf) l from bow group by 1)
select (select count(*) from ln)::bigint documents, (select count(*) from dic)::bigint vocabulary,
  (select median(l) from ln)::double median_length""")
def corpus_stats(spark, sf):
    return vectors.corpus_stats(counts(spark, sf))


@query("label_codes", """with c as (select source category, min(doc_id) f, count(*) n from documents group by 1)
select category, (dense_rank() over (order by category) - 1)::int y,
  (row_number() over (order by f) - 1)::int y_first, n::bigint documents from c""")
def label_codes(spark, sf):
    docs = corpus(spark, sf, "source")
    first = text.label_codes(docs, True).withColumnRenamed("y", "y_first")
    sizes = text.encode_labels(docs).groupBy("category").agg(
        F.first("y").alias("y"), F.count("*").alias("documents"))
    return sizes.join(first, "category")


@query("single_category_docs", """
select l_orderkey doc_id, string_agg(l_linestatus, ' ' order by l_linenumber, l_linestatus) as text, any_value(l_returnflag) category
from lineitem group by l_orderkey having count(distinct l_returnflag) = 1""")
def single_category_docs(spark, sf):
    return text.single_category(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query("topk_class_docs", """
with k as (select source, count(*) n from documents group by 1 order by n desc, source limit 8)
select source, count(*)::bigint documents, sum(n_chars)::bigint characters from documents where source in (select source from k) group by 1""")
def topk_class_docs(spark, sf):
    docs = text.largest_classes(table(spark, sf, "documents"), 8, "source")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


@query("decode_sequences", f"""with {BOW_CTE}, ix as (select term from dic where cf >= 2),
lg as (select doc_id, unnest(tokens) term, generate_subscripts(tokens, 1) pos from pre)
select doc_id, md5(string_agg(coalesce(ix.term, '?'), ' ' order by pos)) digest
from lg left join ix on ix.term=lg.term group by doc_id""")
def decode_sequences(spark, sf):
    docs = materialize(token_lists(spark, sf))
    index = share(text.word_index(docs, 2))
    decoded = text.decode(text.encode(docs, index), index)
    return decoded.select("doc_id", F.md5("text").alias("digest"))
