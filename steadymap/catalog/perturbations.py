"""Queries that perturb the input, and the corpus-level similarity of perturbed word counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import LOCAL_CTE, MRRE_NORM, RANK, rounded, source_space, table
from steadymap.catalog.text import BOW_CTE, corpus, counts, token_lists
from steadymap.operators import perturb, scores, text, vectors
from steadymap.session import materialize

_HASH = "('0x' || substr(md5({0}), 1, 12))::bigint"


def _hash(expr):
    return _HASH.format(expr)


@query("stratified_part", """
with c as (select source, count(*) n, min(doc_id) f from documents group by 1),
s as (select source, n, coalesce(sum(n) over (order by f rows between unbounded preceding and 1 preceding), 0) s from c),
pos as (select source, unnest(range(s::bigint, (s + n)::bigint)) p from s),
fs as (select source, p % 10 fold, count(*) m from pos group by 1, 2),
cum as (select source, fold, sum(m) over (partition by source order by fold) upto from fs),
r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 r from documents),
a as (select r.doc_id, r.source, min(fold)::int fold from r join cum on cum.source=r.source and r.r < cum.upto group by 1, 2)
select doc_id, source as category, fold from a where fold <= 5""")
def stratified_part(spark, sf):
    return perturb.stratified_part(corpus(spark, sf, "source").drop("text"), 5)


@query("shuffle_rows", f"""select doc_id,
 (row_number() over (order by {_hash("doc_id || ':42:3'")}, doc_id) - 1)::bigint as position from documents""")
def shuffle_rows(spark, sf):
    return perturb.shuffle_rows(table(spark, sf, "documents").select("doc_id"), 3)


def _picked_cte(item, share, times):
    return f"""
pk as (select {item} from (select {item}, row_number() over (order by {_hash(f"{item} || ':42:{times}'")}, {item}) - 1 r,
  count(*) over () m from (select distinct {item} from bow)) where r < floor({share}::double * m))"""


def _scaled_sql(item, factor):
    return f"""with {BOW_CTE}, {_picked_cte(item, 0.2, 2)}
select doc_id, term, (case when {item} in (select {item} from pk) then {factor}*tf else tf end)::bigint tf from bow"""


@query("scale_columns", _scaled_sql("term", 5))
def scale_columns(spark, sf):
    return perturb.scale_columns(counts(spark, sf), 2).select("doc_id", "term", "tf")


@query("scale_rows", _scaled_sql("doc_id", 2))
def scale_rows(spark, sf):
    return perturb.scale_rows(counts(spark, sf), 2).select("doc_id", "term", "tf")


@query("drop_columns", f"""with {BOW_CTE}, {_picked_cte('term', 0.25, 1)}
select doc_id, term, tf from bow where term not in (select term from pk)""")
def drop_columns(spark, sf):
    return perturb.drop_columns(counts(spark, sf), 5, 1).select("doc_id", "term", "tf")


def _as(name, cte):
    return cte.replace("pk as", f"{name} as")


@query("permuted_columns", f"""with {BOW_CTE}, {_as('pc', _picked_cte('term', 0.2, 2))}, {_as('pr', _picked_cte('doc_id', 0.2, 1))},
{_as('pd', _picked_cte('term', 0.1, 3))},
one as (select doc_id, term, case when term in (select term from pc) then tf*tf + 1 else tf end tf from bow),
two as (select doc_id, term, case when doc_id in (select doc_id from pr) then 2*tf else tf end tf from one),
three as (select doc_id, term, case when term in (select term from pd) then (case when tf > 1 then 1 end) else tf end tf from two)
select substr(sha256((sum(('0x' || substr(md5(doc_id || '|' || term || '|' || tf), 1, 15))::hugeint))::varchar), 1, 15) fingerprint,
  count(*)::bigint cells, sum(tf)::bigint weight from three where tf is not null""")
def permuted_columns(spark, sf):
    """All changes in a row, two of them the caller's own, and the hash of the changed matrix."""
    c = counts(spark, sf)
    changed, print_ = perturb.permute_columns(c, 2, 1, 2, 3, columns=lambda tf: tf * tf + 1, dropped=lambda tf: F.when(tf > 1, F.lit(1).cast("long")))
    return print_.join(F.broadcast(changed.agg(F.count("*").alias("cells"), F.sum("tf").alias("weight"))))


_JITTER = ("tf + greatest(0, floor(tf * (1 + (2*(" + _hash("doc_id || ':' || term || ':42'")
           + "::double/281474976710656.0::double) - 1)*{0}::double)))")


@query("count_jitter", f"""with {BOW_CTE}
select doc_id, term, ({_JITTER.format(0.25)})::bigint tf from bow""")
def count_jitter(spark, sf):
    return perturb.count_jitter(counts(spark, sf), 0.25).select("doc_id", "term", "tf")


@query("range_jitter", f"""
with l as (select vec_id, k, embedding[k+1]::double x from embeddings, (select unnest(range(64)) k)),
s as (select k, max(x) - min(x) span from l group by k)
select vec_id id, k::int as position,
 round(x + ({_hash("vec_id || ':' || l.k || ':42'")}::double/281474976710656.0::double - 0.5)*0.1::double*span, 6) x
from l join s using (k)""")
def range_jitter(spark, sf):
    out = perturb.range_jitter(source_space(spark, sf), 0.1)
    return rounded(out.select("id", F.posexplode("v").alias("position", "x")))


@query("fingerprint", """
select substr(sha256((sum(('0x' || substr(md5(doc_id || '|' || text), 1, 15))::hugeint))::varchar), 1, 15) fingerprint
from documents""")
def fingerprint(spark, sf):
    return perturb.fingerprint(table(spark, sf, "documents"), "doc_id", "text")


def jittered_spaces(spark, sf, amounts):
    """One space per jitter amount: v1 the counts, v2 the jittered counts, label the source."""
    docs = materialize(token_lists(spark, sf, "source"))
    c = materialize(vectors.bow(docs))
    terms = materialize(vectors.dictionary(c))
    labels = docs.join(text.label_codes(docs), "category").select("doc_id", F.col("y").alias("label"))
    plain = materialize(vectors.sparse_rows(c, terms).withColumnRenamed("v", "v1"))
    spaces = []
    for a in amounts:
        noisy = vectors.sparse_rows(perturb.count_jitter(c, a), terms).withColumnRenamed("v", "v2")
        spaces.append(plain.join(noisy, "doc_id").join(labels, "doc_id").select(
            F.lit(f"jitter_{a}").alias("space"), F.col("doc_id").alias("id"), "label", "v1", "v2"))
    return materialize(reduce(lambda x, y: x.unionByName(y), spaces))


_SIM_SQL = f"""with {BOW_CTE},
cat as (select category, row_number() over (order by category) - 1 y from (select distinct source category from pre)),
dl as (select doc_id i, y from pre join cat on cat.category = pre.source),
j as (select 'jitter_' || a as s, doc_id, term, tf::double t1, ({_JITTER.format('a')})::double t2
  from bow, (select unnest([0.1::double, 0.25::double]) a)),
nn as (select s, doc_id i, sum(t1*t1) n1, sum(t2*t2) n2 from j group by 1, 2),
dt as (select a.s, a.doc_id i, b.doc_id j, sum(a.t1*b.t1) p1, sum(a.t2*b.t2) p2
  from j a join j b on a.s=b.s and a.term=b.term and a.doc_id < b.doc_id group by 1,2,3),
hp as (select x.s, x.i, y.i j, 1 - coalesce(p1,0)/(sqrt(x.n1)*sqrt(y.n1)) d1, 1 - coalesce(p2,0)/(sqrt(x.n2)*sqrt(y.n2)) d2,
   sqrt(greatest(x.n1+y.n1-2*coalesce(p1,0),0)) e1, sqrt(greatest(x.n2+y.n2-2*coalesce(p2,0),0)) e2
   from nn x join nn y on x.s=y.s and x.i<y.i left join dt on dt.s=x.s and dt.i=x.i and dt.j=y.i),
d as (select hp.*, a.y ya, b.y yb from hp join dl a on a.i=hp.i join dl b on b.i=hp.j
  union all select s, j, hp.i, d1, d2, e1, e2, b.y, a.y from hp join dl a on a.i=hp.i join dl b on b.i=hp.j),
r as (select *, row_number() over (partition by s, i order by d1, j) r1, row_number() over (partition by s, i order by d2, j) r2,
   row_number() over (partition by s, i order by e1, j) q1, row_number() over (partition by s, i order by e2, j) q2 from d),
n as (select s, count(*)::double n from nn group by s),
lab as (select s, i, yb, count(*) filter (q1<=7) c1, count(*) filter (q2<=7) c2 from r where q1<=7 or q2<=7 group by s, i, yb),
labs as (select s, sum(least(c1,c2))::double l from lab group by s),
{LOCAL_CTE.split('labs as', 1)[1].split('group by s),', 1)[1]},
q as (select s, d1, d2, {RANK.format(c='d1')} k1, {RANK.format(c='d2')} k2 from d where i<j),
gl as (select s, corr(k1,k2) spearman, corr(d1,d2) pearson from q group by s),
sz as (select y, count(*)::double m from dl group by y),
ce as (select s, y, term, sum(t1)/any_value(m) c1, sum(t2)/any_value(m) c2 from j join dl on dl.i=j.doc_id join sz using (y) group by 1,2,3),
cn as (select s, y, sum(c1*c1) c11, sum(c2*c2) c22 from ce group by 1,2),
xc as (select j.s, j.doc_id i, ce.y, sum(t1*c1) x1, sum(t2*c2) x2 from j join ce on ce.s=j.s and ce.term=j.term group by 1,2,3),
ne as (select nn.s, nn.i, arg_min(cn.y, (round(n1+c11-2*coalesce(x1,0),9), cn.y)) b1, arg_min(cn.y, (round(n2+c22-2*coalesce(x2,0),9), cn.y)) b2
  from nn join cn using (s) left join xc on xc.s=nn.s and xc.i=nn.i and xc.y=cn.y group by 1,2),
dc as (select s, avg((b1=y)::int)::double dc1, avg((b2=y)::int)::double dc2 from ne join dl using (i) group by s),
cp as (select a.s, a.y ya, b.y yb, sum(a.c1*b.c1) x1, sum(a.c2*b.c2) x2 from ce a join ce b on a.s=b.s and a.term=b.term and a.y<b.y group by 1,2,3),
cd as (select a.s, sqrt(a.c11+b.c11-2*coalesce(x1,0)) d1, sqrt(a.c22+b.c22-2*coalesce(x2,0)) d2
  from cn a join cn b on a.s=b.s and a.y<b.y left join cp on cp.s=a.s and cp.ya=a.y and cp.yb=b.y),
co as (select s, corr(k1, k2) cluster_ordering from (select s, {RANK.format(c='d1')} k1, {RANK.format(c='d2')} k2 from cd) group by s),
sl as (select s, i, ya, yb, avg(e1) a1, avg(e2) a2 from d group by 1,2,3,4),
sp as (select s, i, max(a1) filter (ya=yb) a1, min(a1) filter (ya<>yb) b1, max(a2) filter (ya=yb) a2, min(a2) filter (ya<>yb) b2 from sl group by 1,2),
si as (select s, avg(coalesce((b1-a1)/greatest(a1,b1),0)) s1, avg(coalesce((b2-a2)/greatest(a2,b2),0)) s2 from sp group by s)
select local_.s as space, round(spearman,6) spearman_correlation, round(pearson,6) pearson_correlation,
  round(cluster_ordering,6) cluster_ordering, null::double rotation, round(abs(dc1-dc2),6) distance_consistency,
  round(abs(s1-s2),6) silhouette_coefficient, round(trustworthiness,6) trustworthiness, round(continuity,6) continuity,
  round(local_continuity,6) local_continuity, round(mrre_missing,6) mrre_missing, round(mrre_false,6) mrre_false,
  round(label_preservation,6) label_preservation
from local_ join gl using (s) join dc using (s) join co using (s) join si using (s)"""


@query("corpus_similarity", _SIM_SQL)
def corpus_similarity(spark, sf):
    return rounded(scores.corpus_similarity(jittered_spaces(spark, sf, [0.1, 0.25])))
