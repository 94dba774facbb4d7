"""Queries over comparison results. Every row of ``lineitem`` stands for one raw result row."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import rounded, table
from steadymap.functions import naming
from steadymap.plans import results
from steadymap.session import materialize, spread

_METRICS = ["spearman_correlation", "pearson_correlation", "cluster_ordering", "distance_consistency",
            "trustworthiness", "continuity", "local_continuity", "mrre_missing", "mrre_false",
            "label_preservation"]
_PRIMES = [7919, 6271, 5231, 4337, 3571, 2903, 2411, 1993, 1511, 1129]
_SHORT = ["bow", "tfidf", "lda", "lda_linear_combined", "lsi", "lsi_tfidf", "lsi_linear_combined_tfidf",
          "lsi_linear_combined", "nmf", "nmf_tfidf", "nmf_linear_combined", "nmf_linear_combined_tfidf",
          "bert_all_distilroberta_v1", "bert_all_mpnet_base_v2", "doc2vec"]


def _case(key, values):
    return f"case {key} " + " ".join(f"when {n} then '{v}'" for n, v in enumerate(values)) + " end"


_FAMILY = ["BOW", "BOW", "LDA", "LDA"] + ["LSI"] * 4 + ["NMF"] * 4 + [
    "bert_all_distilroberta_v1_n_categories_20", "bert_all_mpnet_base_v2_n_categories_20", "doc2vec_n_topics_20"]
# line 7 mirrors line 6 and line 5 repeats line 4; some rows are headers, self-pairs, wrong
# distances or pairs of two models, so that cleaning has something to remove
RAW_SQL = f"""
with a as (select l_orderkey o, l_linenumber n, l_suppkey s,
    case l_linenumber when 7 then 6 when 5 then 4 else l_linenumber end b from lineitem),
c as (select o, n, o * 8 + n as pos, {_case('o % 3', naming.DATASETS)} as dataset,
    {_case('o % 4', ['mds', 'som', 'tsne', 'umap'])} as dr,
    {_case('o % 12', ['mds', 'som0', 'tsne0', 'umap0', 'mds', 'som1', 'tsne1', 'umap1', 'mds', 'som0', 'tsne2', 'umap0'])} as config,
    (b + o) % 15 as m, case when o % 13 = 0 and b = 2 then (b + o + 1) % 15 else (b + o) % 15 end as m2,
    case when o % 17 = 0 and b = 1 then 0 else 1 end as step,
    case when s % 2 = 0 then 'cluster/run/' else '' end as prefix,
    case when o % 11 = 0 then 1 else 0 end as wrong, b from a),
d as (select c.*, {_case('m', _SHORT)} as tm, {_case('m2', _SHORT)} as tm2 from c),
e as (select d.*,
    tm || case when tm like 'bert%' then '_n_categories_20' when tm in ('bow', 'tfidf') then ''
      when tm like 'lda%' then case when o % 5 = 0 then '_n_topics_20_alpha_symmetric' else '_n_topics_20_alpha_auto' end
      else '_n_topics_20' end as t1,
    tm2 || case when tm2 like 'bert%' then '_n_categories_20' when tm2 in ('bow', 'tfidf') then ''
      when tm2 like 'lda%' then case when o % 5 = 0 then '_n_topics_20_alpha_symmetric' else '_n_topics_20_alpha_auto' end
      else '_n_topics_20' end as t2,
    case when dr = 'som' then case when wrong = 1 then '_jensenshannon' else '' end
      when (tm like 'lda%' and wrong = 0) or (not tm like 'lda%' and wrong = 1) then '_jensenshannon' else '_cosine' end as metric
    from d),
f as (select e.*, prefix || dataset || '/' || dr || '_' || dataset || '_' || t1 || '_' || cast(o as {{text}}) || metric || '.npy' as f1,
    prefix || dataset || '/' || dr || '_' || dataset || '_' || t2 || '_' || cast(o + step as {{text}}) || metric || '.npy' as f2 from e)
select pos, dataset, config, {_case('m', _FAMILY)} as short_tm_name, o % 5 as seed_1, o % 5 + 1 as seed_2,
  case when (o % 3) * 2 + (n % 2) < 2 then cast(0.0 as double) when (o % 3) * 2 + (n % 2) < 4 then cast(0.25 as double) else cast(0.1 as double) end as jitter_1,
  case when (o % 3) * 2 + (n % 2) < 2 then cast(0.1 as double) when (o % 3) * 2 + (n % 2) < 4 then cast(0.0 as double) else cast(0.25 as double) end as jitter_2,
  case when o % 97 = 0 and n = 3 then 'file_name_1' when n = 7 then f2 else f1 end as file_name_1,
  case when n = 7 then f1 else f2 end as file_name_2,
  {", ".join(f"((pos * {p} + 13) % 10007) / cast(10007 as double) as {m}" for m, p in zip(_METRICS, _PRIMES))}
from f"""
_RAW = "raw as (" + RAW_SQL.format(text="varchar") + ")"


def raw_results(spark, sf, *columns):
    """Every raw row; ``columns`` names those a query reads, where it carries not all of them through its steps."""
    sql = RAW_SQL.format(text="string").replace("from lineitem", "from {lineitem}")
    raw = spark.sql(sql, lineitem=spread(table(spark, sf, "lineitem"), "l_orderkey"))
    return materialize(raw.select(*columns) if columns else raw)


def _valid(f):
    has = lambda *ns: "(" + " or ".join(f"contains({f}, '{n}')" for n in ns) + ")"
    red = has("umap_", "tsne_", "mds_")
    return f"""case when {has('lda')} and {has('symmetric', 'asymmetric')} then false when {has('lda')} and {red} then {has('jensenshannon')}
 when {has('nmf')} and {red} then {has('cosine')} else not {has('jensenshannon')} end"""


def _rel(f):
    return f"substr({f}, strpos({f}, dataset))"


def _first(f, names):
    return "coalesce(" + ", ".join(f"case when contains({f}, '{n}') then '{n}' end" for n in names) + ", '')"


def _clean_cte(source, keys):
    """Relative names, first of every key, no mirrored rows."""
    return f"""
rel as (select * replace ({_rel('file_name_1')} as file_name_1, {_rel('file_name_2')} as file_name_2) from {source}),
ded as (select * exclude (k) from (select *, row_number() over (partition by {keys} order by pos) k from rel) where k = 1),
opp as (select dataset od, file_name_1 o1, file_name_2 o2, max(pos) mp from ded group by 1, 2, 3),
mir as (select * exclude (od, o1, o2, mp) from ded left join opp on od = dataset and o1 = file_name_2 and o2 = file_name_1
   where mp is null or mp < pos)"""


_HYPER = f"""{_RAW}, val as (select * from raw where {_valid('file_name_1')}),
{_clean_cte('val', 'dataset, config, short_tm_name, file_name_1, file_name_2')},
cl as (select * from mir where contains(file_name_1, translate(config, '012', '')) and contains(file_name_2, translate(config, '012', ''))
  and ((contains(file_name_1, lower(short_tm_name)) and contains(file_name_2, lower(short_tm_name)))
    or (short_tm_name = 'BOW' and contains(file_name_1, 'tfidf') and contains(file_name_2, 'tfidf'))))"""


def _seed_cte(extra="true"):
    return f"""{_RAW}, hd as (select * exclude (config) from raw where file_name_1 <> 'file_name_1' and {extra}),
prs as (select *, {_first('file_name_1', naming.REDUCTIONS)} config, {_first('file_name_1', naming.MODELS)} "TM",
   {_first('file_name_2', naming.REDUCTIONS)} d2, {_first('file_name_2', naming.MODELS)} t2 from hd),
val as (select * from prs where config = d2 and "TM" = t2 and config <> '' and "TM" <> '' and {_valid('file_name_1')}),
{_clean_cte('val', 'dataset, file_name_1, file_name_2')}"""


_SEED = _seed_cte()
_JITTER = _seed_cte("not (least(jitter_1, jitter_2) = 0.1 and greatest(jitter_1, jitter_2) = 0.25)")
_ABG = """(0.25::double*(trustworthiness+continuity+mrre_missing+mrre_false)+label_preservation+local_continuity)/3.0::double alpha,
 0.5::double*(0.5::double*(0.5::double*(pearson_correlation+1)+0.5::double*(spearman_correlation+1))+0.5::double*(cluster_ordering+1)) beta,
 1-distance_consistency gamma"""
_FAM = lambda c: f"""case when {c} in ('bow','tfidf') then 'BOW' when starts_with({c},'lda') then 'LDA' when starts_with({c},'lsi') then 'LSI'
 when starts_with({c},'nmf') then 'NMF' when starts_with({c},'bert') then 'BERT' when starts_with({c},'doc2vec') then 'Doc2Vec' else {c} end"""


@query("clean_hyperparameter", f"with {_HYPER} select pos, dataset, config, short_tm_name, file_name_1, file_name_2 from cl")
def clean_hyperparameter(spark, sf):
    return results.clean_hyperparameter(raw_results(spark, sf)).select(
        "pos", "dataset", "config", "short_tm_name", "file_name_1", "file_name_2")


@query("clean_seed", f"""with {_SEED} select pos, dataset, config, "TM", seed_1, seed_2, file_name_1, file_name_2 from mir""")
def clean_seed(spark, sf):
    return results.clean_seed(raw_results(spark, sf)).select(
        "pos", "dataset", "config", "TM", "seed_1", "seed_2", "file_name_1", "file_name_2")


@query("clean_jitter", f"""with {_JITTER} select pos, dataset, config, "TM", jitter_1, jitter_2, file_name_1, file_name_2 from mir""")
def clean_jitter(spark, sf):
    return results.clean_jitter(raw_results(spark, sf)).select(
        "pos", "dataset", "config", "TM", "jitter_1", "jitter_2", "file_name_1", "file_name_2")


@query("mirror_dedupe", f"""with {_RAW}, hd as (select * from raw where file_name_1 <> 'file_name_1'), {_clean_cte('hd', 'dataset, file_name_1, file_name_2')}
select pos, file_name_1, file_name_2 from mir""")
def mirror_dedupe(spark, sf):
    rows = results.relative_names(results.drop_headers(raw_results(spark, sf)))
    rows = results.keep_first(rows, ["dataset", "file_name_1", "file_name_2"])
    return results.drop_mirrored(rows).select("pos", "file_name_1", "file_name_2")


@query("unify_results", f"""with {_RAW}
select pos, dataset, file_name_1, file_name_2, note from (select pos, dataset, file_name_1, file_name_2, case when dataset = 'lyrics' then 'late' end note,
  row_number() over (partition by file_name_1, file_name_2 order by pos) k from raw) where k = 1""")
def unify_results(spark, sf):
    raw = raw_results(spark, sf).select("pos", "dataset", "file_name_1", "file_name_2")
    parts = [raw.filter(F.col("dataset") == d) for d in naming.DATASETS]
    parts[1] = parts[1].withColumn("note", F.lit("late"))
    done = raw.withColumn("TM", F.lit("done"))
    return results.unify([*parts, done], ["file_name_1", "file_name_2"])


@query("score_tables", f"""with {_SEED}, sc as (select pos, dataset, config, {_FAM('"TM"')} "TM", {_ABG} from mir)
select dataset, config, "TM", count(*)::bigint as rows_, round(avg(alpha), 6) alpha, round(avg(beta), 6) beta, round(avg(gamma), 6) gamma
from sc group by 1, 2, 3""")
def score_tables(spark, sf):
    scored = results.score_table(results.clean_seed(raw_results(spark, sf)))
    return rounded(scored.groupBy("dataset", "config", "TM").agg(
        F.count("*").alias("rows_"), *[F.avg(s).alias(s) for s in ("alpha", "beta", "gamma")]))


_LEVEL = f"""lv as (select dataset, greatest(jitter_1, jitter_2) high, {', '.join(f'avg({m}) {m}' for m in _METRICS)} from raw group by 1, 2),
ls as (select dataset, high, {_ABG} from lv),
ss as (select pos, dataset, config, "TM", least(jitter_1, jitter_2) low, greatest(jitter_1, jitter_2) high, {_ABG} from mir)"""


@query("jitter_adjust", f"""with {_JITTER}, {_LEVEL}
select pos, ss.dataset, config, {_FAM('"TM"')} "TM", low, ss.high, round(1-abs(ss.alpha-ls.alpha), 6) alpha_adjust,
 round(1-abs(ss.beta-ls.beta), 6) beta_adjust, round(1-abs(ss.gamma-ls.gamma), 6) gamma_adjust
from ss join ls on ls.dataset = ss.dataset and ls.high = ss.high""")
def jitter_adjust(spark, sf):
    raw = raw_results(spark, sf)
    level = raw.groupBy("dataset", F.greatest("jitter_1", "jitter_2").alias("jitter_2")).agg(
        *[F.avg(m).alias(m) for m in _METRICS])
    out = results.adjust_for_jitter(results.clean_jitter(raw), level)
    return rounded(out.select("pos", "dataset", "config", naming.family(F.col("TM")).alias("TM"), "low", "high",
                              "alpha_adjust", "beta_adjust", "gamma_adjust"))


def _values(configs, models):
    return ", ".join(f"('{c}', '{m}', {n * f})" for c, n in configs.items() for m, f in models.items())


def _coverage_sql(cte, source, configs, models, match):
    return f"""with {cte}, ex(config, "TM", expected) as (values {_values(configs, models)}),
ct as (select ex.config, ex."TM", any_value(expected) expected, count(c.pos) present from ex left join {source} c
  on c.config = ex.config and {match} group by 1, 2)
select config, "TM", sum(present)::bigint present, sum(expected)::bigint expected, round(100.0::double*sum(present)/sum(expected), 6) percent
from ct group by grouping sets ((config, "TM"), ())"""


@query("coverage", _coverage_sql(_HYPER, "cl", results.EXPECTED_2, results.FAMILY_FACTOR, 'contains(c.short_tm_name, ex."TM")'))
def coverage(spark, sf):
    rows = results.clean_hyperparameter(raw_results(spark, sf))
    return rounded(results.coverage(rows, results.EXPECTED_2, results.FAMILY_FACTOR, "short_tm_name", True))


_ALL_MODELS = dict.fromkeys(naming.MODELS, 1)


@query("coverage_by_model", _coverage_sql(_SEED, "mir", results.EXPECTED_3, _ALL_MODELS, 'c."TM" = ex."TM"'))
def coverage_by_model(spark, sf):
    # the first row of a pair is kept whole, so what is not counted must not come along
    raw = raw_results(spark, sf, "pos", "dataset", "file_name_1", "file_name_2")
    return rounded(results.coverage(results.clean_seed(raw), results.EXPECTED_3, _ALL_MODELS))


@query("missing_configs", f"""with {_RAW} select c config from (select unnest(['mds','som0','som1','umap0','umap1','tsne0','tsne1','tsne2','som9']) c)
where c not in (select config from raw)""")
def missing_configs(spark, sf):
    return results.missing_configs(raw_results(spark, sf), [*results.EXPECTED_2, "som9"])


def _partner_sql(treatment, f):
    has = lambda n: f"contains({f}, '{n}')"
    swap = lambda a, b: f"replace({f}, '{a}', '{b}')"
    if treatment == "tfidf":
        return f"""case when {has('tfidf')} then null when {has('bow')} then {swap('bow', 'tfidf')}
 when {has('lsi_linear_combined')} then {swap('lsi_linear_combined', 'lsi_linear_combined_tfidf')} when {has('lsi')} then {swap('lsi', 'lsi_tfidf')}
 when {has('nmf_linear_combined')} then {swap('nmf_linear_combined', 'nmf_linear_combined_tfidf')} when {has('nmf')} then {swap('nmf', 'nmf_tfidf')} end"""
    return f"""case when {has('linear_combined')} then null when {has('lda')} then {swap('lda', 'lda_linear_combined')}
 when {has('lsi_tfidf')} then {swap('lsi_tfidf', 'lsi_linear_combined_tfidf')} when {has('lsi_n')} then {swap('lsi_n', 'lsi_linear_combined_n')}
 when {has('nmf_tfidf')} then {swap('nmf_tfidf', 'nmf_linear_combined_tfidf')} when {has('nmf_n')} then {swap('nmf_n', 'nmf_linear_combined_n')} end"""


def _sign_sql(treatment, models):
    tail = lambda s: f"""(select sum(round(exp(lgamma(samples+1)-lgamma(k+1)-lgamma(samples-k+1)))) / power(2.0, samples) from (select unnest(range(n_{s}, samples+1)) k))"""
    return f"""with {_SEED}, sc as (select dataset, config, file_name_1, file_name_2, {_ABG} from mir),
bs as (select *, {_partner_sql(treatment, 'file_name_1')} k1, {_partner_sql(treatment, 'file_name_2')} k2, {_first('file_name_1', models)} model from sc),
tr as (select dataset, file_name_1 k1, file_name_2 k2, any_value(alpha) ta, any_value(beta) tb, any_value(gamma) tg from sc group by 1,2,3 having count(*) = 1),
im as (select model, config reduction, count(*) samples, count(*) filter (ta>alpha) n_alpha, count(*) filter (tb>beta) n_beta, count(*) filter (tg>gamma) n_gamma
  from bs join tr using (dataset, k1, k2) where model <> '' group by 1, 2)
select model, reduction, samples, n_alpha, n_beta, n_gamma, round({tail('alpha')}, 6) p_alpha, round({tail('beta')}, 6) p_beta, round({tail('gamma')}, 6) p_gamma from im"""


@query("sign_test_tfidf", _sign_sql("tfidf", ["bow", "lsi", "nmf"]))
def sign_test_tfidf(spark, sf):
    rows = results.combined_scores(results.clean_seed(raw_results(spark, sf)))
    return rounded(results.sign_tests(rows, "tfidf"))


@query("sign_test_linear", _sign_sql("linear_combined", ["lda", "lsi", "nmf"]))
def sign_test_linear(spark, sf):
    rows = results.combined_scores(results.clean_seed(raw_results(spark, sf)))
    return rounded(results.sign_tests(rows, "linear_combined"))


@query("example_selection", f"""with {_SEED} select pos, file_name_1, file_name_2, round(trustworthiness, 6) trustworthiness from mir
where dataset = 'lyrics' and config = 'som' and "TM" = 'bow' order by trustworthiness desc, pos limit 1 offset 2""")
def example_selection(spark, sf):
    rows = results.clean_seed(raw_results(spark, sf))
    one = results.nth_example(rows, {"dataset": "lyrics", "config": "som", "TM": "bow"},
                              [F.desc("trustworthiness"), "pos"], 3)
    return rounded(one.select("pos", "file_name_1", "file_name_2", "trustworthiness"))


@query("name_functions", f"""with {_RAW}
select pos, {_rel('file_name_1')} relative, coalesce(nullif(array_to_string(list_slice(string_split(file_name_2, '_'), 1, greatest(len(string_split(file_name_2, '_')) - 2, 0)), '_'), ''), '') identifier,
  {_FAM(_first('file_name_2', naming.MODELS))} family, {_first('file_name_2', naming.DATASETS[::-1])} named_dataset,
  case when length(file_name_2) >= 60 then substr(file_name_2, 1, 35) || '_' || substr(sha256(file_name_2), 1, 15) || '.csv' else file_name_2 end shortened,
  config || '_' || seed_1 || '_' || seed_2 as evaluation_key
from raw where file_name_1 <> 'file_name_1'""")
def name_functions(spark, sf):
    f2 = F.col("file_name_2")
    return results.drop_headers(raw_results(spark, sf)).select(
        "pos", naming.relative_path(F.col("file_name_1"), F.col("dataset")).alias("relative"),
        naming.identifier(f2).alias("identifier"),
        naming.family(naming.model_reduction(f2)[1]).alias("family"),
        naming.dataset_of(f2).alias("named_dataset"), naming.shortened(f2, 70, 10).alias("shortened"),
        naming.evaluation_key(F.col("config"), F.col("seed_1").cast("string"), F.col("seed_2").cast("string")).alias("evaluation_key"))


@query("parse_values", """
select l_orderkey o, l_linenumber n, case lower(l_returnflag) when 'n' then false when 'y' then true when 't' then true when 'f' then false end flag,
  case when l_linestatus = 'O' then l_quantity::double end number, case when l_linestatus <> 'O' then 'auto' end word from lineitem""")
def parse_values(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).otherwise("auto")
    parsed = naming.number_or_word(text)
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
                     naming.as_flag(F.col("l_returnflag")).alias("flag"),
                     parsed["number"].alias("number"), parsed["word"].alias("word"))
