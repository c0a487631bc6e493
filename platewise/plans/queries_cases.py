"""Case selection and pathway enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import enrichment as E
from platewise.operators import profiles as P
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte, mix_sql
from platewise.plans.queries_models import case_table
from platewise.session import cut_lineage

SOURCES = {"target": "l_returnflag = 'R'", "reference": "l_returnflag = 'N'", "prediction": "l_linestatus = 'O'"}
cte("gene_map", "SELECT p_partkey, CASE WHEN p_size % 17 = 0 THEN NULL ELSE concat('G', p_partkey // 2) END AS symbol FROM part")
cte("part_scores", " UNION ALL ".join(
    f"SELECT '{n}' AS profile, l_partkey AS p_partkey, round(avg(l_quantity) FILTER ({c}) - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS score FROM lineitem GROUP BY l_partkey"
    for n, c in SOURCES.items()))
cte("collapsed", """
SELECT profile, symbol, arg_max(score, (abs(score), score)) AS score FROM part_scores JOIN gene_map USING (p_partkey) WHERE symbol IS NOT NULL AND score IS NOT NULL GROUP BY ALL
""")
cte("ranked", """
SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY profile) AS n_genes FROM collapsed
""")
cte("gene_sets", """
SELECT DISTINCT 'brand' AS collection, concat(p_brand, '_', p_partkey // 2000) AS term, symbol FROM part JOIN gene_map USING (p_partkey) WHERE symbol IS NOT NULL
UNION ALL SELECT DISTINCT 'type', concat(p_type, '_', p_partkey // 2000), symbol FROM part JOIN gene_map USING (p_partkey) WHERE symbol IS NOT NULL
""")
cte("set_hits", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY profile, collection, term) AS set_size FROM ranked JOIN gene_sets USING (symbol)) WHERE set_size BETWEEN 15 AND 500
""")
cte("es_runs", """
SELECT *, cum / tot - (rank - kth) / (n_genes - set_size)::DOUBLE AS after_, (cum - abs(score)) / tot - (rank - kth) / (n_genes - set_size)::DOUBLE AS before_ FROM
 (SELECT *, sum(abs(score)) OVER g AS tot, sum(abs(score)) OVER (g ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (g ORDER BY rank) AS kth FROM set_hits
  WINDOW g AS (PARTITION BY profile, collection, term))
""".replace("(g ORDER BY", "(PARTITION BY profile, collection, term ORDER BY").replace("OVER g AS", "OVER (PARTITION BY profile, collection, term) AS").replace("\n  WINDOW g AS (PARTITION BY profile, collection, term)", ""))
cte("es_table", """
SELECT profile, collection, term, CASE WHEN max(after_) >= -min(before_) THEN max(after_) ELSE min(before_) END AS es, max(set_size) AS set_size,
 arg_max(rank, (round(after_, 12), -rank)) AS peak_up, arg_min(rank, (round(before_, 12), rank)) AS peak_down FROM es_runs GROUP BY ALL
""")
PERMUTATIONS, SEED = 5000, 42
cte("permutations", f"SELECT perm, {mix_sql(f'((perm * 2654435769 + {SEED}) & 4294967295)')} AS own FROM (SELECT range::UBIGINT AS perm FROM range({PERMUTATIONS}))")
cte("dealt", f"""
SELECT profile, perm, rank, row_number() OVER (PARTITION BY profile, perm ORDER BY k) AS pos FROM
 (SELECT profile, perm, rank, {mix_sql('xor(k, own)')} AS k FROM (SELECT profile, perm, rank, own, {mix_sql('((rank - 1 + own) & 4294967295)')} AS k FROM (SELECT profile, rank::UBIGINT AS rank FROM ranked), permutations))
""")
cte("null_hits", """
SELECT profile, collection, term, perm, pos, abs(w.score) AS w, set_size, w.n_genes FROM dealt d JOIN set_hits h USING (profile, rank) JOIN (SELECT profile, rank AS pos, score, n_genes FROM ranked) w USING (profile, pos)
""")
cte("null_es", """
SELECT profile, collection, term, perm, CASE WHEN max(a) >= -min(b) THEN max(a) ELSE min(b) END AS es0 FROM
 (SELECT *, cum / tot - (pos - kth) / (n_genes - set_size)::DOUBLE AS a, (cum - w) / tot - (pos - kth) / (n_genes - set_size)::DOUBLE AS b FROM
 (SELECT *, sum(w) OVER (PARTITION BY profile, collection, term, perm) AS tot, sum(w) OVER (PARTITION BY profile, collection, term, perm ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum,
  row_number() OVER (PARTITION BY profile, collection, term, perm ORDER BY pos) AS kth FROM null_hits)) GROUP BY ALL
""")
cte("null_means", """
SELECT profile, collection, term, any_value(e.es) AS es, any_value(e.set_size) AS set_size, avg(es0) FILTER (es0 >= 0) AS m_up, -avg(es0) FILTER (es0 < 0) AS m_down,
 count(*) FILTER (sign(es0) = sign(e.es) AND abs(es0) >= abs(e.es)) / nullif(count(*) FILTER (sign(es0) = sign(e.es)), 0)::DOUBLE AS nominal_p FROM null_es JOIN es_table e USING (profile, collection, term) GROUP BY ALL
""")
cte("normed", "SELECT *, es / CASE WHEN es >= 0 THEN m_up ELSE m_down END AS nes FROM null_means")
cte("null_nes", "SELECT profile, collection, perm, es0 / CASE WHEN es0 >= 0 THEN m_up ELSE m_down END AS nes0 FROM null_es JOIN normed USING (profile, collection, term) WHERE nes IS NOT NULL")
cte("null_share", """
SELECT profile, collection, term, count(*) FILTER (nes0 >= 0 AND nes >= 0 AND nes0 >= nes OR nes0 < 0 AND nes < 0 AND nes0 <= nes) / nullif(count(*) FILTER ((nes0 >= 0) = (nes >= 0)), 0)::DOUBLE AS share
 FROM normed JOIN null_nes USING (profile, collection) WHERE nes IS NOT NULL GROUP BY ALL
""")
cte("seen_share", """
SELECT a.profile, a.collection, a.term, count(*) FILTER (abs(b.nes) >= abs(a.nes)) / count(*)::DOUBLE AS share FROM normed a JOIN normed b ON a.profile = b.profile AND a.collection = b.collection AND (a.nes >= 0) = (b.nes >= 0) GROUP BY ALL
""")
cte("extremes", "SELECT profile, collection, perm, max(nes0) AS top, min(nes0) AS bottom FROM null_nes GROUP BY ALL")
cte("family", "SELECT profile, collection, term, avg(CASE WHEN nes >= 0 THEN top >= nes ELSE bottom <= nes END::INT) AS fwer_p FROM normed JOIN extremes USING (profile, collection) WHERE nes IS NOT NULL GROUP BY ALL")
cte("enriched", """
SELECT n.profile, n.collection, n.term, n.set_size, n.es, n.nes, n.nominal_p, least(1, o.share / s.share) AS fdr_q, f.fwer_p FROM normed n LEFT JOIN null_share o USING (profile, collection, term)
 LEFT JOIN seen_share s USING (profile, collection, term) LEFT JOIN family f USING (profile, collection, term)
""")
cte("edges", """
SELECT h.profile, h.collection, h.term, string_agg(symbol, ';' ORDER BY rank) AS leading_edge_genes, count(*) AS n_edge FROM set_hits h JOIN es_table e USING (profile, collection, term)
WHERE CASE WHEN es >= 0 THEN rank <= peak_up ELSE rank >= peak_down END GROUP BY ALL
""")
cte("compared", """
WITH w AS (SELECT collection, term, max(nes) FILTER (profile = 'target') AS target_nes, max(nes) FILTER (profile = 'reference') AS reference_nes, max(nes) FILTER (profile = 'prediction') AS prediction_nes,
 max(fdr_q) FILTER (profile = 'target') AS target_fdr FROM enriched GROUP BY ALL)
SELECT *, abs(reference_nes - target_nes) AS reference_abs_delta, abs(prediction_nes - target_nes) AS prediction_abs_delta, target_fdr < 0.05 AS significant,
 CASE WHEN target_fdr < 0.05 THEN sign(reference_nes) = sign(target_nes) END AS reference_sign_agrees, CASE WHEN target_fdr < 0.05 THEN sign(prediction_nes) = sign(target_nes) END AS prediction_sign_agrees,
 target_fdr < 0.05 AND (sign(reference_nes) <> sign(target_nes) OR abs(reference_nes - target_nes) >= 1) AS target_specific
FROM w WHERE target_nes IS NOT NULL AND reference_nes IS NOT NULL AND prediction_nes IS NOT NULL
""")


def gene_map(t: Tables):
    return t.part.select("p_partkey", F.when(F.col("p_size") % 17 != 0, F.concat(F.lit("G"), F.expr("p_partkey div 2"))).alias("symbol"))


def part_scores(t: Tables):
    """Score of every part in three profiles, one pass over the measurements."""
    base = F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")))
    means = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        *[F.round(F.avg(F.when(F.expr(c), F.col("l_quantity"))) - base, 6).alias(n) for n, c in SOURCES.items()])
    return means.unpivot(["p_partkey"], list(SOURCES), "profile", "score")


def ranked(t: Tables):
    return E.ranked_list(E.collapse_ranking(part_scores(t).join(gene_map(t), "p_partkey"), ["profile"]), ["profile"])


def gene_sets(t: Tables):
    g = t.part.join(gene_map(t), "p_partkey").filter("symbol is not null")
    chunk = F.expr("p_partkey div 2000")
    one = lambda n, c: g.select(F.lit(n).alias("collection"), F.concat_ws("_", c, chunk.cast("string")).alias("term"), "symbol").distinct()
    return one("brand", "p_brand").unionByName(one("type", "p_type"))


def enriched(t: Tables):
    """Permutation test of all sets in all profiles."""
    return E.permutation_test(cut_lineage(ranked(t)), gene_sets(t), ["profile"], PERMUTATIONS, SEED)


def compared(t: Tables):
    return E.compare_pathways(enriched(t))


def edges(t: Tables):
    hits = cut_lineage(E.hits_of(ranked(t), gene_sets(t), ["profile"]))
    return E.leading_edge(hits, E.enrichment_scores(hits, ["profile"]), ["profile"])


@query("q_align_check", """
WITH a AS (SELECT vec_id, embedding FROM embeddings), b AS (SELECT vec_id + 3 AS vec_id, list_transform(embedding::DOUBLE[], lambda x: x + 0.0001::DOUBLE) AS e2 FROM embeddings)
SELECT (SELECT count(*) FROM a JOIN b USING (vec_id)) AS n_matched, 3 AS n_only_a, 3 AS n_only_b, 0 AS n_repeated,
 (SELECT max(list_max(list_transform(list_zip(embedding::DOUBLE[], e2), lambda p: abs(p[1] - p[2])))) FROM a JOIN b USING (vec_id)) AS max_abs_diff
""", "max_abs_diff")
def align_check(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e1"))
    return E.aligned(e, e.select((F.col("vec_id") + 3).alias("vec_id"), F.transform("e1", lambda x: x + 0.0001).alias("e2")), ["vec_id"], "e1", "e2")


@query("q_percentile_scores", """
WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0::DOUBLE AS r,
 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, r / (n - 1) AS high, 1 - r / (n - 1) AS low FROM r
""", "high low")
def percentile_scores(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = E.percentile_score(o, "o_totalprice", "high", True, ["o_orderstatus"])
    return s.select("o_orderkey", "o_orderstatus", "high", (1 - F.col("high")).alias("low"))


cte("shortlist", """
WITH s AS (SELECT * REPLACE (round(reference_target_pearson, 9) AS reference_target_pearson, round(prediction_target_pearson, 9) AS prediction_target_pearson, round(pearson_gain, 9) AS pearson_gain) FROM case_scores),
l AS (SELECT quantile_cont(target_norm, 0.5) AS norm_median, quantile_cont(reference_target_pearson, 0.1) AS ref_q10, quantile_cont(prediction_target_pearson, 0.9) AS pred_q90 FROM s),
e AS (SELECT * FROM s, l WHERE target_norm >= norm_median),
p AS (SELECT *, 1 - (rank() OVER (ORDER BY reference_target_pearson) - 1 + (count(*) OVER (PARTITION BY reference_target_pearson) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS divergence_percentile,
 (rank() OVER (ORDER BY prediction_target_pearson) - 1 + (count(*) OVER (PARTITION BY prediction_target_pearson) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS prediction_percentile,
 (rank() OVER (ORDER BY pearson_gain) - 1 + (count(*) OVER (PARTITION BY pearson_gain) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS gain_percentile FROM e),
m AS (SELECT *, least(divergence_percentile, prediction_percentile, gain_percentile) AS maximin_score FROM p)
SELECT *, row_number() OVER (ORDER BY maximin_score DESC, pearson_gain DESC, prediction_target_pearson DESC, reference_target_pearson, target_norm DESC) AS objective_rank,
 reference_target_pearson <= ref_q10 AND prediction_target_pearson >= pred_q90 AS meets_strict_rule FROM m
""")


def rounded_cases(t: Tables):
    c = ["reference_target_pearson", "prediction_target_pearson", "pearson_gain"]
    return case_table(t).withColumns({n: F.round(n, 9) for n in c})


def shortlist(t: Tables):
    return E.rank_cases(cut_lineage(rounded_cases(t)), 10)


@query("q_case_ranking", """
SELECT concat('case_', lpad(objective_rank::VARCHAR, 2, '0')) AS case_id, objective_rank, cell_line, sample, maximin_score, pearson_gain, meets_strict_rule FROM shortlist WHERE objective_rank <= 10
""", "maximin_score pearson_gain")
def case_ranking(t):
    return shortlist(t).select("case_id", "objective_rank", "cell_line", "sample", "maximin_score", "pearson_gain", "meets_strict_rule")


@query("q_strict_count", """
SELECT count(*) FILTER (meets_strict_rule) AS n_strict, (SELECT count(*) FROM case_scores) AS n_cases FROM shortlist
""")
def strict_count(t):
    return E.strict_count(cut_lineage(rounded_cases(t)))


@query("q_case_profiles", """
SELECT b.gene_idx, """ + ", ".join(f"max({v}) FILTER (objective_rank = {k}) AS case_{k:02d}_{n}" for k in (1, 2, 3) for n, v in (("target", "y"), ("reference", "ref"), ("prediction", "yhat")))
       + " FROM bundle_long b JOIN shortlist USING (cell_line, sample) WHERE objective_rank <= 3 GROUP BY 1",
       " ".join(f"case_{k:02d}_{n}" for k in (1, 2, 3) for n in ("target", "reference", "prediction")))
def case_profiles(t):
    b = cut_lineage(I.bundle(t).filter("split = 'test'"))
    c = ["reference_target_pearson", "prediction_target_pearson", "pearson_gain"]
    from platewise.operators.scoring import case_metrics
    top = E.rank_cases(cut_lineage(case_metrics(b.drop("plate", "split")).withColumns({n: F.round(n, 9) for n in c})), 3)
    v = F.posexplode(F.arrays_zip(F.col("y").alias("target"), F.col("ref").alias("reference"), F.col("yhat").alias("prediction"))).alias("gene_idx", "v")
    long = b.join(top.select("cell_line", "sample", "case_id"), ["cell_line", "sample"]).select("case_id", v)
    return long.groupBy("gene_idx").pivot("case_id", ["case_01", "case_02", "case_03"]).agg(*[F.first(f"v.{n}").alias(n) for n in ("target", "reference", "prediction")])


@query("q_annotate_cases", """
SELECT o_orderkey, c_name, n_name, names FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), ';') AS names FROM nation GROUP BY 1) r ON r.n_regionkey = nation.n_regionkey
""")
def annotate_cases(t):
    from platewise.functions.text import unique_join
    names = t.nation.groupBy("n_regionkey").agg(unique_join(F.col("n_name")).alias("names"))
    ann = E.annotate_unique(t.nation, names, "n_regionkey").select("n_nationkey", "n_name", "names")
    cust = t.customer.join(ann, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name", "names")
    return E.annotate_unique(t.orders.select("o_orderkey", "o_custkey"), cust, "o_custkey").drop("o_custkey")


@query("q_map_report", """
WITH raw AS (SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN '  ' WHEN p_size % 5 = 0 THEN concat(' ', lower(symbol)) ELSE symbol END AS symbol FROM gene_map JOIN part USING (p_partkey)),
m AS (SELECT profile, symbol, nullif(upper(trim(symbol)), '') AS s FROM part_scores LEFT JOIN raw USING (p_partkey)), c AS (SELECT *, count(s) OVER (PARTITION BY profile, s) AS k FROM m)
SELECT profile, count(*) AS n_ids, count(s) AS n_mapped, count(*) - count(symbol) AS n_unmapped, count(DISTINCT s) AS n_symbols, count(*) FILTER (k > 1) AS n_duplicate_rows FROM c GROUP BY 1
""")
def map_report(t):
    """Symbols as an annotation file has them: some blank, some in lower case with a space before."""
    raw = gene_map(t).join(t.part.select("p_partkey", "p_size"), "p_partkey").select(
        "p_partkey", F.when(F.col("p_size") % 13 == 0, "  ").when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), F.lower("symbol"))).otherwise(F.col("symbol")).alias("symbol"))
    return E.mapping_report(part_scores(t).join(raw, "p_partkey", "left"), "symbol", ["profile"])


@query("q_collapse_ranking", "SELECT profile, symbol, score, rank FROM ranked", "score")
def collapse_ranking(t):
    return ranked(t).select("profile", "symbol", "score", "rank")


@query("q_gsea_es", "SELECT profile, collection, term, es, set_size FROM es_table", "es")
def gsea_es(t):
    return E.enrichment_scores(E.hits_of(ranked(t), gene_sets(t), ["profile"]), ["profile"]).drop("peak_up", "peak_down")


@query("q_gsea_edge", "SELECT profile, collection, term, leading_edge_genes, n_edge FROM edges")
def gsea_edge(t):
    return edges(t)


@query("q_gsea_nes", "SELECT profile, collection, term, set_size, es, nes, nominal_p, fdr_q, fwer_p FROM enriched", "es nes nominal_p fdr_q fwer_p")
def gsea_nes(t):
    return enriched(t)


COMPARE = "target_nes reference_nes prediction_nes reference_abs_delta prediction_abs_delta"


@query("q_pathway_compare", f"SELECT collection, term, {COMPARE.replace(' ', ', ')}, significant, reference_sign_agrees, prediction_sign_agrees, target_specific FROM compared", COMPARE)
def pathway_compare(t):
    return compared(t).select("collection", "term", *COMPARE.split(), "significant", "reference_sign_agrees", "prediction_sign_agrees", "target_specific")


@query("q_target_specific", "SELECT collection, term, reference_abs_delta - prediction_abs_delta AS error_reduction FROM compared WHERE target_specific", "error_reduction")
def target_specific(t):
    return E.target_specific_list(compared(t)).select("collection", "term", "error_reduction")


@query("q_leading_edge_genes", """
SELECT profile, collection, term, symbol, rank, score FROM (SELECT profile, collection, term, unnest(string_split(leading_edge_genes, ';')) AS symbol FROM edges) JOIN ranked USING (profile, symbol)
""", "score")
def leading_edge_genes(t):
    return E.leading_edge_genes(edges(t), ranked(t), ["profile"])


_rk = "rank() OVER (PARTITION BY scope ORDER BY {c}) + (count(*) OVER (PARTITION BY scope, {c}) - 1) / 2.0::DOUBLE"


@query("q_pathway_concordance", f"""
WITH s AS (SELECT 'all' AS scope, * FROM compared UNION ALL SELECT collection, * FROM compared),
r AS (SELECT *, {_rk.format(c='target_nes')} AS rt, {_rk.format(c='reference_nes')} AS rr, {_rk.format(c='prediction_nes')} AS rp FROM s)
SELECT scope, count(*) AS n_sets, count(*) FILTER (significant) AS n_significant, count(*) FILTER (target_specific) AS n_target_specific,
 avg(reference_sign_agrees::INT) AS reference_agreement, avg(prediction_sign_agrees::INT) AS prediction_agreement, corr(rr, rt) AS reference_spearman, corr(rp, rt) AS prediction_spearman,
 avg(reference_abs_delta) AS reference_mae, avg(prediction_abs_delta) AS prediction_mae FROM r GROUP BY 1
""", "reference_agreement prediction_agreement reference_spearman prediction_spearman reference_mae prediction_mae")
def pathway_concordance(t):
    return E.pathway_summary(cut_lineage(compared(t)))


@query("q_gene_modules", """
WITH m AS (SELECT DISTINCT term, unnest(string_split(leading_edge_genes, ';')) AS symbol FROM edges WHERE profile = 'target'),
w AS (SELECT term, symbol, max(score) FILTER (profile = 'target') AS target, max(score) FILTER (profile = 'reference') AS reference, max(score) FILTER (profile = 'prediction') AS prediction
 FROM collapsed JOIN m USING (symbol) GROUP BY ALL HAVING target IS NOT NULL AND reference IS NOT NULL AND prediction IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY target DESC, symbol) AS gene_order FROM w)
UNPIVOT o ON target, reference, prediction INTO NAME profile VALUE score
""", "score")
def gene_modules(t):
    genes = edges(t).filter("profile = 'target'").select("term", F.explode(F.split("leading_edge_genes", ";")).alias("symbol"))
    return E.gene_modules(ranked(t).select("profile", "symbol", "score"), genes, ["target", "reference", "prediction"])


@query("q_candidate_union", """
WITH c AS (SELECT term, error, NULL AS nes, 'candidate' AS record_type FROM (SELECT term, reference_abs_delta AS error FROM compared WHERE target_specific)
 UNION ALL SELECT term, NULL, nes, 'enrichment' FROM enriched WHERE profile = 'target' AND nes > 0)
SELECT c.*, term IN (SELECT term FROM enriched WHERE profile = 'target' AND nes > 0) AS has_enrichment FROM c
""", "error nes")
def candidate_union(t):
    e = cut_lineage(enriched(t))
    c = E.compare_pathways(e).filter("target_specific").select("term", F.col("reference_abs_delta").alias("error"))
    return E.candidate_union(c, e.filter("profile = 'target' and nes > 0").select("term", "nes"), "term")
