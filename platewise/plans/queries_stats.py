"""Resampling, tests, regressions, variance partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions import text as X
from platewise.operators import statistics as S
from platewise.operators import summaries as M
from platewise.plans import inputs as I
from platewise.plans.catalog import Tables, query
from platewise.plans.oracle import cte, mix_sql
from platewise.plans.queries_pairs import SAR_REPRESENTATIONS, sar_rows
from platewise.session import cut_lineage, written

OBS = ["cell_line", "drug", "smiles", "dose", "time"]
BOOT = S.N_BOOT


def boot_sql(src: str, by: str, value: str, unit: str, boot: int = BOOT, extra: str = "") -> str:
    """Poisson bootstrap in SQL: same keys, same integer mixing."""
    cdf = " + ".join(f"(u >= {c}::DOUBLE)::INT" for c in S.POISSON_CDF)
    pre = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    rounds = lambda a, b: f"(xor({a}, {a} >> 16) * 73244475) & 4294967295 AS {b}"
    return f"""u0 AS (SELECT {pre}{value} AS x, md5(concat_ws('|', '0', {unit})) AS key FROM {src} WHERE {value} IS NOT NULL),
u1 AS (SELECT * EXCLUDE (key), ('0x' || substr(key, 1, 8))::BIGINT AS h, (('0x' || substr(key, 9, 7))::BIGINT + b * 2654435769) & 4294967295 AS x0 FROM u0, (SELECT unnest(range(1, {boot} + 1)) AS b)),
v1 AS (SELECT *, {rounds('x0', 'x1')} FROM u1), v2 AS (SELECT * EXCLUDE (x0, x1), {rounds('x1', 'x2')} FROM v1), v3 AS (SELECT * EXCLUDE (x2), (h + xor(x2, x2 >> 16)) & 4294967295 AS y0 FROM v2),
u2 AS (SELECT * EXCLUDE (h, y0), {rounds('y0', 'y1')} FROM v3), u3 AS (SELECT * EXCLUDE (y1), {rounds('y1', 'y2')} FROM u2),
u4 AS (SELECT * EXCLUDE (y2), xor(y2, y2 >> 16) / 4294967296.0::DOUBLE AS u FROM u3), u5 AS (SELECT * EXCLUDE (u), {cdf} AS w FROM u4),
rp AS (SELECT {pre}b, sum(w * x) / sum(w) AS m FROM u5 WHERE w > 0 GROUP BY {pre}b),
bd AS (SELECT {pre}quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rp {grp}),
pt AS (SELECT {pre}avg(x) AS mean, count(*) AS n FROM u0 {grp})"""


def drawn_sql(by: str, boot: int = BOOT) -> str:
    """Draws of whole clusters from `cl` (by, c_, sums): same keys, same integer mixing as `statistics.drawn_positions`."""
    pre, group = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    key = f"md5(concat_ws('|', '0', {by or 0}))"
    return f"""nm AS (SELECT *, row_number() OVER ({group} ORDER BY c_) - 1 AS pos FROM cl),
gk AS (SELECT {pre}count(*)::UBIGINT AS k, ('0x' || substr({key}, 1, 8))::UBIGINT AS low, ('0x' || substr({key}, 9, 7))::UBIGINT AS high FROM cl {'GROUP BY ' + by if by else ''}),
go AS (SELECT {pre}b, k, high, {mix_sql('((b * 2654435769 + low) & 4294967295)')} AS own FROM gk, (SELECT unnest(range(1, {boot} + 1))::UBIGINT AS b)),
gd AS (SELECT {pre}b, k, high, {mix_sql('((i + own) & 4294967295)')} AS x FROM go, LATERAL (SELECT unnest(range(1, k::BIGINT + 1))::UBIGINT AS i)),
dr AS (SELECT {pre}b, ((({mix_sql('xor(x, high)')}) * k) >> 32)::BIGINT AS pos FROM gd)"""


def clus_sql(src: str, by: str, value: str, cluster: str, boot: int = BOOT) -> str:
    return f"""cl AS (SELECT {by}, {cluster} AS c_, sum({value}) AS s, count(*) AS c FROM {src} GROUP BY {by}, {cluster}),
{drawn_sql(by, boot)},
rp AS (SELECT {by}, b, sum(s) / sum(c) AS m FROM dr JOIN nm USING ({by}, pos) GROUP BY {by}, b),
bd AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rp GROUP BY {by}),
pt AS (SELECT {by}, sum(s) / sum(c) AS mean, sum(c)::BIGINT AS n, count(*) AS n_clusters FROM cl GROUP BY {by})"""


def normal_p(z: str) -> str:
    """Two-sided normal tail by the series of the error function; beyond 5.6 it is below the digits compared."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    term = f"pow(-1.0::DOUBLE, k) * pow({x}, 2 * k + 1) / (gamma(k + 1.0::DOUBLE) * (2 * k + 1))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 5.6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: {term})) END"


def student_p(t: str, v: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the density; beyond 60 it is below the digits compared (v >= 10)."""
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    area = f"list_sum(list_transform(range(0, 4001), lambda i: {weight} * pow(1 + pow(abs({t}) * i / 4000.0::DOUBLE, 2) / ({v}), -(({v}) + 1) / 2))) * abs({t}) / 12000.0::DOUBLE"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN abs({t}) > 60 THEN 0 ELSE greatest(0, 1 - 2 * exp(lgamma((({v}) + 1) / 2.0::DOUBLE) - lgamma(({v}) / 2.0::DOUBLE)) / sqrt(({v}) * pi()) * {area}) END")


def correlation_t(r: str, v: str) -> str:
    return f"CASE WHEN {r} * {r} < 1 THEN {r} * sqrt({v}) / sqrt(1 - {r} * {r}) END"


@query("q_bootstrap_ci", f"WITH {boot_sql('scores', 'arm', 'pearson', 'cell_line, drug, dose, time')} SELECT * FROM pt JOIN bd USING (arm)", "mean lo hi")
def bootstrap_ci(t):
    return S.bootstrap_mean(I.scores(t), ["arm"], "pearson", ["cell_line", "drug", "dose", "time"], BOOT)


@query("q_cluster_bootstrap", f"WITH {clus_sql('scores', 'arm', 'pearson', 'drug')} SELECT * FROM pt JOIN bd USING (arm)", "mean lo hi")
def cluster_bootstrap(t):
    return S.cluster_bootstrap_mean(I.scores(t), ["arm"], "pearson", "drug", BOOT)


cte("paired", """
SELECT cell_line, drug, smiles, dose, time, a.pearson AS a, b.pearson AS b, a.pearson - b.pearson AS d FROM (FROM scores WHERE arm = 'model') a
JOIN (FROM scores WHERE arm = 'reference') b USING (cell_line, drug, smiles, dose, time)
""")


def arms(t: Tables):
    s = I.scores(t)
    return s.filter("arm = 'model'"), s.filter("arm = 'reference'")


def paired(t: Tables):
    return S.paired_differences(*arms(t), OBS, "pearson")


def wilcoxon_sql(src: str, by: str, d: str = "d") -> str:
    pre = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""wr AS (SELECT {pre}{d} AS d, abs({d}) AS a, rank() OVER ({part} ORDER BY abs({d})) AS r0, count(*) OVER (PARTITION BY {pre}abs({d})) AS t FROM {src} WHERE {d} <> 0),
ws AS (SELECT {pre}count(*) AS n, sum(CASE WHEN d > 0 THEN r0 + (t - 1) / 2.0::DOUBLE ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r0 + (t - 1) / 2.0::DOUBLE ELSE 0 END) AS w_minus,
 sum(t * t - 1) AS ties FROM wr {"GROUP BY " + by if by else ""}),
wz AS (SELECT *, least(w_plus, w_minus) AS w, (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - ties / 48.0::DOUBLE) AS z FROM ws)"""


@query("q_wilcoxon", f"WITH r AS (SELECT dose, round(d, 9) AS d FROM paired), {wilcoxon_sql('r', 'dose')} SELECT dose, n, w_plus, w_minus, w, z, {normal_p('z')} AS p FROM wz", "w_plus w_minus w z p")
def wilcoxon(t):
    return S.wilcoxon(paired(t).withColumn("d", F.round("d", 9)), ["dose"])


@query("q_paired_delta", f"""
WITH {boot_sql('paired', 'dose', 'd', 'cell_line, drug, smiles, dose, time')}, r AS (SELECT dose, round(d, 9) AS d FROM paired), {wilcoxon_sql('r', 'dose')}
SELECT dose, m.mean_a, m.mean_b, pt.mean AS mean_diff, pt.n AS n_pairs, lo, hi, p
FROM pt JOIN bd USING (dose) JOIN (SELECT dose, avg(a) AS mean_a, avg(b) AS mean_b FROM paired GROUP BY 1) m USING (dose) LEFT JOIN (SELECT dose, {normal_p('z')} AS p FROM wz) USING (dose)
""", "mean_a mean_b mean_diff lo hi p")
def paired_delta(t):
    return S.paired_delta(*arms(t), OBS, "pearson", ["dose"], BOOT)


@query("q_spearman_ci", """
WITH r AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY rmse) + (count(*) OVER (PARTITION BY arm, rmse) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY arm ORDER BY pearson) + (count(*) OVER (PARTITION BY arm, pearson) - 1) / 2.0::DOUBLE AS ry FROM (SELECT * REPLACE (round(pearson, 9) AS pearson, round(rmse, 9) AS rmse) FROM scores)),
""" + boot_sql("scores", "arm", "pearson", "cell_line, drug, dose, time").split("rp AS")[0].replace("pearson AS x,", "round(rmse, 9) AS x, round(pearson, 9) AS y,") + """
rr AS (SELECT arm, b, w, sum(w) OVER (PARTITION BY arm, b ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (sum(w) OVER (PARTITION BY arm, b, x) - 1) / 2.0::DOUBLE AS rx,
 sum(w) OVER (PARTITION BY arm, b ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (sum(w) OVER (PARTITION BY arm, b, y) - 1) / 2.0::DOUBLE AS ry FROM u5 WHERE w > 0),
rm AS (SELECT arm, b, sum(w) AS n, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * rx) AS sxx, sum(w * ry * ry) AS syy, sum(w * rx * ry) AS sxy FROM rr GROUP BY ALL),
bb AS (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT arm, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS m FROM rm) GROUP BY 1)
SELECT *, """ + student_p(correlation_t("rho", "n - 2"), "n - 2") + """ AS p FROM (SELECT arm, corr(rx, ry) AS rho, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM r JOIN bb USING (arm) GROUP BY 1)
""", "rho lo hi p")
def spearman_ci(t):
    s = I.scores(t).withColumn("pearson", F.round("pearson", 9)).withColumn("rmse", F.round("rmse", 9))
    return S.spearman_test(s, ["arm"], "rmse", "pearson", BOOT, ["cell_line", "drug", "dose", "time"])


def line_boot_sql(boot: int = BOOT) -> str:
    """Slopes of resampled rows, from sums about the means of all rows."""
    return boot_sql("c", "arm", "x", "cell_line, drug, dose, time", boot).split("rp AS")[0].replace("x AS x,", "x, y,") + """
lr AS (SELECT arm, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS m FROM u5 GROUP BY arm, b),
lb AS (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM lr GROUP BY 1)"""


@query("q_linfit", f"""
WITH c AS (SELECT *, rmse - avg(rmse) OVER (PARTITION BY arm) AS x, pearson - avg(pearson) OVER (PARTITION BY arm) AS y FROM scores), {line_boot_sql()},
f AS (SELECT arm, count(*) AS n, regr_slope(pearson, rmse) AS slope, corr(pearson, rmse) AS r, regr_intercept(pearson, rmse) AS intercept FROM scores GROUP BY 1)
SELECT arm, n, slope, r, intercept, lo, hi, {student_p(correlation_t('r', 'n - 2'), 'n - 2')} AS p FROM f JOIN lb USING (arm)
""", "slope r intercept lo hi p")
def linfit(t):
    return S.line_fit(I.scores(t), ["arm"], "rmse", "pearson", ["cell_line", "drug", "dose", "time"])


@query("q_partial_spearman", """
WITH r AS (SELECT l_returnflag, """ + ", ".join(
    f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0::DOUBLE AS {n}"
    for c, n in (("l_quantity", "x"), ("l_extendedprice", "y"), ("l_discount", "c"), ("l_tax", "e"))) + """ FROM lineitem),
q AS (SELECT l_returnflag, count(*) AS n, corr(x, y) AS xy, corr(x, c) AS xc, corr(y, c) AS yc, corr(x, e) AS xe, corr(y, e) AS ye, corr(c, e) AS ce FROM r GROUP BY 1),
p AS (SELECT *, (xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)) AS a, (xe - xc * ce) / sqrt((1 - xc * xc) * (1 - ce * ce)) AS b, (ye - yc * ce) / sqrt((1 - yc * yc) * (1 - ce * ce)) AS d FROM q)
SELECT *, """ + student_p(correlation_t("rho", "n - 4"), "n - 4") + """ AS p FROM (SELECT l_returnflag, n, (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) AS rho FROM p)
""", "rho p")
def partial_spearman(t):
    return S.partial_spearman(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", ["l_discount", "l_tax"])


_ci = {"rmse": "v0", "pearson": "v1", "l2": "v2", "cosine": "v3"}
_pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def partial_sql(i: int, j: int, given: tuple[int, ...]) -> str:
    if not given:
        return f"c{min(i, j)}{max(i, j)}"
    k, rest = given[-1], given[:-1]
    a, b, d = partial_sql(i, j, rest), partial_sql(i, k, rest), partial_sql(j, k, rest)
    return f"(({a} - {b} * {d}) / sqrt((1 - {b} * {b}) * (1 - {d} * {d})))"


def ranks_sql(weight: str, by: str) -> str:
    """Average ranks r0 .. r3 of v0 .. v3 among rows of a weight."""
    return ", ".join(f"sum({weight}) OVER (PARTITION BY {by} ORDER BY v{i} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (sum({weight}) OVER (PARTITION BY {by}, v{i}) - 1) / 2.0::DOUBLE AS r{i}" for i in range(4))


@query("q_partial_spearman_ci", f"""
WITH s4 AS (SELECT arm, cell_line, drug, dose, time, {', '.join(f'round({c}, 9) AS {v}' for c, v in _ci.items())} FROM scores),
{boot_sql('s4', 'arm', 'v0', 'cell_line, drug, dose, time').split('rp AS')[0].replace('v0 AS x,', 'v0, v1, v2, v3,')}
rr AS (SELECT arm, b, w, {ranks_sql('w', 'arm, b')} FROM u5 WHERE w > 0),
rm AS (SELECT arm, b, sum(w) AS n, {', '.join(f'sum(w * r{i}) AS s{i}' for i in range(4))}, {', '.join(f'sum(w * r{i} * r{j}) AS s{i}{j}' for i in range(4) for j in range(i, 4))} FROM rr GROUP BY ALL),
rc AS (SELECT arm, {', '.join(f'(s{i}{j} - s{i} * s{j} / n) / sqrt((s{i}{i} - s{i} * s{i} / n) * (s{j}{j} - s{j} * s{j} / n)) AS c{i}{j}' for i, j in _pairs)} FROM rm),
rb AS (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT arm, {partial_sql(0, 1, (2, 3))} AS m FROM rc) GROUP BY 1),
pr AS (SELECT arm, {ranks_sql('1', 'arm')} FROM s4),
pc AS (SELECT arm, count(*) AS n, {', '.join(f'corr(r{i}, r{j}) AS c{i}{j}' for i, j in _pairs)} FROM pr GROUP BY 1)
SELECT *, {student_p(correlation_t('rho', 'n - 4'), 'n - 4')} AS p FROM (SELECT arm, n, {partial_sql(0, 1, (2, 3))} AS rho, lo, hi FROM pc JOIN rb USING (arm))
""", "rho lo hi p")
def partial_spearman_ci(t):
    s = I.scores(t).withColumns({c: F.round(c, 9) for c in _ci})
    return S.partial_spearman(s, ["arm"], "rmse", "pearson", ["l2", "cosine"], BOOT, ["cell_line", "drug", "dose", "time"])


def cramer(i: int) -> str:
    """Coefficient i of three by Cramer's rule over the sums a00 .. a22, b0 .. b2."""
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    a = [[f"a{min(r, c)}{max(r, c)}" for c in range(3)] for r in range(3)]
    return f"{det([[f'b{r}' if c == i else a[r][c] for c in range(3)] for r in range(3)])} / {det(a)}"


_ols = {f"a{i}{j}": (i, j) for i in range(3) for j in range(i, 3)} | {f"b{i}": (i, 3) for i in range(3)}
_of = ["1.0::DOUBLE", "rmse", "l2", "pearson"]
_solved = ", ".join(f"{cramer(i)} AS t{i}" for i in range(3))


@query("q_cluster_ols", f"""
WITH cl AS (SELECT drug AS c_, {', '.join(f'sum({_of[i]} * {_of[j]}) AS {n}' for n, (i, j) in _ols.items())} FROM scores WHERE arm = 'model' GROUP BY drug),
{drawn_sql('')},
rp AS (SELECT b, {', '.join(f'sum({n}) AS {n}' for n in _ols)} FROM dr JOIN nm USING (pos) GROUP BY b),
bt AS (SELECT unnest(['intercept', 'rmse', 'l2']) AS term, unnest([t0, t1, t2]) AS v FROM (SELECT {_solved} FROM rp)),
wh AS (SELECT unnest(['intercept', 'rmse', 'l2']) AS term, unnest([t0, t1, t2]) AS coef FROM (SELECT {_solved} FROM (SELECT {', '.join(f'sum({n}) AS {n}' for n in _ols)} FROM cl)))
SELECT term, any_value(coef) AS coef, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, least(1, greatest(2 * least(avg((v > 0)::INT), 1 - avg((v > 0)::INT)), 1.0::DOUBLE / count(v))) AS p
FROM bt JOIN wh USING (term) GROUP BY term
""", "coef lo hi p")
def cluster_ols(t):
    return S.cluster_ols(I.scores(t).filter("arm = 'model'"), "pearson", ["rmse", "l2"], "drug", BOOT)


@query("q_friedman", """
WITH w AS (SELECT cell_line, drug, arm, dose, avg(round(pearson, 9)) AS v FROM scores GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY dose, cell_line, drug) AS n_ FROM w),
r AS (SELECT *, rank() OVER (PARTITION BY dose, cell_line, drug ORDER BY v) + (count(*) OVER (PARTITION BY dose, cell_line, drug, v) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY dose, cell_line, drug, v) AS t FROM c WHERE n_ = 3),
s AS (SELECT dose, sum(R * R) AS ss FROM (SELECT dose, arm, sum(rk) AS R FROM r GROUP BY ALL) GROUP BY 1), k AS (SELECT dose, count(*) / 3.0::DOUBLE AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1)
SELECT *, exp(-stat / 2) AS p FROM (SELECT dose, n::BIGINT AS n_blocks, (12 / (n * 12) * ss - 12 * n) / (1 - ties / (n * 24)) AS stat, (12 / (n * 12) * ss - 12 * n) / (1 - ties / (n * 24)) / (n * 2) AS w FROM s JOIN k USING (dose))
""", "stat w p")
def friedman(t):
    s = I.scores(t).withColumn("pearson", F.round("pearson", 9))
    return S.friedman(s, ["cell_line", "drug"], "arm", "pearson", 3, ["dose"])


@query("q_bh_fdr", """
WITH b AS (SELECT *, count(p) OVER (PARTITION BY arm) AS m, CASE WHEN p IS NULL THEN NULL ELSE count(p) OVER (PARTITION BY arm ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS r FROM
 (SELECT arm, cell_line, drug, dose, CASE WHEN rmse > 40 THEN NULL ELSE floor(abs(round(pearson, 9)) * 50) / 50 END AS p FROM scores))
SELECT arm, cell_line, drug, dose, p, CASE WHEN p IS NULL THEN NULL ELSE least(1, min(p * m / r) OVER (PARTITION BY arm ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM b
""", "p q")
def bh_fdr(t):
    p = F.when(F.col("rmse") <= 40, F.floor(F.abs(F.round("pearson", 9)) * 50) / 50)
    return S.bh_fdr(I.scores(t).select("arm", "cell_line", "drug", "dose", p.alias("p")), "p", ["arm"])


@query("q_sar_corr", f"""
WITH u AS (SELECT cell_line, 'ecfp' AS representation, dose, time, plate, drug_i, drug_j, ecfp_dist AS d, pearson FROM sar UNION ALL SELECT cell_line, 'dense', dose, time, plate, drug_i, drug_j, dense_dist, pearson FROM sar),
k AS (SELECT *, d - avg(d) OVER g AS x, pearson - avg(pearson) OVER g AS y FROM u WHERE d IS NOT NULL AND NOT isnan(d) AND pearson IS NOT NULL AND NOT isnan(pearson) WINDOW g AS (PARTITION BY cell_line, representation)),
{boot_sql('k', 'cell_line, representation', 'x', 'cell_line, representation, dose, time, plate, drug_i, drug_j').split('rp AS')[0].replace('x AS x,', 'x, y,')}
cr AS (SELECT cell_line, representation, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) * (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) AS m
 FROM u5 WHERE w > 0 GROUP BY cell_line, representation, b),
cb AS (SELECT cell_line, representation, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM cr WHERE NOT isnan(m) GROUP BY ALL)
SELECT cell_line, representation, n, r, lo, hi FROM (SELECT cell_line, representation, count(*) AS n, corr(x, y) AS r FROM k GROUP BY ALL) JOIN cb USING (cell_line, representation)
""", "r lo hi")
def sar_corr(t):
    """Correlation of structural distance with profile similarity, with an interval over resampled pairs."""
    return S.pair_correlations(sar_rows(t), SAR_REPRESENTATIONS, ["cell_line"], ["cell_line", "representation", "dose", "time", "plate", "drug_i", "drug_j"], BOOT)


BINNED = f"""
WITH g AS (SELECT arm, cell_line, drug, dose, pearson AS y, (ceil(round((spearman + 1) / 0.1::DOUBLE, 9)) - 1)::INT AS bin FROM scores),
k AS (SELECT * FROM g WHERE bin >= 0 AND bin < 20), {boot_sql('k', 'arm, bin', 'y', 'arm, cell_line, drug, dose')}
"""


@query("q_repro_bins", BINNED + "SELECT arm, bin, mean, n, lo, hi, -1 + (bin + 0.5::DOUBLE) * 0.1::DOUBLE AS mid FROM pt JOIN bd USING (arm, bin) WHERE n >= 20", "mean lo hi mid")
def repro_bins(t):
    return S.binned_means(I.scores(t), ["arm"], "spearman", "pearson", -1.0, 0.1, 20, 20, ["arm", "cell_line", "drug", "dose"], BOOT)


@query("q_binned_r2", """
WITH g AS (SELECT arm, pearson AS y, (ceil(round((spearman + 1) / 0.1::DOUBLE, 9)) - 1)::INT AS bin FROM scores),
b AS (SELECT arm, bin, avg(y) AS m, -1 + (bin + 0.5::DOUBLE) * 0.1::DOUBLE AS mid FROM g WHERE bin >= 0 AND bin < 20 GROUP BY ALL HAVING count(*) >= 20)
SELECT arm, count(*) AS n_bins, regr_r2(m, mid) AS r2 FROM b GROUP BY 1
""", "r2")
def binned_r2(t):
    b = S.binned_means(I.scores(t), ["arm"], "spearman", "pearson", -1.0, 0.1, 20, 20)
    r = S.safe_corr(F.col("mid"), F.col("mean"))
    return b.groupBy("arm").agg(F.count(F.lit(1)).alias("n_bins"), (r * r).alias("r2"))


@query("q_filter_sweep", """
WITH a AS (SELECT th AS threshold, cell_line, drug, dose, pearson, spearman FROM scores, (SELECT unnest([-0.5::DOUBLE, 0.0, 0.3]) AS th) WHERE arm = 'model' AND l2 / 25 - 1 >= th / 10),
n0 AS (SELECT cell_line, drug, dose, pearson AS p0, (ceil(round((spearman + 1) / 0.2::DOUBLE, 9)) - 1)::INT AS bin FROM scores WHERE arm = 'reference'),
n AS (SELECT * FROM n0 WHERE bin IN (SELECT bin FROM n0 GROUP BY bin HAVING count(*) >= 100))
, j AS (SELECT threshold, bin, cell_line, drug, dose, pearson, round(pearson - p0, 12) AS d FROM a JOIN n USING (cell_line, drug, dose) WHERE bin >= 0 AND bin < 10),
""" + wilcoxon_sql("j", "threshold, bin") + "," + boot_sql("j", "threshold, bin", "d", "threshold, bin, cell_line, drug, dose") + """,
o AS (SELECT * FROM (SELECT threshold, bin, count(*) AS n, avg(pearson) AS mean, avg(d) AS diff FROM j GROUP BY ALL) LEFT JOIN bd USING (threshold, bin) LEFT JOIN (SELECT threshold, bin, """ + normal_p("z") + """ AS p FROM wz) USING (threshold, bin)),
b AS (SELECT *, count(p) OVER () AS m, CASE WHEN p IS NOT NULL THEN count(p) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS r FROM o)
SELECT threshold, bin, n, mean, diff, lo, hi, p, CASE WHEN p IS NOT NULL THEN least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM b
""", "mean diff lo hi p q")
def filter_sweep(t):
    """Arms of a training-filter sweep against the unfiltered arm, per reproducibility bin of 100 rows or more, with intervals and tests."""
    from platewise.operators.reports import filter_sweep as sweep
    a, b = arms(t)
    kept = a.withColumn("threshold", F.explode(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.3)))).filter(F.col("l2") / 25 - 1 >= F.col("threshold") / 10)
    binned = b.withColumn("bin", S.right_closed_bin(F.col("spearman"), -1.0, 0.2, 10)).dropna(subset=["bin"])
    return sweep(kept, binned, "threshold", "bin", ["cell_line", "drug", "dose"], "pearson", 100, BOOT)


GRIDS = {"power": [0.1, 0.2, 0.5, 1.5, 2.0], "saturating": [1.0, 3.0, 10.0, 30.0], "michaelis_menten": [1.0, 5.0, 20.0, 80.0]}
_g = {"log": "ln(x)", "sqrt": "sqrt(x)", "power": "pow(x, k)", "saturating": "1 - exp(-x / k)", "michaelis_menten": "x / (k + x)"}
CURVE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS family, k, y, {e} AS g, {2 if n in ('log', 'sqrt') else 3} AS q FROM v, (SELECT unnest({[float(z) for z in GRIDS.get(n, [1.0])]}::DOUBLE[]) AS k)" for n, e in _g.items())


@query("q_curve_fits", f"""
WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), u AS ({CURVE_SQL}),
f AS (SELECT family, k, any_value(q) AS q, count(*) AS n, regr_slope(y, g) AS slope, regr_intercept(y, g) AS intercept, regr_r2(y, g) AS r2 FROM u GROUP BY family, k)
SELECT family, k, slope, intercept, r2, 1 - (1 - r2) * (n - 1) / (n - q) AS adj_r2 FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY r2 DESC, k) AS rn FROM f) WHERE rn = 1
""", "k slope intercept r2 adj_r2", digits=4)
def curve_fits(t):
    return S.curve_fits(t.lineitem, "l_quantity", "l_extendedprice", GRIDS)


@query("q_curve_optimum")
def curve_optimum(t):
    """The same families at their best parameter."""
    return S.curve_optimum(t.lineitem, "l_quantity", "l_extendedprice")


cte("quad_scores", """
SELECT q.*, s.model, s.reference, s.train_mean FROM quads q JOIN (SELECT cell_line, drug, smiles, dose, time, max(pearson) FILTER (arm = 'model') AS model, max(pearson) FILTER (arm = 'reference') AS reference,
 max(pearson) FILTER (arm = 'train_mean') AS train_mean FROM scores GROUP BY ALL) s USING (cell_line, drug, smiles, dose, time)
""")


def quad_tables(t: Tables):
    """Scores, observations and quadrants, each written once for the steps that read it."""
    from platewise.plans.queries_splits import quads
    s = written(I.scores(t).select("arm", *OBS, "pearson"), "scores")
    o = written(s.select(*OBS).distinct(), "observations")
    return s, o, written(quads(t, o), "quadrants")


def quad_scores(t: Tables, tables=None):
    """Scores of all arms beside each test observation and its quadrant."""
    s, _, q = tables or quad_tables(t)
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("pearson"))).alias(a)
    return cut_lineage(q.join(s.groupBy(*OBS).agg(of("model"), of("reference"), of("train_mean")), OBS))


_base = " UNION ALL ".join(f"SELECT quadrant, cell_line, drug, dose, '{b}' AS baseline, model AS m, {b} AS b, round(model - {b}, 9) AS d FROM quad_scores" for b in ("reference", "train_mean"))
_means = "micro_model micro_baseline micro_diff macro_model macro_baseline macro_diff p_obs p_cellline"


@query("q_quadrant_baselines", f"""
WITH l AS ({_base}), c AS (SELECT quadrant, baseline, cell_line, avg(m) AS am, avg(b) AS ab, round(avg(m) - avg(b), 9) AS d FROM l GROUP BY ALL),
{wilcoxon_sql('l', 'quadrant, baseline')}, pl AS (SELECT quadrant, baseline, {normal_p('z')} AS p_obs FROM wz),
{wilcoxon_sql('c', 'quadrant, baseline').replace('wr ', 'xr ').replace('ws ', 'xs ').replace('wz ', 'xz ').replace('FROM wr', 'FROM xr').replace('FROM ws', 'FROM xs')}, pc AS (SELECT quadrant, baseline, {normal_p('z')} AS p_cellline FROM xz)
SELECT quadrant, baseline, n_obs, n_obs_paired, n_cell_lines, micro_model, micro_baseline, macro_model, macro_baseline, n_cl_wins, micro_model - micro_baseline AS micro_diff, macro_model - macro_baseline AS macro_diff, p_obs, p_cellline
FROM (SELECT quadrant, baseline, count(*) AS n_obs, count(d) AS n_obs_paired, count(DISTINCT cell_line) AS n_cell_lines, avg(m) AS micro_model, avg(b) AS micro_baseline FROM l GROUP BY ALL)
JOIN (SELECT quadrant, baseline, avg(am) AS macro_model, avg(ab) AS macro_baseline, count(*) FILTER (d > 0) AS n_cl_wins FROM c GROUP BY ALL) USING (quadrant, baseline)
LEFT JOIN pl USING (quadrant, baseline) LEFT JOIN pc USING (quadrant, baseline)
""", _means)
def quadrant_baselines(t):
    from platewise.operators.reports import compare_baselines
    return compare_baselines(quad_scores(t), ["quadrant"], "cell_line", "model", ["reference", "train_mean"])


@query("q_quadrant_gain", f"""
WITH s AS (SELECT * FROM quad_scores WHERE model IS NOT NULL AND reference IS NOT NULL AND (quadrant IN ('Q2', 'Q3') OR quadrant = 'Q4' AND cell_line IN (SELECT cell_line FROM quads WHERE quadrant = 'Q3')
 AND smiles IN (SELECT smiles FROM smiles_split WHERE split = 'test'))),
g AS (SELECT quadrant, cell_line, avg(model) AS am, avg(reference) AS ab, avg(model - reference) AS gain, count(*) AS k FROM s GROUP BY ALL), {boot_sql('g', 'quadrant', 'gain', 'quadrant, cell_line')}
SELECT quadrant, mean AS estimate, n AS n_cell_lines, lo, hi, model_macro, baseline_macro, n_obs, wins FROM pt JOIN bd USING (quadrant)
JOIN (SELECT quadrant, avg(am) AS model_macro, avg(ab) AS baseline_macro, sum(k)::BIGINT AS n_obs, count(*) FILTER (round(gain, 9) > 0) AS wins FROM g GROUP BY 1) USING (quadrant)
""", "estimate lo hi model_macro baseline_macro")
def quadrant_gain(t):
    """Gain over the reference by quadrant and cell line; both new: only cell lines and compounds held out for the test."""
    from platewise.operators.reports import cluster_gains
    from platewise.plans.queries_splits import smiles_split
    tables = quad_tables(t)
    _, o, q = tables
    lines = q.filter("quadrant = 'Q3'").select("cell_line").distinct().withColumn("_line", F.lit(True))
    held = smiles_split(o).filter("split = 'test'").select("smiles").distinct().withColumn("_smiles", F.lit(True))
    s = quad_scores(t, tables).join(lines, "cell_line", "left").join(held, "smiles", "left")
    return cluster_gains(s.filter("quadrant in ('Q2', 'Q3') or quadrant = 'Q4' and _line and _smiles"), ["quadrant"], "cell_line", "model", "reference", BOOT)


@query("q_quadrant_vs_baseline", f"""
WITH c AS (SELECT dose, cell_line, round(avg(a) - avg(b), 9) AS d, avg(a) AS a, avg(b) AS b, sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM paired GROUP BY ALL), {wilcoxon_sql('c', 'dose')}
SELECT dose, sum(sa) / sum(c.n) AS micro_a, sum(sb) / sum(c.n) AS micro_b, avg(a) AS macro_a, avg(b) AS macro_b, avg(a - b) AS macro_diff, count(*) FILTER (d > 0) AS wins, count(*) AS n_lines, any_value(w) AS w, any_value(p) AS p
FROM c JOIN (SELECT dose, w, {normal_p('z')} AS p FROM wz) z USING (dose) GROUP BY dose
""", "micro_a micro_b macro_a macro_b macro_diff w p")
def quadrant_vs_baseline(t):
    from platewise.operators.reports import compare_by_cluster
    return compare_by_cluster(paired(t), ["dose"], "cell_line")


@query("q_unseen_gain", f"""
WITH g AS (SELECT dose, drug, avg(d) AS gain FROM paired GROUP BY ALL), {boot_sql('g', 'dose', 'gain', 'dose, drug')} SELECT dose, mean, n, lo, hi FROM pt JOIN bd USING (dose)
""", "mean lo hi")
def unseen_gain(t):
    g = paired(t).groupBy("dose", "drug").agg(F.avg("d").alias("gain"))
    return S.bootstrap_mean(g, ["dose"], "gain", ["dose", "drug"], BOOT)


@query("q_pct_vs_none", """
WITH s AS (SELECT cell_line, drug, arm, avg(l2) AS v FROM scores GROUP BY ALL)
SELECT s.cell_line, s.drug, s.arm, s.v, 100 * (s.v - n.v) / abs(n.v) AS pct FROM s JOIN s n ON n.arm = 'reference' AND n.cell_line = s.cell_line AND n.drug = s.drug
""", "v pct")
def pct_vs_none(t):
    s = I.scores(t).groupBy("cell_line", "drug", "arm").agg(F.avg("l2").alias("v"))
    none = s.filter("arm = 'reference'").select("cell_line", "drug", F.col("v").alias("v0"))
    return s.join(none, ["cell_line", "drug"]).select("cell_line", "drug", "arm", "v", (100 * (F.col("v") - F.col("v0")) / F.abs("v0")).alias("pct"))


FACTORS = ["cell_line", "plate", "drug", "dose"]
cte("factor_ss", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT gene, '{f}' AS factor, sum(t * t / n) - sum(t) ** 2 / sum(n) AS ss FROM (SELECT gene, {f}, sum(value) AS t, count(*) AS n FROM profile_long GROUP BY ALL) GROUP BY gene" for f in FACTORS)
    + " UNION ALL SELECT gene, 'total', sum(value ** 2) - sum(value) ** 2 / count(*) FROM profile_long GROUP BY gene)")


@query("q_variance_partition", "SELECT * FROM factor_ss", "ss", digits=4)
def variance_ss(t):
    return S.factor_sums(I.long(t, I.profiles(t)), "gene", "value", FACTORS)


def fractions(t: Tables):
    return S.variance_partition(I.long(t, I.profiles(t)), "gene", "value", FACTORS, I.sparse_profiles(t).select(*FACTORS))


@query("q_variance_components")
def variance_components(t):
    return fractions(t)


@query("q_vp_summary", """
WITH f AS (SELECT s.gene, s.factor, s.ss / t.ss AS share FROM factor_ss s JOIN (FROM factor_ss WHERE factor = 'total') t USING (gene) WHERE s.factor <> 'total')
SELECT factor, count(*) AS n, avg(share) AS mean, stddev_pop(share) AS sd, quantile_cont(share, 0.25) AS q25, quantile_cont(share, 0.5) AS median, quantile_cont(share, 0.75) AS q75,
 count(*) FILTER (share < 0 OR share > 1) AS n_out_of_range, avg(CASE WHEN share < 0.001 THEN 1.0 ELSE 0.0 END) AS degenerate FROM f GROUP BY 1
""", "mean sd q25 median q75 degenerate")
def vp_summary(t):
    ss = cut_lineage(S.factor_sums(I.long(t, I.profiles(t)), "gene", "value", FACTORS)).groupBy("gene").pivot("factor", [*FACTORS, "total"]).agg(F.first("ss"))
    f = ss.select("gene", *[(F.col(c) / F.col("total")).alias(c) for c in FACTORS]).unpivot(["gene"], FACTORS, "factor", "share")
    checks = f.groupBy("factor").agg(F.count_if((F.col("share") < 0) | (F.col("share") > 1)).alias("n_out_of_range"), F.avg((F.col("share") < 0.001).cast("double")).alias("degenerate"))
    return M.distribution_summary(f, ["factor"], "share").join(checks, "factor")
