"""Drift between the earlier and the later half of the time line."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions.quantiles import quantile_list
from riskgraph.operators import drift as D
from riskgraph.queries.registry import query, rounded, rsql
from riskgraph.sources.tables import TX_SQL, transactions

NUM = ("TransactionAmt", "V307", "C1", "id_02", "fraud_score")
CAT = ("ProductCD", "DeviceType", "P_emaildomain")

_SIDES = TX_SQL + """,
b AS (SELECT quantile_cont("TransactionDT", 0.5) AS mid FROM tx),
sides AS (SELECT tx.*, CASE WHEN "TransactionDT" <= mid THEN 0 ELSE 1 END AS side FROM tx CROSS JOIN b)
"""
_NUM_LONG = "nl AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, side, cast("{f}" AS double) AS v FROM sides WHERE "{f}" IS NOT NULL"""
    for f in NUM) + ")"
_CAT_COUNTS = "cc AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, "{f}" AS value, count(*) FILTER (side = 0) AS r,
      count(*) FILTER (side = 1) AS c FROM sides WHERE "{f}" IS NOT NULL GROUP BY "{f}\"""" for f in CAT) + ")"


def _edges_cte(n, name="e"):
    """Quantile edges of the reference, repeated edges raised by 1e-9 one after the other."""
    sql = (f"SELECT feature, {', '.join(f'quantile_cont(v, {i / n}) AS q{i}' for i in range(n + 1))} "
           "FROM nl WHERE side = 0 GROUP BY feature")
    sql = f"SELECT *, q0 AS f0 FROM ({sql})"
    for i in range(1, n + 1):
        sql = f"SELECT *, CASE WHEN q{i} > f{i - 1} THEN q{i} ELSE f{i - 1} + 1e-9 END AS f{i} FROM ({sql})"
    return f"{name} AS ({sql})"


def _psi_ctes(n):
    bins = " + ".join(f"(v >= f{i})::int" for i in range(1, n))
    return f"""{_NUM_LONG}, {_edges_cte(n)},
bc AS (SELECT feature, {bins} AS bin, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c
  FROM nl JOIN e USING (feature) GROUP BY ALL),
grid AS (SELECT feature, unnest(range({n})) AS bin FROM e),
bt AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM bc GROUP BY feature),
bp AS (SELECT g.feature, CASE WHEN coalesce(r, 0) = 0 THEN 1e-6 ELSE r / nr::double END AS p,
    CASE WHEN coalesce(c, 0) = 0 THEN 1e-6 ELSE c / nc::double END AS q
  FROM grid g LEFT JOIN bc ON g.feature = bc.feature AND g.bin = bc.bin JOIN bt ON g.feature = bt.feature),
psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM bp GROUP BY feature)"""


_JS = """rg AS (SELECT feature, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 30 AS st FROM nl GROUP BY feature),
j0 AS (SELECT nl.feature, side, v, lo, st, floor((v - lo) / st) AS i FROM nl JOIN rg USING (feature)),
jb AS (SELECT feature, least(greatest(i + (v >= (i + 1) * st + lo)::int - (v < i * st + lo)::int, 0), 29) AS bin,
  count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM j0 GROUP BY ALL),
jt AS (SELECT feature, sum(r) AS nr, sum(c) AS nc FROM jb GROUP BY feature),
jg AS (SELECT feature, unnest(range(30)) AS bin FROM rg),
jp AS (SELECT g.feature, coalesce(r, 0) / nr::double AS p, coalesce(c, 0) / nc::double AS q
  FROM jg g LEFT JOIN jb ON g.feature = jb.feature AND g.bin = jb.bin JOIN jt ON g.feature = jt.feature),
jq AS (SELECT feature, CASE WHEN p = 0 THEN 1e-12 ELSE p END AS p, CASE WHEN q = 0 THEN 1e-12 ELSE q END AS q,
  CASE WHEN p + q = 0 THEN 1e-12 ELSE (p + q) / 2 END AS m FROM jp),
js AS (SELECT feature, 0.5 * sum(p * ln(p / m)) + 0.5 * sum(q * ln(q / m)) AS js FROM jq GROUP BY feature)"""
_KS = """kv AS (SELECT feature, v, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c FROM nl GROUP BY ALL),
kc AS (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER g AS nr, sum(c) OVER g AS nc FROM kv
  WINDOW w AS (PARTITION BY feature ORDER BY v), g AS (PARTITION BY feature)),
ks AS (SELECT feature, max(abs(cr / nr::double - cc / nc::double)) AS ks,
  max(sqrt(nr * nc / (nr + nc)::double)) AS en FROM kc GROUP BY feature),
kl AS (SELECT *, (en + 0.12 + 0.11 / en) * ks AS lam FROM ks),
kp AS (SELECT feature, ks, CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest((
  SELECT sum(2 * (-1) ** (j - 1) * exp(-2 * j * j * lam * lam)) FROM range(1, 31) t(j)), 0), 1) END AS ks_pvalue FROM kl)"""
_CPSI = """ct AS (SELECT feature, sum(r) AS nr, sum(c) AS nc, count(*) AS kk FROM cc GROUP BY feature),
cp AS (SELECT feature, kk, r, c, nr, nc, CASE WHEN r = 0 THEN 1e-6 ELSE r / nr::double END AS p,
  CASE WHEN c = 0 THEN 1e-6 ELSE c / nc::double END AS q,
  CASE WHEN r = 0 THEN 1e-6 ELSE r * (nc / nr::double) END AS ex FROM cc JOIN ct USING (feature)),
cpsi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi, sum((c - ex) ** 2 / ex) AS chi2, max(kk) - 1 AS dof
  FROM cp GROUP BY feature)"""


def _split(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("TransactionDT", "isFraud", *NUM, *CAT)
    mid = quantile_list(tx, "TransactionDT", [0.5])[0]
    t = F.col("TransactionDT")
    return tx.filter(t <= mid), tx.filter(t > mid)


@query("numeric_psi", f"WITH {_SIDES}, {_psi_ctes(10)} SELECT feature, {rsql({'psi': 'psi'}, 8)} FROM psi")
def numeric_psi(spark, sf_dir):
    return rounded(D.numeric_psi(*_split(spark, sf_dir), NUM), 8)


@query("score_drift", f"WITH {_SIDES}, {_psi_ctes(20)} SELECT feature, {rsql({'psi': 'psi'}, 8)} FROM psi "
       "WHERE feature = 'fraud_score'")
def score_drift(spark, sf_dir):
    return rounded(D.score_drift(*_split(spark, sf_dir), "fraud_score"), 8)


@query("categorical_psi", f"WITH {_SIDES}, {_CAT_COUNTS}, {_CPSI} SELECT feature, {rsql({'psi': 'psi'}, 8)} FROM cpsi")
def categorical_psi(spark, sf_dir):
    return rounded(D.categorical_psi(D.category_counts(*_split(spark, sf_dir), CAT)), 8)


@query("category_union", f"WITH {_SIDES}, {_CAT_COUNTS} SELECT * FROM cc")
def category_union(spark, sf_dir):
    return rounded(D.category_counts(*_split(spark, sf_dir), CAT))


@query("chi_square", f"""WITH {_SIDES}, {_CAT_COUNTS}, {_CPSI} SELECT feature, {rsql({'chi2': 'chi2'}, 6)},
  dof FROM cpsi""")
def chi_square(spark, sf_dir):
    """The tail probability is not in the SQL; it is tested against known values."""
    return rounded(D.chi_square(D.category_counts(*_split(spark, sf_dir), CAT)).drop("chi2_pvalue"), 6)


@query("js_divergence", f"WITH {_SIDES}, {_NUM_LONG}, {_JS} SELECT feature, {rsql({'js': 'js'}, 8)} FROM js")
def js_divergence(spark, sf_dir):
    return rounded(D.js_divergence(*_split(spark, sf_dir), NUM), 8)


@query("ks_test", f"""WITH {_SIDES}, {_NUM_LONG}, {_KS}
SELECT feature, {rsql({'ks': 'ks', 'ks_pvalue': 'ks_pvalue'}, 8)} FROM kp""")
def ks_test(spark, sf_dir):
    return rounded(D.ks_test(*_split(spark, sf_dir), NUM), 8)


_SEV = "CASE WHEN {0} >= 0.25 THEN 'severe' WHEN {0} >= 0.1 THEN 'moderate' ELSE 'none' END"
_REPORT = f"""{_SIDES}, {_psi_ctes(10)}, {_JS}, {_KS}, {_CAT_COUNTS}, {_CPSI},
ms AS (SELECT feature, avg(v) FILTER (side = 1) - avg(v) FILTER (side = 0) AS mean_shift,
  count(*) FILTER (side = 0) AS n_reference, count(*) FILTER (side = 1) AS n_current FROM nl GROUP BY feature),
rep AS (
SELECT feature, 'numeric' AS kind, psi, ks, ks_pvalue, js, cast(NULL AS double) AS chi2, mean_shift, n_reference, n_current
FROM psi JOIN ms USING (feature) JOIN kp USING (feature) JOIN js USING (feature)
UNION ALL SELECT feature, 'categorical', psi, NULL, NULL, NULL, chi2, 0, nr, nc FROM cpsi JOIN ct USING (feature))
"""


@query("drift_report", f"""WITH {_REPORT} SELECT feature, kind,
  {rsql({c: c for c in ("psi", "ks", "ks_pvalue", "js", "chi2", "mean_shift")}, 8)},
  {_SEV.format("psi")} AS severity, cast(n_reference AS bigint) AS n_reference,
  cast(n_current AS bigint) AS n_current FROM rep""")
def drift_report(spark, sf_dir):
    r, c = _split(spark, sf_dir)
    keep = (*NUM, *CAT)
    return rounded(D.drift_report(r.select(*keep), c.select(*keep)).drop("chi2_pvalue", "notes"), 8)


@query("drift_overall", f"""WITH {_REPORT} SELECT {rsql({"overall_psi": "max(psi)"}, 6)}, count(*) AS n_features,
  count(*) FILTER (psi >= 0.1 AND psi < 0.25) AS n_moderate, count(*) FILTER (psi >= 0.25) AS n_severe,
  {_SEV.format("max(psi)")} AS severity FROM rep""")
def drift_overall(spark, sf_dir):
    r, c = _split(spark, sf_dir)
    keep = (*NUM, *CAT)
    return rounded(D.drift_overall(D.drift_report(r.select(*keep), c.select(*keep))), 6)


@query("top_drifted", f"""WITH {_REPORT} SELECT feature, {rsql({"psi": "psi"}, 6)} FROM rep
ORDER BY rep.psi DESC, feature LIMIT 3""")
def top_drifted(spark, sf_dir):
    r, c = _split(spark, sf_dir)
    keep = (*NUM, *CAT)
    return rounded(D.top_drifted(D.drift_report(r.select(*keep), c.select(*keep)), 3).select("feature", "psi"), 6)


@query("label_drift", f"""WITH {TX_SQL} SELECT count("isFraud") AS n, {rsql({"production_rate": 'avg("isFraud")',
  "reference_rate": "0.035", "absolute_drift": 'abs(avg("isFraud") - 0.035)'})} FROM tx""")
def label_drift(spark, sf_dir):
    return rounded(D.label_drift(transactions(spark, sf_dir), "isFraud"))


@query("kind_inference", f"""WITH {TX_SQL} SELECT * FROM (VALUES {", ".join(f"('{f}', 'numeric')" for f in NUM)},
  {", ".join(f"('{f}', 'categorical')" for f in CAT)}) t(feature, kind)""")
def kind_inference(spark, sf_dir):
    kinds = D.infer_kinds(transactions(spark, sf_dir), [*NUM, *CAT])
    return spark.createDataFrame(list(kinds.items()), "feature string, kind string")
