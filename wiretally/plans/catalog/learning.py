"""Queries over drift, datasets, evaluation, model comparison and promotion gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions.text import DNS_LEXICAL_FEATURES
from wiretally.operators.ranks import exact_percentiles
from wiretally.operators import datasets, drift, evaluation, models, reports
from wiretally.params import DEFAULT
from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.records import _FEEDBACK_SQL, feedback_of
from wiretally.plans.catalog.registry import query, r6, table
from wiretally.sources.storage import materialise

_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONG = "li AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, l_shipdate >= TIMESTAMP '1997-06-01' AS cur FROM lineitem" for c in _COLS
) + " UNION ALL SELECT 'flag' AS feature, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END, l_shipdate >= TIMESTAMP '1997-06-01' FROM lineitem)"


def _samples(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("cur", F.col("l_shipdate") >= F.lit("1997-06-01").cast("timestamp_ntz"))
    flag = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0)
    long = l.select("cur", *_COLS, flag.alias("flag")).unpivot(["cur"], [*_COLS, "flag"], "feature", "value")
    return long.filter("not cur").select("feature", "value"), long.filter("cur").select("feature", "value")


_PSI = """
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM li WHERE NOT cur GROUP BY feature),
bn AS (SELECT li.feature, cur, CASE WHEN value = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda x: x <= value)) END AS b, len(e) AS ne FROM li JOIN ed USING (feature)),
bc AS (SELECT feature, b, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c FROM bn WHERE b >= 1 AND b <= ne - 1 AND ne >= 3 GROUP BY ALL),
bs AS (SELECT feature, greatest(r / greatest(1, sum(r) OVER w), 1e-6) AS pr, greatest(c / greatest(1, sum(c) OVER w), 1e-6) AS pc FROM bc WINDOW w AS (PARTITION BY feature)),
ps AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM bs GROUP BY feature)"""
_KS = """
kv AS (SELECT feature, value, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c FROM li GROUP BY ALL),
kc AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS d FROM kv
  WINDOW w AS (PARTITION BY feature ORDER BY value)),
kk AS (SELECT feature, max(d) AS ks FROM kc GROUP BY feature)"""
_JS = """
jv AS (SELECT feature, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM kv),
jj AS (SELECT feature, greatest(0, least(1, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / greatest(0.5 * (p + q), 1e-6)) ELSE 0 END)
  + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / greatest(0.5 * (p + q), 1e-6)) ELSE 0 END))) AS js FROM jv GROUP BY feature)"""


@query("M5 A8", f"WITH {_LONG}, {_PSI} SELECT feature, {q.r6('psi', 'psi')} FROM ps")
def population_stability(spark, sf):
    ref, cur = _samples(spark, sf)
    return drift.psi(ref, cur).select("feature", r6("psi"))


@query("M6", f"WITH {_LONG}, {_KS} SELECT feature, {q.r6('ks', 'ks')} FROM kk")
def kolmogorov_smirnov(spark, sf):
    ref, cur = _samples(spark, sf)
    return drift.ks(ref, cur).select("feature", r6("ks"))


@query("M7 J10 U5", f"""WITH o AS (SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS r, count(*) FILTER (WHERE o_orderstatus <> 'F') AS c FROM orders GROUP BY 1),
s AS (SELECT r / (SELECT sum(r) FROM o) AS p, c / (SELECT sum(c) FROM o) AS q FROM o)
SELECT {q.r6('''greatest(0, least(1, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / greatest(0.5 * (p + q), 1e-6)) ELSE 0 END)
 + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / greatest(0.5 * (p + q), 1e-6)) ELSE 0 END)))''', 'js')} FROM s""")
def category_divergence(spark, sf):
    o = table(spark, sf, "orders")
    return drift.js(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "o_orderpriority").select(r6("js"))


@query("M8 A2", f"WITH {_LONG} SELECT feature, count(DISTINCT value) AS n_distinct, count(DISTINCT value) <= 4 AS discrete FROM li WHERE NOT cur GROUP BY feature")
def discrete_features(spark, sf):
    return drift.is_discrete(_samples(spark, sf)[0])


@query("M9 J11", f"""WITH {_LONG}, {_PSI}, {_KS}, {_JS},
dd AS (SELECT feature, count(DISTINCT value) <= 4 AS discrete, count(*) AS n FROM li WHERE NOT cur GROUP BY feature)
SELECT feature, CASE WHEN discrete THEN 'jensen_shannon' WHEN coalesce(psi, 0) >= 0.00001 THEN 'psi' ELSE 'ks' END AS metric,
{q.r6('CASE WHEN discrete THEN js WHEN coalesce(psi, 0) >= 0.00001 THEN psi ELSE ks END', 'score')}, n AS reference_size
FROM dd LEFT JOIN ps USING (feature) JOIN kk USING (feature) JOIN jj USING (feature)
WHERE (discrete AND js >= 0.00001) OR (NOT discrete AND (coalesce(psi, 0) >= 0.00001 OR ks >= 0.00001))""")
def feature_drift_report(spark, sf):
    ref, cur = _samples(spark, sf)
    p = DEFAULT.with_(psi_threshold=1e-5, ks_threshold=1e-5, js_threshold=1e-5)
    return drift.feature_drift(ref, cur, p).select("feature", "metric", r6("score"), "reference_size")


_PRICES = """li AS (SELECT l_linestatus AS feature, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS value, l_shipdate >= TIMESTAMP '1997-06-01' AS cur FROM lineitem)"""


@query("M10 M5", f"""WITH {_PRICES}, {_PSI}, sz AS (SELECT feature, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c FROM li GROUP BY feature)
SELECT feature AS detector, 'CONFIDENCE_DISTRIBUTION' AS drift_type, 'psi' AS metric, {q.r6('psi', 'score')}, r AS reference_size, c AS current_size
FROM ps JOIN sz USING (feature) WHERE r >= 200 AND c >= 200 AND psi >= 0.00001""")
def score_drift_report(spark, sf):
    """Unit prices stand for scores, line states for detectors."""
    l = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("detector"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("value"),
        (F.col("l_shipdate") >= F.lit("1997-06-01").cast("timestamp_ntz")).alias("cur"))
    found = drift.score_drift(l.filter("not cur"), l.filter("cur"), DEFAULT.with_(psi_threshold=1e-5))
    return found.select("detector", "drift_type", "metric", r6("score"), "reference_size", "current_size")


@query("M11 M7", f"""WITH kv AS (SELECT o_orderpriority AS feature, o_orderstatus AS value, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') AS r,
 count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') AS c FROM orders GROUP BY ALL), {_JS},
sz AS (SELECT feature, sum(r) AS r, sum(c) AS c FROM kv GROUP BY feature)
SELECT feature AS detector, 'CLASS_DISTRIBUTION' AS drift_type, 'jensen_shannon' AS metric, {q.r6('js', 'score')}, CAST(r AS BIGINT) AS reference_size, CAST(c AS BIGINT) AS current_size
FROM jj JOIN sz USING (feature) WHERE js >= 0.00001""")
def class_drift_report(spark, sf):
    """Order states stand for alert classes, priorities for detectors."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("detector"), "o_orderstatus", (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("old"))
    found = drift.class_drift(o.filter("old"), o.filter("not old"), "o_orderstatus", DEFAULT.with_(js_threshold=1e-5))
    return found.select("detector", "drift_type", "metric", r6("score"), "reference_size", "current_size")


_JUDGED = """jd AS (SELECT source, CASE WHEN doc_id < (SELECT median(doc_id) FROM labels) THEN 'reference' ELSE 'current' END AS period,
 CASE WHEN quality = 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS label FROM labels JOIN documents USING (doc_id))"""


@query("M12", f"""WITH {_JUDGED}, p AS (SELECT source AS detector,
 coalesce(count(*) FILTER (WHERE period = 'reference' AND label = 'TRUE_POSITIVE') / nullif(count(*) FILTER (WHERE period = 'reference'), 0), 0) AS a,
 coalesce(count(*) FILTER (WHERE period = 'current' AND label = 'TRUE_POSITIVE') / nullif(count(*) FILTER (WHERE period = 'current'), 0), 0) AS b,
 count(*) FILTER (WHERE period = 'current') AS sample_size FROM jd GROUP BY source)
SELECT detector, {q.r6('a - b', 'drop')}, sample_size FROM p WHERE a - b >= -1 AND sample_size >= 1""")
def precision_decay(spark, sf):
    l = table(spark, sf, "labels")
    mid = exact_percentiles(l, "doc_id", [0.5]).first()["quantiles"][0]
    j = l.join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("detector")), "doc_id").select(
        "detector", F.when(F.col("doc_id") < mid, "reference").otherwise("current").alias("period"),
        F.when(F.col("quality") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("label"))
    return drift.precision_decay(j, max_drop=-1.0, min_samples=1).select("detector", r6("drop"), "sample_size")


_SCORED = """sc AS (SELECT lang, quality AS label, 1 / (1 + exp(-(CAST(n_chars AS DOUBLE) - 1500) / 1000)) AS score FROM labels JOIN documents USING (doc_id))"""


def _scored(spark, sf):
    """Quality labels with a fixed score of the document length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    z = (F.col("n_chars").cast("double") - 1500) / 1000
    return table(spark, sf, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("label"), (1 / (1 + F.exp(-z))).alias("score"))


_SAFE = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"


@query("A11 A14", f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
 count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, avg((score - label) ** 2) AS b FROM sc GROUP BY lang)
SELECT lang, tp, fp, tn, fn, {q.r6('b', 'brier_score')}, {q.r6(_SAFE('tp', 'tp + fp'), 'precision')}, {q.r6(_SAFE('tp', 'tp + fn'), 'recall')},
{q.r6(_SAFE('2 * tp', '2 * tp + fp + fn'), 'f1')}, {q.r6(_SAFE('fp', 'fp + tn'), 'false_positive_rate')} FROM c""")
def confusion_metrics(spark, sf):
    c = evaluation.confusion(_scored(spark, sf), 0.5, ["lang"])
    return c.select("lang", "tp", "fp", "tn", "fn", *[r6(x) for x in ("brier_score", "precision", "recall", "f1", "false_positive_rate")])


@query("A12 A13", f"""WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM sc GROUP BY score),
w AS (SELECT *, sum(p) OVER d AS tp, sum(p + n) OVER d AS seen, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM g WINDOW d AS (ORDER BY score DESC))
SELECT {q.r6('sum(n * ((tp - p) + 0.5 * p) / (pp * nn))', 'roc_auc')}, {q.r6('sum(p / pp * tp / seen)', 'pr_auc')} FROM w""")
def ranking_metrics(spark, sf):
    return evaluation.ranking(_scored(spark, sf)).select(r6("roc_auc"), r6("pr_auc"))


@query("A15", f"""WITH {_SCORED} SELECT {q.r6('avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) FILTER (WHERE label = 1)', 'recall')},
{q.r6('avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) FILTER (WHERE label = 0)', 'fpr')}, {q.r6('avg(score) FILTER (WHERE label = 1)', 'mean_p')} FROM sc""")
def transfer_probe(spark, sf):
    t = evaluation.transfer_check(_scored(spark, sf), 0.7)
    return t.select(r6("independent_generator_recall", "recall"), r6("independent_benign_fpr", "fpr"), r6("independent_dga_mean_probability", "mean_p"))


_NAMES = """nm AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS w, lang FROM documents),
fam AS (SELECT domain, f.label AS label, f.family AS family FROM (SELECT w AS domain, min({'label': CASE WHEN lang = 'en' THEN 0 ELSE 1 END, 'family': lang}) AS f FROM nm GROUP BY w))"""


def _names(spark, sf):
    """Distinct words as names; the language is the family, English the benign class."""
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"), "lang")
    return w.select(F.lower("w").alias("domain"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("label"), F.col("lang").alias("family")).distinct()


@query("M1 M2 A17 U6", f"""WITH {_NAMES}, held AS (SELECT * FROM fam WHERE family = 'de' AND label = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, family ORDER BY sha256(domain), domain) AS r, count(*) OVER (PARTITION BY label, family) AS n
 FROM fam WHERE NOT (family = 'de' AND label = 1)),
sp AS (SELECT domain, label, family, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM rk),
a AS (SELECT * FROM sp UNION ALL SELECT domain, label, family, 'unseen_family' FROM held UNION ALL SELECT domain, label, family, 'unseen_family' FROM sp WHERE split = 'test' AND label = 0)
SELECT split, label, family, count(*) AS n, sum(length(domain))::BIGINT AS letters FROM a GROUP BY ALL""")
def name_dataset_splits(spark, sf):
    d = datasets.name_dataset(_names(spark, sf), "de")
    return d.groupBy("split", "label", "family").agg(F.count("*").alias("n"), F.sum(F.col("dns_domain_length").cast("bigint")).alias("letters"))


_FB_ALERTS = """fa AS (SELECT 'a' || CAST(doc_id AS VARCHAR) AS alert_id, CASE WHEN lang = 'en' THEN 'dga' ELSE 'recon' END AS detector_name, n_chars AS ts_us, CAST(n_chars AS DOUBLE) AS x FROM documents),
us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts_us DESC, feedback_id) AS r FROM fb WHERE label IN ('TRUE_POSITIVE', 'FALSE_POSITIVE')) WHERE r = 1),
jn AS (SELECT us.feedback_id, alert_id, fa.ts_us, label, x FROM us JOIN fa USING (alert_id) WHERE detector_name = 'dga')"""


def _fb_alerts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("alert_id"), F.when(F.col("lang") == "en", "dga").otherwise("recon").alias("detector_name"),
        F.col("n_chars").alias("ts_us"), F.create_map(F.lit("length"), F.col("n_chars").cast("double")).alias("observations"),
        F.create_map(F.lit("length_threshold"), F.lit(10.0)).alias("comparisons"))


@query("M3 J7 W19", f"""WITH {_FEEDBACK_SQL}, {_FB_ALERTS}, rk AS (SELECT *, row_number() OVER (ORDER BY ts_us, alert_id) AS r, count(*) OVER () AS n FROM jn)
SELECT feedback_id, alert_id, CASE WHEN label = 'TRUE_POSITIVE' THEN 1 ELSE 0 END AS label, x AS length,
CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM rk WHERE n >= 20""")
def feedback_dataset(spark, sf):
    d = datasets.feedback_dataset(feedback_of(spark, sf), _fb_alerts(spark, sf), "dga", ["length"])
    return d.select("feedback_id", "alert_id", "label", "length", "split")


@query("M4 J13 P15", f"""WITH {_FEEDBACK_SQL}, {_FB_ALERTS} SELECT feedback_id, alert_id IN (SELECT alert_id FROM fa) AS known FROM fb
WHERE feedback_id NOT IN (SELECT feedback_id FROM jn WHERE (SELECT count(*) FROM jn) >= 20)""")
def unconsumed_feedback(spark, sf):
    fb, a = feedback_of(spark, sf), _fb_alerts(spark, sf)
    used = datasets.consumption(datasets.feedback_dataset(fb, a, "dga", ["length"]), "d1")
    left = datasets.unconsumed(fb, used)
    known, unknown = datasets.known_and_unknown(left, a)
    return known.select("feedback_id", F.lit(True).alias("known")).unionByName(unknown.select("feedback_id", F.lit(False).alias("known")))


_HASH_PIECES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS p{i}" for i in range(8))


@query("A18", f"""WITH h AS (SELECT sha256(concat_ws('|', coalesce(length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(length(text)::VARCHAR || ':' || text, '-'))) AS h FROM documents),
p AS (SELECT count(*) AS row_count, {_HASH_PIECES} FROM h)
SELECT row_count, sha256(concat_ws('|', row_count, {", ".join(f"p{i}" for i in range(8))})) AS content_hash FROM p""")
def dataset_content_hash(spark, sf):
    return datasets.content_hash(table(spark, sf, "documents"), ["doc_id", "text"])


@query("W20", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts) DESC, event_id DESC) AS r FROM events)
SELECT CASE WHEN r <= 2000 THEN 'current' ELSE 'reference' END AS half, count(*) AS n, min(event_id) AS lowest, max(event_id) AS highest FROM r WHERE r <= 4001 GROUP BY 1""")
def newest_halves(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    h = drift.halves(e, ["ts_us", "event_id"], 4001)
    return h.groupBy("half").agg(F.count("*").alias("n"), F.min("event_id").alias("lowest"), F.max("event_id").alias("highest"))


def _model_rows(spark, sf):
    """One registry row per part brand and size from the part table: metrics are column ratios."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("det"), (k % 5).cast("string")).alias("detector"), k.cast("string").alias("model_version"), k.alias("training_us"),
        (0.8 + (k % 21) / 100.0).alias("precision"), (0.7 + (k % 31) / 100.0).alias("recall"), ((k % 100) / 100.0).alias("f1"),
        ((k % 40) / 1000.0).alias("false_positive_rate"), ((k % 80) / 10.0).alias("inference_latency_ms"),
        F.when(k % 9 == 0, "0.9.0").otherwise("1.0.0").alias("feature_schema_version"),
        F.when(k % 8 == 0, "short").otherwise(F.sha2(k.cast("string"), 256)).alias("artifact_hash"),
        F.when(k % 7 == 0, "").otherwise("ds").alias("dataset_id"), F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("regression_tests_passed"),
        F.when(k % 2 == 0, (k % 10) / 10.0).alias("independent_generator_recall"), F.when(k % 4 == 0, (k % 30) / 100.0).alias("independent_benign_fpr"),
    )


@query("M16 J12 U7 Q-A8", """WITH m AS (SELECT p_partkey AS k, 'det' || CAST(p_partkey % 5 AS VARCHAR) AS detector FROM part),
g AS (SELECT *, list_filter([
 CASE WHEN NOT (0.8 + (k % 21) / 100.0 >= 0.9) THEN 'precision' END, CASE WHEN NOT (0.7 + (k % 31) / 100.0 >= 0.8) THEN 'recall' END,
 CASE WHEN NOT ((k % 40) / 1000.0 <= 0.02) THEN 'false_positive_rate' END, CASE WHEN NOT ((k % 80) / 10.0 <= 5.0) THEN 'inference_latency' END,
 CASE WHEN k % 9 = 0 THEN 'feature_schema' END, CASE WHEN k % 8 = 0 THEN 'artifact_integrity' END, CASE WHEN k % 7 = 0 THEN 'dataset_recorded' END,
 CASE WHEN k % 3 = 1 THEN 'regression_tests' END, CASE WHEN (k % 100) / 100.0 < 0.5 THEN 'improves_on_champion' END,
 CASE WHEN k % 2 = 0 AND (k % 10) / 10.0 < 0.5 THEN 'generalises_to_independent_generator' END, CASE WHEN k % 4 = 0 AND (k % 30) / 100.0 > 0.1 THEN 'independent_benign_fpr' END,
 CASE WHEN (0.8 + (k % 21) / 100.0) = 1.0 AND (0.7 + (k % 31) / 100.0) = 1.0 THEN 'not_implausibly_perfect' END], lambda x: x IS NOT NULL) AS f FROM m)
SELECT detector, CAST(k AS VARCHAR) AS model_version, array_to_string(list_filter(f, lambda x: x <> 'recall'), ',') AS failures,
 CASE WHEN list_contains(f, 'recall') THEN 'recall' ELSE '' END AS acknowledged, len(list_filter(f, lambda x: x <> 'recall')) = 0 AS passed FROM g""")
def promotion_gate_report(spark, sf):
    m = _model_rows(spark, sf)
    champions = m.groupBy("detector").agg(F.lit(0.5).alias("f1"))
    g = models.promotion_gates(m, champions, DEFAULT, ("recall",))
    return g.select("detector", "model_version", F.array_join("failures", ",").alias("failures"), F.array_join("acknowledged", ",").alias("acknowledged"), "passed")


@query("A27 Q-A7 A29", """WITH m AS (SELECT p_partkey AS k, 'det' || CAST(p_partkey % 5 AS VARCHAR) AS detector FROM part),
s AS (SELECT *, CASE WHEN k % 50 = 1 THEN 'CHAMPION' WHEN k % 50 = 2 THEN 'CHALLENGER' WHEN k % 10 = 3 THEN 'RETIRED' ELSE 'CANDIDATE' END AS st FROM m)
SELECT detector, CAST(max(k) FILTER (WHERE st = 'CHAMPION') AS VARCHAR) AS champion, CAST(max(k) FILTER (WHERE st = 'CHALLENGER') AS VARCHAR) AS challenger, count(*) AS model_count FROM s GROUP BY detector""")
def model_registry_summary(spark, sf):
    m = _model_rows(spark, sf).select("detector", "model_version", "training_us")
    k = F.col("training_us")
    log = lambda cond, st, t: m.filter(cond).select("detector", "model_version", F.lit(st).alias("to_status"), F.lit(t).alias("ts_us"))
    promotions = log(k % 10 == 3, "CHALLENGER", 1).unionByName(log(k % 10 == 3, "RETIRED", 2)).unionByName(log(k % 50 == 1, "CHAMPION", 3)).unionByName(log(k % 50 == 2, "CHALLENGER", 3))
    return reports.registry_summary(m, promotions)


_LIVE = """lv AS (SELECT l_returnflag AS detector, l_linestatus = 'O' AS shadow, l_discount * 10 AS confidence FROM lineitem)"""


def _live(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_returnflag").alias("detector_name"), (F.col("l_linestatus") == "O").alias("shadow"), (F.col("l_discount") * 10).alias("confidence"))


@query("A16", f"WITH {_LIVE} SELECT detector AS detector_name, CASE WHEN shadow THEN 'challenger' ELSE 'champion' END AS role, count(*) AS samples, {q.r6('avg(confidence)', 'mean_confidence')} FROM lv GROUP BY ALL")
def score_means(spark, sf):
    return evaluation.score_means(_live(spark, sf)).select("detector_name", "role", "samples", r6("mean_confidence"))


@query("M15 J12 A16", f"""WITH {_LIVE.replace('FROM lineitem', ', CAST(l_quantity > 25 AS INT) AS label FROM lineitem')},
c AS (SELECT detector, shadow, count(*) AS n, avg(confidence) AS mean, count(*) FILTER (WHERE label = 1 AND confidence >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND confidence >= 0.5) AS fp,
 count(*) FILTER (WHERE label = 0 AND confidence < 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND confidence < 0.5) AS fn FROM lv GROUP BY ALL),
m AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM c),
j AS (SELECT d.detector, a.n AS an, b.n AS bn, a.mean AS am, b.mean AS bm, a.f1 AS af, b.f1 AS bf, a.fpr AS ar, b.fpr AS br
 FROM (SELECT DISTINCT detector FROM m) d LEFT JOIN (FROM m WHERE NOT shadow) a USING (detector) LEFT JOIN (FROM m WHERE shadow) b USING (detector))
SELECT detector, coalesce(an, 0) AS champion_samples, coalesce(bn, 0) AS challenger_samples, {q.r6('coalesce(am, 0)', 'champion_mean_confidence')}, {q.r6('coalesce(bm, 0)', 'challenger_mean_confidence')},
{q.r6('af', 'champion_f1')}, {q.r6('bf', 'challenger_f1')}, {q.r6('ar', 'champion_fpr')}, {q.r6('br', 'challenger_fpr')},
CASE WHEN bn IS NULL THEN 'no challenger registered' WHEN an IS NULL THEN 'no champion; challenger cannot be compared and must not be promoted blind'
 WHEN bf > af AND br <= ar THEN 'challenger better on held-out F1 and no worse on false positives' WHEN bf > af THEN 'challenger better on F1 but worse on false positives -- weigh alert load'
 ELSE 'challenger does not beat champion; keep the incumbent' END AS verdict FROM j""")
def champion_challenger_comparison(spark, sf):
    """Metrics of either role are those of its own judged rows; the score spreads differ too little for the note."""
    live = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("detector_name"), (F.col("l_linestatus") == "O").alias("shadow"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_quantity") > 25).cast("int").alias("label"))
    judged = evaluation.confusion(live.withColumnRenamed("confidence", "score"), 0.5, ["detector_name", "shadow"])
    metrics = judged.select(
        F.col("detector_name").alias("detector"), F.when(F.col("shadow"), "challenger").otherwise("champion").alias("role"),
        F.lit("v1").alias("version"), "f1", "false_positive_rate")
    c = models.compare(live, metrics)
    shown = [f"{r}_{m}" for m in ("mean_confidence", "f1", "fpr") for r in ("champion", "challenger")]
    return c.select("detector", "champion_samples", "challenger_samples", *[r6(n) for n in shown], "verdict")


def _promotions(spark, sf):
    """Status changes of the part table's models: some became challengers, of those some champions or retired."""
    m = _model_rows(spark, sf)
    k = F.col("training_us")
    log = lambda cond, st, t: m.filter(cond).select("detector", "model_version", F.lit(st).alias("to_status"), (k * 10 + t).alias("ts_us"))
    return log(k % 6 < 3, "CHALLENGER", 1).unionByName(log(k % 6 == 1, "CHAMPION", 2)).unionByName(log(k % 6 == 2, "RETIRED", 3))


_PROMOTED = """m AS (SELECT p_partkey AS k, 'det' || CAST(p_partkey % 5 AS VARCHAR) AS detector, CAST(p_partkey AS VARCHAR) AS model_version FROM part),
pr AS (SELECT detector, model_version, 'CHALLENGER' AS to_status, k * 10 + 1 AS ts_us, k FROM m WHERE k % 6 < 3 UNION ALL SELECT detector, model_version, 'CHAMPION', k * 10 + 2, k FROM m WHERE k % 6 = 1
 UNION ALL SELECT detector, model_version, 'RETIRED', k * 10 + 3, k FROM m WHERE k % 6 = 2)"""


@query("Q-A7", f"""WITH {_PROMOTED} SELECT detector, model_version, coalesce(lag(to_status) OVER (PARTITION BY detector, model_version ORDER BY ts_us), 'CANDIDATE') AS from_status, to_status, ts_us,
row_number() OVER (PARTITION BY detector ORDER BY ts_us DESC, model_version, to_status) AS position FROM pr""")
def promotion_history(spark, sf):
    return reports.promotion_history(_promotions(spark, sf)).select("detector", "model_version", "from_status", "to_status", "ts_us", "position")


@query("A29", f"""WITH {_PROMOTED}, st AS (SELECT detector, model_version, arg_max(to_status, ts_us) AS status, any_value(k) AS k FROM pr GROUP BY ALL),
cu AS (SELECT *, 'ds' || CAST(k % 4 AS VARCHAR) AS dataset_id FROM st WHERE status <> 'RETIRED' AND k % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY detector, status ORDER BY k DESC) = 1)
SELECT dataset_id, count(*) FILTER (WHERE status = 'CHAMPION') AS champions, count(*) FILTER (WHERE status = 'CHALLENGER') AS challengers FROM cu GROUP BY dataset_id""")
def datasets_in_use(spark, sf):
    k = F.col("training_us")
    m = _model_rows(spark, sf).select("detector", "model_version", "training_us", F.when(k % 7 != 0, F.concat(F.lit("ds"), (k % 4).cast("string"))).alias("dataset_id"))
    return reports.datasets_in_use(m, _promotions(spark, sf))


_SIGNALS = """dr AS (SELECT l_returnflag AS detector, 'discount_mean' AS metric, epoch_us(date_trunc('month', l_shipdate)) AS ts_us,
 abs(avg(l_discount) - 0.05) * 100 AS score, 0.05 AS threshold, l_returnflag || '-' || CAST(epoch_us(date_trunc('month', l_shipdate)) AS VARCHAR) AS drift_id FROM lineitem GROUP BY ALL)"""


def _signals(spark, sf):
    """Monthly signals: how far the mean discount of a return flag lies from five percent."""
    month = F.unix_micros(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")))
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("detector"), month.alias("ts_us")).agg((F.abs(F.avg("l_discount") - 0.05) * 100).alias("score"))
    return s.select("detector", F.lit("discount_mean").alias("metric"), "ts_us", "score", F.lit(0.05).alias("threshold"), F.concat_ws("-", "detector", F.col("ts_us").cast("string")).alias("drift_id"))


@query("A29", f"""WITH {_SIGNALS} SELECT detector, metric, ts_us, {q.r6('score', 'score')}, {q.r6('threshold', 'threshold')}, score >= threshold AS exceeded,
count(*) FILTER (WHERE score >= threshold) OVER (PARTITION BY detector, metric ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS exceeded_so_far FROM dr""")
def drift_signal_series(spark, sf):
    s = reports.drift_series(_signals(spark, sf))
    return s.select("detector", "metric", "ts_us", r6("score"), r6("threshold"), "exceeded", "exceeded_so_far")


@query("Q-A9 P15 T2", f"""WITH {_SIGNALS}, fb AS (SELECT doc_id, quality = 1 AS consumed FROM labels), bm AS (SELECT o_orderkey, epoch_us(o_orderdate) AS t FROM orders)
SELECT 'drift' AS list, drift_id AS id, ts_us FROM (SELECT * FROM dr WHERE detector = 'R' ORDER BY ts_us DESC, drift_id LIMIT 50)
UNION ALL SELECT 'feedback', id, t FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id * 3 % 1000 AS t FROM fb WHERE NOT consumed ORDER BY t DESC, id LIMIT 100)
UNION ALL SELECT 'benchmarks', id, t FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, t FROM bm ORDER BY t DESC, id LIMIT 20)""")
def newest_lists(spark, sf):
    """The console's lists: drift signals of a detector, unused judgements, benchmark results."""
    judged = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("feedback_id"), (F.col("doc_id") * 3 % 1000).alias("ts_us"), (F.col("quality") == 1).alias("consumed"))
    timed = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("benchmark_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"))
    part = lambda df, name, key: df.select(F.lit(name).alias("list"), F.col(key).alias("id"), "ts_us")
    return part(reports.drift_list(_signals(spark, sf), detector="R"), "drift", "drift_id").unionByName(
        part(reports.feedback_list(judged, unconsumed_only=True), "feedback", "feedback_id")).unionByName(
        part(reports.benchmark_list(timed), "benchmarks", "benchmark_id"))


@query("M14", f"""WITH p AS (SELECT round(l_extendedprice / 1000) AS x, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS y FROM lineitem GROUP BY x),
c AS (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM p WINDOW w AS (ORDER BY x)),
lo AS (SELECT i.x, j.x AS start, min((k.cy - j.cy + j.y) / (k.cn - j.cn + j.n)) AS m FROM c i JOIN c j ON j.x <= i.x JOIN c k ON k.x >= i.x GROUP BY ALL),
f AS (SELECT x, max(m) AS m FROM lo GROUP BY x)
SELECT min(x) AS low, max(x) AS high, CAST(sum(n) AS DOUBLE) AS weight, {q.r6('m', 'mean')} FROM f JOIN p USING (x) GROUP BY m""")
def calibration_blocks(spark, sf):
    """Isotonic fit of large quantities on the price in thousands; the SQL is the max-min formula."""
    from wiretally.operators import calibration

    rows = table(spark, sf, "lineitem").select(F.round(F.col("l_extendedprice") / 1000).alias("score"), (F.col("l_quantity") > 25).cast("int").alias("label"))
    return calibration.blocks(rows).select("low", "high", "weight", r6("mean"))


@query("M13 M14 A11 A12")
def boosted_name_model(spark, sf):
    """Trees on the lexical features of the labelled names, calibrated, evaluated per split."""
    # written: training reads its rows several times, and each time their features would be built again
    d = materialise(datasets.name_dataset(_names(spark, sf), "de"), "name-dataset")
    feats = list(DNS_LEXICAL_FEATURES)
    model = models.train(d.filter("split = 'train'"), d.filter("split = 'validation'"), feats, "1", max_iter=10)
    scored = model.score(d.filter("split in ('test', 'unseen_family')"), "score")
    return evaluation.confusion(scored, 0.5, ["split"]).select("split", "tp", "fp", "tn", "fn", r6("f1"))


