"""Judge queries.  Pairs are labelled documents of one language; read-outs are whole-number arithmetic on their ids (declared synthetic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import calibration as K
from quern.operators import judge as J
from quern.operators import regression as G
from quern.operators import resampling as S
from quern.plans.catalog import query


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, category, subset, prompt, chosen, rejected, c, r (the two ids)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    # only ids are numbered; texts join afterwards
    named = docs.select("doc_id", "lang").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("lang", "quality").orderBy("doc_id")))
    good = named.filter("quality = 1").select("lang", "n", F.col("doc_id").alias("c"))
    bad = named.filter("quality = 0").select("lang", "n", F.col("doc_id").alias("r"))
    rows = good.join(bad, ["lang", "n"]).join(docs.select(F.col("doc_id").alias("c"), F.col("text").alias("chosen"), F.col("source").alias("subset")), "c").join(docs.select(F.col("doc_id").alias("r"), F.col("text").alias("rejected")), "r")
    return rows.select(F.concat_ws("/", "lang", F.col("n").cast("string")).alias("item_id"), F.col("lang").alias("category"), "subset", F.concat(F.lit("Write about {"), F.col("lang"), F.lit("}.")).alias("prompt"), "chosen", "rejected", "c", "r")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("order", F.explode(F.array(*[F.lit(o) for o in J.ORDERS])))
    straight = F.col("order") == J.ORDERS[0]
    z = F.when(straight, ((F.col("c") * 37 + F.col("r") * 11) % 201 - 80) / 20.0).otherwise(((F.col("c") * 53 + F.col("r") * 29) % 201 - 90) / 20.0)
    mass = F.when(straight, (F.col("c") * 13 + F.col("r") * 7) % 101).otherwise((F.col("c") * 17 + F.col("r") * 5) % 101) / 100.0
    return rows.select(F.lit("synthetic").alias("model"), F.lit("minimal").alias("rubric"), "order", "item_id", z.alias("z"), mass.alias("mass_ab"), ((F.col("c") + F.col("r")) % 5 != 0).alias("compliant"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.swap_pairs(records(spark, sf_dir)).join(items(spark, sf_dir), "item_id")


ITEMS = """it0 AS (SELECT d.doc_id, text, lang, source, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id) AS n FROM documents d JOIN labels USING (doc_id)),
it AS (SELECT g.lang || '/' || g.n AS item_id, g.lang AS category, g.source AS subset, 'Write about {' || g.lang || '}.' AS prompt, g.text AS chosen, b.text AS rejected, g.doc_id AS c, b.doc_id AS r FROM it0 g JOIN it0 b ON g.lang = b.lang AND g.n = b.n AND g.quality = 1 AND b.quality = 0)"""
PAIRS = f"""WITH {ITEMS}, pz AS (SELECT it.*, ((c * 37 + r * 11) % 201 - 80) / 20.0::DOUBLE AS z_cf, ((c * 53 + r * 29) % 201 - 90) / 20.0::DOUBLE AS z_rf, least((c * 13 + r * 7) % 101, (c * 17 + r * 5) % 101) / 100.0::DOUBLE AS mass_min, (c + r) % 5 <> 0 AS compliant_both FROM it),
pa AS (SELECT *, (z_cf - z_rf) / 2 AS s, (z_cf + z_rf) / 2 AS b, CASE WHEN z_cf >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS raw_cf, CASE WHEN z_rf < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS raw_rf, CASE WHEN z_cf > z_rf THEN 1.0 WHEN z_cf < z_rf THEN 0.0 ELSE 0.5 END::DOUBLE AS sym, (z_cf >= 0) = (z_rf >= 0) AS flip FROM pz)"""
_R6 = lambda name, sql: f"round({sql}, 6) AS {name}"
_SHARE = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
_STATS = ", ".join([_R6("sym_acc", "avg(sym)"), _R6("raw_acc", "avg((raw_cf + raw_rf) / 2)"), _R6("flip_rate", _SHARE("flip")), _R6("b_median", "quantile_cont(b, 0.5)"), _R6("b_median_abs", "quantile_cont(abs(b), 0.5)"), _R6("s_median_abs", "quantile_cont(abs(s), 0.5)"), _R6("bias_dominates", _SHARE("abs(b) > abs(s)")), _R6("mass_p50", "quantile_cont(mass_min, 0.5)")])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql() -> str:
    a, b = "CASE WHEN o = 'chosen_first' THEN chosen ELSE rejected END", "CASE WHEN o = 'chosen_first' THEN rejected ELSE chosen END"
    body = " || ".join([_quoted(J.PARTS[0]), "prompt", _quoted(J.PARTS[1]), a, _quoted(J.PARTS[2]), b, _quoted(J.PARTS[3] + J.RUBRICS["minimal"]["closing"])])
    x = J.CHAT["chatml"]
    return f"""WITH {ITEMS}, p AS (SELECT item_id, o AS "order", CASE WHEN o = 'chosen_first' THEN 'A' ELSE 'B' END AS expected_verdict, {body} AS u FROM it, (SELECT unnest(['chosen_first', 'rejected_first']) AS o))
SELECT item_id, "order", expected_verdict, length(u)::INT AS user_chars, md5({_quoted(x[0])} || {_quoted(J.RUBRICS['minimal']['system'])} || {_quoted(x[1])} || u || {_quoted(x[2])}) AS rendered_md5 FROM p"""


@query(_prompt_sql())
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = J.prompts(items(spark, sf_dir), "minimal", "chatml")
    return made.select("item_id", "order", "expected_verdict", F.length("user").alias("user_chars"), F.md5("rendered").alias("rendered_md5"))


@query(f"""WITH {ITEMS}, l AS (SELECT item_id, list_transform(range(16), lambda j: ((c * (j + 3) + r * (2 * j + 1)) % 97) / 10.0::DOUBLE - 4) AS x FROM it),
m AS (SELECT item_id, x, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS norm, list_position(x, list_max(x)) - 1 AS top FROM l)
SELECT item_id, round(x[4] - x[6], 6) AS z, round(x[4] - norm, 6) AS logp_a, round(x[6] - norm, 6) AS logp_b, round(exp(x[4] - norm) + exp(x[6] - norm), 6) AS mass_ab, top IN (3, 5) AS compliant FROM m""")
def logit_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    rows = rows.withColumn("logits", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: ((F.col("c") * (j + 3) + F.col("r") * (2 * j + 1)) % 97) / 10.0 - 4))
    top = F.array_position("logits", F.array_max("logits")) - 1
    rows = rows.withColumn("argmax_token", F.when(top == 3, " A").when(top == 5, "B ").otherwise("the"))
    return rounded(J.read_logits(rows).select("item_id", "z", "logp_a", "logp_b", "mass_ab", "compliant"))


@query(f"{PAIRS} SELECT item_id, z_cf, z_rf, s, b, raw_cf, raw_rf, sym, flip, compliant_both, mass_min FROM pa")
def swap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.swap_pairs(records(spark, sf_dir)).select("item_id", "z_cf", "z_rf", "s", "b", "raw_cf", "raw_rf", "sym", "flip", "compliant_both", "mass_min")


@query(f"""{PAIRS} SELECT category, count(*) AS n_items, {_R6('compliance_rate', _SHARE('compliant_both'))}, {_R6('mass_p50', 'quantile_cont(mass_min, 0.5)')}, {_R6('raw_acc', 'avg((raw_cf + raw_rf) / 2)')}, {_R6('raw_cf', 'avg(raw_cf)')}, {_R6('raw_rf', 'avg(raw_rf)')},
{_R6('sym_acc', 'avg(sym)')}, {_R6('sym_minus_raw', 'avg(sym - (raw_cf + raw_rf) / 2)')}, {_R6('flip_rate', _SHARE('flip'))}, {_R6('b_mean', 'avg(b)')}, {_R6('b_median', 'quantile_cont(b, 0.5)')}, {_R6('b_sd', 'stddev_samp(b)')}, {_R6('b_q25', 'quantile_cont(b, 0.25)')}, {_R6('b_q75', 'quantile_cont(b, 0.75)')},
{_R6('b_positive', _SHARE('b > 0'))}, {_R6('s_mean', 'avg(s)')}, {_R6('s_median_abs', 'quantile_cont(abs(s), 0.5)')}, {_R6('s_sd', 'stddev_samp(s)')}, {_R6('bias_dominates', _SHARE('abs(b) > abs(s)'))} FROM pa GROUP BY category""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.summary(pairs(spark, sf_dir), "category"))


@query(f"{PAIRS} SELECT stratum, count(*) AS n_items, {_STATS} FROM (SELECT *, 'all' AS stratum FROM pa UNION ALL SELECT *, CASE WHEN compliant_both THEN 'compliant_both' ELSE 'non_compliant' END FROM pa) GROUP BY stratum")
def compliance_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.compliance_strata(J.swap_pairs(records(spark, sf_dir))))


@query(f"""{PAIRS}, bi AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.25::DOUBLE), (1, 0.25, 0.5), (2, 0.5, 0.75), (3, 0.75, 0.9), (4, 0.9, 1e300)) AS t(bin, lo, hi))
SELECT bin::INT AS bin, any_value(lo) AS lo, count(item_id) AS n_items, {_STATS} FROM bi LEFT JOIN pa ON mass_min >= lo AND mass_min < hi GROUP BY bin""")
def compliance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.mass_bins(J.swap_pairs(records(spark, sf_dir))))


@query(f"""WITH {ITEMS}, w AS (SELECT *, len(regexp_extract_all(chosen, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+')) AS wc, len(regexp_extract_all(rejected, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+')) AS wr FROM it)
SELECT category, count(*) AS n_items, 0.5::DOUBLE AS always_a, round(avg(CASE WHEN length(chosen) > length(rejected) THEN 1.0 WHEN length(chosen) < length(rejected) THEN 0.0 ELSE 0.5 END), 6) AS longer_chars, round(avg(CASE WHEN wc > wr THEN 1.0 WHEN wc < wr THEN 0.0 ELSE 0.5 END), 6) AS longer_words, 0.5::DOUBLE AS random FROM w GROUP BY category""")
def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.floors(items(spark, sf_dir), "category"))


_BINS = f"""{PAIRS}, cf AS (SELECT 1 / (1 + exp(-abs(s))) AS conf, sym AS correct FROM pa),
so AS (SELECT list_sort(list(conf)) AS l, count(*) AS n FROM cf),
ed AS (SELECT DISTINCT len(list_filter(l, lambda x: x <= l[greatest(1, CASE WHEN i = 10 THEN n ELSE round_even(i * n / 10, 0) END)::INT])) AS e FROM so, (SELECT unnest(range(1, 11)) AS i)),
rn AS (SELECT conf, correct, (SELECT count(*) FROM cf c2 WHERE c2.conf <= c1.conf) AS upto FROM cf c1),
bn AS (SELECT conf, correct, (SELECT count(*) FROM ed WHERE e < upto)::INT AS bin FROM rn)"""


@query(f"{_BINS} SELECT bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(correct), 6) AS acc FROM bn GROUP BY bin")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.reliability_curve(K.fold(J.swap_pairs(records(spark, sf_dir)))))


@query(f"{_BINS}, cu AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(correct) AS acc FROM bn GROUP BY bin) SELECT sum(n)::BIGINT AS n_points, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM cu")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.ece(K.fold(J.swap_pairs(records(spark, sf_dir)))))


_LOO = f"""{PAIRS}, lo AS (SELECT item_id, category, z_cf, z_rf, b, (sum(b) OVER () - b) / (count(*) OVER () - 1) AS global_,
coalesce((sum(b) OVER c1 - b) / nullif(count(*) OVER c1 - 1, 0), (sum(b) OVER () - b) / (count(*) OVER () - 1)) AS category_,
coalesce((sum(b) OVER c2 - b) / nullif(count(*) OVER c2 - 1, 0), (sum(b) OVER () - b) / (count(*) OVER () - 1)) AS subset_ FROM pa WINDOW c1 AS (PARTITION BY category), c2 AS (PARTITION BY subset)),
es AS (SELECT item_id, category, z_cf, z_rf, unnest(['none', 'global', 'category', 'subset', 'oracle']) AS estimator, unnest([0.0::DOUBLE, global_, category_, subset_, b]) AS b_hat FROM lo)"""


@query(f"{_LOO} SELECT item_id, estimator, round(b_hat, 6) AS b_hat FROM es")
def loo_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.loo_estimates(pairs(spark, sf_dir)).select("item_id", "estimator", "b_hat"))


@query(f"""{_LOO}, cr AS (SELECT *, (CASE WHEN round(z_cf - b_hat, 9) > 0 THEN 1.0 WHEN round(z_cf - b_hat, 9) = 0 THEN 0.5 ELSE 0.0 END + CASE WHEN round(z_rf - b_hat, 9) < 0 THEN 1.0 WHEN round(z_rf - b_hat, 9) = 0 THEN 0.5 ELSE 0.0 END) / 2 AS score FROM es)
SELECT estimator, coalesce(category, 'all') AS category, count(*) AS n_items, round(avg(score), 6) AS acc FROM cr GROUP BY GROUPING SETS ((estimator), (estimator, category))""")
def correction_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = G.corrected(G.settled(G.loo_estimates(pairs(spark, sf_dir)))).withColumn("category", F.explode(F.array(F.lit("all"), F.col("category"))))
    return rounded(named.groupBy("estimator", "category").agg(F.count("*").alias("n_items"), F.avg("score").alias("acc")))


@query(f"""{PAIRS}, ft AS (SELECT b, category, subset, ln((length(chosen) + length(rejected))::DOUBLE) AS l0, abs(ln(length(chosen) / length(rejected)::DOUBLE)) AS l1, ln(length(prompt)::DOUBLE) AS l2 FROM pa),
f AS (SELECT b, avg(b) OVER (PARTITION BY category) AS m1, avg(b) OVER w AS m2, l0 - avg(l0) OVER w AS x0, l1 - avg(l1) OVER w AS x1, l2 - avg(l2) OVER w AS x2 FROM ft WINDOW w AS (PARTITION BY subset)),
su AS (SELECT var_pop(b) * count(*) AS total, sum((b - m1) * (b - m1)) AS w1, sum((b - m2) * (b - m2)) AS w2, sum(x0 * x0) + 1e-8 AS a00, sum(x0 * x1) AS a01, sum(x0 * x2) AS a02, sum(x1 * x1) + 1e-8 AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) + 1e-8 AS a22, sum(x0 * (b - m2)) AS c0, sum(x1 * (b - m2)) AS c1, sum(x2 * (b - m2)) AS c2 FROM f)
SELECT unnest(['category', 'subset', 'subset_plus_length']) AS spec, unnest([round(1 - w1 / total, 6), round(1 - w2 / total, 6), round(1 - (w2 - ({G.EXPLAINED}) / ({G.DETERMINANT})) / total, 6)]) AS r2 FROM su""")
def bias_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.length_columns(pairs(spark, sf_dir))
    parts = [G.group_r2(p, "b", c).select(F.lit(c).alias("spec"), F.round("r2", 6).alias("r2")) for c in ("category", "subset")]
    return parts[0].union(parts[1]).union(G.group_and_lengths_r2(p, "b", "subset").select(F.lit("subset_plus_length").alias("spec"), F.round("r2", 6).alias("r2")))


@query(f"""{PAIRS} SELECT item_id, round(ln((length(chosen) + length(rejected))::DOUBLE), 6) AS log_total_chars, round(ln(length(chosen) / length(rejected)::DOUBLE), 6) AS dlog_chars, round(ln(len(regexp_extract_all(chosen, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+')) / len(regexp_extract_all(rejected, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'))::DOUBLE), 6) AS dlog_words, sign(s)::DOUBLE AS sign_s FROM pa""")
def length_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.length_columns(pairs(spark, sf_dir)).select("item_id", "log_total_chars", "dlog_chars", "dlog_words", "sign_s"))


def _sum(term: str) -> str:
    """Sum over the rows z of a design: z[1] and z[2] its features, l the chance of losing at the round's coefficients."""
    return f"list_sum(list_transform(rows, lambda z: {term}))".replace("l_", "(1 / (1 + exp(z[1] * b1 + z[2] * b2)))")


@query(f"""WITH RECURSIVE {PAIRS[5:]}, fe AS (SELECT item_id, category, s, sign(s)::DOUBLE AS g, ln(length(chosen) / length(rejected)::DOUBLE) AS d FROM pa),
sa AS (SELECT *, 'all' AS stratum FROM fe UNION ALL SELECT *, category FROM fe),
sc AS (SELECT stratum, item_id, s / coalesce(nullif(stddev_samp(s) OVER w, 0), 1) AS s, g / coalesce(nullif(stddev_samp(g) OVER w, 0), 1) AS g, d / coalesce(nullif(stddev_samp(d) OVER w, 0), 1) AS d FROM sa WINDOW w AS (PARTITION BY stratum)),
de AS (SELECT stratum, item_id, unnest(['length', 'judge', 'joint', 'joint_sign']) AS spec, unnest([[d, 0.0], [s, 0.0], [s, d], [g, d]]) AS z FROM sc),
sp AS (SELECT stratum, spec, list(z ORDER BY item_id) AS rows FROM de GROUP BY ALL),
nt AS (SELECT stratum, spec, rows, 0 AS k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM sp UNION ALL
  SELECT stratum, spec, rows, k + 1, b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (SELECT *, {_sum('z[1] * l_')} - 1e-3 * b1 AS g1, {_sum('z[2] * l_')} - 1e-3 * b2 AS g2,
  {_sum('z[1] * z[1] * l_ * (1 - l_)')} + 1e-3 AS h11, {_sum('z[1] * z[2] * l_ * (1 - l_)')} AS h12, {_sum('z[2] * z[2] * l_ * (1 - l_)')} + 1e-3 AS h22 FROM nt) WHERE k < 40),
fi AS (SELECT stratum, spec, b1, b2, {_sum('CASE WHEN z[1] * b1 + z[2] * b2 > 0 THEN 1.0 WHEN z[1] * b1 + z[2] * b2 = 0 THEN 0.5 ELSE 0.0 END')} / len(rows) AS acc, {_sum('ln(1 + exp(-z[1] * b1 - z[2] * b2))')} / len(rows) AS loss FROM nt WHERE k = 40),
co AS (SELECT *, unnest(CASE spec WHEN 'length' THEN ['dlog_chars'] WHEN 'judge' THEN ['s'] WHEN 'joint' THEN ['s', 'dlog_chars'] ELSE ['sign_s', 'dlog_chars'] END) AS feature, unnest(CASE WHEN spec IN ('length', 'judge') THEN [b1] ELSE [b1, b2] END) AS coef FROM fi)
SELECT stratum, spec, feature, round(coef, 6) AS coef, round(acc, 6) AS acc, round(loss, 6) AS logloss FROM co""")
def cond_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length probe, overall and by category."""
    rows = G.length_columns(pairs(spark, sf_dir)).withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("category"))))
    return rounded(G.length_probe(rows.select("stratum", "item_id", "s", "sign_s", "dlog_chars")))


@query()
def ridge_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.length_columns(pairs(spark, sf_dir))
    return rounded(G.ridge_estimates(rows.select("model", "item_id", "subset", "b", *G.LENGTHS)))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetrised minus raw accuracy with 10,000 resamples, by category."""
    rows = pairs(spark, sf_dir).select("category", "item_id", (F.col("sym") - F.col("raw_mean")).alias("d"))
    return rounded(S.by_group(rows, ["category"], "item_id", lambda f: S.mean_interval(f["d"].to_numpy())))


@query()
def compliance_gap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetrised accuracy of compliant items minus the rest, an unpaired interval."""
    rows = J.swap_pairs(records(spark, sf_dir)).select("model", "item_id", "sym", "compliant_both")
    return rounded(S.by_group(rows, ["model"], "item_id", lambda f: S.two_sample_interval(f.loc[f["compliant_both"], "sym"].to_numpy(), f.loc[~f["compliant_both"], "sym"].to_numpy())))


def lcg_sql(rows: str, keys: list[str], order: str, values: list[str], replicates: int = 50) -> str:
    """Common table expressions placed, states and drawn (drawn rows: keys, r, values)."""
    by, each = ", ".join(keys), ", ".join(values)
    on = " AND ".join([*(f"states.{k} = placed.{k}" for k in keys), f"placed.j = ((x >> 8) * 8388608 + (((x * 1103515245 + 12345) % 2147483648) >> 8)) % states.n"])
    return f"""placed AS (SELECT {by}, {each}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS j, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}),
states AS (SELECT {by}, n, r, (((r * n + j + 1) % 2147483648) * 1103515245 + 12345) % 2147483648 AS x FROM placed, (SELECT unnest(range({replicates})) AS r)),
drawn AS (SELECT {', '.join(f'states.{k}' for k in keys)}, r, {each} FROM states JOIN placed ON {on})"""


_LO_HI = "round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi"


@query(f"""{PAIRS}, {lcg_sql('pa', ['category'], 'item_id', ['sym'])},
me AS (SELECT category, r, avg(sym) AS m FROM drawn GROUP BY ALL)
SELECT category, n, round(mean, 6) AS mean, {_LO_HI} FROM me JOIN (SELECT category, count(*) AS n, avg(sym) AS mean FROM pa GROUP BY 1) USING (category) GROUP BY ALL""")
def bootstrap_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.lcg_bootstrap(pairs(spark, sf_dir).select("category", "item_id", "sym"), ["category"], "item_id", "sym"))


_ACCURACIES = "(SELECT category, item_id, (raw_cf + raw_rf) / 2 AS raw_acc, sym AS sym_acc, sym - (raw_cf + raw_rf) / 2 AS sym_minus_raw FROM pa)"
_THREE = "avg(raw_acc) AS raw_acc, avg(sym_acc) AS sym_acc, avg(sym_minus_raw) AS sym_minus_raw"


@query(f"""{PAIRS}, ac AS {_ACCURACIES}, {lcg_sql('ac', ['category'], 'item_id', ['raw_acc', 'sym_acc', 'sym_minus_raw'])},
me AS (UNPIVOT (SELECT category, r, {_THREE} FROM drawn GROUP BY ALL) ON raw_acc, sym_acc, sym_minus_raw INTO NAME metric VALUE m),
wh AS (UNPIVOT (SELECT category, count(*) AS n, {_THREE} FROM ac GROUP BY 1) ON raw_acc, sym_acc, sym_minus_raw INTO NAME metric VALUE mean)
SELECT category, metric, n, round(mean, 6) AS mean, {_LO_HI} FROM me JOIN wh USING (category, metric) GROUP BY ALL""")
def summary_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's accuracies and their paired difference, intervals by draws that SQL repeats."""
    return rounded(S.lcg_means(J.accuracies(pairs(spark, sf_dir), "category", "item_id"), ["category"], "item_id", ["raw_acc", "sym_acc", "sym_minus_raw"]))


@query()
def summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's accuracies and their paired difference, 10,000 resamples."""
    return rounded(J.summary_intervals(pairs(spark, sf_dir), "category"))


@query(f"""{PAIRS}, pb AS (SELECT 'synthetic' AS model, item_id, sym, compliant_both FROM pa), {lcg_sql('pb', ['model', 'compliant_both'], 'item_id', ['sym'])},
me AS (SELECT model, r, avg(sym) FILTER (compliant_both) - avg(sym) FILTER (NOT compliant_both) AS m FROM drawn GROUP BY ALL)
SELECT model, n_true, n_false, round(mean, 6) AS mean, {_LO_HI} FROM me JOIN (SELECT model, count(*) FILTER (compliant_both) AS n_true, count(*) FILTER (NOT compliant_both) AS n_false, avg(sym) FILTER (compliant_both) - avg(sym) FILTER (NOT compliant_both) AS mean FROM pb GROUP BY 1) USING (model) GROUP BY ALL""")
def compliance_gap_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetrised accuracy of compliant items minus the rest, an unpaired interval by draws that SQL repeats."""
    rows = J.swap_pairs(records(spark, sf_dir)).select("model", "item_id", "sym", "compliant_both")
    return rounded(S.lcg_gap(rows, ["model"], "compliant_both", "item_id", "sym"))


@query()
def ladder_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correction ladder with its regression rung, intervals against no correction and against the oracle, recovered share."""
    return rounded(G.ladder_intervals(G.length_columns(pairs(spark, sf_dir))))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 600 * n / sum(n) OVER () AS x FROM c),
f AS (SELECT *, floor(x) AS fl, 600 - sum(floor(x)) OVER () AS short, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS k FROM e)
SELECT source, n AS count, (fl + CASE WHEN k <= short THEN 1 ELSE 0 END)::INT AS quota FROM f""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return J.largest_remainder(docs.groupBy("source").count(), 600, "source").select("source", "count", "quota")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 600 * n / sum(n) OVER () AS x FROM c),
f AS (SELECT *, floor(x) AS fl, 600 - sum(floor(x)) OVER () AS short, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS k FROM e),
q AS (SELECT source, fl + CASE WHEN k <= short THEN 1 ELSE 0 END AS quota FROM f)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents) JOIN q USING (source) WHERE n <= quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return J.stratified_sample(docs, 600, "source", "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || source || ':' || doc_id), doc_id) AS n FROM documents) WHERE n <= 50")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return J.sample_per_group(docs, 50, "source", "doc_id")


@query(f"""WITH {ITEMS} SELECT item_id, o AS "order" FROM it, (SELECT unnest(['chosen_first', 'rejected_first']) AS o) WHERE NOT (c % 3 = 0 AND o = 'chosen_first')""")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    wanted = J.prompts(rows).withColumn("model", F.lit("synthetic")).select("model", "rubric", "order", "item_id")
    done = records(spark, sf_dir).join(rows.select("item_id", "c"), "item_id").filter((F.col("c") % 3 == 0) & (F.col("order") == "chosen_first"))
    return J.todo(wanted, done).select("item_id", "order")
