from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import MEASURES, TAGS, TAGS_HOURLY, events, r, tags_hourly
from tidewatch.checks.registry import query
from tidewatch.operators import correlate as c, profile as p
from tidewatch.operators.series import Series
from tidewatch.sources.tables import inventory, schema_table, table

STEADY = [*MEASURES, "steady"]
SPLIT = "1998-01-01"


def measures(spark, d):
    """Line item measures plus a feature that never varies, as telemetry tags."""
    li = table(spark, d, "lineitem")
    return li.select(*MEASURES, (F.col("l_linenumber") * 0 + 3.0).alias("steady"), "l_shipdate", "l_returnflag")


def sample_a(spark, d):
    return measures(spark, d).filter(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz"))


def sample_b(spark, d):
    return measures(spark, d).filter(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz"))


M = "m AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber * 0 + 3.0::DOUBLE AS steady, l_shipdate, l_returnflag FROM lineitem)"
TALL = M + ", tall AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, {x}::DOUBLE AS value, l_shipdate, l_returnflag FROM m" for x in STEADY) + ")"
A, B = f"l_shipdate < TIMESTAMP '{SPLIT}'", f"l_shipdate >= TIMESTAMP '{SPLIT}'"


def pick(df, *rounded, keep=(), places=4):
    return df.select(*keep, *[r(x, places).alias(x) for x in rounded])


@query("G01_column_profile", f"""WITH {TALL} SELECT feature, count(*) AS rows, count(DISTINCT value) AS distinct_values, count(value) AS valid,
0::BIGINT AS missing, 0::BIGINT AS infinite, count(*) FILTER (value = 0) AS zeros, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median,
stddev_samp(value) = 0 AS zero_variance, stddev_samp(value) > 0 AND stddev_samp(value) < 1e-8 AS near_zero_variance, max(value) - min(value) > 1000 AS wide_range FROM tall GROUP BY 1""")
def g01(spark, d):
    x = p.column_profile(measures(spark, d), STEADY)
    return pick(x, "min", "max", "mean", "std", "median", keep=["feature", "rows", "distinct_values", "valid", "missing", "infinite", "zeros",
                                                              "zero_variance", "near_zero_variance", "wide_range"])


@query("G02_quality_profile", f"""WITH {TALL} SELECT feature, count(value) AS valid, round(100.0 * (count(*) - count(value)) / count(*), 4) AS missing_pct,
round(max(abs(value)), 4) AS abs_max, """ + ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for n, q in p.QUALITY_QUANTILES.items()) + " FROM tall GROUP BY 1")
def g02(spark, d):
    x = p.quality_profile(measures(spark, d), STEADY)
    return pick(x, "missing_pct", "abs_max", *p.QUALITY_QUANTILES, keep=["feature", "valid"])


TAGTALL = TAGS_HOURLY + ", tall AS (" + " UNION ALL ".join(f"SELECT '{t}' AS feature, hour, label, {t} AS value FROM tags" for t in TAGS) + ")"


@query("G03_distinct_counts", f"""WITH {TAGTALL} SELECT feature, count(DISTINCT round(value, 6)) AS distinct_values,
count(DISTINCT round(value, 6)) + max((value IS NULL)::INTEGER) AS with_null FROM tall GROUP BY 1""")
def g03(spark, d):
    h = tags_hourly(spark, d)
    h = h.select("hour", *[F.round(t, 6).alias(t) for t in TAGS])
    a = p.distinct_values(h, TAGS)
    return a.join(p.distinct_values(h, TAGS, count_null=True).withColumnRenamed("distinct_values", "with_null"), "feature")


@query("G04_near_constant", f"""WITH {TALL}, n AS (SELECT feature, value, count(*) AS n FROM tall GROUP BY 1, 2)
SELECT feature, round(max(n) / sum(n), 6) AS top_share, max(n) / sum(n) >= 0.99 AS near_constant FROM n GROUP BY 1""")
def g04(spark, d):
    return p.dominant_share(measures(spark, d), STEADY).select("feature", r("top_share").alias("top_share"), "near_constant")


@query("G05_kind_counts", f"""WITH {TALL}, n AS (SELECT feature, count(DISTINCT value) AS n FROM tall GROUP BY 1)
SELECT CASE WHEN n <= 1 THEN 'constant' WHEN n = 2 THEN 'binary' ELSE 'continuous' END AS kind, count(*) AS features FROM n GROUP BY 1""")
def g05(spark, d):
    return p.kind_counts(p.distinct_values(measures(spark, d), STEADY))


@query("G06_table_health", """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts THEN 1 ELSE 0 END AS back FROM events)
SELECT count(*) AS rows, sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT)::BIGINT AS null_cells,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicate_rows, sum(back)::BIGINT AS backward_steps, sum(back) = 0 AS monotonic FROM e""")
def g06(spark, d):
    return p.table_health(events(spark, d), Series(["user_id"], ["event_id", "ts"], cell=F.floor(F.col("event_id") / 65536)))


@query("G07_duplicate_groups", "SELECT l_quantity, l_discount, l_tax, l_shipdate, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def g07(spark, d):
    return p.duplicate_groups(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_shipdate"])


@query("G08_key_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def g08(spark, d):
    return p.duplicate_groups(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("G09_value_frequencies", f"""WITH {TALL} SELECT feature, l_returnflag, value, count(*) AS rows,
round(count(*) / sum(count(*)) OVER (PARTITION BY feature, l_returnflag), 9) AS share FROM tall WHERE feature IN ('l_discount', 'l_tax') GROUP BY 1, 2, 3""")
def g09(spark, d):
    x = p.value_counts(measures(spark, d), ["l_discount", "l_tax"], ["l_returnflag"])
    return x.select("feature", "l_returnflag", "value", "rows", r("share", 9).alias("share"))


def _side(tag, cond):
    return f"""{tag} AS (SELECT feature, count(DISTINCT value) AS distinct_values, min(value) AS mn, max(value) AS mx, avg(value) AS mean,
stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM tall WHERE {cond} GROUP BY 1)"""


@query("G10_sample_stability", f"""WITH {TALL}, {_side('a', A)}, {_side('b', B)} SELECT feature, a.distinct_values AS distinct_values_a, b.distinct_values AS distinct_values_b,
round(a.mean, 4) AS mean_a, round(b.mean, 4) AS mean_b, round(a.mn, 4) AS min_a, round(b.mx, 4) AS max_b,
a.distinct_values <= 1 AS constant_a, a.distinct_values <= 1 AND b.distinct_values <= 1 AS constant_both FROM a JOIN b USING (feature)""")
def g10(spark, d):
    x = p.sample_stability(sample_a(spark, d), sample_b(spark, d), STEADY)
    return pick(x, "mean_a", "mean_b", "min_a", "max_b", keep=["feature", "distinct_values_a", "distinct_values_b", "constant_a", "constant_both"])


SHIFTS = f"""{TALL}, {_side('a', A)}, {_side('b', B)}, o AS (SELECT feature, 100 * avg((value < mn)::INT) AS below_pct, 100 * avg((value > mx)::INT) AS above_pct
FROM tall JOIN a USING (feature) WHERE {B} GROUP BY 1),
s AS (SELECT feature, (b.mean - a.mean) / nullif(a.std, 0) AS mean_shift, (b.median - a.median) / nullif(a.std, 0) AS median_shift, below_pct, above_pct, a.q05 AS base_q05, b.q95 AS other_q95, b.q99 AS other_q99
FROM a JOIN b USING (feature) JOIN o USING (feature))"""


@query("G11_drift", f"""WITH {SHIFTS} SELECT feature, round(mean_shift, 6) + 0 AS mean_shift, round(median_shift, 6) + 0 AS median_shift, round(base_q05, 4) AS base_q05, round(other_q95, 4) AS other_q95, round(other_q99, 4) AS other_q99,
round(below_pct, 6) AS below_pct, round(above_pct, 6) AS above_pct, coalesce(abs(mean_shift) >= 2, false) AS shift_flag, below_pct + above_pct > 1 AS range_flag FROM s""")
def g11(spark, d):
    x = p.drift(sample_a(spark, d), {"b": sample_b(spark, d)}, STEADY)
    x = x.withColumns({c: r(c, 4) for c in ("base_q05", "other_q95", "other_q99")})
    return pick(x, "mean_shift", "median_shift", "below_pct", "above_pct", keep=["feature", "shift_flag", "range_flag", "base_q05", "other_q95", "other_q99"], places=6)


def _shifts(x):
    return ", ".join(f"coalesce(abs({x}.{q} - a.{q}) / nullif(a.std, 0), 0)" for q in ("mean", "median", "q05", "q95"))


@query("G12_drift_priority", f"""WITH {SHIFTS}, {_side('c', "l_returnflag = 'R'")},
t AS (SELECT s.feature, greatest({_shifts('b')}, {_shifts('c')}) AS sp, greatest(below_pct + above_pct, (SELECT 100 * avg((value < a.mn OR value > a.mx)::INT) FROM tall WHERE tall.feature = s.feature AND l_returnflag = 'R')) AS rp
 FROM s JOIN a USING (feature) JOIN b USING (feature) JOIN c USING (feature))
SELECT feature, round(sp, 6) AS shift_priority, round(rp, 6) AS range_priority, row_number() OVER (ORDER BY rp DESC, sp DESC, feature)::INTEGER AS shift_rank FROM t""")
def g12(spark, d):
    others = {"b": sample_b(spark, d), "r": measures(spark, d).filter("l_returnflag = 'R'")}
    x = p.drift(sample_a(spark, d), others, STEADY, zero_std_as_zero=True)
    return pick(p.drift_priority(x), "shift_priority", "range_priority", keep=["feature", "shift_rank"], places=6)


def corr_sql(a, b):
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN"
    return f"""(covar_pop({a}, {b}) / nullif(stddev_pop({both} {a} END) * stddev_pop({both} {b} END), 0))"""


def pairs_sql(cols, source, where="true"):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {corr_sql(a, b)} AS correlation FROM {source} WHERE {where}"
                              for i, a in enumerate(cols) for b in cols[i + 1:])


@query("G13_pearson_matrix", f"WITH {M} SELECT feature_1, feature_2, round(correlation, 6) + 0 AS correlation FROM ({pairs_sql(STEADY, 'm')})")
def g13(spark, d):
    x = c.pearson_pairs(measures(spark, d).select(*STEADY), STEADY)
    return pick(x, "correlation", keep=["feature_1", "feature_2"], places=6)


@query("G13_pearson_matrix_wide", """WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT printf('v%02d', a.i) AS feature_1, printf('v%02d', b.i) AS feature_2, round(corr(a.x, b.x), 6) + 0 AS correlation
FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2""")
def g13_wide(spark, d):
    e = table(spark, d, "embeddings")
    cols = [f"v{i:02d}" for i in range(64)]
    x = c.pearson_pairs(e.select(*[F.col("embedding")[i].alias(n) for i, n in enumerate(cols)]), cols)
    return pick(x, "correlation", keep=["feature_1", "feature_2"], places=6)


@query("G14_label_correlation", f"WITH {TAGS_HOURLY} " + " UNION ALL ".join(
    f"SELECT '{t}' AS feature, round({corr_sql(t, 'label')}, 6) + 0 AS correlation FROM tags" for t in TAGS if t != "error"))
def g14(spark, d):
    x = c.label_correlation(tags_hourly(spark, d), [t for t in TAGS if t != "error"], "label")
    return pick(x, "correlation", keep=["feature"], places=6)


AVG_RANK = "(rank() OVER (PARTITION BY feature ORDER BY {x}) + (count(*) OVER (PARTITION BY feature, {x}) - 1) / 2.0)"


@query("G15_score_association", f"""WITH {TALL}, s AS (SELECT feature, value, l_extendedprice_s AS score FROM (
 SELECT 'l_quantity' AS feature, l_quantity AS value, l_extendedprice AS l_extendedprice_s FROM m UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM m
 UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM m)),
k AS (SELECT feature, value, score, {AVG_RANK.format(x='value')} AS rx, {AVG_RANK.format(x='score')} AS ry FROM s)
SELECT feature, count(*) AS rows, round(corr(value, score), 6) + 0 AS pearson_r, round(corr(rx, ry), 6) + 0 AS spearman_r,
CASE WHEN corr(value, score) < 0 THEN 'lower_score_with_higher_feature' ELSE 'higher_score_with_higher_feature' END AS score_direction FROM k GROUP BY 1 UNION ALL SELECT 'steady', count(*), NULL, NULL, 'undefined' FROM lineitem""")
def g15(spark, d):
    x = c.score_association(measures(spark, d), ["l_quantity", "l_discount", "l_tax", "steady"], "l_extendedprice")
    return pick(x, "pearson_r", "spearman_r", keep=["feature", "rows", "score_direction"], places=6)


@query("G15_association_p_values")
def g15_p(spark, d):
    x = c.score_association(measures(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return x.select("feature", "pearson_p", "spearman_p")


@query("G16_family_summary", """SELECT p_brand AS family, count(*) AS features, round(avg(p_retailprice), 4) AS mean_price, round(max(p_retailprice), 4) AS max_price,
round(quantile_cont(p_retailprice, 0.5), 4) AS median_price, round(avg(p_size), 4) AS mean_size, round(max(p_size)::DOUBLE, 4) AS max_size, round(quantile_cont(p_size, 0.5), 4) AS median_size FROM part GROUP BY 1""")
def g16(spark, d):
    pt = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    x = p.family_summary(pt, "family", ["price", "size"])
    return pick(x, *[f"{s}_{v}" for v in ("price", "size") for s in ("mean", "max", "median")], keep=["family", "features"])


DUP = ["l_quantity", "l_tax", "quantity_copy", "l_discount", "tax_copy"]


@query("G17_equal_columns", """SELECT 'l_quantity' AS feature_1, 'quantity_copy' AS feature_2, count(*) AS compared FROM lineitem
UNION ALL SELECT 'l_tax', 'tax_copy', count(*) FROM lineitem WHERE l_discount > 0.02""")
def g17(spark, d):
    li = table(spark, d, "lineitem").withColumns({"quantity_copy": F.col("l_quantity") * 1.0, "tax_copy": F.when(F.col("l_discount") > 0.02, F.col("l_tax"))})
    return c.equal_columns(li, DUP)


PAIR_VIEW = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "charge"]


def _priced(spark, d, cond=None):
    li = table(spark, d, "lineitem")
    li = li.filter(cond) if cond is not None else li
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_quantity", "l_extendedprice", "l_discount", rev.alias("revenue"), (rev * (1 + F.col("l_tax"))).alias("charge"))


PRICED = """pr AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""


@query("G18_family_redundancy", f"""WITH {PRICED}, c AS ({pairs_sql(PAIR_VIEW, 'pr')}), h AS (SELECT *, (feature_1 LIKE 'l_%')::INT AS a, (feature_2 LIKE 'l_%')::INT AS b FROM c WHERE abs(correlation) >= 0.6)
SELECT CASE WHEN least(a, b) = 1 THEN 'raw' ELSE 'derived' END AS family_1, CASE WHEN greatest(a, b) = 1 THEN 'raw' ELSE 'derived' END AS family_2, count(*) AS pairs,
round(max(abs(correlation)), 6) AS max_abs_correlation FROM h GROUP BY 1, 2""")
def g18(spark, d):
    hp = c.high_pairs(c.pearson_pairs(_priced(spark, d), PAIR_VIEW), 0.6)
    fam = lambda x: F.when(F.col(x).startswith("l_"), "raw").otherwise("derived")
    return c.family_pairs(hp, fam("feature_1"), fam("feature_2")).select("family_1", "family_2", "pairs", r("max_abs_correlation").alias("max_abs_correlation"))


@query("G19_pivot_samples", f"""WITH {PRICED}, a AS ({pairs_sql(PAIR_VIEW, 'pr', A)}), b AS ({pairs_sql(PAIR_VIEW, 'pr', B)})
SELECT least(a.feature_1, a.feature_2) AS feature_1, greatest(a.feature_1, a.feature_2) AS feature_2, round(a.correlation, 6) + 0 AS a_correlation, round(b.correlation, 6) + 0 AS b_correlation
FROM a JOIN b ON a.feature_1 = b.feature_1 AND a.feature_2 = b.feature_2""")
def g19(spark, d):
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    a = c.pearson_pairs(_priced(spark, d, F.col("l_shipdate") < cut), PAIR_VIEW).withColumn("sample", F.lit("a"))
    b = c.pearson_pairs(_priced(spark, d, F.col("l_shipdate") >= cut), PAIR_VIEW).withColumn("sample", F.lit("b"))
    return pick(c.pivot_samples(a.unionByName(b), "sample", ["a", "b"]), "a_correlation", "b_correlation", keep=["feature_1", "feature_2"], places=6)


@query("G20_partner_counts", f"""WITH {PRICED}, c AS (SELECT * FROM ({pairs_sql(PAIR_VIEW, 'pr')}) WHERE abs(correlation) >= 0.6),
e AS (SELECT feature_1 AS feature, feature_2 AS partner, correlation FROM c UNION ALL SELECT feature_2, feature_1, correlation FROM c)
SELECT feature, count(*) AS high_correlation_count, round(max(abs(correlation)), 6) AS max_abs_correlation, arg_max(partner, abs(correlation)) AS most_correlated_feature,
string_agg(partner, ';' ORDER BY partner) AS partners FROM e GROUP BY 1""")
def g20(spark, d):
    x = c.partners(c.high_pairs(c.pearson_pairs(_priced(spark, d), PAIR_VIEW), 0.6))
    return x.withColumn("max_abs_correlation", r("max_abs_correlation"))


@query("J13_feature_pairs", f"WITH {PRICED} SELECT feature_1, feature_2, round(correlation, 6) + 0 AS correlation FROM ({pairs_sql(PAIR_VIEW, 'pr')}) WHERE abs(correlation) >= 0.95")
def j13(spark, d):
    x = c.high_pairs(c.pearson_pairs(_priced(spark, d), PAIR_VIEW), 0.95)
    return pick(x, "correlation", keep=["feature_1", "feature_2"], places=6)


@query("A18_correlation_groups", f"""WITH RECURSIVE {PRICED}, c AS (SELECT * FROM ({pairs_sql(PAIR_VIEW, 'pr')}) WHERE abs(correlation) >= 0.9),
e AS (SELECT feature_1 AS a, feature_2 AS b FROM c UNION SELECT feature_2, feature_1 FROM c),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS feature, min(b) AS component FROM reach GROUP BY 1), s AS (SELECT component, count(*) AS group_size FROM g GROUP BY 1)
SELECT dense_rank() OVER (ORDER BY group_size DESC, component) AS group_no, group_size, feature FROM g JOIN s USING (component)""")
def a18(spark, d):
    hp = c.high_pairs(c.pearson_pairs(_priced(spark, d), PAIR_VIEW), 0.9)
    return c.ordered_groups(c.connected_groups(hp.select("feature_1", "feature_2")))


@query("A18_independent_features", f"""WITH {PRICED}, c AS (SELECT * FROM ({pairs_sql(PAIR_VIEW, 'pr')}) WHERE abs(correlation) >= 0.9)
SELECT f.o::INTEGER AS ordinal, f.feature FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(PAIR_VIEW))}) f(o, feature)
WHERE feature NOT IN (SELECT feature_1 FROM c UNION SELECT feature_2 FROM c)""")
def a18_independent(spark, d):
    x = _priced(spark, d)
    hp = c.high_pairs(c.pearson_pairs(x, PAIR_VIEW), 0.9)
    names = schema_table(x.select(*PAIR_VIEW)).select("ordinal", F.col("column_name").alias("feature"))
    return c.independent_features(names, c.connected_groups(hp.select("feature_1", "feature_2"))).select("ordinal", "feature")


@query("A18_components_of_customers", """WITH RECURSIVE p AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS node, min(b) AS component FROM reach GROUP BY 1""")
def a18_customers(spark, d):
    cu = table(spark, d, "customer")
    return c.connected_groups(cu.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("feature_1"),
                                        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("feature_2")))


GAPH = 3600.0


@query("G55_temporal_feasibility", f"""WITH {TAGS_HOURLY}, d AS ({" UNION ALL ".join(f'''SELECT '{t}' AS feature, hour, {t} AS v FROM tags''' for t in TAGS)}),
g AS (SELECT *, CASE WHEN epoch_us(hour) - lag(epoch_us(hour)) OVER (PARTITION BY feature ORDER BY hour) > 3600000000 THEN 1 ELSE 0 END AS brk FROM d),
q AS (SELECT *, sum(brk) OVER (PARTITION BY feature ORDER BY hour) AS s FROM g),
f AS (SELECT feature, v - lag(v) OVER (PARTITION BY feature, s ORDER BY hour) AS df,
 CASE WHEN count(v) OVER w = 5 THEN stddev_samp(v) OVER w END AS sd FROM q WINDOW w AS (PARTITION BY feature, s ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT feature, count(df) AS steps, round(avg((df <> 0)::INT), 6) AS change_rate, round(avg(abs(df)), 6) AS mean_abs_change, round(max(abs(df)), 6) AS max_abs_change,
round(stddev_samp(df), 6) AS std_of_diff, round(avg(sd), 6) AS mean_rolling_std, round(quantile_cont(abs(df), 0.5), 6) AS median_abs_change, round(quantile_cont(abs(df), 0.95), 6) AS p95_abs_change,
round(max(sd), 6) AS max_rolling_std, round(quantile_cont(sd, 0.5), 6) AS median_rolling_std, round(quantile_cont(sd, 0.95), 6) AS p95_rolling_std FROM f GROUP BY 1""")
def g55(spark, d):
    x = p.temporal_feasibility(tags_hourly(spark, d), Series([], ["hour"]), TAGS, GAPH)
    return pick(x, "change_rate", "mean_abs_change", "max_abs_change", "std_of_diff", "mean_rolling_std", "median_abs_change", "p95_abs_change", "max_rolling_std", "median_rolling_std", "p95_rolling_std", keep=["feature", "steps"], places=6)


@query("G56_column_groups", """WITH c AS (SELECT p_type || '_' || replace(p_name, ' ', '_') || p_size AS n FROM part)
SELECT split_part(n, '_', 1) AS process, regexp_replace(split_part(n, '_', -1), '[0-9]+$', '') AS tag_type, count(*) AS columns FROM c GROUP BY 1, 2""")
def g56(spark, d):
    n = F.concat("p_type", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"))
    return p.column_groups(table(spark, d, "part").select(n.alias("name")), "name")


@query("S16_inventory", """SELECT 'lineitem' AS dataset, count(*) AS rows, 11::INTEGER AS columns, 0::BIGINT AS missing, 0::BIGINT AS nan_values, 0::BIGINT AS infinite,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates,
CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) THEN 'PASS' ELSE 'REVIEW' END AS status FROM lineitem
UNION ALL SELECT 'events', count(*), 6, 0, 0, 0, 0, 'PASS' FROM events""")
def s16(spark, d):
    return inventory(table(spark, d, "lineitem"), "lineitem").unionByName(inventory(events(spark, d), "events"))
