"""Queries: Shapley values, attribution shares and seed stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import regimes as R
from .fixtures import Fixtures, add_view
from .registry import query
from .scoring_queries import rounded

GRP = "CASE WHEN feature LIKE 'forward::%' THEN 'forward' ELSE split_part(feature, '::', 2) END"
add_view("fx_attrg", f"SELECT *, {GRP} AS grp FROM fx_attr", "fx_attr")
add_view("fx_sm", f"""
    SELECT date, maturity, feature, {GRP} AS grp, avg(shap_value) AS mean_shap, abs(avg(shap_value)) AS abs_mean_shap, stddev_pop(shap_value) AS std_shap, CAST(count(*) AS BIGINT) AS n_seeds
    FROM fx_attr GROUP BY date, maturity, feature""", "fx_attr")
add_view("fx_mass", "SELECT date, maturity, grp, sum(abs_mean_shap) AS mass FROM fx_sm GROUP BY 1,2,3", "fx_sm")
add_view("fx_sg", "SELECT date, maturity, seed, grp, sum(shap_value) AS signed, sum(abs(shap_value)) AS absolute FROM fx_attrg GROUP BY 1,2,3,4", "fx_attrg")


def sm(fx: Fixtures):
    return A.seed_mean(fx.attr)


def groups(fx: Fixtures):
    return A.seed_groups(fx.attr)


@query("seed_mean_attr", "SELECT date, maturity, feature, round(mean_shap, 10) + 0 AS mean_shap, round(abs_mean_shap, 10) + 0 AS abs_mean_shap, round(std_shap, 10) + 0 AS std_shap, n_seeds FROM fx_sm", "fx_sm")
def q_seed_mean(fx):
    return rounded(sm(fx), mean_shap=10, abs_mean_shap=10, std_shap=10)


@query("block_importance", """
    WITH pf AS (SELECT maturity, grp, feature, avg(abs_mean_shap) AS v FROM fx_sm GROUP BY 1,2,3)
    SELECT maturity, grp, 'total' AS agg, round(avg(mass), 10) + 0 AS value FROM fx_mass GROUP BY 1,2
    UNION ALL SELECT maturity, grp, 'per_feat', round(avg(abs_mean_shap), 10) + 0 FROM fx_sm GROUP BY 1,2
    UNION ALL SELECT maturity, grp, 'feature_mean', round(avg(v), 10) + 0 FROM pf GROUP BY 1,2
    UNION ALL SELECT maturity, grp, 'feature_sum', round(sum(v), 10) + 0 FROM pf GROUP BY 1,2""", "fx_sm fx_mass")
def q_importance(fx):
    return rounded(A.block_importance(sm(fx)), value=10)


@query("block_features", "SELECT grp, CAST(count(DISTINCT feature) AS BIGINT) AS n_features FROM fx_sm GROUP BY 1", "fx_sm")
def q_features(fx):
    return A.block_features(fx.attr)


@query("group_share", """
    WITH a AS (SELECT maturity, grp, avg(mass) AS mass FROM fx_mass GROUP BY 1,2)
    SELECT maturity, grp, round(mass, 10) + 0 AS mass, round(mass/sum(mass) OVER (PARTITION BY maturity), 10) + 0 AS share,
           CAST(row_number() OVER (PARTITION BY maturity ORDER BY round(mass, 12) DESC, grp) AS INTEGER) AS rank FROM a""", "fx_mass")
def q_share(fx):
    return rounded(A.group_shares(sm(fx)), mass=10, share=10)


add_view("fx_mass_dense", """
    SELECT s.maturity, s.grp, d.date, coalesce(m.mass, 0e0) AS mass FROM (SELECT DISTINCT maturity, grp FROM fx_mass) s CROSS JOIN (SELECT DISTINCT date FROM fx_mass) d
    LEFT JOIN fx_mass m ON m.maturity = s.maturity AND m.grp = s.grp AND m.date = d.date""", "fx_mass")


@query("block_share_smoothed", """
    WITH a AS (SELECT *, mass/nullif(sum(mass) OVER (PARTITION BY date, maturity), 0) AS share, avg(mass) OVER w AS sm FROM fx_mass_dense WINDOW w AS (PARTITION BY maturity, grp ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT date, maturity, grp, 'share_then_smooth' AS kind, round(avg(share) OVER (PARTITION BY maturity, grp ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 10) + 0 AS share FROM a
    UNION ALL SELECT date, maturity, grp, 'smooth_then_share', round(sm/nullif(sum(sm) OVER (PARTITION BY date, maturity), 0), 10) + 0 FROM a""", "fx_mass_dense")
def q_smoothed(fx):
    mass = A.group_abs(sm(fx))
    a = A.block_share_path(mass, 6, smooth_first=False).withColumn("kind", F.lit("share_then_smooth"))
    b = A.block_share_path(mass, 6, smooth_first=True).withColumn("kind", F.lit("smooth_then_share"))
    return rounded(a.unionByName(b), share=10)


add_view("fx_macro_share", """
    SELECT date, maturity, coalesce(sum(abs_mean_shap) FILTER (WHERE grp = 'forward'), 0) AS forward, coalesce(sum(abs_mean_shap) FILTER (WHERE grp <> 'forward'), 0) AS macro,
           coalesce(sum(abs_mean_shap) FILTER (WHERE grp <> 'forward'), 0)/nullif(sum(abs_mean_shap), 0) AS macro_share FROM fx_sm GROUP BY 1,2""", "fx_sm")


@query("macro_share", "SELECT date, maturity, round(forward, 10) + 0 AS forward, round(macro, 10) + 0 AS macro, round(forward + macro, 10) + 0 AS total, round(macro_share, 10) + 0 AS macro_share FROM fx_macro_share", "fx_macro_share")
def q_macro_share(fx):
    return rounded(A.macro_share(sm(fx)), forward=10, macro=10, total=10, macro_share=10)


@query("regime_means", """
    WITH f AS (SELECT m.*, EXISTS (SELECT 1 FROM fx_regimes r WHERE m.date BETWEEN last_day(r.start_date) AND last_day(r.end_date)) AS flag FROM fx_macro_share m)
    SELECT maturity, CAST(count(*) FILTER (WHERE NOT flag) AS BIGINT) AS n_out, round(avg(macro_share) FILTER (WHERE NOT flag), 10) + 0 AS out_mean, CAST(count(*) FILTER (WHERE flag) AS BIGINT) AS n_in,
           round(avg(macro_share) FILTER (WHERE flag), 10) + 0 AS in_mean, round(avg(macro_share), 10) + 0 AS sample_mean, round(avg(macro_share) FILTER (WHERE flag) - avg(macro_share) FILTER (WHERE NOT flag), 10) + 0 AS diff
    FROM f GROUP BY 1""", "fx_macro_share fx_regimes")
def q_regime_means(fx):
    f = R.flag_regime(A.macro_share(sm(fx)), fx.regimes)
    return rounded(A.regime_means(f, ["maturity"], "macro_share"), out_mean=10, in_mean=10, sample_mean=10, diff=10)


@query("composition_share", """
    WITH m AS (SELECT grp, avg(mass) AS mass FROM fx_mass WHERE maturity = 60 GROUP BY 1) SELECT grp, round(mass, 10) + 0 AS mass, round(mass/sum(mass) OVER (), 10) + 0 AS share FROM m""", "fx_mass")
def q_composition(fx):
    return rounded(A.composition(sm(fx), 60), mass=10, share=10)


@query("macro_ranking", """
    WITH m AS (SELECT maturity, grp, avg(mass) AS mass FROM fx_mass WHERE grp <> 'forward' GROUP BY 1,2)
    SELECT maturity, grp, round(mass, 10) + 0 AS mass, round(100*mass/sum(mass) OVER (PARTITION BY maturity), 6) + 0 AS share_pct, CAST(row_number() OVER (PARTITION BY maturity ORDER BY round(mass, 12) DESC, grp) AS INTEGER) AS rank FROM m""", "fx_mass")
def q_ranking(fx):
    return rounded(A.macro_ranking(sm(fx)), mass=10, share_pct=6)


@query("top_features_rel", """
    WITH m AS (SELECT maturity, feature, grp, avg(abs_mean_shap) AS value FROM fx_sm WHERE grp <> 'forward' GROUP BY 1,2,3),
         r AS (SELECT *, row_number() OVER (PARTITION BY maturity ORDER BY round(value, 12) DESC, feature) AS rank, value/max(value) OVER (PARTITION BY maturity) AS rel FROM m)
    SELECT maturity, feature, grp, round(value, 10) + 0 AS value, CAST(rank AS INTEGER) AS rank, round(rel, 10) + 0 AS rel, split_part(feature, '::', 3) AS display FROM r WHERE rank <= 10""", "fx_sm")
def q_top(fx):
    return rounded(A.top_features(sm(fx), 10), value=10, rel=10)


# ---- seeds ------------------------------------------------------------------------------------


@query("seed_group_attr", "SELECT date, maturity, seed, grp, round(signed, 10) + 0 AS signed, round(absolute, 10) + 0 AS absolute FROM fx_sg", "fx_sg")
def q_seed_group(fx):
    return rounded(groups(fx), signed=10, absolute=10)


@query("seed_band", "SELECT date, maturity, grp, round(avg(signed), 10) + 0 AS mean, round(min(signed), 10) + 0 AS min, round(max(signed), 10) + 0 AS max, CAST(count(*) AS BIGINT) AS n_seeds FROM fx_sg GROUP BY 1,2,3", "fx_sg")
def q_band(fx):
    return rounded(A.seed_band(groups(fx)), mean=10, min=10, max=10)


@query("seed_spread", """
    SELECT maturity, grp, round(median(s), 10) + 0 AS median, round(avg(s), 10) + 0 AS mean, round(max(s), 10) + 0 AS max
    FROM (SELECT date, maturity, grp, max(signed) - min(signed) AS s FROM fx_sg WHERE grp <> 'forward' GROUP BY 1,2,3) q GROUP BY 1,2""", "fx_sg")
def q_spread(fx):
    return rounded(A.seed_spread(A.seed_band(groups(fx))), median=10, mean=10, max=10)


# the guard against tiny means sits where no mean of either engine can lie within rounding
@query("attr_cov", """
    WITH g AS (SELECT maturity, grp, avg(c) AS group_cov FROM (SELECT date, maturity, grp, CASE WHEN abs(avg(signed)) > 1e-6 THEN stddev_samp(signed)/abs(avg(signed)) END AS c FROM fx_sg GROUP BY 1,2,3) q GROUP BY 1,2),
         f AS (SELECT maturity, grp, avg(c) AS feature_cov FROM (SELECT maturity, grp, feature, avg(c) AS c FROM (SELECT date, maturity, grp, feature, CASE WHEN abs(avg(shap_value)) > 1e-6 THEN stddev_samp(shap_value)/abs(avg(shap_value)) END AS c
               FROM fx_attrg GROUP BY 1,2,3,4) x GROUP BY 1,2,3) y GROUP BY 1,2)
    SELECT g.maturity, g.grp, round(group_cov, 5) + 0 AS group_cov, round(feature_cov, 5) + 0 AS feature_cov FROM g JOIN f ON f.maturity = g.maturity AND f.grp = g.grp""", "fx_sg fx_attrg")
def q_cov(fx):
    return rounded(A.variation(fx.attr, groups(fx)), group_cov=5, feature_cov=5)


def agreement_sql(view: str, item: str, value: str) -> str:
    return f"""
    WITH v AS (SELECT date, maturity, seed, {item} AS item, abs({value}) AS v FROM {view}),
         r AS (SELECT *, rank() OVER (PARTITION BY date, maturity, seed ORDER BY v) + (count(*) OVER (PARTITION BY date, maturity, seed, v) - 1)/2e0 AS r FROM v),
         n AS (SELECT date, maturity, count(DISTINCT item) AS n FROM v GROUP BY 1,2),
         f AS (SELECT r.date, r.maturity, r.seed, n.n FROM r JOIN n ON n.date = r.date AND n.maturity = r.maturity GROUP BY ALL HAVING count(*) = n.n AND n.n >= 3),
         x AS (SELECT r.* FROM r JOIN f ON f.date = r.date AND f.maturity = r.maturity AND f.seed = r.seed),
         p AS (SELECT a.date, a.maturity, a.seed, b.seed AS other, covar_pop(a.r, b.r)/nullif(stddev_pop(a.r)*stddev_pop(b.r), 0) AS rho
               FROM x a JOIN x b ON a.date = b.date AND a.maturity = b.maturity AND a.item = b.item AND a.seed < b.seed GROUP BY 1,2,3,4)
    SELECT date, maturity, round(avg(rho), 10) + 0 AS mean_rho, round(min(rho), 10) + 0 AS min_rho, CAST(count(rho) AS INTEGER) AS n_pairs FROM p GROUP BY 1,2 HAVING count(rho) > 0"""


@query("rank_agreement", agreement_sql("(SELECT date, maturity, seed, grp, round(signed, 10) AS signed FROM fx_sg WHERE grp <> 'forward') q", "grp", "signed"), "fx_sg")
def q_agreement(fx):
    g = A.macro_only(groups(fx)).withColumn("signed", F.round("signed", 10))
    return rounded(A.rank_agreement(g, "grp", "signed"), mean_rho=10, min_rho=10)


add_view("fx_feature_seed", "SELECT date, maturity, seed, feature, avg(shap_value) AS v FROM fx_attr GROUP BY 1,2,3,4", "fx_attr")


@query("rank_agreement_features", agreement_sql("fx_feature_seed", "feature", "v"), "fx_feature_seed")
def q_agreement_features(fx):
    return rounded(A.rank_agreement(fx.attr, "feature", "shap_value"), mean_rho=10, min_rho=10)


@query("seed_share_sd", """
    WITH m AS (SELECT maturity, seed, grp, avg(abs(shap_value)) AS mass FROM fx_attrg GROUP BY 1,2,3), s AS (SELECT *, mass/sum(mass) OVER (PARTITION BY maturity, seed) AS share FROM m)
    SELECT maturity, grp, round(stddev_pop(share), 10) + 0 AS share_sd, round(avg(share), 10) + 0 AS share_mean, CAST(count(*) AS BIGINT) AS n_seeds FROM s GROUP BY 1,2""", "fx_attrg")
def q_share_sd(fx):
    return rounded(A.seed_share_spread(fx.attr), share_sd=10, share_mean=10)


@query("within_date_sd", """
    WITH s AS (SELECT *, absolute/nullif(sum(absolute) OVER (PARTITION BY date, maturity, seed), 0) AS share FROM fx_sg),
         d AS (SELECT date, maturity, grp, coalesce(stddev_samp(share), 0) AS sd, max(share) - min(share) AS rg FROM s GROUP BY 1,2,3)
    SELECT maturity, grp, round(quantile_cont(sd, 0.5), 10) + 0 AS sd_median, round(quantile_cont(sd, 0.75), 10) + 0 AS sd_p75, round(quantile_cont(rg, 0.5), 10) + 0 AS range_median, round(quantile_cont(rg, 0.75), 10) + 0 AS range_p75 FROM d GROUP BY 1,2""", "fx_sg")
def q_within(fx):
    return rounded(A.within_date_spread(groups(fx)), sd_median=10, sd_p75=10, range_median=10, range_p75=10)


def model_share_sql(cond: str) -> str:
    return f"""(SELECT maturity, grp, mass/sum(mass) OVER (PARTITION BY maturity) AS share FROM (SELECT maturity, grp, avg(mass) AS mass FROM (SELECT date, maturity, grp, sum(a) AS mass
        FROM (SELECT date, maturity, feature, grp, abs(avg(shap_value)) AS a FROM fx_attrg WHERE {cond} GROUP BY 1,2,3,4) q WHERE grp <> 'forward' GROUP BY 1,2,3) z GROUP BY 1,2) y)"""


@query("model_agreement", f"""
    SELECT a.grp, round(avg(abs(a.share - b.share)), 10) + 0 AS mean_abs_diff, round(max(abs(a.share - b.share)), 10) + 0 AS max_abs_diff, round(avg(a.share), 10) + 0 AS share_a, round(avg(b.share), 10) + 0 AS share_b
    FROM {model_share_sql('seed < 3')} a JOIN {model_share_sql('seed >= 3')} b ON b.maturity = a.maturity AND b.grp = a.grp GROUP BY 1""", "fx_attrg")
def q_model_agreement(fx):
    attr = fx.shared(fx.attr)
    side = lambda cond: A.group_shares(A.seed_mean(attr.where(cond)), keep_forward=False)
    out = A.model_agreement(side(F.col("seed") < 3), side(F.col("seed") >= 3))
    return rounded(out, mean_abs_diff=10, max_abs_diff=10, share_a=10, share_b=10)


@query("seed_coverage", "SELECT date, maturity, CAST(count(DISTINCT seed) AS BIGINT) AS n_seeds, CAST(count(DISTINCT feature) AS BIGINT) AS n_features, CAST(count(*) AS BIGINT) AS n_rows FROM fx_attr GROUP BY 1,2", "fx_attr")
def q_coverage(fx):
    return A.coverage(fx.attr)


@query("seed_dates", "SELECT seed, CAST(count(DISTINCT date) AS BIGINT) AS n_dates, CAST(count(*) AS BIGINT) AS n_cells FROM (SELECT DISTINCT seed, date, maturity FROM fx_attr) q GROUP BY 1", "fx_attr")
def q_seed_dates(fx):
    return A.seed_dates(fx.attr)


# ---- exact Shapley ----------------------------------------------------------------------------

PLAYERS = ["forward", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
N = len(PLAYERS)
PLAYER_SQL = "CASE grp " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(PLAYERS)) + " END"
# contributions per date and maturity: block sums of the seed means; background is the maturity's mean
add_view("fx_contrib", f"""
    SELECT date, maturity, {PLAYER_SQL} AS player, grp, sum(mean_shap) AS inside FROM fx_sm GROUP BY ALL""", "fx_sm")
add_view("fx_players", f"""
    SELECT d.date, d.maturity, p.player, p.grp, coalesce(c.inside, 0e0) AS inside, coalesce(b.outside, 0e0) AS outside
    FROM (SELECT DISTINCT date, maturity FROM fx_contrib) d CROSS JOIN (VALUES {', '.join(f"({i}, '{g}')" for i, g in enumerate(PLAYERS))}) p(player, grp)
    LEFT JOIN fx_contrib c ON c.date = d.date AND c.maturity = d.maturity AND c.player = p.player
    LEFT JOIN (SELECT maturity, player, avg(inside) AS outside FROM fx_contrib GROUP BY 1,2) b ON b.maturity = d.maturity AND b.player = p.player""", "fx_contrib")
add_view("fx_coal", f"""
    SELECT k.date, k.maturity, s.bits, sum(CASE WHEN (s.bits >> k.player) & 1 = 1 THEN k.inside ELSE k.outside END)
           + CASE WHEN (s.bits & 3) = 3 THEN 10e0*max(k.inside) FILTER (WHERE player = 0)*max(k.inside) FILTER (WHERE player = 1) ELSE 0 END AS v
    FROM fx_players k CROSS JOIN (SELECT CAST(unnest(range({1 << N})) AS INTEGER) AS bits) s GROUP BY 1,2,3""", "fx_players")
add_view("fx_phi", f"""
    WITH w AS (SELECT a.date, a.maturity, i.player, bit_count(a.bits) AS s, b.v - a.v AS d FROM fx_coal a CROSS JOIN (SELECT CAST(unnest(range({N})) AS INTEGER) AS player) i
               JOIN fx_coal b ON b.date = a.date AND b.maturity = a.maturity AND b.bits = a.bits + (1 << i.player) WHERE (a.bits >> i.player) & 1 = 0)
    SELECT date, maturity, player, sum(d*CAST(factorial(CAST(s AS INTEGER)) AS DOUBLE)*CAST(factorial(CAST({N - 1} - s AS INTEGER)) AS DOUBLE)/CAST(factorial({N}) AS DOUBLE)) AS phi FROM w GROUP BY 1,2,3""", "fx_coal")


def players(fx: Fixtures):
    return player_rows(A.with_block(sm(fx)).withColumnRenamed("mean_shap", "v"), A.CELL)


def player_rows(parts, keys: list[str]):
    """Contributions of all players per cell of ``parts`` (keys, grp, v) and their background; an unknown player fails."""
    at = F.array_position(F.array(*map(F.lit, PLAYERS)), F.col("grp")) - 1
    name = F.when(at >= 0, F.col("grp")).otherwise(F.raise_error(F.concat(F.lit("unknown player: "), F.col("grp"))))
    contrib = parts.withColumn("grp", name).groupBy(*keys).pivot("grp", PLAYERS).agg(F.sum("v"))
    rows = contrib.unpivot(keys, PLAYERS, "grp", "inside").withColumn("player", at.cast("int"))
    back = F.avg("inside").over(A.Window.partitionBy(*[k for k in keys if k != "date"], "player"))
    return rows.select(*keys, "player", "grp", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.coalesce(back, F.lit(0.0)).alias("outside"))


def joint_term():
    return F.when(F.col("bits").bitwiseAND(F.lit(3)) == 3, 10.0 * F.get("_x", F.lit(0)) * F.get("_x", F.lit(1))).otherwise(0.0)


def coalitions(fx: Fixtures):
    return A.coalition_values(players(fx), A.CELL, N, joint_term())


@query("coalition_values", "SELECT date, maturity, bits, round(v, 10) + 0 AS v FROM fx_coal", "fx_coal")
def q_coalitions(fx):
    return rounded(coalitions(fx), v=10)


@query("group_shapley", "SELECT date, maturity, player, round(phi, 10) + 0 AS phi FROM fx_phi", "fx_phi")
def q_shapley(fx):
    return rounded(A.shapley(coalitions(fx), A.CELL, N), phi=10)


add_view("fx_seed_players", f"""
    WITH c AS (SELECT date, maturity, seed, {PLAYER_SQL} AS player, signed AS inside FROM fx_sg)
    SELECT d.date, d.maturity, d.seed, p.player, coalesce(c.inside, 0e0) AS inside, coalesce(b.outside, 0e0) AS outside
    FROM (SELECT DISTINCT date, maturity, seed FROM c) d CROSS JOIN (SELECT CAST(unnest(range({N})) AS INTEGER) AS player) p
    LEFT JOIN c ON c.date = d.date AND c.maturity = d.maturity AND c.seed = d.seed AND c.player = p.player
    LEFT JOIN (SELECT maturity, seed, player, avg(inside) AS outside FROM c GROUP BY 1,2,3) b ON b.maturity = d.maturity AND b.seed = d.seed AND b.player = p.player""", "fx_sg")
# the score is linear but for one joint term, so a player's value is its own gap plus half of what the joint term adds with the other
add_view("fx_seed_phi", """
    WITH j AS (SELECT date, maturity, seed, 10e0*max(inside) FILTER (WHERE player = 0)*max(inside) FILTER (WHERE player = 1) AS x FROM fx_seed_players GROUP BY 1,2,3)
    SELECT k.date, k.maturity, k.seed, k.player, k.inside - k.outside + CASE WHEN k.player < 2 THEN j.x/2 ELSE 0 END AS phi
    FROM fx_seed_players k JOIN j ON j.date = k.date AND j.maturity = k.maturity AND j.seed = k.seed""", "fx_seed_players")


@query("group_shapley_seeds", """
    SELECT date, maturity, player, round(avg(phi), 9) + 0 AS mean_shap, round(abs(avg(phi)), 9) + 0 AS abs_mean_shap, round(stddev_pop(phi), 9) + 0 AS std_shap, CAST(count(*) AS BIGINT) AS n_seeds
    FROM fx_seed_phi GROUP BY 1,2,3""", "fx_seed_phi")
def q_shapley_seeds(fx):
    keys = [*A.CELL, "seed"]
    rows = player_rows(groups(fx).withColumnRenamed("signed", "v"), keys)
    phi = A.shapley(A.coalition_values(rows, keys, N, joint_term()), keys, N)
    return rounded(A.over_seeds(phi, A.CELL), mean_shap=9, abs_mean_shap=9, std_shap=9)


@query("binary_shapley", """
    WITH p AS (SELECT date, maturity, sum(inside) FILTER (WHERE player = 0) AS fi, sum(outside) FILTER (WHERE player = 0) AS fo, sum(inside) FILTER (WHERE player > 0) AS mi, sum(outside) FILTER (WHERE player > 0) AS mo FROM fx_players GROUP BY 1,2),
         v AS (SELECT date, maturity, fo + mo AS v0, fi + mo AS v1, fo + mi AS v2, fi + mi + 10e0*fi*mi AS v3 FROM p)
    SELECT date, maturity, 0 AS player, round(((v1 - v0) + (v3 - v2))/2, 10) + 0 AS phi FROM v UNION ALL SELECT date, maturity, 1, round(((v2 - v0) + (v3 - v1))/2, 10) + 0 FROM v""", "fx_players")
def q_binary(fx):
    two = players(fx).groupBy(*A.CELL, F.least(F.col("player"), F.lit(1)).alias("player")).agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    joint = F.when(F.col("bits") == 3, 10.0 * F.get("_x", F.lit(0)) * F.get("_x", F.lit(1))).otherwise(0.0)
    return rounded(A.shapley(A.coalition_values(two, A.CELL, 2, joint), A.CELL, 2), phi=10)


@query("additivity_check", f"""
    WITH e AS (SELECT date, maturity, max(v) FILTER (WHERE bits = 0) AS b, max(v) FILTER (WHERE bits = {(1 << N) - 1}) AS p FROM fx_coal GROUP BY 1,2), s AS (SELECT date, maturity, sum(phi) AS s FROM fx_phi GROUP BY 1,2)
    SELECT e.date, e.maturity, round(b*2e0 + 0.01e0, 10) + 0 AS base_value, round(p*2e0 + 0.01e0, 10) + 0 AS prediction, round(abs((p*2e0 + 0.01e0) - (b*2e0 + 0.01e0 + s.s*2e0)), 10) + 0 AS residual FROM e JOIN s ON s.date = e.date AND s.maturity = e.maturity""", "fx_coal fx_phi")
def q_additivity(fx):
    c = coalitions(fx)
    return rounded(A.additivity(c, A.shapley(c, A.CELL, N), A.CELL, N, 2.0, 0.01), base_value=10, prediction=10, residual=10)


@query("background_means", """
    SELECT maturity, 'sampled' AS kind, round(avg(y), 10) + 0 AS background, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY maturity ORDER BY md5(concat(CAST(date AS VARCHAR), '|7'))) AS rn FROM fx_curve WHERE date <= DATE '2000-12-31') q WHERE rn <= 20 GROUP BY 1
    UNION ALL SELECT maturity, 'last', round(avg(y), 10) + 0, CAST(count(*) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY maturity ORDER BY date DESC) AS rn FROM fx_curve WHERE date <= DATE '2000-12-31') z WHERE rn <= 20 GROUP BY 1""", "fx_curve")
def q_background(fx):
    train = fx.curve.where(F.col("date") <= "2000-12-31")
    a = A.background(train, ["maturity"], "y", 20, seed=7).withColumn("kind", F.lit("sampled"))
    b = A.background(train, ["maturity"], "y", 20).withColumn("kind", F.lit("last"))
    return rounded(a.unionByName(b), background=10)


@query("naive_vs_exact", f"""
    WITH n AS (SELECT maturity, grp, avg(mass) AS i FROM fx_mass GROUP BY 1,2),
         e AS (SELECT maturity, CASE player {' '.join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(PLAYERS))} END AS grp, avg(abs(phi)) AS i FROM fx_phi GROUP BY 1,2),
         b AS (SELECT coalesce(n.maturity, e.maturity) AS maturity, coalesce(n.grp, e.grp) AS grp, coalesce(n.i, 0) AS n, coalesce(e.i, 0) AS e FROM n FULL OUTER JOIN e ON n.maturity = e.maturity AND n.grp = e.grp),
         s AS (SELECT maturity, grp, 100*n/sum(n) OVER (PARTITION BY maturity) AS n, 100*e/sum(e) OVER (PARTITION BY maturity) AS e FROM b)
    SELECT maturity, grp, round(n, 6) + 0 AS naive_pct, round(e, 6) + 0 AS exact_pct, round(e - n, 6) + 0 AS diff_pp FROM s""", "fx_mass fx_phi")
def q_naive_exact(fx):
    naive = A.group_average(A.group_abs(sm(fx))).withColumnRenamed("mass", "importance")
    name = F.element_at(F.array(*map(F.lit, PLAYERS)), F.col("player") + 1)
    exact = A.shapley(coalitions(fx), A.CELL, N).groupBy("maturity", name.alias("grp")).agg(F.avg(F.abs("phi")).alias("importance"))
    return rounded(A.compare_aggregations(naive, exact), naive_pct=6, exact_pct=6, diff_pp=6)
