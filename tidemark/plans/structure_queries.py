"""Groups, similarity, percolation and communities: registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import communities, percolation, signals, snapshots, structure
from tidemark.plans import signal_queries as sq
from tidemark.plans import sql
from tidemark.plans.common import rounded, stored
from tidemark.plans.registry import MARKET, QUESTIONS, default_signals
from tidemark.session import materialize, scratch_path
from tidemark.sources import adapters


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        told = signals.build(sq._features(spark, sf_dir), default_signals())
        return structure.groups(structure.state_vectors(told, QUESTIONS))

    return stored(spark, sf_dir, "groups", build)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = _groups(spark, sf_dir)
    return found, stored(spark, sf_dir, "pairs", lambda: structure.pair_similarity(found))


def combination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _groups(spark, sf_dir)
    return found.select("idx", "group_key", "size", F.concat_ws("|", "state_vector").alias("state_vector"), F.concat_ws("|", "tokens").alias("tokens"), "sample")


def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.token_weights(_groups(spark, sf_dir)))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_graph(spark, sf_dir)[1])


def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.histogram(*_graph(spark, sf_dir)))


def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.nearest_groups(*_graph(spark, sf_dir)))


def families_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.families(*_graph(spark, sf_dir), 0.6)


def _forest(spark: SparkSession, sf_dir: str, lens: str = "jaccard") -> DataFrame:
    return stored(spark, sf_dir, f"forest-{lens}", lambda: percolation.spanning_forest(percolation.weighted(_graph(spark, sf_dir)[1], lens)))


def _sweep_of(spark: SparkSession, sf_dir: str, lens: str = "jaccard") -> DataFrame:
    found, forest = _groups(spark, sf_dir), _forest(spark, sf_dir, lens)
    return stored(spark, sf_dir, f"sweep-{lens}", lambda: percolation.sweep(found, materialize(percolation.merge_tree(forest), "tree")))


def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the forest's edges, ascending: any maximum spanning forest has the same."""
    told = _forest(spark, sf_dir, "idf").groupBy("weight").agg(F.count("*").alias("n"))
    return told.groupBy(F.round("weight", 6).alias("weight")).agg(F.sum("n").alias("n"))


def merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.merge_tree(_forest(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sweep_of(spark, sf_dir))


def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, stats = _groups(spark, sf_dir), _sweep_of(spark, sf_dir)
    return rounded(structure.threshold_candidates(stats, found.count()).crossJoin(structure.percolation_peak(stats)))


#: Two thresholds of the weighted Jaccard similarity between which the largest family of the test tables breaks.
BEFORE, AFTER, AUDIT = 0.69, 0.7, 0.8


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, forest = _groups(spark, sf_dir), _forest(spark, sf_dir, "idf")
    return stored(spark, sf_dir, "broken", lambda: percolation.pieces(found, percolation.cut(found, forest, BEFORE), percolation.cut(found, forest, AFTER)))


def percolation_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits of both lenses: the thresholds before and at them, the pieces of the largest family and their sizes."""
    found, parts = _groups(spark, sf_dir), None
    for lens in ("idf", "hamming"):
        stats, forest = _sweep_of(spark, sf_dir, lens), _forest(spark, sf_dir, lens)
        for kind in ("first", "peak"):
            at = percolation.split(stats, kind == "first")
            if at:
                broken = percolation.pieces(found, percolation.cut(found, forest, at[0]), percolation.cut(found, forest, at[1]))
                told = broken.groupBy("piece").agg(F.count("*").alias("groups")).select(
                    F.lit(lens).alias("lens"), F.lit(kind).alias("split"), F.lit(at[0]).alias("before"), F.lit(at[1]).alias("at"), F.col("piece").cast("long").alias("piece"), "groups"
                )
                parts = told if parts is None else parts.unionByName(told)
    return parts if parts is not None else spark.createDataFrame([], "lens string, split string, before double, at double, piece long, groups long")


def hamming_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the largest family, held against the Hamming similarity."""
    found, pairs = _graph(spark, sf_dir)
    return rounded(percolation.hamming_audit(found, pairs, _broken(spark, sf_dir), AUDIT))


def piece_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(percolation.piece_contrast(_groups(spark, sf_dir), _broken(spark, sf_dir)))


def broken_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pairs = _graph(spark, sf_dir)
    return rounded(percolation.broken_bridges(found, percolation.weighted(pairs, "idf"), _broken(spark, sf_dir), BEFORE, AFTER))


def family_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pairs = _graph(spark, sf_dir)
    return structure.top_tokens(found, structure.families(found, pairs, 0.6))


def bridge_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens on the edges that are lost between two thresholds and joined families."""
    found, pairs = _graph(spark, sf_dir)
    low, high = structure.families(found, pairs, 0.4), structure.families(found, pairs, 0.7)
    lost = structure.bridges(pairs, low, high, 0.4, 0.7)
    return rounded(structure.bridge_tokens(found, lost, found.count()))


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.sparse_graph(_graph(spark, sf_dir)[1]))


def partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pairs = _graph(spark, sf_dir)
    return rounded(structure.partition_grid(found, pairs, [0.4, 0.6, 0.8], [0.6, 0.8]))


def state_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = signals.build(sq._features(spark, sf_dir), default_signals())
    return rounded(structure.state_diversity(structure.state_vectors(told, QUESTIONS)))


def flow_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pairs = _graph(spark, sf_dir)
    return communities.label_flow(found, materialize(structure.sparse_graph(pairs), "sparse"))


def markov_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pairs = _graph(spark, sf_dir)
    return communities.markov(found, materialize(structure.sparse_graph(pairs), "sparse"))


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, with the modularity of the whole partition on every row."""
    found, pairs = _graph(spark, sf_dir)
    edges = materialize(structure.sparse_graph(pairs), "sparse")
    labels = materialize(communities.louvain(found, edges), "louvain")
    return rounded(labels.crossJoin(F.broadcast(communities.modularity(labels, edges))))


def family_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the threshold families on the sparse graph, and each family's density."""
    found, pairs = _graph(spark, sf_dir)
    edges = materialize(structure.sparse_graph(pairs), "sparse")
    labels = structure.families(found, pairs, 0.6)
    return rounded(communities.summaries(labels, edges).crossJoin(F.broadcast(communities.modularity(labels, edges).select("modularity"))))


def _market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of each company's listed share from quarter end to quarter end, as features of the price axis."""
    quarter = F.last_day(F.add_months(F.trunc("price_date", "quarter"), 2))
    closes = adapters.bars(spark, sf_dir).groupBy("ticker", quarter.alias("end")).agg(F.max_by("close", "price_date").alias("close"))
    w = Window.partitionBy("ticker").orderBy("end")
    told = closes.select(F.col("ticker").alias("listed"), "end", *[(F.col("close") / F.lag("close", n).over(w) - 1).alias(k) for k, n in (("yearReturn", 4), ("quarterReturn", 1))])
    flat = told.select("listed", "end", F.explode(F.array(*[F.struct(F.lit(k).alias("feature_key"), F.round(k, 9).alias("feature_value")) for k in ("yearReturn", "quarterReturn")])).alias("f"))
    return adapters.companies(spark, sf_dir).join(flat, "listed").where("f.feature_value is not null").select(
        "ticker", "cik", F.lit("momentum").alias("factor"), F.lit(MARKET).alias("axis"), F.lit("price").alias("metric_key"), "f.feature_key", "f.feature_value", F.col("end").alias("period_end"), F.col("end").alias("effective_date")
    )


def _signals_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of both axes at 32 quarter ends."""
    def build() -> DataFrame:
        rows = sq._features(spark, sf_dir).unionByName(_market_features(spark, sf_dir))
        return signals.states(rows, default_signals(with_market=True), sq.QUARTERS)

    return stored(spark, sf_dir, "signals-at", build)


def structure_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of every scope at 32 quarter ends, through a store that first got the quarters up to 1999, then all."""
    at = snapshots.scoped(_signals_at(spark, sf_dir))
    store = snapshots.SnapshotStore(spark, scratch_path(spark, "snapshots"))
    store.update(at.where("as_of < date'2000-01-01'"))
    store.update(at)
    core = F.concat_ws(",", F.transform("core", lambda x: F.concat(x["token"], F.lit(":"), F.format_number(x["share"], 4))))
    return store.rows().drop("mark").withColumn("core", core)


def gated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the end of 2000 by the questions whose policy lets them be used, over fundamental axes."""
    size = adapters.companies(spark, sf_dir).count()
    valid = signals.validation(sq._features(spark, sf_dir), default_signals(), size)
    policies = signals.question_policies(signals.question_states(valid, size)).withColumn("is_active", F.col("dominant_share") < 0.9)
    # states of one axis at one date; no other axis or date has a part in them
    own = sq._features(spark, sf_dir).where(F.col("axis") == sq.AXIS)
    at = snapshots.scoped(signals.states(own, default_signals(), ["2000-12-31"])).where("scope = 'fundamentals'")
    return snapshots.state_groups(snapshots.gated(at, policies)).select("scope", "as_of", "idx", "size", F.concat_ws("|", "state").alias("state"), F.concat_ws("|", "tokens").alias("tokens"))


QUERIES = {f.__name__: f for f in (
    combination_groups, token_weights, pair_similarity, similarity_histogram, similar_groups, families_at_threshold, spanning_forest, merge_tree, threshold_sweep, threshold_candidates,
    structure_snapshots, gated_groups, percolation_splits, hamming_audit, piece_contrast, broken_bridges,
    family_tokens, bridge_analysis, sparse_graph, partition_agreement, state_diversity, flow_communities, markov_communities, louvain_communities, family_modularity,
)}

_BASE = f"""WITH RECURSIVE {sq._FEATURES}, {sq._LATEST.format(where='')}, {sq._AGG}, {sq._rules_sql()}, {sq._CHOSEN},
asked(factor) AS (VALUES {', '.join(f"('{f}')" for f, _ in QUESTIONS)}),
answers AS (SELECT n.entity, a.factor || '.{sq.AXIS}' AS question, c.signal_key FROM (SELECT DISTINCT entity FROM chosen) n CROSS JOIN asked a LEFT JOIN chosen c ON c.entity = n.entity AND c.factor = a.factor),
vectors AS (SELECT entity, list_sort(list(question || '=' || coalesce(signal_key, 'missing'))) AS vec, list_sort(coalesce(list(question || '.' || signal_key) FILTER (signal_key IS NOT NULL AND signal_key NOT LIKE 'mixed\\_%' ESCAPE '\\'), [])) AS tokens FROM answers GROUP BY 1),
grouped AS (SELECT vec, any_value(tokens) AS tokens, count(*) AS size, min(entity) AS sample, substr(sha1(array_to_string(vec, '|')), 1, 12) AS group_key FROM vectors GROUP BY vec),
gr AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_key) - 1 AS idx FROM grouped)"""
_PAIRS = f"""{_BASE},
tok AS (SELECT idx, size, unnest(tokens) AS token FROM gr),
w AS (SELECT token, count(*) AS df, least(ln(1 + (SELECT count(*) FROM gr) / count(*)), 3.0) AS weight FROM tok GROUP BY 1),
tw AS (SELECT tok.*, weight FROM tok JOIN w USING (token)),
ns AS (SELECT idx, count(*) AS n, sum(weight) AS w FROM tw GROUP BY 1),
meet AS (SELECT x.idx AS a, y.idx AS b, count(*) AS shared, sum(x.weight) AS sw FROM tw x JOIN tw y ON x.token = y.token AND x.idx < y.idx GROUP BY 1, 2),
every AS (
  SELECT ga.idx AS a, gb.idx AS b, coalesce(m.shared, 0) AS shared, coalesce(m.sw, 0) AS sw, coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(m.shared, 0) AS u, coalesce(na.w, 0) + coalesce(nb.w, 0) - coalesce(m.sw, 0) AS uw,
    list_sum(list_transform(list_zip(ga.vec, gb.vec), lambda p: (p[1] <> p[2])::INT)) AS different, len(ga.vec) AS ln_
  FROM gr ga JOIN gr gb ON ga.idx < gb.idx LEFT JOIN meet m ON m.a = ga.idx AND m.b = gb.idx LEFT JOIN ns na ON na.idx = ga.idx LEFT JOIN ns nb ON nb.idx = gb.idx),
ham AS (SELECT a, b, shared, u AS "union", CASE WHEN u > 0 THEN shared / u ELSE 0 END AS jaccard, CASE WHEN shared > 0 THEN sw / uw ELSE 0 END AS idf_jaccard, different, ln_, 1 - different / ln_ AS hamming
  FROM every WHERE different < ln_)"""


def _families(name: str, threshold: str, lens: str = "jaccard") -> str:
    return f"""{name}_e AS (SELECT a, b FROM ham WHERE {lens} > 0 AND {lens} >= {threshold} UNION SELECT b, a FROM ham WHERE {lens} > 0 AND {lens} >= {threshold}),
{name}_r(node, reached) AS (SELECT idx, idx FROM gr UNION SELECT r.node, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.reached),
{name} AS (SELECT node AS idx, min(reached) AS label FROM {name}_r GROUP BY 1)"""


_SPARSE = """both_ AS (SELECT a, b, idf_jaccard AS weight FROM ham WHERE idf_jaccard >= 0.08 UNION ALL SELECT b, a, idf_jaccard FROM ham WHERE idf_jaccard >= 0.08),
sparse AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, weight FROM (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) <= 14))"""

_BOTH_SPARSE = "bs AS MATERIALIZED (SELECT a, b, weight FROM sparse UNION ALL SELECT b, a, weight FROM sparse)"


def _sweep_sql(lens: str = "jaccard", name: str = "sweep") -> str:
    """The sweep by the labels at each of the thresholds, from all edges."""
    at = f"least(100, floor(round({lens}, 12) * 100))"
    return f"""{name}_t AS (SELECT range AS t FROM range(101)),
{name}_e AS (SELECT t, a, b FROM ham JOIN {name}_t ON {lens} > 0 AND t <= {at} UNION SELECT t, b, a FROM ham JOIN {name}_t ON {lens} > 0 AND t <= {at}),
{name}_r(t, node, reached) AS (SELECT t, idx, idx FROM gr, {name}_t UNION SELECT r.t, r.node, e.b FROM {name}_r r JOIN {name}_e e ON e.t = r.t AND e.a = r.reached),
{name}_l AS (SELECT t, node, min(reached) AS label FROM {name}_r GROUP BY 1, 2), {name}_z AS (SELECT t, label, count(*) AS n FROM {name}_l GROUP BY 1, 2),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, label) AS r FROM {name}_z),
{name} AS (SELECT t / 100 AS threshold, count(*) AS families, max(n) AS largest, coalesce(max(n) FILTER (r = 2), 0) AS second, count(*) FILTER (n = 1) AS singletons,
  CAST(coalesce(sum(n * n) FILTER (r > 1), 0) AS BIGINT) AS second_moment, coalesce(sum(n * n) FILTER (r > 1) / sum(n) FILTER (r > 1), 0) AS mean_finite_size FROM {name}_k GROUP BY t)"""


_SWEEP = _sweep_sql()
_BROKEN = f"""{_families('fb', str(BEFORE), 'round(idf_jaccard, 12)')}, {_families('fa', str(AFTER), 'round(idf_jaccard, 12)')},
big AS (SELECT label FROM fb GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1), inner_ AS (SELECT idx, fa.label FROM fb JOIN big USING (label) JOIN fa USING (idx)),
pc AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS piece, count(*) AS groups FROM inner_ GROUP BY 1), broken AS (SELECT piece, idx, groups FROM inner_ JOIN pc USING (label))"""
_SHARES = """ps AS (SELECT piece, token, sum(size) / any_value(whole) AS share, CAST(sum(size) AS BIGINT) AS entities, count(*) AS groups FROM broken JOIN tok USING (idx) JOIN (SELECT piece, sum(size) AS whole FROM broken JOIN gr USING (idx) GROUP BY 1) USING (piece) GROUP BY 1, 2),
base AS (SELECT token, sum(size) / (SELECT sum(size) FROM broken JOIN gr USING (idx)) AS baseline_share FROM broken JOIN tok USING (idx) GROUP BY 1)"""


_AT = f"""WITH RECURSIVE {sq._FEATURES.replace('features AS (', 'funda AS (')}, {sql.COMPANIES.strip()}, {sql.BARS.strip()},
qc AS (SELECT ticker, last_day(date_trunc('quarter', price_date) + INTERVAL 2 MONTH) AS "end", arg_max(close, price_date) AS close FROM bars GROUP BY 1, 2),
qr AS (SELECT ticker, "end", round(close / lag(close, 4) OVER w - 1, 9) AS y, round(close / lag(close) OVER w - 1, 9) AS q FROM qc WINDOW w AS (PARTITION BY ticker ORDER BY "end")),
features AS MATERIALIZED (SELECT ticker, cik, factor, axis, metric_key, feature_key, feature_value, period_end, effective_date FROM funda
  UNION ALL SELECT c.ticker, c.cik, 'momentum', '{MARKET}', 'price', k, CASE k WHEN 'yearReturn' THEN y ELSE q END, "end", "end" FROM companies c JOIN qr ON qr.ticker = c.listed, (VALUES ('yearReturn'), ('quarterReturn')) f(k) WHERE CASE k WHEN 'yearReturn' THEN y ELSE q END IS NOT NULL),
dates(as_of) AS (VALUES {', '.join(f"(DATE '{d}')" for d in sq.QUARTERS)}),
latest AS (SELECT cik AS entity, d.as_of, f.* FROM features f JOIN dates d ON f.effective_date <= d.as_of
  QUALIFY row_number() OVER (PARTITION BY cik, d.as_of, factor, axis, metric_key, feature_key ORDER BY effective_date DESC, period_end DESC) = 1),
agg AS MATERIALIZED (SELECT entity, as_of, factor, axis, feature_key, median(feature_value) AS value, count(DISTINCT metric_key) AS metrics FROM latest GROUP BY 1, 2, 3, 4, 5),
hit AS ({' UNION ALL '.join(
    f"SELECT entity, as_of, factor, axis, '{s.signal_key}' AS signal_key, {s.priority} AS priority FROM agg WHERE factor = '{s.factor}' GROUP BY ALL HAVING "
    + (' AND '.join([f"count(*) FILTER (feature_key = '{c.feature_key}' AND metrics >= {c.least_metrics} AND value {c.operator} {c.value}) > 0" for c in (*s.all, *s.any)]) or 'true')
    for s in default_signals(with_market=True).signals)}),
at_ AS MATERIALIZED (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY entity, as_of, factor, axis ORDER BY priority, signal_key) = 1),
sc AS (SELECT 'all' AS scope, * FROM at_ UNION ALL SELECT 'fundamentals', * FROM at_ WHERE axis = '{sq.AXIS}' UNION ALL SELECT 'price_linked', * FROM at_ WHERE axis = '{MARKET}')"""
_STATES = """st AS (SELECT scope, as_of, entity, list_sort(list(factor || '.' || axis || '=' || signal_key)) AS state, list_sort(coalesce(list(factor || '.' || axis || '.' || signal_key) FILTER (signal_key NOT LIKE 'mixed\\_%' ESCAPE '\\'), [])) AS tokens FROM {source} GROUP BY 1, 2, 3),
sg AS MATERIALIZED (SELECT scope, as_of, state, any_value(tokens) AS tokens, count(*) AS size, row_number() OVER (PARTITION BY scope, as_of ORDER BY count(*) DESC, array_to_string(state, '|')) - 1 AS idx FROM st GROUP BY 1, 2, 3)"""


def _agreement_sql(left: tuple[float, ...], right: tuple[float, ...]) -> str:
    return f"{_PAIRS}, " + ", ".join(_families(f"j{i}", str(t)) for i, t in enumerate(left)) + ", " + ", ".join(_families(f"h{i}", str(t), "hamming") for i, t in enumerate(right)) + ", both_l AS (" + " UNION ALL ".join(
        f"SELECT {t} AS jaccard_t, {u} AS hamming_t, x.label AS l, y.label AS m FROM j{i} x JOIN h{k} y USING (idx)" for i, t in enumerate(left) for k, u in enumerate(right)
    ) + """), cell AS (SELECT jaccard_t, hamming_t, l, m, count(*) AS n FROM both_l GROUP BY ALL),
c0 AS (SELECT jaccard_t, hamming_t, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM cell GROUP BY ALL),
c1 AS (SELECT jaccard_t, hamming_t, sum(n * (n - 1) / 2) AS s FROM (SELECT jaccard_t, hamming_t, l, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
c2 AS (SELECT jaccard_t, hamming_t, sum(n * (n - 1) / 2) AS s FROM (SELECT jaccard_t, hamming_t, m, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL)
SELECT CAST(jaccard_t AS DOUBLE) AS jaccard_t, CAST(hamming_t AS DOUBLE) AS hamming_t, round(CASE WHEN (c1.s + c2.s) / 2 - c1.s * c2.s / (t * (t - 1) / 2) <> 0 THEN (c0.s - c1.s * c2.s / (t * (t - 1) / 2)) / ((c1.s + c2.s) / 2 - c1.s * c2.s / (t * (t - 1) / 2)) ELSE 0 END, 6) AS adjusted_rand
FROM c0 JOIN c1 USING (jaccard_t, hamming_t) JOIN c2 USING (jaccard_t, hamming_t)"""


def _splits_sql() -> str:
    parts = []
    for lens, column in (("idf", "idf_jaccard"), ("hamming", "hamming")):
        for kind in ("first", "peak"):
            pick = "largest < was AND second > 0 ORDER BY threshold" if kind == "first" else "true ORDER BY mean_finite_size DESC, threshold"
            parts.append(f"""SELECT '{lens}' AS lens, '{kind}' AS split, before, threshold AS at, row_number() OVER (ORDER BY count(*) DESC, l1.label) AS piece, count(*) AS groups
  FROM (SELECT * FROM (SELECT *, coalesce(lag(threshold) OVER (ORDER BY threshold), threshold) AS before, lag(largest) OVER (ORDER BY threshold) AS was FROM {lens}_s) WHERE {pick} LIMIT 1) p
  JOIN {lens}_s_l l0 ON l0.t = round(p.before * 100) JOIN {lens}_s_l l1 ON l1.node = l0.node AND l1.t = round(p.threshold * 100)
  WHERE l0.label = (SELECT label FROM {lens}_s_k k WHERE k.t = round(p.before * 100) AND k.r = 1) GROUP BY before, threshold, l1.label""")
    return f"{_PAIRS}, {_sweep_sql('idf_jaccard', 'idf_s')}, {_sweep_sql('hamming', 'hamming_s')} " + " UNION ALL ".join(f"({p})" for p in parts)


SQL = {
    "combination_groups": f"{_BASE} SELECT idx, group_key, size, array_to_string(vec, '|') AS state_vector, array_to_string(tokens, '|') AS tokens, sample FROM gr",
    "token_weights": f"{_PAIRS} SELECT token, df, round(weight, 6) AS weight FROM w",
    "pair_similarity": f"{_PAIRS} SELECT a, b, shared, \"union\", round(jaccard, 6) AS jaccard, round(idf_jaccard, 6) AS idf_jaccard, round(hamming, 6) AS hamming, CAST(different AS INT) AS different FROM ham",
    "similarity_histogram": f"""{_PAIRS}, h AS (SELECT CAST(least(20, floor((1 - different / ln_) * 20)) AS INT) AS bucket, count(*) AS n FROM every GROUP BY 1)
SELECT CAST(r.range AS INT) AS bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM every), 6) AS share FROM range(21) r LEFT JOIN h ON h.bucket = r.range""",
    "similar_groups": f"""{_PAIRS}, m AS (SELECT a, b, jaccard FROM ham UNION ALL SELECT b, a, jaccard FROM ham)
SELECT a, CAST(row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, size DESC, b) AS INT) AS rank, b, round(jaccard, 6) AS jaccard FROM m JOIN gr ON gr.idx = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, size DESC, b) <= 5""",
    "families_at_threshold": f"{_PAIRS}, {_families('fam', '0.6')} SELECT idx, label FROM fam",
    "threshold_sweep": f"{_PAIRS}, {_SWEEP} SELECT threshold, families, largest, second, singletons, second_moment, round(mean_finite_size, 6) AS mean_finite_size FROM sweep",
    "spanning_forest": f"""{_PAIRS}, lv AS (SELECT DISTINCT round(idf_jaccard, 12) AS weight FROM ham WHERE idf_jaccard > 0),
le AS (SELECT weight, a, b FROM ham JOIN lv ON round(idf_jaccard, 12) >= weight UNION SELECT weight, b, a FROM ham JOIN lv ON round(idf_jaccard, 12) >= weight),
lr(weight, node, reached) AS (SELECT weight, idx, idx FROM gr, lv UNION SELECT r.weight, r.node, e.b FROM lr r JOIN le e ON e.weight = r.weight AND e.a = r.reached),
lc AS (SELECT weight, count(DISTINCT label) AS k FROM (SELECT weight, node, min(reached) AS label FROM lr GROUP BY 1, 2) GROUP BY 1)
SELECT round(weight, 6) AS weight, CAST(sum(n) AS BIGINT) AS n FROM (SELECT weight, coalesce(lag(k) OVER (ORDER BY weight DESC), (SELECT count(*) FROM gr)) - k AS n FROM lc) WHERE n > 0 GROUP BY 1""",
    "merge_tree": f"""{_PAIRS}, {_SWEEP}, cl AS (SELECT t, node, label, count(*) OVER (PARTITION BY t, label) AS n FROM sweep_l UNION ALL SELECT 101, idx, idx, 1 FROM gr),
up AS (SELECT DISTINCT lo.t AS level, hi.label AS child, hi.n AS child_size, lo.label AS parent, lo.n AS parent_size FROM cl lo JOIN cl hi ON hi.node = lo.node AND hi.t = lo.t + 1 WHERE hi.n <> lo.n)
SELECT CAST(level AS INT) AS level, child, child_size, CAST(coalesce(lag(level) OVER (PARTITION BY child ORDER BY level DESC), 101) AS INT) AS born, parent, parent_size FROM up""",
    "structure_snapshots": f"""{_AT}, {_STATES.format(source='sc')},
tk AS (SELECT scope, as_of, idx, size, unnest(tokens) AS token FROM sg),
wt AS (SELECT scope, as_of, token, round(least(ln(1 + any_value(g) / count(*)), 3.0), 12) AS w FROM tk JOIN (SELECT scope, as_of, count(*) AS g FROM sg GROUP BY 1, 2) USING (scope, as_of) GROUP BY 1, 2, 3),
tw AS (SELECT tk.*, w FROM tk JOIN wt USING (scope, as_of, token)), tot AS (SELECT scope, as_of, idx, sum(w) AS t FROM tw GROUP BY 1, 2, 3),
ed AS MATERIALIZED (SELECT scope, as_of, m.a, m.b FROM (SELECT x.scope, x.as_of, x.idx AS a, y.idx AS b, sum(x.w) AS s FROM tw x JOIN tw y ON x.scope = y.scope AND x.as_of = y.as_of AND x.token = y.token AND x.idx <> y.idx GROUP BY 1, 2, 3, 4) m
  JOIN tot p USING (scope, as_of) JOIN tot q USING (scope, as_of) WHERE p.idx = m.a AND q.idx = m.b AND round(s / (p.t + q.t - s), 9) >= 0.6),
rc(scope, as_of, node, reached) AS (SELECT scope, as_of, idx, idx FROM sg UNION SELECT r.scope, r.as_of, r.node, e.b FROM rc r JOIN ed e ON e.scope = r.scope AND e.as_of = r.as_of AND e.a = r.reached),
lb AS (SELECT scope, as_of, node AS idx, min(reached) AS label FROM rc GROUP BY 1, 2, 3),
mb AS (SELECT sg.*, label FROM sg JOIN lb USING (scope, as_of, idx)),
fm AS (SELECT scope, as_of, label, count(*) AS groups, CAST(sum(size) AS BIGINT) AS entities FROM mb GROUP BY 1, 2, 3),
lg AS (SELECT * FROM fm QUALIFY row_number() OVER (PARTITION BY scope, as_of ORDER BY groups DESC, label) = 1),
tp AS (SELECT scope, as_of, token, sum(size) / any_value(entities) AS share, row_number() OVER (PARTITION BY scope, as_of ORDER BY sum(size) DESC, count(*) DESC, token) AS r
  FROM (SELECT scope, as_of, size, entities, unnest(tokens) AS token FROM mb JOIN lg USING (scope, as_of, label)) GROUP BY 1, 2, 3)
SELECT scope, as_of, CAST(sum(f.entities) AS BIGINT) AS entities, CAST(sum(f.groups) AS BIGINT) AS groups, (SELECT count(DISTINCT token) FROM tk WHERE tk.scope = f.scope AND tk.as_of = f.as_of) AS dimensions, count(*) AS families,
  any_value(l.groups) AS largest_groups, any_value(l.entities) AS largest_entities, coalesce((SELECT string_agg(token || ':' || format('{{:.4f}}', share), ',' ORDER BY r) FROM tp WHERE tp.scope = f.scope AND tp.as_of = f.as_of AND r <= 5), '') AS core
FROM fm f JOIN lg l USING (scope, as_of) GROUP BY f.scope, f.as_of, scope, as_of""",
    "gated_groups": f"""{_AT}, policy AS ({sq.SQL['question_policies']}),
open_ AS (SELECT factor, axis FROM policy WHERE status IN ('use', 'review') AND dominant_share < 0.9),
gt AS (SELECT sc.* FROM sc JOIN open_ USING (factor, axis) WHERE scope = 'fundamentals' AND as_of = DATE '2000-12-31'), {_STATES.format(source='gt')}
SELECT scope, as_of, idx, size, array_to_string(state, '|') AS state, array_to_string(tokens, '|') AS tokens FROM sg""",
    "percolation_splits": _splits_sql(),
    "hamming_audit": f"""{_PAIRS}, {_BROKEN}, inp AS (SELECT x.piece, a, b, hamming FROM ham JOIN broken x ON x.idx = a JOIN broken y ON y.idx = b AND y.piece = x.piece),
ie_ AS (SELECT piece, a, b FROM inp WHERE hamming >= {AUDIT} UNION SELECT piece, b, a FROM inp WHERE hamming >= {AUDIT}),
ir(piece, node, reached) AS (SELECT piece, idx, idx FROM broken UNION SELECT r.piece, r.node, e.b FROM ir r JOIN ie_ e ON e.piece = r.piece AND e.a = r.reached),
iz AS (SELECT piece, label, count(*) AS n FROM (SELECT piece, node, min(reached) AS label FROM ir GROUP BY 1, 2) GROUP BY 1, 2),
ic AS (SELECT piece, count(*) AS subclusters, max(n) AS largest_subcluster, count(*) FILTER (n = 1) AS singletons FROM iz GROUP BY 1)
SELECT piece, groups, entities, round(CASE WHEN groups > 1 THEN coalesce(total, 0) / (groups * (groups - 1) / 2) END, 6) AS mean_hamming, subclusters, largest_subcluster, round(largest_subcluster / groups, 6) AS largest_share, singletons
FROM (SELECT piece, count(*) AS groups, CAST(sum(size) AS BIGINT) AS entities FROM broken JOIN gr USING (idx) GROUP BY 1) JOIN ic USING (piece) LEFT JOIN (SELECT piece, sum(hamming) AS total FROM inp GROUP BY 1) USING (piece)""",
    "piece_contrast": f"""{_PAIRS}, {_BROKEN}, {_SHARES}, major AS (SELECT piece FROM pc WHERE groups >= greatest(10, ceil((SELECT count(*) FROM broken) * 0.02)))
SELECT p.piece, CAST(row_number() OVER (PARTITION BY p.piece ORDER BY entities DESC, groups DESC, token) AS INT) AS rank, token, entities, groups, round(share, 6) AS share, round(baseline_share, 6) AS baseline_share, round(share / baseline_share, 6) AS lift,
  round(share - coalesce((SELECT max(o.share) FROM ps o JOIN major USING (piece) WHERE o.piece <> p.piece AND o.token = p.token), 0), 6) AS contrast
FROM ps p JOIN base USING (token) WHERE p.piece <= 4 QUALIFY row_number() OVER (PARTITION BY p.piece ORDER BY entities DESC, groups DESC, token) <= 5""",
    "broken_bridges": f"""{_PAIRS}, {_BROKEN}, {_SHARES},
lost AS (SELECT a, b, round(idf_jaccard, 12) AS weight FROM ham JOIN broken x ON x.idx = a JOIN broken y ON y.idx = b WHERE round(idf_jaccard, 12) >= {BEFORE} AND round(idf_jaccard, 12) < {AFTER} AND x.piece <> y.piece),
c AS (SELECT x.token, count(*) AS edges, sum(weight) AS weight FROM lost JOIN tok x ON x.idx = a JOIN tok y ON y.idx = b AND y.token = x.token GROUP BY 1)
SELECT token, edges, (SELECT count(*) FROM lost) AS bridges, round(edges / (SELECT count(*) FROM lost), 6) AS share, round(baseline_share, 6) AS baseline_share, round(edges / (SELECT count(*) FROM lost) / baseline_share, 6) AS lift, round(weight / edges, 6) AS mean_weight
FROM c JOIN base USING (token) ORDER BY edges DESC, round(weight, 9) DESC, token LIMIT 8""",
    "threshold_candidates": f"""{_PAIRS}, {_SWEEP},
sized AS (SELECT *, lag(largest) OVER (ORDER BY threshold) - largest AS drop_, greatest(10, ceil((SELECT count(*) FROM gr) * 0.02)) AS size FROM sweep),
em AS (SELECT coalesce(min(threshold) FILTER (second >= size), 0.4) AS emergence FROM sized)
SELECT round(max(emergence), 6) AS secondary_emergence, round(coalesce(min(threshold) FILTER (threshold > emergence AND second < size), 0.7), 6) AS secondary_disappearance,
  round(coalesce(arg_max(threshold, (drop_, -threshold)) FILTER (threshold > emergence AND drop_ > 0), 0.75), 6) AS giant_collapse,
  round(arg_max(threshold, (mean_finite_size, -threshold)), 6) AS peak, round(min(threshold) FILTER (drop_ > 0), 6) AS first_drop FROM sized, em""",
    "family_tokens": f"""{_PAIRS}, {_families('fam', '0.6')}, c AS (SELECT label, token, CAST(sum(size) AS BIGINT) AS entities, count(*) AS groups FROM tok JOIN fam USING (idx) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY entities DESC, groups DESC, token) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY entities DESC, groups DESC, token) <= 5""",
    "bridge_analysis": f"""{_PAIRS}, {_families('hi', '0.7')},
lost AS (SELECT a, b FROM ham JOIN hi x ON x.idx = a JOIN hi y ON y.idx = b WHERE jaccard >= 0.4 AND jaccard < 0.7 AND x.label <> y.label),
c AS (SELECT x.token, count(*) AS n FROM lost JOIN tok x ON x.idx = a JOIN tok y ON y.idx = b AND y.token = x.token GROUP BY 1)
SELECT c.token, n, round(n / (SELECT count(*) FROM lost), 6) AS share, round(n / (SELECT count(*) FROM lost) / (w.df / (SELECT count(*) FROM gr)), 6) AS lift FROM c JOIN w USING (token)""",
    "sparse_graph": f"{_PAIRS}, {_SPARSE} SELECT a, b, round(weight, 6) AS weight FROM sparse",
    "partition_agreement": _agreement_sql((0.4, 0.6, 0.8), (0.6, 0.8)),
    "state_diversity": f"""{_BASE}, c AS (SELECT question, coalesce(signal_key, 'missing') AS state, count(*) AS n FROM answers GROUP BY 1, 2)
SELECT question, count(*) AS states, round(max(n) / sum(n), 6) AS dominant_share FROM c GROUP BY 1 ORDER BY max(n) / sum(n), question LIMIT 5""",
    "family_modularity": f"""{_PAIRS}, {_families('fam', '0.6')}, {_SPARSE},
tot AS (SELECT sum(weight) AS t FROM sparse), deg AS (SELECT label, sum(weight) AS d FROM (SELECT a, weight FROM sparse UNION ALL SELECT b, weight FROM sparse) JOIN fam ON idx = a GROUP BY 1),
ins AS (SELECT x.label, count(*) AS edges, sum(weight) AS weight FROM sparse JOIN fam x ON x.idx = a JOIN fam y ON y.idx = b WHERE x.label = y.label GROUP BY 1),
md AS (SELECT sum(coalesce(i.weight, 0) / t - pow(d / (2 * t), 2)) AS modularity FROM deg LEFT JOIN ins i USING (label), tot),
nn AS (SELECT label, count(*) AS nodes FROM fam GROUP BY 1)
SELECT label, nodes, coalesce(edges, 0) AS edges, round(coalesce(weight, 0), 6) AS weight, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes * (nodes - 1) / 2) ELSE 0 END, 6) AS density, round(modularity, 6) AS modularity FROM nn LEFT JOIN ins USING (label), md""",
}

def _flow_sql() -> str:
    """Label flow, a pair of relations a round; a round after the last change changes nothing."""
    rounds = "".join(f""",
v{i} AS (SELECT e.a AS idx, l.label AS vote, round(sum(e.weight), 12) AS w FROM bs e JOIN l{i - 1} l ON l.idx = e.b GROUP BY 1, 2),
l{i} AS MATERIALIZED (SELECT idx, CASE WHEN w > coalesce(mine, 0) OR (w = coalesce(mine, 0) AND vote < label) THEN vote ELSE label END AS label
  FROM (SELECT l.idx, l.label, max(v.w) AS w, arg_max(v.vote, (v.w, -v.vote)) AS vote, max(v.w) FILTER (v.vote = l.label) AS mine FROM l{i - 1} l LEFT JOIN v{i} v USING (idx) GROUP BY 1, 2))""" for i in range(1, communities.FLOW_ROUNDS + 1))
    return f"{_PAIRS}, {_SPARSE}, {_BOTH_SPARSE}, l0 AS (SELECT idx, idx AS label FROM gr){rounds} SELECT idx, label FROM l{communities.FLOW_ROUNDS}"


def _markov_sql() -> str:
    """Markov clustering, a matrix a round."""
    rounds = "".join(f""",
p{i} AS (SELECT x.i, y.j, pow(sum(x.v * y.v), {communities.INFLATION}) AS v FROM m{i - 1} x JOIN m{i - 1} y ON x.j = y.i GROUP BY 1, 2),
q{i} AS (SELECT * FROM p{i} WHERE v >= {communities.LEAST_VALUE} QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(v, 12) DESC, j) <= {communities.ROW_LIMIT}),
m{i} AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM q{i})""" for i in range(1, communities.MARKOV_ROUNDS + 1))
    return f"""{_PAIRS}, {_SPARSE}, {_BOTH_SPARSE}, s0 AS (SELECT idx AS i, idx AS j, 1.0::DOUBLE AS v FROM gr UNION ALL SELECT a, b, weight FROM bs),
m0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM s0){rounds},
bm AS (SELECT i AS idx, arg_max(j, (round(v, 9), -j)) AS label FROM m{communities.MARKOV_ROUNDS} GROUP BY 1) SELECT gr.idx, coalesce(label, gr.idx) AS label FROM gr LEFT JOIN bm USING (idx)"""


#: One level of Louvain: a step a move, the state is the list of all labels.
_LOUVAIN = f"""{_PAIRS}, {_SPARSE}, {_BOTH_SPARSE},
nb AS MATERIALIZED (SELECT gr.idx, coalesce(list({{'b': bs.b, 'w': bs.weight}}) FILTER (bs.b IS NOT NULL), []) AS around, coalesce(sum(bs.weight), 0) AS degree FROM gr LEFT JOIN bs ON bs.a = gr.idx GROUP BY 1),
dg AS MATERIALIZED (SELECT list(degree ORDER BY idx) AS degrees, sum(degree) AS twice, count(*) AS n FROM nb),
lv(step, labels) AS (SELECT 0::BIGINT, list(idx ORDER BY idx) FROM gr
  UNION ALL SELECT step + 1, list_concat(list_concat(labels[1:idx], [best]), labels[idx + 2:]) FROM (
    SELECT step, labels, idx, list_sort(list_transform(list_distinct(list_append(list_transform(around, lambda x: labels[x.b + 1]), labels[idx + 1])),
      lambda c: {{'r': -round(coalesce(list_sum(list_transform(list_filter(around, lambda x: labels[x.b + 1] = c), lambda x: x.w)), 0)
        - degree * (list_sum(list_transform(range(n), lambda k: CASE WHEN labels[k + 1] = c AND k <> idx THEN degrees[k + 1] ELSE 0 END))) / twice, 12), 'c': c}}))[1].c AS best
    FROM lv, dg, nb WHERE step < {communities.SWEEPS} * n AND nb.idx = step % n)),
fl AS (SELECT unnest(labels) AS label, unnest(range(len(labels))) AS idx FROM (SELECT labels FROM lv ORDER BY step DESC LIMIT 1)),
tot AS (SELECT sum(weight) AS t FROM sparse), deg AS (SELECT label, sum(degree) AS d FROM nb JOIN fl USING (idx) WHERE degree > 0 GROUP BY 1),
ins AS (SELECT x.label, sum(weight) AS weight FROM sparse JOIN fl x ON x.idx = a JOIN fl y ON y.idx = b WHERE x.label = y.label GROUP BY 1),
md AS (SELECT coalesce(sum(coalesce(i.weight, 0) / t - pow(d / (2 * t), 2)), 0) AS modularity, count(*) AS communities FROM deg LEFT JOIN ins i USING (label), tot)
SELECT idx, label, round(modularity, 6) AS modularity, communities FROM fl, md"""

SQL |= {"flow_communities": _flow_sql(), "markov_communities": _markov_sql(), "louvain_communities": _LOUVAIN}
