"""Queries on pages, documents, manifests, profiles and dependency graphs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from strataq.functions.session import scratch_folder, table, written
from strataq.functions.time import DAY, micros
from strataq.operators import graph, pages
from strataq.operators.asof import asof_backward, within_ranges
from strataq.plans.registry import query
from strataq.sources import scans

def _canon_sql(u: str) -> str:
    cut = f"regexp_replace(trim({u}), '#.*$', '')"
    head = f"regexp_extract({cut}, '^[A-Za-z]+://[^/?]*')"
    low = f"lower({head}) || substr({cut}, length({head}) + 1)"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({low}, '^(https?://)(www\.|m\.)', '\1'), '([?&])((utm_[a-z]+|fbclid|ref|page)=[^&]*&?)+', '\1', 'g'), '[?&]+$', ''), '/+$', '')"


_CANON = _canon_sql("url")


@query("page_declared_url", "WITH p AS (SELECT page_id, CASE WHEN own <> '' THEN own ELSE url END AS u FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'HTTPS://WWW.Example.org/' || page_id || '/?ref=x' ELSE '' END AS own, url FROM pages)) SELECT page_id, " + _canon_sql("u") + " AS canon FROM p")
def declared_urls(spark, sf_dir):
    """D1, url: the address that a page declares of itself; every fourth page gets such a line."""
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<LINK rel="canonical" href="HTTPS://WWW.Example.org/'), "page_id", F.lit('/?ref=x">'))).otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(link, F.regexp_replace("html", "(?i)canonical", "")).alias("html"))
    return p.select("page_id", pages.declared_url(F.col("url"), F.col("html")).alias("canon"))


_TEXT = r"regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
for _e, _c in pages.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query("page_text", rf"SELECT page_id, trim(regexp_replace({_TEXT}, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir):
    """The text of a page's html."""
    return table(spark, sf_dir, "pages").select("page_id", pages.html_text(F.col("html")).alias("text"))


@query(
    "page_stories",
    rf"""WITH RECURSIVE t AS (SELECT page_id, trim(regexp_replace({_TEXT}, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages), w AS (SELECT page_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM t),
    h AS (SELECT DISTINCT page_id, array_to_string(w[k : k + 4], ' ') AS passage FROM (SELECT page_id, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
    e AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM h a JOIN h b USING (passage)),
    r(root, node) AS (SELECT page_id, page_id FROM pages UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
    SELECT node AS page_id, min(root) AS story FROM r GROUP BY node""",
)
def page_stories(spark, sf_dir):
    """Stories, as components of pages that share five words running."""
    p = table(spark, sf_dir, "pages").select("page_id", pages.html_text(F.col("html")).alias("text"))
    return pages.stories(p, 5)


@query("retry_queue", "SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 < 3")
def retry_queue(spark, sf_dir):
    """Pages that are tried again; every seventh is fetched, and ids modulo five stand for attempts."""
    return table(spark, sf_dir, "pages").where(pages.due_again(F.col("page_id") % 5, F.col("page_id") % 7 == 0)).select("page_id")


@query("url_canonicalize", f"SELECT page_id, {_CANON} AS canon FROM pages")
def canonical_urls(spark, sf_dir):
    """Canonical addresses."""
    return table(spark, sf_dir, "pages").select("page_id", pages.canonical_url(F.col("url")).alias("canon"))


@query("seen_set_diff", f"WITH p AS (SELECT page_id, {_CANON} AS canon FROM pages) SELECT canon, min(page_id) AS first_page, count(*) AS n FROM p WHERE canon NOT IN (SELECT canon FROM p WHERE page_id % 3 = 0) GROUP BY canon")
def seen_diff(spark, sf_dir):
    """Addresses of a run that an earlier run (every third page) had not seen."""
    p = table(spark, sf_dir, "pages").select("page_id", pages.canonical_url(F.col("url")).alias("canon"))
    new = p.join(p.where("page_id % 3 = 0").select("canon").distinct(), "canon", "left_anti")
    return new.groupBy("canon").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("url_shape_rules", r"SELECT page_id FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+') OR regexp_matches(url, '/(tag|category|author)/') OR regexp_matches(url, '#')")
def url_rules(spark, sf_dir):
    """Addresses whose shape tells that they are no articles."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").where(u.rlike(r"[?&]page=[0-9]+") | u.rlike("/(tag|category|author)/") | u.contains("#")).select("page_id")


@query("content_hash_dedup", r"WITH h AS (SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM documents WHERE text IS NOT NULL) SELECT min(doc_id) AS doc_id, h, count(*) AS copies FROM h GROUP BY h")
def content_dedup(spark, sf_dir):
    """One document of each content."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", pages.content_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_STAGED = """s AS (SELECT d.doc_id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'rejected' WHEN length(text) < 200 THEN 'short' WHEN row_number() OVER (PARTITION BY text ORDER BY d.doc_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS stage
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _staged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("\0")), 256).alias("h"), F.length("text").alias("n"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    d = d.join(first, "h").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", pages.stage(F.col("n") < 200, F.coalesce("toxic", F.lit(0)) == 1, F.col("doc_id") != F.col("first")).alias("stage"))


@query("stage_funnel", f"WITH {_STAGED}, a AS (SELECT unnest(['rejected', 'short', 'duplicate', 'accepted', 'pending']) AS stage) SELECT a.stage, count(s.doc_id) AS n FROM a LEFT JOIN s ON a.stage = s.stage GROUP BY a.stage")
def funnel(spark, sf_dir):
    """Documents by stage, empty stages shown."""
    stages = spark.createDataFrame([(s,) for s in (*pages.STAGES, "pending")], "stage string")
    n = _staged(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("n"))
    return stages.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("audit_sample", f"WITH {_STAGED} SELECT doc_id FROM s WHERE stage = 'rejected' ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 10")
def audit_sample(spark, sf_dir):
    """A repeatable sample of rejects, which is the feature."""
    return _staged(spark, sf_dir).where("stage = 'rejected'").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(10).select("doc_id")


@query("blob_collection", f"WITH {_STAGED}, b AS (SELECT DISTINCT md5(text) AS blob FROM documents), live AS (SELECT DISTINCT md5(text) AS blob FROM documents JOIN s USING (doc_id) WHERE stage IN ('accepted', 'duplicate') OR doc_id % 60 < 30) SELECT blob FROM b WHERE blob IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live WHERE live.blob = b.blob)")
def blob_collection(spark, sf_dir):
    """Stored contents that no document refers to which is live or younger than thirty days; ids modulo sixty stand for days."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("blob")).where("blob is not null")
    live = d.join(_staged(spark, sf_dir).where(F.col("stage").isin("accepted", "duplicate") | (F.col("doc_id") % 60 < 30)), "doc_id", "left_semi")
    return d.select("blob").distinct().join(live.select("blob").distinct(), "blob", "left_anti")


@query("link_set_diff", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) SELECT link, count(*) AS n FROM l WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM l o WHERE o.page_id % 2 = 0 AND o.link = l.link) GROUP BY link""")
def link_diff(spark, sf_dir):
    """Links of one run's pages that the other's have not."""
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    new = l.where("page_id % 2 = 1").join(l.where("page_id % 2 = 0").select("link").distinct(), "link", "left_anti")
    return new.groupBy("link").agg(F.count("*").alias("n"))


@query("embedding_floor", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q))), 9) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1) ORDER BY score DESC, vec_id LIMIT 20")
def embedding_floor(spark, sf_dir):
    """Similarity to one intent vector, the best twenty: a top-k report."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id = 1").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("v", "q") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q")))
    q = q.limit(1)  # one intent vector
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


# ---------------------------------------------------------------- graphs

#: Which metric is computed from which, (source, metric), and what is computed from the price.
EDGES = (
    ("S_STACKS", "age_distribution_5min_delta"), ("age_distribution_5min_delta", "stack_circulation_delta_T"), ("stack_circulation_delta_T", "stack_circulation_T"),
    ("stack_circulation_T", "nvt"), ("stack_circulation_T", "stock_to_flow_ratio"), ("stack_circulation_delta_T", "stock_to_flow_ratio"),
    ("stack_circulation_T", "token_velocity"), ("transaction_volume", "token_velocity"), ("stack_circulation_T", "nvt_transaction_volume"),
    ("transaction_volume", "nvt_transaction_volume"), ("age_distribution_5min_delta", "stack_realized_cap_usd_delta"),
    ("stack_realized_cap_usd_delta", "stack_realized_cap_usd_T"), ("stack_circulation_T", "mean_realized_price_usd_T"),
    ("stack_realized_cap_usd_T", "mean_realized_price_usd_T"), ("stack_realized_cap_usd_T", "realized_cap_hodl_waves_T"),
    ("mean_realized_price_usd_T", "mvrv_usd"), ("stack_realized_cap_usd_T", "mvrv_z"), ("daily_marketcap_usd", "mvrv_z"),
    ("S_STACKS", "stack_age_consumed"), ("stack_age_consumed", "stack_liveliness"), ("age_distribution_5min_delta", "stack_mean_age_dollar_days"),
    ("age_distribution_5min_delta", "dormant_circulation"), ("dormant_circulation", "dormant_circulation_usd"),
    ("age_distribution_5min_delta", "spent_coins_age_band_T"), ("age_distribution_5min_delta", "network_profit_loss"),
    ("age_distribution_5min_delta", "total_supply_in_profit"), ("total_supply_in_profit", "percent_of_total_supply_in_profit"),
    ("stack_circulation_T", "percent_of_total_supply_in_profit"), ("S_BAL", "custom_total_supply_delta"), ("custom_total_supply_delta", "total_supply"),
    ("stack_circulation_T", "total_supply"), ("total_supply", "daily_marketcap_usd"), ("total_supply", "fully_diluted_valuation_usd"),
    ("daily_marketcap_usd", "bitcoin_dominance"), ("total_supply", "annual_inflation_rate"), ("stack_circulation_T", "non_exchange_token_supply"),
    ("exchange_token_supply", "non_exchange_token_supply"), ("stack_circulation_T", "percent_of_total_supply_on_exchanges"),
    ("exchange_token_supply", "percent_of_total_supply_on_exchanges"), ("S_BAL", "exchange_token_supply"), ("S_BAL", "holders_distribution_T"),
    ("S_BAL", "active_holders_distribution_T"), ("S_TX", "transaction_volume"), ("S_TX", "transaction_count"), ("S_TX", "payment_count"),
    ("S_TX", "daily_active_addresses"), ("S_TX", "network_growth"), ("S_TX", "whale_transaction_count_usd"), ("S_TX", "whale_transaction_volume_usd"),
    ("daily_active_addresses", "daa_divergence"),
    ("PRICE", "stack_realized_cap_usd_delta"), ("PRICE", "mvrv_usd"), ("PRICE", "mvrv_z"), ("PRICE", "dormant_circulation_usd"), ("PRICE", "network_profit_loss"),
    ("PRICE", "total_supply_in_profit"), ("PRICE", "daily_marketcap_usd"), ("PRICE", "fully_diluted_valuation_usd"), ("PRICE", "daa_divergence"),
)
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)


def _edges(spark):
    return spark.createDataFrame(list(EDGES), "source string, target string")


#: What rests on what in the tables: nations on regions, suppliers on nations, parts on suppliers, and some parts on a nation or a region straight away.
_TABLE_EDGES = """e(source, target) AS (
  SELECT 'region ' || n_regionkey, 'nation ' || n_nationkey FROM nation UNION SELECT 'nation ' || s_nationkey, 'supplier ' || s_suppkey FROM supplier
  UNION SELECT 'supplier ' || l_suppkey, 'part ' || l_partkey FROM lineitem UNION SELECT 'nation ' || (p_partkey % 25), 'part ' || p_partkey FROM part WHERE p_size < 10
  UNION SELECT 'region ' || (p_partkey % 5), 'supplier ' || (p_partkey % 7 + 1) FROM part WHERE p_size = 1
)"""


def _table_edges(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key) if isinstance(key, str) else key)
    key = F.col("p_partkey")
    edges = [
        t("nation").select(node("region", "n_regionkey"), node("nation", "n_nationkey")), t("supplier").select(node("nation", "s_nationkey"), node("supplier", "s_suppkey")),
        t("lineitem").select(node("supplier", "l_suppkey"), node("part", "l_partkey")), t("part").where("p_size < 10").select(node("nation", key % 25), node("part", key)),
        t("part").where("p_size = 1").select(node("region", key % 5), node("supplier", key % 7 + 1)),
    ]
    return reduce(lambda a, b: a.union(b), edges).toDF("source", "target").distinct()


_CLOSURE = f"WITH RECURSIVE {_TABLE_EDGES}, r(root, node, depth) AS (SELECT DISTINCT source, source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT r.root, e.target, depth + 1 FROM r JOIN e ON r.node = e.source)"


@query("metric_closure", f"{_CLOSURE} SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY root, node")
def closure(spark, sf_dir):
    """What depends on each leaf, and how far."""
    e = written(_table_edges(spark, sf_dir))
    leaves = e.select(F.col("source").alias("node")).distinct().join(e.select(F.col("target").alias("node")), "node", "left_anti")
    return graph.reachable(e, leaves.select(F.col("node").alias("root"), "node"))


@query("metric_colours", f"{_CLOSURE} SELECT node, string_agg(DISTINCT root, ',' ORDER BY root) AS colours FROM r WHERE depth > 0 GROUP BY node")
def colours(spark, sf_dir):
    """The union of the leaves that a metric rests on."""
    r = closure(spark, sf_dir).where("depth > 0")
    return r.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("root")), ",").alias("colours"))


def _parts(c: str) -> str:
    return f"list_filter(string_split(string_split({c}, '/')[1], '_'), lambda p: NOT regexp_full_match(p, '[0-9]+(min|h|d|day|week|y)'))"


def _canon(c: str) -> str:
    p = _parts(c)
    return f"""CASE WHEN len({p}) > 2 AND {p}[-2] = '1e' AND regexp_full_match({p}[-1], '[0-9]+') THEN array_to_string({p}[:-3], '_') || '_B'
    WHEN len({p}) > 1 AND regexp_full_match({p}[-1], '1|all|inf|1e[0-9]+') THEN array_to_string({p}[:-2], '_') || '_B' ELSE array_to_string({p}, '_') END"""


_NAMES = """e AS (SELECT 'stack_' || event_type || '_' || (event_id % 30 + 1) || CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'min' ELSE 'd/v2' END AS source,
  'holders_' || event_type || CASE user_id % 5 WHEN 0 THEN '_1e_' || (event_id % 9) WHEN 1 THEN '_1e' || (event_id % 9) || '_1d' WHEN 2 THEN '_all' WHEN 3 THEN '_7d' ELSE '_' || (event_id % 12) || 'h_inf/2024-01' END AS target FROM events)"""


@query("metric_parents", f"WITH {_NAMES}, c AS (SELECT DISTINCT {_canon('source')} AS s, {_canon('target')} AS t FROM e) SELECT t AS metric, string_agg(DISTINCT s, ',' ORDER BY s) AS parents, count(DISTINCT s) AS n FROM c WHERE s <> t GROUP BY t")
def parents(spark, sf_dir):
    """Parents of each metric under canonical names, and how many; kinds of events and their ids make names with versions, windows and sizes."""
    e, kind, i = table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    unit = F.when(i % 3 == 0, "d").when(i % 3 == 1, "min").otherwise("d/v2")
    u = F.col("user_id") % 5
    size = (
        F.when(u == 0, F.concat(F.lit("_1e_"), i % 9)).when(u == 1, F.concat(F.lit("_1e"), i % 9, F.lit("_1d"))).when(u == 2, "_all").when(u == 3, "_7d")
        .otherwise(F.concat(F.lit("_"), i % 12, F.lit("h_inf/2024-01")))
    )
    e = e.select(F.concat(F.lit("stack_"), kind, F.lit("_"), i % 30 + 1, unit).alias("source"), F.concat(F.lit("holders_"), kind, size).alias("target")).distinct()
    e = e.select(graph.canonical(F.col("source")).alias("s"), graph.canonical(F.col("target")).alias("metric")).where("s <> metric")
    return e.groupBy("metric").agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("parents"), F.countDistinct("s").alias("n"))


@query("topo_levels", f"{_CLOSURE} SELECT node, max(depth)::INT AS level FROM r GROUP BY node")
def topo(spark, sf_dir):
    """The level at which a job may run: one beyond its last dependency."""
    return graph.levels(_table_edges(spark, sf_dir))


@query(
    "stale_closure",
    f"""WITH RECURSIVE e(source, target) AS (VALUES {_VALUES}), m AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT source AS node FROM e UNION SELECT target FROM e)),
    r(root, node) AS (SELECT node, node FROM m UNION SELECT r.root, e.target FROM r JOIN e ON r.node = e.source),
    l AS (SELECT node, count(*) AS n, max(epoch_us(ts)) AS last FROM events JOIN m ON event_id % 200 = k GROUP BY node)
    SELECT root, count(*) AS metrics, sum(l.n)::BIGINT AS points, max(l.last)::BIGINT AS last FROM r JOIN l ON l.node = r.node GROUP BY root""",
)
def stale_closure(spark, sf_dir):
    """The given edges over points that are dealt to metrics: how many points rest on each node, and the latest."""
    from pyspark.sql import Window as W

    e = _edges(spark)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    named = nodes.withColumn("k", F.row_number().over(W.orderBy("node")))
    ev = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("k"), micros("ts").alias("t")).groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    points = ev.join(named, "k")
    r = graph.reachable(e, nodes.select(F.col("node").alias("root"), "node"))
    return r.join(points, "node").groupBy("root").agg(F.count("*").alias("metrics"), F.sum("n").alias("points"), F.max("last").alias("last"))


@query(
    "stale_composites",
    f"""WITH e(source, target) AS (VALUES {_VALUES}), m AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT source AS node FROM e UNION SELECT target FROM e)),
    pts AS (SELECT node, epoch_us(ts) AS dt, epoch_us(ts) + event_id * 7919 % 86400000000 AS computed_at FROM events JOIN m ON event_id % 200 = k),
    l AS (SELECT node, max(computed_at) AS computed_at FROM pts GROUP BY node)
    SELECT source, target, t.computed_at AS computed_at, s.computed_at AS input_computed_at FROM e JOIN l s ON s.node = source JOIN l t ON t.node = target WHERE t.computed_at < s.computed_at""",
)
def stale(spark, sf_dir):
    """Metrics whose latest points were computed before those of an input; points are events, dealt to the metrics by their ids."""
    from pyspark.sql import Window as W

    nodes = _edges(spark).select(F.col("source").alias("node")).union(_edges(spark).select("target")).distinct()
    named = nodes.withColumn("k", F.row_number().over(W.orderBy("node")))
    ev = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("k"), (micros("ts") + F.col("event_id") * 7919 % DAY).alias("computed_at"))
    return graph_stale(_edges(spark), ev.join(named, "k").select("node", "computed_at"))


def graph_stale(edges, points):
    """Edges whose metric was last computed before its input; ``points``: (node, computed_at)."""
    last = points.groupBy("node").agg(F.max("computed_at").alias("at"))
    j = edges.join(last.select(F.col("node").alias("source"), F.col("at").alias("input_computed_at")), "source").join(last.select(F.col("node").alias("target"), F.col("at").alias("computed_at")), "target")
    return j.where("computed_at < input_computed_at").select("source", "target", "computed_at", "input_computed_at")


@query("job_selector", "WITH j AS (SELECT n_name AS job, r_name AS region, n_nationkey % 2 AS half FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT job FROM j WHERE region = 'ASIA' AND half = 0 AND job NOT LIKE '%INDO%'")
def selector(spark, sf_dir):
    """All labels must match, names with excluded parts drop out."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("job"), F.create_map(F.lit("region"), F.col("r_name"), F.lit("half"), (F.col("n_nationkey") % 2).cast("string")).alias("labels"))
    want = F.create_map(F.lit("region"), F.lit("ASIA"), F.lit("half"), F.lit("0"))
    match = F.forall(F.map_entries(want), lambda e: F.element_at("labels", e["key"]).eqNullSafe(e["value"]))
    return j.where(match & ~F.col("job").rlike("INDO")).select("job")


# ---------------------------------------------------------------- manifests and profiles

_PARTS = """k AS (SELECT n_name AS repo, n_nationkey % 3 AS kind, (CASE WHEN p_partkey % 2 = 1 THEN '@s/' ELSE '' END) || 'pkg' || (p_partkey % 150) AS package,
  p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version, p_partkey FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"""


@query(
    "nested_lockfiles",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer), o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem)
    SELECT 'repo' || nation AS path, 'c' || k AS package, '1.0.' || k AS version, 0 AS depth FROM c
    UNION SELECT 'repo' || nation, '@o/p' || o.k, '2.0.' || o.k, 1 FROM o JOIN c ON o.c = c.k
    UNION SELECT 'repo' || nation, 'l' || n || 'x' || p, '3.' || n || '.' || p, 2 FROM l JOIN o ON l.o = o.k JOIN c ON o.c = c.k""",
)
def nested_lockfiles(spark, sf_dir):
    """Packages of older lock files, whose dependencies nest, at any depth and with an entry's fields in any order: orders within customers, lines within orders."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    nested = lambda entries: F.concat(F.lit("{"), F.array_join(F.collect_list(entries), ", "), F.lit("}"))

    def entry(name, version, inner, last):
        own, deps = F.concat(F.lit('"version": '), version), F.concat(F.lit('"dependencies": '), inner)
        fields = F.when(last, F.concat(F.lit('"resolved": "x", '), deps, F.lit(', "requires": {"version": "^9"}, '), own)).otherwise(F.concat(own, F.lit(', "dev": true, '), deps))
        return F.concat(name, F.lit(": {"), fields, F.lit("}"))

    part, line = F.col("l_partkey"), F.col("l_linenumber")
    lines = l.select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").distinct().groupBy("l_orderkey").agg(nested(F.concat(quoted(F.lit("l"), line, F.lit("x"), part), F.lit(': {"integrity": "y", "version": '), quoted(F.lit("3."), line, F.lit("."), part), F.lit("}"))).alias("inner"))
    none = F.coalesce("inner", F.lit("{}"))
    key = F.col("o_orderkey")
    orders = o.join(lines, key == F.col("l_orderkey"), "left").select("o_custkey", entry(quoted(F.lit("@o/p"), key), quoted(F.lit("2.0."), key), none, key % 2 == 0).alias("e"))
    orders = orders.repartition("o_custkey").groupBy("o_custkey").agg(nested("e").alias("inner"))
    key = F.col("c_custkey")
    files = c.join(orders, key == F.col("o_custkey"), "left").select(F.concat(F.lit("repo"), "c_nationkey").alias("path"), entry(quoted(F.lit("c"), key), quoted(F.lit("1.0."), key), none, key % 3 == 0).alias("e"))
    files = files.select("path", F.concat(F.lit('{"lockfileVersion": 1, "dependencies": {'), "e", F.lit("}}")).alias("value"))
    return scans.nested_packages(files).distinct()


def _parts_of(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "nation"), key % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("repo"), (F.col("n_nationkey") % 3).alias("kind"), F.concat(F.when(key % 2 == 1, "@s/").otherwise(""), F.lit("pkg"), key % 150).alias("package"),
        F.concat_ws(".", "p_size", key % 10, key % 7).alias("version"), key.alias("k"),
    )


@query(
    "lock_flag_scan",
    f"""WITH {_PARTS}, bad AS (SELECT DISTINCT package, version AS bad FROM k WHERE p_partkey % 11 = 0)
    SELECT repo, package, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, CASE WHEN max(CASE WHEN version = bad THEN 1 ELSE 0 END) = 1 THEN '!!COMPROMISED!!' ELSE 'OK' END AS flag
    FROM k JOIN bad USING (package) GROUP BY repo, package""",
)
def lock_flags(spark, sf_dir):
    """Locked versions against a list of bad ones, several of a package."""
    p = _parts_of(spark, sf_dir)
    return scans.flagged(p.select("repo", "package", "version"), p.where("k % 11 = 0").select("package", "version").distinct())


@query(
    "lock_files_to_flags",
    f"""WITH {_PARTS}, bad AS (SELECT package, max(version) AS bad FROM k WHERE p_partkey % 3 = 0 GROUP BY package)
    SELECT repo, package, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, CASE WHEN max(CASE WHEN version = bad THEN 1 ELSE 0 END) = 1 THEN '!!COMPROMISED!!' ELSE 'OK' END AS flag
    FROM k JOIN bad USING (package) GROUP BY repo, package""",
)
def lock_files(spark, sf_dir):
    """The texts of lock files of three kinds, read, and their versions held against a list of bad ones."""
    p = _parts_of(spark, sf_dir)
    entry = (
        F.when(F.col("kind") == 0, F.concat(F.lit('"node_modules/x'), "k", F.lit("/node_modules/"), "package", F.lit('": {"version": "'), "version", F.lit('"}')))
        .when(F.col("kind") == 1, F.concat(F.lit('"'), "package", F.lit("@^"), "k", F.lit('":\n  version "'), "version", F.lit('"\n')))
        .otherwise(F.concat(F.lit("  '"), "package", F.lit("@"), "version", F.lit("':\n    resolution: x\n")))
    )
    texts = p.groupBy("repo", "kind").agg(F.collect_list(entry).alias("lines")).withColumn("body", F.when(F.col("kind") == 0, F.array_join("lines", ", ")).otherwise(F.array_join("lines", "\n")))
    name = F.when(F.col("kind") == 0, "package-lock.json").when(F.col("kind") == 1, "yarn.lock").otherwise("pnpm-lock.yaml")
    value = F.when(F.col("kind") == 0, F.concat(F.lit('{"packages": {'), "body", F.lit("}}"))).when(F.col("kind") == 1, F.col("body")).otherwise(F.concat(F.lit("packages:\n"), "body"))
    files = texts.select(F.concat("repo", F.lit("__"), name).alias("path"), value.alias("value"))
    bad = p.where("k % 3 = 0").groupBy("package").agg(F.max("version").alias("version"))
    return scans.flagged(scans.locked(files), bad)


#: Repositories out of customers: what files one has and what its manifest says follows from its key.
_REPO_FACTS = """r AS (SELECT c_custkey AS k, 'repo' || c_custkey AS repo FROM customer WHERE c_custkey % 10 <> 0)"""


@query(
    "repo_posture",
    f"""WITH {_REPO_FACTS} SELECT repo, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'package-lock.json' END, CASE WHEN k % 5 = 0 THEN 'pnpm-lock.yaml' END, CASE WHEN k % 2 = 0 THEN 'yarn.lock' END) AS lockfiles,
    CASE WHEN k % 4 = 0 THEN 'pnpm@' || (k % 9) ELSE '' END AS manager, concat_ws('|', CASE WHEN k % 6 = 0 THEN 'build' END, CASE WHEN k % 7 = 1 THEN 'vite' END, CASE WHEN k % 7 = 2 THEN 'next' END, CASE WHEN k % 3 = 1 THEN 'ts' END) AS tools,
    (k % 4)::BIGINT AS workflows, concat_ws(',', CASE WHEN k % 8 = 1 THEN 'own' END, CASE WHEN k % 8 IN (2, 3) THEN 'web' END) AS git_deps FROM r""",
)
def repo_posture(spark, sf_dir):
    """V2: lock files, package manager, build tools, workflows and git dependencies of repositories' files."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("repo"), k).alias("repo"))
    entry = lambda when, name, value: F.when(when, F.concat(F.lit(f'"{name}": "'), value, F.lit('"')))
    many = lambda name, *entries: F.concat(F.lit(f'"{name}": {{'), F.array_join(F.array_compact(F.array(*entries)), ", "), F.lit("}"))
    manifest = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(
        entry(k % 4 == 0, "packageManager", F.concat(F.lit("pnpm@"), k % 9)), many("scripts", entry(k % 6 == 0, "build", F.lit("make"))),
        many("dependencies", entry(k % 7 == 1, "vite", F.lit("^5")), entry(k % 8 == 1, "own", F.lit("git+ssh://git@e.org/o/r.git")), entry(k % 8 == 2, "web", F.lit("https://e.org/y.tgz"))),
        many("devDependencies", entry(k % 7 == 2, "next", F.lit("14")), entry(k % 3 == 1, "typescript", F.lit("5")), entry(k % 8 == 3, "web", F.lit("some-owner/some-repo#v1"))),
    )), ", "), F.lit("}"))
    file = lambda when, path, value: r.where(when).select("repo", path.alias("path"), value.alias("value"))
    flows = r.select("repo", F.explode(F.sequence(F.lit(0).cast("long"), k % 4)).alias("n")).where("n > 0").select("repo", F.concat(F.lit(".github/workflows/"), "n", F.lit(".yml")).alias("path"), F.lit("").alias("value"))
    files = [
        file(k % 10 != 0, F.lit("package.json"), manifest), file(k % 10 == 0, F.lit("README"), F.lit("no manifest")), file(k % 3 == 0, F.lit("package-lock.json"), F.lit("{}")),
        file(k % 2 == 0, F.lit("yarn.lock"), F.lit("")), file(k % 5 == 0, F.lit("pnpm-lock.yaml"), F.lit("")), file(k % 2 == 1, F.lit("sub/yarn.lock"), F.lit("")), flows,
    ]
    return scans.posture(reduce(lambda a, b: a.unionByName(b), files))


_HALVES = """p AS (SELECT event_type || '>' || (user_id % 40) AS stack, count(*) FILTER (WHERE event_id % 2 = 1) AS n1, sum(round(value * 100000)::BIGINT) FILTER (WHERE event_id % 2 = 1) AS b1,
  count(*) FILTER (WHERE event_id % 2 = 0) AS n0, sum(round(value * 100000)::BIGINT) FILTER (WHERE event_id % 2 = 0) AS b0 FROM events GROUP BY 1)"""
_SCALED = "CASE WHEN n{k} > 0 AND b{k} > 0 THEN b{k}::DOUBLE / (1 - exp(-(b{k}::DOUBLE / n{k}) / 2097152.0::DOUBLE)) ELSE 0 END"


@query("profile_diff", f"WITH {_HALVES}, s AS (SELECT stack, {_SCALED.format(k=1)} - {_SCALED.format(k=0)} AS delta FROM p) SELECT stack, round(delta, 3) AS delta FROM s WHERE delta <> 0")
def profile_diff(spark, sf_dir):
    """Live bytes by stack, scaled for sampling, new less base; events are samples, every second one of the new profile."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(">", "event_type", F.col("user_id") % 40).alias("stack"), F.col("event_id") % 2, F.round(F.col("value") * 100_000).cast("long").alias("bytes")).toDF("stack", "new", "bytes")
    half = lambda k: e.where(F.col("new") == k).groupBy("stack").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("bytes > 0")
    return scans.profile_difference(half(0), half(1)).select("stack", F.round("delta", 3).alias("delta"))


@query("range_lookup", "WITH m AS (SELECT s_suppkey * 1000 AS lo, s_suppkey * 1000 + 600 AS hi, s_suppkey FROM supplier), a AS (SELECT p_partkey, p_partkey * 37 % 100000 AS addr FROM part) SELECT p_partkey, s_suppkey FROM a LEFT JOIN m ON addr >= lo AND addr < hi")
def range_lookup(spark, sf_dir):
    """The disjoint range that holds an address: the nearest start below it, then a check of its end."""
    m = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 1000).alias("addr"), F.struct((F.col("s_suppkey") * 1000 + 600).alias("hi"), "s_suppkey").alias("range"))
    a = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 100000).alias("addr"))
    found = asof_backward(a, m, "addr", "range", slice_size=10_000)
    return found.select("p_partkey", F.when(F.col("addr") < F.col("range.hi"), F.col("range.s_suppkey")).alias("s_suppkey"))


_SPANS = """v AS (SELECT event_id AS range_id, user_id, epoch_us(ts) AS lo, epoch_us(ts) + round(value * 36000000000)::BIGINT AS hi FROM events WHERE event_type = 'view'),
  c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')"""


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"), F.round(F.col("value") * 36_000_000_000).cast("long").alias("long"))
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("range_id"), "user_id", F.col("at").alias("lo"), (F.col("at") + F.col("long")).alias("hi"))
    return views, e.where("event_type = 'click'").select("event_id", "user_id", "at")


@query("overlapping_ranges", f"WITH {_SPANS} SELECT event_id, range_id FROM c JOIN v ON c.user_id = v.user_id AND t >= lo AND t < hi")
def overlapping_ranges(spark, sf_dir):
    """Every range that holds a point, where ranges overlap and nest."""
    views, clicks = _spans(spark, sf_dir)
    return within_ranges(clicks, views, "at", "lo", "hi", ["user_id"], finest=3_600_000_000).select("event_id", "range_id")


@query("nearest_below", f"WITH {_SPANS} SELECT event_id, CASE WHEN t - lo <= 43200000000 THEN range_id END AS range_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND t >= lo")
def nearest_below(spark, sf_dir):
    """The nearest start at or below a point, unless it is more than twelve hours off."""
    views, clicks = _spans(spark, sf_dir)
    return asof_backward(clicks, views.select("user_id", F.col("lo").alias("at"), "range_id"), "at", "range_id", ["user_id"], greatest_gap=43_200_000_000).select("event_id", "range_id")


@query(
    "heap_profiles",
    """SELECT 'p' || (user_id % 20) AS profile, event_type || '>' || (user_id % 7) AS stack, count(*) AS n, sum(round(value * 1000)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1, 2 HAVING sum(round(value * 1000)::BIGINT) > 0""",
)
def heap_profiles(spark, sf_dir):
    """Heap profiles as texts, read back to stacks and what they hold; events are samples, a kind and a user's place the stack."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id") % 20).alias("profile"), F.concat(F.col("event_type"), F.lit(">"), F.col("user_id") % 7).alias("stack"), F.round(F.col("value") * 1000).cast("long").alias("size"))
    kept = e.groupBy("profile", "stack").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    frames = F.array_join(F.transform(F.split("stack", ">"), lambda f: F.concat(F.lit("0x"), F.lower(F.hex(F.encode(f, "UTF-8"))))), " ")
    entry = F.concat(F.lit("@ "), frames, F.lit("\n  t*: "), "n", F.lit(": "), "bytes", F.lit(" [0: 0]\n  t0: 1: 1 [0: 0]"))
    texts = kept.groupBy("profile").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("body"))  # a profile has few stacks
    files = texts.select(F.col("profile").alias("path"), F.concat(F.lit("heap_v2/2097152\n  t*: 9: 9 [0: 0]\n"), "body", F.lit("\nMAPPED_LIBRARIES:\n00400000-0040b000 r-xp 00000000 08:01 17 /bin/a\n")).alias("value"))
    back = F.array_join(F.transform("stack", lambda f: F.decode(F.unhex(F.substring(f, 3, 1000)), "UTF-8")), ">")
    return scans.heap_stacks(files).select(F.col("path").alias("profile"), back.alias("stack"), "n", "bytes")


@query("tsv_round_trip", "SELECT n_nationkey AS key, n_name AS name, c.n AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def tsv_round_trip(spark, sf_dir):
    """A table written with tabs between its columns and read again under the name that stands in for it."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), "customers")
    with scratch_folder(spark, f"tsv-{uuid.uuid4().hex}") as at:
        scans.write_tsv(rows, f"{at}/nations_experimental")
        return written(scans.read_tsv(spark, f"{at}/{scans.resolve({'nations': 'nations_experimental'}, 'nations')}", "key long, name string, customers long"))
