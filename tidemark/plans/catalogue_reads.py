"""Further queries, with their SQL: composed reads, backfills, parsers, scalar readings, state tables.

They join the registry of ``catalogue``, over the same tables in the same parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates, salary, states
from tidemark.functions import text as X
from tidemark.operators import coverage, feed, lifecycle, merge, reads, resolve
from tidemark.plans import search as S
from tidemark.plans.catalogue import _POSTINGS, _open, _part_cards, _postings, _stated, _tree, query
from tidemark.session import table
from tidemark.sources import pages as P
from tidemark.sources import readers
from tidemark.staging import new_folder
from tidemark.streaming import state as streaming

TS = "timestamp"


# ---- composed reads

_MARKET = """WITH p AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS vacancy, p_name AS title, p_brand AS employer, p_type AS classification, 'src' || (p_partkey % 3) AS source,
 CASE p_partkey % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'unknown' WHEN 2 THEN 'not_present' END AS company_state, CASE p_size % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'not_applicable' ELSE 'not_present' END AS class_state,
 p_retailprice AS low, p_retailprice + p_size AS high, CASE WHEN p_partkey % 5 = 0 THEN 'day' ELSE 'year' END AS period, DATE '2024-01-01' + p_size AS last_seen, p_size % 7 <> 0 AS active FROM part),
"""


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    least = part.groupBy(F.col("p_name").alias("_n"), F.col("p_brand").alias("_b")).agg(F.min("p_partkey").alias("vacancy"))
    found = part.join(least, (F.col("p_name") == F.col("_n")) & (F.col("p_brand") == F.col("_b")))
    field_states = F.map_filter(
        F.create_map(F.lit("company"), F.when(key % 4 == 0, "known").when(key % 4 == 1, "unknown").when(key % 4 == 2, "not_present"), F.lit("classification"), F.when(F.col("p_size") % 3 == 0, "known").when(F.col("p_size") % 3 == 1, "not_applicable").otherwise("not_present")),
        lambda k, v: v.isNotNull(),
    )
    return found.select(
        key.alias("id"), "vacancy", F.col("p_name").alias("title"), F.col("p_brand").alias("employer"), F.col("p_type").alias("classification"), F.concat(F.lit("src"), (key % 3).cast("string")).alias("source"),
        field_states.alias("states"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + F.col("p_size")).alias("high"), F.when(key % 5 == 0, "day").otherwise("year").alias("period"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("last_seen"), (F.col("p_size") % 7 != 0).alias("active"),
    )


@query(_MARKET + """m AS (SELECT *, coalesce(company_state, 'unknown') AS cs, period = 'year' AS comparable FROM p),
h AS (SELECT *, (((cs = 'known' AND lower(employer) LIKE '%brand#1%') OR cs IN ('unknown', 'not_applicable')) AND (lower(title) LIKE '%bolt%' OR lower(employer) LIKE '%bolt%' OR lower(classification) LIKE '%bolt%')
  OR ((class_state = 'known' AND lower(classification) LIKE '%promo%') OR class_state IN ('unknown', 'not_applicable')) AND (lower(title) LIKE '%small%' OR lower(employer) LIKE '%small%' OR lower(classification) LIKE '%small%'))
  AND ((cs = 'known' AND (lower(employer) LIKE '%brand#1%' OR lower(employer) LIKE '%brand#2%' OR lower(employer) LIKE '%brand#3%')) OR cs IN ('unknown', 'not_applicable'))
  AND source IN ('src0', 'src2') AND (NOT comparable OR (high >= 920 AND low <= 1200)) AS hit FROM m),
v AS (SELECT vacancy, count(*) AS members, max(last_seen) AS last_seen, string_agg(id || ':' || source || ':' || CASE WHEN comparable THEN 'comparable_overlap' ELSE 'uncertain_preserved' END, ',' ORDER BY id) FILTER (WHERE hit) AS matched FROM h GROUP BY vacancy HAVING bool_or(hit) AND bool_or(active))
SELECT vacancy, members, last_seen, matched, (SELECT count(*) FROM v) AS total FROM v WHERE vacancy > 20 ORDER BY vacancy LIMIT 50""")
def search_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"company": ["employer"], "employer": ["employer"], "title": ["title"], "classification": ["classification"]}
    states.check_interval(920.0, 1200.0, "year", "AUD")
    found = S.search(["company:brand#1 AND bolt", "classification:promo and small"], fields, ["title", "employer", "classification"], F.col("states"), {"employer": "company"})
    company = states.contains_any(F.col("employer"), F.coalesce(F.col("states")["company"], F.lit("unknown")), S.check_values(["brand#1", "Brand#2", "brand#3"]))
    can = states.comparable(F.lit("known"), F.lit("known"), F.col("period"), F.lit("AUD"), F.lit("range"), "year", "AUD")
    overlap = states.interval_filter(can, F.col("low"), F.col("high"), 920.0, 1200.0)
    page = reads.search_page(_market(spark, sf_dir), found & company & F.col("source").isin("src0", "src2") & overlap, can, F.col("active"), 50, 20)
    listed = F.array_join(F.transform("matched", lambda m: F.concat_ws(":", m["id"].cast("string"), m["source"], m["basis"])), ",")
    return page.select("vacancy", "members", "last_seen", listed.alias("matched"), "total")


@query(_POSTINGS + """, q AS (SELECT doc_id AS id, CASE WHEN vacancy <> doc_id THEN vacancy END AS primary_id, vacancy, source, upper(lang) AS geography_code, n_chars AS last_seen, lang <> 'de' AS active FROM p),
f AS (SELECT q.*, (SELECT count(*) FROM q m WHERE m.vacancy = q.id) AS members, (SELECT max(last_seen) FROM q m WHERE m.vacancy = q.id) AS vacancy_last_seen, (SELECT bool_or(active) FROM q m WHERE m.vacancy = q.id) AS vacancy_active FROM q
 WHERE primary_id IS NULL AND geography_code = 'EN' AND id > 10),
g AS (SELECT * FROM f WHERE vacancy_active ORDER BY id LIMIT 61), h AS (SELECT * FROM g ORDER BY id LIMIT 60)
SELECT id, source, members, vacancy_last_seen, vacancy_active, members - 1 AS links, (SELECT count(*) FROM g) > 60 AS has_more, (SELECT max(id) FROM h) AS next_cursor FROM h""")
def feed_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir).select(F.col("doc_id").alias("id"), "primary_id", "source", F.upper("lang").alias("geography_code"), F.col("n_chars").alias("last_seen"), (F.col("lang") != "de").alias("active"))
    links = rows.where("primary_id IS NOT NULL").select(F.col("primary_id").alias("a"), F.col("id").alias("b"))
    page = reads.feed_page(rows, links, 60, F.col("active"), after=10, geography=" en ")
    return page.select("id", "source", "members", "vacancy_last_seen", "vacancy_active", "links", "has_more", "next_cursor")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, len(CASE WHEN event_id % 3 = 0 THEN [event_type, 'x'] ELSE [] END) AS n_tags, user_id % 2 = 1 AS easy_apply, CASE WHEN event_id % 5 <> 0 THEN value END AS low, value + 1 AS high FROM events""")
def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    tags = F.when(key % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('","x"]'))).when(key % 3 == 1, F.lit("{broken"))
    rows = table(spark, sf_dir, "events").select(key, tags.alias("tags"), (F.col("user_id") % 2).cast("int").alias("easy_apply"), F.when(key % 5 != 0, F.col("value")).alias("low"), (F.col("value") + 1).alias("high"), F.from_json("props", "k long")["k"].alias("k"), "props")
    out = reads.payload(rows, "tags", ["easy_apply"], ["low", "high"], ["props"], include_raw=False)
    return out.select("event_id", "k", F.size("tags").alias("n_tags"), "easy_apply", F.col("salary_normalized.low").alias("low"), F.col("salary_normalized.high").alias("high"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY k) FILTER (WHERE k <= 20) || ']' AS captures FROM c GROUP BY user_id""")
def detail_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return reads.history(events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], ["event_id", "event_type"], 20)


@query("""WITH h AS (SELECT user_id AS job_id, event_id % 25 AS query_id, count(*) AS hit_count FROM events GROUP BY ALL)
SELECT job_id, query_id, hit_count, n_name AS query_text, row_number() OVER (PARTITION BY job_id ORDER BY hit_count DESC, n_name) AS place FROM h JOIN nation ON query_id = n_nationkey""")
def detail_query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id"), (F.col("event_id") % 25).alias("query_id")).agg(F.count("*").alias("hit_count"))
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("query_text"))
    return reads.query_hits_of(hits, F.broadcast(queries)).withColumn("place", F.col("place").cast("long"))  # a dimension of 25 rows


_EDGES = """WITH c AS (SELECT p_partkey AS id, lower(p_name) AS t, p_brand AS e, p_type AS c, p_size % 2 AS emp, p_size % 4 AS loc, floor(p_retailprice / 100) AS sal FROM part),
p AS (SELECT a.id AS a, b.id AS b, a.c = b.c AND a.emp = b.emp AND a.loc = b.loc AND a.sal = b.sal AS exact,
 0.72 + CASE WHEN a.loc = b.loc THEN 0.08 ELSE 0 END + CASE WHEN a.emp = b.emp THEN 0.04 ELSE 0 END + CASE WHEN a.sal = b.sal THEN 0.04 ELSE 0 END + CASE WHEN a.c = b.c THEN 0.03 ELSE 0 END AS score FROM c a JOIN c b ON a.t = b.t AND a.e = b.e AND a.id < b.id),
x AS (SELECT a, b, CASE WHEN exact THEN 'exact_rich_card' ELSE 'near_rich_card' END AS match_type FROM p WHERE exact OR round(score, 9) >= 0.92)
"""


@query(_EDGES + "SELECT a AS id, b AS other, match_type FROM x UNION ALL SELECT b, a, match_type FROM x")
def detail_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.neighbours(resolve.edges(_part_cards(spark, sf_dir))).select("id", "other", "match_type")


@query(_POSTINGS + "SELECT doc_id, quality, n_chars FROM p JOIN labels USING (doc_id) WHERE vacancy = doc_id AND n_chars >= 200 ORDER BY n_chars DESC, doc_id DESC LIMIT 40")
def new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir).select("doc_id", "primary_id", "n_chars")
    found = reads.new_records(rows, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "n_chars", F.lit(200), 40)
    return found.select("doc_id", "quality", "n_chars")


_NODES = """WITH n AS (SELECT r_name AS code, r_regionkey AS id, NULL::INT AS parent, CASE WHEN r_regionkey % 2 = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE_CHILD_COVERAGE' END AS status, 100 + r_regionkey AS reported, 10 * r_regionkey AS unique_jobs, r_regionkey % 2 AS updated FROM region WHERE r_regionkey <> 3
 UNION ALL SELECT r_name, 100 + n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_regionkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'INCOMPLETE_PAGE_LIMIT' ELSE 'COMPLETE_INCREMENTAL' END, n_nationkey, n_nationkey + 1, n_nationkey % 4 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3),
"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    region = table(spark, sf_dir, "region").where("r_regionkey <> 3")
    roots = region.select(F.col("r_name").alias("code"), r.alias("id"), F.lit(None).cast("int").alias("parent"), F.when(r % 2 == 0, "COMPLETE").otherwise("INCOMPLETE_CHILD_COVERAGE").alias("status"), (r + 100).alias("reported"), (r * 10).alias("unique_jobs"), (r % 2).alias("updated"))
    kids = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == r)
    kids = kids.select(F.col("r_name").alias("code"), (n + 100).alias("id"), F.when(n % 6 != 5, F.col("n_regionkey")).alias("parent"), F.when(n % 3 == 0, "INCOMPLETE_PAGE_LIMIT").otherwise("COMPLETE_INCREMENTAL").alias("status"), n.alias("reported"), (n + 1).alias("unique_jobs"), (n % 4).alias("updated"))
    return roots.unionByName(kids)


@query(_NODES + """h AS (SELECT n_name, r_name AS code, n_nationkey AS id, n_nationkey % 5 AS captured_at, n_nationkey * 2 AS covered FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3),
l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY updated DESC, id DESC) AS k FROM n WHERE parent IS NULL), o AS (SELECT code, count(*) AS open FROM n WHERE status NOT LIKE 'COMPLETE%' GROUP BY code),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY captured_at DESC, id DESC) AS k FROM h)
SELECT r_name AS code, l.code IS NOT NULL AS has_cycle, coalesce(l.status, 'NOT_RUN') AS status, l.reported, coalesce(l.unique_jobs, 0) AS unique_jobs, coalesce(o.open, 0) AS incomplete, b.n_name AS previous_status, b.covered AS previous_covered
FROM region LEFT JOIN l ON l.code = r_name AND l.k = 1 LEFT JOIN o ON o.code = r_name LEFT JOIN b ON b.code = r_name AND b.k = 1""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    past = table(spark, sf_dir, "nation").where("n_regionkey < 3").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    past = past.select(F.col("r_name").alias("code"), n.alias("id"), (n % 5).alias("captured_at"), F.col("n_name").alias("root_status"), (n * 2).alias("covered"))
    return coverage.report(table(spark, sf_dir, "region").select(F.col("r_name").alias("code")), _nodes(spark, sf_dir), past, "code", "updated")


@query(_NODES + "l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id DESC) AS k FROM n WHERE parent IS NULL) SELECT code, status AS root_status, reported, unique_jobs AS covered, (SELECT count(*) FROM n m WHERE m.code = l.code AND m.status NOT LIKE 'COMPLETE%') AS incomplete FROM l WHERE k = 1")
def cycle_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.reset(_nodes(spark, sf_dir), "code")[0]


@query(_NODES + "z AS (SELECT 1) SELECT code, id, parent, 'PENDING' AS status, NULL::INT AS reported, 0 AS unique_jobs, updated FROM n WHERE parent IS NULL")
def cycle_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.reset(_nodes(spark, sf_dir), "code")[1]


@query("SELECT source, count(*) AS jobs, count(*) FILTER (WHERE quality = 1) AS with_text, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS without_text, count(*) FILTER (WHERE quality = 0) AS unavailable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.population(_stated(spark, sf_dir), F.col("state") == "not_present", F.col("state") == "known")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 5 = 0) AS complete, count(*) FILTER (WHERE c_custkey % 5 = 1) AS capped, greatest(0, count(*) - count(*) FILTER (WHERE c_custkey % 5 < 2)) AS remaining FROM customer")
def campaign_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"))
    m = F.col("place") % 5
    cursors = places.withColumn("status", F.when(m == 0, "COMPLETE").when(m == 1, "INCOMPLETE_CAP").otherwise("RUNNING")).withColumn("cycle", F.when(m == 3, "old").otherwise("now"))
    return reads.campaign_progress(cursors, places, "now")


_CAPABLE = {"src1": {"title": "supported", "salary": "supported"}, "src2": {"title": "supported"}}


@query("SELECT source, f.field, CASE WHEN source = 'src1' AND f.field IN ('title', 'salary') OR source = 'src2' AND f.field = 'title' THEN 'supported' ELSE 'unknown' END AS capability FROM (SELECT DISTINCT source FROM documents), (VALUES ('title'), ('salary'), ('location')) f(field)")
def field_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source").distinct().withColumn("field", F.explode(F.array(*map(F.lit, ("title", "salary", "location")))))
    return rows.withColumn("capability", states.capability(F.concat(F.lit(" "), F.upper("source")), F.col("field"), _CAPABLE))


@query(_MARKET + "z AS (SELECT 1) SELECT id, vacancy, source, row_number() OVER (PARTITION BY vacancy ORDER BY CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 99 END, id DESC) AS place FROM p WHERE active")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.source_candidates(_market(spark, sf_dir), F.col("active"), {"src2": 0, "src0": 1})
    return found.select("id", "vacancy", "source", F.col("place").cast("long").alias("place"))


@query(_MARKET + "z AS (SELECT 1) SELECT vacancy, count(*) AS terminal_members FROM p WHERE NOT active AND vacancy IN (SELECT vacancy FROM p WHERE source = 'src1' AND last_seen >= DATE '2024-01-20') GROUP BY vacancy")
def terminal_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.terminal_families(_market(spark, sf_dir), " SRC1", F.lit("2024-01-20").cast("date"), ~F.col("active"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bulk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return reads.only_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids.unionByName(ids), "o_custkey")


@query("SELECT DISTINCT o_orderkey AS job, l_suppkey AS partition FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS pr FROM orders) JOIN lineitem ON l_orderkey = o_orderkey OR l_orderkey = pr")
def covered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(key, F.when(key % 3 == 1, key - 1).alias("primary_id"))
    held = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("partition"), F.col("l_orderkey").alias("job"))
    return coverage.covered_jobs(jobs, held, "o_orderkey", "primary_id")


@query("WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey - 1 END AS pr FROM customer), t AS (SELECT id, id AS root, pr FROM l UNION ALL SELECT t.id, l.id, l.pr FROM t JOIN l ON l.id = t.pr) SELECT id, min(root) AS root FROM t GROUP BY id")
def primary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return resolve.resolved_primaries(table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 10 != 0, key - 1).alias("primary_id")))


@query(_EDGES + """, z AS (SELECT 1) SELECT a.c_custkey AS id, a.c_custkey - a.c_custkey % 2 AS old_primary, a.c_custkey - a.c_custkey % 3 AS new_primary,
CASE WHEN a.c_custkey % 3 = 0 THEN 'unlinked' WHEN a.c_custkey % 2 = 0 THEN 'linked' ELSE 'moved' END AS action FROM customer a WHERE a.c_custkey % 2 <> a.c_custkey % 3""")
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    return resolve.link_audit(rows.select(key.alias("id"), (key - key % 2).alias("primary_id")), rows.select(key.alias("id"), (key - key % 3).alias("primary_id")))


# ---- backfills, counters, state tables

_CAPTURED = """WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2026-02-30' ELSE '2020-01-01' END AS posted_at, c_custkey % 4 = 0 AS gone FROM customer),
e AS (SELECT o_custkey, o_orderdate AS value, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 2 END AS rank FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 7 <> 0),
b AS (SELECT o_custkey, arg_min(value, -rank * 100000000 + epoch(value) / 1000) AS value FROM e GROUP BY 1)
"""


@query(_CAPTURED + """, s AS (SELECT r.*, gone OR posted_at = '2026-02-30' AS stale FROM r)
SELECT c_custkey, posted_at AS before, CASE WHEN NOT (posted_at IS NULL OR stale) THEN posted_at WHEN value IS NOT NULL THEN strftime(value, '%Y-%m-%d') END AS after,
CASE WHEN NOT (posted_at IS NULL OR stale) THEN 'keep' WHEN value IS NOT NULL THEN 'update' WHEN stale THEN 'clear' ELSE 'none' END AS action FROM s LEFT JOIN b ON o_custkey = c_custkey""")
def date_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(key, F.when(key % 3 == 1, "2026-02-30").when(key % 3 == 2, "2020-01-01").alias("posted_at"), (key % 4 == 0).alias("gone"))
    stale = F.col("gone") | (F.col("posted_at").isNotNull() & dates.strict_timestamp(F.col("posted_at")).isNull())
    seen = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT' AND o_custkey % 7 <> 0").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.when(F.col("o_orderstatus") == "F", "source_exact").otherwise("source_relative").alias("basis"))
    best = reads.best_date(seen, "c_custkey", F.col("d"), dates.basis_rank(F.col("basis")))
    return reads.backfill(records, best, "c_custkey", "posted_at", stale)


@query("""WITH w AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e, event_type AS label FROM events WHERE event_type IN ('purchase', 'signup')),
f AS (SELECT p.event_id, any_value(p.user_id) AS user_id, any_value(p.ts) AS ts FROM events p JOIN w ON p.user_id = w.user_id AND p.ts BETWEEN w.s AND w.e WHERE p.event_type = 'click' GROUP BY p.event_id HAVING count(DISTINCT w.label) = 1)
SELECT user_id, min(ts) AS first_proved, count(*) AS proved FROM f GROUP BY user_id""")
def window_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    windows = events.where(F.col("event_type").isin("purchase", "signup")).select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e"), F.col("event_type").alias("label"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    proved = lifecycle.unique_window(clicks, windows, "user_id", "ts", "s", "e", "label", "event_id", 6 * 3600)
    return clicks.join(proved.select("event_id"), "event_id").groupBy("user_id").agg(F.min("ts").alias("first_proved"), F.count("*").alias("proved"))


@query("SELECT l_suppkey, count(*) AS cards, count(*) FILTER (WHERE l_linenumber = 1 AND l_orderkey % 3 <> 1) AS new_jobs, count(*) FILTER (WHERE NOT (l_linenumber = 1 AND l_orderkey % 3 <> 1)) AS duplicates FROM lineitem GROUP BY 1")
def query_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", key, F.when(key % 3 == 1, key - 1).otherwise(key).alias("primary_id"), (F.col("l_linenumber") == 1).alias("created"))
    return merge.query_counters(rows, "l_suppkey", "l_orderkey", "primary_id", "created")


@query("""WITH s AS (SELECT user_id, min(ts) AS first_seen, arg_max(ts, event_id) AS last_seen, count(*) AS n, user_id % 2 = 0 AS archived FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id),
o AS (SELECT user_id, min(ts) AS first_seen, arg_max(ts, event_id) AS last_seen, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(s.user_id, o.user_id) AS user_id, least(s.first_seen, o.first_seen) AS first_seen, coalesce(o.last_seen, s.last_seen) AS last_seen, coalesce(s.n, 0) + coalesce(o.n, 0) AS capture_count, o.user_id IS NULL AND coalesce(s.archived, false) AS archived FROM s FULL JOIN o ON s.user_id = o.user_id""")
def state_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    state = merge.observation_state(events.where(F.col("ts") < cut), "user_id", "ts", F.col("event_id")).withColumn("archived", F.col("user_id") % 2 == 0)
    return merge.refresh_state(state, events.where((F.col("ts") >= cut) & (F.col("user_id") % 3 == 0)), "user_id", "ts", F.col("event_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'NEW', NULL")
def admin_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    edits = rows.where(key % 3 == 0).select(key, F.lit("EDITED").alias("c_mktsegment"), F.when(key % 6 == 0, 0.0).alias("c_acctbal"))
    new = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return merge.overlay(rows, edits.unionByName(new), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.prune(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "user_id")


@query("SELECT d.doc_id AS job_id, f.name AS field_name, 'unknown' AS state FROM documents d, (VALUES ('quality'), ('toxic')) f(name) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (f.name = 'quality' OR l.toxic = 1))")
def missing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").alias("job_id"), F.lit("quality").alias("field_name")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("job_id"), F.lit("toxic").alias("field_name")))
    return merge.missing_states(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["quality", "toxic"], known)


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1 LIMIT 100")
def bounded_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return lifecycle.bounded_repair(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"), tried, "c_custkey", 100)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || '  ' WHEN p_partkey % 3 = 1 THEN '' ELSE p_name || ' x' END AS p_name FROM part WHERE p_partkey % 3 = 2 OR p_partkey > 100000000")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    now = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = now.withColumn("p_name", F.when(key % 3 == 0, F.concat(F.upper("p_name"), F.lit("  "))).when(key % 3 == 1, F.lit("")).otherwise(F.concat("p_name", F.lit(" x"))))
    return merge.changed(now, new, "p_partkey", ["p_name"])


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS nid, 'u' || (p_partkey % 50) AS url FROM part),
a AS (SELECT c_custkey AS nid, min(c_custkey) AS t FROM customer GROUP BY 1), b AS (SELECT 'u' || c_custkey AS url, min(c_custkey) AS t FROM customer WHERE c_custkey < 20 GROUP BY 1), s AS (SELECT s_suppkey + 1500 AS nid, min(s_suppkey) AS t FROM supplier GROUP BY 1), d AS (SELECT 'u' || (s_suppkey % 40) AS url, min(s_suppkey) AS t FROM supplier GROUP BY 1)
SELECT p_partkey, coalesce(a.t, b.t, s.t, d.t) AS match, CASE WHEN a.t IS NOT NULL OR b.t IS NOT NULL THEN 'job' WHEN s.t IS NOT NULL OR d.t IS NOT NULL THEN 'tombstone' END AS match_kind FROM i LEFT JOIN a ON a.nid = i.nid LEFT JOIN b ON b.url = i.url LEFT JOIN s ON s.nid = i.nid LEFT JOIN d ON d.url = i.url""")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, c, s = F.col("p_partkey"), F.col("c_custkey"), F.col("s_suppkey")
    url = lambda x: F.concat(F.lit("u"), x.cast("string"))
    new = table(spark, sf_dir, "part").select(key, F.when(key % 4 != 0, key).alias("nid"), url(key % 50).alias("url"))
    jobs = table(spark, sf_dir, "customer").select(c.alias("nid"), F.when(c < 20, url(c)).alias("url"), c.alias("target"))
    stones = table(spark, sf_dir, "supplier").select((s + 1500).alias("nid"), url(s % 40).alias("url"), s.alias("target"))
    return merge.identity_lookup(new, jobs, stones, "nid", "url", "target").select("p_partkey", "match", "match_kind")


@query(_POSTINGS + ", t AS (SELECT DISTINCT vacancy FROM p JOIN labels USING (doc_id) WHERE quality = 1) SELECT doc_id FROM p WHERE vacancy NOT IN (SELECT vacancy FROM t) AND doc_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def enqueue_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality")
    rows = _postings(spark, sf_dir).join(labels, F.col("doc_id") == F.col("_d"), "left")
    queued = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("job_id"))
    return lifecycle.enqueue(rows, "doc_id", "vacancy", F.col("quality") == 1, queued).select("doc_id")


@query("SELECT c_custkey AS job_id, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN c_custkey % 4 = 0 THEN 'timeout' WHEN c_custkey % 6 = 0 THEN 'old' END AS last_error FROM customer")
def defer_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    queue = table(spark, sf_dir, "customer").select(key.alias("job_id"), F.lit(1).alias("attempts"), F.when(key % 6 == 0, "old").alias("last_error"))
    return lifecycle.defer(queue, queue.where("job_id % 4 = 0").select("job_id", F.lit("timeout").alias("error")))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 410 WHEN trim(d.body) <> '' THEN 200 ELSE 409 END AS code FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END AS body FROM documents WHERE doc_id % 2 = 0) d FULL JOIN labels l ON d.doc_id = l.doc_id")
def text_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ").alias("body"))
    return feed.text_outcome(docs, table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "body").select("doc_id", "code")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS terminal, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.summary(table(spark, sf_dir, "orders"), {"terminal": ~_open(), "large": F.col("o_totalprice") > 100000, "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("SELECT page_id, url AS canonical_url FROM (SELECT page_id, 'https://h.org/' || (page_id % 40) AS url FROM pages) WHERE url = 'https://h.org/7'")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h.org/"), (F.col("page_id") % 40).cast("string")).alias("canonical_url"))
    return feed.exact_lookup(rows, url="HTTPS://H.ORG/7/?utm_source=x#top")


@query("""SELECT 'c' || (o_custkey % 50) AS consumer_key, max(o_orderkey) AS last_id, (SELECT max(o_orderkey) FROM orders) AS through_id, (SELECT count(*) FROM orders x WHERE x.o_orderstatus <> 'F' AND x.o_orderkey > max(o.o_orderkey)) AS pending FROM orders o WHERE o_custkey % 50 < 5 AND o_orderkey < 3000 GROUP BY 1""")
def consumer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    points = orders.where("o_custkey % 50 < 5 AND o_orderkey < 3000").groupBy(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("consumer_key")).agg(F.max("o_orderkey").alias("last_id"))
    return streaming.consumer_state(orders, points, "o_orderkey", _open())


@query("SELECT user_id, event_id FROM events WHERE event_id > 500")
def read_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1000).parquet(sf_dir)
    return streaming.drain(stream.where("event_id > 500").select("user_id", "event_id"), "append")


# ---- scalar readings

_WHERE = """WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Sydney NSW' WHEN 1 THEN 'Canberra ACT' WHEN 2 THEN 'Queensland' WHEN 3 THEN 'Parramatta, New South Wales' WHEN 4 THEN 'Braddon ACT' ELSE NULL END AS a,
 CASE c_custkey % 4 WHEN 0 THEN 'Sydney' WHEN 1 THEN 'Canberra' WHEN 2 THEN 'Parramatta' ELSE 'Australia' END AS b FROM customer),
f AS (SELECT *, CASE c_custkey % 6 WHEN 0 THEN 'sydney' WHEN 1 THEN 'canberra' WHEN 3 THEN 'parramatta' WHEN 4 THEN 'braddon' ELSE '' END AS la, CASE c_custkey % 4 WHEN 0 THEN 'sydney' WHEN 1 THEN 'canberra' WHEN 2 THEN 'parramatta' ELSE '' END AS lb,
 c_custkey % 6 IN (1, 4) AS ra, c_custkey % 4 = 1 AS rb FROM t)
"""


@query(_WHERE + "SELECT c_custkey, la <> '' AND lb <> '' AND la <> lb AND NOT (ra AND rb) AS conflict FROM f")
def location_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    a = F.when(key % 6 == 0, "Sydney NSW").when(key % 6 == 1, "Canberra ACT").when(key % 6 == 2, "Queensland").when(key % 6 == 3, "Parramatta, New South Wales").when(key % 6 == 4, "Braddon ACT")
    b = F.when(key % 4 == 0, "Sydney").when(key % 4 == 1, "Canberra").when(key % 4 == 2, "Parramatta").otherwise("Australia")
    rows = table(spark, sf_dir, "customer").select(key, a.alias("a"), b.alias("b"))
    return rows.select("c_custkey", X.locations_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'AUD' END AS currency FROM part")
def proved_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    url = F.when(key % 3 == 0, "https://WWW.Site.com.au/job/1").when(key % 3 == 1, "https://site.com.au.evil.org/1").otherwise("https://other.org/site.com.au")
    return table(spark, sf_dir, "part").select("p_partkey", salary.context_currency(F.when(key % 2 == 0, " Board ").otherwise("else"), url, ("board",), ("site.com.au",)).alias("currency"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rank FROM events")
def basis_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    basis = F.when(m == 0, "source_exact").when(m == 1, "source_relative").when(m == 2, "search_window_bound").otherwise("not_present")
    return table(spark, sf_dir, "events").select("event_id", dates.basis_rank(basis).alias("rank"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1000 + o_orderkey WHEN 1 THEN NULL ELSE o_orderkey END AS results, CASE WHEN o_orderkey % 2 = 0 THEN 1000 + o_orderkey END AS applicants,
CASE o_orderkey % 4 WHEN 0 THEN 'external_apply' WHEN 1 THEN 'easy_apply' ELSE 'unknown' END AS apply_method, CASE WHEN o_orderkey % 2 = 0 THEN (1000000 + o_orderkey)::VARCHAR END AS native_id, 'my-key-' || o_orderkey AS consumer_key FROM orders""")
def page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    k = key.cast("string")
    page = F.when(key % 3 == 0, F.concat(F.lit("Jobs\n"), F.format_number(key + 1000, 0), F.lit(" Results\n9 jobs"))).when(key % 3 == 1, F.concat(F.repeat(F.lit("x\n"), 20), F.lit("5 jobs"))).otherwise(F.concat(k, F.lit(" job")))
    header = F.when(key % 2 == 0, F.concat(F.format_number(key + 1000, 0), F.lit(" applicants"))).otherwise(F.concat(F.lit("Over "), k, F.lit(" applicants")))
    link = F.when(key % 4 == 0, "https://x.org/apply").when(key % 4 == 1, F.lit(None).cast("string")).otherwise("https://h.org/1")
    alias = F.when(key % 2 == 0, F.concat(F.when(key % 4 == 0, "li-").otherwise(""), (key + 1000000).cast("string"))).otherwise("x1")
    return table(spark, sf_dir, "orders").select(
        key, X.result_count(page).alias("results"), X.applicant_count(header).alias("applicants"), X.apply_method(link, F.lit("https://h.org/1")).alias("apply_method"), X.native_id(alias).alias("native_id"), X.consumer_key(F.concat(F.lit(" My  Key "), k)).alias("consumer_key"),
    )


@query("""SELECT page_id, 'https://h.org/jobs?a=1' || CASE WHEN page_id % 3 + 1 > 1 THEN '&page=' || (page_id % 3 + 1) ELSE '' END AS paged, CASE WHEN page_id % 2 = 0 THEN (page_id % 9 + 1) * 24 END AS window_hours, page_id % 4 IN (0, 3) AS same FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    bare = F.lit("https://h.org/jobs?a=1&page=9")
    ranged = F.when(key % 2 == 0, F.concat(F.lit("https://h.org/jobs?daterange="), (key % 9 + 1).cast("string"), F.lit("&b=2"))).otherwise("https://h.org/jobs?b=2")
    actual = F.when(key % 4 == 0, "https://H.org/jobs/?x=1&a=b%20c").when(key % 4 == 1, "https://h.org/jobs?x=1").when(key % 4 == 2, "https://evil.org/jobs?a=b+c").otherwise("")
    return table(spark, sf_dir, "pages").select(key, X.page_url(bare, key % 3 + 1).alias("paged"), X.date_range_hours(ranged).cast("long").alias("window_hours"), X.same_page(actual, F.lit("https://h.org/jobs?a=b+c"), ("h.org",)).alias("same"))


@query("""SELECT p_partkey, '$' || format('{:,}', (p_size * 1000)::BIGINT) || CASE WHEN p_partkey % 2 = 0 THEN ' - $' || format('{:,}', (p_size * 1000 + 500)::BIGINT) || '.50' ELSE '' END AS label FROM part""")
def salary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("p_size") * 1000).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", X.salary_label(low, F.when(F.col("p_partkey") % 2 == 0, low + 500.5)).alias("label"))


@query("SELECT event_id, date_trunc('day', ts) - INTERVAL 1 DAY AS cutoff, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS slot FROM events")
def cutoffs_and_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast(TS)
    return table(spark, sf_dir, "events").select("event_id", dates.previous_midnight(ts, "UTC").cast("timestamp_ntz").alias("cutoff"), dates.slot(ts, 12).cast("timestamp_ntz").alias("slot"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'not_applicable' WHEN doc_id % 4 = 1 THEN 'known' WHEN doc_id % 4 = 2 THEN 'not_present' ELSE 'unknown' END AS state FROM documents")
def derived_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    states.check_names(["source"], ("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", states.derived_state(F.when(m == 0, "not_applicable"), F.when(m == 1, F.col("lang")).otherwise(" "), m == 2).alias("state"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal <= 1000 THEN 'LEAF' WHEN c_custkey % 3 > 0 THEN 'SPLIT' ELSE 'UNSPLITTABLE' END AS decision, CASE WHEN c_custkey % 2 = 0 AND c_acctbal + 5 >= 4000 THEN 'COMPLETE_RECOVERED' WHEN c_custkey % 2 = 0 THEN 'INCOMPLETE_PAGE_LIMIT' ELSE 'COMPLETE' END AS recovered,
CASE WHEN c_acctbal + 5 >= 6000 THEN 'COMPLETE_BY_PARTITION' ELSE 'INCOMPLETE_CHILD_COVERAGE' END AS reconciled FROM customer""")
def coverage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("c_acctbal")
    status = F.when(key % 2 == 0, "INCOMPLETE_PAGE_LIMIT").otherwise("COMPLETE")
    return table(spark, sf_dir, "customer").select(key, coverage.split_decision(n, 1000, key % 3).alias("decision"), coverage.recovered(status, n, F.lit(4000), 5).alias("recovered"), coverage.reconciled(F.lit("INCOMPLETE_CHILD_COVERAGE"), n, F.lit(6000), 5).alias("reconciled"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 2 DAY - INTERVAL 30 MINUTE END AS cutoff FROM events")
def incremental_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast(TS)
    previous = F.when(F.col("event_id") % 2 == 0, ts - F.expr("INTERVAL 2 DAYS")).otherwise(ts - F.expr("INTERVAL 9 DAYS"))
    return table(spark, sf_dir, "events").select("event_id", streaming.incremental_cutoff(previous, ts, 30, 3).cast("timestamp_ntz").alias("cutoff"))


@query("SELECT max(o_orderkey) FILTER (WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0)::VARCHAR AS started_at FROM orders")
def watermark_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = lambda ok: F.when(ok, "COMPLETE_BY_PARTITION").otherwise("INCOMPLETE")
    stats = F.to_json(F.struct(F.create_map(F.lit("a"), F.struct(F.lit("COMPLETE").alias("status")), F.lit("b"), F.struct(status(F.col("o_custkey") % 3 == 0).alias("status"))).alias("coverage")))
    runs = table(spark, sf_dir, "orders").select(key.alias("id"), F.lit("normal").alias("kind"), F.lit("fresh").alias("mode"), F.when(F.col("o_orderstatus") == "O", "COMPLETE").otherwise("PARTIAL").alias("status"), key.cast("string").alias("started_at"), stats.alias("stats"))
    found = streaming.latest_watermark(runs, ["a", "b"])
    return spark.createDataFrame([(found,)], "started_at string")


# ---- parsers and sources


@query("SELECT page_id, pos, page_id * 3 + pos + 1 AS rank, 'id' || page_id || '-' || pos AS id, 'Title ' || pos AS title FROM pages, (VALUES (0), (1), (2)) v(pos)")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = lambda i: F.concat(F.lit('{"id":"id'), F.col("page_id").cast("string"), F.lit(f'-{i}","url":"u{i}","title":"Title {i}"}}'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("["), F.concat_ws(",", card(0), card(1), card(2)), F.lit("]")).alias("cards"))
    return readers.cards_from_json(pages, "cards", "page_id", 3).select("page_id", "pos", "rank", "id", "title")


@query("SELECT doc_id, 2 AS cards, 'A ' || doc_id AS first_title, lang AS first_line FROM documents")
def snapshot_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("A "), F.col("doc_id").cast("string"))
    blocks = F.array(F.concat(title, F.lit("\n\n"), "lang"), F.lit("b c\nmore"))
    rows = table(spark, sf_dir, "documents").select("doc_id", P.cards_from_text(F.array(title, F.lit("B c")), blocks).alias("cards"))
    return rows.select("doc_id", F.size("cards").alias("cards"), F.col("cards")[0]["title"].alias("first_title"), F.col("cards")[0]["lines"][1].alias("first_line"))


@query("SELECT event_id, event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'deep' ELSE 'flat' END AS employer FROM events")
def detail_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    body = F.when(key % 2 == 0, F.concat(F.lit('{"job":{"title":"'), "event_type", F.lit('","advertiser":{"name":"deep"}}}'))).otherwise(F.concat(F.lit('{"title":"'), "event_type", F.lit('","company":" flat "}')))
    rows = table(spark, sf_dir, "events").select("event_id", P.detail_facts(body, {"title": ["$.job.title", "$.title"], "employer": ["$.job.advertiser.name", "$.company"]}).alias("f"))
    return rows.select("event_id", "f.title", "f.employer")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN repeat('Body line of ' || lang || '. ', 9) || chr(10) || 'End ' || source END AS body, 'Full time' AS employment, '$' || doc_id || ' a year' AS salary FROM documents")
def detail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    line = F.concat(F.lit("Body line of "), "lang", F.lit(". "))
    box = F.when(key % 2 == 0, "How you match\n3 skills match your profile\nSQL\n+2 more\n").otherwise("")
    text = F.concat(F.lit("Menu\nFull time\n"), F.concat(F.lit("$"), key.cast("string"), F.lit(" a  year\n")), F.when(key % 3 != 0, "Save\n").otherwise("Keep\n"), box, F.repeat(line, 9), F.lit("\n  \nEnd "), "source", F.lit("\nReport this job\nFooter"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", P.lines_of(text).alias("lines"))
    start, stops = "save", ("report this job", "similar jobs")
    body = P.lines_of(P.body_text(F.col("lines"), start, stops))
    plain = F.array_join(P.without_match_box(body, "how you match", r"^\+[0-9]+ more"), "\n")
    facts = P.header_facts(F.col("lines"), {"employment": "^(?i)(full|part) time$", "salary": r"^\$"})
    out = rows.select("doc_id", F.when(F.size("lines") > 0, plain).alias("body"), P.body_text(F.col("lines"), start, stops).isNull().alias("none"), facts.alias("f"))
    # the SQL keeps the blank at the end of the repeated line
    full = F.when(~F.col("none"), F.replace(F.col("body"), F.lit("\nEnd"), F.lit(" \nEnd")))
    return out.select("doc_id", full.alias("body"), "f.employment", "f.salary")


@query("SELECT page_id, 'classification' AS level, 'Label ' || page_id AS label, '/jobs-in-x' || page_id || '/in-all-act' AS url FROM pages UNION ALL SELECT page_id, 'subclassification', 'Sub', '/jobs-in-x/sub' || page_id || '/in-all-act' FROM pages UNION ALL SELECT page_id, 'work_type', 'FT', '/jobs-in-x/sub/in-all-act/full-time' FROM pages")
def refinement_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    link = lambda href, label: F.concat(F.lit('<a class="r" href="'), href, F.lit('"> '), label, F.lit("</a>"))
    one = F.concat(F.lit("/jobs-in-x"), k, F.lit("/in-all-act"))
    two = F.concat(F.lit("/jobs-in-x/sub"), k, F.lit("/in-all-act"))
    html = F.concat(link(one, F.concat(F.lit("<b>Label</b>  "), k)), link(one, F.lit("again")), link(two, F.lit("Sub")), link(F.lit("/jobs-in-x/sub/in-all-act/full-time"), F.lit("FT")), link(F.lit("/about"), F.lit("About")), link(F.lit("/jobs-in-y/z/in-all-act"), F.lit("other")))
    rows = table(spark, sf_dir, "pages").select("page_id", P.links_of(html).alias("links"))
    levels = [P.refinement_links(F.col("links"), *at) for at in (("state", "all-act", F.lit("https://h.org/jobs/in-all-act")), ("classification", "all-act", F.lit("/jobs-in-x/in-all-act")), ("subclassification", "all-act", F.lit("/jobs-in-x/sub/in-all-act")))]
    found = rows.select("page_id", F.explode(F.concat(*levels)).alias("l"))
    return found.select("page_id", "l.level", "l.label", "l.url")


@query("SELECT (i // 10)::INT AS page, (i % 10 + 1)::INT AS place, (i // 2)::BIGINT AS id FROM range(400) t(i) WHERE i % 2 = 0 AND i // 2 < 190")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(P.ListingSource)
    return spark.read.format("paged_listing").options(pages=40, size=10, total=190, repeat=2).load()


@query("SELECT 'listing' AS source, CASE WHEN length(p_partkey::VARCHAR) >= 1 THEN (p_partkey + 1000000)::VARCHAR END AS source_job_id, p_name AS title, 'NSW' AS geography_code, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS min_amount, (p_size // 10 + 1)::INT AS page_number, (p_size + 1)::INT AS rank FROM part")
def adapted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("li-"), (key + 1000000).cast("string")).alias("id"), F.lit("https://h.org/1").alias("job_url"), F.concat(F.lit("  "), "p_name").alias("title"), F.col("p_brand").alias("company"), F.lit("Sydney, New South Wales").alias("location"),
        F.when(key % 2 == 0, F.col("p_retailprice")).otherwise(F.lit("NaN").cast("double")).alias("min_amount"), F.lit(None).cast("double").alias("max_amount"), F.lit("2026-01-01").cast("date").alias("date_posted"), F.col("p_size").alias("position"),
    )
    return readers.ADAPTERS["listing"](raw).select("source", "source_job_id", "title", "geography_code", "min_amount", "page_number", "rank")


@query("SELECT o_custkey AS id, min(o_orderstatus) AS first FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '1' END || '' AS o_orderstatus FROM orders) GROUP BY 1")
def resilient_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    read = lambda m: orders.where(f"o_orderkey % 2 = {m}").select(F.col("o_custkey").alias("id"), F.lit(str(m)).alias("first")).distinct()
    return readers.first_by_id([read(0), read(1)], "id")


@query("""WITH g AS (SELECT o_custkey AS listing, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS offset_, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 10 END AS n FROM orders),
a AS (SELECT *, sum(n) OVER w AS nxt, count(*) OVER w AS probed FROM g WINDOW w AS (PARTITION BY listing ORDER BY offset_ ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT listing, CASE WHEN max(offset_) >= 1000 THEN 'INCOMPLETE_CAP' WHEN bool_or(n < 10 AND probed >= 3 AND coalesce(nxt, 0) = 0) THEN 'COMPLETE' ELSE 'OPEN' END AS status FROM a GROUP BY listing""")
def listing_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) * 10
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing"), place.alias("offset"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(10).alias("rows"))
    return readers.end_of_stream(pages, 10)


@query("SELECT count(*) AS rows, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def backup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = readers.read_required(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"])
    root = new_folder(spark)
    readers.backup(orders, root, 1, "o_orderkey")
    readers.append(readers.evidence_row(orders.limit(10), ["o_orderkey", "o_orderstatus"]), f"{root}/evidence")
    return readers.manifest(spark.read.parquet(f"{root}/v000001"), "o_orderkey").select("rows", "least", "greatest")


@query("SELECT 'r' || r_regionkey AS id, len(list_distinct(list_value(r_name, lower(r_name), r_name))) AS spellings FROM region")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("r_name")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.size(F.array_distinct(F.array(name, F.lower(name), name))).cast("long").alias("spellings"))


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 4 = 0")
def open_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.incomplete_leaves(_tree(spark, sf_dir)).select("id")
