"""Every query of the engine, with the SQL that an independent database answers it by.

The driver's tables stand in for a market of postings: orders are a feed ('F' is terminal), documents are
postings of 20 sources, labels their field states (quality 1 known, 0 not present, no row unknown), events
are observations of users, parts are cards, and region, nation and customer are a tree of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, salary, states
from tidemark.functions import text as X
from tidemark.operators import coverage, feed, lifecycle, merge, resolve
from tidemark.plans import search as S
from tidemark.session import table
from tidemark.sources import readers
from tidemark.staging import staged
from tidemark.streaming import state as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FOLD_SQL = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\pL\pN_]+', ' ', 'g'))"


def _open() -> Column:
    return feed.active(F.col("o_orderstatus"), ("F",))


# ---- feeds, pages and counts

_PAGE = """WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
  WHERE o_orderkey > {after} AND o_orderkey <= {through} AND coalesce(o_orderstatus, '') NOT IN ('F') ORDER BY o_orderkey LIMIT {limit} + 1),
p AS (SELECT * FROM t ORDER BY o_orderkey LIMIT {limit})
SELECT *, (SELECT count(*) FROM t) > {limit} AS has_more, (SELECT max(o_orderkey) FROM p) AS next_cursor FROM p"""


def _page(spark: SparkSession, sf_dir: str, after: int, through: int, limit: int) -> DataFrame:
    df = table(spark, sf_dir, "orders").where(_open()).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return feed.keyset_page(df, "o_orderkey", limit, after, through)


@query(_PAGE.format(after=0, through=9000, limit=200))
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 0, 9000, 200)


@query(_PAGE.format(after=8900, through=9000, limit=200))
def feed_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 8900, 9000, 200)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the vacancy is the least id of equal folded texts; its own id means no primary."""
    # written once: else every use of the fingerprint reads, folds and hashes all texts again
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", X.fingerprint(X.fold(F.col("text"))).alias("fp")), "postings")
    least = docs.groupBy(F.col("fp").alias("_f")).agg(F.min("doc_id").alias("vacancy"))
    return docs.join(least, F.col("fp") == F.col("_f")).drop("_f").withColumn("primary_id", F.when(F.col("vacancy") != F.col("doc_id"), F.col("vacancy")))


_POSTINGS = f"""WITH d AS (SELECT doc_id, source, lang, n_chars, sha256({FOLD_SQL.format("text")}) AS fp FROM documents),
p AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS vacancy FROM d)
"""


@query(_POSTINGS + "SELECT doc_id, source, fp FROM p WHERE vacancy = doc_id AND doc_id IN (SELECT vacancy FROM p WHERE lang <> 'de')")
def feed_primary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.with_active_member(_postings(spark, sf_dir), "doc_id", "primary_id", F.col("lang") != "de").select("doc_id", "source", "fp")


@query(
    _POSTINGS
    + """, e AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id)
SELECT vacancy, count(*) AS members, max(seen) AS last_seen, bool_or(lang <> 'de') AS active FROM p LEFT JOIN e ON p.doc_id = e.user_id GROUP BY vacancy"""
)
def vacancy_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    both = _postings(spark, sf_dir).join(seen, F.col("doc_id") == F.col("user_id"), "left")
    return feed.lifecycle(both, "vacancy", "seen", F.col("lang") != "de")


@query(_POSTINGS + ", e AS (SELECT vacancy AS a, doc_id AS b FROM p WHERE vacancy <> doc_id) SELECT id, count(*) AS links FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id")
def feed_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _postings(spark, sf_dir).where("vacancy <> doc_id").select(F.col("vacancy").alias("a"), F.col("doc_id").alias("b"))
    return feed.link_counts(links, "a", "b")


@query("SELECT max(o_orderkey) AS through_id, count(*) FILTER (WHERE o_orderkey > 5000 AND o_orderstatus <> 'F') AS pending FROM orders")
def pending_active_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.pending(table(spark, sf_dir, "orders"), "o_orderkey", 5000, _open())


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50")
def new_since_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").where("ts >= '2024-01-20'")
    return feed.top_recent(df, "ts", "event_id", 50)


# ---- URLs, identities and fingerprints

_URL = r"""(SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)"""
_CANON = r"""lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)', 1), '/+$', '') ||
CASE WHEN q = '' THEN '' ELSE '?' || q END"""
_PAGES = rf"""WITH a AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
  lambda kv: kv <> '' AND lower(string_split(kv, '=')[1]) NOT IN ('ref', 'refid', 'trackingid', 'trk') AND NOT starts_with(lower(string_split(kv, '=')[1]), 'utm_')), '&') AS raw FROM {_URL}),
e AS (SELECT *, array_to_string(list_transform(list_filter(string_split(raw, '&'), lambda kv: kv <> ''), lambda kv: replace(url_encode(url_decode(replace(string_split(kv, '=')[1], '+', ' '))), '%20', '+') || '=' ||
  replace(url_encode(url_decode(replace(substr(kv, length(string_split(kv, '=')[1]) + 2), '+', ' '))), '%20', '+')), '&') AS q FROM a),
c AS (SELECT page_id, url, {_CANON} AS canonical_url FROM e)
"""


@query(_PAGES + "SELECT page_id, canonical_url FROM c")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical_url"))


@query(_PAGES + "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'web:id:' || page_id ELSE 'web:url:' || canonical_url END AS identity_key FROM c")
def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", X.identity_key(F.lit(" WEB "), own, F.col("url")).alias("identity_key"))


@query(_PAGES + "SELECT canonical_url, min(page_id) AS first_page, count(*) AS captures FROM c GROUP BY canonical_url")
def identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical_url"))
    return df.groupBy("canonical_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("captures"))


@query(_POSTINGS + "SELECT fp, min(doc_id) AS primary_id, count(*) AS members FROM p GROUP BY fp HAVING count(*) > 1")
def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(X.fold(F.col("text"))).alias("fp"))
    return docs.groupBy("fp").agg(F.min("doc_id").alias("primary_id"), F.count("*").alias("members")).where("members > 1")


_CARD = "sha256(" + FOLD_SQL.format("p_name") + " || chr(31) || " + FOLD_SQL.format("p_brand") + " || chr(31) || " + FOLD_SQL.format("p_type") + " || chr(31) || p_size::VARCHAR)"


@query(f"SELECT p_partkey, {_CARD} AS card FROM part")
def exact_card_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.card_fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("card"))


# ---- three-valued filters and search


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), F.when(F.col("quality") == 1, "known").otherwise("not_present").alias("recorded"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(labels, F.col("doc_id") == F.col("_d"), "left").withColumn("state", F.coalesce("recorded", F.lit("unknown")))


_STATED = "WITH s AS (SELECT d.doc_id, source, lang, n_chars, CASE WHEN quality = 1 THEN 'known' WHEN quality = 0 THEN 'not_present' ELSE 'unknown' END AS state FROM documents d LEFT JOIN labels l USING (doc_id))\n"


@query(_STATED + "SELECT doc_id, source, state FROM s WHERE CASE state WHEN 'not_present' THEN false WHEN 'known' THEN source LIKE '%src1%' OR source LIKE '%rc7%' ELSE true END")
def state_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).where(states.contains_any(F.col("source"), F.col("state"), ["SRC1", "rc7"])).select("doc_id", "source", "state")


@query(_STATED + "SELECT doc_id, lang, state FROM s WHERE CASE state WHEN 'not_present' THEN false WHEN 'known' THEN lang IN ('de', 'fr') ELSE true END")
def state_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).where(states.in_any(F.col("lang"), F.col("state"), ["de", "fr"])).select("doc_id", "lang", "state")


_DATED = "WITH t AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'not_present' ELSE 'known' END AS state, CASE WHEN o_orderkey % 7 = 0 THEN '2026-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted FROM orders)\n"


@query(_DATED + "SELECT o_orderkey, posted FROM t WHERE state = 'known' AND try_cast(posted AS DATE) >= DATE '1998-06-01'")
def date_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(key % 4 == 0, "unknown").when(key % 4 == 1, "not_present").otherwise("known")
    posted = F.when(key % 7 == 0, "2026-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", posted.alias("posted"), state.alias("state"))
    return df.where(states.on_or_after(dates.strict_timestamp(F.col("posted")), F.col("state"), F.lit("1998-06-01").cast("timestamp"))).select("o_orderkey", "posted")


_BANDS = """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_retailprice END AS low, CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE p_retailprice + p_size END AS high,
 CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'known' END AS state, CASE WHEN p_partkey % 3 = 0 THEN 'day' ELSE 'year' END AS period, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'AUD' END AS currency FROM part),
c AS (SELECT *, coalesce(state = 'known' AND period = 'year' AND currency = 'AUD', false) AS comparable FROM t)
"""


@query(_BANDS + "SELECT p_partkey, low, high, CASE WHEN comparable THEN 'comparable_overlap' ELSE 'uncertain_preserved' END AS basis FROM c WHERE NOT comparable OR (coalesce(high >= 950, true) AND coalesce(low <= 1000, true))")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    states.check_interval(950.0, 1000.0, "year", "AUD")
    key = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(
        key,
        F.when(key % 5 != 1, F.col("p_retailprice")).alias("low"),
        F.when(key % 5 != 2, F.col("p_retailprice") + F.col("p_size")).alias("high"),
        F.when(key % 6 == 0, "unknown").otherwise("known").alias("state"),
        F.when(key % 3 == 0, "day").otherwise("year").alias("period"),
        F.when(key % 11 != 0, "AUD").alias("currency"),
    )
    can = states.comparable(F.col("state"), F.lit("known"), F.col("period"), F.col("currency"), F.lit("range"), "year", "AUD")
    kept = df.withColumn("can", can).where(states.interval_filter(F.col("can"), F.col("low"), F.col("high"), 950.0, 1000.0))
    return kept.select("p_partkey", "low", "high", states.match_basis(F.col("can")).alias("basis"))


FIELDS = {"name": ["p_name"], "brand": ["p_brand"], "type": ["p_type"], "text": ["p_name", "p_type"]}
DEFAULT = ["p_name", "p_brand", "p_type"]
_ANY = "(lower(p_name) LIKE '%{0}%' OR lower(p_brand) LIKE '%{0}%' OR lower(p_type) LIKE '%{0}%')"


def _searched(spark: SparkSession, sf_dir: str, *expressions: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *DEFAULT).where(S.search(list(expressions), FIELDS, DEFAULT))


def _search_sql(where: str) -> str:
    return f"SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE {where}"


@query(_search_sql(_ANY.format("red") + " AND " + _ANY.format("economy")))
def search_expr_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "red and ECONOMY")


@query(_search_sql(_ANY.format("small ring") + " OR " + _ANY.format("blue") + " AND " + _ANY.format("promo")))
def search_expr_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '"small ring" OR blue AND promo')


@query(_search_sql("(" + _ANY.format("small ring") + " OR " + _ANY.format("blue") + ") AND " + _ANY.format("promo")))
def search_expr_paren(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "(\"small ring\" OR blue) AND promo")


@query(_search_sql("lower(p_brand) LIKE '%brand#1%' AND (lower(p_name) LIKE '%bolt%' OR lower(p_type) LIKE '%bolt%')"))
def search_expr_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, 'brand:"Brand#1" AND text:bolt')


@query(_search_sql(_ANY.format("red widget") + " OR " + "lower(p_type) LIKE '%large%'"))
def search_expr_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "red widget", "type:large")


@query(_POSTINGS + ", h AS (SELECT DISTINCT vacancy FROM p WHERE source LIKE '%src1%'), n AS (SELECT count(*) AS total FROM h) SELECT vacancy, total FROM h, n WHERE vacancy > 100 ORDER BY vacancy LIMIT 40")
def search_total_and_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.search_results(_postings(spark, sf_dir), F.col("source").contains("src1"), "vacancy", "doc_id", "source").select("vacancy")
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.where("vacancy > 100").orderBy("vacancy").limit(40).join(F.broadcast(total))


@query(_POSTINGS + "SELECT vacancy, count(*) AS matched, string_agg(doc_id || ':' || source, ',' ORDER BY doc_id) AS sources FROM p WHERE source LIKE '%src1%' GROUP BY vacancy")
def matched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.search_results(_postings(spark, sf_dir), F.col("source").contains("src1"), "vacancy", "doc_id", "source")
    listed = F.array_join(F.transform("matched_sources", lambda m: F.concat_ws(":", m["id"].cast("string"), m["source"])), ",")
    return found.select("vacancy", F.size("matched_sources").cast("long").alias("matched"), listed.alias("sources"))


# ---- folding observations


@query("SELECT user_id, min(ts) AS first_seen, arg_max(ts, event_id) AS last_seen, count(*) AS capture_count FROM events GROUP BY user_id")
def observation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.observation_state(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_id"))


@query("SELECT user_id, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS value, arg_max(event_type, event_id) AS event_type, bool_or(event_type = 'error') AS failed FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) GROUP BY user_id")
def upsert_last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "event_type", (F.col("event_type") == "error").alias("failed"))
    return merge.upsert(obs, "user_id", F.col("event_id"), ["value", "event_type"], ["failed"])


_RANK = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, props, r AS basis_rank FROM (SELECT *, {_RANK} AS r, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC, CASE WHEN {_RANK} = 3 THEN length(props) ELSE 0 END DESC, event_id) AS k FROM events) WHERE k = 1")
def rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    rank = F.when(t == "purchase", 3).when(t == "signup", 2).when(t == "click", 1).otherwise(0)
    return merge.rank_merge(table(spark, sf_dir, "events"), "user_id", "props", rank, F.col("event_id"))


@query("""SELECT c.c_custkey, CASE WHEN c_custkey % 2 = 0 THEN coalesce(o.p, '') ELSE c_mktsegment END AS segment FROM customer c
LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(merge.last_known("o_orderpriority", F.col("o_orderkey"), "segment"))
    filled = merge.fill_only(now, orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["segment"])
    return filled.withColumn("segment", F.coalesce("segment", F.lit("")))


@query("SELECT user_id, arg_min(props, event_id) FILTER (WHERE event_type = 'view') AS body FROM events GROUP BY user_id")
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_type") == "view", F.col("props"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(merge.first_known(body, F.col("event_id"), "body"))


@query("SELECT user_id, event_type, count(*) AS hit_count, min(ts) AS first_hit, max(ts) AS last_hit FROM events GROUP BY ALL")
def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("SELECT user_id, event_type AS field, coalesce(arg_max(s, event_id) FILTER (WHERE s <> 'unknown'), 'unknown') AS state FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'unknown' ELSE 'not_present' END AS s FROM events) GROUP BY ALL")
def field_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "event_id", F.when(m == 0, "known").when(m == 1, "unknown").otherwise("not_present").alias("state"))
    return merge.merge_states(rows, ["user_id", "field"], "state", F.col("event_id"))


@query("""WITH old AS (SELECT o_custkey, min(o_orderdate) AS first_seen, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
new AS (SELECT o_custkey, min(o_orderdate) AS first_seen, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT new.o_custkey, least(new.first_seen, coalesce(old.first_seen, new.first_seen)) AS first_seen, new.n + coalesce(old.n, 0) AS n, old.o_custkey IS NULL AS created FROM new LEFT JOIN old USING (o_custkey)""")
def tombstone_resurrection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), F.lit(1).cast("long").alias("one"))
    cut = F.lit("1998-01-01").cast("timestamp")
    old = orders.where(F.col("first_seen") < cut).groupBy("o_custkey").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("n"))
    stones = merge.tombstones(old, "o_custkey", "first_seen", "last_seen", "n")
    new = orders.where(F.col("first_seen") >= cut).groupBy("o_custkey").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("n"))
    return merge.resurrect(new, stones, "o_custkey", "first_seen", "n")


# ---- lifecycle, queues and audits


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 == 1, key - 1).alias("primary_id"), "o_orderdate", (F.col("o_orderstatus") == "F").alias("archived"))
    return lifecycle.retention(rows, "o_orderkey", "primary_id", F.col("o_orderdate"), F.col("archived"), F.lit("1998-01-01").cast("timestamp"), F.lit("1996-06-01").cast("timestamp"))


_RETAIN = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS primary_id, o_orderdate, o_orderstatus = 'F' AS was FROM orders),
a AS (SELECT *, was OR o_orderdate < TIMESTAMP '1998-01-01' AS archived FROM r), d AS (SELECT *, archived AND o_orderdate < TIMESTAMP '1996-06-01' AS due FROM a),
f AS (SELECT d.*, EXISTS (SELECT 1 FROM d x WHERE x.primary_id = d.o_orderkey AND NOT x.archived) AS held FROM d)
"""


@query(_RETAIN + "SELECT o_orderkey FROM f WHERE archived AND NOT was AND NOT (due AND NOT held)")
def retention_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).where("phase = 'archive'").select("o_orderkey")


@query(_RETAIN + "SELECT o_orderkey FROM f WHERE due AND NOT held")
def retention_remove_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).where("phase = 'remove'").select("o_orderkey")


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, o_orderstatus <> 'F' AS live FROM orders),
v AS (SELECT *, min(id) OVER (PARTITION BY o_custkey) AS vacancy FROM m)
SELECT DISTINCT vacancy, CASE WHEN bool_or(live) OVER (PARTITION BY vacancy) THEN first_value(id) OVER (PARTITION BY vacancy ORDER BY (id = vacancy AND live) DESC, live DESC, o_orderdate DESC, id) ELSE vacancy END AS new_primary FROM v""")
def family_reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", (F.col("o_orderstatus") != "F").alias("live"))
    least = rows.groupBy(F.col("o_custkey").alias("_c")).agg(F.min("id").alias("vacancy"))
    members = rows.join(least, F.col("o_custkey") == F.col("_c"))
    return lifecycle.reroot(members, "vacancy", "id", F.col("live"), "o_orderdate").select("vacancy", "new_primary").distinct()


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS vacancy, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE ' ' END AS body FROM orders)
SELECT DISTINCT r.vacancy AS primary_id FROM lineitem l JOIN r ON l_orderkey = r.id JOIN r p ON p.id = r.vacancy
WHERE l_linenumber < 3 AND l_linestatus = 'O' AND r.o_orderstatus <> 'F' AND trim(p.body) = '' AND (l_shipdate >= TIMESTAMP '1998-06-01' OR l_linenumber > 1 OR l_returnflag = 'R') ORDER BY 1 LIMIT 300""")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 1, key - 1).otherwise(key).alias("vacancy"), "o_orderstatus", F.when(key % 5 == 0, F.col("o_orderpriority")).otherwise(" ").alias("body"))
    queue = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.lower("l_linestatus").alias("source"), (F.col("l_linenumber") - 1).alias("attempts"), F.col("l_shipdate").alias("queued_at"), F.when(F.col("l_returnflag") == "R", "failed").alias("last_error"))
    return lifecycle.dequeue(queue, records, "id", "vacancy", _open(), F.col("body"), 2, F.lit("1998-06-01").cast("timestamp"), 300, " O ")


@query(_STATED + "SELECT count(*) FILTER (WHERE state = 'known') AS available, count(*) FILTER (WHERE state = 'not_present') AS failed, count(*) FILTER (WHERE state = 'unknown') AS missing FROM s")
def readiness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.readiness(_stated(spark, sf_dir), F.col("state") == "known", F.col("state") == "not_present")


@query(_STATED + "SELECT source, count(*) AS total, count(*) FILTER (WHERE state = 'known') AS known, count(*) FILTER (WHERE state = 'not_present') AS absent, count(*) FILTER (WHERE n_chars > 5000) AS long_texts, greatest(0, count(*) - count(*) FILTER (WHERE state = 'known') - count(*) FILTER (WHERE state = 'not_present') - count(*) FILTER (WHERE n_chars > 5000)) AS residual FROM s GROUP BY source")
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.audit(_stated(spark, sf_dir), "source", {"known": F.col("state") == "known", "absent": F.col("state") == "not_present", "long_texts": F.col("n_chars") > 5000})


@query("""WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return feed.delta(orders.where("o_orderdate < '1996-01-01' AND o_orderpriority <> '5-LOW'"), orders.where("o_orderpriority <> '1-URGENT'"), "o_orderpriority")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return feed.latest(df, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


_CARDS = """WITH c AS (SELECT user_id, event_id, -epoch_us(ts) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS pos, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS t FROM events),
p AS (SELECT *, pos // 20 AS page FROM c), o AS (SELECT *, t IS NOT NULL AND coalesce(lag(t) OVER (PARTITION BY user_id, page ORDER BY pos) >= t, row_number() OVER (PARTITION BY user_id, page ORDER BY pos) = 1) AS ok FROM p),
g AS (SELECT user_id, page, bool_and(ok) AS fit, min(t) AS old, max(t) AS new FROM o GROUP BY 1, 2),
h AS (SELECT *, fit AND coalesce(new <= lag(old) OVER (PARTITION BY user_id ORDER BY page), true) AS fit2 FROM g),
i AS (SELECT *, bool_and(fit2) OVER (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS cutoff_active FROM h)
SELECT user_id, page, pos, cutoff_active, cutoff_active AND coalesce(t < TIMESTAMP '2024-01-10', false) AS past_cutoff FROM o JOIN i USING (user_id, page)"""


@query(_CARDS)
def page_monotonic_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    pos = (F.row_number().over(W.partitionBy("user_id").orderBy(F.col("event_id").desc())) - 1).cast("long")
    cards = events.select("user_id", pos.alias("pos"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("t"))
    cards = cards.withColumn("page", F.floor(F.col("pos") / 20).cast("long"))
    out = lifecycle.page_cutoff(cards, ["user_id"], "page", "pos", "t", F.lit("2024-01-10").cast("timestamp"))
    return out.select("user_id", "page", "pos", "cutoff_active", "past_cutoff")


@query("""WITH w AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e, event_type AS label FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT p.event_id, min(w.label) AS label FROM events p JOIN w ON p.user_id = w.user_id AND p.ts BETWEEN w.s AND w.e WHERE p.event_type = 'click' GROUP BY p.event_id HAVING count(DISTINCT w.label) = 1""")
def interval_join_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    windows = events.where(F.col("event_type").isin("purchase", "signup")).select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e"), F.col("event_type").alias("label"))
    return lifecycle.unique_window(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), windows, "user_id", "ts", "s", "e", "label", "event_id", 6 * 3600)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query("""WITH w AS (SELECT n_name AS name, r_name AS area, src FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('s1'), ('s2')) v(src)),
c AS (SELECT n_name AS name, r_name AS area, src, n_nationkey % 2 = 0 AS active FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('s2'), ('s3')) v(src) WHERE n_nationkey < 20)
SELECT coalesce(w.name, c.name) AS name, coalesce(w.area, c.area) AS area, coalesce(w.src, c.src) AS src, CASE WHEN c.active IS NULL THEN 'insert' WHEN w.name IS NULL AND c.active THEN 'deactivate' ELSE 'keep' END AS action
FROM w FULL JOIN c ON w.name = c.name AND w.area = c.area AND w.src = c.src""")
def registry_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("area"))
    each = lambda df, *src: df.withColumn("src", F.explode(F.array(*[F.lit(s) for s in src])))
    now = each(places.where("n_nationkey < 20"), "s2", "s3").withColumn("active", F.col("n_nationkey") % 2 == 0)
    return merge.registry_sync(each(places, "s1", "s2"), now, ["name", "area", "src"])


@query("""WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN value > 3 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN props END AS body FROM events),
m AS (SELECT *, value IS NOT NULL AND coalesce(trim(body) <> '', false) AS ok FROM r)
SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE ok) AS valid_rows, arg_min(body, event_id) FILTER (WHERE ok) AS body,
CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'invalid' WHEN count(DISTINCT CASE WHEN ok THEN event_type END) > 1 THEN 'conflict' ELSE 'import' END AS verdict FROM m GROUP BY user_id""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 3, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("body"))
    return merge.import_plan(rows, "user_id", ["value", "body"], ["body"], F.col("event_id"), "event_type").select("user_id", "rows", "valid_rows", "body", "verdict")


@query("SELECT lang AS old, upper(lang) AS new, count(*) AS rows, lang <> upper(lang) AS changed FROM documents GROUP BY ALL")
def recompute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return merge.recompute_diff(docs, docs.withColumn("lang", F.upper("lang")), "doc_id", "lang")


# ---- scalar normalisers

_LOC = r"""WITH t AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Suburb ' || n_nationkey || ' NSW, Australia' WHEN 1 THEN 'Canberra ACT' WHEN 2 THEN 'Queensland' WHEN 3 THEN 'Town' || n_nationkey || ', New South Wales' ELSE n_name END AS loc FROM nation),
f AS (SELECT *, trim(regexp_replace(lower(split_part(loc, ',', 1)), '[^\pL\pN_]+', ' ', 'g')) AS head, trim(regexp_replace(lower(loc), '[^\pL\pN_]+', ' ', 'g')) AS whole FROM t),
b AS (SELECT *, trim(regexp_replace(head, ' (australian capital territory|new south wales|queensland|australia|nsw|qld|act)$', '')) AS bare FROM f)
SELECT n_nationkey, CASE WHEN bare IN ('australia','new south wales','nsw','queensland','qld','australian capital territory','act') THEN '' ELSE bare END AS locality,
CASE WHEN regexp_matches(whole, '\b(australian capital territory|act|canberra)\b') THEN 'canberra' ELSE '' END AS region,
CASE WHEN regexp_matches(whole, '\b(new south wales|nsw)\b') THEN 'NSW' WHEN regexp_matches(whole, '\b(queensland|qld)\b') THEN 'QLD' WHEN regexp_matches(whole, '\b(australian capital territory|act)\b') THEN 'ACT' ELSE 'none' END AS code FROM b"""


@query(_LOC)
def locality_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    loc = (
        F.when(key % 5 == 0, F.concat(F.lit("Suburb "), key.cast("string"), F.lit(" NSW, Australia")))
        .when(key % 5 == 1, "Canberra ACT")
        .when(key % 5 == 2, "Queensland")
        .when(key % 5 == 3, F.concat(F.lit("Town"), key.cast("string"), F.lit(", New South Wales")))
        .otherwise(name)
    )
    df = table(spark, sf_dir, "nation").select("n_nationkey", loc.alias("loc"))
    return df.select("n_nationkey", X.locality(F.col("loc")).alias("locality"), X.region(F.col("loc")).alias("region"), X.geography(F.col("loc"), F.lit("none")).alias("code"))


@query("""SELECT p_partkey, 'known' AS state, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_retailprice END AS min_amount,
CASE WHEN p_partkey % 4 = 2 THEN NULL WHEN p_partkey % 4 = 0 THEN p_retailprice + p_size ELSE p_retailprice END AS max_amount, 'day' AS period, 'AUD' AS currency,
CASE p_partkey % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'up_to' WHEN 2 THEN 'from' ELSE 'exact' END AS bound FROM part""")
def salary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, low = F.col("p_partkey"), F.format_number("p_retailprice", 2)
    high = F.format_number(F.col("p_retailprice") + F.col("p_size"), 2)
    label = (
        F.when(key % 4 == 0, F.concat(F.lit("AUD $"), low, F.lit(" - $"), high, F.lit(" per day + super")))
        .when(key % 4 == 1, F.concat(F.lit("Up to AUD $"), low, F.lit(" per day")))
        .when(key % 4 == 2, F.concat(F.lit("From $"), low, F.lit(" AUD p.d.")))
        .otherwise(F.concat(F.lit("AUD "), low, F.lit(" daily")))
    )
    s = F.col("s")
    df = table(spark, sf_dir, "part").select("p_partkey", salary.normalize_salary(label).alias("s"))
    return df.select("p_partkey", s["state"].alias("state"), F.round(s["min_amount"], 2).alias("min_amount"), F.round(s["max_amount"], 2).alias("max_amount"), s["period"].alias("period"), s["currency"].alias("currency"), s["bound"].alias("bound"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts - to_hours((event_id % 30 + 1)::INT) WHEN 1 THEN ts - to_days((event_id % 6 + 1)::INT) ELSE ts - INTERVAL 24 MINUTE END AS value, 'source_relative' AS basis FROM events")
def posting_date_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    label = (
        F.when(key % 3 == 0, F.concat(F.lit("Listed "), (key % 30 + 1).cast("string"), F.lit("h ago")))
        .when(key % 3 == 1, F.concat((key % 6 + 1).cast("string"), F.lit(" days ago")))
        .otherwise("twenty-four minutes ago")
    )
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    df = table(spark, sf_dir, "events").select("event_id", dates.posting_date(F.lit(None).cast("string"), label, at).alias("d"), F.col("ts"))
    return df.select("event_id", F.col("d")["value"].cast(df.schema["ts"].dataType).alias("value"), F.col("d")["basis"].alias("basis"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS links FROM pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    df = table(spark, sf_dir, "pages").select("page_id", readers.html_facts(F.col("html")).alias("f"))
    return df.select("page_id", f["title"].alias("title"), f["lang"].alias("lang"), f["links"].cast("long").alias("links"))


# ---- coverage


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"), F.lit("INCOMPLETE").alias("status"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 == 0, "INCOMPLETE_PAGE_LIMIT").otherwise("COMPLETE").alias("status"))
    return regions.unionByName(nations)


_TREE = """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS label, 'INCOMPLETE' AS status FROM region UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'INCOMPLETE_PAGE_LIMIT' ELSE 'COMPLETE' END FROM nation),
t AS (SELECT id, label AS path, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT c.id, t.path || ' > ' || c.label, t.depth + 1 FROM nodes c JOIN t ON c.parent = t.id)
"""


@query(_TREE + "SELECT id, path, depth FROM t")
def coverage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.paths(_tree(spark, sf_dir))


@query(_TREE + "SELECT n.id, t.path, n.status FROM nodes n JOIN t ON n.id = t.id WHERE n.status NOT LIKE 'COMPLETE%' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.id)")
def incomplete_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return coverage.incomplete_leaves(tree).select("id", "status").join(coverage.paths(tree).select("id", "path"), "id").select("id", "path", "status")


@query("""WITH k AS (SELECT n_nationkey AS id, n_regionkey AS parent, CASE WHEN n_nationkey = 7 THEN 'INCOMPLETE_COUNT_MISMATCH' WHEN n_nationkey = 8 THEN 'COMPLETE_INCREMENTAL' ELSE 'COMPLETE' END AS status FROM nation),
s AS (SELECT parent, count(*) AS child_count, bool_and(status LIKE 'COMPLETE%') AS ok, bool_or(status = 'COMPLETE_INCREMENTAL') AS inc FROM k GROUP BY 1),
u AS (SELECT k.parent, count(DISTINCT c_custkey % 1000) AS n FROM customer JOIN k ON c_nationkey = k.id GROUP BY 1)
SELECT r_regionkey AS id, 250 AS reported, coalesce(n, 0) AS unique_jobs, coalesce(child_count, 0) AS child_count,
CASE WHEN ok AND inc THEN 'COMPLETE_INCREMENTAL' WHEN ok AND coalesce(n, 0) + 5 >= 250 THEN 'COMPLETE_BY_PARTITION' ELSE 'INCOMPLETE_CHILD_COVERAGE' END AS status
FROM region LEFT JOIN s ON r_regionkey = s.parent LEFT JOIN u ON r_regionkey = u.parent""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    kids = table(spark, sf_dir, "nation").select(key.alias("id"), F.col("n_regionkey").alias("parent"), F.when(key == 7, "INCOMPLETE_COUNT_MISMATCH").when(key == 8, "COMPLETE_INCREMENTAL").otherwise("COMPLETE").alias("status"))
    held = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("partition"), (F.col("c_custkey") % 1000).alias("job"))
    return coverage.roll_up(kids, held, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit(250).alias("reported")), 5)


@query("""SELECT c_custkey, CASE WHEN c_acctbal + 10 >= 5000 THEN 'COMPLETE' WHEN c_custkey % 5 = 0 THEN 'COMPLETE_INCREMENTAL' WHEN c_custkey % 7 = 0 THEN 'INCOMPLETE_REPEATED_PAGE' WHEN c_custkey % 11 = 0 THEN 'INCOMPLETE_PAGE_LIMIT' ELSE 'INCOMPLETE_COUNT_MISMATCH' END AS status FROM customer""")
def leaf_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", coverage.leaf_status(F.col("c_acctbal"), F.lit(5000), 10, key % 5 == 0, key % 7 == 0, key % 11 == 0).alias("status"))


# ---- entity resolution


def _part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("employer"), F.col("p_type").alias("classification"),
        F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("employment_type"), F.concat(F.lit("Town"), (F.col("p_size") % 4).cast("string")).alias("location"),
        F.concat(F.lit("src"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.concat(F.lit("$"), F.floor(F.col("p_retailprice") / 100).cast("string")).alias("salary_text"),
    )


@query("""WITH c AS (SELECT p_partkey AS id, lower(p_name) AS t, p_brand AS e, p_type AS c, p_size % 2 AS emp, p_size % 4 AS loc, floor(p_retailprice / 100) AS sal FROM part),
p AS (SELECT a.id AS a, b.id AS b, a.c = b.c AND a.emp = b.emp AND a.loc = b.loc AND a.sal = b.sal AS exact,
 0.72 + CASE WHEN a.loc = b.loc THEN 0.08 ELSE 0 END + CASE WHEN a.emp = b.emp THEN 0.04 ELSE 0 END + CASE WHEN a.sal = b.sal THEN 0.04 ELSE 0 END + CASE WHEN a.c = b.c THEN 0.03 ELSE 0 END AS score FROM c a JOIN c b ON a.t = b.t AND a.e = b.e AND a.id < b.id)
SELECT a, b, CASE WHEN exact THEN 1.0 ELSE round(score, 2) END::DOUBLE AS score, CASE WHEN exact THEN 'exact_rich_card' ELSE 'near_rich_card' END AS match_type FROM p WHERE exact OR round(score, 9) >= 0.92""")
def near_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges(_part_cards(spark, sf_dir)).withColumn("score", F.round("score", 2))


@query()
def same_vacancy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.same_vacancy(_part_cards(spark, sf_dir))


# ---- streaming


@query(ORACLE_SQL["observation_state"])
def stream_observation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return streaming.drain(streaming.running_state(stream, "user_id", "ts", "event_id"))
