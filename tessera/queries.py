"""A query for every operator, on the star schema and event tables, and the SQL
that gives the same rows.  Each runs over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import Index, Table
from .functions import columns as C
from .functions.throttle import replay
from .operators import log, write
from .operators.indexes import index_order, index_view
from .operators.read import Request, batch_get, count, get_item, key_conditions, page, pages, positional_get, query, scan, segment, selected, top_of_partitions
from .operators.update import returned, update
from .plans import partiql
from .service import Service, ServiceError
from .sources.files import shared_folder
from .sources.tagged_json import checked, read_items, update_items, write_items
from .values import ValidationError

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = Table("events", "user_id", "ts", {"user_id": "N", "ts": "N"})
ORDERS = Table("orders", "o_custkey", "o_orderkey", {"o_custkey": "N", "o_orderkey": "N", "o_orderstatus": "S", "o_orderdate": "S", "o_orderpriority": "S"}, indexes=(
    Index("all", "o_orderstatus", "o_orderdate"),
    Index("keys", "o_orderstatus", "o_orderdate", "KEYS_ONLY"),
    Index("some", "o_orderpriority", "o_orderdate", "INCLUDE", ("o_totalprice",)),
))
CUSTOMER = Table("customer", "c_custkey", None, {"c_custkey": "N", "c_mktsegment": "S", "c_name": "S"}, indexes=(Index("segment", "c_mktsegment", "c_name"),))
LINE_KEYS, LINE_ORDER = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]
NOW = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the label attributes that some lack."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


# Point and partition reads.
@add("get_item", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return get_item(table(spark, d, "orders"), {"o_orderkey": {"N": "7"}})


@add("query_partition", "SELECT * FROM events WHERE user_id = 8")
def _(spark, d):
    return query(table(spark, d, "events"), EVENTS.keys, "user_id = :u", Request(values={":u": 8}))


def _time(text: str):
    import datetime

    return datetime.datetime.fromisoformat(text)


def _span(spark: SparkSession, d: str):
    """The middle half of the time that the events cover."""
    low, high = table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    return low + (high - low) / 4, high - (high - low) / 4


@add("query_sk_between", "SELECT event_id, user_id, ts, event_type, value FROM events WHERE user_id = 8 AND ts BETWEEN (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events) AND (SELECT max(ts) - (max(ts) - min(ts)) / 4 FROM events) AND event_type = 'click'")
def query_sk_between(spark, d):
    low, high = _span(spark, d)
    r = Request(filter="#t = :t", names={"#t": "event_type"}, values={":u": 8, ":a": low, ":b": high, ":t": "click"}, projection="event_id, user_id, ts, #t, #v")
    r.names["#v"] = "value"
    return query(table(spark, d, "events"), EVENTS.keys, "user_id = :u AND ts BETWEEN :a AND :b", r)


@add("query_sk_compare", "SELECT op, o_custkey, o_orderkey FROM orders, (VALUES ('<'), ('<='), ('='), ('>='), ('>')) t(op) WHERE o_custkey = 10 AND CASE op WHEN '<' THEN o_orderkey < 5000 WHEN '<=' THEN o_orderkey <= 5000 WHEN '=' THEN o_orderkey = 5000 WHEN '>=' THEN o_orderkey >= 5000 ELSE o_orderkey > 5000 END")
def _(spark, d):
    orders, out = table(spark, d, "orders"), None
    for op in ("<", "<=", "=", ">=", ">"):
        rows = query(orders, ORDERS.keys, f"o_custkey = :c AND o_orderkey {op} :o", Request(values={":c": 10, ":o": 5000}, projection="o_custkey, o_orderkey")).withColumn("op", F.lit(op))
        out = rows if out is None else out.union(rows)
    return out.select("op", "o_custkey", "o_orderkey")


@add("query_begins_with", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer#00000')")
def _(spark, d):
    index = CUSTOMER.index("segment")
    view = index_view(table(spark, d, "customer"), CUSTOMER, index)
    return query(view, index.keys, "c_mktsegment = :s AND begins_with(c_name, :p)", Request(values={":s": "BUILDING", ":p": "Customer#00000"}), CUSTOMER.keys)


@add("query_reverse_limit", "SELECT * FROM events WHERE user_id = 8 ORDER BY ts DESC LIMIT 5")
def _(spark, d):
    return query(table(spark, d, "events"), EVENTS.keys, "user_id = :u", Request(values={":u": 8}, forward=False, limit=5))


@add("query_limit_then_filter", "SELECT * FROM (SELECT * FROM events WHERE user_id = 8 ORDER BY ts LIMIT 20) WHERE event_type = 'click'")
def _(spark, d):
    return query(table(spark, d, "events"), EVENTS.keys, "user_id = :u", Request(values={":u": 8, ":t": "click"}, limit=20, filter="event_type = :t"))


@add("topk_per_partition", "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS INTEGER) AS rn FROM events QUALIFY rn <= 3")
def _(spark, d):
    return top_of_partitions(table(spark, d, "events"), EVENTS.keys, 3, forward=False)


# The predicate language.
@add("scan_filter", "SELECT * FROM part WHERE (p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#23')) OR (NOT (p_size < 45) AND p_retailprice > 1000)")
def _(spark, d):
    r = Request(filter="(p_size BETWEEN :a AND :b AND p_brand IN (:w, :x, :y, :z)) OR (NOT p_size < :c AND p_retailprice > :p)", values={":a": 10, ":b": 30, ":c": 45, ":p": 1000, ":w": "Brand#11", ":x": "Brand#12", ":y": "Brand#13", ":z": "Brand#23"})
    return scan(table(spark, d, "part"), ["p_partkey"], r)


def _labelled_scan(name: str, text: str, sql: str) -> None:
    @add(name, f"SELECT * FROM {_LABELLED} WHERE {sql}")
    def _(spark, d):
        return scan(_labelled(spark, d), ["doc_id"], Request(filter=text, values={":q": 1, ":t": 0, ":s": "x", ":n": "N"}))


_labelled_scan("scan_not_missing", "NOT quality = :q", "quality IS NULL OR quality <> 1")
_labelled_scan("scan_neq_missing", "quality <> :q", "quality <> 1")
_labelled_scan("scan_exists", "attribute_exists(quality) AND toxic = :t", "quality IS NOT NULL AND toxic = 0")
_labelled_scan("scan_not_exists", "attribute_not_exists(quality)", "quality IS NULL")
_labelled_scan("scan_attribute_type", "attribute_type(quality, :n)", "quality IS NOT NULL")
_labelled_scan("scan_type_mismatch", "NOT (lang <> :q OR quality = :s) AND NOT quality = toxic", "quality IS NULL OR toxic IS NULL OR quality <> toxic")


@add("scan_contains_size", "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(text, 'the') AND octet_length(encode(text)) BETWEEN 500 AND 3000")
def _(spark, d):
    r = Request(filter="contains(#t, :w) AND size(#t) BETWEEN :a AND :b", names={"#t": "text"}, values={":w": "the", ":a": 500, ":b": 3000}, projection="doc_id, lang, source, n_chars")
    return scan(table(spark, d, "documents"), ["doc_id"], r)


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested documents."""
    events = table(spark, d, "events").withColumn("props", F.from_json("props", "k long"))
    return events.withColumn("info", F.struct(F.struct("user_id", "event_type").alias("who"), F.array(F.struct(F.col("value").alias("v"), F.col("props.k").alias("k")), F.struct((F.col("value") + 1).alias("v"), (F.col("props.k") + 1).alias("k"))).alias("list")))


@add("scan_path", "SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def _(spark, d):
    return scan(_nested(spark, d), ["event_id"], Request(filter="props.k >= :k", values={":k": 50}, projection="event_id, user_id"))


@add("scan_projection", "SELECT event_id, event_type AS who_type, [value, value + 1] AS vs, CAST(2 AS INTEGER) AS picks FROM events")
def _(spark, d):
    rows = scan(_nested(spark, d), ["event_id"], Request(projection="event_id, info.who.event_type, info.#l[0].v, info.#l[1].v, info.nothing", names={"#l": "list"}))
    return rows.select("event_id", F.col("info.who.event_type").alias("who_type"), F.transform("info.list", lambda x: x.v).alias("vs"), F.size("info.list").alias("picks"))


@add("scan_count", 'SELECT count(*) FILTER (WHERE p_size > 25) AS "Count", count(*) AS "ScannedCount" FROM part')
def _(spark, d):
    return count(table(spark, d, "part"), Request(filter="p_size > :s", values={":s": 25}))


_FNV = "list_reduce(list_prepend(1469598103934665603::HUGEINT, list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::INTEGER::HUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@add("scan_segment", f"SELECT c_custkey, c_name FROM (SELECT *, encode('S' || c_name) || '\\x00\\x00'::BLOB AS b FROM customer) WHERE {_FNV} % 4 = 1")
def _(spark, d):
    return segment(table(spark, d, "customer"), ["c_name"], 1, 4, exact=True).select("c_custkey", "c_name")


@add("segments_tile", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct FROM orders")
def _(spark, d):
    orders, parts = table(spark, d, "orders"), None
    for i in range(3):
        part = scan(orders, ["o_orderkey"], Request(segment=(i, 3), projection="o_orderkey"))
        parts = part if parts is None else parts.union(part)
    return parts.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


# Pages.
@add("page_keyset", "SELECT * FROM orders WHERE o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 2000) ORDER BY o_custkey, o_orderkey LIMIT 100")
def _(spark, d):
    return scan(table(spark, d, "orders"), ORDERS.keys, Request(start={"o_custkey": 40, "o_orderkey": 2000}, limit=100))


_DOC_SIZE = "CAST(6 + octet_length(encode(CAST(doc_id AS VARCHAR))) + 4 + octet_length(encode(text)) + 4 + octet_length(encode(lang)) + 6 + octet_length(encode(source)) + 7 + octet_length(encode(CAST(n_chars AS VARCHAR))) AS BIGINT)"


@add("page_bytes", f"SELECT doc_id, n_chars FROM (SELECT *, sum({_DOC_SIZE}) OVER (ORDER BY doc_id) AS s, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k <= 1000 AND (s <= 1048576 OR k = 1)")
def _(spark, d):
    return page(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "n_chars")


@add("index_page", "SELECT o_orderstatus, o_orderdate, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_custkey, o_orderkey LIMIT 50")
def _(spark, d):
    index = ORDERS.index("keys")
    return query(index_view(table(spark, d, "orders"), ORDERS, index), index.keys, "o_orderstatus = :s", Request(values={":s": "F"}, limit=50), index_order(ORDERS, index))


# Batches of reads.
@add("batch_get", "SELECT * FROM orders WHERE o_orderkey IN (1, 5, 7, 32, 99999999)")
def _(spark, d):
    wanted = spark.createDataFrame([(k,) for k in (1, 5, 7, 32, 7, 99_999_999)], "o_orderkey long")
    return batch_get(table(spark, d, "orders"), wanted, ["o_orderkey"])


@add("transact_get", "SELECT CAST(place AS BIGINT) AS place, CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (VALUES (0, 5), (1, -1), (2, 17)) t(place, c_custkey) LEFT JOIN customer USING (c_custkey)")
def _(spark, d):
    wanted = spark.createDataFrame([(0, 5), (1, -1), (2, 17)], "place long, c_custkey long")
    return positional_get(table(spark, d, "customer"), wanted, ["c_custkey"], "place")


# Indexes.
@add("gsi_all", "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders)")
def _(spark, d):
    orders, index = table(spark, d, "orders"), ORDERS.index("all")
    low, high = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    return query(index_view(orders, ORDERS, index), index.keys, "o_orderstatus = :s AND o_orderdate >= :d", Request(values={":s": "O", ":d": low + (high - low) / 2}), ORDERS.keys)


@add("gsi_keys_only", "SELECT o_orderstatus, o_orderdate, o_custkey, o_orderkey FROM orders")
def _(spark, d):
    return index_view(table(spark, d, "orders"), ORDERS, ORDERS.index("keys"))


@add("gsi_include", "SELECT o_orderpriority, o_orderdate, o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    view = index_view(table(spark, d, "orders"), ORDERS, ORDERS.index("some"))
    return scan(view, ORDERS.keys, Request(filter="o_totalprice > :p", values={":p": 100_000}))


@add("gsi_sparse", f"SELECT quality, doc_id FROM {_LABELLED} WHERE quality IS NOT NULL")
def _(spark, d):
    documents = Table("documents", "doc_id", None, {"doc_id": "N", "quality": "N"}, indexes=(Index("quality", "quality", None, "KEYS_ONLY"),))
    return index_view(_labelled(spark, d), documents, documents.index("quality"))


# Writes.  lineitem stands for a log: its key repeats, its order is the ship date.
_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem"
_LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate"


@add("put_newest_wins", f"SELECT {_LINE_COLUMNS} FROM ({_LINES}) WHERE k = 1")
def _(spark, d):
    return log.newest(table(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", ")), LINE_KEYS, LINE_ORDER)


@add("delete_tombstone", f"SELECT {_LINE_COLUMNS} FROM ({_LINES}) WHERE k = 1 AND l_returnflag <> 'R'")
def _(spark, d):
    return log.current(table(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", ")), LINE_KEYS, LINE_ORDER, F.col("l_returnflag") == "R")


@add("pitr", f"SELECT {_LINE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-17') WHERE k = 1 AND l_returnflag <> 'R'")
def _(spark, d):
    past = log.as_of(table(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", ")), F.col("l_shipdate") <= F.lit(_time("1995-06-17")))
    return log.current(past, LINE_KEYS, LINE_ORDER, F.col("l_returnflag") == "R")


@add("conditional_put", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1 THEN 'OK' ELSE 'ConditionalCheckFailed' END AS status FROM lineitem) GROUP BY status")
def _(spark, d):
    return write.first_wins(table(spark, d, "lineitem").select(*LINE_KEYS, *LINE_ORDER), LINE_KEYS, LINE_ORDER).groupBy("status").agg(F.count("*").alias("n"))


@add("conditional_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 OR o_totalprice IS NULL THEN 'OK' ELSE 'ConditionalCheckFailed' END AS status FROM (SELECT DISTINCT l_orderkey + 1 AS o_orderkey FROM lineitem) LEFT JOIN orders USING (o_orderkey)")
def _(spark, d):
    requests = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1).alias("o_orderkey")).distinct()
    return write.conditional(table(spark, d, "orders"), requests, ["o_orderkey"], "o_totalprice > :p OR attribute_not_exists(o_orderkey)", {":p": 150_000})


@add("update_set_add", "SELECT o_orderkey, round(o_totalprice * 1.0 + 10 - 2.5, 4) AS o_totalprice, 'DONE' AS o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    out = update(orders, "SET o_orderstatus = :s, o_orderpriority = if_not_exists(o_orderpriority, :s), o_totalprice = o_totalprice - :m ADD o_totalprice :n", {":s": "DONE", ":n": 10, ":m": 2.5}, keys=("o_orderkey",))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


def _tagged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a set of status letters and a list of numbers."""
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.array_distinct(F.array(status, F.lit("F"))).alias("tags"), F.array("o_custkey", "o_orderkey").alias("list"))


@add("update_set_ops", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN ['X'] ELSE list_sort([o_orderstatus, 'X']) END AS tags, [o_custkey, o_orderkey, 1, 2] AS list FROM orders")
def _(spark, d):
    out = update(_tagged_orders(spark, d), "ADD tags :x DELETE tags :y SET #l = list_append(#l, :z)", {":x": {"SS": ["X", "F"]}, ":y": {"SS": ["F", "O"]}, ":z": [1, 2]}, {"#l": "list"}, keys=("o_orderkey",), sets=frozenset({"tags"}))
    return out.withColumn("tags", F.array_sort("tags"))


@add("update_remove_nested", "SELECT event_id, value AS v0, CAST(NULL AS BIGINT) AS k0, CAST(1 AS INTEGER) AS n FROM events")
def _(spark, d):
    out = update(_nested(spark, d), "REMOVE info.#l[1], info.#l[0].k", names={"#l": "list"}, keys=("event_id",))
    return out.select("event_id", F.col("info.list")[0].v.alias("v0"), F.col("info.list")[0].k.alias("k0"), F.size("info.list").alias("n"))


@add("update_returning", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'F' END AS o_orderstatus FROM orders")
def _(spark, d):
    return returned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "SET o_orderstatus = :s", "UPDATED_NEW", ["o_orderkey"], {":s": "F"})


@add("transact_write", "SELECT l_orderkey, l_linenumber, l_partkey, bool_and(l_quantity < 45) OVER (PARTITION BY l_orderkey) AS committed FROM lineitem")
def _(spark, d):
    actions = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return write.transact(actions, "l_orderkey", F.col("l_quantity") < 45).select("l_orderkey", "l_linenumber", "l_partkey", "committed")


@add("idempotent_write", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'OK' WHEN first_value(l_partkey) OVER w = l_partkey THEN 'Replayed' ELSE 'IdempotentParameterMismatch' END AS status FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey)) GROUP BY status")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", *LINE_KEYS).alias("token"), F.col("l_partkey").cast("string").alias("body"), *LINE_ORDER)
    return write.once(rows, "token", "body", LINE_ORDER).groupBy("status").agg(F.count("*").alias("n"))


# The change feed.
_FEED_COLUMNS = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
_FEED = "SELECT *, lag(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) OVER w AS old_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey)"
_EVENTS_SQL = f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, old_quantity, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS new_quantity, CASE WHEN l_returnflag = 'R' THEN 'REMOVE' WHEN old_quantity IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS event_name FROM ({_FEED}) WHERE l_returnflag <> 'R' OR old_quantity IS NOT NULL"


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return log.changes(table(spark, d, "lineitem").select(*_FEED_COLUMNS), LINE_KEYS, LINE_ORDER, F.col("l_returnflag") == "R")


@add("change_stream", _EVENTS_SQL)
def _(spark, d):
    return _feed(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("old_image.l_quantity").alias("old_quantity"), F.col("new_image.l_quantity").alias("new_quantity"), "event_name")


@add("stream_view", f"SELECT event_name, count(*) AS n, count(old_quantity) AS n_old, CAST(0 AS BIGINT) AS n_new FROM ({_EVENTS_SQL}) GROUP BY event_name")
def _(spark, d):
    feed = log.viewed(_feed(spark, d), "OLD_IMAGE")
    return feed.groupBy("event_name").agg(F.count("*").alias("n"), F.count("old_image").alias("n_old"), F.count("new_image").alias("n_new"))


@add("stream_records", "SELECT event_id AS seq, user_id, event_type FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 1000")
def _(spark, d):
    return log.records(table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type"), "AT_SEQUENCE_NUMBER", 100)


@add("stream_retention", "SELECT count(*) AS n FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 86400")
def _(spark, d):
    events = table(spark, d, "events").select(_epoch("ts").alias("at"))
    latest = events.agg(F.max("at").alias("now"))
    return events.join(F.broadcast(latest)).where(F.col("at") >= F.col("now") - 86_400).agg(F.count("*").alias("n"))


def _epoch(name: str):
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`) AS DOUBLE) / 1e6")


# Expiry, sizes, capacity.
@add("ttl_live", "SELECT event_id, user_id FROM events WHERE floor(epoch(ts)) > (SELECT floor(avg(epoch(ts))) FROM events)")
def _(spark, d):
    events = table(spark, d, "events").withColumn("expires", F.floor(_epoch("ts")))
    now = int(events.agg(F.floor(F.avg(_epoch("ts")))).first()[0] or 0)
    return scan(events, ["event_id"], Request(ttl="expires", now=now, projection="event_id, user_id"))


@add("item_size", f"SELECT doc_id, {_DOC_SIZE} AS item_bytes FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("doc_id", C.item_size(docs).alias("item_bytes"))


@add("capacity_units", f"SELECT doc_id, greatest(0.5, ceil(s / 4096.0)) AS strong, greatest(0.5, ceil(s / 4096.0) * 0.5) AS eventual, greatest(0.5, ceil(s / 4096.0) * 2) AS transactional, greatest(1.0, ceil(s / 1024.0)) AS written FROM (SELECT doc_id, CAST({_DOC_SIZE} AS DOUBLE) AS s FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    size = C.item_size(docs)
    return docs.select("doc_id", C.read_units(size).alias("strong"), C.read_units(size, consistent=False).alias("eventual"), C.read_units(size, transactional=True).alias("transactional"), C.write_units(size).alias("written"))


_TAKEN = """WITH RECURSIVE r AS (SELECT event_type AS table_name, epoch_us(ts) / 1e6 AS "at", row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
b AS (SELECT table_name, "at", k, 0.001::DOUBLE * 300.0::DOUBLE AS level FROM r WHERE k = 1
  UNION ALL SELECT r.table_name, r."at", r.k, least(0.001::DOUBLE * 300.0::DOUBLE, CASE WHEN b.level <= 0 THEN b.level ELSE b.level - 1 END + (r."at" - b."at") * 0.001::DOUBLE) FROM b JOIN r ON r.table_name = b.table_name AND r.k = b.k + 1)
SELECT table_name, "at", CAST(1 AS DOUBLE) AS units, level > 0 AS admitted FROM b"""


@add("throttle_replay", _TAKEN)
def _(spark, d):
    events = table(spark, d, "events").select("event_type", _epoch("ts").alias("at"), F.lit(1.0).alias("units"))
    return replay(events, "event_type", "at", "units", rate=0.001)


@add("backup_size", "SELECT count(*) * 1024 AS backup_bytes FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg((F.count("*") * 1024).alias("backup_bytes"))


# PartiQL.
@add("partiql_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000.5 AND o_custkey <> 5")
def _(spark, d):
    s = partiql.parse("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000.5 AND o_custkey <> ?", [5])
    return partiql.select(table(spark, d, s.table), s)


@add("partiql_mismatch", f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NOT NULL AND lang = 'en'")
def _(spark, d):
    s = partiql.parse("SELECT doc_id FROM labelled WHERE quality <> 'text' AND lang = 'en'")
    return partiql.select(_labelled(spark, d), s)


# Documents of tagged JSON.
_TAGGED_ORDER = """'{"o_custkey":{"N":"' || o_custkey || '"},"o_orderkey":{"N":"' || o_orderkey || '"},"o_orderpriority":{"S":"' || o_orderpriority || '"},"o_orderstatus":{"S":"' || o_orderstatus || '"}}'"""


def _order_documents(spark: SparkSession, d: str) -> DataFrame:
    return write_items(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"))


@add("json_sink", f"SELECT {_TAGGED_ORDER} AS value FROM orders")
def _(spark, d):
    return _order_documents(spark, d)


@add("json_source_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F') AND o_custkey BETWEEN 10 AND 500 AND o_orderkey <> 7 AND starts_with(o_orderpriority, '1')")
def _(spark, d):
    items = read_items(_order_documents(spark, d), {"o_custkey": "N", "o_orderkey": "N"})
    r = Request(filter="NOT o_orderstatus = :f AND o_custkey BETWEEN :a AND :b AND o_orderkey <> :k AND begins_with(o_orderpriority, :p) AND attribute_not_exists(other.path)", values={":f": "F", ":a": 10, ":b": 500, ":k": 7, ":p": "1"})
    return scan(items, ["o_custkey", "o_orderkey"], r).select(F.col("o_orderkey").cast("long"), F.try_variant_get("item", "$.o_orderstatus.S", "string").alias("o_orderstatus"))


@add("json_update", """SELECT '{"n":{"N":"' || (o_custkey + 1) || '"},"o_orderkey":{"N":"' || o_orderkey || '"},"tags":{"SS":["a","' || o_orderstatus || '"]}}' AS value FROM orders""")
def _(spark, d):
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("n"), F.array(F.lit("a")).alias("tags"), F.col("o_orderstatus").alias("s"))
    both = write_items(docs, frozenset({"tags"}))
    out = None
    for status in ("F", "O", "P"):
        part = both.where(F.contains("value", F.lit(f'"s":{{"S":"{status}"}}')))
        part = update_items(part, "SET n = n + :one REMOVE s ADD tags :t", {":one": 1, ":t": {"SS": [status]}}, keys=("o_orderkey",)).where("error IS NULL").select("value")
        out = part if out is None else out.union(part)
    return out


@add("validate_items", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 40 THEN 'empty set' WHEN l_quantity > 30 THEN 'duplicates' WHEN l_quantity > 20 THEN 'number' ELSE 'valid' END AS kind FROM lineitem) GROUP BY kind")
def _(spark, d):
    q = F.col("l_quantity")
    body = F.when(q > 40, '{"k":{"S":"a"},"s":{"SS":[]}}').when(q > 30, '{"k":{"S":"a"},"s":{"SS":["x","x"]}}').when(q > 20, '{"k":{"S":"a"},"n":{"N":"1.x"}}').otherwise('{"k":{"S":"a"},"n":{"N":"1.50"}}')
    out = checked(table(spark, d, "lineitem").select(body.alias("value")), {"k": "S"})
    e = F.col("error")
    kind = F.when(e.contains("empty"), "empty set").when(e.contains("duplicates"), "duplicates").when(e.contains("number"), "number").when(e.isNull() & F.contains("value", F.lit('"1.5"')), "valid").otherwise(e)
    return out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# Writes that make items, fail on them, or come in groups.
_FEW = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"


def _few(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


@add("conditional_put_empty", "SELECT o_orderkey, 'OK' AS status FROM orders")
def _(spark, d):
    orders = _few(spark, d)
    return write.conditional(orders.limit(0), orders.select("o_orderkey"), ["o_orderkey"], "attribute_not_exists(o_orderkey) AND NOT o_totalprice > :p", {":p": 1})


@add("update_upsert", """SELECT o_orderkey, CASE WHEN w IS NULL THEN o_totalprice ELSE coalesce(o_totalprice, 0) + 5 END AS o_totalprice, CASE WHEN w IS NULL THEN o_orderstatus ELSE coalesce(o_orderstatus, 'NEW') END AS o_orderstatus, CASE WHEN w IS NOT NULL THEN 'yes' END AS seen
FROM orders FULL JOIN (SELECT DISTINCT l_orderkey * 3 AS o_orderkey, 1 AS w FROM lineitem) USING (o_orderkey)""")
def _(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("o_orderkey"))
    return write.upsert(_few(spark, d), wanted, ["o_orderkey"], "SET o_orderstatus = if_not_exists(o_orderstatus, :n), seen = :y ADD o_totalprice :v REMOVE nothing, nothing.at.all", {":n": "NEW", ":y": "yes", ":v": 5})


@add("update_nested_set", "SELECT event_id, [CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END, CASE WHEN event_id % 2 = 0 THEN 7 ELSE user_id END] || CASE WHEN event_id % 2 = 0 THEN [8] ELSE [] END AS list, CASE WHEN event_id % 2 = 0 THEN 9 ELSE event_id END AS k, CASE WHEN event_id % 2 = 1 THEN 'ValidationException' END AS error FROM events")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", F.array("event_id", "user_id").alias("list"), F.struct(F.struct(F.col("event_id").alias("k")).alias("in")).alias("info"))
    even, odd = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    good = update(even, "SET #l[2] = :c, #l[0] = :a, #l[1] = :b, info.#i.k = :k", {":a": 0, ":b": 7, ":c": 8, ":k": 9}, {"#l": "list", "#i": "in"}, keys=("event_id",), error="error")
    bad = update(odd, "SET info.#i.k = :k, #l[9] = :a", {":a": 0, ":k": 9}, {"#l": "list", "#i": "in"}, keys=("event_id",), error="error")
    return good.union(bad).select("event_id", "list", F.col("info.in.k").alias("k"), "error")


@add("update_add_replaces", "SELECT o_orderkey, CAST(3 AS BIGINT) AS o_orderstatus FROM orders")
def _(spark, d):
    out = update(_few(spark, d).select("o_orderkey", "o_orderstatus"), "ADD o_orderstatus :n", {":n": 3}, keys=("o_orderkey",))
    return out.select("o_orderkey", F.col("o_orderstatus").cast("long").alias("o_orderstatus"))


@add("returning_old", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    return returned(_few(spark, d).select("o_orderkey", "o_orderstatus"), "SET o_orderstatus = :s", "UPDATED_OLD", ["o_orderkey"], {":s": "F"})


_ACTIONS = "SELECT l_orderkey AS tx, l_orderkey + l_linenumber % 3 AS o_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'Delete' WHEN 1 THEN 'Put' WHEN 2 THEN 'Update' ELSE 'ConditionCheck' END AS kind, CAST(l_partkey AS DOUBLE) AS p, l_returnflag AS s FROM lineitem WHERE l_orderkey % 10 = 0"
_TRANSACTED = f"""WITH a AS ({_ACTIONS}), c AS (SELECT a.*, coalesce(o_totalprice > 20000, true) AS met FROM a LEFT JOIN orders USING (o_orderkey)),
good AS (SELECT tx FROM c GROUP BY tx HAVING bool_and(met) AND count(*) = count(DISTINCT o_orderkey)),
w AS (SELECT a.* FROM a SEMI JOIN good USING (tx) WHERE kind <> 'ConditionCheck')
SELECT o_orderkey, CASE kind WHEN 'Put' THEN w.p WHEN 'Update' THEN coalesce(w.p, o.o_totalprice) ELSE o.o_totalprice END AS o_totalprice, CASE kind WHEN 'Put' THEN w.s WHEN 'Update' THEN coalesce(w.s, o.o_orderstatus) ELSE o.o_orderstatus END AS o_orderstatus
FROM orders o FULL JOIN w USING (o_orderkey) WHERE kind IS DISTINCT FROM 'Delete'"""


@add("transact_write_items", _TRANSACTED)
def _(spark, d):
    """Orders 10 apart, so that two transactions don't meet on a key; actions on one key within one cancel it."""
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "Delete").when(n == 1, "Put").when(n == 2, "Update").otherwise("ConditionCheck")
    actions = table(spark, d, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("tx"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("o_orderkey"), kind.alias("kind"), F.col("l_partkey").cast("double").alias("o_totalprice"), F.col("l_returnflag").alias("o_orderstatus"))
    return write.transact_write(_few(spark, d), actions, "tx", ["o_orderkey"], "o_totalprice > :p OR attribute_not_exists(o_orderkey)", {":p": 20_000})


@add("batch_write_items", f"""WITH r AS (SELECT l_partkey % 100 AS batch, l_orderkey AS o_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_quantity FROM lineitem),
good AS (SELECT batch FROM r GROUP BY batch HAVING bool_and(l_partkey % 700 > 1)),
w AS (SELECT * FROM r SEMI JOIN good USING (batch) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) = 1)
SELECT o_orderkey, coalesce(w.l_extendedprice, o.o_totalprice) AS o_totalprice, coalesce(w.l_returnflag, o.o_orderstatus) AS o_orderstatus FROM ({_FEW}) o FULL JOIN w USING (o_orderkey) WHERE w.l_linenumber IS NULL OR w.l_linenumber <> 2""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    requests = lines.select((F.col("l_partkey") % 100).alias("batch"), F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.col("l_returnflag").alias("o_orderstatus"), F.when(F.col("l_linenumber") == 2, "D").otherwise("P").alias("op"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return write.batch_write(_few(spark, d), requests, "batch", ["o_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], F.col("l_partkey") % 700 > 1)


# PartiQL writes and their failures.
@add("partiql_insert", f"{_FEW} WHERE o_orderkey <> 7 UNION ALL SELECT 7, 1.5, 'N' UNION ALL SELECT -1, NULL, 'M'")
def _(spark, d):
    rows = _few(spark, d)
    for text in ("INSERT INTO orders VALUE {'o_orderkey': 7, 'o_totalprice': 1.5, 'o_orderstatus': 'N'}", "INSERT INTO orders VALUE {'o_orderkey': ?, 'o_orderstatus': 'M'}"):
        rows = partiql.written(rows, partiql.parse(text, [-1]), ["o_orderkey"])
    return rows


@add("partiql_update", "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 2.5 ELSE o_totalprice END AS o_totalprice, o_orderstatus, CASE WHEN o_orderkey = 7 THEN 'x' END AS note FROM orders UNION ALL SELECT -5, 2.5, NULL, 'x'")
def _(spark, d):
    rows = _few(spark, d)
    for where in ("o_orderkey = 7", "o_orderkey = -5", "o_orderkey = 32 AND o_orderstatus = 'nothing'"):
        rows = partiql.written(rows, partiql.parse(f"UPDATE orders SET o_totalprice = 2.5, note = 'x' WHERE {where}"), ["o_orderkey"])
    return rows


@add("partiql_delete", f"{_FEW} WHERE o_orderkey <> 7")
def _(spark, d):
    rows = _few(spark, d)
    for where in ("o_orderkey = 7", "o_orderkey = 5 AND o_totalprice < 0", "o_orderkey = -1"):
        rows = partiql.written(rows, partiql.parse(f"DELETE FROM orders WHERE {where}"), ["o_orderkey"])
    return rows


# Conditions in full: sets, missing paths, and texts that aren't conditions.
@add("scan_contains_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey <> 10")
def _(spark, d):
    r = Request(filter="contains(tags, :o) AND NOT contains(nums, :n) AND attribute_type(tags, :t)", values={":o": "O", ":n": 10, ":t": "SS"}, sets=frozenset({"tags", "nums"}), projection="o_orderkey")
    rows = _tagged_orders(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.array("o_custkey").alias("nums")), "o_orderkey")
    return scan(rows, ["o_orderkey"], r)


def _outcome(spark: SparkSession, d: str, text: str) -> str:
    try:
        n = scan(table(spark, d, "region"), ["r_regionkey"], Request(filter=text, values={":v": 1})).count()
    except ValidationError:
        return "ValidationException"
    return str(n)


_CONDITIONS = {"r_name": "0", "NOT r_regionkey": "5", "r_regionkey = :none": "0", "r_regionkey = ": "ValidationException", "(r_regionkey = :v": "ValidationException", "no.path[3].at = :v": "0", "attribute_not_exists(no.path[3])": "5"}


@add("condition_outcomes", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in _CONDITIONS.items()) + ") t(condition, outcome)")
def _(spark, d):
    return spark.createDataFrame([(c, _outcome(spark, d, c)) for c in _CONDITIONS], "condition string, outcome string")


@add("query_key_conditions", "SELECT * FROM events WHERE user_id = 8 AND event_id BETWEEN 100 AND 5000")
def _(spark, d):
    text, names, values = key_conditions({"user_id": ("EQ", [8]), "event_id": ("BETWEEN", [100, 5000])})
    return query(table(spark, d, "events"), ["user_id", "event_id"], text, Request(names=names, values=values))


@add("select_kinds", 'SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS "Count", 3 AS n_projected, 1 AS n_specific, 6 AS n_all')
def _(spark, d):
    orders, r = table(spark, d, "orders"), Request(filter="o_totalprice > :p", values={":p": 100_000})
    only = Request(projection="o_orderstatus")
    counts = [len(selected(orders, k, x, ["o_orderstatus", "o_orderdate", "o_custkey"]).columns) for k, x in (("ALL_PROJECTED_ATTRIBUTES", r), ("SPECIFIC_ATTRIBUTES", only), ("ALL_ATTRIBUTES", r))]
    return selected(orders, "COUNT", r).select("Count", *[F.lit(n).alias(name) for n, name in zip(counts, ("n_projected", "n_specific", "n_all"), strict=True)])


@add("page_chain", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 60 AS INTEGER) AS page FROM customer WHERE c_custkey <= 300")
def _(spark, d):
    """LastEvaluatedKey leads from page to page until none is left."""
    rows, out = table(spark, d, "customer").where("c_custkey <= 300"), None
    for n, (part, _key) in enumerate(pages(rows, ["c_custkey"], Request(limit=60))):
        part = part.select("c_custkey", F.lit(n).alias("page"))
        out = part if out is None else out.union(part)
    return out if out is not None else rows.select("c_custkey", F.lit(0).alias("page"))


# The feed of a table: events are writes of their user, one in seven a delete.
_EVENT_FEED = "(SELECT event_id AS seq, user_id, CASE WHEN event_id % 7 = 0 THEN 'REMOVE' WHEN old IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS event_name FROM (SELECT *, lag(CASE WHEN event_id % 7 <> 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) WHERE event_id % 7 <> 0 OR old IS NOT NULL)"


@add("stream_iterators", f"SELECT 'TRIM_HORIZON' AS kind, * FROM (SELECT * FROM {_EVENT_FEED} ORDER BY seq LIMIT 50) UNION ALL SELECT 'AFTER_SEQUENCE_NUMBER', * FROM (SELECT * FROM {_EVENT_FEED} WHERE seq > 500 ORDER BY seq LIMIT 1000) UNION ALL SELECT 'AT_SEQUENCE_NUMBER', * FROM (SELECT * FROM {_EVENT_FEED} WHERE seq >= 500 ORDER BY seq LIMIT 1000)")
def _(spark, d):
    events, out = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "value"), None
    feed = log.changes(events, ["user_id"], ["seq"], F.col("seq") % 7 == 0).select("seq", "user_id", "event_name")
    for kind, limit in (("TRIM_HORIZON", 50), ("LATEST", 1000), ("AFTER_SEQUENCE_NUMBER", 1000), ("AT_SEQUENCE_NUMBER", 1000)):
        part = log.records(feed, kind, 500, limit).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.union(part)
    return out


# Values and files.
_NUMBERS = {"1.0": "1", "+5": "5", "-0": "0", "1.50": "1.5", "007": "7", "1e2": "100", "1.5e-3": "0.0015", "x": "error", "12345678901234567890123456789012345678": "12345678901234567890123456789012345678"}


@add("canonical_numbers", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NUMBERS.items()) + ") t(given, number)")
def _(spark, d):
    lines = spark.createDataFrame([(x, f'{{"k":{{"S":"a"}},"n":{{"N":"{x}"}}}}') for x in _NUMBERS], "given string, value string")
    out = None
    for x in _NUMBERS:
        part = checked(lines.where(F.col("given") == x).select("value"), {"k": "S"}).select(F.lit(x).alias("given"), F.when(F.col("error").isNull(), F.get_json_object("value", "$.n.N")).otherwise("error").alias("number"))
        out = part if out is None else out.union(part)
    return out


@add("binary_base64", """SELECT doc_id, '{"b":{"B":"' || to_base64(encode(coalesce(lang, ''))) || '"},"doc_id":{"N":"' || doc_id || '"}}' AS value FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).cast("binary").alias("b"))
    return write_items(docs).select(F.get_json_object("value", "$.doc_id.N").cast("long").alias("doc_id"), "value")


@add("codec_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, [o_orderstatus, 'F'] AS tags, o_orderdate FROM orders")
def _(spark, d):
    """Through the table's own files: typed, compressed, with the range of each column."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.array("o_orderstatus", F.lit("F")).alias("tags"), "o_orderdate")
    return _written(orders, "codec")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@add("backup_restore", f"SELECT {_LINE_COLUMNS} FROM ({_LINES}) WHERE k = 1 AND l_returnflag <> 'R'")
def _(spark, d):
    """A snapshot of the current view, written; the log may go on, or go."""
    view = log.current(table(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", ")), LINE_KEYS, LINE_ORDER, F.col("l_returnflag") == "R")
    return _written(view, "backup")


# Requests that manage tables, streams, expiry, backups and replicas; the answers as rows.
def _told(name: str, script: Callable[[Service], list[str]], expected: list[str]) -> None:
    @add(name, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(expected)) + ") t(step, answer)")
    def _(spark, d):
        store = Service(spark, f"{shared_folder(spark)}/tessera/store-{uuid.uuid4().hex}")
        return spark.createDataFrame(list(enumerate(script(store))), "step int, answer string")


def _made(store: Service, name: str, **more) -> None:
    store.call("CreateTable", {"TableName": name, "KeySchema": [{"AttributeName": "pk", "KeyType": "HASH"}], "AttributeDefinitions": [{"AttributeName": "pk", "AttributeType": "S"}]} | more)


def _try(call: Callable[[], object]) -> str:
    try:
        return str(call())
    except ServiceError as e:
        return e.kind


def _tables(store: Service) -> list[str]:
    _made(store, "B")
    _made(store, "A")
    store.call("PutItem", {"TableName": "A", "Item": {"pk": {"S": "x"}}})
    out = [",".join(store.call("ListTables", {})["TableNames"]), _try(lambda: _made(store, "A"))]
    out.append(str(store.call("DescribeTable", {"TableName": "A"})["Table"]["ItemCount"]))
    store.call("UpdateTable", {"TableName": "A", "ProvisionedThroughput": {"ReadCapacityUnits": 7, "WriteCapacityUnits": 8}})
    out.append(str(store.call("DescribeTable", {"TableName": "A"})["Table"]["TableStatus"]))
    store.call("DeleteTable", {"TableName": "B"})
    return [*out, ",".join(store.call("ListTables", {})["TableNames"]), _try(lambda: store.call("DescribeTable", {"TableName": "B"}))]


_told("manage_tables", _tables, ["A,B", "ResourceInUseException", "1", "ACTIVE", "A", "ResourceNotFoundException"])


def _streams(store: Service) -> list[str]:
    _made(store, "T", StreamSpecification={"StreamEnabled": True, "StreamViewType": "NEW_AND_OLD_IMAGES"})
    for call, more in (("PutItem", {"Item": {"pk": {"S": "x"}, "v": {"N": "1"}}}), ("PutItem", {"Item": {"pk": {"S": "x"}, "v": {"N": "2"}}}), ("DeleteItem", {"Key": {"pk": {"S": "x"}}})):
        store.call(call, {"TableName": "T"} | more)
    arn = store.call("ListStreams", {})["Streams"][0]["StreamArn"]
    at = store.call("GetShardIterator", {"StreamArn": arn, "ShardIteratorType": "TRIM_HORIZON"})["ShardIterator"]
    latest = store.call("GetShardIterator", {"StreamArn": arn, "ShardIteratorType": "LATEST"})["ShardIterator"]
    got = store.call("GetRecords", {"ShardIterator": at, "Limit": 2})
    rest = store.call("GetRecords", {"ShardIterator": got["NextShardIterator"]})["Records"]
    status = store.call("DescribeStream", {"StreamArn": arn})["StreamDescription"]["StreamViewType"]
    return [status, ",".join(x["eventName"] for x in got["Records"]), ",".join(x["eventName"] for x in rest), str(len(store.call("GetRecords", {"ShardIterator": latest})["Records"]))]


_told("manage_streams", _streams, ["NEW_AND_OLD_IMAGES", "INSERT,MODIFY", "REMOVE", "0"])


def _expiry(store: Service) -> list[str]:
    _made(store, "T")
    out = [store.call("DescribeTimeToLive", {"TableName": "T"})["TimeToLiveDescription"]["TimeToLiveStatus"]]
    store.call("UpdateTimeToLive", {"TableName": "T", "TimeToLiveSpecification": {"Enabled": True, "AttributeName": "e"}})
    store.call("PutItem", {"TableName": "T", "Item": {"pk": {"S": "x"}, "e": {"N": "5"}}})
    return [*out, store.call("DescribeTimeToLive", {"TableName": "T"})["TimeToLiveDescription"]["TimeToLiveStatus"], str(store.call("GetItem", {"TableName": "T", "Key": {"pk": {"S": "x"}}}))]


_told("manage_expiry", _expiry, ["DISABLED", "ENABLED", "{}"])


def _backups(store: Service) -> list[str]:
    _made(store, "T")
    for x in "ab":
        store.call("PutItem", {"TableName": "T", "Item": {"pk": {"S": x}, "v": {"N": "1"}}})
    arn = store.call("CreateBackup", {"TableName": "T", "BackupName": "n"})["BackupDetails"]["BackupArn"]
    out = [str(store.call("DescribeBackup", {"BackupArn": arn})["BackupDescription"]["BackupDetails"]["BackupSizeBytes"])]
    store.call("DeleteTable", {"TableName": "T"})
    store.call("RestoreTableFromBackup", {"BackupArn": arn, "TargetTableName": "R"})
    out += [",".join(sorted(x["pk"]["S"] for x in store.call("Scan", {"TableName": "R"})["Items"])), str(len(store.call("ListBackups", {})["BackupSummaries"]))]
    store.call("DeleteBackup", {"BackupArn": arn})
    return [*out, str(len(store.call("ListBackups", {})["BackupSummaries"])), _try(lambda: store.call("DescribeBackup", {"BackupArn": arn}))]


_told("manage_backups", _backups, ["2048", "a,b", "1", "0", "BackupNotFoundException"])


def _statements(store: Service) -> list[str]:
    _made(store, "T")
    texts = ["INSERT INTO T VALUE {'pk': 'a', 'v': 1}", "UPDATE T SET v = 2 WHERE pk = 'a' AND v = 1", "UPDATE T SET v = 3 WHERE pk = 'a' AND v = 1", "SELECT v FROM T WHERE pk = 'a'", "DELETE FROM T WHERE pk = 'a'", "SELECT v FROM T", "SELECT"]
    answers = store.call("BatchExecuteStatement", {"Statements": [{"Statement": t} for t in texts]})["Responses"]
    return [x.get("Item", {}).get("v", {}).get("N", "") or x.get("Error", {}).get("Code", "") for x in answers]


_told("execute_statements", _statements, ["", "", "ConditionalCheckFailedException", "2", "", "", "ValidationException"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition in a span of its sort key, filtered and projected."""
    return query_sk_between(spark, sf_dir)
