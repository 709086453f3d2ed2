"""Specification queries, joins, queues and histories over the supplied tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import lifecycle, spec
from tessera.operators.spec import Specification
from tessera.plans.registry import query, table
from tessera.sources import vault, versions


@query("SELECT c_custkey, c_name, c_acctbal, total, total > 40 AS has_next FROM (SELECT *, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 20")
def spec_page(spark, d):
    s = Specification({"c_mktsegment": "BUILDING"}, ("-c_acctbal", "c_custkey"), page=2, page_size=20)
    return spec.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), s).drop("c_mktsegment")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def spec_count(spark, d):
    return spec.count(table(spark, d, "orders"), Specification({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}))


@query("SELECT count(*) > 0 AS found FROM part WHERE p_size = 50 AND p_brand = 'Brand#99'")
def spec_exists(spark, d):
    return spec.exists(table(spark, d, "part"), Specification({"p_size": 50, "p_brand": "Brand#99"}))


DELETED = "CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-01' END"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND {DELETED} IS NULL")
def spec_live_rows(spark, d):
    rows = table(spark, d, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 7 == 0, F.lit(datetime.datetime(2024, 1, 1))))
    return spec.select(rows, Specification({"c_nationkey": 3})).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def spec_with_deleted(spark, d):
    rows = table(spark, d, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 7 == 0, F.lit(datetime.datetime(2024, 1, 1))))
    return spec.select(rows, Specification({"c_nationkey": 3}, include_deleted=True)).select("c_custkey", "c_name")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return spec.get(table(spark, d, "orders"), "o_orderkey", 7)


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey + 1000 AS c_custkey, c_name FROM customer) n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.c_custkey)")
def insert_conflicts(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", "c_name")
    return spec.conflicts(stored.withColumn("c_custkey", F.col("c_custkey") + 1000), stored, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey + 1000 AS c_custkey, c_name FROM customer) n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.c_custkey)")
def validated_insert(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", "c_name")
    return spec.insertable(stored.withColumn("c_custkey", F.col("c_custkey") + 1000), stored, ["c_custkey"])


@query("""SELECT s.s_suppkey, CASE WHEN s.s_suppkey % 3 = 0 AND s.s_suppkey % 2 = 0 THEN 'new' ELSE s.s_name END AS s_name,
 s.s_suppkey % 2 + CASE WHEN s.s_suppkey % 3 = 0 AND s.s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS version,
 s.s_suppkey % 3 = 0 AND s.s_suppkey % 2 = 0 AS applied, s.s_suppkey % 3 = 0 AND s.s_suppkey % 2 <> 0 AS stale FROM supplier s""")
def optimistic_update(spark, d):
    stored = table(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 2).alias("version"))
    changes = stored.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(0).cast("long").alias("expected_version"), F.lit("new").alias("s_name"))
    return spec.update_versioned(stored, changes, "s_suppkey", ["s_name"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def alias_join(spark, d):
    of_asia = Specification({"r_name": "ASIA"}, ("n_name", "n_nationkey"))
    return spec.of_kind(table(spark, d, "nation"), table(spark, d, "region"), ("n_regionkey", "r_regionkey"), of_asia).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n.n_name END AS needle FROM customer LEFT JOIN nation n ON c_nationkey = n.n_nationkey AND c_custkey % 5 <> 0) JOIN nation ON nullif(needle, '') = n_name")
def alias_empty_needle(spark, d):
    """Needles are names of nations, some of them empty or null."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    asked = table(spark, d, "customer").join(names, (F.col("c_nationkey") == F.col("k")) & (F.col("c_custkey") % 5 != 0), "left")
    needles = asked.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("name")).alias("needle"))
    return spec.by_needle(table(spark, d, "nation"), "n_name", needles, "needle").select("c_custkey", "n_nationkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS ord FROM orders")
def children_in_order(spark, d):
    return spec.ranked(table(spark, d, "orders"), ["o_custkey"], "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "ord")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), []::BIGINT[]) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def parents_with_children(spark, d):
    out = spec.with_children(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderkey")
    return out.select("c_custkey", F.col("n_children").alias("n_orders"), F.col("children").alias("orders"))


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def sessions_with_results(spark, d):
    return spec.with_result(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def content_hash_lookup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    twice = rows.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")
    return spec.by_digest(rows, F.col("text"), twice).select("doc_id", "sha256")


@query("SELECT * FROM lineitem WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders) AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders))")
def two_key_lookup(spark, d):
    """The first line of the first order that has any: the keys are two values read from the tables."""
    lines = table(spark, d, "lineitem")
    order = table(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    line = spec.get(lines, "l_orderkey", order).agg(F.min("l_linenumber")).first()[0]
    return spec.select(lines, Specification({"l_orderkey": order, "l_linenumber": line})).where("l_orderkey is not null and l_linenumber is not null")


@query("SELECT user_id, count(*) AS downloads, max(ts) AS last_at FROM events WHERE event_type = 'click' GROUP BY user_id")
def download_counter(spark, d):
    return spec.counted(table(spark, d, "events").where("event_type = 'click'"), "user_id", "ts").withColumnRenamed("times", "downloads")


@query("SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return spec.latest(table(spark, d, "events"), ["user_id"], "ts", "event_type")


@query("SELECT o_custkey, count(*) + 1 AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark, d):
    versions = spec.ranked(table(spark, d, "orders"), ["o_custkey"], "o_orderkey")
    return spec.next_version(versions, ["o_custkey"], "ord").select("o_custkey", F.col("next_version").cast("long").alias("next_version"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'edited' END ELSE 'machine' END AS value FROM labels")
def effective_values(spark, d):
    user = F.when(F.col("quality") == 1, "edited")
    return table(spark, d, "labels").select("doc_id", spec.effective(F.col("toxic") == 1, user, F.lit("machine")).alias("value"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25")
def topk_claim(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE").alias("status"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"))
    return lifecycle.claim_next(jobs, F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp_ntz"), 25).select(F.col("id").alias("o_orderkey"), F.col("priority").alias("o_orderpriority"))


@query("SELECT event_id, least(greatest((value::INT) - 50, 0), 100) AS percent, left(repeat(event_type, 40), 150) AS message FROM events")
def progress_clamp(spark, d):
    e = table(spark, d, "events")
    c = lifecycle.clamp_progress(F.bround("value").cast("int") - 50, F.repeat("event_type", F.lit(40)))
    return e.select("event_id", c.alias("c")).select("event_id", "c.percent", "c.message")


@query("""WITH j AS (SELECT event_id, ts AS heartbeat_at, (event_id % 4)::INT AS attempt_count FROM events WHERE event_type = 'view')
SELECT CASE WHEN attempt_count >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS status, count(*) AS n FROM j WHERE heartbeat_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE GROUP BY 1""")
def stale_sweep(spark, d):
    jobs = table(spark, d, "events").where("event_type = 'view'").select("event_id", F.col("ts").cast("timestamp").alias("heartbeat_at"), (F.col("event_id") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), F.lit("RUNNING").alias("status"))
    return lifecycle.requeue_stale(jobs, F.lit("2024-01-15 00:00:00").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 AND event_id % 4 < 3 THEN 'QUEUED' WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
 CASE WHEN event_type = 'error' THEN 40 ELSE 100 END AS progress FROM events""")
def retry_outcome(spark, d):
    e = table(spark, d, "events").withColumns({"status": F.lit("RUNNING"), "progress": F.lit(40), "attempt_count": (F.col("event_id") % 4).cast("int"), "max_attempts": F.lit(3)})
    status = F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED")
    return lifecycle.finish(e, status, F.col("ts"), F.col("event_id") % 2 == 0).select("event_id", "status", "progress")


@query("""WITH parties AS (SELECT l_orderkey AS contract, l_suppkey AS supplier FROM lineitem)
SELECT contract, s_name, n_name FROM parties JOIN supplier ON supplier = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 10""")
def resolve_parties(spark, d):
    parties = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract"), "l_suppkey")
    some = F.broadcast(table(spark, d, "nation").where("n_nationkey < 10"))  # twenty-five rows
    out = spec.resolved_parties(parties, table(spark, d, "supplier"), ("l_suppkey", "s_suppkey"), some, ("s_nationkey", "n_nationkey"))
    return out.select("contract", "s_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def unresolved_parties(spark, d):
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return spec.unresolved_parties(asked, table(spark, d, "supplier").where("s_acctbal > 0"), ("l_suppkey", "s_suppkey"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS flags, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'True' ELSE 'False' END AS had_error, count(*)::VARCHAR AS n FROM events GROUP BY user_id")
def session_snapshot(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("flags"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"), F.count("*").alias("c"))
    return g.select("user_id", "flags", spec.as_text(F.col("e") > 0, "boolean").alias("had_error"), spec.as_text(F.col("c"), "long").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_size < 10 ORDER BY p_name, p_partkey LIMIT 20")
def reference_search(spark, d):
    p = table(spark, d, "part").where((F.col("p_size") < 10) & F.contains(F.lower("p_name"), F.lit("a")))
    return p.orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT p_partkey, concat_ws('-', substr(h,1,8), substr(h,9,4), '7'||substr(h,14,3), '8'||substr(h,18,3), substr(h,21,12)) AS id FROM (SELECT p_partkey, md5('part|' || p_partkey) AS h FROM part)")
def derived_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", spec.derived_id(F.lit("part"), F.col("p_partkey")).alias("id"))


STATUS = "CASE event_type WHEN 'signup' THEN 'DRAFT' WHEN 'view' THEN 'GENERATING' WHEN 'click' THEN 'COMPLETED' WHEN 'error' THEN 'GENERATION_FAILED' ELSE 'VOIDED' END"
_OK = ", ".join(f"'{a}>{b}'" for a, bs in lifecycle.CONTRACT.items() for b in bs)


def history(spark, d):
    e = F.col("event_type")
    status = F.when(e == "signup", "DRAFT").when(e == "view", "GENERATING").when(e == "click", "COMPLETED").when(e == "error", "GENERATION_FAILED").otherwise("VOIDED")
    return table(spark, d, "events").select("event_id", "user_id", "ts", status.alias("status"))


@query(f"SELECT event_id, user_id, was, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT event_id, user_id, ts, {STATUS} AS status FROM events)) WHERE was IS NOT NULL AND (was || '>' || status) NOT IN ({_OK})")
def illegal_transitions(spark, d):
    return lifecycle.illegal_transitions(history(spark, d), "user_id", lifecycle.CONTRACT, "ts", "event_id").select("event_id", "user_id", "was", "status")


@query(f"SELECT event_id, user_id, status FROM (SELECT *, max((status IN ('COMPLETED', 'VOIDED'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT event_id, user_id, ts, {STATUS} AS status FROM events)) WHERE e = 1")
def steps_after_the_end(spark, d):
    return lifecycle.after_terminal(history(spark, d), "user_id", ("COMPLETED", "VOIDED"), "ts", "event_id").select("event_id", "user_id", "status")


@query(f"SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT event_id, user_id, ts, {STATUS} AS status FROM events) WHERE status = 'VOIDED') WHERE nth > 1")
def once_only_violations(spark, d):
    return lifecycle.more_than_once(history(spark, d), "user_id", "VOIDED", "ts", "event_id").select("event_id", "nth")


@query(f"SELECT event_id, status NOT IN ('VOIDED', 'SUPERSEDED') AND length(trim(props)) >= 10 AS voidable, status = 'COMPLETED' AS supersedable, status IN ('COMPLETED', 'SUPERSEDED', 'VOIDED') AS locked FROM (SELECT event_id, props, {STATUS} AS status FROM events)")
def state_guards(spark, d):
    h = history(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")
    s = F.col("status")
    return h.select("event_id", lifecycle.can_void(s, F.col("props")).alias("voidable"), lifecycle.can_supersede(s).alias("supersedable"), lifecycle.is_locked(s).alias("locked"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true ELSE false END AND o_orderkey % 3 <> 0 AS usable,
 CASE WHEN o_orderkey % 4 IN (0, 1, 2) THEN o_orderdate::DATE END AS ended_on, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 'FRONT' END ELSE 'BACK' END AS side FROM orders""")
def states_of_records(spark, d):
    k = F.col("o_orderkey")
    archived = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    state = F.when(k % 3 == 0, "INVALID").otherwise("VALID")
    status = F.when(k % 4 == 0, "COMPLETED").when(k % 4 == 1, "COMPLETED_WITH_WARNINGS").when(k % 4 == 2, "FAILED").otherwise("EXTRACTING")
    side = lifecycle.resolved_side(F.when(k % 5 != 0, "BACK"), F.when(k % 7 != 0, "FRONT"))
    return table(spark, d, "orders").select("o_orderkey", lifecycle.is_usable(archived, state).alias("usable"), lifecycle.completed_at(status, F.col("o_orderdate").cast("date")).alias("ended_on"), side.alias("side"))


@query("SELECT o_custkey, o_orderkey, 100 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders")
def sequence_numbers(spark, d):
    return lifecycle.sequence_numbers(table(spark, d, "orders"), ["o_custkey"], F.lit(100), "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "sequence")


@query("""SELECT a.doc_id AS front, b.doc_id AS back, a.lang AS front_type FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang WHERE a.doc_id % 5 <> 0 AND b.doc_id % 5 <> 0""")
def session_inputs(spark, d):
    images = table(spark, d, "documents").select(F.col("doc_id").alias("image"), F.col("lang").alias("type"), F.when(F.col("doc_id") % 5 == 0, F.lit(1)).alias("purged_at"))
    pairs = images.select(F.col("image").alias("front"), (F.col("image") + 1).alias("back"))
    return lifecycle.session_inputs(pairs, images).select("front", "back", "front_type")


@query("SELECT doc_id AS session, quality AS field FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id AND x.n_chars % 2 = l.quality)")
def foreign_corrections(spark, d):
    fields = table(spark, d, "documents").select(F.col("doc_id").alias("session"), (F.col("n_chars") % 2).cast("int").alias("field"))
    return lifecycle.foreign_corrections(table(spark, d, "labels").select(F.col("doc_id").alias("session"), F.col("quality").alias("field")), fields)


@query("SELECT o_custkey AS session, bool_and(o_totalprice >= 1000) AS confirmable FROM orders GROUP BY 1")
def confirmable_sessions(spark, d):
    return lifecycle.confirmable(table(spark, d, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_totalprice") < 1000).alias("needs_review")))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 100 ELSE 0 END AS percent FROM events")
def session_progress(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").select("event_id", lifecycle.progress(F.when(e == "view", "EXTRACTING").when(e == "click", "COMPLETED").otherwise("UNKNOWN")).alias("percent"))


@query("SELECT coalesce(f.doc_id, r.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'ROW_WITHOUT_FILE' ELSE 'FILE_WITHOUT_ROW' END AS kind FROM documents f FULL JOIN (SELECT doc_id + 100 AS doc_id FROM labels) r ON f.doc_id = r.doc_id WHERE f.doc_id IS NULL OR r.doc_id IS NULL")
def orphan_sweep(spark, d):
    return vault.orphans(table(spark, d, "documents"), table(spark, d, "labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id")


@query("SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL 14 DAY GROUP BY ALL")
def retention_purge(spark, d):
    old = table(spark, d, "events").where(F.col("ts") < F.expr("timestamp_ntz'2024-01-30 00:00:00' - interval 14 days"))
    return old.groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, sum(toxic) AS corrected, sum(toxic)::DOUBLE / count(*) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source, lang")
def accuracy_report(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return j.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("corrected"), (F.sum("toxic") / F.count("*")).alias("rate"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS period, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def dashboard_summary(spark, d):
    return table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("period"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, count(*) AS n, grouping(event_type) + 0 AS g FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type), ())")
def extension_grouping_sets(spark, d):
    return table(spark, d, "events").rollup("event_type", "user_id").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' ELSE c_address END AS c_address, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 1 END AS change
 FROM (SELECT *, c_name AS c_address FROM customer) WHERE c_mktsegment = 'BUILDING' OR c_acctbal >= 0""")
def stored_customers(spark, d):
    """All customers stored, those in debt deleted, those of one segment stored anew, then compacted: what the store has."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_name").alias("c_address"))
    store = versions.scratch(spark, "c_custkey")
    store.insert(c.select("c_custkey", "c_address", F.lit(1).alias("change")))
    store.delete(c.where("c_acctbal < 0"))
    store.upsert(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("moved").alias("c_address"), F.lit(3).alias("change")))
    store.compact()
    store.vacuum()
    return store.read()
