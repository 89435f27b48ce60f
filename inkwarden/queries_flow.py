"""More of the operators as queries: timers, listings, running totals, limits and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, closure, ordered, registry, trust
from .operators.catalogue import HASHES, Catalogue
from .operators.deltas import Deltas, Table
from .queries import query, table
from .sources.listing import Listing
from .sources.scratch import shared_folder
from .streaming import timers
from .streaming.watched import WatchedTree

# ---- streams -----------------------------------------------------------------------------------

DEBOUNCE, RETRY = 2 * 3_600_000, 3 * 3_600_000


@query(f"""
WITH RECURSIVE e AS (
  SELECT '/in/user/' || user_id AS path, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AS cancel,
         CASE WHEN event_type = 'error' THEN 'SCAN_UNAVAILABLE' WHEN value >= 150 THEN 'INPUT_SIZE_LIMIT' END AS error,
         CASE WHEN event_type <> 'error' AND value < 150 THEN sha256(event_type) END AS sha256,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
n AS (SELECT *, lead(ms) OVER p AS next_ms, coalesce(lead(cancel) OVER p, false) AS next_cancel FROM e WINDOW p AS (PARTITION BY path ORDER BY rn)),
s AS (
  SELECT path, rn, CASE WHEN NOT cancel THEN ms + {DEBOUNCE} END AS due, 1::BIGINT AS changes, cancel::BIGINT AS generation FROM n WHERE rn = 1
  UNION ALL
  SELECT n.path, n.rn, CASE WHEN n.cancel THEN NULL WHEN s.due > n.ms THEN s.due ELSE n.ms + {DEBOUNCE} END,
         CASE WHEN s.due > n.ms THEN s.changes + 1 ELSE 1 END, s.generation + n.cancel::BIGINT
  FROM s JOIN n ON n.path = s.path AND n.rn = s.rn + 1),
w AS (SELECT n.*, due, changes, generation, (SELECT max(ms) FROM e) AS mark FROM s JOIN n USING (path, rn) WHERE due IS NOT NULL),
c AS (SELECT path, 'CANCELLED' AS action, next_ms AS at_ms, sha256, error, generation, changes FROM w WHERE next_cancel AND next_ms < due),
d AS (SELECT *, lag(error) OVER p AS last_error, lag(sha256) OVER p AS last_sha256 FROM w WHERE coalesce(next_ms >= due, true) AND due < mark WINDOW p AS (PARTITION BY path ORDER BY rn))
SELECT * FROM c
UNION ALL SELECT path, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN last_error IS NULL AND last_sha256 = sha256 THEN 'SKIP' ELSE 'SCAN' END, due, sha256, error, generation, changes FROM d
UNION ALL SELECT path, 'RETRY', due + {RETRY}, sha256, error, generation, 0 FROM d WHERE error = 'SCAN_UNAVAILABLE' AND coalesce(next_ms >= due + {RETRY}, true) AND due + {RETRY} < mark""")
def timed_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a path for each user: inspected two hours after the first, tried again three hours after a failure, cancelled by a sign-up."""
    top = shared_folder(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    error = F.when(F.col("event_type") == "error", "SCAN_UNAVAILABLE").when(F.col("value") >= 150, "INPUT_SIZE_LIMIT")
    changes = stream.select(
        F.concat(F.lit("/in/user/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("cancel"), F.when(error.isNull(), F.sha2("event_type", 256)).alias("sha256"), error.alias("error"),
    )
    timers.run(changes, f"{top}/out", f"{top}/state", "context", debounce=DEBOUNCE, retry=RETRY)
    return spark.read.parquet(f"{top}/out").select("path", "action", F.unix_millis("at").alias("at_ms"), "sha256", "error", "generation", "changes")


@query("""
SELECT 'folder=' || hex(coalesce(source, '')) || '/part=' || (doc_id // 5000) AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS length,
       sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS sha256, NULL::VARCHAR AS error, 1::BIGINT AS walk FROM documents GROUP BY 1""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, then taken by runs of a listing, a pass each, until the walk is complete; a pass has a quarter of the bytes."""
    top = shared_folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.hex(F.coalesce("source", F.lit(""))).alias("folder"), F.expr("doc_id div 5000").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    total = rows.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    rows.repartition("folder", "part").sortWithinPartitions("folder", "part", "doc_id").select("folder", "part", "value").write.partitionBy("folder", "part").text(f"{top}/in")
    spark.dataSource.register(Listing)
    stream = spark.readStream.format("listing").options(path=f"{top}/in", cursor=f"{top}/cursor", bytes=max(1, total // 4)).load()

    def write(batch: DataFrame, number: int) -> None:
        found = batch.select(F.regexp_extract("path", "(folder=[^/]*/part=[^/]*)/[^/]*$", 1).alias("folder"), "length", F.sha2("content", 256).alias("sha256"), "error", "walk", "status")
        found.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    done = False
    while not done:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"{top}/out")
        done = not out.filter("status = 'COMPLETE'").isEmpty()
    return out.select("folder", "length", "sha256", "error", "walk")


@query("""
WITH f AS (SELECT hex(coalesce(source, '')) AS folder, doc_id // 5000 AS part, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n FROM documents GROUP BY ALL),
g AS (SELECT * FROM f WHERE folder <> (SELECT min(folder) FROM f) UNION ALL SELECT 'late', doc_id // 5000, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT 1::BIGINT AS walk, count(*) AS files, count(*) AS scanned, 0::BIGINT AS unchanged, 0::BIGINT AS failed, 0::BIGINT AS removed, sum(n)::BIGINT AS bytes FROM f
UNION ALL SELECT 2, count(*), count(*) FILTER (folder = 'late'), count(*) FILTER (folder <> 'late'), 0, (SELECT count(*) FROM f WHERE folder = (SELECT min(folder) FROM f)), sum(n)::BIGINT FROM g""")
def watched_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, walked twice in passes of a quarter of the bytes; between the walks a source's files go and others come."""
    top = shared_folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.hex(F.coalesce("source", F.lit(""))).alias("folder"), F.expr("doc_id div 5000").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    size, first = rows.agg(F.sum(F.octet_length("value") + 1), F.min("folder")).first()

    def put(some: DataFrame, mode: str) -> None:
        some.repartition("folder", "part").sortWithinPartitions("folder", "part", "doc_id").select("folder", "part", "value").write.mode(mode).partitionBy("folder", "part").text(f"{top}/in")

    put(rows, "overwrite")
    tree = WatchedTree(spark, f"{top}/in", f"{top}/watched", most_bytes=max(1, (size or 0) // 4))
    for walk in (1, 2):
        if walk == 2:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/in/folder={first}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            put(rows.filter("doc_id % 2 = 0").withColumn("folder", F.lit("late")), "append")
        while tree.run() != "COMPLETE":
            pass
    return tree.passes().groupBy("walk").agg(*[F.sum(c).cast("long").alias(c) for c in ("files", "scanned", "unchanged", "failed", "removed", "bytes")])


# ---- orders ------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
t AS (SELECT 'source ' || coalesce(source, '') AS scope, 50000 AS most, doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM d
      UNION ALL SELECT 'all', 1000000, doc_id, sum(n) OVER (ORDER BY doc_id) FROM d)
SELECT scope, count(*) FILTER (total <= most) AS rows, coalesce(max(total) FILTER (total <= most), 0)::BIGINT AS bytes, min(doc_id) FILTER (total > most) AS over_doc_id FROM t GROUP BY scope""")
def byte_budget_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are taken until a budget of bytes is spent, for each source and over all, and the row that would go beyond."""
    docs = table(spark, sf_dir, "documents")
    length = F.octet_length(F.coalesce("text", F.lit("")))
    each = ordered.aborted(docs.select("source", "doc_id", "text"), ["source"], ["doc_id"], length, 50_000).select(F.concat(F.lit("source "), F.coalesce("source", F.lit(""))).alias("scope"), "rows", "bytes", "over_doc_id")
    every = ordered.aborted(docs.select("doc_id", "text"), [], ["doc_id"], length, 1_000_000).select(F.lit("all").alias("scope"), "rows", "bytes", "over_doc_id")
    return each.unionByName(every)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
s AS (
  SELECT user_id, event_id, rn, true AS accepted, [us] AS times FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, len(t) < 5, CASE WHEN len(t) < 5 THEN list_append(t, us) ELSE t END
  FROM (SELECT e.user_id, e.event_id, e.rn, e.us, list_filter(s.times, lambda x: x >= e.us - 86400000000) AS t FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT user_id, event_id, accepted FROM s""")
def rate_limit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five accepted calls a day and user; refused calls don't count."""
    return audit.accepted_calls(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"], 5, 86_400).select("user_id", "event_id", "accepted")


@query("SELECT quantile_disc(n_chars::DOUBLE, 0.5) AS p50, quantile_disc(n_chars::DOUBLE, 0.95) AS p95, quantile_disc(n_chars::DOUBLE, 0.999) AS p999, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most FROM documents")
def text_size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"p50": 0.5, "p95": 0.95, "p999": 0.999, "least": 0.0, "most": 1.0}
    return ordered.as_row(spark, ordered.percentiles(table(spark, sf_dir, "documents"), "n_chars", shares))


_LEVEL = "CASE WHEN n <= 64 THEN 0 WHEN n <= 64 * 16 THEN 1 WHEN n <= 64 * 256 THEN 2 WHEN n <= 64 * 4096 THEN 3 ELSE 4 END"
_UP = " ".join(
    f", u{k} AS (SELECT source, n, left(pre, {k}) AS pre, sha256(string_agg(substr(pre, {k + 1}, 1) || x, chr(10) ORDER BY pre)) AS x FROM v{k + 1} WHERE length(pre) = {k + 1} GROUP BY ALL), v{k} AS (SELECT * FROM u{k} UNION ALL SELECT * FROM v{k + 1} WHERE length(pre) <= {k})"
    for k in range(3, -1, -1)
)


@query(f"""
WITH h AS (SELECT source, sha256(doc_id || ' ' || sha256(text)) AS h FROM documents),
c AS (SELECT source, count(*) AS n FROM h GROUP BY source),
v4 AS (SELECT h.source, n, left(h, {_LEVEL}) AS pre, sha256(string_agg(h, chr(10) ORDER BY h)) AS x FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source GROUP BY ALL){_UP}
SELECT source, n AS entries, x AS root FROM v0""")
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle root of each source's documents."""
    return registry.manifest_tree(table(spark, sf_dir, "documents"), ["source"], F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2("text", 256)))


# ---- stores ------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('changed ' || text) ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version
FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0""")
def delta_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored, every third changed, every fifth deleted and some of those put back, compacted between: four commits and what is left."""
    store = Deltas(spark, shared_folder(spark), {"texts": Table("doc_id long, sha256 string, version long", ("doc_id",), True)})
    docs = table(spark, sf_dir, "documents")
    new, third = F.sha2("text", 256), F.pmod("doc_id", F.lit(3)) == 0
    rows = docs.select("doc_id", new.alias("sha256"), F.lit(1).alias("version"))
    changed = docs.select("doc_id", F.when(third, F.sha2(F.concat(F.lit("changed "), "text"), 256)).otherwise(new).alias("sha256"), F.when(third, 2).otherwise(1).alias("version"))
    store.commit({"texts": rows})
    store.commit({"texts": changed.filter(third)})
    store.compact()
    store.commit({"texts": changed.filter("doc_id % 5 = 0").withColumn("_gone", F.lit(True))})
    store.commit({"texts": changed.filter("doc_id % 35 = 0")})
    return store.read("texts")


@query("""WITH d AS (SELECT doc_id AS id, sha256(text) AS sha256, doc_id % 2 AS batch FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY batch, id) AS k FROM d)
SELECT id, sha256 FROM f WHERE k = 1""")
def content_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of even documents, of odd ones, and of all once more: each content has the one that came first."""
    store = registry.ContentStore(spark, shared_folder(spark), "id long, sha256 string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    for batch in (docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1"), docs):
        store.append(batch)
    return store.reports()


@query("""WITH s AS (SELECT count(DISTINCT source) AS n FROM documents)
SELECT doc_id::VARCHAR AS component_id, CASE WHEN doc_id % 3 = 0 THEN 'REAPPROVAL_REQUIRED' ELSE 'BLOCKED' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'REQUIRE_REAPPROVAL' ELSE 'BLOCK' END AS action, NULL::VARCHAR AS approval_id,
       2 AS policy_version, (1 + n % 50)::INT AS flag_score, 2::BIGINT AS told, 0::BIGINT AS violations FROM documents, s""")
def policy_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components for documents, a third of them approved; two policies, the second with a score from the table. Version, demotions and event are one commit."""
    catalogue = Catalogue(spark, shared_folder(spark))
    docs = table(spark, sf_dir, "documents")
    approved = F.pmod("doc_id", F.lit(3)) == 0
    none, n = F.lit(None).cast("string"), F.col("doc_id").cast("string")
    rows = docs.select(
        n.alias("component_id"), n.alias("name"), F.lit("server").alias("kind"), F.concat(F.lit("/c/"), n).alias("source_path"), *[F.sha2("text", 256).alias(h) for h in HASHES], none.alias("content"),
        F.when(approved, "APPROVED").otherwise("BLOCKED").alias("state"), F.lit(1).alias("version"), F.lit(True).alias("source_valid"), F.when(approved, "ALLOW").otherwise("BLOCK").alias("action"), F.when(approved, n).alias("approval_id"),
    )
    catalogue.new_policy({}, "first")
    at = catalogue.head()
    catalogue.store.commit({"state": rows}, at)
    sources = docs.select(F.count_distinct("source")).first()[0]
    catalogue.new_policy({"scan_flag_score": 1 + sources % 50}, "second")
    last = trust.current_policy(catalogue.policies()).select(F.col("version").alias("policy_version"), F.get_json_object("policy", "$.scan_flag_score").cast("int").alias("flag_score"))
    told = catalogue.events().filter("event_type = 'POLICY_CHANGED'").agg(F.count("*").alias("told"))
    wrong = catalogue.policy_violations().agg(F.count("*").alias("violations"))
    # One row each.
    return catalogue.current().select("component_id", "state", "action", "approval_id").join(F.broadcast(last)).join(F.broadcast(told)).join(F.broadcast(wrong))


# ---- packages ----------------------------------------------------------------------------------


@query("""WITH RECURSIVE w AS (SELECT doc_id AS package, ('w' || k) AS part, k, len(ws) AS n, doc_id % 4 AS kind FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents), (SELECT unnest(range(6)) AS k) WHERE k < len(ws)),
e AS (SELECT package, part AS source, 'w' || (k + 1) AS target FROM w WHERE NOT (kind = 1 AND k = 2) AND k + 1 < least(6, n) + CASE WHEN kind = 2 THEN 1 ELSE 0 END UNION SELECT package, part, 'w0' FROM w WHERE kind = 3),
r AS (SELECT package, part FROM w WHERE k = 0 UNION SELECT e.package, e.target FROM r JOIN e ON e.package = r.package AND e.source = r.part),
d AS (SELECT package, 1 AS missing, 0 AS unreferenced FROM (SELECT * FROM r EXCEPT SELECT package, part FROM w) UNION ALL SELECT package, 0, 1 FROM (SELECT package, part FROM w EXCEPT SELECT * FROM r))
SELECT p.package, CASE WHEN count(d.package) = 0 THEN 'VALID' ELSE 'INVALID' END AS status, coalesce(sum(missing), 0)::BIGINT AS missing, coalesce(sum(unreferenced), 0)::BIGINT AS unreferenced FROM (SELECT DISTINCT package FROM w) p LEFT JOIN d USING (package) GROUP BY p.package""")
def package_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packages whose first words refer to each other in a row: some rows are broken, some lead beyond what is there, some go round."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("package"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"), F.pmod("doc_id", F.lit(4)).alias("kind"))
    words = docs.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(6), F.col("n")) - 1)).alias("k"))
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    parts = words.select("package", name(F.col("k")).alias("part"))
    beyond = F.least(F.lit(6), F.col("n")) + F.when(F.col("kind") == 2, 1).otherwise(0)
    on = words.filter(~((F.col("kind") == 1) & (F.col("k") == 2)) & (F.col("k") + 1 < beyond)).select("package", name(F.col("k")).alias("source"), name(F.col("k") + 1).alias("target"))
    back = words.filter("kind = 3").select("package", name(F.col("k")).alias("source"), F.lit("w0").alias("target"))
    return closure.closed(parts, on.unionByName(back), parts.filter("part = 'w0'"))
