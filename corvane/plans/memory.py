"""Bi-temporal memory, usage and source-version ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ledger, lexical, temporal
from corvane.plans.registry import ASSERTIONS, query
from corvane.sources import model

VALID, KNOWN = "2024-01-20 00:00:00", "2024-01-21 00:00:00"

#: Relations: each assertion supersedes its predecessor with the same subject and kind; a few correct, retract, contradict or reinforce others.
REL = f"""{ASSERTIONS}, prev AS (SELECT *, lag(assertion_id) OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, assertion_id) AS target_assertion_id FROM asr),
 rel AS (SELECT assertion_id AS relation_id, target_assertion_id, CASE assertion_id % 5 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'corrects' WHEN 2 THEN 'retracts' WHEN 3 THEN 'contradicts' ELSE 'reinforces' END AS relation_type,
  valid_from AS effective_at, recorded_at FROM prev WHERE target_assertion_id IS NOT NULL)"""
KINDS = ("supersedes", "corrects", "retracts", "contradicts", "reinforces")


def times(spark, sf_dir) -> tuple[str, str]:
    """A valid time in the middle of the events, and a known time a day after it."""
    r = model.table(spark, sf_dir, "events").select(F.expr("timestampadd(SECOND, CAST(timestampdiff(SECOND, min(ts), max(ts)) / 2 AS INT), min(ts))").alias("m")).first()["m"]
    import datetime as dt

    mid = r.replace(hour=0, minute=0, second=0, microsecond=0)
    return str(mid), str(mid + dt.timedelta(days=1))


MID = "mid AS (SELECT date_trunc('day', CAST(min(ts) AS TIMESTAMP) + to_seconds(CAST(floor(date_diff('second', CAST(min(ts) AS TIMESTAMP), CAST(max(ts) AS TIMESTAMP)) / 2) AS BIGINT))) AS valid_at FROM events), tm AS (SELECT valid_at, valid_at + to_days(1) AS known_at FROM mid)"
STATE = f"""WITH {REL}, {MID}, seen AS (SELECT a.* FROM asr a, tm WHERE a.recorded_at <= known_at), cnt AS (SELECT r.* FROM rel r, tm WHERE r.recorded_at <= known_at AND r.effective_at <= valid_at),
 inv AS (SELECT *, row_number() OVER (PARTITION BY target_assertion_id ORDER BY effective_at, recorded_at, relation_id) AS n FROM cnt WHERE relation_type IN ('supersedes', 'corrects', 'retracts')),
 con AS (SELECT target_assertion_id, count(*) FILTER (relation_type = 'contradicts') AS contradictions, count(*) FILTER (relation_type = 'reinforces') AS reinforcements FROM cnt GROUP BY ALL),
 st AS (SELECT s.assertion_id, s.subject_id, s.predicate, s.confidence, s.importance, s.valid_from, CASE WHEN s.valid_from > valid_at THEN 'FUTURE' WHEN i.relation_type = 'supersedes' THEN 'SUPERSEDED' WHEN i.relation_type = 'corrects' THEN 'CORRECTED'
   WHEN i.relation_type = 'retracts' THEN 'RETRACTED' WHEN c.contradictions > 0 THEN 'CONTESTED' ELSE 'ACTIVE' END AS lifecycle, i.effective_at AS ended, coalesce(c.contradictions, 0) AS contradictions, coalesce(c.reinforcements, 0) AS reinforcements
  FROM seen s CROSS JOIN tm LEFT JOIN inv i ON i.target_assertion_id = s.assertion_id AND i.n = 1 LEFT JOIN con c ON c.target_assertion_id = s.assertion_id)"""


def relations(spark, sf_dir) -> DataFrame:
    return temporal.succession(model.assertions(spark, sf_dir), ["subject_id", "predicate"]).withColumn("relation_type", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("relation_id") % 5 + 1).cast("int")))


def states(spark, sf_dir) -> DataFrame:
    valid, known = times(spark, sf_dir)
    return temporal.resolve(model.assertions(spark, sf_dir), relations(spark, sf_dir), valid, known)


@query(STATE + " SELECT assertion_id, lifecycle, CASE WHEN lifecycle <> 'FUTURE' THEN ended END AS valid_to, contradictions, reinforcements FROM st")
def temporal_state_asof(spark, sf_dir):
    return states(spark, sf_dir).select("assertion_id", "lifecycle", F.col("valid_to").cast("timestamp_ntz").alias("valid_to"), "contradictions", "reinforcements")


@query(STATE.replace("valid_at + to_days(1) AS known_at", "valid_at - to_days(1) AS known_at") + " SELECT lifecycle, count(*) AS n FROM st GROUP BY lifecycle")
def temporal_known_before(spark, sf_dir):
    """The same valid time, known two days earlier: late records are not seen."""
    import datetime as dt

    valid, _ = times(spark, sf_dir)
    known = str(dt.datetime.fromisoformat(valid) - dt.timedelta(days=1))
    return temporal.resolve(model.assertions(spark, sf_dir), relations(spark, sf_dir), valid, known).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REL}, r AS (SELECT *, row_number() OVER (PARTITION BY target_assertion_id ORDER BY effective_at, recorded_at, relation_id) AS n FROM rel WHERE relation_type IN ('supersedes', 'corrects', 'retracts') QUALIFY n = 1)
 SELECT target_assertion_id, relation_id, relation_type FROM r""")
def lifecycle_invalidation(spark, sf_dir):
    """The relation that ends each assertion: earliest in force, then recorded, then by id."""
    r = relations(spark, sf_dir).where(F.col("relation_type").isin("supersedes", "corrects", "retracts"))
    best = r.groupBy("target_assertion_id").agg(F.min(F.struct("effective_at", "recorded_at", "relation_id", "relation_type")).alias("b"))
    return best.select("target_assertion_id", "b.relation_id", "b.relation_type")


USAGE = """use AS (SELECT event_id % 1000 AS assertion_id, CASE event_type WHEN 'purchase' THEN 'successful' WHEN 'error' THEN 'rejected' ELSE 'selected' END AS outcome, CAST(ts AS TIMESTAMP) AS used_at FROM events),
 us AS (SELECT assertion_id, count(*) AS uses, count(*) FILTER (outcome = 'successful') AS successful, count(*) FILTER (outcome = 'rejected') AS rejected, max(used_at) AS last_used FROM use GROUP BY 1)"""


def usages(spark, sf_dir) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "successful").when(F.col("event_type") == "error", "rejected").otherwise("selected")
    e = model.table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("assertion_id"), outcome.alias("outcome"), F.col("ts").alias("at"))
    return temporal.usage(model.assertions(spark, sf_dir).select("assertion_id"), e)


@query(f"WITH {USAGE} SELECT event_id AS assertion_id, coalesce(uses, 0) AS uses, coalesce(successful, 0) AS successful, coalesce(rejected, 0) AS rejected, last_used FROM events e LEFT JOIN us ON us.assertion_id = e.event_id")
def usage_stats(spark, sf_dir):
    return usages(spark, sf_dir)


FORCE = "least(greatest((coalesce(successful, 0) + greatest(coalesce(uses, 0) - coalesce(successful, 0) - coalesce(rejected, 0), 0) * 0.25 + reinforcements) / greatest(coalesce(uses, 0) + reinforcements, 1)::DOUBLE * least(ln(1 + coalesce(uses, 0) + reinforcements) / ln(11.0), 1.0), 0.0), 1.0)"
SEARCH = STATE + f""", {USAGE}, lex AS (SELECT assertion_id, row_number() OVER (ORDER BY value DESC, assertion_id) AS lex_rank FROM asr WHERE predicate = 'purchase' QUALIFY lex_rank <= 160),
 s AS (SELECT st.assertion_id, lifecycle, valid_from, round(CASE lifecycle WHEN 'CONTESTED' THEN 0.82 WHEN 'ACTIVE' THEN 1.0 ELSE 0.94 END * (0.15 * coalesce(1.0::DOUBLE / lex_rank, 0) + 0.10 * confidence + 0.08 * importance + 0.05 * {FORCE}
  + 0.02 / (1.0 + greatest(date_diff('microsecond', valid_from, valid_at) / 86400000000.0::DOUBLE, 0.0) / 365.0)), 6) AS score
 FROM st CROSS JOIN tm LEFT JOIN us USING (assertion_id) LEFT JOIN lex USING (assertion_id) WHERE KEEP) SELECT assertion_id, lifecycle, score FROM s ORDER BY score DESC, valid_from DESC, assertion_id LIMIT 20"""


def _search(spark, sf_dir, mode):
    valid, _ = times(spark, sf_dir)
    ranked = lexical.top(model.assertions(spark, sf_dir).where("predicate = 'purchase'").withColumn("all", F.lit(1)), 160, "value", "assertion_id", by="all").select("assertion_id", F.col("rank").alias("lex_rank"))
    return temporal.searched(states(spark, sf_dir), usages(spark, sf_dir), ranked, None, valid, mode, 20).select("assertion_id", "lifecycle", "score")


@query(SEARCH.replace("KEEP", "lifecycle IN ('ACTIVE', 'CONTESTED')"))
def temporal_search(spark, sf_dir):
    return _search(spark, sf_dir, "latest_valid")


@query(SEARCH.replace("KEEP", "lifecycle <> 'FUTURE'"))
def temporal_search_historical(spark, sf_dir):
    return _search(spark, sf_dir, "historical")


@query(STATE + " SELECT subject_id, predicate, count(*) FILTER (lifecycle IN ('ACTIVE', 'CONTESTED')) AS current, count(*) AS known FROM st GROUP BY subject_id, predicate")
def current_projection(spark, sf_dir):
    s = states(spark, sf_dir)
    return s.groupBy("subject_id", "predicate").agg(F.count_if(F.col("lifecycle").isin("ACTIVE", "CONTESTED")).alias("current"), F.count(F.lit(1)).alias("known"))


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id) ORDER BY conv_id, turn LIMIT 100")
def pending_events(spark, sf_dir):
    runs = model.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"))
    return temporal.pending(model.table(spark, sf_dir, "conversations"), runs, "conv_id").select("conv_id", "turn").orderBy("conv_id", "turn").limit(100)


@query("SELECT event_id AS proposal_id, event_type AS predicate FROM events WHERE event_id < 3000")
def apply_idempotent(spark, sf_dir):
    """A ledger of 2000 with overlapping proposals applied twice."""
    e = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("proposal_id"), F.col("event_type").alias("predicate"))
    more = e.where("proposal_id >= 1500 AND proposal_id < 3000")
    return temporal.applied(temporal.applied(e.where("proposal_id < 2000"), more), more)


@query(f"""WITH {ASSERTIONS}, r AS (SELECT event_id AS relation_id, event_id AS source_assertion_id, CASE WHEN event_id % 50 = 0 THEN event_id WHEN event_id % 70 = 0 THEN -1 ELSE event_id - 1 END AS target_assertion_id FROM events)
 SELECT relation_id, CASE WHEN source_assertion_id = target_assertion_id THEN 'self' WHEN t.subject_id IS NULL THEN 'unknown target' WHEN s.subject_id IS NULL THEN 'unknown source' WHEN s.subject_id <> t.subject_id THEN 'other subject' END AS issue
 FROM r LEFT JOIN asr t ON t.assertion_id = target_assertion_id LEFT JOIN asr s ON s.assertion_id = source_assertion_id WHERE issue IS NOT NULL""")
def relation_violations(spark, sf_dir):
    i = F.col("event_id")
    r = model.table(spark, sf_dir, "events").select(i.alias("relation_id"), i.alias("source_assertion_id"), F.when(i % 50 == 0, i).when(i % 70 == 0, F.lit(-1)).otherwise(i - 1).alias("target_assertion_id"))
    return temporal.violations(r, model.assertions(spark, sf_dir))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def embeddings_by_dimension(spark, sf_dir):
    return model.vectors(spark, sf_dir).where(F.size("v") == 64).select("vec_id")


# -- source versions: an asset is a user, a version each of its distinct (kind, hour) contents in order of first appearance

VER = """ev AS (SELECT user_id AS asset_id, event_type || ':' || CAST(event_id % 40 AS VARCHAR) AS fingerprint, min(event_id) AS first_seen FROM events WHERE event_id < 5000 GROUP BY 1, 2),
 hist AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY first_seen) AS version_number FROM ev)"""


def history(spark, sf_dir) -> DataFrame:
    print_ = F.concat_ws(":", "event_type", (F.col("event_id") % 40).cast("string"))
    e = model.table(spark, sf_dir, "events").where("event_id < 5000").groupBy(F.col("user_id").alias("asset_id"), print_.alias("fingerprint")).agg(F.min("event_id").alias("first_seen"))
    return ledger.numbered(e, "asset_id", F.col("first_seen"))


@query(f"WITH {VER} SELECT asset_id, fingerprint, version_number FROM hist")
def version_ledger(spark, sf_dir):
    return history(spark, sf_dir).select("asset_id", "fingerprint", "version_number")


@query(f"WITH {VER} SELECT asset_id, fingerprint, version_number FROM hist QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY version_number DESC) = 1")
def active_versions(spark, sf_dir):
    return ledger.latest(history(spark, sf_dir)).select("asset_id", "fingerprint", "version_number")


@query(f"WITH {VER} SELECT c.c_custkey AS asset_id, coalesce(max(version_number), 0) + 1 AS next_number FROM customer c LEFT JOIN hist h ON h.asset_id = c.c_custkey GROUP BY 1")
def next_version_number(spark, sf_dir):
    assets = model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"))
    return ledger.next_numbers(history(spark, sf_dir), assets)


@query(f"""WITH {VER}, inc AS (SELECT user_id AS asset_id, event_type || ':' || CAST(event_id % 40 AS VARCHAR) AS fingerprint FROM events WHERE event_id >= 4000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id) = 1),
 act AS (SELECT asset_id, arg_max(fingerprint, version_number) AS active, max(version_number) AS top FROM hist GROUP BY 1), same AS (SELECT asset_id, fingerprint, max(version_number) AS v FROM hist GROUP BY 1, 2)
 SELECT i.asset_id, i.fingerprint, CASE WHEN active = i.fingerprint THEN 'unchanged' WHEN v IS NOT NULL THEN 'reused' ELSE 'new' END AS outcome, coalesce(v, coalesce(top, 0) + 1) AS version_number
 FROM inc i LEFT JOIN act USING (asset_id) LEFT JOIN same s ON s.asset_id = i.asset_id AND s.fingerprint = i.fingerprint""")
def incremental_publish(spark, sf_dir):
    from pyspark.sql import Window as W

    e = model.table(spark, sf_dir, "events").where("event_id >= 4000").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("event_id") % 97, "event_id"))).where("n = 1")
    incoming = e.select(F.col("user_id").alias("asset_id"), F.concat_ws(":", "event_type", (F.col("event_id") % 40).cast("string")).alias("fingerprint"))
    return ledger.published(history(spark, sf_dir), incoming)


@query("SELECT doc_id, 'stale' AS problem FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def rebuild_reconciliation(spark, sf_dir):
    active = model.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    return ledger.reconciled(active, model.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT doc_id, quality AS mark FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_documents(spark, sf_dir):
    old = model.table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("mark"))
    return ledger.upserted(old, model.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("mark")), "doc_id")


@query("""SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash, min(doc_id) AS canonical, count(*) AS copies, array_to_string(list_sort(list_distinct(list(doc_id))), ',') AS aliases
  FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    d = ledger.deduplicated(model.table(spark, sf_dir, "documents"), "text", "doc_id").where("copies > 1")
    return d.select("content_hash", "canonical", "copies", F.array_join(F.transform("aliases", lambda x: x.cast("string")), ",").alias("aliases"))


@query(f"""WITH {VER}, act AS (SELECT asset_id, fingerprint, version_number FROM hist QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY version_number DESC) = 1), src AS (SELECT fingerprint, min(asset_id) AS asset_id FROM act GROUP BY 1)
  SELECT s.fingerprint, s.asset_id, count(*) AS events FROM src s JOIN events e ON e.user_id = s.asset_id AND e.event_type = split_part(s.fingerprint, ':', 1) WHERE e.event_id < 5000 GROUP BY ALL""")
def active_projection(spark, sf_dir):
    """Events of the active version of each content; a content shared by assets counts for the smallest."""
    act = ledger.latest(history(spark, sf_dir))
    src = act.groupBy("fingerprint").agg(F.min("asset_id").alias("asset_id"))
    e = model.table(spark, sf_dir, "events").where("event_id < 5000").select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("kind"))
    return src.withColumn("kind", F.substring_index("fingerprint", ":", 1)).join(e, ["asset_id", "kind"]).groupBy("fingerprint", "asset_id").agg(F.count(F.lit(1)).alias("events"))


@query(f"""SELECT doc_id, 'evt_' || substr(sha256('documents' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || source), 1, 24) AS event_key, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash FROM documents""")
def stable_ids(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", T.stable_id("evt", F.lit("documents"), F.col("doc_id"), F.col("source")).alias("event_key"), T.content_hash(F.col("text")).alias("content_hash"))
