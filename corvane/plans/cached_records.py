"""Queries on cached model records: bodies made from the documents, with a fault in most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import cached_records as c
from corvane.plans import adapters as a
from corvane.plans.registry import query

EQUAL = ("run_id", "sample_id", "input_sha256", "cache_identity")
#: The fault of a record is its document's number modulo this; the last two have none.
FAULTS = 23


def _made(sha: str) -> dict[str, str]:
    """SQL of the columns of a record, from doc_id, lang, clean (the text's plain letters), word (its first), quoted (as JSON) and digest.

    Both engines read it; sha is a SQL function of theirs with {} for its text.
    """
    f = f"(doc_id % {FAULTS})"
    number = "CAST(doc_id % 4 AS STRING)"
    raw = lambda i: f"'r{i} ' || clean"
    tried = lambda i, n=None: f"""'{{"raw_response":"' || {raw(i)} || '","error":null, "attempt":{n or i}}}'"""
    plain = lambda i: f"""'{{"attempt":{i},"error":null,"raw_response":"' || {raw(i)} || '"}}'"""
    chain = "''"
    chains = [chain]
    for i in (1, 2, 3):
        chain = sha.format(plain(1)) if i == 1 else sha.format(f"{chain} || {plain(i)}")
        chains.append(chain)
    pick = lambda values: "CASE doc_id % 4 " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"
    swap = f"CASE WHEN {f} = 6 THEN {tried(1, 2)} ELSE {tried(1)} END"
    history = pick(["''", swap, f"{swap} || ',' || {tried(2)}", f"{swap} || ', ' || {tried(2)} || ',' || {tried(3)}"])
    category = f"CASE WHEN {f} = 10 THEN '\"PIT\",\"PIT\"' WHEN {f} = 11 THEN '\"SKY\"' WHEN lang = 'en' OR {f} = 19 THEN '\"GROUND\"' WHEN lang = 'de' THEN '\"PIT\"' ELSE '' END"
    state = f"CASE WHEN {f} = 14 THEN 'explicitly_safe' WHEN {f} = 15 THEN 'hazard_described' WHEN {f} = 16 THEN 'ambiguous' WHEN word IS NULL THEN 'no_extractable_hazard' ELSE 'hazard_described' END"
    one = f"""'{{"object_id":"o1","name":"' || CASE WHEN {f} = 9 THEN '  ' ELSE word END || '","categories":[' || {category} || '],"category_status":"' || CASE WHEN {f} = 19 THEN 'uncertain' WHEN lang IN ('en', 'de') THEN 'resolved' ELSE 'missing' END
        || '","text_evidence":"' || CASE WHEN {f} = 12 THEN word || '#' || word ELSE word END || '","visual_evidence":"","review_status":"none"}}'"""
    objects = f"CASE WHEN {f} = 8 THEN '{{}}' WHEN word IS NULL OR {f} = 15 THEN '[]' WHEN {f} = 13 THEN '[' || {one} || ', ' || {one} || ']' ELSE '[' || {one} || ']' END"
    identity = sha.format("""'{"input_sha256":"' || digest || '","job":"reference","model":"m1"}'""")
    body = f"""'{{"status":"' || CASE WHEN {f} = 16 THEN 'failed' ELSE 'ok' END || '","scene_text_state":"' || {state} || '","scope_uncertain":' || CASE WHEN {f} = 17 THEN '"no"' WHEN {f} = 16 THEN 'true' ELSE 'false' END
        || ',"run_id":"run-' || CASE WHEN {f} = 2 THEN 'x' ELSE '1' END || '","sample_id":"' || CAST(doc_id AS STRING) || '","input_sha256":"' || CASE WHEN {f} = 3 THEN {sha.format("digest")} ELSE digest END || '","cache_identity":"' || {identity}
        || '","raw_text":' || quoted || ',"attempts":' || CASE WHEN {f} = 4 THEN 'true' WHEN {f} = 5 THEN '9' ELSE {number} END || ',"attempt_history":[' || {history} || '],"raw_response":"' || CASE WHEN {f} = 7 THEN 'other' ELSE {pick(["''", raw(1), raw(2), raw(3)])} END
        || '","chain_sha256":"' || CASE WHEN {f} = 18 THEN 'none' ELSE {pick(chains)} END || '","objects":' || {objects} || ',"error":null' || CASE WHEN {f} = 20 THEN ',"generation_empty":false' ELSE '' END || ',"human_review_status":"none","agent_review_status":"none"}}'"""
    return {"identity": identity, "body": f"CASE WHEN {f} = 0 THEN '[1]' WHEN {f} = 1 THEN '{{\"status\":' ELSE {body} END"}


def _sql() -> str:
    made = _made("sha256({})")
    kind = lambda p, o="b": f"json_type({o}, '$.{p}')"
    text = lambda p, o="b": f"CASE WHEN json_type({o}, '$.{p}') = 'VARCHAR' THEN json_extract_string({o}, '$.{p}') END"
    whole = lambda p, o="b": f"CASE WHEN json_type({o}, '$.{p}') IN ('UBIGINT', 'BIGINT') THEN json_extract({o}, '$.{p}')::BIGINT END"
    some = lambda check: f"len(list_filter(objects, lambda o: coalesce({check}, true))) > 0"
    cats = "CASE WHEN json_type(o, '$.categories') = 'ARRAY' THEN json_extract_string(o, '$.categories[*]') END"
    status = text("category_status", "o")
    faults = {c: f"(json_extract_string(b, '$.{c}') IS DISTINCT FROM {v})" for c, v in zip(EQUAL, ("'run-1'", "doc_id::VARCHAR", "digest", "identity"), strict=True)}
    faults |= {
        "status": f"NOT {text('status')} IN ('ok', 'review_required', 'failed')", "state": f"NOT state IN ('hazard_described', 'explicitly_safe', 'no_extractable_hazard', 'ambiguous')", "scope_uncertain": f"{kind('scope_uncertain')} <> 'BOOLEAN'",
        "attempts": "NOT n BETWEEN 0 AND 3", "attempt_history": "NOT (len(history) = n AND list_transform(history, lambda h: json_extract(h, '$.attempt')::BIGINT) = range(1, n + 1))",
        "chain_sha256": f"NOT {text('chain_sha256')} = list_reduce(list_prepend('', list_transform(history, lambda h: '{{\"attempt\":' || json_extract(h, '$.attempt')::VARCHAR || ',\"error\":' || json_extract(h, '$.error')::VARCHAR || ',\"raw_response\":' || json_extract(h, '$.raw_response')::VARCHAR || '}}')), lambda x, y: sha256(x || y))",
        "raw_response": f"NOT CASE WHEN n > 0 THEN {text('raw_response')} = json_extract_string(history[-1], '$.raw_response') ELSE {text('raw_response')} = '' END",
        "error": f"coalesce({kind('error')}, 'NULL') NOT IN ('NULL', 'VARCHAR')", "objects": "objects IS NULL",
    }
    of_objects = {
        "object_incomplete": some("json_type(o) <> 'OBJECT' OR len(list_filter(['categories', 'category_status', 'text_evidence', 'visual_evidence', 'review_status'], lambda p: coalesce(json_type(o, '$.' || p), 'NULL') = 'NULL')) > 0"),
        "object_id": some(f"coalesce({text('object_id', 'o')}, '') = ''"), "object_name": some(f"trim(coalesce({text('name', 'o')}, '')) = ''"),
        "object_categories": some(f"len(list_distinct({cats})) <> len({cats}) OR NOT list_has_all(['GROUND', 'PIT', 'OVERHEAD'], {cats})"), "object_category_status": some(f"NOT {status} IN ('resolved', 'missing', 'uncertain')"),
        "object_resolved_empty": some(f"{status} = 'resolved' AND len({cats}) = 0"), "object_unresolved_filled": some(f"{status} <> 'resolved' AND len({cats}) > 0"),
        "object_evidence": some(f"trim({text('text_evidence', 'o')}) = '' OR NOT contains(text, {text('text_evidence', 'o')})"),
        "object_id_repeated": f"len(list_distinct(list_transform(objects, lambda o: {text('object_id', 'o')}))) < len(objects)",
        "object_repeated": f"len(list_distinct(list_transform(objects, lambda o: lower(trim({text('name', 'o')})) || chr(1) || {text('text_evidence', 'o')}))) < len(objects)",
    }
    optional = {
        "safe_with_objects": "len(objects) > 0 AND state IN ('explicitly_safe', 'no_extractable_hazard')", "hazard_without_objects": "len(objects) = 0 AND state = 'hazard_described'",
        "failed_not_open": f"{text('status')} = 'failed' AND NOT coalesce(state = 'ambiguous' AND json_extract(b, '$.scope_uncertain')::VARCHAR = 'true', false)", "failed_without_error": f"{text('status')} = 'failed' AND coalesce({text('error')}, '') = ''",
        "generation_empty": "coalesce(json_extract(b, '$.generation_empty')::VARCHAR NOT IN ('true', 'null'), false)",
    }
    faults = {n: f"coalesce({x}, true)" for n, x in faults.items()} | {n: f"coalesce(({x}) AND objects IS NOT NULL, false)" for n, x in of_objects.items()} | {n: f"coalesce({x}, false)" for n, x in optional.items()}
    faults |= {f: f"coalesce({kind(f)} <> 'VARCHAR', true)" for f in ("human_review_status", "agent_review_status")}
    listed = ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in faults.items())
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g') AS clean, nullif(regexp_extract(coalesce(text, ''), '[A-Za-z]{{3,}}'), '') AS word, to_json(coalesce(text, ''))::VARCHAR AS quoted, sha256(coalesce(text, '')) AS digest FROM documents),
made AS (SELECT doc_id, text, digest, {made['identity']} AS identity, {made['body']} AS body FROM d),
read AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM made),
parts AS (SELECT *, CASE WHEN {kind('objects')} = 'ARRAY' THEN json_extract(b, '$.objects[*]') END AS objects, json_extract(b, '$.attempt_history[*]') AS history, {whole('attempts')} AS n, {text('scene_text_state')} AS state FROM read)
SELECT doc_id, CASE WHEN coalesce(json_type(b), '') = 'OBJECT' THEN array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') ELSE 'not_an_object' END AS violations FROM parts"""


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records (doc_id, body) and the samples that they answer."""
    text = F.coalesce("text", F.lit(""))
    docs = a.table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))
    made = _made("sha2({}, 256)")
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    rows = docs.withColumns({"clean": F.regexp_replace("text", "[^A-Za-z0-9]+", " "), "word": F.when(word != "", word), "quoted": quoted, "digest": F.sha2("text", 256)})
    samples = docs.withColumn("input_sha256", F.sha2("text", 256)).select("doc_id", F.col("text").alias("raw_text"), F.lit("run-1").alias("run_id"), F.col("doc_id").cast("string").alias("sample_id"), "input_sha256", c.identity_digest(input_sha256=F.col("input_sha256"), job=F.lit("reference"), model=F.lit("m1")).alias("cache_identity"))
    return rows.select("doc_id", F.expr(made["body"]).alias("body")), samples


@query(_sql())
def cached_record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.record_violations(*records(spark, sf_dir), "doc_id", equal=EQUAL)
    return found.select("doc_id", F.array_join("violations", ",").alias("violations"))


_LOGS_SQL = """log AS (SELECT conv_id, turn, to_json({'role': role, 'said': {'z': turn, 'a': role}, 'extra': turn % 7}) AS body FROM conversations),
record AS (SELECT conv_id, turn, to_json({'said': {'a': CASE WHEN turn % 5 = 4 THEN 'x' ELSE role END, 'z': turn}, 'role': CASE WHEN turn % 3 = 2 THEN upper(role) ELSE role END}) AS body FROM conversations WHERE conv_id % 11 <> 3)"""


@query(rf"""WITH {_LOGS_SQL}
SELECT l.conv_id * 1000 + l.turn AS entry, count(*) AS n, any_value(CASE WHEN r.body IS NULL THEN 'record' ELSE concat_ws(',', CASE WHEN json_extract_string(l.body, '$.role') <> json_extract_string(r.body, '$.role') THEN 'role' END,
  CASE WHEN json_extract_string(l.body, '$.said.a') <> json_extract_string(r.body, '$.said.a') OR json_extract(l.body, '$.said.z') <> json_extract(r.body, '$.said.z') THEN 'said' END) END) AS violations
FROM log l LEFT JOIN record r USING (conv_id, turn) GROUP BY 1""")
def cached_log_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.table(spark, sf_dir, "conversations").withColumn("entry", F.col("conv_id") * 1000 + F.col("turn"))
    said = lambda role, first: F.struct(*(x for x in ([F.col("turn").alias("z"), role.alias("a")] if first else [role.alias("a"), F.col("turn").alias("z")])))
    logs = own.select("entry", F.to_json(F.struct("role", said(F.col("role"), True).alias("said"), (F.col("turn") % 7).alias("extra"))).alias("body"))
    other = F.when(F.col("turn") % 5 == 4, "x").otherwise(F.col("role"))
    kept = own.where("conv_id % 11 <> 3").select("entry", F.to_json(F.struct(said(other, False).alias("said"), F.when(F.col("turn") % 3 == 2, F.upper("role")).otherwise(F.col("role")).alias("role"))).alias("body"))
    found = c.log_violations(logs, kept, "entry", ("role", "said"))
    return found.groupBy("entry").agg(F.count("*").alias("n"), F.first(F.array_join("violations", ",")).alias("violations"))


# Metrics of a part's size, price and number; some are out of range, of another type, or missing.
_METRICS = """'{"near_fraction":' || CAST(p_size AS STRING) || 'e-3,"near_concentration":' || CASE WHEN p_size % 5 = 0 THEN '0.9' WHEN p_size = 49 THEN '1.2' ELSE '0.5' END || ',"sky_fraction":' || CASE WHEN p_size = 48 THEN '"0.5"' WHEN p_size % 3 = 0 THEN '0' ELSE '0.25' END
|| ',"near_candidate":' || CASE WHEN p_size = 47 THEN '1' ELSE 'true' END || CASE WHEN p_size = 46 THEN '' ELSE ',"depth_rgb_edge_correlation":' || CASE WHEN p_size = 45 THEN '-2' WHEN p_size % 2 = 0 THEN '-0.5' ELSE '0.5' END END || '}'"""
_PAYLOAD = f"""'{{"reasons":' || CASE WHEN p_partkey % 4 = 0 THEN '[{{"message":"m","code":"sky_missing"}}]' WHEN p_partkey % 41 = 0 THEN '[{{"code":"other","message":"m"}}]' ELSE '[]' END || ',"metrics":' || {_METRICS} || ',"status":"' || CASE WHEN p_partkey % 4 = 0 THEN 'rejected' WHEN p_partkey % 43 = 0 THEN 'unknown' ELSE 'passed' END || '"' || CASE WHEN p_partkey % 47 = 0 THEN ',"more":1' ELSE '' END || '}}'"""
_NUMBER = lambda name: f"CASE WHEN json_type(b, '$.metrics.{name}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(b, '$.metrics.{name}')::DOUBLE END"


@query(f"""WITH p AS (SELECT p_partkey, ({_PAYLOAD})::JSON AS b FROM part), m AS (SELECT *, {_NUMBER('near_fraction')} AS nf, {_NUMBER('near_concentration')} AS nc, {_NUMBER('sky_fraction')} AS sf, {_NUMBER('depth_rgb_edge_correlation')} AS ec, json_extract_string(b, '$.reasons[*].code') AS codes FROM p),
c AS (SELECT *, concat_ws(',', CASE WHEN len(json_keys(b)) <> 3 OR len(json_keys(b, '$.metrics')) <> 5 THEN 'fields' END, CASE WHEN json_extract_string(b, '$.status') NOT IN ('passed', 'warning', 'rejected') THEN 'status' END, CASE WHEN NOT list_has_all(['near_artifact', 'sky_missing'], codes) THEN 'reasons' END,
 CASE WHEN json_type(b, '$.metrics.near_candidate') <> 'BOOLEAN' THEN 'near_candidate' END, CASE WHEN NOT coalesce(nf BETWEEN 0 AND 1, false) THEN 'near_fraction' END, CASE WHEN NOT coalesce(nc BETWEEN 0 AND 1, false) THEN 'near_concentration' END, CASE WHEN NOT coalesce(sf BETWEEN 0 AND 1, false) THEN 'sky_fraction' END, CASE WHEN NOT coalesce(ec BETWEEN -1 AND 1, false) THEN 'depth_rgb_edge_correlation' END) AS problems,
 concat_ws(',', CASE WHEN nf > 0 AND nf <= 0.02 AND nc >= 0.8 AND ec < 0.1 THEN 'near_artifact' END, CASE WHEN sf < 0.01 THEN 'sky_missing' END) AS now FROM m)
SELECT p_partkey, problems, CASE WHEN problems = '' THEN CASE WHEN now = '' THEN 'passed' ELSE 'rejected' END END AS status, CASE WHEN problems = '' THEN now END AS reasons, CASE WHEN problems = '' THEN (now = '') <> (json_extract_string(b, '$.status') = 'passed') OR now <> array_to_string(codes, ',') END AS stale FROM c""")
def revalidated_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = a.table(spark, sf_dir, "part").select("p_partkey", F.expr(_PAYLOAD).alias("body"))
    found = c.revalidated_quality(payloads, "p_partkey", "body", most_near=0.02)
    return found.withColumns({"problems": F.array_join("problems", ","), "reasons": F.array_join("reasons", ",")})
