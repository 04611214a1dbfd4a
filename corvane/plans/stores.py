"""Queries on stores of a pipeline: cached arrays, and nested values before they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.redaction import redacted_frame
from corvane.plans import adapters as a
from corvane.plans.registry import query
from corvane.sources.array_cache import npy_bytes, read_arrays

_FAULT = "(doc_id % 13)"


def _manifest(sha: str) -> str:
    """SQL, for both engines, of an entry's manifest from doc_id, n (bytes of its text), print, and the digests of its arrays."""
    shape = f"'[1,' || CAST(CASE WHEN {_FAULT} = 5 THEN n + 1 ELSE n END AS STRING) || ']'"
    name = f"CASE WHEN {_FAULT} = 8 THEN '9x' WHEN {_FAULT} = 9 THEN 'textual' ELSE 'text' END"
    checksum = sha.format("'flags:' || flags_digest || chr(10) || 'text:' || text_digest")
    return f"""'{{"schema_version":1,"sample_id":"d' || CAST(doc_id AS STRING) || '","stage":"mask","kind":"' || CASE WHEN {_FAULT} = 1 THEN 'json' ELSE 'npz' END || '","fingerprint":"' || CASE WHEN {_FAULT} = 2 THEN 'old' ELSE print END || '","array_sha256":"' || {checksum}
        || '","arrays":{{"flags":{{"shape":[2,2],"dtype":"bool","ndim":2}},"' || {name} || '":{{"ndim":2,"dtype":"' || CASE WHEN {_FAULT} = 4 THEN 'int64' ELSE 'uint8' END || '","shape":' || {shape} || '}}}},"metadata":{{}}' || CASE WHEN {_FAULT} = 7 THEN ',"more":1' ELSE '' END || '}}'"""


def cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wanted entries, manifests and arrays: the bytes of each document and four flags, with a fault in most entries."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    docs = a.table(spark, sf_dir, "documents").select("doc_id", data.alias("raw"), F.octet_length(data).cast("bigint").alias("n"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"))
    one = F.lit(1).cast("bigint")
    fault, flags = F.col("doc_id") % 13, F.concat(*[F.unhex(F.when(F.col("doc_id") % (2 << bit) >= (1 << bit), "01").otherwise("00")) for bit in range(4)])
    docs = docs.withColumns({"text": npy_bytes("uint8", F.array(one, F.col("n")), F.col("raw")), "flags": npy_bytes("bool", F.array(2 * one, 2 * one), flags)})
    docs = docs.withColumn("text", F.when(fault == 10, F.concat(F.unhex(F.lit("94")), F.expr("substring(text, 2)"))).otherwise(F.col("text")))
    docs = docs.withColumns({"print": F.sha2("raw", 256), "text_digest": F.sha2("text", 256), "flags_digest": F.sha2("flags", 256)})
    manifests = docs.where("doc_id % 13 <> 0").select("sample_id", F.lit("mask").alias("stage"), F.expr(_manifest("sha2({}, 256)")).alias("body"))
    kept = docs.where("doc_id % 13 <> 6").withColumn("text", F.when(fault == 3, F.concat("text", F.unhex(F.lit("00")))).otherwise(F.col("text")))
    arrays = kept.select("sample_id", F.lit("mask").alias("stage"), F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("data")) for x in ("text", "flags")])))
    return docs.select("sample_id", F.lit("mask").alias("stage"), F.col("print").alias("fingerprint")), manifests, arrays


def _npy(kind: str, shape: str, values: str) -> str:
    text = f"""rpad('{{''descr'': ''{kind}'', ''fortran_order'': False, ''shape'': (' || {shape} || '), }}', 117, ' ') || chr(10)"""
    return f"unhex('934E554D505901007600') || encode({text}) || {values}"


def _cache_sql() -> str:
    flags = " || ".join(f"unhex(CASE WHEN doc_id % {2 << bit} >= {1 << bit} THEN '01' ELSE '00' END)" for bit in range(4))
    size = "list_product(shape) * CASE dtype WHEN 'float32' THEN 4 ELSE 1 END"
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, strlen(coalesce(text, '')) AS n, 'd' || doc_id AS sample_id FROM documents),
b AS (SELECT *, {_npy("|u1", "'1, ' || n", "raw")} AS text0, {_npy("|b1", "'2, 2'", flags)} AS flags, sha256(raw) AS print FROM d),
e AS (SELECT *, CASE WHEN {_FAULT} = 10 THEN unhex('94' || substr(hex(text0), 3)) ELSE text0 END AS text FROM b),
m AS (SELECT *, sha256(text) AS text_digest, sha256(flags) AS flags_digest FROM e), made AS (SELECT *, ({_manifest("sha256({})")})::JSON AS body FROM m WHERE {_FAULT} <> 0),
stored AS (SELECT sample_id, unnest(['flags', 'text']) AS name, unnest([flags, CASE WHEN {_FAULT} = 3 THEN text || unhex('00') ELSE text END]) AS data FROM m WHERE {_FAULT} <> 6),
head AS (SELECT *, hex(data) AS h, decode(unhex(substr(hex(data), 21, 2 * ('0x' || substr(hex(data), 19, 2) || substr(hex(data), 17, 2))::INT))) AS header FROM stored),
found AS (SELECT sample_id, name, sha256(data) AS digest, octet_length(data) AS size, h[:16] = '934E554D50590100' AS npy, CASE regexp_extract(header, '''descr'': ''([^'']*)''', 1) WHEN '|u1' THEN 'uint8' WHEN '|b1' THEN 'bool' WHEN '<f4' THEN 'float32' END AS dtype,
  regexp_extract_all(regexp_extract(header, 'shape'': .([0-9, ]*)', 1), '[0-9]+')::BIGINT[] AS shape, 10 + strlen(header) AS start FROM head),
listed AS (SELECT sample_id, unnest(json_keys(body, '$.arrays')) AS name, body FROM made),
said AS (SELECT sample_id, name, json_extract_string(body, '$.arrays."' || name || '".dtype') AS dtype, (json_extract(body, '$.arrays."' || name || '".shape'))::BIGINT[] AS shape, (json_extract(body, '$.arrays."' || name || '".ndim'))::INT AS ndim FROM listed),
sound AS (SELECT sample_id, bool_and(regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]*') AND ndim IN (2, 3) AND len(shape) = ndim AND list_min(shape) > 0 AND dtype IN ('bool', 'uint8', 'float32') AND list_product(shape) <= 100000000) AS fine FROM said GROUP BY 1),
whole AS (SELECT sample_id, sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name)) AS checksum, list(name ORDER BY name) AS names, sum(size)::BIGINT AS bytes FROM found GROUP BY 1),
fit AS (SELECT f.sample_id, bool_and(coalesce(f.npy AND f.dtype = s.dtype AND f.shape = s.shape AND f.size - f.start = list_product(s.shape) * CASE s.dtype WHEN 'float32' THEN 4 ELSE 1 END, false)) AS fits FROM found f LEFT JOIN said s USING (sample_id, name) GROUP BY 1),
names AS (SELECT sample_id, list(name ORDER BY name) AS names FROM said GROUP BY 1),
judged AS (SELECT d.sample_id, bytes, CASE WHEN body IS NULL THEN 'miss absent' WHEN json_extract_string(body, '$.kind') = 'json' THEN 'miss other_kind' WHEN checksum IS NULL THEN 'damaged no_arrays' WHEN json_extract_string(body, '$.fingerprint') <> m.print THEN 'miss stale'
  WHEN len(json_keys(body)) <> 8 THEN 'damaged manifest' WHEN json_extract_string(body, '$.array_sha256') <> checksum THEN 'damaged checksum' WHEN NOT fine THEN 'damaged descriptors' WHEN names.names <> whole.names THEN 'damaged names' WHEN NOT fits THEN 'damaged arrays' ELSE 'hit ' END AS v
  FROM d JOIN m USING (sample_id) LEFT JOIN made USING (sample_id) LEFT JOIN whole USING (sample_id) LEFT JOIN sound USING (sample_id) LEFT JOIN fit USING (sample_id) LEFT JOIN names USING (sample_id))
SELECT sample_id, split_part(v, ' ', 1) AS outcome, split_part(v, ' ', 2) AS reason, CASE WHEN v = 'hit ' THEN bytes END AS bytes FROM judged"""


@query(_cache_sql())
def array_cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_arrays(*cache(spark, sf_dir))
    size = F.aggregate("arrays", F.lit(0).cast("bigint"), lambda total, x: total + F.octet_length(x["data"]))
    return found.select("sample_id", "outcome", "reason", size.alias("bytes"))


_SAID = "CASE turn % 4 WHEN 1 THEN text || ' sk-' || role || CAST(conv_id AS STRING) || '_x y' WHEN 2 THEN 'see DATA : image/png ; charset=x; base64, AAAA ' || text ELSE 'ask-me ' || text END"
_CLEAN = r"regexp_replace({}, '(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]+', '\1[REDACTED]', 'g')"


@query(rf"""WITH t AS (SELECT conv_id, turn, role, {_SAID} AS said FROM conversations), c AS (SELECT *, CASE WHEN turn % 4 = 2 THEN '[REDACTED_BASE64_IMAGE]' ELSE {_CLEAN.format('said')} END AS body FROM t)
SELECT conv_id, turn, role, body, '[REDACTED]' AS api_key, {_CLEAN.format("role || ' sk-' || role")} AS note, CASE WHEN turn % 2 = 0 THEN 'Api-Key=[REDACTED];note=x' ELSE '[REDACTED]=' || turn || ';plain=[REDACTED] ' || role END AS headers, NULL::BIGINT AS pin FROM c""")
def redacted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = a.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_SAID).alias("said"))
    turn, role = F.col("turn"), F.col("role")
    odd = F.create_map(F.concat(F.lit("sk-key-"), turn.cast("string")), turn.cast("string"), F.lit("plain"), F.concat(F.lit("sk-abc "), role))
    headers = F.when(turn % 2 == 0, F.create_map(F.lit("Api-Key"), role, F.lit("note"), F.lit("x"))).otherwise(odd)
    auth = F.struct(role.alias("API_Key"), F.concat(role, F.lit(" sk-"), role).alias("note"), F.struct(turn.alias("api-key")).alias("inner"))
    whole = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("said").alias("body"), auth.alias("auth"), headers.alias("headers"))).alias("turns"))
    shown = redacted_frame(whole).select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return shown.select("conv_id", "turn", "role", "body", F.col("auth.API_Key").alias("api_key"), "auth.note", entries.alias("headers"), F.col("auth.inner.`api-key`").alias("pin"))
