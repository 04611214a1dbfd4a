"""Queries on record files, tags, conversations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions.parser import parsed_output
from corvane.operators.validation import direct_state, format_errors, judge_scores, leaks
from corvane.plans import adapters as a
from corvane.plans.registry import query
from corvane.sources import records as r

_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(rf"""WITH {a.FILE_LINES_SQL}, b AS (SELECT *, {_STRIP('line')} AS bare FROM file_lines), g AS (SELECT *, sum((bare = '')::INT) OVER (PARTITION BY source ORDER BY line_no) AS run FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY line_no) - 1 AS place FROM g WHERE bare <> ''),
q AS (SELECT source, min(line_no) AS line_no, min_by(bare, place) AS image, coalesce(max(bare) FILTER (place % 2 = 1), '') AS text FROM p GROUP BY source, run, place // 2)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS position, md5(image) AS image, md5(text) AS text FROM q""")
def triplet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.triplets(a.lines(spark, sf_dir)).select("source", F.col("position").cast("bigint").alias("position"), F.md5(F.col("image").cast("binary")).alias("image"), F.md5(F.col("text").cast("binary")).alias("text"))


@query(rf"""WITH {a.FILE_LINES_SQL}, b AS (SELECT *, {_STRIP('line')} AS bare FROM file_lines), h AS (SELECT *, regexp_matches(bare, '(?i)^\S+\.(png|jpe?g)$') AS header FROM b),
g AS (SELECT *, sum(header::INT) OVER (PARTITION BY source ORDER BY line_no) - 1 AS position FROM h)
SELECT source, position::BIGINT AS position, max(bare) FILTER (header) AS sample_id, md5(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT header), ''), '\s+$', '')) AS raw_text FROM g WHERE position >= 0 GROUP BY ALL""")
def block_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.header_blocks(a.lines(spark, sf_dir), strict=False).select("source", "position", "sample_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


@query(rf"""WITH {a.FILE_LINES_SQL}, e AS (SELECT source, CASE WHEN (line_no - 1) % 3 = 0 AND NOT regexp_matches(trim(line), '(?i)\.(jpg|jpeg|png|bmp)$') THEN 'ImageNameError' WHEN (line_no - 1) % 3 = 1 AND trim(line) = '' THEN 'AnnotationMissingError'
WHEN (line_no - 1) % 3 = 1 AND NOT regexp_matches(trim(line), '(?i)^(<SAFE\s*/>|<ALERT>.*</ALERT>\s*<GUIDE>.*</GUIDE>)$') THEN 'AlertFormatError' WHEN (line_no - 1) % 3 = 2 AND trim(line) <> '' THEN 'MissingEmptyLineError' END AS error FROM file_lines)
SELECT source, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL UNION ALL SELECT source, 'IncompleteBlockError', 1 FROM file_lines GROUP BY source HAVING max(line_no) % 3 <> 0""")
def format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_errors(a.lines(spark, sf_dir))


@query(f"""WITH {a.MESSAGES_SQL}, f AS (SELECT conv_id, list_filter(messages, lambda m: m.role = 'assistant') AS x FROM turns) SELECT conv_id, x[1].content AS content, CASE WHEN length(trim(x[1].content)) > 0 THEN x[1].content ELSE x[2].content END AS lenient FROM f""")
def first_assistant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.messages(spark, sf_dir).select("conv_id", r.assistant_text(F.col("messages")).alias("content"), r.assistant_text(F.col("messages"), exact=False).alias("lenient"))


@query(f"""WITH {a.MESSAGES_SQL}, f AS (SELECT conv_id, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS c FROM turns),
l AS (SELECT conv_id, c, unnest(CASE WHEN c IS NULL OR conv_id % 7 = 0 THEN ['en', 'zh'] WHEN regexp_matches(c, '[\\x{{4e00}}-\\x{{9fff}}]') THEN ['zh'] ELSE ['en'] END) AS language FROM f)
SELECT language, CASE WHEN c IS NULL OR conv_id % 7 = 0 THEN 'safe' ELSE 'hazard' END AS class, count(*) AS n FROM l GROUP BY ALL""")
def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.messages(spark, sf_dir).select("conv_id", r.assistant_text(F.col("messages")).alias("c"))
    safe = F.col("c").isNull() | (F.col("conv_id") % 7 == 0)
    languages = F.when(safe, F.array(F.lit("en"), F.lit("zh"))).when(t.has_cjk(F.col("c")), F.array(F.lit("zh"))).otherwise(F.array(F.lit("en")))
    return own.select(F.explode(languages).alias("language"), F.when(safe, "safe").otherwise("hazard").alias("class")).groupBy("language", "class").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 9 = 0 THEN '前方' ELSE '' END, '[\x{4e00}-\x{9fff}]') AS cjk FROM documents")
def cjk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("text", F.when(F.col("doc_id") % 9 == 0, "前方").otherwise(""))
    return a.table(spark, sf_dir, "documents").select("doc_id", t.has_cjk(own).alias("cjk"))


@query(rf"SELECT page_id, {_STRIP('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')} AS title, {_STRIP('''regexp_extract(html, '(?is)<p>(.*?)</p>', 1)''')} AS first_p FROM pages")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return a.table(spark, sf_dir, "pages").select("page_id", t.tag(html, "title").alias("title"), t.tag(html, "p").alias("first_p"))


_OUTPUT = "CASE doc_id % 6 WHEN 0 THEN '  <SAFE/> ' WHEN 1 THEN '<SAFE />' WHEN 2 THEN '' WHEN 3 THEN '<ALERT>' || text || '</ALERT><GUIDE>go</GUIDE>' WHEN 4 THEN '<ALERT>' || text || '</ALERT>' ELSE 'safe' END"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    own = F.when(k == 0, "  <SAFE/> ").when(k == 1, "<SAFE />").when(k == 2, "").when(k == 3, F.concat(F.lit("<ALERT>"), "text", F.lit("</ALERT><GUIDE>go</GUIDE>"))).when(k == 4, F.concat(F.lit("<ALERT>"), "text", F.lit("</ALERT>"))).otherwise("safe")
    return a.table(spark, sf_dir, "documents").select("doc_id", own.alias("output"))


_BARE = f"outputs AS (SELECT doc_id, {_OUTPUT} AS output FROM documents), bare AS (SELECT doc_id, output, {_STRIP('output')} AS b FROM outputs)"


@query(rf"WITH {_BARE} SELECT doc_id, CASE WHEN b = '' THEN ['empty', 'malformed'] WHEN b = '<SAFE/>' OR regexp_full_match(b, '(?s)<ALERT>.+?</ALERT>\s*<GUIDE>.+?</GUIDE>') THEN [] ELSE ['malformed'] END AS flags FROM bare")
def output_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("doc_id", t.quality_flags(F.col("output")).alias("flags"))


@query(rf"WITH {_BARE} SELECT doc_id, b = '<SAFE/>' AS exact, regexp_full_match(b, '(?i)<SAFE\s*/>') AS regex, lower(b) = '<safe/>' AS lower, lower(b) IN ('</safe>', '<safe/>', '<safe />', 'safe') AS in_set FROM bare")
def safe_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("output")
    return _outputs(spark, sf_dir).select("doc_id", *[t.is_safe(own, v).alias("in_set" if v == "set" else v) for v in t.SAFE_VARIANTS])


@query(rf"""WITH {_BARE} SELECT doc_id, CASE WHEN regexp_full_match(b, '(?i)<SAFE\s*/>') THEN 'explicitly_safe' WHEN b = '' THEN 'no_extractable_hazard' WHEN NOT (regexp_full_match(b, '(?is)<ALERT>.*?</ALERT>\s*<GUIDE>.*?</GUIDE>') AND {_STRIP("regexp_extract(b, '(?is)<ALERT>(.*?)</ALERT>', 1)")} <> '' AND NOT regexp_matches(b, '(?i)<SAFE\s*/>')) THEN 'review_required' END AS state FROM bare""")
def direct_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("doc_id", direct_state(F.col("output")).alias("state"))


_PART_NAMES = "n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name || 's, (large)' WHEN 1 THEN 'Buses & ' || p_name WHEN 2 THEN p_name || ' boxes' WHEN 3 THEN p_type || ' glasses' ELSE 'low-hanging ' || p_name || ' ladies' END AS name FROM part)"


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    own = F.when(k == 0, F.concat(F.lit("The "), n, F.lit("s, (large)"))).when(k == 1, F.concat(F.lit("Buses & "), n)).when(k == 2, F.concat(n, F.lit(" boxes"))).when(k == 3, F.concat("p_type", F.lit(" glasses"))).otherwise(F.concat(F.lit("low-hanging "), n, F.lit(" ladies")))
    return a.table(spark, sf_dir, "part").select("p_partkey", own.alias("name"))


@query(f"WITH {_PART_NAMES} SELECT p_partkey, {a.cautious_sql('name')} AS norm FROM n")
def name_normalise_cautious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_names(spark, sf_dir).select("p_partkey", t.cautious_name(F.col("name")).alias("norm"))


@query(f"WITH {_PART_NAMES} SELECT p_partkey, {a.simple_sql('name')} AS norm FROM n")
def name_normalise_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_names(spark, sf_dir).select("p_partkey", t.simple_name(F.col("name")).alias("norm"))


@query(f"""WITH {_PART_NAMES}, w AS (SELECT p_partkey, list_distinct(string_split({a.simple_sql('name')}, ' ')) AS x FROM n)
SELECT l.p_partkey AS a, r.p_partkey AS b, round(len(list_intersect(l.x, r.x)) / len(list_distinct(list_concat(l.x, r.x))), 9) AS jaccard, len(list_intersect(l.x, r.x)) IN (len(l.x), len(r.x)) AS subset FROM w l JOIN w r ON r.p_partkey = l.p_partkey + 5""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _part_names(spark, sf_dir).select("p_partkey", t.simple_name(F.col("name")).alias("n"))
    pairs = own.select(F.col("p_partkey").alias("a"), F.col("n").alias("x"), (F.col("p_partkey") + 5).alias("b")).join(own.select(F.col("p_partkey").alias("b"), F.col("n").alias("y")), "b")
    return pairs.select("a", "b", F.round(t.token_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"), t.token_subset(F.col("x"), F.col("y")).alias("subset"))


@query("""SELECT p_partkey, sha256('{"name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}') AS fingerprint FROM part""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "part").select("p_partkey", t.fingerprint(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("fingerprint"))


@query(f"""WITH {_PART_NAMES}, h AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN name || ' objects' ELSE name END AS name FROM n), w AS (SELECT p_partkey, list_last(regexp_extract_all(lower(name), '[a-z]+')) AS w FROM h)
SELECT p_partkey, CASE WHEN length(w) > 2 AND w LIKE '%s' THEN w[:-2] ELSE w END IN ('obstacle', 'object', 'hazard') AS generic FROM w""")
def generic_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("name", F.lit(" objects"))).otherwise(F.col("name"))
    return _part_names(spark, sf_dir).select("p_partkey", t.has_generic_head(name).alias("generic"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS text FROM documents""")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").select("doc_id", F.md5(t.collapsed(F.col("text")).cast("binary")).alias("text"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_extract(url, '([^/]*/)?[^/]*$') AS with_parent FROM pages""")
def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "pages").select("page_id", t.image_label(F.col("url")).alias("name"), t.image_label(F.col("url"), with_parent=True).alias("with_parent"))


@query(r"""SELECT page_id, p <> '' AND NOT regexp_matches(p, '[\\:\x00-\x1F]') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, 'example.*') WHEN 1 THEN url WHEN 2 THEN 'a/../' || page_id ELSE 'img/' || page_id || '.png' END AS p FROM pages)""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    p = F.when(k == 0, F.regexp_extract("url", "example.*", 0)).when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit("a/../"), n)).otherwise(F.concat(F.lit("img/"), n, F.lit(".png")))
    return a.table(spark, sf_dir, "pages").select("page_id", t.safe_relative_path(p).alias("safe"))


@query("""WITH e AS (SELECT event_id, event_id % 11 AS h, event_id % 7 AS g, event_id % 5 AS f, event_id % 4 AS kind FROM events)
SELECT event_id, CASE WHEN kind <> 3 AND h <= 10 THEN h::INT END AS hazard, CASE WHEN kind <> 3 AND h <= 10 THEN g::INT END AS guide FROM e""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    n = lambda m: (k % m).cast("string")
    body = F.concat(F.lit('{"hazard": '), F.when(k % 4 == 1, F.concat(n(11), F.lit(".7"))).otherwise(F.concat(F.lit('"'), n(11), F.lit('"'))), F.lit(', "guide": '), n(7), F.lit(', "format": '), n(5), F.lit("}"))
    answer = F.when(k % 4 == 3, F.lit('no scores {"hazard": "7.9", "guide": 1}')).otherwise(F.concat(F.lit("Scores:\n"), body, F.lit("\nDone.")))
    return a.table(spark, sf_dir, "events").select("event_id", judge_scores(answer).alias("j")).select("event_id", "j.hazard", "j.guide")


@query("SELECT conv_id, turn, contains(lower(text), 'the') AS leak FROM conversations")
def prompt_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "conversations").select("conv_id", "turn", leaks(F.col("text"), F.lit("The")).alias("leak"))


@query("""WITH e AS (SELECT event_id, list_transform(range(1, (event_id % 9 + 1)::BIGINT), lambda i: (event_id * 7 + i * 3) % 11) AS ids FROM events), p AS (SELECT event_id, ids, list_position(list_transform(ids, lambda x: x IN (2, 5)), true) AS spot FROM e)
SELECT event_id, len(CASE WHEN spot IS NULL OR spot = 0 THEN ids ELSE ids[:spot - 1] END)::INT AS kept, CASE WHEN spot > 0 THEN 'stop' WHEN len(ids) >= 7 THEN 'length' ELSE 'open' END AS finish FROM p""")
def token_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ids = F.when(k % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k % 9, F.lit(1)).cast("int")), lambda i: (k * 7 + i * 3) % 11))
    return a.table(spark, sf_dir, "events").select("event_id", t.trimmed_tokens(ids, (2, 5), 7).alias("x")).select("event_id", F.size("x.ids").alias("kept"), "x.finish")


@query()
def tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _outputs(spark, sf_dir).select("doc_id", parsed_output(F.col("output"), True).alias("x"))
    return own.select("doc_id", F.length("x.alert").alias("alert_chars"), "x.guide", "x.hazard", "x.warned")
