"""SQL that gives the same rows as registered queries, for DuckDB."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM keyed JOIN least USING (k) WHERE m < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_BENCH_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, bw.n, item FROM dw JOIN bw USING (k) WHERE dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS its FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(its, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op3() -> str:
    from corvane.llm import quality_rules as q

    separators = ", ".join(f"'{s}'" for s in q.SEPARATORS)
    end = q.SENTENCE_END.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1) GROUP BY 1),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), line AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM cut),
lw AS (SELECT doc_id, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS x FROM line), own AS (SELECT *, array_to_string(x, '') AS joined FROM lw WHERE len(x) > 0),
judged AS (SELECT doc_id, line, len(x) AS words, length(joined) - length(regexp_replace(joined, '[#*$%&|<>]', '', 'g')) > {q.SYMBOL_SHARE} * length(joined)
  OR len(list_filter(x, lambda v: v IN ({separators}))) > {q.SEPARATOR_SHARE} * len(x) OR (len(x) <= {q.BOILERPLATE_WORDS} AND regexp_matches(line, '{q.BOILERPLATE}')) OR NOT regexp_matches(line, '{end}') AS failed FROM own),
lines AS (SELECT doc_id, count(*) AS n_lines, count_if(failed) AS n_failed, coalesce(sum(words) FILTER (NOT failed), 0)::BIGINT AS n_kept_words, count(*) - count(DISTINCT line) AS n_dup_lines FROM judged GROUP BY 1),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed, coalesce(n_kept_words, 0) AS n_kept_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_kept_words >= {q.KEPT_SHARE} * n_words AS kept FROM verdict
"""


def _op10() -> str:
    from corvane.llm import url_filter as u

    ranked = sorted(u.RULES, key=lambda rule: -len(rule[1] + rule[2]))
    fits = lambda rule: f"(host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ranked) + " END"
    found = lambda terms: "list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda t: regexp_matches(whole, '(^|[^\\p{L}\\p{N}])' || t || '($|[^\\p{L}\\p{N}])'))"
    return rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, lower(url_decode(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), ''))) AS whole FROM pages)
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, coalesce({case(lambda r: r[0])}, CASE WHEN len({found(u.STRICT_TERMS)}) > 0 OR len({found(u.SOFT_TERMS)}) >= {u.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""


OP11 = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_BENCH_WORDS}) AS t FROM benchmark) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM df, s), room AS (SELECT doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, s),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN room USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op3_quality_rules": _op3(), "op6_decontaminate": OP6, "op10_url_filter": _op10(), "op11_lexical_search": OP11}
