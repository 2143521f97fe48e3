"""Scalars over whole tables: normalization, identities, URLs, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import identity, labels, norm, urls

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def sql_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '\p{{M}}', '', 'g')"


def sql_punct(x: str) -> str:
    return sql_ws(rf"regexp_replace({x}, '\p{{P}}+', '', 'g')")


SQL_KEYS = {
    "casefold": lambda x: sql_fold(sql_ws(x)),
    "diacritics_insensitive": lambda x: sql_strip(sql_fold(sql_ws(x))),
    "punct_stripped": lambda x: sql_strip(sql_fold(sql_punct(sql_ws(x)))),
    "nospace": lambda x: f"replace({sql_strip(sql_fold(sql_ws(x)))}, ' ', '')",
}


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict = {}
SQL: dict = {}


def over_text(name: str, function, sql: str) -> None:
    """A scalar over every whole text, as a digest."""
    QUERIES[name] = lambda s, d: read(s, d, "documents").select("doc_id", F.md5(function(F.col("text"))).alias("digest"))
    SQL[name] = f"SELECT doc_id, md5({sql}) AS digest FROM documents"


over_text("fn_ws", norm.whitespace, sql_ws("text"))
over_text("fn_strip_diacritics", norm.strip_diacritics, sql_strip("text"))
over_text("fn_strip_punct", norm.strip_punctuation, sql_punct("text"))
over_text("fn_punct_to_space", norm.punctuation_to_space, sql_ws(r"regexp_replace(text, '\p{P}', ' ', 'g')"))
over_text("fn_casefold", norm.casefold, sql_fold("text"))
over_text("fn_remove_spaces", norm.remove_spaces, "replace(text, ' ', '')")
over_text("fn_nfc", norm.nfc, "nfc_normalize(text)")
for _name, _key in norm.KEYS.items():
    over_text({"casefold": "key_casefold", "diacritics_insensitive": "key_diacritics_insensitive", "punct_stripped": "key_punct_stripped", "nospace": "key_nospace"}[_name], _key, SQL_KEYS[_name]("text"))

_FORMS = "list_value(p_name, upper(p_name), p_brand || '  ' || p_type, '')"


def fn_search_keys(spark, sf):
    forms = F.array("p_name", F.upper("p_name"), F.concat("p_brand", F.lit("  "), "p_type"), F.lit(""))
    keys = read(spark, sf, "part").select("p_partkey", norm.search_keys(forms).alias("k"))
    return keys.select("p_partkey", *[F.array_join(f"k.{n}", "|").alias(n) for n in norm.KEYS])


def _sql_keys(forms: str, name: str) -> str:
    # the first place of each distinct key keeps the order
    mapped = f"list_transform({forms}, lambda x: {SQL_KEYS[name]('x')})"
    return f"array_to_string(list_filter({mapped}, lambda k, i: k <> '' AND list_position({mapped}, k) = i), '|')"


QUERIES["fn_search_keys"] = fn_search_keys
SQL["fn_search_keys"] = f"SELECT p_partkey, {', '.join(f'{_sql_keys(_FORMS, n)} AS {n}' for n in norm.KEYS)} FROM part"

# identities
QUERIES["fn_content_hash"] = lambda s, d: read(s, d, "pages").select("page_id", identity.content_sha256(F.col("html")).alias("content_sha256"), identity.content_id(F.col("html")).alias("content_id"))
SQL["fn_content_hash"] = "SELECT page_id, sha256(html) AS content_sha256, substr(sha256(html), 1, 16) AS content_id FROM pages"
QUERIES["fn_snapshot_id"] = lambda s, d: read(s, d, "pages").select("page_id", identity.snapshot_id(F.col("url"), F.lit("2026-01-01T00:00:00Z"), F.sha2("html", 256)).alias("snapshot_id"))
SQL["fn_snapshot_id"] = "SELECT page_id, substr(sha256(url || chr(10) || '2026-01-01T00:00:00Z' || chr(10) || sha256(html)), 1, 16) AS snapshot_id FROM pages"
QUERIES["fn_ir_id"] = lambda s, d: read(s, d, "orders").select("o_orderkey", identity.ir_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey"), F.lit("lexicon_v3")).alias("ir_id"))
SQL["fn_ir_id"] = "SELECT o_orderkey, substr(sha256(o_orderpriority || '|' || o_orderstatus || '|' || o_orderkey::VARCHAR || '|lexicon_v3'), 1, 16) AS ir_id FROM orders"
QUERIES["fn_bundle_id"] = lambda s, d: read(s, d, "part").select("p_partkey", identity.bundle_id(F.lit("full"), F.lit("20260208"), F.concat(F.lit("sha256:"), F.sha2("p_name", 256))).alias("bundle_id"), identity.storage_scope(F.col("p_brand"), F.sha2("p_name", 256)).alias("scope"))
SQL["fn_bundle_id"] = "SELECT p_partkey, 'bundle_full_20260208_' || substr(sha256(p_name), 1, 8) AS bundle_id, p_brand || '::' || sha256(p_name) AS scope FROM part"
QUERIES["fn_sha256_file"] = lambda s, d: read(s, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"), F.octet_length("text").cast("long").alias("byte_length"))
SQL["fn_sha256_file"] = "SELECT doc_id, 'sha256:' || sha256(text) AS sha256, strlen(text)::BIGINT AS byte_length FROM documents"

# URLs
QUERIES["fn_canonicalize_url"] = lambda s, d: read(s, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))
_track = ", ".join(f"'{t}'" for t in urls.TRACKING)
_parts = "regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', {})"
_host = f"lower({_parts.format(2)})"
_scheme = f"lower({_parts.format(1)})"
_path = f"regexp_replace({_parts.format(3)}, '/+$', '')"
_kept = f"list_sort(list_filter(str_split({_parts.format(4)}, '&'), lambda p: p <> '' AND lower(str_split(p, '=')[1]) NOT IN ({_track})))"
SQL["fn_canonicalize_url"] = f"""
SELECT page_id, {_scheme} || '://' || CASE WHEN {_scheme} = 'http' THEN regexp_replace({_host}, ':80$', '') ELSE regexp_replace({_host}, ':443$', '') END
  || CASE WHEN {_path} = '' THEN '/' ELSE {_path} END || CASE WHEN len({_kept}) > 0 THEN '?' || array_to_string({_kept}, '&') ELSE '' END AS url
FROM pages"""
QUERIES["fn_url_policy"] = lambda s, d: read(s, d, "pages").select("page_id", urls.allowed_url(F.col("url"), F.lit("http://localhost:8000")).alias("allowed"))
SQL["fn_url_policy"] = "SELECT page_id, starts_with(lower(url), 'https://') OR regexp_matches(lower(url), '^http://(localhost|[^/:?#]*\\.local|10\\.[0-9.]+|192\\.168\\.[0-9.]+)([:/?#]|$)') AS allowed FROM pages"
QUERIES["fn_parse_href"] = lambda s, d: read(s, d, "pages").select("page_id", urls.parsed_href(F.col("url")).alias("h")).select("page_id", "h.lexicon_url", "h.anchor")
SQL["fn_parse_href"] = """SELECT page_id, CASE WHEN ok THEN str_split(url, '#')[1] END AS lexicon_url, CASE WHEN ok THEN regexp_extract(url, '^[^#]*#(.*)$', 1) END AS anchor
FROM (SELECT page_id, url, contains(url, '#') AND str_split(url, '#')[1] <> '' AND regexp_extract(url, '^[^#]*#(.*)$', 1) <> '' AS ok FROM pages)"""
QUERIES["fn_url_tail"] = lambda s, d: read(s, d, "pages").select("page_id", labels.url_tail(F.col("url")).alias("tail"))
SQL["fn_url_tail"] = "SELECT page_id, str_split(url, '/')[-1] AS tail FROM pages"
QUERIES["fn_redact_headers"] = lambda s, d: read(s, d, "events").select("event_id", F.create_map(F.concat(F.lit("X-"), "event_type", F.lit("-Token")), F.col("props"), F.lit("ETag"), F.col("event_type"), F.lit("Set-Cookie"), F.col("props")).alias("h")).select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(urls.redacted_headers(F.col("h"))), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("headers"))
SQL["fn_redact_headers"] = "SELECT event_id, array_to_string(list_sort(['X-' || event_type || '-Token=[REDACTED]', 'ETag=' || event_type, 'Set-Cookie=[REDACTED]']), ';') AS headers FROM events"
QUERIES["fn_crawl_outcome"] = lambda s, d: read(s, d, "events").select("event_id", *[c.alias(n) for c, n in zip(urls.crawl_outcome(urls.robots_note(F.when(F.col("user_id") % 7 == 0, 404).when(F.col("user_id") % 7 == 1, 503).when(F.col("user_id") % 7 > 2, 200), F.col("user_id") % 3 == 0, F.col("user_id") % 11 == 0), F.when(F.col("event_id") % 6 == 0, F.lit(None)).when(F.col("event_id") % 6 == 1, 404).when(F.col("event_id") % 6 == 2, 429).otherwise(200), F.col("event_type"), F.when(F.col("event_id") % 4 > 0, F.lit("click"))), ("crawl_status", "error_details"))])
SQL["fn_crawl_outcome"] = """
WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 11 = 0 THEN 'permission_override' WHEN user_id % 7 = 2 THEN 'robots_fetch_failed' WHEN user_id % 7 = 0 THEN 'no_robots_file' WHEN user_id % 7 = 1 THEN 'robots_unexpected_status_503' WHEN user_id % 3 = 0 THEN 'disallowed' ELSE 'allowed' END AS note,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 200 END AS status, CASE WHEN event_id % 4 > 0 THEN 'click' END AS prev FROM events)
SELECT event_id, CASE WHEN note = 'disallowed' THEN 'robots_blocked' WHEN status IS NULL THEN 'error' WHEN status = 404 THEN 'not_found' WHEN status >= 400 THEN 'error' WHEN prev IS NULL THEN 'new' WHEN prev = event_type THEN 'unchanged' ELSE 'changed' END AS crawl_status,
  CASE WHEN note = 'disallowed' THEN '' WHEN status IS NULL THEN 'max_retries_exceeded' WHEN status >= 400 AND status <> 404 THEN 'http_' || status ELSE '' END AS error_details FROM e"""

# labels
QUERIES["fn_pos_hint"] = lambda s, d: read(s, d, "documents").select("doc_id", labels.pos_hint(F.col("text")).alias("pos_hint"))
SQL["fn_pos_hint"] = f"""SELECT doc_id, CASE WHEN contains(w, '/') OR w IN ({', '.join(repr(x) for x in labels.POS_HINTS)}) THEN w END AS pos_hint FROM (SELECT doc_id, lower(regexp_extract(text, '^\\s*(\\S+)', 1)) AS w FROM documents)"""
QUERIES["fn_first_int"] = lambda s, d: read(s, d, "customer").select("c_custkey", labels.first_int(F.col("c_name")).alias("n"))
SQL["fn_first_int"] = "SELECT c_custkey, try_cast(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS INT) AS n FROM customer"
QUERIES["fn_attribution"] = lambda s, d: read(s, d, "part").select("p_partkey", labels.attribution(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("] x [b]"))).alias("a")).select("p_partkey", "a.text", "a.source")
SQL["fn_attribution"] = "SELECT p_partkey, trim(regexp_replace(p_name || ' [' || p_brand || '] x [b]', '\\s*\\[[^\\]]*\\]\\s*', ' ', 'g')) AS text, '[' || p_brand || ']' AS source FROM part"
QUERIES["fn_warning_type"] = lambda s, d: read(s, d, "documents").select("doc_id", labels.warning_type(F.col("text")).alias("w"))
SQL["fn_warning_type"] = "SELECT doc_id, CASE WHEN contains(text, ':') THEN str_split(text, ':')[1] ELSE coalesce(nullif(regexp_extract(text, '^\\s*(\\S+)', 1), ''), 'unknown') END AS w FROM documents"
QUERIES["fn_iso_now"] = lambda s, d: read(s, d, "events").select("event_id", labels.iso_second(F.col("ts")).alias("at"))
SQL["fn_iso_now"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events"
QUERIES["fn_fmt_bytes"] = lambda s, d: read(s, d, "documents").select("doc_id", labels.human_bytes(F.col("n_chars")).alias("size"))
SQL["fn_fmt_bytes"] = "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.2f KB', round(n_chars / 1024.0, 2)) ELSE printf('%.2f MB', round(n_chars / 1048576.0, 2)) END AS size FROM documents"
QUERIES["prj_language_meta"] = lambda s, d: read(s, d, "documents").select("doc_id", F.concat(labels.language_label(F.when(F.col("lang") == "en", "English"), F.col("lang"), "Source"), F.lit(" ↔ "), labels.language_label(F.lit(" "), F.lit(""), "Target")).alias("name"))
SQL["prj_language_meta"] = "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'English' END, upper(nullif(trim(lang), '')), 'Source') || ' ↔ Target' AS name FROM documents"
QUERIES["fn_fmt_ms"] = lambda s, d: read(s, d, "documents").select("doc_id", labels.human_ms(F.col("n_chars") / 8.0).alias("took"))
SQL["fn_fmt_ms"] = "SELECT doc_id, round(n_chars / 8.0::DOUBLE)::BIGINT || ' ms' AS took FROM documents"
QUERIES["fn_crawl_id"] = lambda s, d: read(s, d, "documents").select("doc_id", labels.crawl_id(F.col("source"), F.timestamp_millis(F.lit(1_767_225_600_000) + F.col("doc_id") * 86_399_987), F.hex(F.col("doc_id") * 7)).alias("crawl_id"))
SQL["fn_crawl_id"] = "SELECT doc_id, concat_ws('_', 'crawl', strftime(make_timestamp((1767225600000 + doc_id * 86399987) * 1000), '%Y%m%d_%H%M%S_%g'), right(lpad(lower(printf('%x', doc_id * 7)), greatest(4, length(printf('%x', doc_id * 7)))::INT, '0'), 4), source) AS crawl_id FROM documents"
