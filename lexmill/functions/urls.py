"""URL and HTTP scalars as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track, dropped from canonical URLs (compared without case).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "_ga")
#: Header names, and parts of names, whose values are redacted.
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "www-authenticate", "proxy-authenticate")
SECRET_PARTS = ("token", "secret", "password", "credential", "apikey", "api-key", "api_key", "bearer", "auth-token", "access-key", "private-key")
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _quoted(c: Column) -> Column:
    """Form encoding, with * escaped and ~ kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquoted(c: Column) -> Column:
    """Form decoding; a % that begins no escape stands for itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(c: Column) -> Column:
    """Lower-cased scheme and host without the scheme's default port, no slashes at the path's end, no
    tracking parameters or fragment, the other parameters sorted and encoded anew."""
    scheme, host = F.lower(F.regexp_extract(c, _PARTS, 1)), F.lower(F.regexp_extract(c, _PARTS, 2))
    path, query = F.regexp_extract(c, _PARTS, 3), F.regexp_extract(c, _PARTS, 4)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(F.regexp_replace(path, "/+$", "") == "", "/").otherwise(F.regexp_replace(path, "/+$", ""))

    def pair(p: Column) -> Column:
        return F.struct(_unquoted(F.substring_index(p, "=", 1)).alias("k"), _unquoted(F.when(p.contains("="), F.regexp_extract(p, "^[^=]*=(.*)$", 1)).otherwise("")).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p.k).isin(*TRACKING)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p.k), F.lit("="), _quoted(p.v))), "&")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).when(host != "", "//").otherwise(""), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def redacted_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS) | F.lower(k).rlike("|".join(SECRET_PARTS)), "[REDACTED]").otherwise(v))


def parsed_href(href: Column) -> Column:
    """A struct (lexicon_url, anchor) of what stands before and behind the first #; null where there is no # or nothing on a side."""
    url, anchor = F.substring_index(href, "#", 1), F.regexp_extract(href, "(?s)^[^#]*#(.*)$", 1)
    return F.when(href.contains("#") & (url != "") & (anchor != ""), F.struct(url.alias("lexicon_url"), anchor.alias("anchor")))


def allowed_url(url: Column, origin: Column) -> Column:
    """https, or http to the same origin, this machine, a .local name or a private IPv4 address."""
    scheme, host = F.lower(F.regexp_extract(url, "^([^:/?#]+)://", 1)), F.lower(F.regexp_extract(url, r"^[^:/?#]+://(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"^(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})$")
    same = F.lower(F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1)) == F.lower(origin)
    return (scheme == "https") | ((scheme == "http") & (F.coalesce(same, F.lit(False)) | host.isin("localhost", "[::1]") | host.endswith(".local") | private))


def robots_note(status: Column, disallowed: Column, override: Column) -> Column:
    """What a robots.txt response says of a URL."""
    return F.when(override, "permission_override").when(status.isNull(), "robots_fetch_failed").when(status == 404, "no_robots_file").when(status != 200, F.concat(F.lit("robots_unexpected_status_"), status.cast("string"))).when(disallowed, "disallowed").otherwise("allowed")


def crawl_outcome(note: Column, status: Column, sha256: Column, previous: Column) -> tuple[Column, Column]:
    """(crawl_status, error_details) of a fetch; the first rule that holds decides."""
    state = F.when(note == "disallowed", "robots_blocked").when(status.isNull(), "error").when(status == 404, "not_found").when(status >= 400, "error").when(previous.isNull(), "new").when(previous == sha256, "unchanged").otherwise("changed")
    error = F.when(note == "disallowed", "").when(status.isNull(), "max_retries_exceeded").when((status >= 400) & (status != 404), F.concat(F.lit("http_"), status.cast("string"))).otherwise("")
    return state, error
