"""URL functions as column expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed import catalogue as fc
from ..fixed import embeds as fe
from .regex import first, first_once, has, let, sub

_SCHEME = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.\-]*):"
_LEAD = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_NETLOC = _LEAD + r"//([^/?#]*)"
_HOST = _LEAD + r"//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)"
_PATH = r"(?s)" + _LEAD + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.translate(url, "\t\r\n", ""), pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, _SCHEME))


def netloc(url: Column) -> Column:
    return _part(url, _NETLOC)


def path(url: Column) -> Column:
    return _part(url, _PATH)


def query(url: Column) -> Column:
    return _part(url, _QUERY)


def fragment(url: Column) -> Column:
    return _part(url, _FRAGMENT)


def host(url: Column) -> Column:
    """Lower-case host without user info and port; the empty string when there is none."""
    return F.lower(F.translate(_part(url, _HOST), "[]", ""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"))


def host_in(host_col: Column, domains) -> Column:
    """True when the host is one of the domains or a subdomain of one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host_col == d) | host_col.endswith("." + d)
    return out


def registrable_domain(host_col: Column) -> Column:
    return F.substring_index(F.lower(host_col), ".", -2)


def same_site(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (registrable_domain(a) == registrable_domain(b))


def _decode_plus(text: Column) -> Column:
    # A percent sign that starts no valid escape is kept: escape it first, then decode.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves bad sequences and `+` as they are."""
    return F.when(F.contains(text, F.lit("%")), _decode_plus(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)


def _encode_plus(text: Column) -> Column:
    out = F.url_encode(text)
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def percent_encode(text: Column, safe: str = "") -> Column:
    """Percent-encoding with the given characters left alone; a space becomes `%20`."""
    out = F.replace(_encode_plus(text), F.lit("+"), F.lit("%20"))
    for ch in safe:
        out = F.replace(out, F.lit("%%%02X" % ord(ch)), F.lit(ch))
    return out


def canonical_url(url: Column) -> Column:
    """One spelling per page: https, lower-case host, no port, no fragment, no trailing slashes, no tracking parameters,
    no blank parameters, the others decoded and re-encoded in their order."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    parts = F.struct(host(url).alias("host"), trimmed.alias("path"), query(url).alias("query"))
    return let(parts, lambda u: F.concat(_canonical_head(u["host"], u["path"]), _canonical_query(u["query"])))


def _canonical_head(h: Column, p: Column) -> Column:
    rooted = F.when(p == "", F.lit("/")).when((h != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    return F.when((h == "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("https:"), p)).otherwise(
        F.concat(F.lit("https://"), h, rooted)
    )


def _canonical_query(q: Column) -> Column:
    pairs = F.transform(F.split(q, "&"), lambda p: F.struct(_decode_plus(_name(p)).alias("k"), _decode_plus(_value(p)).alias("v")))
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*fc.TRACKING_PARAMS))
    encoded = F.transform(kept, lambda p: F.concat(_encode_plus(p["k"]), F.lit("="), _encode_plus(p["v"])))
    text = let(F.array_join(encoded, "&"), lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("?"), t)))
    return F.when(q == "", F.lit("")).otherwise(text)


def _name(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _value(pair: Column) -> Column:
    return F.regexp_replace(pair, r"(?s)^[^=]*=?", "")


def stable_id(source: Column, page_url: Column, angle_key: Column) -> Column:
    angle = F.coalesce(F.nullif(angle_key, F.lit("")), F.lit("0"))
    basis = F.concat(source, F.lit("|"), canonical_url(page_url), F.lit("|"), angle)
    return F.substring(F.sha2(basis, 256), 1, 16)


def merge_key(target: Column) -> Column:
    """Identity under which copies of one stream merge over sources, or null when there is none."""
    wrapped = F.contains(target, F.lit("player?url="))
    opened = F.when(wrapped, percent_decode(sub(target, r"^https?:.*?url=", ""))).otherwise(target)

    def key(t: Column) -> Column:
        bare = F.regexp_replace(sub(t, fe.TOKEN_PARAMS, ""), r"[?&]+$", "")
        return F.coalesce(
            F.when(F.contains(t, F.lit("youtube")), F.concat(F.lit("yt:"), first_once(t, fe.YT_VIDEO))),
            F.when(F.contains(t, F.lit("feratel.com/webtv/")), F.concat(F.lit("feratel:"), first_once(t, fe.FERATEL_CAM))),
            F.when(F.contains(t, F.lit(".m3u8")), F.concat(F.lit("hls:"), bare)),
        )

    return let(opened, key)


def unwrap(target: Column) -> Column:
    return F.coalesce(percent_decode(first(target, fe.UNWRAP)), target)


def is_still_image(url: Column) -> Column:
    return has(path(url), fe.STILL_IMAGE, ignore_case=True)


def is_never_a_stream(url: Column) -> Column:
    return host_in(host(url), fc.NEVER_A_STREAM_HOSTS)


def is_safe_redirect(url: Column) -> Column:
    return ~url.rlike(r"[\x00-\x1f\x7f]") & scheme(url).isin("http", "https")


def strip_query(text: Column) -> Column:
    """Cut the query string of every URL inside a text."""
    return sub(text, fc.URL_QUERY, "$1")


def bare_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), path(url))


def scrub_credentials(text: Column) -> Column:
    return F.regexp_replace(text, fc.CREDENTIAL, "$1REDACTED")


def _resolve_dots(segments: Column) -> Column:
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(kept, "/")


def join_base(base: Column) -> Column:
    """What `url_join` needs of a base URL. Compute it once per row where many references are joined with one base."""
    parts = F.struct(scheme(base).alias("scheme"), netloc(base).alias("net"), path(base).alias("path"), query(base).alias("query"))
    return let(
        parts,
        lambda p: F.struct(
            base.alias("url"), p["scheme"].alias("scheme"), p["net"].alias("net"), p["path"].alias("path"), p["query"].alias("query"),
            F.concat(p["scheme"], F.lit("://"), p["net"]).alias("origin"),
            F.concat(p["scheme"], F.lit("://"), p["net"], F.when(p["path"] == "", F.lit("/")).otherwise(
                F.regexp_replace(p["path"], r"[^/]*$", ""))).alias("prefix"),
            F.when(p["path"] == "", F.lit("/")).otherwise(F.regexp_replace(p["path"], r"[^/]*$", "")).alias("dir"),
            ((p["scheme"] != "") & (p["net"] != "") & ~p["path"].rlike(r"(?:^|/)\.{1,2}(?:/|$)") & ~F.contains(p["path"], F.lit("//"))).alias("plain"),
        ),
    )


_ABSOLUTE = r"^https?://[^/?#\s]+[^#?\s]*(?:\?[^#\s]+)?(?:#\S+)?$"
# References that need no more than a prefix: no scheme, no dot segments, no empty segments, no fragment, no blank query.
_SIMPLE_REL = r"^(?![^?]*/\.{0,2}(?:/|$|\?))(?!\.{1,2}(?:/|$|\?))[^/?#:\s][^?#:\s]*(?:\?[^#\s]+)?$"
_SIMPLE_ABS = r"^(?=/[^/])(?![^?]*/\.{1,2}(?:/|$|\?))[^?#\s]*(?:\?[^#\s]+)?$"


# A bare file name, perhaps with a query: by far the most common reference.
FILE_NAME = r"^[A-Za-z0-9_~-][A-Za-z0-9_~.-]*(?:\?[^#\s]+)?$"


def url_join(base: Column, ref: Column) -> Column:
    """The absolute form of a reference found on a page."""
    return let(join_base(base), lambda b: join_with(b, ref))


def join_with(base: Column, ref: Column) -> Column:
    """The absolute form of a reference, for a base prepared with `join_base`."""
    return (
        F.when(base["plain"] & ref.rlike(FILE_NAME), F.concat(base["prefix"], ref))
        .when((base["url"] == "") | ref.rlike(_ABSOLUTE), ref)
        .when(ref == "", base["url"])
        .when(base["plain"] & ref.rlike(_SIMPLE_REL), F.concat(base["origin"], base["dir"], ref))
        .when(base["plain"] & ref.rlike(_SIMPLE_ABS), F.concat(base["origin"], ref))
        .otherwise(let(_reference(ref), lambda r: _join_parts(base, r)))
    )


def _reference(ref: Column) -> Column:
    return F.struct(
        ref.alias("url"), scheme(ref).alias("scheme"), netloc(ref).alias("net"), path(ref).alias("path"), query(ref).alias("query"),
        fragment(ref).alias("fragment"),
    )


def _join_parts(b: Column, r: Column) -> Column:
    rooted = r["path"].startswith("/")
    segments = F.when(rooted, F.split(r["path"], "/")).otherwise(_inner_non_empty(F.concat(b["dir"], r["path"])))
    merged = let(segments, _resolve_dots)
    merged = F.when(merged == "", F.lit("/")).otherwise(merged)
    new_path = F.when(r["net"] != "", r["path"]).when(r["path"] == "", b["path"]).otherwise(merged)
    new_query = F.when((r["net"] == "") & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    net = F.when(r["net"] != "", r["net"]).otherwise(b["net"])
    slash = lambda p: F.when((net != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    built = F.concat(
        F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit("://"))).otherwise(F.lit("")),
        net,
        let(new_path, slash),
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(F.lit("")),
        F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(F.lit("")),
    )
    return F.when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), r["url"]).otherwise(built)


def _inner_non_empty(path_col: Column) -> Column:
    return let(
        F.split(path_col, "/"), lambda parts: F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == F.size(parts) - 1))
    )
