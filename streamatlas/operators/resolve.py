"""Resolution of targets to stream URLs, as joins with documents that were fetched before.

What a resolver needs of a document is cut out of it where the document is read (`document_facts`), so bodies never travel
through a shuffle: the joins move two short strings per document.

Inputs: bodies(url, body) holds one row per fetched document. A form post is landed under its URL with the form as query:
`<ajax url>?action=auth_token&id=<id>&embed=1`. tool_output(target_url, output) holds the landed output of the external tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import catalogue as fc
from ..fixed import embeds as fe
from ..functions import urls
from ..functions.regex import first, first_once, let, rx
from .keyed import materialise
from .routing import is_alias_page, route


def _is_object(doc: Column) -> Column:
    return F.schema_of_variant(doc).startswith("OBJECT")


def json_string(doc: Column, path: str) -> Column:
    """The string at a path of a parsed document; null when there is none or it is no string."""
    return F.when(
        F.schema_of_variant(F.variant_get(doc, path, "variant")) == "STRING", F.variant_get(doc, path, "string")
    )


def embedded_stream(body: Column) -> Column:
    """The stream URL of a player-data script, or null."""
    blob = F.regexp_extract(body, rx(fe.PLAYER_DATA, ignore_case=True, dot_all=True), 1)
    src = let(F.try_parse_json(blob), lambda doc: F.when(_is_object(doc), json_string(doc, "$.streamSrc")))
    return let(src, lambda s: F.when(F.contains(s, F.lit(".m3u8")), s))


def ajax_url(cam_id: Column) -> Column:
    return F.concat(F.lit(fe.BALTIC_AJAX + "?action=auth_token&id="), cam_id, F.lit("&embed=1"))


def _ozolio_init(cid: Column) -> Column:
    doc = urls.percent_encode(F.concat(F.lit(fe.OZOLIO_RELAY + "/pub.api?cmd=explore&oid=CID_"), cid, F.lit("&channel=0")))
    return F.concat(
        F.lit(fe.OZOLIO_RELAY + "/ses.api?cmd=init&oid=CID_"), cid, F.lit("&ver=5&channel=0&control=0&document="), doc
    )


def _ozolio_open(sid: Column) -> Column:
    return F.concat(F.lit(fe.OZOLIO_RELAY + "/ses.api?cmd=open&oid="), sid, F.lit("&output=1&format=M3U8&profile=AUTO"))


def document_facts(bodies: DataFrame) -> DataFrame:
    """(url, a, b): what the resolver of this document reads from it, one row per URL. Of a URL that was fetched several times the last fetch counts
    (column fetched_at, where there is one; ties and logs without times: the greatest pair, so that the result is always the same)."""
    url, body = F.col("url"), F.col("body")
    relay = url.startswith(fe.OZOLIO_RELAY + "/ses.api?cmd=")
    manifest_api = F.contains(url, F.lit(".joada.net/api/videos/manifest/"))
    kind = (
        F.when(url.startswith(fe.BALTIC_AJAX), "baltic-post")
        .when(relay & F.contains(url, F.lit("cmd=init")), "ozolio-init")
        .when(relay & F.contains(url, F.lit("cmd=open")), "ozolio-open")
        .when(manifest_api, "viewsurf-api")
        .otherwise(route(url))
    )
    none = F.lit(None).cast("string")
    pair = lambda a, b=none: F.struct(a.alias("a"), b.alias("b"))
    parsed = lambda fn: let(F.try_parse_json(body), fn)
    bad = lambda doc: F.when(doc.isNull(), F.lit("\0"))

    def read(k: Column) -> Column:
        return (
            F.when(k == "metatag", pair(first_once(body, fe.META_VIDEO, ignore_case=True)))
            .when(k == "baltic", pair(first_once(body, fe.BALTIC_ID, dot_all=True)))
            .when(k == "baltic-post", pair(first_once(body, fe.BALTIC_HLS, 0)))
            .when(k == "ipcamlive", pair(first_once(body, fe.IPCAM_ADDRESS), first_once(body, fe.IPCAM_STREAM)))
            .when(k == "skyline", pair(first_once(body, fe.SKYLINE_TOKEN)))
            .when(k == "earthcam", pair(F.replace(first_once(body, fe.EARTHCAM_HLS, 0), F.lit("\\/"), F.lit("/"))))
            .when(k == "wetmet", pair(first_once(body, fe.WETMET_HLS, 0)))
            .when(k == "hdontap", pair(embedded_stream(body)))
            .when(k == "ozolio-init", parsed(lambda d: pair(json_string(d, "$.session.id"), bad(d))))
            .when(k == "ozolio-open", parsed(lambda d: pair(json_string(d, "$.output.source"), F.coalesce(bad(d), json_string(d, "$.output.media")))))
            .when(k == "viewsurf-api", parsed(lambda d: pair(json_string(d, "$.m3u8"), F.when(_is_object(d), F.lit("object")))))
        )

    # A generator, so that documents of no resolver are left out without evaluating anything twice.
    found = F.array_compact(F.array(let(kind, read)))
    times = ["fetched_at"] if "fetched_at" in bodies.columns else []
    facts = bodies.where(body.isNotNull()).select("url", *times, F.inline(found))
    last = facts.groupBy("url").agg(F.max(F.struct(*times, "a", "b")).alias("_last"))
    return last.select("url", "_last.a", "_last.b", F.lit(True).alias("got"))


def first_hop(name: Column, target: Column) -> Column:
    """URL of the document the resolver reads first, or null when it reads none."""
    alias = F.concat(F.lit(fe.IPCAM_PLAYER), first(target, fe.IPCAM_ALIAS, ignore_case=True))
    return (
        F.when(name.isin("metatag", "baltic", "skyline", "earthcam", "wetmet", "hdontap"), target)
        .when(name == "ipcamlive", F.when(is_alias_page(target), alias).otherwise(target))
        .when(name == "ozolio", _ozolio_init(first(target, fe.OZOLIO_ID)))
        .when(name == "viewsurf", F.concat(F.lit(fe.VIEWSURF_HOSTS[0] + "/api/videos/manifest/"), first(target, fe.VIEWSURF_UUID)))
    )


def second_hop(name: Column, target: Column, a: Column) -> Column:
    session = F.when(a.rlike(fe.OZOLIO_SESSION), a)
    return (
        F.when(name == "baltic", ajax_url(a))
        .when(name == "ozolio", _ozolio_open(session))
        .when(name == "viewsurf", F.concat(F.lit(fe.VIEWSURF_HOSTS[1] + "/api/videos/manifest/"), first(target, fe.VIEWSURF_UUID)))
    )


def tool_result(output: Column, now: Column) -> tuple[Column, Column, Column]:
    """(url, ttl, error) of landed tool output: exactly one line, or an error."""
    text = F.regexp_replace(output, r"^\s+|\s+\z", "")
    lines = F.size(F.split(text, r"\r\n|[\n\r]"))
    ok = (text != "") & (lines == 1)
    url = F.when(ok, text)
    expire = F.nullif(F.regexp_extract(url, fe.YTDLP_EXPIRE, 1), F.lit(""))
    ttl = expire.try_cast("long") - now
    error = F.when(text.isNull() | (text == ""), F.lit(fe.ERR_YTDLP)).when(~ok, F.lit(fe.ERR_YTDLP_SPLIT))
    return url, ttl, error


def read_documents(bodies: DataFrame) -> DataFrame:
    """`document_facts`, written once. Whoever resolves over the same documents several times reads them here and gives the result in place of the bodies."""
    return materialise(document_facts(bodies), "facts")


def resolve(targets: DataFrame, bodies: DataFrame, tool_output: DataFrame | None = None, now: int | Column = 0) -> DataFrame:
    """(target_url, resolver, url, stream_type, ttl_seconds, error) for distinct targets (column target_url). bodies: documents, or what
    `read_documents` made of them."""
    now_col = now if isinstance(now, Column) else F.lit(now).cast("long")
    # Bodies are read once; both hops join the short facts cut out of them.
    facts = bodies if "got" in bodies.columns else read_documents(bodies)
    t = F.col("target_url")
    df = targets.select("target_url").withColumn("resolver", route(t))
    name = F.col("resolver")
    # Most targets read no document, or no second one. Their null keys would all meet in one partition; a key of their own, which no URL equals, spreads them.
    spread = lambda hop: F.coalesce(F.col(hop), F.concat(F.lit("\0"), t))
    df = df.withColumn("_hop1", first_hop(name, t)).withColumn("_key1", spread("_hop1"))
    df = df.join(facts.select(F.col("url").alias("_key1"), F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("got").alias("g1")),
                 "_key1", "left")
    df = df.withColumn("_hop2", second_hop(name, t, F.col("a1"))).withColumn("_key2", spread("_hop2"))
    df = df.join(facts.select(F.col("url").alias("_key2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("got").alias("g2")),
                 "_key2", "left")
    if tool_output is None:
        df = df.withColumn("output", F.lit(None).cast("string"))
    else:
        df = df.join(tool_output.select("target_url", "output"), "target_url", "left")
    a1, b1, g1, a2, b2, g2 = (F.col(c) for c in ("a1", "b1", "g1", "a2", "b2", "g2"))
    tool_url, tool_ttl, tool_error = tool_result(F.col("output"), now_col)
    bad_json = F.lit("\0")
    session_ok = F.coalesce(a1.rlike(fe.OZOLIO_SESSION), F.lit(False))
    live = F.coalesce((b2 == "LIVE") & F.contains(a2, F.lit("/hls-live/")), F.lit(False))
    # The first host that answers with an object decides, even if that object names no stream.
    api_object1, api_object2 = F.coalesce(b1 == "object", F.lit(False)), F.coalesce(b2 == "object", F.lit(False))
    api_url = F.nullif(F.when(api_object1, a1).when(api_object2, a2), F.lit(""))
    url = (
        F.when(name == "direct", urls.unwrap(t))
        .when(name.isin("metatag", "earthcam", "wetmet", "hdontap"), a1)
        .when(name == "skyline", F.concat(F.lit(fe.SKYLINE_MANIFEST), a1))
        .when(name == "ipcamlive", F.concat(F.regexp_replace(a1, "/+$", ""), F.lit("/streams/"), b1, F.lit("/stream.m3u8")))
        .when(name == "baltic", a2)
        .when((name == "ozolio") & session_ok & live, a2)
        .when(name == "viewsurf", api_url)
        .when(name == "ytdlp", tool_url)
    )
    fetch_failed = F.lit(fe.ERR_FETCH)
    error = (
        F.when(name == "metatag", F.when(g1, fe.ERR_META).otherwise(fetch_failed))
        .when(name == "ipcamlive", F.when(g1, fe.ERR_IPCAM).otherwise(fetch_failed))
        .when(name == "skyline", F.when(g1, fe.ERR_SKYLINE).otherwise(fetch_failed))
        .when(name == "earthcam", F.when(g1, fe.ERR_EARTHCAM).otherwise(fetch_failed))
        .when(name == "wetmet", F.when(g1, fe.ERR_WETMET).otherwise(fetch_failed))
        .when(name == "hdontap", F.when(g1, fe.ERR_HDONTAP).otherwise(fetch_failed))
        .when(
            name == "baltic",
            F.when(g1.isNull(), fetch_failed).when(a1.isNull(), F.lit(fe.ERR_BALTIC_ID)).when(g2.isNull(), F.lit(fe.ERR_POST))
            .otherwise(F.concat(F.lit(fe.ERR_BALTIC_HLS), a1)),
        )
        .when(
            name == "ozolio",
            F.when(F.col("_hop1").isNull(), F.lit(fe.ERR_OZOLIO_ID))
            .when(g1.isNull(), fetch_failed)
            .when(b1 == bad_json, F.lit(fe.ERR_OZOLIO_JSON))
            .when(~session_ok, F.lit(fe.ERR_OZOLIO_SESSION))
            .when(g2.isNull(), fetch_failed)
            .when(b2 == bad_json, F.lit(fe.ERR_OZOLIO_JSON))
            .when(F.coalesce(a2, F.lit("")) == "", F.lit(fe.ERR_OZOLIO_STREAM))
            .otherwise(F.lit(fe.ERR_OZOLIO_LOOP)),
        )
        .when(
            name == "viewsurf",
            F.when(F.col("_hop1").isNull(), F.lit(fe.ERR_VIEWSURF_UUID))
            .when(~(api_object1 | api_object2), F.lit(fe.ERR_VIEWSURF_HOSTS))
            .otherwise(F.lit(fe.ERR_VIEWSURF_HLS)),
        )
        .when(name == "ytdlp", tool_error)
    )
    fixed_ttl = F.lit(None).cast("long")
    for resolver, seconds in fe.RESOLVE_TTL.items():
        fixed_ttl = F.when(name == resolver, F.lit(seconds).cast("long")).otherwise(fixed_ttl)
    epoch_ms = F.nullif(F.regexp_extract(url, fe.BALTIC_EPOCH, 1), F.lit("")).try_cast("long")
    ttl = (
        F.when(name == "baltic", F.floor(epoch_ms / 1000) - now_col)
        .when(name == "ytdlp", tool_ttl)
        .otherwise(fixed_ttl)
    )
    is_mp4 = (name == "metatag") & F.contains(url, F.lit(".mp4"))
    return df.select(
        "target_url",
        "resolver",
        url.alias("url"),
        F.when(url.isNotNull(), F.when(is_mp4, "mp4").otherwise("hls")).alias("stream_type"),
        F.when(url.isNotNull(), ttl).alias("ttl_seconds"),
        F.when(url.isNull(), error).alias("error"),
    )


def error_detail(message: Column) -> Column:
    """An error message fit for counting: query strings of URLs cut, at most a fixed number of characters."""
    return F.substring(urls.strip_query(message), 1, fc.DETAIL_CHARS)


