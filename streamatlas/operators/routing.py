"""Routing of a target to the resolver that can open it: ordered rules, the first match wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..fixed import embeds as fe
from ..functions import urls
from ..functions.regex import has, let

# A rule is a resolver name and a test of (url, host, path).
Rule = tuple[str, Callable[[Column, Column, Column], Column]]

RESOLVERS = (
    "ytdlp", "direct", "metatag", "baltic", "ipcamlive", "skyline", "earthcam", "wetmet", "hdontap", "ozolio", "viewsurf",
)


def _contains(*needles: str):
    def test(u: Column, _host: Column, _path: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(u, F.lit(n)) for n in needles])

    return test


def _on_host(domain: str, path_test: Callable[[Column], Column]):
    return lambda _u, host, path: urls.host_in(host, (domain,)) & path_test(path)


def is_alias_page(u: Column) -> Column:
    return has(u, fe.IPCAM_ALIAS, ignore_case=True)


# The rules in order. Provider rules look at host and path, so that a URL that merely carries a provider's
# address in its query does not reach that provider's resolver.
RULES: tuple[Rule, ...] = (
    ("baltic", _contains("balticlivecam.com")),
    ("ipcamlive", lambda u, _h, _p: F.contains(u, F.lit("ipcamlive.com/player/player.php")) | is_alias_page(u)),
    ("metatag", _on_host("feratel.com", lambda p: F.contains(p, F.lit("/webtv")))),
    ("wetmet", _contains("api.wetmet.net/widgets/stream/frame.php")),
    ("skyline", _contains("skylinewebcams.com/en/webcam/")),
    ("earthcam", _contains("earthcam.")),
    ("hdontap", _on_host("hdontap.com", lambda p: p.startswith("/stream/"))),
    ("ozolio", _on_host("ozolio.com", lambda p: F.contains(p, F.lit("/explore/")))),
    ("viewsurf", _on_host("joada.net", lambda p: p.startswith("/embeded/embeded.html"))),
    ("ytdlp", _contains("twitch.tv/")),
    ("ytdlp", _contains("youtube.com", "youtu.be", "twitch.tv", "dailymotion.com", "earthcam")),
    ("direct", _contains(".m3u8", "worldcams.tv/player?url=")),
)


def route(target: Column, rules: Sequence[Rule] = RULES, known: Sequence[str] = RESOLVERS) -> Column:
    """Name of the first rule that matches, or null. Rules that name an unknown resolver are refused up front."""
    unknown = sorted({name for name, _ in rules} - set(known))
    if unknown:
        raise ValueError(f"rules name unknown resolvers: {unknown}")

    def pick(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, test in reversed(rules):
            out = F.when(test(p["url"], p["host"], p["path"]), F.lit(name)).otherwise(out)
        return out

    parts = F.struct(target.alias("url"), urls.host(target).alias("host"), urls.path(target).alias("path"))
    return let(parts, pick)
