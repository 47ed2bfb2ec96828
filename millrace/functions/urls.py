"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon as L

_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\s\[\]]+)(?::([0-9]*))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"
#: What a path may hold as it is; anything else is percent-encoded.
_NO_PATH = "[^!-~]|[\"<>`{}]"


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def _plain_path(raw: Column) -> Column:
    """A path without "." and ".." segments and with what it can't hold encoded; "/" for an empty one."""
    parts = F.split(raw, "/")
    last = F.element_at(parts, -1)
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x))
    kept = F.concat(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    short = F.when(raw.rlike(r"/\.\.?(/|$)"), kept).otherwise(raw)
    coded = F.array_join(F.transform(F.split(short, ""), lambda c: F.when(c.rlike(_NO_PATH), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(raw == "", "/").otherwise(F.when(short.rlike(_NO_PATH), coded).otherwise(short))


def _kept_query(raw: Column) -> Column:
    """The parameters that don't only track, sorted by name, encoded as forms are; empty or with "?" in front."""
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    each = F.transform(F.filter(F.split(raw, "&"), lambda x: x != ""), lambda x, i: F.named_struct(F.lit("k"), read(F.substring_index(x, "=", 1)), F.lit("i"), i, F.lit("v"), read(F.when(F.contains(x, F.lit("=")), F.substring(x, F.locate("=", x) + 1, F.length(x))).otherwise(""))))
    kept = F.array_sort(F.filter(each, lambda x: ~(F.lower(x["k"]).isin(*L.TRACKING) | F.startswith(F.lower(x["k"]), F.lit("utm_")))))
    joined = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.when(raw == "", "").otherwise(F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def canonical_url(raw: Column, base: Column | None = None) -> Column:
    """The canonical form of an http(s) URL, resolved against base if given, or null.

    Lower-case host, no fragment, no default port, no tracking parameters, the others sorted by name, "/" for an empty
    path; http becomes https where the base is https on the same host and the port is the usual one. Native throughout.
    """
    full = _stripped(raw) if base is None else _resolved(_stripped(raw), base)
    parts = F.named_struct(*(x for k, n in enumerate(("scheme", "host", "port", "path", "query"), 1) for x in (F.lit(n), F.regexp_extract(full, _PARTS, k))))  # named, as aliases are lost beside a generator

    def build(p: Column) -> Column:
        scheme, name = F.lower(p["scheme"]), F.lower(p["host"])
        usual = (p["port"] == "") | ((scheme == "http") & (p["port"].cast("int") == 80)) | ((scheme == "https") & (p["port"].cast("int") == 443))
        if base is not None:
            scheme = F.when((scheme == "http") & usual & (F.lower(F.regexp_extract(base, _PARTS, 1)) == "https") & (F.lower(F.regexp_extract(base, _PARTS, 2)) == name), "https").otherwise(scheme)
        url = F.concat(scheme, F.lit("://"), name, F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"].cast("int").cast("string"))), _plain_path(p["path"]), _kept_query(p["query"]))
        return F.when(F.lower(p["scheme"]).isin("http", "https") & (name != "") & ((p["port"] == "") | (p["port"].cast("int") < 65536)), url)

    return _bound(parts, build)


def _resolved(raw: Column, base: Column) -> Column:
    """A reference as a full URL, dot segments still in it."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.concat(F.regexp_replace(path(base), "[^/]*$", ""), F.when(path(base) == "", "/").otherwise(""))
    return (
        F.when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") | base.isNull(), raw).when(F.startswith(raw, F.lit("//")), F.concat(F.substring_index(base, ":", 1), F.lit(":"), raw)).when(F.startswith(raw, F.lit("/")), F.concat(origin, raw))
        .when(F.startswith(raw, F.lit("?")), F.concat(origin, path(base), raw)).when((raw == "") | F.startswith(raw, F.lit("#")), F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(origin, folder, raw))
    )


def resolved_url(raw: Column, base: Column) -> Column:
    return canonical_url(raw, base)


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def without_slash(url: Column) -> Column:
    """One trailing slash less, but not on a root path."""
    return F.when(F.length(path(url)) > 1, F.regexp_replace(url, r"^([^?#]*[^/])/((?:\?.*)?)$", "$1$2")).otherwise(url)


def same_section(a: Column, b: Column) -> Column:
    """Same host and the same first two path segments, or as many as both have; never for root paths."""
    x, y = segments(a), segments(b)
    n = F.least(F.lit(2), F.size(x), F.size(y))
    return F.coalesce((host(a) == host(b)) & (n > 0) & (F.slice(x, 1, F.greatest(n, F.lit(1))) == F.slice(y, 1, F.greatest(n, F.lit(1)))), F.lit(False))


def _plain(segment: Column) -> Column:
    return F.regexp_replace(F.lower(segment), r"[\s_\-]+", "")


def acts(url: Column) -> Column:
    """Whether requesting the URL could end a session or change something."""
    s = F.transform(segments(url), _plain)
    pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.concat(a, b))
    pars = F.split(query(url), "&")
    action = F.exists(pars, lambda p: F.lower(F.split(p, "=")[0]).isin("action", "do", "cmd", "op", "method") & _plain(F.element_at(F.split(p, "="), -1)).isin(*L.ACTIONS))
    return F.arrays_overlap(s, F.array(*map(F.lit, L.ACTING_SEGMENTS))) | F.coalesce(F.exists(pairs, lambda p: p.isin(*L.ACTING_PAIRS)), F.lit(False)) | action


def binary(url: Column) -> Column:
    return url.rlike(L.BINARY) | path(url).rlike(L.ATTACHMENT)


def glob(pattern: str) -> str:
    """An anchored regular expression for a pattern in which * stands for any text and ? for one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in "/_" else c for c in pattern) + "$"


def in_scope(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Not excluded, and included where anything is."""
    any_of = lambda ps: F.greatest(F.lit(False), *(url.rlike(glob(p)) for p in ps)) if ps else F.lit(False)
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))
