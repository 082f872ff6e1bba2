"""URL parsing and RFC 3986 joining as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions.expressions import let

# Scheme, host, path without the parameters of its last segment, parameters, query, fragment.
_PARTS = (
    r"(?s)\A(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?((?:[^?#]*/)?[^/;?#]*)(?:;([^/?#]*))?(?:\?([^#]*))?(?:#(.*))?\z"
)
_PART_NAMES = ("scheme", "netloc", "path", "params", "query", "fragment")


def _clean(c: Column) -> Column:
    """Drop leading control characters and blanks, and tabs and line breaks anywhere."""
    return F.ltrim(F.translate(c, "\t\r\n", ""), F.lit("".join(map(chr, range(0x21)))))


def split_url(c: Column) -> Column:
    """struct<scheme,netloc,path,params,query,fragment>; absent parts are empty strings."""
    # A cleaned URL has no line break, so one match and one split give all parts.
    joined = F.regexp_replace(_clean(c), _PARTS, "\n".join(f"${i}" for i in range(1, 7)))

    def parts(found: Column) -> Column:
        fields = [F.get(found, F.lit(i)).alias(name) for i, name in enumerate(_PART_NAMES)]
        return F.struct(F.lower(F.get(found, F.lit(0))).alias("scheme"), *fields[1:])

    return let(F.split(joined, "\n"), parts)


def _has_bad_brackets(netloc: Column) -> Column:
    return F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))


def is_http_url(c: Column) -> Column:
    """An http or https URL that names a host."""
    return let(
        split_url(c), lambda u: u["scheme"].isin("http", "https") & (u["netloc"] != "") & ~_has_bad_brackets(u["netloc"])
    )


def _with(prefix: str, part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(prefix), part))


def _build(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        scheme, F.lit("://"), netloc, rooted, _with(";", params), _with("?", query), _with("#", fragment)
    )


def _resolve_path(base_path: Column, path: Column) -> Column:
    """Merge a relative path into the base path and remove dot segments."""
    folder = let(F.split(base_path, "/"), lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))

    def merged(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == last))

    relative = let(F.concat(folder, F.split(path, "/")), merged)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    # Most links are rooted and have no dot segments.
    settled = path.startswith("/") & ~F.contains(path, F.lit("/."))

    def walk(all_segments: Column) -> Column:
        kept = F.aggregate(
            all_segments,
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s))),
        )
        ends_in_dots = F.element_at(all_segments, -1).isin(".", "..")
        joined = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)

    return F.when(settled, path).otherwise(let(segments, walk))


def resolve_from(base: Column, b: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``, whose split form is ``b``; null when it is malformed."""

    def join(u: Column) -> Column:
        foreign = (u["scheme"] != "") & (u["scheme"] != b["scheme"])
        no_path = (u["path"] == "") & (u["params"] == "")
        other_host = u["netloc"] != ""

        def on_this_host(path: Column) -> Column:
            params = F.when(no_path, b["params"]).otherwise(u["params"])
            query = F.when(no_path & (u["query"] == ""), b["query"]).otherwise(u["query"])
            return _build(b["scheme"], b["netloc"], path, params, query, u["fragment"])

        path = F.when(no_path, b["path"]).otherwise(_resolve_path(b["path"], u["path"]))
        return (
            F.when(F.coalesce(href, F.lit("")) == "", base)
            .when(_has_bad_brackets(u["netloc"]), F.lit(None).cast("string"))
            .when(foreign, href)
            .when(other_host, _build(b["scheme"], u["netloc"], u["path"], u["params"], u["query"], u["fragment"]))
            .otherwise(let(path, on_this_host))
        )

    return let(split_url(href), join)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base`` (an http or https URL); null when it is malformed."""
    return let(split_url(base), lambda b: resolve_from(base, b, href))
