"""SF17, SF19, SF21, SF32, SF33, P11, P14: URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .expr import blank_to_null, c, contains_any, first_group, let, strip, strip_chars, text

URL_EDGES = " \t\r\n\"'<>[]()（）【】,;，；。"


def clean_url(value: Column | str) -> Column:
    """SF17: first URL of a mixed text, protocol added to ``//``, marks stripped."""
    s = strip(text(value))
    url = F.coalesce(blank_to_null(F.regexp_extract(s, r"""https?://[^\s"'<>]+""", 0)), s)
    url = F.regexp_replace(url, "^//", "https://")
    return strip_chars(url, URL_EDGES)


def netloc(url: Column | str) -> Column:
    """Lower-case authority of a URL, empty when there is none."""
    return F.lower(F.regexp_extract(strip(text(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def host(url: Column | str, drop_www: bool = False) -> Column:
    """Authority without port; ``www.`` removed on request."""
    h = F.substring_index(netloc(url), ":", 1)
    return F.regexp_replace(h, r"^www\.", "") if drop_www else h


def mixed_host(value: Column | str) -> Column:
    """SF17: host of the first URL inside a mixed text, null when none."""
    url = F.regexp_extract(text(value), r"https?://[^\s,，；;]+", 0)
    return blank_to_null(host(url, drop_www=True))


def domain_root(value: Column | str) -> Column:
    """SF17: organisation root, three labels for the known second-level suffixes."""

    def root(parts: Column) -> Column:
        n = F.size(parts)
        last2 = F.array_join(F.slice(parts, -2, 2), ".")
        return (
            F.when(n == 0, F.lit(""))
            .when(n == 1, F.get(parts, F.lit(0)))
            .when((n >= 3) & last2.isin(V.SECOND_LEVEL_SUFFIXES), F.array_join(F.slice(parts, -3, 3), "."))
            .otherwise(last2)
        )

    h = strip_chars(F.lower(strip(F.substring_index(text(value), ":", 1))), ".")
    return let(F.filter(F.split(h, r"\."), lambda p: p != ""), root)


def dot_suffixes(value: Column | str) -> Column:
    """All suffixes of a host that start at a label: a.b.c, b.c, c."""
    parts = F.split(c(value), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )


def low_quality(url: Column | str, hints=tuple(V.LOW_QUALITY_HOSTS)) -> Column:
    """P11."""
    return contains_any(netloc(url), hints)


def is_edu(host_col: Column) -> Column:
    return host_col.contains(".edu.cn") | host_col.endswith(".edu")


def is_gov(host_col: Column) -> Column:
    return host_col.contains(".gov.cn")


def query_param(url: Column | str, name: str) -> Column:
    """First value of a query parameter, percent-decoded; null when absent or broken."""
    query = F.regexp_extract(text(url), r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return blank_to_null(F.try_url_decode(raw))


def unwrap_redirect(url: Column | str, host_word: str = "bing.com", path_word: str = "/ck/") -> Column:
    """SF19: target of a search redirect link, the link itself when it cannot be read."""
    u = text(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)

    def target(raw: Column) -> Column:
        body = F.when(raw.startswith("a1"), raw.substr(3, 1 << 20)).when(raw.startswith("a"), raw.substr(2, 1 << 20)).otherwise(raw)
        b64 = F.translate(body, "-_", "+/")
        pad = F.when(F.length(b64) % 4 == 2, F.lit("==")).when(F.length(b64) % 4 == 3, F.lit("=")).otherwise(F.lit(""))
        decoded = F.try_to_binary(F.concat(b64, pad), F.lit("base64")).cast("string")
        plain = F.try_url_decode(raw)
        return (
            F.when(raw.rlike("^https?://"), raw)
            .when(decoded.rlike("^https?://"), decoded)
            .when(plain.rlike("^https?://"), plain)
        )

    wrapped = netloc(u).contains(host_word) & path.contains(path_word)
    first, second = (let(query_param(u, n), target) for n in ("u", "r"))
    return F.when(wrapped, F.coalesce(first, second, u)).otherwise(u)


def content_id(url: Column | str, html: Column | str) -> Column:
    """SF21: 32-digit hex id from the query string, else from the page source."""
    candidates = []
    for name in ["id", "contentId", "contentid", "articleId", "articleid"]:
        value = query_param(url, name)
        candidates.append(F.when(value.rlike("^[0-9a-fA-F]{32}$"), value))
    page = text(html)
    candidates.append(
        blank_to_null(
            F.regexp_extract(page, r"contentId\s*=\s*\$\.getAddrUrl\('id'\)\|\|'([0-9a-fA-F]{32})'", 1)
        )
    )
    candidates.append(blank_to_null(F.regexp_extract(page, r"[?&]id=([0-9a-fA-F]{32})", 1)))
    return F.coalesce(*candidates, F.lit(""))


def fetch_url(source_url: Column | str, official_url: Column | str) -> Column:
    """SF32: source URL when set, else the official one, cleaned."""
    source = strip(text(source_url))
    return clean_url(F.when(source != "", source).otherwise(text(official_url)))


def path_year(url: Column | str) -> Column:
    """SF33: three-digit year of a report path, 0 when absent."""
    year = F.regexp_extract(text(url), r"/apply_his_report/(\d{3})/", 1)
    return F.coalesce(blank_to_null(year).cast("int"), F.lit(0))


def system_dir(html: Column | str, year: int, kind: str) -> Column:
    """SF33: system directory of a query page by ordered fallbacks; null when none matches."""
    prefix = rf"\./system/(ColQry_{int(year)}"
    patterns = {
        "star": [prefix + r"[^/]+)/SGroup1\.htm", prefix + r"[^/]+)/"],
        "apply": [prefix + r"apply[^/]+)/", prefix + r"[^/]+)/QrybyStu", prefix + r"[^/]+)/"],
    }
    return first_group(text(html), patterns[kind])


def image_candidates(urls: Column | str, limit: int | None = 8, fallback: bool = False) -> Column:
    """Image URLs by suffix without stop words; optionally the unfiltered list when none is left."""
    suffix = contains_any
    kept = F.filter(
        c(urls),
        lambda u: suffix(F.lower(u), V.IMAGE_SUFFIXES) & ~suffix(F.lower(u), V.IMAGE_STOP_WORDS),
    )
    kept = F.slice(kept, 1, limit) if limit else kept
    return F.when(F.size(kept) == 0, c(urls)).otherwise(kept) if fallback else kept


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """SF20: absolute form of a link, with dot segments removed for relative paths."""
    return let(F.struct(text(base).alias("b"), strip(text(href)).alias("h")), lambda x: _resolved(x["b"], x["h"]))


def _resolved(b: Column, h: Column) -> Column:
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(b, r"^([^?#]*)", 1)
    path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")))
    joined = F.concat(folder, h)
    tidy = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(4):
        tidy = F.regexp_replace(tidy, r"(?<!/)/(?!\.\./)[^/?#]+/\.\./", "/")
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
        .when(h.startswith("?"), F.concat(page, h))
        .otherwise(tidy)
    )
