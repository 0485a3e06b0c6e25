"""Addresses, links and network paths in text, as Column expressions with the junk filters of a forensic scan."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Generic top-level domains that a found address may end in; country codes come from the ISO list of the JVM.
GENERIC_TLDS = "com org net edu gov mil int info biz app dev io co me ai tv mobi name pro aero asia jobs museum tel travel".split()
# Country-code domains that are no ISO country.
EXTRA_COUNTRY_TLDS = "ac eu su uk".split()
# Hosts of metadata namespaces, which are no links.
NAMESPACE_HOSTS = ["ns.adobe.com", "www.w3.org", "purl.org", "xml.org", "schemas.microsoft.com", "iptc.org"]
# The three patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LINK = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"
UNC = r"\\\\[a-zA-Z0-9_\-.]+\\[a-zA-Z0-9_\-.$\\]+"


def top_level_domains(spark: SparkSession) -> list[str]:
    """Generic domains, ISO country codes and the few country domains beside them."""
    return [*GENERIC_TLDS, *sorted(c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()), *EXTRA_COUNTRY_TLDS]


def _many(s: Column, chars: str) -> Column:
    """How many characters of s are in the class."""
    return F.length(F.regexp_replace(s, f"[^{chars}]", ""))


def _cut(s: Column, pattern: str) -> Column:
    return F.regexp_replace(s, pattern, "")


def is_email(mail: Column, tlds: list[str]) -> Column:
    """Whether a hit of EMAIL looks like an address and not like binary junk."""
    user, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    body, tld = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.lower(F.substring_index(domain, ".", -1))
    edges = ~(user.startswith("-") | user.endswith("-") | body.startswith("-") | body.endswith("-"))
    camel = (_many(domain, "A-Z") >= 2) & (_many(domain, "a-z") >= 2)
    return (
        (F.length(mail) >= 7) & edges & tld.isin(tlds) & (_many(mail, "0-9") <= F.length(mail) * 0.4) & (_many(mail, "aeiouyAEIOUY") > 0)
        & (_many(mail, "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ") / F.length(mail) <= 0.8) & ~camel & ~mail.rlike(r"(.)\1{3,}")
    )


def emails(text: Column, tlds: list[str]) -> Column:
    """Distinct addresses of a text, sorted."""
    return F.array_sort(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))), lambda m: is_email(m, tlds)))


def link_host(link: Column) -> Column:
    return F.regexp_extract(link, r"://([^/]*)", 1)


def links(text: Column) -> Column:
    """Distinct links of a text without trailing punctuation and namespace hosts, sorted."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: _cut(u, r"[.,;:?!)\]]+$")))
    return F.array_sort(F.filter(found, lambda u: (u != "") & ~F.lower(link_host(u)).isin(NAMESPACE_HOSTS)))


def unc_paths(text: Column) -> Column:
    r"""Distinct \\server\share paths that look like names, sorted."""

    def good(p: Column) -> Column:
        parts = F.split(F.regexp_replace(p, r"^\\+", ""), r"\\")
        share = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
        vowels = (_many(p, "a-zA-Z") == 0) | (_many(p, "aeiouyAEIOUY") > 0)
        camel = (_many(p, "A-Z") >= 2) & (_many(p, "a-z") >= 2)
        return (F.length(F.element_at(parts, 1)) >= 3) & (F.length(share) >= 3) & vowels & ~camel & (_many(p, "0-9") <= F.length(p) * 0.4)

    return F.array_sort(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(UNC), F.lit(0))), good))
