"""What a saved page's HTML says: platform, e-mail address, social handle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from vitrina import defaults
from vitrina.functions.text import business_slug, let, literal, text


def is_social(web: Column) -> Column:
    low = F.lower(web)
    hit = F.lit(False)
    for domain in defaults.SOCIAL_DOMAINS:
        hit = hit | low.contains(domain)
    return hit


def platform(
    html: Column,
    lower_html: Column,
    signatures: Sequence[tuple[str, str]] = defaults.PLATFORM_SIGNATURES,
    cart_words: Sequence[str] = defaults.CART_WORDS,
    strict: bool = False,
) -> Column:
    """Name of the first signature found, the generic label for a cart, else null.

    Signatures keep their letter case, cart words do not. By default a
    signature may start inside a word (``mage/`` is found in ``image/png``);
    ``strict`` asks for a non-letter before it.
    """

    def found(needle: str) -> Column:
        plain = html.contains(needle)
        if not strict:
            return plain
        return plain & html.rlike(rf"(?<![A-Za-z]){literal(needle)}")

    chain = None
    for name, needle in signatures:
        chain = (F if chain is None else chain).when(found(needle), name)
    for word in cart_words:
        chain = (F if chain is None else chain).when(
            lower_html.contains(word), defaults.UNKNOWN_PLATFORM
        )
    return chain


# Fixed value: the address pattern.
_LOCAL = r"[a-zA-Z0-9](?:[a-zA-Z0-9._+\-]*[a-zA-Z0-9])?"
_HOST = r"[a-zA-Z0-9](?:[a-zA-Z0-9.\-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,}"
EMAIL = f"{_LOCAL}@{_HOST}"

# The same matches, found in linear time: within a run of address characters
# only the first letter or digit after the run's start, or after the previous
# match, can begin a match, so no other start is tried.
_EMAIL_SEARCH = rf"(?:\G|(?<![a-zA-Z0-9._+\-]))[._+\-]*({EMAIL})"


def valid_email(address: Column) -> Column:
    def judge(v: Column) -> Column:
        extension = F.substring_index(v["domain"], ".", -1)
        digits_only = F.regexp_replace(v["local"], "[._-]", "").rlike(r"\A[0-9]+\z")
        return (
            ~extension.isin(*defaults.FILE_EXTENSIONS)
            & ~digits_only
            & ~v["local"].isin(*defaults.BLOCKED_LOCALS)
            & ~v["domain"].isin(*defaults.BLOCKED_DOMAINS)
        )

    low = F.lower(address)
    return let(
        F.struct(
            F.regexp_extract(low, r"\A(.*)@", 1).alias("local"),
            F.substring_index(low, "@", -1).alias("domain"),
        ),
        judge,
    )


def first_email(html: Column) -> Column:
    """First address in page order that looks like a person's; null without one."""
    found = F.regexp_extract_all(html, F.lit(_EMAIL_SEARCH), F.lit(1))
    return F.when(html.contains("@"), F.get(F.filter(found, valid_email), F.lit(0)))


def placeholder_email(name: Column) -> Column:
    return F.concat(F.lit("vmarketing@"), business_slug(name), F.lit(".com"))


def valid_handle(handle: Column) -> Column:
    low = F.lower(handle)
    return (
        low.rlike(r"\A[a-z0-9._]+\z")
        & ~low.isin(*defaults.RESERVED_HANDLES)
        & ~low.contains("..")
        & ~low.endswith(".")
    )


# The patterns for a profile link and for a breadcrumb.
PROFILE_URL = r"(?i)(?:https?:)?//(?:www\.)?instagram\.com/([A-Za-z0-9_.]{1,30})"
PROFILE_CRUMB = r"(?i)instagram\.com\s*›\s*([A-Za-z0-9_.]{1,30})\s*$"


def profile_link(handle: Column) -> Column:
    return F.concat(F.lit("https://instagram.com/"), handle)


def first_handle(html: Column) -> Column:
    """Link of the first valid profile handle in a page; null without one."""
    found = F.regexp_extract_all(html, F.lit(PROFILE_URL), F.lit(1))
    return profile_link(F.get(F.filter(found, valid_handle), F.lit(0)))


def profile_in(link: Column) -> Column:
    """Handle in a profile link, else in a breadcrumb, else ''."""
    by_url = F.nullif(F.regexp_extract(link, PROFILE_URL, 1), F.lit(""))
    return F.coalesce(by_url, F.regexp_extract(link, PROFILE_CRUMB, 1), F.lit(""))
