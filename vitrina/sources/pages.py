"""Saved web pages: town tables and listing detail pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vitrina import defaults, model
from vitrina.functions.text import clean_rating, clean_text, phone_in, phone_like, text

# The parts of a town table.
_TABLE = r'(?s)<table[^>]*class="[^"]*wikitable[^"]*"[^>]*>(.*?)</table>'
_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
_CELL = r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"


def _cell_text(cell: Column) -> Column:
    plain = F.regexp_replace(F.replace(cell, F.lit("&nbsp;"), F.lit(" ")), "<[^>]+>", "")
    for entity, sign in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return clean_text(plain)


def _once(c: Column) -> Column:
    """'Madrid Madrid' and 'MadridMadrid' give 'Madrid'."""
    return F.trim(F.regexp_replace(c, r"\A(.+?) ?\1\z", "$1"))


def towns_from_html(
    pages: DataFrame, html: str = "html", min_population: int = defaults.MIN_TOWN_POPULATION
) -> DataFrame:
    """rank, name, population, province, region of all town tables of a page."""
    own = [c for c in pages.columns if c != html]

    def all_of(column: str, pattern: str) -> Column:
        return F.regexp_extract_all(column, F.lit(pattern), F.lit(1))

    tables = pages.select(*own, F.posexplode(all_of(html, _TABLE)).alias("table_pos", "_table"))
    rows = tables.select(
        *own, "table_pos", F.posexplode(all_of("_table", _ROW)).alias("row_pos", "_row")
    )
    cells = rows.select(*own, "table_pos", "row_pos", all_of("_row", _CELL).alias("_cells")).where(
        F.size("_cells") >= 5
    )

    def cell(i: int) -> Column:
        return _cell_text(F.get("_cells", F.lit(i)))

    digits = F.regexp_replace(cell(2), r"(?U)[^\d]", "")
    return (
        cells.select(
            *own,
            "table_pos",
            "row_pos",
            F.regexp_extract(cell(0), r"\A(\d+)", 1).try_cast("long").alias("rank"),
            _once(cell(1)).alias("name"),
            F.coalesce(digits.try_cast("long"), F.lit(0)).alias("population"),
            _once(cell(3)).alias("province"),
            _once(cell(4)).alias("region"),
        )
        .where(F.col("rank").isNotNull())
        .where(F.col("population") >= min_population)
        .where((F.col("name") != "") & (F.col("region") != ""))
    )


class _DetailPage(HTMLParser):
    """Collects text and attributes of the elements a detail page is read by."""

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr"}
    _BREAKS = {"br", "p", "div", "li", "tr", "h1", "h2", "h3"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Of each element: tag, attributes, where its text begins and ends among the pieces.
        self.elements: list[list] = []
        self._pieces: list[str] = []
        self._open: list[tuple[str, int]] = []
        self._open_tags: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in self._BREAKS:
            self.handle_data(" ")
        if tag not in self._VOID:
            self._open.append((tag, len(self.elements)))
            self._open_tags[tag] += 1
        at = len(self._pieces)
        self.elements.append([tag, dict(attrs), at, at])

    def handle_endtag(self, tag):
        while self._open_tags[tag]:
            name, i = self._open.pop()
            self._open_tags[name] -= 1
            self.elements[i][3] = len(self._pieces)
            if name == tag:
                break
        if tag in self._BREAKS:
            self.handle_data(" ")

    def handle_data(self, data):
        if not (self._open_tags["script"] or self._open_tags["style"]):
            self._pieces.append(data)

    def close(self):
        super().close()
        for _, i in self._open:
            self.elements[i][3] = len(self._pieces)

    def matching(self, test, most: int) -> list[tuple[str, dict]]:
        """Text and attributes of the first ``most`` elements that pass the test."""
        found = islice((e for e in self.elements if test(e[0], e[1])), most)
        return [("".join(self._pieces[start:end]), attrs) for _, attrs, start, end in found]


def _attr(name: str, part: str, tags: tuple[str, ...] = ()):
    return lambda tag, attrs: (not tags or tag in tags) and part in (attrs.get(name) or "")


# Where a detail page keeps each field, in order of preference.
_PHONES = [
    lambda tag, attrs: (attrs.get("data-item-id") or "").startswith("phone"),
    _attr("aria-label", "Teléfono", ("button",)),
    _attr("aria-label", "Phone", ("button",)),
    _attr("aria-label", "Teléfono", ("a",)),
    _attr("aria-label", "Phone", ("a",)),
]
_CATEGORIES = [
    _attr("jsaction", "pane.rating.category", ("button",)),
    lambda tag, attrs: tag == "button" and "DkEaL" in (attrs.get("class") or "").split(),
    _attr("aria-label", "Categoría", ("div",)),
]
_RATING_TRIES = 12

_RAW = (
    "url string, name string, phones array<string>, address string, site_text string, "
    "site_href string, stars string, numbers array<string>, categories array<string>, "
    "any_phone string, source_query string, retrieved_at_utc string, town string, seq long"
)
_GIVEN = ["any_phone", "source_query", "retrieved_at_utc", "town", "seq"]


def _read_details(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [_detail(url, html or "") for url, html in zip(batch["url"], batch["html"])]
        names = [c.split()[0] for c in _RAW.split(", ")]
        out = pd.DataFrame(read, columns=names[: -len(_GIVEN)])
        for name in _GIVEN:
            out[name] = batch[name].to_numpy()
        yield out


def _detail(url: str, html: str) -> tuple:
    page = _DetailPage()
    page.feed(html)
    page.close()

    def first(test) -> tuple[str, dict]:
        return next(iter(page.matching(test, 1)), ("", {}))

    def item(name: str) -> tuple[str, dict]:
        return first(lambda tag, a: tag in ("button", "a") and a.get("data-item-id") == name)

    phones = []
    for test in _PHONES:
        words, attrs = first(test)
        phones += [words, attrs.get("aria-label") or ""]
    site, site_attrs = item("authority")
    _, stars = first(
        lambda tag, a: tag == "div" and a.get("role") == "img"
        and "estrellas" in (a.get("aria-label") or "")
    )
    hidden = page.matching(
        lambda tag, a: tag == "span" and a.get("aria-hidden") == "true", _RATING_TRIES
    )
    return (
        url,
        first(lambda tag, a: tag == "h1")[0],
        phones,
        item("address")[0],
        site,
        site_attrs.get("href") or "",
        (stars.get("aria-label") or "").split(" ")[0],
        [words for words, _ in hidden],
        [first(test)[0] for test in _CATEGORIES],
    )


def listings_from_detail_pages(
    pages: DataFrame,
    source_query: Column,
    retrieved_at_utc: Column,
    town: Column | None = None,
    seq: Column | None = None,
) -> DataFrame:
    """Listings of saved detail pages (url, html).

    Query, time, the town the page was collected for and the place in arrival order may
    be columns of the page table; with ``seq`` the result has that column as well.

    Only taking the page apart is Python, one page at a time on the scan; the
    rules that choose and clean the values are column expressions. The web
    address is the link's text when that is an address, else its target.
    """
    # The page's whole source is the last resort for a phone number.
    given = {
        "any_phone": phone_in(F.col("html")),
        "source_query": source_query.cast("string"),
        "retrieved_at_utc": retrieved_at_utc.cast("string"),
        "town": F.lit("") if town is None else text(town),
        "seq": F.lit(0).cast("long") if seq is None else seq.cast("long"),
    }
    raw = pages.select("url", "html", *[v.alias(n) for n, v in given.items()]).mapInPandas(
        _read_details, _RAW
    )
    phones = F.transform("phones", lambda p: phone_like(clean_text(p)))
    ratings = F.transform("numbers", clean_rating)
    site = clean_text(F.col("site_text"))
    site_is_address = site.rlike(r"\A(https?://\S+|[\w-]+(\.[\w-]+)+(/\S*)?)\z")
    fields = {
        "nombre": clean_text(F.col("name")),
        "telefono": _first_filled(F.array_append(phones, F.col("any_phone"))),
        "direccion": clean_text(F.col("address")),
        "web": F.when(site_is_address, site).otherwise(clean_text(F.col("site_href"))),
        "rating": _first_filled(F.array_prepend(ratings, clean_rating(F.col("stars")))),
        "categoria": _first_filled(F.transform("categories", clean_text)),
        "source_query": F.col("source_query"),
        "retrieved_at_utc": F.col("retrieved_at_utc"),
        "maps_url": text(F.col("url")),
        "municipio_origen": F.col("town"),
        "lat": F.lit(""),
        "lon": F.lit(""),
    }
    order = [] if seq is None else ["seq"]
    return raw.select(*[fields[c].alias(c) for c in model.LISTING_COLUMNS], *order)


def _first_filled(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))
