"""Main text of pages by union-free regular expressions inferred per host."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import keep
from vitrina.llm.urls import url_host

# Elements without content, elements whose content is no markup, and elements that end
# an open paragraph: fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that close an open one of the given kinds when they start.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
# Never main text: boilerplate elements, and elements whose class, id or role names such.
DROPPED = set(
    "head nav aside footer form script style noscript template select button menu dialog iframe "
    "svg canvas object textarea title search".split()
)
NOISE = re.compile(
    "(?:^|[^a-z])(?:ad|ads|advert[a-z]*|adbox|banner|sponsor[a-z]*|promo[a-z]*|nav|navbar|navigation|"
    "menu|breadcrumbs?|sidebar|masthead|header|footer|cookies?|consent|notices?|newsletter|subscribe|"
    "share|sharing|social|related|comments?|replies|reply|disqus|popup|modal|toolbar|pagination|pager|login)"
    "(?:$|[^a-z])"
)
# Names of blocks inside an article that are none of its text; a whole class or role says so.
INNER_NOISE = re.compile(
    "ad|ads|advert[a-z]*|adbox|banner|sponsor[a-z]*|promo[a-z]*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    "cookies?|consent|newsletter|subscribe|share|sharing|social|related|comments?|replies|disqus|popup|modal|"
    "toolbar|pagination|pager|login"
)
# Their ids are made from their text, or name it.
TEXTUAL = set("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre".split())
MAIN = ("article", "main")
HAS_MAIN = re.compile("<(?:article|main)(?=[\\s/>]|$)", re.I)
# Elements nested deeper than this count as lying at this depth.
DEPTH = 60

TOKEN = re.compile("<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<|[^<]+", re.S)
LABEL = re.compile("(?<![^\\s\"'/])(class|id|role|aria-label)\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", re.I)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, ""), ("text", text, "") in page order."""
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        if m is None:
            yield "text", page[at], ""
            at += 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group()[0] != "<" or m.group() == "<":
                yield "text", m.group(), ""
            continue
        tag = tag.lower()
        if m.group(1):
            yield "close", tag, ""
            continue
        yield "open", tag, m.group(3)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, at)
            at = end.start() if end else size


def _whole_noise(labels: list[tuple[str, str]]) -> bool:
    """Whether a class or role, as a whole, names a block that is no main text."""
    names = [n for k, v in labels if k.lower() in ("class", "role") for n in v.strip("\"'").lower().split()]
    return any(INNER_NOISE.fullmatch(n) for n in names)


def is_noise(tag: str, rest: str, in_main: bool) -> bool:
    """Whether an element's labels say that it is no main text."""
    labels = LABEL.findall(rest) if rest else []
    if tag in (*MAIN, "body", "html") or not labels:
        return False
    if in_main:
        return tag not in TEXTUAL and _whole_noise(labels)
    values = [v for k, v in labels if tag not in TEXTUAL or k.lower() != "id"]
    return bool(NOISE.search(" ".join(values).lower()))


def texts(page: str) -> Iterator[tuple[list[str], list[int], bool, str]]:
    """Path, its elements' numbers, whether a new block begins here, and text.

    The names of dropped elements end in "!". An element that holds an article or main
    element is not dropped for its labels, unless a class or role as a whole says noise
    (a list of comments) and another article or main element lies outside of it.
    """
    spared: set[int] = set()
    if HAS_MAIN.search(page):
        held: dict[int, int] = {}
        noise: set[int] = set()
        total = 0
        for opened, numbers, rest in _elements(page):
            if opened in MAIN:
                total += 1
                for n in numbers[:-1]:
                    held[n] = held.get(n, 0) + 1
            elif _whole_noise(LABEL.findall(rest) if rest else []):
                noise.add(numbers[-1])
        spared = {n for n, count in held.items() if n not in noise or count == total}
    return _texts(page, spared)


def _elements(page: str) -> Iterator[tuple[str, list[int], str]]:
    """Every element as it opens: tag, numbers of the open elements and its own, attributes."""
    opened: list[tuple[str, list[int], str]] = []
    for _ in _texts(page, set(), opened):
        yield from opened
        opened.clear()
    yield from opened


def _texts(
    page: str, spared: set[int], opened: list | None = None
) -> Iterator[tuple[list[str], list[int], bool, str]]:
    path: list[str] = []
    tags: list[str] = []
    numbers: list[int] = []
    fresh, number = True, 0

    def close(upto: str) -> None:
        while tags.pop() != upto:
            path.pop(), numbers.pop()
        path.pop(), numbers.pop()

    for kind, value, rest in events(page):
        if kind == "text":
            yield path[:DEPTH], numbers[:DEPTH], fresh, value
            fresh = False
            continue
        fresh = fresh or value in BLOCKS
        if kind == "close":
            if value in tags:
                close(value)
            continue
        if value in VOID:
            continue
        if value in BLOCKS and "p" in tags:
            close("p")
        while tags and tags[-1] in CLOSES.get(value, ()):
            close(tags[-1])
        in_main = any(t in MAIN for t in tags)
        dropped = value in DROPPED or (value == "header" and not in_main)
        number += 1
        dropped = dropped or (number not in spared and is_noise(value, rest, in_main))
        tags.append(value)
        path.append(value + "!" * dropped)
        numbers.append(number)
        if opened is not None and (value in MAIN or rest):
            opened.append((value, numbers[:] if value in MAIN else [number], rest))


# A wrapper is a tree: [tag, optional, repeated, constant, children]. A text has the tag
# "#"; its constant is None for a slot.


def page_wrapper(page: str) -> list:
    """The page's own expression: its tree, with runs of equal elements as repeated groups.

    The root's constant tells pages apart.
    """
    digest = hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    root: list = ["", False, False, digest, []]
    open_: list[list] = [root]
    above: list[int] = []
    for path, numbers, _, text in texts(page):
        text = " ".join(html.unescape(text).split())
        same = 0
        while same < min(len(numbers), len(above)) and numbers[same] == above[same]:
            same += 1
        del open_[same + 1 :]
        for tag in path[same:]:
            node = [tag, False, False, None, []]
            open_[-1][4].append(node)
            open_.append(node)
        above = numbers
        if text:
            open_[-1][4].append(["#", False, False, text if len(text) < 200 else None, []])
    return _folded(root)


def _folded(node: list) -> list:
    """Siblings of one tag that follow one another become one repeated group."""
    kids: list[list] = []
    for kid in node[4]:
        kid = _folded(kid)
        if kids and kids[-1][0] == kid[0]:
            merged = merge(kids[-1], kid)
            merged[2] = True
            kids[-1] = merged
        else:
            kids.append(kid)
    return [*node[:4], kids]


def merge(a: list, b: list) -> list:
    """One expression for both: what differs becomes a slot, an optional or a repeated group."""
    constant = a[3] if a[3] == b[3] else None
    one, two = [k[0] for k in a[4]], [k[0] for k in b[4]]
    kids: list[list] = []
    for what, i, j, m, n in SequenceMatcher(None, one, two, autojunk=False).get_opcodes():
        if what == "equal":
            kids += [merge(x, y) for x, y in zip(a[4][i:j], b[4][m:n])]
        else:
            kids += [[k[0], True, *k[2:]] for k in [*a[4][i:j], *b[4][m:n]]]
    squeezed: list[list] = []
    for kid in kids:
        if squeezed and squeezed[-1][0] == kid[0]:
            both = merge(squeezed[-1], kid)
            both[1], both[2] = squeezed[-1][1] and kid[1], True
            squeezed[-1] = both
        else:
            squeezed.append(kid)
    return [a[0], a[1] or b[1], a[2] or b[2], constant, squeezed]


def joined(a: list, b: list) -> list:
    """Wrapper of the pages of both; its root is marked if they differ."""
    if a == b:
        return a
    both = merge(a, b)
    both[2] = True
    return both


def content_paths(wrapper: list) -> list[list[str]]:
    """Paths whose text slots are main text: in articles, in main elements, elsewhere.

    Inside an article or main element every text counts; elsewhere only slots do, not
    constants, unless the host has but one page to tell them by. Paths through dropped elements never count. A page takes the first of the
    three lists on which it has any text.
    """
    found: dict[str, set[str]] = {"article": set(), "main": set(), "": set()}

    def walk(node: list, path: tuple[str, ...]) -> None:
        for kid in node[4]:
            if kid[0].endswith("!"):
                continue
            if kid[0] != "#":
                walk(kid, (*path, kid[0]))
                continue
            region = next((m for m in MAIN if m in path), "")
            if region or kid[3] is None or not wrapper[2]:
                found[region].add("/".join(path))

    walk(wrapper, ())
    return [sorted(p) for p in found.values()]


def main_text(page: str, paths: list[set[str]]) -> str:
    """Blocks of the page's texts on the paths of the first list that gives any."""
    runs = [("/".join(path), fresh, text) for path, _, fresh, text in texts(page)]
    for chosen in paths:
        blocks: list[list[str]] = []
        pending = True
        for path, fresh, text in runs:
            pending = pending or fresh
            if path in chosen:
                if pending or not blocks:
                    blocks.append([])
                pending = False
                blocks[-1].append(text)
        cleaned = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
        found = [b for b in cleaned if b]
        if found:
            return "\n\n".join(found)
    return ""


def _strings(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in columns.values()], names=list(columns))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per _host with its wrapper (JSON), from rows of _host, _html.

    Tasks fold their pages into one wrapper per host, so a host's pages are never
    gathered; the tasks' wrappers are folded in two steps.
    """
    most_hosts = 2_000

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return _strings(_host=list(known), wrapper=[json.dumps(w) for w in known.values()])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = page_wrapper(page)
                known[host] = joined(known[host], mine) if host in known else mine
                if len(known) > most_hosts:
                    yield out()
                    known.clear()
        yield out()

    def fold(table: pa.Table) -> pa.Table:
        wrappers = [json.loads(w) for w in sorted(table.column("wrapper").to_pylist())]
        merged = wrappers[0]
        for other in wrappers[1:]:
            merged = joined(merged, other)
        return pa.Table.from_batches(
            [_strings(_host=[table.column("_host")[0].as_py()], wrapper=[json.dumps(merged)])]
        )

    schema = "_host string, wrapper string"
    parts = pages.select("_host", "_html").mapInArrow(local, schema).distinct()
    dealt = parts.withColumn("_deal", F.pmod(F.xxhash64("wrapper"), F.lit(16)))
    return dealt.groupBy("_host", "_deal").applyInArrow(fold, schema).groupBy("_host").applyInArrow(fold, schema)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Pages of one host (without regard to case; null and odd urls are one host) are
    aligned to a wrapper: a tree of tags with optional and repeated groups, where texts
    that differ are slots. The wrapper says on which paths main text lies. Whole pages
    are read; a null or empty page has an empty text. Repeated rows get the same text.
    Extra columns are ignored; an empty table gives an empty one.
    """
    plain = pages.select(
        F.col(id_col).alias("_id"), F.col(url).alias("_url"),
        F.coalesce(F.col(body), F.lit("")).alias("_html"), url_host(F.col(url)).alias("_host"),
    )
    wrappers = infer_wrappers(plain)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(content_paths(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield _strings(_host=batch.column(0).to_pylist(), _paths=found)

    kept = keep(wrappers.select("_host", "wrapper").mapInArrow(paths, "_host string, _paths string"), "wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[set[str]]] = {}
        for batch in batches:
            out = []
            for page, of_host in zip(batch.column(2), batch.column(3).to_pylist()):
                if of_host not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[of_host] = [set(p) for p in json.loads(of_host)]
                out.append(main_text(page.as_py(), known[of_host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["_id", "_url", "text"]
            )

    # The planner broadcasts the kept table of paths if it is small; else Spark can split
    # a host with very many pages.
    matched = plain.join(kept, "_host", "left").select("_id", "_url", "_html", F.coalesce("_paths", F.lit("[]")).alias("_paths"))
    kinds = dict(plain.dtypes)
    texts_ = matched.mapInArrow(extract, f"_id {kinds['_id']}, _url {kinds['_url']}, text string")
    return texts_.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )
