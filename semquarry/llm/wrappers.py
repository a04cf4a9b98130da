"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a tree of elements, its malformed parts closed as browsers do. An expression is an element's
name, how often it may stand there (once, ``?``, ``+`` or ``*``) and its parts in order; a part is an
expression, constant text or a text slot. A page is first an expression of its own, all of whose text is
constant, in which neighbours of one name that can be aligned are folded into one repeated group. Two
expressions are merged by aligning their parts: what agrees is merged in turn, text that differs becomes a
slot, runs of one name become repeated, and what only one has becomes optional. All pages of a host are
merged, first those of a task, then the tasks' expressions, which are as small as a page's structure.

Text that stays the same over all pages is the host's template, and what fills slots is its content. The
wrapper's main part follows from how many characters its slots have been filled with: what is marked as an
article or as main, else the element into which nearly all that fills slots falls, outside of links and
boilerplate. Matching a page against the wrapper gives the slots' text below the main part; blocks of template
text there are left out where at least ``PAGES`` pages agree on them.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"](?=[^<>]*>))*)(?P<close>>|\Z)", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label wbr".split())
#: An element that ends an open one of the same kind.
ENDS = {name: frozenset(others.split()) for name, others in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "tr td th thead", "tfoot": "tr td th tbody"}.items()}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements and words of class, id and role that mark what is no article.
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe button select textarea input menu dialog title head svg object".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer menu nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget disqus respond masthead toolbar pagination complementary contentinfo search modal".split())
#: The main part is narrowed while one part has so much of the text.
MOST = 0.8
#: Tasks to which a host's pages are dealt, and groups in which its tasks' expressions are merged first.
SALTS, GROUPS = 64, 256
#: Pages that must agree on a text before it is template. Hosts whose expressions a task holds at once.
PAGES, HOSTS = 4, 500
#: Text of a slot, in place of a constant's digest.
SLOT = 0


class Element:
    __slots__ = ("name", "label", "parts")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.parts = name, label, []


def parse(page: str | None) -> Element:
    """The tree of a page's elements; parts are elements and raw strings. Unclosed elements end where their parent does."""
    root = Element("#root", "#root")
    stack, at, page = [root], 0, page or ""
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if "<" in text and not m:  # a tag that the page's end cuts off
                text = re.sub(r"<[/!A-Za-z][^<>]*\Z", "", text)
            stack[-1].parts.append(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if m["cdata"] is not None:
            stack[-1].parts.append(entities.escape(m["cdata"]))
        elif not name:
            continue
        elif m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
        else:
            if name in ENDS or name in BLOCKS_END_P:
                ends = ENDS.get(name, frozenset(("p",)))
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ends or stack[i].name not in INLINE and stack[i].name != "p"), 0)
                if depth and stack[depth].name in ends:
                    del stack[depth:]
            words = sorted({w for found in _CLASS.findall(m["rest"]) for w in "".join(found).lower().split()})
            element = Element(name, ".".join([name, *words]))
            stack[-1].parts.append(element)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name not in VOID and not m["rest"].endswith("/"):
                stack.append(element)
    return root


def _boilerplate(label: str) -> bool:
    name, _, words = label.partition(".")
    return name in BOILERPLATE or name not in ("html", "body", "article", "main") and any(w in BOILERPLATE_WORDS for w in _WORD.findall(words))


# An expression is [label, how often, parts, characters, characters in links, pages, digest]; text has the label "#"
# and the digest of what it is in all pages so far, or SLOT.
def expression(element: Element, linked: bool = False) -> list:
    parts: list = []
    for part in element.parts:
        if isinstance(part, str):
            text = "".join(part.split())
            if text:
                parts.append(["#", "", [], len(text), len(text) * linked, 1, zlib.crc32(text.encode("utf-8", "replace")) or 1])
        elif part.name not in RAW:
            parts.append(expression(part, linked or part.name == "a"))
    return [element.label, "", _fold(parts, True), 0, 0, 1, SLOT]


_REPEATED = {"": "+", "?": "*", "+": "+", "*": "*"}
_OPTIONAL = {"": "?", "?": "?", "+": "*", "*": "*"}


def _fold(parts: list, page: bool = False) -> list:
    """Neighbours of one label as one repeated group; ``page``: they are of one page."""
    out: list = []
    for part in parts:
        if out and out[-1][0] == part[0]:
            pages = max(out[-1][5], part[5])
            out[-1] = merge(out[-1], part, page)
            out[-1][5] = pages
            out[-1][1] = _REPEATED[out[-1][1]] if part[0] != "#" else out[-1][1]
        else:
            out.append(part)
    return out


def merge(a: list, b: list, page: bool = False) -> list:
    """The expression of both, which have one label. Texts of one page that differ make one constant, of all of them."""
    often = a[1] if a[1] == b[1] else "*" if "*" in (a[1], b[1]) or {a[1], b[1]} == {"?", "+"} else (a[1] + b[1])
    x, y = a[2], b[2]
    labels = [p[0] for p in x], [p[0] for p in y]
    parts: list = []
    if labels[0] == labels[1]:
        parts = [merge(p, q, page) for p, q in zip(x, y, strict=True)]
    else:
        for kind, i, j, k, l in SequenceMatcher(None, *labels, autojunk=False).get_opcodes():  # noqa: E741
            if kind == "equal":
                parts += [merge(p, q, page) for p, q in zip(x[i:j], y[k:l], strict=True)]
            else:
                parts += [[p[0], _OPTIONAL[p[1]], *p[2:]] for p in (*x[i:j], *y[k:l])]
        parts = _fold(parts, page)
    digest = (a[6] * 31 + b[6]) % 2**32 or 1 if page and a[0] == "#" else a[6] if a[6] == b[6] else SLOT
    return [a[0], often, parts, a[3] + b[3], a[4] + b[4], 1 if page else a[5] + b[5], digest]


def _constant(e: list) -> bool:
    return e[0] == "#" and e[6] != SLOT and e[5] >= PAGES


def _varies(e: list) -> bool:
    return e[0] == "#" and not _constant(e) or any(map(_varies, e[2]))


def _mass(e: list) -> int:
    """Characters that fill slots in no boilerplate and in no link."""
    return 0 if _boilerplate(e[0]) or _constant(e) else e[3] - e[4] + sum(map(_mass, e[2]))


def main_path(wrapper: list) -> list[str]:
    """Labels from below the root to the main part of a wrapper."""

    def marked(e: list, path: list[str]) -> Iterator[tuple[int, list[str]]]:
        for part in e[2]:
            if part[0] != "#" and not _boilerplate(part[0]):
                name, _, words = part[0].partition(".")
                if name in ("article", "main") or "main" in words.split("."):
                    yield _mass(part), [*path, part[0]]
                else:
                    yield from marked(part, [*path, part[0]])

    found = [x for x in marked(wrapper, []) if x[0]]
    if found:
        return max(found, key=lambda x: x[0])[1]
    path: list[str] = []
    while True:
        whole = sum(_mass(p) for p in wrapper[2])
        best = max((p for p in wrapper[2] if p[0] != "#"), key=_mass, default=None)
        if best is None or not whole or _mass(best) < MOST * whole or "+" in best[1] or "*" in best[1] or best[0].split(".")[0] in INLINE:
            return path
        path.append(best[0])
        wrapper = best


def template(wrapper: list, path: list[str]) -> list[list]:
    """[labels below the main part, digest] of each constant text there; none where nothing varies.

    Text is template only with the whole block that it stands in, and only outside of repeated groups.
    """
    found: list[list] = []

    def inline(e: list) -> bool:
        return e[0] == "#" or e[0].partition(".")[0] in INLINE

    def walk(e: list, labels: list[str], open_: bool) -> None:
        if e[1] in ("+", "*"):
            return
        if not inline(e):
            open_ = any(inline(part) and _varies(part) for part in e[2])
        for part in e[2]:
            if part[0] != "#":
                walk(part, [*labels, part[0]], open_)
            elif _constant(part) and not open_:
                found.append([labels, part[6]])

    mains = [wrapper]
    for label in path:
        mains = [p for e in mains for p in e[2] if p[0] == label]
    for e in mains:
        if _varies(e):
            walk(e, [], False)
    return found


def text_of(root: Element, path: list[str], constants: Iterable[list] = ()) -> str | None:
    """The text of a page's main parts by a wrapper's path, without the constants; None where the page has no such part."""
    found = [root]
    for label in path:
        found = [p for e in found for p in e.parts if isinstance(p, Element) and p.label == label]
        if not found:
            return None
    blocks: list[list[str]] = [[]]
    fixed = {(tuple(labels), digest) for labels, digest in constants}

    def walk(e: Element, labels: tuple) -> None:
        inline = e.name in INLINE
        if not inline:
            blocks.append([])
        for part in e.parts:
            if isinstance(part, str):
                if not fixed or (labels, zlib.crc32("".join(part.split()).encode("utf-8", "replace")) or 1) not in fixed:
                    blocks[-1].append(part)
            elif part.name not in RAW and not _boilerplate(part.label):
                walk(part, (*labels, part.label))
        if not inline:
            blocks.append([])

    for e in found:
        walk(e, ())
    texts = (" ".join(entities.unescape("".join(block)).split()) for block in blocks)
    return " ".join(t for t in texts if t)


def _host(url) -> F.Column:
    """The host of a URL, lower case; a page without one belongs to the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, rule): the merged expression of all pages of each host, and from it the way to its main part and the template there, as JSON.

    A host's expressions, one from each task, are merged in ``GROUPS`` groups and then those of the groups.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(e) for e in found.values()], pa.string())], ["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = expression(parse(page))
                found[host] = merge(found[host], own) if host in found else own
                if len(found) > HOSTS:
                    yield done()
        yield done()

    def merged(group: pd.DataFrame) -> list:
        out = None
        for text in group["wrapper"]:
            out = merge(out, json.loads(text)) if out else json.loads(text)
        return out

    def join(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[:1][["host"]].assign(wrapper=json.dumps(merged(group)))

    def last(group: pd.DataFrame) -> pd.DataFrame:
        out = merged(group)
        path = main_path(out)
        return group.iloc[:1][["host"]].assign(wrapper=json.dumps(out), rule=json.dumps([path, template(out, path)]))

    partial = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(tidy(infer), "host string, wrapper string")
    partial = partial.withColumn("part", F.spark_partition_id() % GROUPS).groupBy("host", "part").applyInPandas(join, "host string, wrapper string")
    return partial.groupBy("host").applyInPandas(last, "host string, wrapper string, rule string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null and empty pages have an empty text. A page that lacks its host's main part is its own wrapper.
    Rows are neither merged nor dropped; pages without a host share the host ''. Further columns are left
    out, and an empty table gives no rows.
    """
    found = wrappers(pages).select("host", "rule")
    keyed = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                root = parse(page)
                text = text_of(root, *json.loads(rule)) if rule else None
                texts.append(text if text is not None else text_of(root, main_path(expression(root))) or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # pages are by far the larger side; a host's pages are dealt to SALTS tasks, and its rule, a few words, to each
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "rule")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(tidy(extract), f"page_id {kind}, url string, text string, n_chars long")


def op4_wrappers(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
