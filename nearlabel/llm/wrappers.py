"""Main text of web pages by union-free regular-expression inference over the pages of a host.

A page is a stream of block tags and text slots. Inference folds adjacent repeats into repeated groups and aligns the
streams of one host one after another: equal tokens stay, a group met by one of its bodies stays a group, and what only
one side has becomes an optional group. Texts that meet in a slot and are equal on pages that differ elsewhere make the
slot constant, a part of the template; unequal ones make it varying. The wrapper that results, a regular expression over
tags and slots without unions, tells for every text slot of the host in which containers it lies and whether it is
template, and so which containers are the article. A page without the host's article branch is judged by itself.

Pages are reduced to folded streams and counted before anything is shuffled, so a host with a third of all pages is a few
rows; streams are aligned in groups of bounded size, whose wrappers are aligned again.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlabel.operators.graph import Scratch

#: Streams aligned in one group; longest repeated group in tokens; hosts whose wrappers are broadcast, and bytes of these;
#: tokens of streams whose folding a task remembers.
GROUP, LONGEST, HOSTS, HOST_BYTES, KNOWN = 256, 24, 20_000, 64 << 20, 300_000
#: Tags within a line, tags without content, tags whose content is no text, tags that end implicitly.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe")
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Containers that hold no article text, by tag, by role, and by a class or id made of such words alone.
OUTSIDE_TAGS = frozenset("head nav footer aside form button select menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement banner sidebar menu nav navbar navigation footer cookie cookies notice promo sponsor sponsored newsletter subscribe share sharing social related breadcrumb breadcrumbs comment comments reply replies popup modal".split()
)
ARTICLE = frozenset(["article", "main"])
#: No class or id puts these outside.
WHOLE = ARTICLE | {"html", "body"}

_EMPTY_SVG = r"""svg\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>"""
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?!" + _EMPTY_SVG + ")(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?=svg)(" + _EMPTY_SVG + ")|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _name(tag: str, attributes: str) -> str:
    """The tag, marked ``!!`` if its role puts it outside the article, ``!`` if a class name or its id does, ``**`` if
    its role makes it the main part, ``*`` the article."""
    mark = ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            words = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if words in OUTSIDE_ROLES:
                    return tag + "!!"
                if words in ARTICLE:
                    return tag + ("**" if words == "main" else "*")
            elif tag not in WHOLE and any(OUTSIDE_WORDS.issuperset(x) for name in words.split() if (x := re.findall("[a-z0-9]+", name))):
                mark = "!"
    return tag + mark


def stream(page: str | None) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """Events (kind, path, text): ``<`` a block opens, ``>`` it closes, ``#`` a slot with its text, white space joined.
    The path has the names of the open blocks."""
    text = _DROP.sub(lambda m: " " if m[1] or m[2] else "", page or "")
    stack: list[str] = []
    held: list[str] = []
    at = 0

    def slot() -> Iterator[tuple[str, tuple[str, ...], str]]:
        if held:
            said = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if said:
                yield "#", tuple(stack), said

    def bare(name: str) -> str:
        return name.rstrip("!*")

    for m in _TAG.finditer(text):
        held.append(text[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1] or m[4] or "", (m[2] or m[5]).lower(), m[3] or m[6] or "")
        if tag in INLINE:
            continue
        if tag in VOID:
            held.append(" ")
            continue
        yield from slot()
        if closing:
            if tag in [bare(x) for x in stack]:
                while bare(stack[-1]) != tag:
                    yield ">", tuple(stack), stack.pop()
                yield ">", tuple(stack), stack.pop()
            continue
        ends = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        while stack and bare(stack[-1]) in ends:
            yield ">", tuple(stack), stack.pop()
        stack.append(_name(tag, attributes))
        yield "<", tuple(stack), stack[-1]
        if attributes.rstrip().endswith("/"):
            yield ">", tuple(stack), stack.pop()
    held.append(text[at:])
    yield from slot()
    while stack:
        yield ">", tuple(stack), stack.pop()


# A wrapper is a tuple of nodes: "<name", ">name", a slot, or ("+", nodes) repeated, ("?", nodes) optional. A slot is "#"
# if its text varies, "#=digest" if it is the same on pages that differ, "#?digest" if only one page was seen.


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def _shape(node):
    """A node with all slots alike."""
    if isinstance(node, tuple):
        return node[0], tuple(map(_shape, node[1]))
    return "#" if node[0] == "#" else node


def _merged(x, y, differ: bool):
    """Two nodes of one shape as one; whether they come from pages that differ."""
    if isinstance(x, tuple):
        return x[0], tuple(_merged(a, b, differ) for a, b in zip(x[1], y[1], strict=True))
    if x[0] != "#" or x == y == "#":
        return x
    if x == "#" or y == "#" or x[2:] != y[2:]:
        return "#"
    return "#=" + x[2:] if differ or "=" in (x[1], y[1]) else x


def _constant(node):
    """A node seen on several pages that differ, with the same texts."""
    return _merged(node, node, True)


def fold(nodes: tuple) -> tuple:
    """Adjacent repeats as repeated groups, shortest first; a group takes in further copies of its body."""
    out, form = list(nodes), [_shape(n) for n in nodes]
    for width in range(1, min(LONGEST, len(out)) + 1):
        i = 0
        while i + width <= len(out):
            body = tuple(form[i : i + width])
            if width == 1 and isinstance(body[0], tuple) and body[0][0] == "+":
                group = body[0]
                span = len(group[1])
                whole, j = out[i], i + 1
                while form[j : j + 1] == [group] or tuple(form[j : j + span]) == group[1]:
                    size = 1 if form[j : j + 1] == [group] else span
                    whole = _merged(whole, out[j] if size == 1 and form[j] == group else ("+", tuple(out[j : j + span])), False)
                    j += size
                out[i:j], form[i:j] = [whole], [group]
                i += 1
                continue
            j = i + width
            while tuple(form[j : j + width]) == body:
                j += width
            if j > i + width and _balanced(body):
                whole = tuple(out[i : i + width])
                for k in range(i + width, j, width):
                    whole = tuple(_merged(x, y, False) for x, y in zip(whole, out[k : k + width], strict=True))
                out[i:j], form[i:j] = [("+", whole)], [("+", body)]
            i += 1
    return tuple(out)


def _balanced(nodes: tuple) -> bool:
    """Whether tags open and close within the group; a slot repeated by itself is none."""
    depth = 0
    for n in nodes:
        if isinstance(n, str) and n[0] != "#":
            depth += 1 if n[0] == "<" else -1
            if depth < 0:
                return False
    return depth == 0 and any(isinstance(n, tuple) or n[0] == "<" for n in nodes)


def _unrolled(nodes: tuple, groups: set) -> tuple:
    """Bodies of repeated and optional groups of the other side, as such groups."""
    out, form = list(nodes), [_shape(n) for n in nodes]
    for group in sorted(groups, key=lambda g: (-len(g[1]), str(g))):
        size, i = len(group[1]), 0
        while i + size <= len(out):
            if tuple(form[i : i + size]) == group[1]:
                out[i : i + size], form[i : i + size] = [(group[0], tuple(out[i : i + size]))], [group]
            i += 1
    return fold(tuple(out))


def _placed(nodes: tuple) -> list[tuple]:
    """Nodes by shape, with the containers they lie in: only what lies in the same ones is aligned, so that optional
    groups begin and end in one container."""
    out, stack = [], ()
    for n in nodes:
        out.append((stack, _shape(n)))
        if isinstance(n, str) and n[0] == "<":
            stack = (*stack, n)
        elif isinstance(n, str) and n[0] == ">":
            stack = stack[:-1]
    return out


def align(a: tuple, b: tuple) -> tuple:
    """A wrapper for all that a and b, of different pages, stand for: mismatches become optional groups."""
    if tuple(map(_shape, a)) == tuple(map(_shape, b)):
        return tuple(_merged(x, y, True) for x, y in zip(a, b, strict=True))
    groups = lambda w: {_shape(n) for n in w if isinstance(n, tuple)}
    a, b = _unrolled(a, groups(b)), _unrolled(b, groups(a))
    out: list = []
    for op, i, k, j, m in SequenceMatcher(None, _placed(a), _placed(b), autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merged(x, y, True) for x, y in zip(a[i:k], b[j:m], strict=True)]
            continue
        for part in (a[i:k], b[j:m]):
            if part:
                out.append(part[0] if len(part) == 1 and isinstance(part[0], tuple) and part[0][0] == "?" else ("?", tuple(part)))
    return tuple(out)


def infer(streams: list[tuple]) -> tuple:
    """The wrapper of several streams or wrappers, aligned from the most frequent on."""
    wrapper = streams[0] if streams else ()
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def _slots(wrapper: tuple) -> Iterator[tuple[tuple[str, ...], str]]:
    """The path and the node of every text slot of a wrapper, in order."""
    found: list[tuple[tuple[str, ...], str]] = []

    def walk(nodes: tuple, stack: list[str]) -> list[str]:
        for n in nodes:
            if isinstance(n, tuple):
                before = list(stack)
                stack = walk(n[1], list(stack))
                if n[0] == "?":
                    stack = max(before, stack, key=len)
            elif n[0] == "#":
                found.append((tuple(stack), n))
            elif n[0] == "<":
                stack = [*stack, n[1:]]
            elif n[1:] in stack:
                stack = stack[: len(stack) - 1 - stack[::-1].index(n[1:])]
        return stack

    walk(wrapper, [])
    yield from found


def slots(wrapper: tuple) -> set[tuple[str, ...]]:
    """The paths of all text slots of a wrapper."""
    return {p for p, _ in _slots(wrapper)}


@lru_cache(10_000)
def _kind(path: tuple[str, ...]) -> str:
    """``article``, ``plain``, ``outside``, or ``held``: an article within a container that is outside by a class or id.
    A main part is never outside by such a name."""
    last = lambda test: max((i for i, x in enumerate(path) if test(x)), default=-1)
    if last(lambda x: x in OUTSIDE_TAGS or x.endswith("!!")) >= 0:
        return "outside"
    marked, article = last(lambda x: x.endswith("!")), last(lambda x: x in ARTICLE or x.endswith("*"))
    if article < 0:
        return "outside" if marked >= 0 else "plain"
    if marked < 0 or last(lambda x: x == "main" or x.endswith("**")) > marked:
        return "article"
    return "held" if article > marked else "outside"


def main_slots(wrapper: tuple) -> tuple[bool, frozenset[tuple[tuple[str, ...], str]]]:
    """Whether the host's text is in its article containers, and its template: path and digest of constant slots.

    Article containers are the article if a slot in them is not constant, or if no slot of the host is. Where nothing
    but constant slots is left (all pages alike) there is no telling, and no template."""
    found = [(p, n) for p, n in _slots(wrapper) if _kind(p) != "outside"]
    live = [p for p, n in found if n[:2] != "#="]
    template = frozenset((p, n[2:]) for p, n in found if n[:2] == "#=") if live else frozenset()
    return any(_kind(p) == "article" for p in live or [p for p, _ in found]), template


def extract(page: str | None, main: tuple[bool, frozenset[tuple[tuple[str, ...], str]]] | None = None) -> str:
    """Texts of main slots, one a line: of the article containers where the page has the host's article branch, else all
    outside of containers of other matter that are not the host's template, or all if that leaves none."""
    has_article, template = main or (True, frozenset())
    events = [(p, t) for kind, p, t in stream(page) if kind == "#" and _kind(p) != "outside"]
    texts = [t for p, t in events if _kind(p) == "article"] if has_article else []
    if not texts and template:
        texts = [t for p, t in events if (p, _digest(t)) not in template]
    return "\n".join(texts or [t for _, t in events])


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def places(wrapper: tuple, nodes: tuple) -> list[int] | None:
    """For each slot of the nodes that were folded to a wrapper, the number of the wrapper's slot; None if they do not match."""
    out: list[int] = []

    def walk(seq: tuple, at: int, k: int) -> tuple[int, int] | None:
        for n in seq:
            if isinstance(n, tuple):
                times, after = 0, k
                while at < len(nodes):
                    held = len(out)
                    met = walk(n[1], at, k)
                    if met is None:
                        del out[held:]
                        break
                    times += 1
                    at, after = met
                if not times:
                    return None
                k = after
            elif at < len(nodes) and nodes[at] == n:
                at += 1
                if n == "#":
                    out.append(k)
                    k += 1
            else:
                return None
        return at, k

    met = walk(wrapper, 0, 0)
    return out if met and met[0] == len(nodes) else None


def _filled(nodes: tuple, texts: Iterator[str]) -> tuple:
    """Nodes with their slots replaced in order."""
    return tuple((n[0], _filled(n[1], texts)) if isinstance(n, tuple) else next(texts) if n == "#" else n for n in nodes)


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, folded stream with the texts of its slots, content, pages; summed up by task."""
    held: dict[tuple[str, tuple], list] = {}
    folded: dict[tuple, tuple[tuple, list[int] | None]] = {}
    known = 0
    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes, texts = [], []
            for kind, _, text in stream(page):
                nodes.append("#" if kind == "#" else kind + text)
                if kind == "#":
                    texts.append("#?" + _digest(text))
            nodes = tuple(nodes)
            if nodes not in folded:
                if known > KNOWN:
                    folded, known = {}, 0
                wrapper = fold(fold(nodes))
                folded[nodes] = wrapper, places(wrapper, nodes)
                known += len(nodes)
            wrapper, at = folded[nodes]
            own = ["#"] * sum(1 for _ in _slots(wrapper)) if at is None else [""] * (max(at, default=-1) + 1)
            for k, t in zip(at or (), texts, strict=False):
                own[k] = _merged(own[k], t, False) if own[k] else t
            content = _digest(" ".join(texts))
            row = held.setdefault((host_of(url), wrapper), [0, own, content])
            row[0] += 1
            if content != row[2]:
                row[1:] = [[_merged(x, y, True) for x, y in zip(row[1], own, strict=True)], ""]
        if len(held) > 5000:
            yield _counted(held)
            held = {}
    yield _counted(held)


def _counted(held: dict) -> pa.RecordBatch:
    """Content is empty where pages differed."""
    rows = [(h, json.dumps(_filled(w, iter(own))), content, n) for (h, w), (n, own, content) in held.items()]
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("content", pa.string()), ("pages", pa.int64())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def _tuples(x):
    return tuple(_tuples(y) for y in x) if isinstance(x, list) else x


def _infer(t: pa.Table) -> pa.Table:
    """The wrapper of the rows of a host; rows of one shape, which are of different pages, are merged first."""
    met: dict[tuple, list] = {}
    for w, n, differ in zip(t.column("wrapper").to_pylist(), t.column("pages").to_pylist(), t.column("differ").to_pylist(), strict=True):
        nodes = _tuples(json.loads(w))
        nodes = tuple(map(_constant, nodes)) if differ else nodes
        row = met.setdefault(tuple(map(_shape, nodes)), [0, nodes])
        if row[0]:
            row[1] = tuple(_merged(x, y, True) for x, y in zip(row[1], nodes, strict=True))
        row[0] += n
    rows = sorted(met.items(), key=lambda r: (-r[1][0], json.dumps(r[0])))
    wrapper = json.dumps(infer([nodes for _, (_, nodes) in rows]))
    return pa.table({"host": pa.array([t.column("host")[0].as_py()], pa.string()), "wrapper": [wrapper], "pages": pa.array([sum(n for _, (n, _) in rows)], pa.int64()), "differ": [False]})


def host_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, wrapper (JSON), pages: the wrapper of every host, from all its pages.

    The folded streams are counted, cut, and aligned in groups of about GROUP; the groups' wrappers again, until each host
    has one, so no task aligns more than a group, however many streams a host has."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    schema = "host string, wrapper string, pages long, differ boolean"
    found = pages.select(url, page).mapInArrow(_structures, "host string, wrapper string, content string, pages long")
    found = found.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"), (F.min("content") != F.max("content")).alias("differ"))
    rows = scratch.cut(found.select("host", "wrapper", "pages", "differ"), "streams")
    while True:
        sizes = rows.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
        dealt = rows.join(sizes, F.col("host") == F.col("h")).select("host", "wrapper", "pages", "differ", F.pmod(F.xxhash64("wrapper"), "parts").alias("part"))
        rows = scratch.cut(dealt.groupBy("host", "part").applyInArrow(lambda t: _infer(t.drop_columns(["part"])), schema), "groups")
        if not rows.groupBy("host").count().filter("count > 1").limit(1).count():
            return rows.drop("differ")


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wrappers = shared.value if shared else dict(zip(map(host_of, urls), batch.column(2).to_pylist(), strict=True))
            known: dict[str, tuple] = {}
            out = []
            for u, p in zip(urls, pages, strict=True):
                host = host_of(u)
                if host not in known:
                    known[host] = main_slots(_tuples(json.loads(wrappers[host])))
                out.append(extract(p, known[host]))
            yield pa.array(out, pa.string())

    return run


def main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``main_text``: the texts of the article's blocks in page order, one a line.

    Character references are decoded, white space within a block is one space, ``<br>`` counts as white space. Null,
    empty and textless pages give the empty text. Pages without a host, or with a null url, form one host of their own.
    Repeated rows stay; a column ``main_text`` that exists is replaced.
    """
    spark = pages.sparkSession
    wrappers = host_wrappers(pages, url, page)
    size = wrappers.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("wrapper")).alias("bytes")).first()
    if size.n <= HOSTS and (size.bytes or 0) <= HOST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.select("host", "wrapper").collect()})

        @F.arrow_udf("string")
        def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            yield from _apply(shared)(pa.RecordBatch.from_arrays(list(b), names=["u", "p"]) for b in batches)

        return pages.withColumn("main_text", texts(F.col(url), F.col(page)))

    @F.arrow_udf("string")
    def joined(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _apply(None)(pa.RecordBatch.from_arrays(list(b), names=["u", "p", "w"]) for b in batches)

    @F.arrow_udf("string")
    def host(urls: pa.Array) -> pa.Array:
        return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())

    named = pages.withColumn("_host_of_page", host(F.col(url)))
    met = named.join(wrappers.select(F.col("host").alias("_host_of_page"), F.col("wrapper").alias("_wrapper_of_host")), "_host_of_page", "left")
    return met.withColumn("main_text", joined(F.col(url), F.col(page), F.col("_wrapper_of_host"))).drop("_host_of_page", "_wrapper_of_host")
