"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, each with the path of open elements above it, and its blocks of
text, each with its path. Over the pages of a host a token has an occurrence vector, its count in
each page. Tokens with equal vectors form a class. A class is valid if it spans enough of the
host's pages, has more than one token or is on every page, is ordered (its tokens follow each other
in the same order wherever they occur), and nests (its span crosses no span of another class in any
page). Valid classes make up the host's template: its elements enclose each other, what stands in
them between template tokens are slots, and its texts are template text.

The main slot is found by content over all pages of the host: from the root, a template element
that holds at least ``SHARE`` of the running text of the one it is in takes its place, until none
does; an article element ends the descent. Running text is what is neither template text nor
linked. Of a page, the blocks in that element are the main text, without template text, and without
what its own markup names as menu, header, footer, sidebar, notice, advert, form or comments.
Pages that lack the element, and hosts of fewer than ``LEAST_PAGES`` pages, go by their own
article or main element.

Vectors are never built: sums over pages of the count times two hashes of the page tell them
apart, so a host of any size is a map-side sum, and so are order, nesting and the text in elements.
A host's template has at most about ``1 / SUPPORT`` times a page's tokens.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

#: Share of a host's pages, and number of pages, that a template's token is in; of template text, a higher share; share of the running text that the main element holds.
SUPPORT, LEAST_PAGES, TEXT_SUPPORT, SHARE = 0.3, 3, 0.6, 0.6
#: Tokens of all hosts that are broadcast at most, 16 bytes each in arrays; more are joined by host, and hosts of more than HOT pages in parts.
BROADCAST_TOKENS, HOT = 1 << 20, 1 << 16
#: Counts that a task holds before it passes them on.
HELD = 200_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>])*)>?|<[!?][^>]*>?|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?>\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {x: re.compile(rf"</{x}\b[^>]*>?|\Z", re.I) for x in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end at the next one of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = frozenset("ul ol dl table select html body div section article main center blockquote".split())
AWAY = frozenset("head nav footer aside form button select fieldset dialog menu object".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An element goes by its class or id if that is made of these words, with words of layout and numbers at most.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter subscribe subscription sharing related recommended comment comments disqus reply replies popup modal overlay paywall pagination pager toolbar widget".split()
)
LAYOUT_WORDS = frozenset("area bar block bottom box button buttons closed col column container content footer form group header holder inner item items leaderboard left link links list main open outer panel respond right row section site slot thread title top unit wrap wrapper".split())
#: Elements that hold text rather than a part of the page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre figure figcaption blockquote".split())
#: Links in a row that make a menu, and their share of a block's text.
MENU, LINKED = 3, 0.8


def named_away(values: list[str]) -> bool:
    """Whether a class name or id says that the element isn't main text."""
    for value in values:
        words = [w for w in re.split(r"[^a-z]+", value) if w]
        if words and not AWAY_WORDS.isdisjoint(words) and all(w in AWAY_WORDS or w in LAYOUT_WORDS for w in words):
            return True
    return False


class Page:
    """Elements and blocks of a page.

    Elements, in order, none but the root inline: token (hash of the path), parent, name, whether it
    goes, place in the order of openings and closings, and the header it is in, -1 if none. Blocks:
    element, text, letters of it in links, links, place.
    """

    def __init__(self, source: str | None) -> None:
        self.token, self.parent, self.name = [0], [-1], [""]
        self.away, self.header, self.kind = [False], [-1], [1]
        self.opened, self.closed, self.last = [0], [0], [0]
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        digest = xxhash.xxh64_intdigest
        # Open elements: name, path, element, nearest barrier and nearest element that isn't inline (as places here), links open.
        stack: list[tuple[str, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0)]
        where: dict[str, list[int]] = {}
        cells = Counter()
        text: list[str] = []
        linked = links = at = now = 0
        size = len(source)

        def flush() -> None:
            nonlocal linked, links, now
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                if line:
                    now += 1
                    self.blocks.append((stack[stack[-1][4]][2], line, linked, links, now))
                text.clear()
                linked = links = 0

        def close(i: int) -> None:
            nonlocal now
            for name, _, e, _, _, _ in reversed(stack[i:]):
                where[name].pop()
                if name not in INLINE:
                    now += 1
                    self.closed[e], self.last[e] = now, len(self.token) - 1
            del stack[i:]

        while at < size:
            m = TAG.match(source, at)
            at = m.end()
            if m[4] is not None:
                text.append(m[4])
                if stack[-1][5]:
                    linked += len(m[4].strip())
                continue
            if m[2] is None:
                continue
            name = m[2].lower()
            inline = name in INLINE
            if not inline:
                flush()
            if m[1]:
                if where.get(name) and not (inline and where[name][-1] < stack[-1][4]):
                    close(where[name][-1])
                continue
            if name in VOID:
                continue
            if name in RAW:
                at = RAW[name].search(source, at).end()
                continue
            if inline:
                up = stack[-1]
                links += name == "a"
                where.setdefault(name, []).append(len(stack))
                stack.append((name, up[1], up[2], up[3], up[4], up[5] + (name == "a")))
                continue
            if name in CLOSES:
                nearest = max((where[x][-1] for x in CLOSES[name] if where.get(x)), default=0)
                if nearest > stack[-1][3]:
                    close(nearest)
            elif stack[stack[-1][4]][0] == "p":
                close(stack[-1][4])
            if stack[-1][4] < len(stack) - 1:  # inline ones left open in the block before
                close(stack[-1][4] + 1)
            mark, values, role = "", [], ""
            if m[3]:
                for a in ATTRIBUTE.finditer(m[3]):
                    value = (a[2] or a[3] or a[4] or "").lower()
                    if a[1].lower() == "role":
                        role = value
                    else:
                        values.append(value)
                    mark += f" {a[1].lower()}={value}"
            up = stack[-1]
            e, parent = len(self.token), up[2]
            if name in ("td", "th"):  # cells of a row are told apart by their number
                cells[parent] += 1
                mark += f" {cells[parent]}"
            path = digest(f"{up[1]}/{name}{mark}") >> 1
            self.token.append(path)
            self.parent.append(parent)
            self.name.append(name)
            self.away.append(self.away[parent] or name in AWAY or role in AWAY_ROLES or named_away(values))
            self.header.append(e if name == "header" and self.header[parent] < 0 else self.header[parent])
            self.kind.append(3 if name == "article" else max(2, self.kind[parent]) if name == "main" or role == "main" else self.kind[parent])
            now += 1
            self.opened.append(now)
            self.closed.append(0)
            self.last.append(0)
            where.setdefault(name, []).append(len(stack))
            stack.append((name, path, e, len(stack) if name in BARRIERS else up[3], len(stack), up[5]))
        flush()
        close(1)
        self.closed[0], self.last[0] = now + 1, len(self.token) - 1

    def tokens(self) -> Counter:
        """Count of each token outside of what goes."""
        out = Counter(t for t, p in zip(self.token, self.parent, strict=True) if p >= 0 and not self.away[p])
        out.update(block_token(self.token[b[0]], b[1]) for b in self.blocks if not self.away[b[0]])
        return out

    def layout(self, classes: dict[int, int]) -> dict[int, tuple[int, bool, int, int, str]]:
        """Of each token in classes (token to class): order of its class, whether that crosses another, running text in it, nearest element above it that is in classes, name."""
        inside, near = [0] * len(self.token), [0] * len(self.token)
        spots: list[tuple[int, int, int, int]] = []  # place, end, class, token
        for e, line, linked, _, place in self.blocks:
            if self.away[e]:
                continue
            t = block_token(self.token[e], line)
            c = classes.get(t)
            if c is not None:
                spots.append((place, place, c, t))
            elif self.header[e] < 0:
                inside[e] += max(0, len(line) - linked)
        for e in range(len(self.token) - 1, 0, -1):
            inside[self.parent[e]] += inside[e]
        out: dict[int, tuple[int, bool, int, int, str]] = {}
        for e in range(1, len(self.token)):
            p, t = self.parent[e], self.token[e]
            near[e] = self.token[p] if self.token[p] in classes else near[p]
            if t in classes and not self.away[p]:
                spots.append((self.opened[e], self.closed[e], classes[t], t))
                was = out.get(t)
                out[t] = (0, False, inside[e] + (was[2] if was else 0), near[e], self.name[e])
        spots.sort()
        order, crossed = spans_of(spots)
        for _, _, c, t in spots:
            was = out.get(t, (0, False, 0, 0, ""))
            out[t] = (order[c], c in crossed, *was[2:])
        return out

    def text(self, template: dict[int, int] | None) -> tuple[str, bool]:
        """Main text, and whether the template decided. template: of this host, by token: 2 template text, 3 the main element."""
        template = template or {}
        top = next((e for e in range(1, len(self.token)) if template.get(self.token[e]) == 3 and not self.away[e]), None)
        if top is None:
            best = max((self.kind[b[0]] for b in self.blocks if not self.away[b[0]]), default=1)
            own = [b for b in self.blocks if not self.away[b[0]] and self.kind[b[0]] == best and (best > 1 or self.header[b[0]] < 0)]
            plain = best == 1
        else:
            own = [b for b in self.blocks if top <= b[0] <= self.last[top] and not self.away[b[0]]]
            plain = self.kind[top] == 1
        said = [template.get(block_token(self.token[b[0]], b[1])) == 2 for b in own]
        # Where most is template text, the page is a copy of others rather than framed by them.
        if 2 * sum(len(b[1]) for b, x in zip(own, said, strict=True) if x) <= sum(len(b[1]) for b in own):
            own = [b for b, x in zip(own, said, strict=True) if not x]
        if plain:
            own = without_menus(own)
        if plain and top is not None:  # the page's title may stand above
            title = [b for b in self.blocks if b[0] < top and self.name[b[0]] == "h1" and not self.away[b[0]] and self.header[b[0]] < 0 and template.get(block_token(self.token[b[0]], b[1])) != 2]
            own = title + own
        return "\n".join(b[1] for b in own), top is not None


def spans_of(spots: list[tuple[int, int, int, int]]) -> tuple[dict[int, int], set[int]]:
    """Hash of each class's order of tokens, -1 if it differs within the page, and the classes whose spans cross. spots: (place, end, class, token) by place."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for place, end, c, t in spots:
        by.setdefault(c, []).append((place, end, t))
    order, spans = {}, []
    for c, own in by.items():
        n = len({t for _, _, t in own})
        cycle = [t for _, _, t in own[:n]]
        same = all(t == cycle[i % n] for i, (_, _, t) in enumerate(own))
        order[c] = xxhash.xxh64_intdigest(np.array(cycle, np.int64).tobytes()) >> 1 if same else -1
        spans += [(own[i][0], max(end for _, end, _ in own[i : i + n]), c) for i in range(0, len(own), n)]
    crossed: set[int] = set()
    open_: list[tuple[int, int]] = []
    for place, end, c in sorted(spans, key=lambda x: (x[0], -x[1])):
        while open_ and open_[-1][0] < place:
            open_.pop()
        if open_ and open_[-1][0] < end:
            # Of two that cross, the one with fewer tokens in the page isn't structure.
            crossed.add(min((len(by[c]), c), (len(by[open_[-1][1]]), open_[-1][1]))[1])
        else:
            open_.append((end, c))
    return order, crossed


def without_menus(blocks: list[tuple[int, str, int, int, int]]) -> list[tuple[int, str, int, int, int]]:
    """Without rows of links: MENU or more blocks one after the other, or links in one block, that are little but links."""
    linked = [b[2] >= LINKED * len(b[1]) for b in blocks]
    out, i = [], 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and linked[j]:
            j += 1
        if j - i < MENU:
            out += [b for b in blocks[i:j] if b[3] < MENU]
        if j < len(blocks):
            out.append(blocks[j])
        i = j + 1
    return out


def block_token(path: int, line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFF) >> 1


def host_of(url: str | None) -> int:
    """Hash of the host; pages without one share a host."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")) >> 1


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the host of the first column in front."""
    for b in batches:
        hosts = pa.array([host_of(u) for u in b.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([hosts, *b.columns], ["host", *b.schema.names])


class Sums:
    """Counts by host and token, passed on when a task holds many."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], first: list[int]) -> None:
        self.held: dict[tuple[int, int], list] = {}
        self.names, self.kinds, self.first = ["host", "token", *names], [pa.int64(), pa.int64(), *kinds], first

    def of(self, host: int, token: int) -> list:
        x = self.held.get((host, token))
        if x is None:
            x = self.held[host, token] = list(self.first)
        return x

    def out(self) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in self.held.items()]
        self.held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(self.kinds)], self.names)


def templated(rows: DataFrame, found: DataFrame, work: Callable, schema: str, limit: int | None = None, hot: int = HOT) -> DataFrame:
    """rows (url, ...) through work, which gets batches, each with the host and a dict (token to value) or None for each row. found: (host, tokens, values), checkpointed.

    Few tokens are broadcast. Many are joined by host; hosts of over ``hot`` rows are dealt by a hash
    of the row, their tokens repeated for each part. The list of these hosts, at most a row of
    16 bytes for each ``hot`` rows, is on the driver.
    """
    size = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    names, held = rows.columns, None
    if size <= (BROADCAST_TOKENS if limit is None else limit):
        held = rows.sparkSession.sparkContext.broadcast({r.host: (np.array(r.tokens, np.int64), np.array(r["values"], np.int64)) for r in found.toLocalIterator()})
    else:
        hosts = common.map_texts(rows.select(names[0]), lambda batches: (b.select(["host"]) for b in hashed(batches)), "host long")
        parts = [(r.host, -(-r.n // hot)) for r in hosts.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > hot).collect()]
        n = rows.sparkSession.createDataFrame(parts, "host long, n int")
        own = common.map_texts(rows, hashed, f"host long, {rows.schema.simpleString()[7:-1]}")
        part = F.pmod(F.xxhash64(*names), F.coalesce("n", F.lit(1))).cast("int")
        dealt = own.join(F.broadcast(n), "host", "left").withColumn("part", part).drop("n")
        copies = found.join(F.broadcast(n), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
        rows = dealt.join(copies, ["host", "part"], "left").select(*names, "host", "tokens", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, dict[int, int]] = {}

        def of(host: int) -> dict[int, int] | None:
            if host not in held.value:
                return None
            if host not in ready:
                if len(ready) > 1000:
                    ready.clear()
                ready[host] = dict(zip(*[x.tolist() for x in held.value[host]], strict=True))
            return ready[host]

        def beside() -> Iterator[tuple[pa.RecordBatch, list, list]]:
            for b in batches:
                if held is not None:
                    hosts = [host_of(u) for u in b.column(0).to_pylist()]
                    yield b, hosts, [of(h) for h in hosts]
                else:
                    hosts, tokens, values = (b.column(x).to_pylist() for x in ("host", "tokens", "values"))
                    yield b, hosts, [dict(zip(t, v, strict=True)) if t else None for t, v in zip(tokens, values, strict=True)]

        return work(beside())

    return common.map_texts(rows, run, schema)


def classes_of(pages: DataFrame) -> DataFrame:
    """(host, all, tokens, values, pages, total): tokens of enough pages of each host, their classes and counts, by token. pages: (url, html), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["pages", "total", "f1", "f2"], [pa.int64()] * 4, [0] * 4)
        for b in batches:
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                h = xxhash.xxh64_intdigest((source or "").encode("utf-8", "surrogatepass"))
                h1, h2 = h & 0x3FFFFFFF, h >> 34
                for token, n in [(0, 1), *Page(source).tokens().items()]:
                    x = sums.of(host, token)
                    x[0] += 1
                    x[1] += n
                    x[2] += n * h1
                    x[3] += n * h2
            if len(sums.held) > HELD:
                yield sums.out()
        yield sums.out()

    counts = common.map_texts(pages, run, "host long, token long, pages long, total long, f1 long, f2 long")
    summed = common.checkpoint(counts.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "f1", "f2")]).where(f"pages >= {LEAST_PAGES}"))
    hosts = summed.where("token = 0").select("host", F.col("pages").alias("all"))
    tokens = summed.where("token <> 0").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    kind = F.shiftrightunsigned(F.xxhash64("pages", "total", "f1", "f2"), 1)
    member = F.struct("token", kind.alias("c"), "pages", "total")
    gathered = tokens.groupBy("host").agg(F.first("all").alias("all"), F.collect_list(member).alias("x"))
    return gathered.select("host", "all", F.col("x.token").alias("tokens"), F.col("x.c").alias("values"), F.col("x.pages").alias("pages"), F.col("x.total").alias("total"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, values): the template of each host that has one, as Page.text takes it. pages: (url, html), distinct on a host."""
    classes = common.checkpoint(classes_of(pages))

    def run(batches: Iterator[tuple[pa.RecordBatch, list, list]]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["low", "high", "crossed", "mass", "up", "name"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], [(1 << 63) - 1, -2, 0, 0, 0, ""])
        for b, hosts, known in batches:
            for host, source, own in zip(hosts, b.column(1).to_pylist(), known, strict=True):
                if own is None:
                    continue
                for token, (order, crossed, mass, up, name) in Page(source).layout(own).items():
                    x = sums.of(host, token)
                    x[0], x[1] = min(x[0], order), max(x[1], order)
                    x[2] += crossed
                    x[3] += mass
                    x[4], x[5] = up, name
            if len(sums.held) > HELD:
                yield sums.out()
        yield sums.out()

    schema = "host long, token long, low long, high long, crossed long, mass long, up long, name string"
    laid = templated(pages, classes.select("host", "tokens", "values"), run, schema).groupBy("host", "token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("crossed").alias("crossed"), F.sum("mass").alias("mass"), F.max("up").alias("up"), F.max("name").alias("name"))
    laid = laid.groupBy("host").agg(F.collect_list(F.struct("token", "low", "high", "crossed", "mass", "up", "name")).alias("laid"))
    both = classes.join(laid, "host").select("host", "all", F.arrays_zip("tokens", "values", "pages", "total").alias("own"), "laid")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [template_of(*row) for row in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in out], pa.list_(pa.int64())), pa.array([list(x.values()) for x in out], pa.list_(pa.int64()))], ["host", "tokens", "values"])

    return common.map_texts(both, decide, "host long, tokens array<long>, values array<long>").where("size(tokens) > 0")


def template_of(pages: int, own: list[dict], laid: list[dict]) -> dict[int, int]:
    """Template text (2) and the main element (3) of a host. own: tokens, values (classes), pages, total; laid: what layout sums to."""
    at = {x["token"]: x for x in laid}
    sizes = Counter(x["values"] for x in own)
    valid = {}
    for x in own:
        place = at.get(x["tokens"])
        if place and (sizes[x["values"]] > 1 or x["pages"] == pages) and place["low"] == place["high"] >= 0 and not place["crossed"]:
            valid[x["tokens"]] = x
    out = {t: 2 for t, x in valid.items() if not at[t]["name"] and x["pages"] >= TEXT_SUPPORT * pages}
    elements = {t for t, x in valid.items() if at[t]["name"] and x["pages"] == x["total"] and at[t]["mass"] > 0}
    below: dict[int, list[int]] = {}
    for t in elements:
        up = at[t]["up"]
        while up and up not in elements:
            up = at[up]["up"] if up in at else 0
        below.setdefault(up, []).append(t)
    now, mass, name = 0, sum(at[t]["mass"] for t in below.get(0, ())), ""
    while name != "article":
        inner = [t for t in below.get(now, ()) if at[t]["name"] not in TEXTUAL and (name != "main" or at[t]["name"] == "article")]
        best = max(inner, key=lambda t: (at[t]["mass"], at[t]["name"] == "article", t), default=None)
        if best is None or at[best]["mass"] < SHARE * mass:
            break
        now, mass, name = best, at[best]["mass"], at[best]["name"]
    if now:
        out[now] = 3
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, by_template) for each row of pages; blocks of the main text are joined by newlines.

    by_template says whether the host's template decided, rather than the page's own elements. Null
    and empty pages give an empty text. Very long and deep pages are read whole, in time in
    proportion to their length. Pages without a host share one. Copies of a page on a host count
    once: what only they share is no template. Repeated rows get equal values; ids may be null. An
    empty table gives an empty one. Other columns aren't read.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col(id_col).alias("id"))
    # To find copies, the host need only be told apart as host_of does.
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    sources = rows.where("html IS NOT NULL").select("url", "html", host.alias("host"), F.xxhash64("html").alias("copy"))
    found = common.checkpoint(templates(common.once(sources, ["host", "copy"]).select("url", "html")))

    def run(batches: Iterator[tuple[pa.RecordBatch, list, list]]) -> Iterator[pa.RecordBatch]:
        for b, _, known in batches:
            out = [Page(source).text(own) for source, own in zip(b.column(1).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.bool_())], ["id", "url", "text", "by_template"])

    return templated(rows, found, run, f"id {common.type_of(pages, id_col)}, url string, text string, by_template boolean")
