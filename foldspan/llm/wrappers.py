"""Main text of HTML pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tokens: block tags, and text. Equal neighbours fold into a repeated group. The streams of one
host are aligned one after another with the wrapper so far: texts that differ become slots, tags that only one side
has become an optional group, or a repeated one if they continue the group before them. The wrapper of a host then
says which slots hold the main text: those inside an article if there is one, else those whose text varies between
pages and isn't mostly links, in the part of the page that has most of it; never those whose tags or names mark
menus, notices, comments and the like.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.plans.lineage import cut

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select option button textarea audio video map datalist".split())
#: Elements around anything but the main text.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset(("article", "main"))
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("html body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph or an element of their own kind.
CLOSES = {"p": BLOCK, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr", "tbody", "tfoot"))}
#: Words of class, id and role attributes that mark other parts of a page.
NAMED = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot colophon sidebar side aside widget widgets rail ad ads adv advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond responses discussion search form pagination pager toolbar copyright skip legal tags meta complementary contentinfo".split()
)
#: Words that say nothing of their own beside those: only a name of marking and such words marks a part.
NEUTRAL = frozenset("site page main global top bottom left right box block list section container wrapper wrap inner outer item items bar area panel link links button buttons row col column slot unit zone body text content post posts article articles story stories primary secondary bg js".split())
#: Quotes delimit a value only right after its equals sign; elsewhere, as in ``x=it's``, they are characters like others.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)|[^>])*)(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
LINKED, HIDDEN = "a", re.compile(r"""(?:^|[\s"'/])(hidden|aria-hidden\s*=\s*["']?true)(?=[\s"'/=]|$)|display\s*:\s*none""", re.I)
#: A block's share of link text from which it is a link.
LINK_SHARE = 0.6
#: Names that say a part is no main text are overruled if less than this share of the varying text is outside such parts.
OVERRULED = 0.1
#: Characters of all wrappers up to which they are broadcast.
BROADCAST_CHARS = 64 << 20
#: Groups in which the wrappers of a host are aligned before its last alignment.
SALTS = 32


def label(tag: str, attributes: str) -> str:
    """A token of an opening tag: its name and the words of its names, marked by ``!`` if they say it's not main text."""
    names = [re.findall(r"[a-z]+", n) for _, v in NAMES.findall(attributes) for n in v.strip("\"'").lower().split()] if attributes else []
    words = {w for n in names for w in n}
    # share-price and related-work name parts of a text, share-buttons and related-posts do not
    # no-sidebar and has-menu say something of the part's layout, as do all names of the whole page
    named = tag not in ("html", "body") and any(NAMED.intersection(n) and all(w in NAMED or w in NEUTRAL for w in n) for n in names)
    bad = tag in ASIDE or named or bool(attributes and HIDDEN.search(attributes))
    if "main" in words and not bad and tag not in MAIN:
        words.add("main")
    return tag + "".join(f".{w}" for w in sorted(words)) + ("!" if bad else "")


def blocks(page: str | None) -> Iterator[tuple[str, str, int]]:
    """``(path, text, characters inside links)`` of each block of text in page order; the path names the open blocks."""
    stack: list[str] = []  # labels of open blocks
    text: list[str] = []
    linked, in_link, at, page = 0, False, 0, page or ""

    def flush():
        nonlocal linked
        t = " ".join(entities.unescape("".join(text)).split())
        n, linked = min(linked, len(t)), 0
        text.clear()
        return [("/".join(stack), t, n)] if t else []

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            linked += len(piece) * in_link
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text.append(entities.escape(m[0][9:].removesuffix("]]>")))
        if not m[2]:
            continue
        tag, close = m[2].lower(), bool(m[1])
        if not close and tag in SILENT and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "template", "noscript", "title") else at)
            text.append(" ")
        elif tag == "a":
            in_link = not close
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            yield from flush()
            in_link = False
            if close:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].split(".")[0].rstrip("!") == tag), None)
                if depth is not None:
                    del stack[depth:]
            else:
                while stack and tag in CLOSES.get(stack[-1].split(".")[0].rstrip("!"), ()):
                    stack.pop()
                if tag not in VOID:
                    stack.append(label(tag, m[3]))
    yield from flush()


# Wrappers. A node is a token (a block's path), or [kind, nodes] with kind "?" (optional) or "+" (repeated).


def folded(tokens: list) -> list:
    """Equal neighbouring runs of tokens as one repeated group, short runs first."""
    for width in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(tokens):
            run, times = tokens[i : i + width], 1
            while len(run) == width and tokens[i + times * width : i + (times + 1) * width] == run:
                times += 1
            if times > 1:
                out.append(run[0] if width == 1 and isinstance(run[0], list) and run[0][0] == "+" else ["+", run])
                i += times * width
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def key(node) -> str:
    """What two nodes must share to be aligned: a group is aligned with its content."""
    while isinstance(node, list):
        node = node[1][0]
    return node


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal keys, both rising: a longest common subsequence, in memory linear in the lists.

    Keys that only one list has match nothing and are left out first. A stretch is halved at the middle of a shortest
    way from its start to its end (found from both sides at once), each half likewise.
    """
    common = set(a) & set(b)
    left, right = ([i for i, k in enumerate(x) if k in common] for x in (a, b))
    x, y = [a[i] for i in left], [b[j] for j in right]
    found, open_ = [], [(0, len(x), 0, len(y))]
    while open_:
        lo, hi, at, to = open_.pop()
        while lo < hi and at < to and x[lo] == y[at]:
            found.append((left[lo], right[at]))
            lo, at = lo + 1, at + 1
        while lo < hi and at < to and x[hi - 1] == y[to - 1]:
            hi, to = hi - 1, to - 1
            found.append((left[hi], right[to]))
        if lo < hi and at < to:
            p, q = middle(x[lo:hi], y[at:to])
            open_ += [(lo, lo + p, at, at + q), (lo + p, hi, at + q, to)]
    return sorted(found)


def middle(x: list[str], y: list[str]) -> tuple[int, int]:
    """A place in both lists that a shortest edit of one into the other passes; neither their start nor their end."""
    n, m = len(x), len(y)
    delta, ahead, behind = n - m, {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for mine, other, forward in ((ahead, behind, True), (behind, ahead, False)):
            for k in range(-d, d + 1, 2):
                i = mine.get(k + 1, -1) if k == -d or (k != d and mine.get(k - 1, -1) < mine.get(k + 1, -1)) else mine.get(k - 1, -1) + 1
                j = i - k
                if i < 0 or i > n or j < 0 or j > m:
                    continue
                while i < n and j < m and (x[i] == y[j] if forward else x[n - 1 - i] == y[m - 1 - j]):
                    i, j = i + 1, j + 1
                mine[k] = i
                if i + other.get(delta - k, -n - 1) >= n and (delta % 2 == 1) == forward:
                    return (i, j) if forward else (n - i, m - j)
    raise AssertionError("two ways always meet")


def peeled(node) -> tuple[list, set]:
    """The nodes inside a node and the kinds of the groups around them; a group of one group counts as both."""
    nodes, kinds = [node], set()
    while len(nodes) == 1 and isinstance(nodes[0], list):
        kind, nodes = nodes[0]
        kinds.add(kind)
    return nodes, kinds


def grouped(nodes: list, kinds: set):
    """The node that repeats ``nodes`` or leaves them out, as ``kinds`` and a lone group among them say."""
    if len(nodes) == 1:
        nodes, own = peeled(nodes[0])
        kinds = kinds | own
    out = ["+", nodes] if "+" in kinds else nodes[0] if len(nodes) == 1 else None
    return out if "?" not in kinds else ["?", nodes if out is None else [out]]


def aligned(wrapper: list, page: list) -> list:
    """The wrapper that also fits ``page``: both in order, with what only one has optional or repeated."""
    a, b = [key(n) for n in wrapper], [key(n) for n in page]

    def merged(x, y):
        if x == y:
            return x
        (left, kinds), (right, others) = peeled(x), peeled(y)
        return grouped(aligned(left, right), kinds | others)

    def extra(nodes):
        """Nodes that one side lacks: part of the repeated group before them, or optional."""
        for n in nodes:
            before = out[-1] if out else None
            if before is not None and key(before) == key(n):
                (left, kinds), (right, _) = peeled(before), peeled(n)
                out[-1] = grouped(left if left == right else aligned(left, right), kinds | {"+"})
            else:
                out.append(grouped([n], {"?"}))

    out: list = []
    i = j = 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        extra(wrapper[i:p])
        extra(page[j:q])
        if p < len(a):
            out.append(merged(wrapper[p], page[q]))
        i, j = p + 1, q + 1
    return folded(out)


def expression(wrapper: list) -> str:
    """The wrapper as text: paths with slots, groups with ``?`` or ``+``."""
    return " ".join(f"({expression(n[1])}){n[0]}" if isinstance(n, list) else f"{n}/#PCDATA" for n in wrapper)


class Wrapper:
    """An automaton of a wrapper's slots that says to which of them each block of a page belongs; sets are bit masks."""

    def __init__(self, nodes: list):
        self.paths: list[str] = []
        self.follow: list[int] = []
        self.first = self._row(nodes)[0]
        self.at: dict[str, int] = {}
        for i, p in enumerate(self.paths):
            self.at[p] = self.at.get(p, 0) | 1 << i
        self.known: dict[tuple, list[int]] = {}

    def _row(self, nodes: list) -> tuple[int, int, bool]:
        """Slots that can be first and last, and whether there may be none."""
        first, last, empty = 0, 0, True
        for n in nodes:
            if isinstance(n, list):
                f, t, e = self._row(n[1])
                if n[0] == "+":
                    self._link(t, f)
                e |= n[0] == "?"
            else:
                f = t = 1 << len(self.paths)
                e = False
                self.paths.append(n)
                self.follow.append(0)
            self._link(last, f)
            first, last, empty = first | f if empty else first, last | t if e else t, empty and e
        return first, last, empty

    def _link(self, last: int, first: int) -> None:
        for i in ones(last):
            self.follow[i] |= first

    def match(self, tokens: list[str]) -> list[str]:
        """The slot of each token as text; where a page leaves the wrapper it goes on at any slot of the same path, else at the path."""
        known = self.known.get(of := tuple(tokens))
        if known is not None:
            return known
        sets, allowed = [], self.first
        for t in tokens:
            here = self.at.get(t, 0)
            sets.append(allowed & here or here)
            if here:
                allowed = 0
                for i in ones(sets[-1]):
                    allowed |= self.follow[i]
        out, then = list(tokens), None
        for k in range(len(tokens) - 1, -1, -1):
            fits = [i for i in ones(sets[k]) if then is None or self.follow[i] >> then & 1] or list(ones(sets[k]))
            if fits:
                then = fits[0]
                out[k] = str(then)
        if len(self.known) < 256:
            self.known[of] = out
        return out


def ones(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


@functools.lru_cache(1024)
def compiled(wrapper: str) -> Wrapper:
    return Wrapper(json.loads(wrapper))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host of a partition its wrapper; hosts leave in bounded numbers."""

    def emit():
        out = pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(w) for w in hosts.values()], pa.string())], names=["host", "wrapper"])
        hosts.clear()
        return out

    hosts: dict = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            stream = folded([p for p, _, _ in blocks(page)])
            if not stream:
                continue
            wrapper = hosts.get(host, stream)
            hosts[host] = wrapper if wrapper == stream else aligned(wrapper, stream)
            if len(hosts) >= 2000:
                yield emit()
    if hosts:
        yield emit()


FIGURES = "host string, slot string, path string, plain bigint, blocks bigint, linked bigint, lo bigint, hi bigint, page_lo bigint, page_hi bigint"


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of the slots of each host of a partition: characters of blocks that are no links, blocks, those that are
    links, extremes of the hashes of the texts and of the pages that have the slot."""
    names = [x.split()[0] for x in FIGURES.split(", ")]

    def emit():
        out = pa.RecordBatch.from_pandas(pd.DataFrame([(*k, *v) for k, v in slots.items()], columns=names), preserve_index=False)
        slots.clear()
        return out

    hashed = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
    slots: dict = {}
    for batch in batches:
        for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
            found = list(blocks(page))
            of_page: dict = {}
            for slot, (path, t, n) in zip(compiled(wrapper).match([p for p, _, _ in found]), found, strict=True):
                texts = of_page.setdefault((host, slot, path), [[], 0, 0])
                texts[0].append(t)
                texts[1] += len(t) * (not is_link(t, n))
                texts[2] += is_link(t, n)
            whole = hashed("\n".join(f"{path}\t{t}" for path, t, _ in found))
            for k, (texts, plain, linked) in of_page.items():
                digest = hashed("\n".join(texts))
                old = slots.get(k, (0, 0, 0, digest, digest, whole, whole))
                slots[k] = (old[0] + plain, old[1] + len(texts), old[2] + linked, min(old[3], digest), max(old[4], digest), min(old[5], whole), max(old[6], whole))
            if len(slots) >= 50_000:
                yield emit()
    if slots:
        yield emit()


def is_link(text: str, linked: int) -> bool:
    """A block of text that is mostly in links."""
    return linked >= LINK_SHARE * len(text)


def is_main(path: str) -> bool:
    return any(p.split(".")[0] in MAIN or ".main" in p for p in path.split("/"))


def is_marked(path: str) -> bool:
    """Some element on the path is no main text; a header inside the article only introduces it."""
    inside = False
    for p in path.split("/"):
        inside |= p.split(".")[0] in MAIN
        if p.endswith("!") and not (inside and p == "header!"):
            return True
    return False


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def content_slots(slots: list[tuple]) -> tuple[list[str], list[str]]:
    """The slots of a host that hold main text, and those of them of which links are left out.

    ``slots`` are (slot, path, characters outside link blocks, link blocks are most, shared by different pages, varies).
    What different pages share in a slot and never varies is template, but for headings inside an article or beside main
    text; what only one page has, or copies of it, is nothing that pages share and counts as varying.
    """
    compared = any(s[5] for s in slots)
    open_ = [s for s in slots if not compared or s[5] or not s[4]]
    texts = [s for s in open_ if s[2]]
    free = [s for s in texts if not is_marked(s[1])]
    total = sum(s[2] for s in texts)
    if sum(s[2] for s in free) < OVERRULED * total or not free:
        free = texts
    if not compared and (main := [s for s in free if is_main(s[1])]):
        free = main  # no page to compare with: only the names say something
    total = sum(s[2] for s in free)
    weigh: dict[str, int] = {}
    for s in free:
        steps = s[1].split("/")
        for k in range(1, len(steps) + 1):
            at = "/".join(steps[:k])
            weigh[at] = weigh.get(at, 0) + s[2]
    # the deepest part of the page with most of the text that varies; all of an article that it lies in
    part = max((p for p, w in weigh.items() if 2 * w > total), key=lambda p: (p.count("/"), p), default="")
    steps = part.split("/")
    if (outer := next((k for k, p in enumerate(steps) if is_main(p)), None)) is not None:
        part = "/".join(steps[: outer + 1])
    elif steps[-1].split(".")[0] in ("p", "li", *HEADINGS):
        part = part.rpartition("/")[0]
    within = lambda s: not part or s[1] == part or s[1].startswith(part + "/")
    above = lambda s: s[1].rpartition("/")[0]
    inside = [s for s in (open_ if is_main(part) else texts) if within(s)]
    beside = {above(s) for s in inside}
    inside += [s for s in slots if s not in inside and within(s) and s[2] and (is_main(part) or above(s) in beside) and s[1].rpartition("/")[2].split(".")[0] in HEADINGS]
    below = [s for s in inside if not is_marked(s[1][len(part) :] if part and not is_main(part) else s[1])]
    chosen = below or inside
    return sorted(s[0] for s in chosen), sorted(s[0] for s in chosen if s[3] and not is_main(part))


def _inferred(pdf: pd.DataFrame) -> pd.DataFrame:
    wrapper: list | None = None
    for w in sorted(pdf["wrapper"]):
        wrapper = json.loads(w) if wrapper is None else aligned(wrapper, json.loads(w))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    slots, plain = content_slots([(r.slot, r.path, r.plain, 2 * r.linked > r.blocks, r.page_lo != r.page_hi, r.lo != r.hi) for r in pdf.itertuples()])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slots": [slots], "plain": [plain]})


def _beside(rows: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``hosts``, already computed, has for their host; broadcast where that is small."""
    chars = hosts.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    hosts = hosts.withColumnRenamed("host", "of")
    return rows.join(F.broadcast(hosts) if chars <= BROADCAST_CHARS else hosts, F.col("host") == F.col("of"), how).drop("of")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, slots, plain)`` from ``host`` and ``html`` of all pages; of the slots in ``plain`` links are left out.

    Each partition aligns its pages; the distinct wrappers of partitions, not pages, are aligned in ``SALTS`` groups a
    host, and the wrappers of those groups last. Pages are then matched against the wrapper of their host, and the
    figures of its slots, merged by an aggregate, say which hold main text. Null hosts are one host.
    """
    rows = pages.select(F.coalesce(F.col("host"), F.lit("")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null")
    parts = rows.mapInArrow(_sketch, "host string, wrapper string").distinct().groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    wrappers = cut(parts.applyInPandas(_inferred, "host string, wrapper string").groupBy("host").applyInPandas(_inferred, "host string, wrapper string"))
    figures = _beside(rows, wrappers, "inner").mapInArrow(_figures, FIGURES)
    merged = figures.groupBy("host", "slot", "path").agg(*[F.sum(c).alias(c) for c in ("plain", "blocks", "linked")], *[f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "page_lo"), (F.max, "page_hi"))])
    return wrappers.join(merged.groupBy("host").applyInPandas(_chosen, "host string, slots array<string>, plain array<string>"), "host")


def extracted(page: str | None, wrapper: str | None, slots: list[str] | None, plain: list[str] | None = None) -> str:
    """The blocks of a page in the chosen slots of its host's wrapper, by two newlines; of those in ``plain`` no links."""
    found = list(blocks(page))
    if not found or wrapper is None:
        return ""
    chosen, unlinked = set(slots or ()), set(plain or ())
    of = compiled(wrapper).match([p for p, _, _ in found])
    return "\n\n".join(t for slot, (_, t, n) in zip(of, found, strict=True) if slot in chosen and not (slot in unlinked and is_link(t, n)))


def main_text(html: Column, *host: Column) -> Column:
    """The main text of pages by the wrapper, slots and plain slots of their hosts."""

    def run(page: pa.Array, known: pa.Array, chosen: pa.Array, plain: pa.Array) -> pa.Array:
        return pa.array([extracted(*x) for x in zip(page.to_pylist(), known.to_pylist(), chosen.to_pylist(), plain.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(html, *host)


def extract_pages(pages: DataFrame, host: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; ``host`` says which pages share a template.

    A null or empty page has an empty text. Wrappers come to the pages by an equi-join on the host, broadcast where
    they are small. Repeated pages are extracted alike, and a host that has only those is a host of one page. A page of
    any length is parsed whole and aligned in memory linear in it. Of parts that hold equally much, the one with
    the greater path is taken. No pages, no rows. Only the three columns and what ``host`` reads are used, so that
    other names cannot clash.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    out = _beside(rows, cut(infer_wrappers(rows)), "left").withColumn("text", main_text(F.col("html"), F.col("wrapper"), F.col("slots"), F.col("plain")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
