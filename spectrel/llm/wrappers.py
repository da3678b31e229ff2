"""Main text of web pages by wrappers: union-free regular expressions over the pages of a host.

A page is a stream of block-level tags and texts (inline tags are part of their text; tags left open are closed as HTML closes them).
Neighbours that repeat are folded into a repeated group. The streams of a host are aligned one after the other into its wrapper:
what only some hold becomes optional, repeats stay repeated groups, and texts that differ become slots, while texts that all pages
share stay as they are. Wrappers of parts of a host's pages are aligned in the same way, 64 at a time, until each host has one.
A level of more than `WIDE` items that differ becomes a repeated group of optional items, so a wrapper's size is bounded by kinds of
tags and depth, not by pages.

The wrapper says which texts are main text: those in the article (or main) element, or, where a host has none, those in the smallest
element with most of the host's changing text outside links. Menus, headers, footers, sidebars, notices, adverts, forms and comments,
told by tag, role or class, are left out, and so are texts that at least `SHARED` different pages of the host share while others change.

Null html gives an empty text; null url is the host "". Equal rows give equal rows; an empty table none; other columns are not looked
at. Elements nested deeper than `DEPTH` count as the one above. The text does not depend on other hosts.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

WIDE, DEPTH, SHARED, FAN = 64, 120, 8, 64
#: Wrappers of more than this many characters together are not broadcast but joined by a shuffle.
BROADCAST_CHARS = 32 << 20
#: Hosts whose wrappers a task holds before it passes them on.
HELD_HOSTS = 2000

# HTML's element names by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript template iframe object svg math select xmp noembed noframes canvas audio video".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"thead", "tbody"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "p": {"td", "th", "table", "li"}}
#: Elements that say nothing of what they hold: neighbours repeat each other only if they hold the same kinds of children.
PLAIN = {"div", "section", "x", "center", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KNOWN = VOID | INLINE | RAW | CLOSES_P | set("html head body li dt dd tr td th tbody thead tfoot caption colgroup button label legend option optgroup summary output picture".split())
_READ = dict.fromkeys(RAW, "raw") | dict.fromkeys(INLINE | {"br", "img", "wbr", "source", "track", "embed", "area"}, "inline")
#: Elements and parts of names (class, id, role) that hold no main text.
LEFT_OUT = set("nav aside footer form button menu dialog head label legend search".split())
LEFT_OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright discussion disqus "
    "footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup popular promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
HEAD_NAMES = {"header", "banner", "masthead"}

_TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*)|[!?](?:[^>]*>|.*)"  # comments and declarations, or what is left of one
    r"|(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>"  # a tag
    r"|(/?)([A-Za-z][^\s/>]*)([^>]*)>)",  # a tag with an open quote
    re.S,
)
_ENDS = {name: re.compile(f"</{name}(?:[\\s/][^>]*)?>", re.I) for name in RAW}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: name, label (name and parts of class, id and role), children (nodes, or texts as [text, characters in links])."""

    __slots__ = ("name", "label", "children")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.children = name, label, []


def _label(name: str, attributes: str) -> str:
    known = name if name in KNOWN else "x"
    if not attributes or attributes.isspace():
        return known
    words = {w[:24] for _, value in _NAMES.findall(attributes) for w in _PART.findall(_CAMEL.sub(" ", value).lower())}
    # names that leave an element out always stay in its label
    first = sorted(words, key=lambda w: (w not in LEFT_OUT_NAMES, w))[:6]
    return ".".join([known, *sorted(first), *(["hidden"] if _HIDDEN.search(attributes) and "hidden" not in first else [])])


def parsed(page: str, plain: bool = True) -> Node:
    """The tree of a page's blocks. plain: texts as text; else as they stand in the page, which is enough to tell them apart."""
    root = Node("#root", "#root")
    stack, buffer, place, size = [root], [], 0, len(page)
    links = linked = 0  # in a link?; characters of the buffer in links

    def flush():
        nonlocal linked
        text = "".join(buffer)
        if plain:
            text = " ".join((html_entities.unescape(text) if "&" in text else text).split())
        else:
            text = text.strip()
        if text:
            stack[-1].children.append([text, min(linked, len(text))])
        buffer.clear()
        linked = 0

    def close(names, scope):
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].name
            if name in names:
                if buffer:
                    flush()
                del stack[k:]
                return
            if name in scope:
                return

    search = _TOKEN.search
    while place < size:
        found = search(page, place)
        at = found.start() if found else size
        if at > place:
            buffer.append(page[place:at])
            if links:
                linked += at - place
        if not found:
            break
        place = found.end()
        closing, name, attributes = found.group(1, 2, 3)
        if name is None:
            closing, name, attributes = found.group(4, 5, 6)
            if name is None:
                continue
        name = name.lower()
        kind = _READ.get(name, "block")
        if kind == "inline":
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                links = 0 if closing else 1
            # an inline element whose name says so is taken out like a block
            if closing:
                if len(stack) > 1 and any(n.name == name for n in stack[1:]):
                    close({name}, CLOSES_P)
            elif attributes and name not in VOID and not attributes.isspace() and _left_out(label := _label(name, attributes), True):
                if buffer:
                    flush()
                stack.append(Node(name, label))
                stack[-2].children.append(stack[-1])
            continue
        if kind == "raw":
            if not closing and not attributes.endswith("/"):
                end = _ENDS[name].search(page, place)
                place = end.end() if end else size
            if buffer and name not in ("noscript", "svg", "math"):
                flush()
            continue
        if buffer:
            flush()
        if closing:
            if stack[-1].name == name and len(stack) > 1:
                stack.pop()
            else:
                close({name}, ())
            continue
        if name in CLOSES_P:
            if stack[-1].name == "p":
                stack.pop()
            else:
                close({"p"}, SCOPES["p"])
            links = 0
        if name in SIBLINGS:
            close(SIBLINGS[name], SCOPES.get(name, ()))
        if name in VOID:
            continue
        node = Node(name, _label(name, attributes))
        stack[-1].children.append(node)
        if len(stack) <= DEPTH:
            stack.append(node)
    if buffer:
        flush()
    return root


# A wrapper is a list of items [label, optional, repeated, inside]: inside is a list of items, or for texts ("#") what is known of
# them: [digest or None where they differ, pages, characters, characters in links, name of the element].


def _entries(children: list) -> list[tuple[str, list]]:
    """Children as (label, occurrences), repeats folded: first of one label, then of up to four labels in a row."""
    out: list[tuple[str, list]] = []
    for c in children:
        label = c.label if isinstance(c, Node) else "#"
        if out and out[-1][0] == label and (label.split(".")[0] not in PLAIN or _kinds(out[-1][1][-1]) == _kinds(c)):
            out[-1][1].append(c)
        else:
            out.append((label, [c]))
    if len(out) > 3:
        for n in (2, 3, 4):
            out = _tandem(out, n)
    return out


def _kinds(node: Node) -> set[str]:
    return {c.label if isinstance(c, Node) else "#" for c in node.children}


def _tandem(entries: list, n: int) -> list:
    labels, out, i = [e[0] for e in entries], [], 0
    while i < len(entries):
        j = i + n
        while labels[i : i + n] == labels[j : j + n] and j + n <= len(entries):
            j += n
        if j > i + n and len(set(labels[i : i + n])) > 1:
            out.append(("(" + "|".join(labels[i : i + n]) + ")", [entries[k : k + n] for k in range(i, j, n)]))
            i = j
        else:
            out.append(entries[i])
            i += 1
    return out


def _units(label: str) -> list[str]:
    """The labels inside a group's label."""
    out, depth, begin = [], 0, 1
    for k in range(1, len(label) - 1):
        depth += (label[k] == "(") - (label[k] == ")")
        if label[k] == "|" and not depth:
            out.append(label[begin:k])
            begin = k + 1
    return [*out, label[begin:-1]]


def _regrouped(labels: list[str], other: list[str]) -> list[tuple[int, int, str]]:
    """How places of labels go together so that groups of `other` are met: (from, to, group or "")."""
    groups = {tuple(_units(g)): g for g in other if g[0] == "(" and g not in labels}
    out, i = [], 0
    while i < len(labels):
        fit = next(((n, groups[u]) for u in groups if (n := len(u)) and tuple(labels[i : i + n]) == u), None)
        out.append((i, i + fit[0], fit[1]) if fit else (i, i + 1, ""))
        i = out[-1][1]
    return out


def _matched(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment of two label lists by a longest common subsequence."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(lo)]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append((lo + i, None))
            i += 1
        else:
            out.append((None, lo + j))
            j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def _learn(entries: list, name: str) -> list:
    """The wrapper of one page's entries."""
    items = []
    for label, found in entries:
        if label == "#":
            inside: list = [_digest(found[0][0]), 1, len(found[0][0]), found[0][1], name]
        elif label[0] == "(":
            inside = _learn(found[0], name)
            for more in found[1:]:
                inside = align(inside, _learn(more, name))
        elif all(len(n.children) == 1 and not isinstance(n.children[0], Node) for n in found):
            texts = [n.children[0] for n in found]
            same = all(t[0] == texts[0][0] for t in texts)
            inside = [["#", False, False, [_digest(texts[0][0]) if same else None, len(texts), sum(len(t[0]) for t in texts), sum(t[1] for t in texts), found[0].name]]]
        else:
            inside = learn(found[0])
            for more in found[1:]:
                inside = align(inside, learn(more))
        items.append([label, False, len(found) > 1, inside])
    return _bounded(items)


def learn(node: Node) -> list:
    return _learn(_entries(node.children), node.name)


def _starred(items: list) -> list:
    """One repeated group of optional items, one of each label."""
    held: dict[str, list] = {}
    flat = list(items)
    while any(x[0][0] in "(*" for x in flat):
        flat = [x for item in flat for x in (item[3] if item[0][0] in "(*" else [item])]
    for label, _, repeated, inside in flat:
        if label not in held and len(held) >= 4 * WIDE:
            label = label.split(".")[0]
        if label in held:
            held[label] = [label, True, True, _merged(label, held[label][3], inside)]
        else:
            held[label] = [label, True, repeated, inside]
    return [["*", False, True, [held[k] for k in sorted(held)]]]


def _bounded(items: list) -> list:
    return _starred(items) if len(items) > WIDE else items


def _merged(label: str, a: list, b: list) -> list:
    if label == "#":
        return [a[0] if a[0] == b[0] else None, a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4]]
    return align(a, b)


def align(a: list, b: list) -> list:
    """The wrapper of what two wrappers stand for."""
    if any(x[0] == "*" for x in (*a, *b)):
        return _starred(a + b)
    first, second = [x[0] for x in a], [x[0] for x in b]
    if first == second:
        return [[x[0], x[1] or y[1], x[2] or y[2], _merged(x[0], x[3], y[3])] for x, y in zip(a, b, strict=True)]
    gather = lambda items, labels, other: [[g, False, False, items[i:j]] if g else items[i] for i, j, g in _regrouped(labels, other)]
    a, b = gather(a, first, second), gather(b, second, first)
    out = []
    for i, j in _matched([x[0] for x in a], [x[0] for x in b]):
        if i is None or j is None:
            label, _, repeated, inside = b[j] if i is None else a[i]
            out.append([label, True, repeated, inside])
        else:
            out.append([a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2], _merged(a[i][0], a[i][3], b[j][3])])
    return _bounded(out)


def _left_out(label: str, in_article: bool) -> bool:
    name, *words = label.split(".")
    if name in LEFT_OUT or (name == "header" and not in_article):
        return True
    words = set(words) - (HEAD_NAMES if in_article else set())
    return not LEFT_OUT_NAMES.isdisjoint(words)


def _holds(items: list, names: set[str]) -> bool:
    return any(x[0] != "#" and ((x[0].split(".")[0] in names and LEFT_OUT_NAMES.isdisjoint(x[0].split(".")[1:])) or _holds(x[3], names)) for x in items)


def decided(wrapper: list, pages: int) -> list:
    """The wrapper with True or False for each text: is it main text? pages: how many different pages it was learned from."""
    root = next((n for n in ("article", "main") if _holds(wrapper, {n})), None)
    texts: list[tuple[list, bool, bool]] = []  # text, under the root and not left out, repeated

    def walk(items, inside, out, repeated):
        weight = 0
        for item in items:
            label, _, again, below = item
            if label == "#":
                weight += 0 if out else max(0, below[2] - 2 * below[3])
                texts.append((item, inside and not out, repeated or again))
            else:
                name = label.split(".")[0]
                here = inside or (name == root and not out and not _left_out(label, True))
                # what holds the article is not left out by its names
                gone = out or (label[0] not in "(*" and _left_out(label, here) and not (root and not here and _holds(below, {root})))
                weight += walk(below, here, gone, repeated or again)
        return weight

    walk(wrapper, root is None, False, False)
    if root is None:
        # the smallest element that holds most of what is not left out, not in links, and changes from page to page
        def weigh(items, out):
            total = 0
            for label, _, _, below in items:
                if label == "#":
                    total += 0 if out or (pages > 1 and below[0] is not None) else max(0, below[2] - 2 * below[3])
                else:
                    total += weigh(below, out or (label[0] not in "(*" and _left_out(label, False)))
            return total

        items, whole = wrapper, weigh(wrapper, False)
        while whole:
            best = max((x for x in items if x[0] != "#" and not (x[0][0] not in "(*" and _left_out(x[0], False))), key=lambda x: weigh(x[3], False), default=None)
            # texts of the level itself, or several children that share the weight, end the way down; so does a repeated element
            if best is None or best[2] or best[0].split(".")[0] in HEADINGS | {"p"} or weigh(best[3], False) < 0.8 * whole:
                break
            items = best[3]
        under: set[int] = set()

        def mark(items):
            for x in items:
                under.add(id(x)) if x[0] == "#" else mark(x[3])

        mark(items)
        texts = [(t, ok and id(t) in under and 2 * t[3][3] <= t[3][2], rep) for t, ok, rep in texts]
    changing = any(ok and t[3][0] is None for t, ok, _ in texts)
    verdict = {}
    for t, ok, rep in texts:
        shared = t[3][0] is not None and not rep and changing and t[3][4] not in HEADINGS and t[3][1] >= SHARED and pages >= SHARED
        verdict[id(t)] = ok and not shared

    def shown(items):
        return [[x[0], verdict[id(x)] if x[0] == "#" else shown(x[3])] for x in items]

    return shown(wrapper)


def _flat(shown: list) -> dict:
    """The items of a level by label, groups taken apart; of several with one label all their items, of several texts whether any is shown."""
    out: dict = {}
    for label, below in shown:
        for key, inside in _flat(below).items() if label[0] in "(*" else ((label, below),):
            out[key] = (out[key] or inside if key == "#" else out[key] + inside) if key in out else inside
    return out


def texts_of(page: Node, shown: list) -> list[str]:
    """The texts of a page that its host's decided wrapper shows as main text, in page order.

    Items are met in order by an alignment; what meets none, as where a page can be folded in two ways, is what its label is elsewhere on
    that level."""
    out: list[str] = []

    def walk(entries, items, any_order):
        labels, other = [e[0] for e in entries], [x[0] for x in items]
        if any_order or (items and items[0][0] == "*"):
            pairs = [(None, e) for e in entries]
        elif labels == other:
            pairs = list(zip((x[1] for x in items), entries, strict=True))
        else:
            entries, labels, items, other = _met(entries, labels, items, other)
            pairs = [(items[i][1] if i is not None else None, entries[j]) for i, j in _matched(other, labels) if j is not None]
        known = None
        for below, (label, found) in pairs:
            loose = below is None
            if loose:
                known = _flat(items) if known is None else known
                below = items if label[0] == "(" else known.get(label, known.get(label.split(".")[0], []))
            for one in found:
                if label == "#":
                    if below is True:
                        out.append(one[0])
                elif label[0] == "(":
                    walk(one, below, loose)
                else:
                    walk(_entries(one.children), below, False)

    walk(_entries(page.children), shown, False)
    return out


def _met(entries, labels, items, other):
    """Entries and items with the groups of each other."""
    entries = [(g, [entries[i:j]]) if g else entries[i] for i, j, g in _regrouped(labels, other)]
    labels = [e[0] for e in entries]
    items = [[g, items[i:j]] if g else items[i] for i, j, g in _regrouped(other, labels)]
    return entries, labels, items, [x[0] for x in items]


def host(url: Column) -> Column:
    from spectrel.llm import urlfilter

    return F.coalesce(urlfilter.parts(url)[0], F.lit(""))


_PARTIAL = "host string, part long, pages long, wrapper string"


def _rows(held: dict, first: int) -> pa.RecordBatch:
    wrappers = [json.dumps(w, separators=(",", ":")) for w, _ in held.values()]
    parts = [first + i for i in range(len(held))]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(parts, pa.int64()), pa.array([n for _, n in held.values()], pa.int64()), pa.array(wrappers, pa.string())], names=["host", "part", "pages", "wrapper"])


def fit(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper: one wrapper (JSON) for each host of pages(url, html), learned from all its pages."""

    def partial(batches):
        held: dict[str, tuple[list, int]] = {}
        base, sent = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = learn(parsed(page or "", False))
                before = held.get(name)
                held[name] = (align(before[0], found), before[1] + 1) if before else (found, 1)
            if len(held) > HELD_HOSTS:
                yield _rows(held, base + sent)
                sent, held = sent + len(held), {}
        if held:
            yield _rows(held, base + sent)

    def merge(key, table):
        rows = sorted(zip(table["part"].to_pylist(), table["wrapper"].to_pylist(), table["pages"].to_pylist(), strict=True))
        out = json.loads(rows[0][1])
        for _, wrapper, _ in rows[1:]:
            out = align(out, json.loads(wrapper))
        return pa.table({"host": [key[0].as_py()], "part": [rows[0][0]], "pages": [sum(n for *_, n in rows)], "wrapper": [json.dumps(out, separators=(",", ":"))]})

    found = common.cut(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(partial, _PARTIAL))
    while (most := found.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FAN)
        mixed = F.pmod(F.xxhash64("part"), F.lit(groups))
        found = common.cut(found.groupBy("host", mixed.alias("group")).applyInArrow(merge, _PARTIAL))
    return found.select("host", "pages", "wrapper")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text per row of pages(page_id, url, html): blocks of main text joined by two line ends.

    wrappers: as fit() gives them, here learned from the pages themselves if not given; a host without one gets none of the host's
    knowledge, only the tags'."""
    wrappers = fit(pages) if wrappers is None else wrappers
    chars = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    known = wrappers.select("host", "pages", "wrapper")
    known = F.broadcast(known) if chars <= BROADCAST_CHARS else known

    def read(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                tree = parsed(page or "")
                if (key := (wrapper, n)) not in held:
                    if len(held) > HELD_HOSTS:
                        held.clear()
                    held[key] = decided(json.loads(wrapper), n) if wrapper else None
                texts.append("\n\n".join(texts_of(tree, held[key] if held[key] is not None else decided(learn(tree), 1))))
                if not wrapper:
                    held.pop(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host")).join(known, "host", "left")
    return rows.select("page_id", "url", "html", "wrapper", "pages").mapInArrow(read, "page_id long, url string, text string")
