"""Main text of web pages through wrappers inferred per host.

Method: a page's token stream is an expression over elements and text slots. Pages of one host are
aligned: a text that differs becomes a slot, an element met again becomes a repeated group, and one that
only some pages have becomes optional, until one expression without alternatives, the host's wrapper,
accepts all of them. Each page first folds its own repeats; pages that then read alike are one
expression with summed slots. Expressions are merged in groups of bounded size, round after round, so a
host of any size is spread over tasks. In a wrapper a key occurs once in a list, so the keys on the way
to a slot name it in the wrapper and in each of its pages.

The wrapper's slots decide what is article: those in ``main`` or ``article`` elements, else those of the
element that holds most of the text that differs between pages. Link lists, and text outside of prose
elements that all pages of the host share, are left out where no ``article`` holds them. A page without any such slot is judged by
its own expression. Elements that by their name, role or class hold menus, page headers, footers,
sidebars, notices, adverts, forms, scripts or comments leave the streams before.

Defined cases: null or empty html, and pages without article text, give an empty text; a null url is a
host of its own; markup may be broken, nested without end or very long; repeated rows and rows that share
an id each give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmarts.llm.common import cut, parts
from sparkmarts.llm.html_tokens import HEADINGS, TEXT, Node, article_nodes, parse

GROUP = "("
#: An item of an expression: [key, optional, repeated, items], with key GROUP for groups; a text slot has
#: [pages, characters, of them linked, least hash, largest hash] in place of items.
KEY, OPTIONAL, REPEATED, INSIDE = range(4)
#: Elements that a search for the article's element goes down into.
FRAMES = frozenset("div section center td tr table tbody span".split())
#: Elements whose text is prose even where all pages share it.
PROSE = frozenset("p blockquote pre figcaption caption dd dt li td th".split()) | HEADINGS
BROADCAST_BYTES = 16 << 20


def keys(item: list) -> set[str]:
    if item[KEY] != GROUP:
        return {item[KEY]}
    return set().union(*map(keys, item[INSIDE]))


def merged(one: list, other: list, pages: int) -> list:
    """One item that accepts both; ``pages``: 1 if they are of different pages, 0 if of the same."""
    optional, repeated = one[OPTIONAL] or other[OPTIONAL], one[REPEATED] or other[REPEATED]
    if one[KEY] == other[KEY] == TEXT:
        a, b = one[INSIDE], other[INSIDE]
        slot = [a[0] + b[0] if pages else max(a[0], b[0]), a[1] + b[1], a[2] + b[2], min(a[3], b[3]),
                max(a[4], b[4])]
        return [TEXT, optional, repeated, slot]
    if one[KEY] == other[KEY]:
        return [one[KEY], optional, repeated, aligned(one[INSIDE], other[INSIDE], pages)]
    lists = [item[INSIDE] if item[KEY] == GROUP else [[item[KEY], False, item[REPEATED], item[INSIDE]]]
             for item in (one, other)]
    return [GROUP, optional, True, aligned(*lists, pages)]


def gathered(items: list[list], by: list[list]) -> list[list]:
    """``items`` with those that a group of ``by`` spans as one group."""
    for group in by:
        if group[KEY] == GROUP:
            own = keys(group)
            met = [i for i, item in enumerate(items) if not own.isdisjoint(keys(item))]
            if len(met) > 1:
                span = items[met[0]:met[-1] + 1]
                one = [GROUP, all(x[OPTIONAL] for x in span), False, span]
                items = [*items[:met[0]], one, *items[met[-1] + 1:]]
    return items


def aligned(a: list[list], b: list[list], pages: int) -> list[list]:
    """The items of two lists: shared ones merged, others optional, in an order that both keep."""
    if [x[KEY] for x in a] == [x[KEY] for x in b] and all(x[KEY] != GROUP for x in a):
        return [merged(x, y, pages) for x, y in zip(a, b)]
    spans = gathered(a, b)
    a, b = (a, gathered(b, a)) if spans is a else (spans, b)  # of one side only: each call gets less
    of_a, of_b = [keys(x) for x in a], [keys(y) for y in b]
    # longest common subsequence
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            same = not of_a[i].isdisjoint(of_b[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], same + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and not of_a[i].isdisjoint(of_b[j]) and (
                best[i][j] == 1 + best[i + 1][j + 1]):
            out.append(merged(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][KEY], True, *a[i][REPEATED:]])
            i += 1
        else:
            out.append([b[j][KEY], True, *b[j][REPEATED:]])
            j += 1
    return folded(out, pages)


def folded(items: list[list], pages: int = 0) -> list[list]:
    """The list with every key once: an item met again makes a repeated group back to its first place."""
    out: list[list] = []
    place: dict[str, int] = {}
    i = 0
    while i < len(items):
        item = items[i]
        i += 1
        own = keys(item)
        at = min((place[k] for k in own if k in place), default=None)
        if at is None:
            place.update(dict.fromkeys(own, len(out)))
            out.append(item)
            continue
        square = out[at:]
        if len(square) == 1 and square[0][KEY] == item[KEY] != GROUP:
            both = merged(square[0], item, pages)
            both[REPEATED] = True
        else:
            # the next square: what follows of the group's items, up to its first one
            lead = square[0][INSIDE][0] if square[0][KEY] == GROUP else square[0]
            lead, members = keys(lead), set().union(*map(keys, square))
            more = [item]
            while i < len(items) and keys(items[i]) <= members and lead.isdisjoint(keys(items[i])):
                more.append(items[i])
                i += 1
            if len(square) > 1 or square[0][KEY] != GROUP:
                square = [[GROUP, all(x[OPTIONAL] for x in square), True, square]]
            both = merged(square[0], [GROUP, False, True, folded(more, pages)], pages)
        del out[at:]
        out.append(both)
        place.update(dict.fromkeys(keys(both), at))
    return out


def expression(texts: list[Node]) -> list[list]:
    """A page's own expression, of the tree over its text runs."""
    root, order = None, []
    for node in texts:
        while node is not None and getattr(node, "items", None) is None:
            node.items = ()
            order.append(node)
            node = node.parent
    depth: dict[Node, int] = {}
    for node in order:
        line = []
        while node is not None and node not in depth:
            line.append(node)
            node = node.parent
        base = depth[node] if node is not None else -1
        for up in reversed(line):
            base += 1
            depth[up] = base
    for node in sorted(order, key=lambda n: -depth[n]):
        if node.name == TEXT:
            text = node.text()
            number = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            node.items = [1, len(text), min(node.linked, len(text)), number, number]
        else:
            node.items = folded([[c.key, False, False, c.items] for c in node.children])
        if node.parent is None:
            root = node
    return root.items if root is not None else []


def slots(items: list[list], path: str = "") -> Iterator[tuple[str, list]]:
    """(path, slot) of the expression in order."""
    for item in items:
        if item[KEY] == TEXT:
            yield f"{path}/{TEXT}", item[INSIDE]
        else:
            yield from slots(item[INSIDE], path if item[KEY] == GROUP else f"{path}/{item[KEY]}")


def shape(items: list[list]) -> list:
    """The expression without its slots' figures."""
    return [[k, int(o), int(r), 0 if k == TEXT else shape(inside)] for k, o, r, inside in items]


def filled(items: list, figures: Iterator[list]) -> list[list]:
    """An expression from its shape and its slots' figures, in order."""
    return [[k, bool(o), bool(r), list(next(figures)) if k == TEXT else filled(inside, figures)]
            for k, o, r, inside in items]


def article_paths(items: list[list]) -> set[str]:
    """Paths of the slots that hold article text."""
    leaves = []  # (tags above, path, figures, whether it repeats)

    def walk(some: list[list], tags: tuple, path: str, repeated: bool) -> None:
        for key, _, again, inside in some:
            if key == TEXT:
                leaves.append((tags, f"{path}/{TEXT}", inside, repeated or again))
            elif key == GROUP:
                walk(inside, tags, path, True)
            else:
                walk(inside, (*tags, key.partition(".")[0]), f"{path}/{key}", repeated or again)

    walk(items, (), "", False)
    fixed = lambda leaf: leaf[2][0] > 2 and leaf[2][3] == leaf[2][4] and not leaf[3]
    if all(map(fixed, leaves)):  # all pages are copies: nothing tells the text from the frame
        fixed = lambda leaf: False
    links = lambda leaf: leaf[2][2] > 0.6 * leaf[2][1] and (leaf[3] or "li" in leaf[0])
    frame = lambda leaf: links(leaf) or fixed(leaf) and PROSE.isdisjoint(leaf[0])
    for region in ("main", "article"):
        held = [leaf for leaf in leaves if region in leaf[0]]
        if held:
            return {leaf[1] for leaf in held if "article" in leaf[0] or not frame(leaf)}
    own = [leaf for leaf in leaves if not (links(leaf) or fixed(leaf))]
    top = densest(items, {leaf[1]: leaf[2][1] - leaf[2][2] for leaf in own})
    headline = [leaf for leaf in own if "h1" in leaf[0]]
    inside = [leaf for leaf in leaves if leaf[1].startswith(f"{top}/") and not frame(leaf)]
    if not any("h1" in leaf[0] for leaf in inside):
        inside += headline
    return {leaf[1] for leaf in inside}


def densest(items: list[list], weight: dict[str, int]) -> str:
    """Path of the innermost frame that holds most of the text."""
    path = ""
    while True:
        total = sum(w for p, w in weight.items() if p.startswith(f"{path}/"))
        for key, _, again, inside in items:
            down = f"{path}/{key}"
            if key.partition(".")[0] in FRAMES and not again and total and (
                    sum(w for p, w in weight.items() if p.startswith(f"{down}/")) > 0.6 * total):
                path, items = down, inside
                break
        else:
            return path


def page_blocks(page: str | None) -> tuple[list[list], list[tuple[str, str]]]:
    """A page's expression, and its text runs with their paths."""
    texts = article_nodes(parse(page or ""))
    texts = [t for t in texts if t.text()]
    paths: dict[Node, str] = {}

    def path(node: Node) -> str:  # at most as deep as article_nodes allows
        if node.parent is None:
            return ""
        if node not in paths:
            paths[node] = f"{path(node.parent)}/{node.key}"
        return paths[node]

    return expression(texts), [(path(t), t.text()) for t in texts]


def _shape_rows(batches: Iterator[pa.RecordBatch], most: int = 5000) -> Iterator[pa.RecordBatch]:
    """(host, shape, slot, figures): slots summed over a batch's pages that read alike."""
    held: dict[tuple[str, str], list[list]] = {}

    def rows() -> pa.RecordBatch:
        flat = [(host, text, n, *slot) for (host, text), of in held.items() for n, slot in enumerate(of)]
        held.clear()
        names = ["host", "shape", "slot", "pages", "chars", "linked", "least", "most"]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        columns = list(zip(*flat)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items, _ = page_blocks(page)
            if not items:
                continue
            key, own = (host, json.dumps(shape(items))), [figures for _, figures in slots(items)]
            old = held.get(key)
            held[key] = own if old is None else [
                [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]
                for a, b in zip(old, own)]
            if len(held) >= most:
                yield rows()
    yield rows()


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper a (host, bucket) of a sorted stream of (host, bucket, wrapper)."""
    group, items = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group[0]]), pa.array([json.dumps(items)])],
                                          names=["host", "wrapper"])

    for batch in batches:
        for host, bucket, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (host, bucket):
                if group is not None:
                    yield row()
                group, items = (host, bucket), json.loads(wrapper)
            else:
                items = aligned(items, json.loads(wrapper), 1)
    if group is not None:
        yield row()


def infer_wrappers(shapes: DataFrame, fan_in: int = 64) -> DataFrame:
    """(host, wrapper): one expression a host, merged from (host, shape, figures) in rounds."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [json.dumps(filled(json.loads(text), map(list, zip(*figures)))) for text, figures in
                     zip(batch.column(1).to_pylist(), _figures(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string())],
                                             names=["host", "wrapper"])

    wrappers = cut(shapes.select("host", "shape", "figures").mapInArrow(first, "host string, wrapper string"))
    while True:
        most = wrappers.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return wrappers
        bucket = F.pmod(F.xxhash64("wrapper"), F.lit(math.ceil(most / fan_in))).cast("int")
        by = ["host", "bucket"]
        wrappers = cut(wrappers.select("host", bucket.alias("bucket"), "wrapper")
                       .repartition(parts(wrappers), *by).sortWithinPartitions(*by, "wrapper")
                       .mapInArrow(_merge_groups, "host string, wrapper string"))


def _figures(column: pa.Array) -> Iterator[tuple[list, ...]]:
    """Per row, the slots' figures as five lists in slot order."""
    for row in column.to_pylist():
        yield tuple([slot[name] for slot in row] for name in ("pages", "chars", "linked", "least", "most"))


def choose_slots(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, shape, keep): the slots of each shape that its host's wrapper, or else it alone, holds for
    article text."""

    def host_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(article_paths(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))],
                                             names=["host", "paths"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, figures, paths in zip(batch.column(1).to_pylist(), _figures(batch.column(2)),
                                            batch.column(3).to_pylist()):
                items = filled(json.loads(text), map(list, zip(*figures)))
                names = [path for path, _ in slots(items)]
                allowed = set(paths or ())
                if allowed.isdisjoint(names):
                    allowed = article_paths(items)
                kept.append([path for path in names if path in allowed])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.string()))],
                names=["host", "shape", "keep"])

    of_host = wrappers.mapInArrow(host_paths, "host string, paths array<string>")
    return shapes.select("host", "shape", "figures").join(of_host, "host", "left").mapInArrow(
        choose, "host string, shape string, keep array<string>")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with each page's shape and text runs in place of its html."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    for batch in batches:
        shapes, blocks = [], []
        for page in batch.column(3).to_pylist():
            items, runs = page_blocks(page)
            shapes.append(json.dumps(shape(items)) if items else "")
            blocks.append([{"path": path, "text": text} for path, text in runs])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(shapes, pa.string()), pa.array(blocks, kind)],
            names=["id", "url", "host", "shape", "blocks"])


def extract(pages: DataFrame, fan_in: int = 64, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """<id_col>, <url_col>, text, n_chars: the article of each page, its blocks joined by one space."""
    url = F.col(url_col).cast("string")
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    own = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.lower(host).alias("host"),
                       F.col(html_col).cast("string").alias("html"))
    slot = F.struct("slot", "pages", "chars", "linked", "least", "most")
    shapes = cut(own.select("host", "html").mapInArrow(
        _shape_rows, "host string, shape string, slot int, pages long, chars long, linked long, "
                     "least long, most long")
        .groupBy("host", "shape", "slot").agg(
            F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
            F.min("least").alias("least"), F.max("most").alias("most"))
        .groupBy("host", "shape").agg(F.sort_array(F.collect_list(slot)).alias("figures")))
    keep = cut(choose_slots(shapes, infer_wrappers(shapes, fan_in)))
    size = keep.agg(F.sum(F.octet_length("shape") + F.octet_length(F.to_json("keep")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        keep = F.broadcast(keep)
    kind = own.schema["id"].dataType.simpleString()
    blocks = own.mapInArrow(_block_rows, f"id {kind}, url string, host string, shape string, "
                                         "blocks array<struct<path:string,text:string>>")
    chosen = F.filter("blocks", lambda b: F.array_contains("keep", b["path"]))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    out = blocks.join(keep, ["host", "shape"], "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce(text, F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
