"""A small selector engine: tag, .class, #id, [attr], [attr=value] and descendants, over stored pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PART = re.compile(r"""([A-Za-z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:=["']?([^"'\]]*)["']?)?\]""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "texts", "order")

    def __init__(self, tag, attrs, parent, order):
        self.tag, self.attrs, self.parent, self.order, self.texts = tag, attrs, parent, order, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.nodes))
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for node in self.open:
            node.texts.append(data)


def parse(html: str | None) -> list[Node]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def parse_source(html: str | None) -> list[Node]:
    """As parse, but that texts and attributes are as the source has them, character references not decoded: while it
    is parsed, a noncharacter that it doesn't hold stands for the ampersand."""
    html = html or ""
    mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in html)
    nodes = parse(html.replace("&", mark))
    for node in nodes:
        node.texts = [t.replace(mark, "&") for t in node.texts]
        node.attrs = {k.replace(mark, "&"): v.replace(mark, "&") for k, v in node.attrs.items()}
    return nodes


def _compile(selector: str) -> list[list[tuple]]:
    steps = []
    for word in selector.split():
        parts = [m.groups() for m in _PART.finditer(word)]
        if "".join(m.group() for m in _PART.finditer(word)) != word:
            raise ValueError(f"unsupported selector: {selector}")
        steps.append(parts)
    return steps


def _fits(node: Node, parts: list[tuple]) -> bool:
    for tag, cls, ident, attr, value in parts:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or (value is not None and node.attrs[attr] != value)):
            return False
    return True


def select(nodes: list[Node], selector: str, under: Node | None = None) -> list[Node]:
    """Nodes that the selector matches, in document order, below `under` if given."""
    steps = _compile(selector)

    def matches(node: Node) -> bool:
        if not _fits(node, steps[-1]):
            return False
        left, at = len(steps) - 2, node.parent
        while left >= 0 and at is not None and at is not under:
            if _fits(at, steps[left]):
                left -= 1
            at = at.parent
        return left < 0

    def below(node: Node) -> bool:
        at = node.parent
        while at is not None and at is not under:
            at = at.parent
        return at is under

    return [n for n in nodes if matches(n) and (under is None or below(n))]


def extract(pages: DataFrame, item: str, fields: dict[str, str], key: str = "page_id", html: str = "html", source: bool = False, every: bool = False) -> DataFrame:
    """(key, item_ix, fields...): one row per node that `item` matches; a field is "selector" for its text or
    "selector@attr" for an attribute, of the first match below the item; null without one. With `source`, texts are as the source
    has them, references and white space too. With `every`, a page without an item is one, whole.

    Pages are parsed in Arrow batches, one page at a time. Bad selectors raise on the driver.
    """
    plan = {n: (s.split("@")[0].strip(), s.split("@")[1] if "@" in s else None) for n, s in fields.items()}
    for s, _ in plan.values():
        _compile(s)
    _compile(item)
    key_type = pages.schema[key].dataType
    out_type = T.StructType([T.StructField(key, key_type), T.StructField("item_ix", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in fields]])

    read, joined = (parse_source, "".join) if source else (parse, lambda texts: " ".join("".join(texts).split()))
    none = [None] if every else []

    def run(batches):
        for b in batches:
            rows = {n: [] for n in out_type.names}
            for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = read(body)
                for i, node in enumerate(select(nodes, item) or none):
                    rows[key].append(k)
                    rows["item_ix"].append(i)
                    for n, (s, attr) in plan.items():
                        hit = (select(nodes, s, node) if s else [node] if node else [])[:1]
                        rows[n].append((hit[0].attrs.get(attr) if attr else joined(hit[0].texts)) if hit else None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([], pa.int32())) if not rows[key] else pa.array(rows[key], b.column(0).type), pa.array(rows["item_ix"], pa.int32()), *[pa.array(rows[n], pa.string()) for n in fields]], names=out_type.names)

    return pages.select(key, html).mapInArrow(run, out_type)
