"""Trees of nested tags, as a second kind of structure tree."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reduction import Block, listed

# Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Block("document", 0)
        self.open = [self.top]

    def _add(self, tag: str) -> Block:
        line, column = self.getpos()
        new = Block(tag, line << 20 | column)
        self.open[-1].children.append(new)
        return new

    def handle_starttag(self, tag, attrs):
        new = self._add(tag)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self._add(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].label == tag:
                del self.open[k:]
                break


def tag_tree(html: str) -> Block:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    order, stack = [], [parser.top]
    while stack:
        block = stack.pop()
        order.append(block)
        stack += block.children
    for block in reversed(order):
        block.depth = max((c.depth + 1 for c in block.children), default=0)
    return parser.top


def tag_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, block_type, depth, struct_key,
    strict_key) of the tags of (page_id, html)."""
    schema = "page_id long, node_id int, parent_id int, block_type string, depth int, struct_key string, strict_key string"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += [(row["page_id"], *(n[c] for c in names[1:])) for n in listed(tag_tree(row["html"] or ""))]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, schema)
