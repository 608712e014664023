"""Main text of web pages by wrapper induction.

Pages of a host come from one template. Each page is read as a tree of blocks, and the
tree of the host's commonest shape, the shortest page of it, is the reference. Simple tree
matching aligns every page with its host's reference, and counting over the host tells
what each node of the reference is: a node with the same text on nearly all pages is
template, one with as many children as the page likes is a list, and one made of links is
a menu. Template and menus go, as do slots that are labelled as something beside the
article (menus, headers, footers, sidebars, notices, adverts, forms, comments); the other
slots are content, and so are the items of a list that no position tells apart: those with
siblings of their own shape. Other children of a list are slots as elsewhere.

Counting is an aggregation over (host, node, text), so a host may hold any share of the
pages; only the reference trees and wrappers, of a size bounded by a page, travel by host.

Defined results: pages without html, or without text in a block, have an empty text; a
null url is a host of its own; equal rows are pages of their own, but pages of a host
with the same block texts are one witness of its template: of a host with fewer than
ENOUGH distinct pages only labels count.
"""

from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.dom import Matcher, parse
from rollbook.llm.shared import ROW, numbered
from rollbook.sources.staging import stage

#: A node is template if one text has this share of at least ENOUGH distinct pages of a host.
CONSTANT, ENOUGH = 0.9, 8
#: A slot is a menu if links make up this share of its characters.
LINKED = 0.7

BLOCKS = "array<struct<node:int,digest:bigint,chars:bigint,linked:bigint,chrome:boolean>>"


def host(url):
    """The host of a url column, as wrappers are kept by: without scheme, lower case."""
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", -1)
    return F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: ROW, host, its tree and its blocks without their texts."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            trees, blocks = [], []
            for source in batch.column("html"):
                page = parse(source.as_py() or "")
                trees.append(list(map("{}:{}".format, page.depths, page.tags)))
                blocks.append(
                    [
                        {
                            "node": n,
                            "digest": xxhash.xxh3_64_intdigest(t) - 2**63,
                            "chars": len(t),
                            "linked": k,
                            "chrome": page.chrome[n],
                        }
                        for n, t, k in zip(page.block_nodes, page.texts, page.links, strict=True)
                    ]
                )
            kind = pa.list_(
                pa.struct(
                    [
                        ("node", pa.int32()),
                        ("digest", pa.int64()),
                        ("chars", pa.int64()),
                        ("linked", pa.int64()),
                        ("chrome", pa.bool_()),
                    ]
                )
            )
            columns = [
                *batch.select([*ROW, "host"]).columns,
                pa.array([" ".join(t) for t in trees]),
                pa.array(blocks, kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*ROW, "host", "tree", "blocks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: ROW, page_id, url and the texts of its blocks."""
    names = [*ROW, "page_id", "url"]
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            texts = [parse(source.as_py() or "").texts for source in batch.column("html")]
            made = pa.array(texts, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, made], names=[*names, "texts"]
            )


class _Aligner:
    """Alignments with reference trees, whose parsed forms are kept for a while."""

    def __init__(self):
        self.matcher, self.trees = Matcher(), {}

    def tree(self, text: str):
        if text not in self.trees:
            if len(self.trees) > 2000:
                self.__init__()
            pairs = [part.split(":", 1) for part in text.split(" ")]
            self.trees[text] = self.matcher.tree([int(d) for d, _ in pairs], [t for _, t in pairs])
        return self.trees[text]

    def __call__(self, reference: str, tree: str):
        self.tree(reference)
        page = self.tree(tree)
        return self.tree(reference), page, self.matcher.align(self.tree(reference), page)


@cache
def _aligner() -> _Aligner:
    return _Aligner()


def _alike(tree) -> list[bool]:
    """Which nodes of a tree have siblings of the same shape."""
    out = [False] * len(tree.tags)
    for children in tree.children:
        many = Counter(tree.shape[c] for c in children)
        for child in children:
            out[child] = many[tree.shape[child]] > 1
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and matched node: host, node, digest, characters, links, children, and
    whether a sibling in the page has the same shape."""
    names = ["host", "node", "digest", "chars", "linked", "children", "alike"]
    align = _aligner()
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        columns = (batch.column(c).to_pylist() for c in ("host", "tree", "blocks", "reference"))
        for name, tree, blocks, reference in zip(*columns, strict=True):
            _, page, pairs = align(reference, tree)
            alike = _alike(page)
            own: dict[int, tuple] = {}
            for b in blocks:
                digest, chars, linked = own.get(b["node"], (0, 0, 0))
                # a block's text may stand in several parts around its children
                digest = b["digest"] if not chars else (digest * 31 + b["digest"]) % 2**62
                own[b["node"]] = (digest, chars + b["chars"], linked + b["linked"])
            for node, there in pairs:
                row = (name, node, *own.get(there, (0, 0, 0)), len(page.children[there]), alike[there])
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.bool_()]
        arrays = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: ROW and, block by block, whether it is content."""
    align = _aligner()
    for batch in batches:
        columns = (
            batch.column(c).to_pylist()
            for c in ("tree", "blocks", "reference", "dropped", "lists", "items")
        )
        kept = []
        for tree, blocks, reference, dropped, lists, items in zip(*columns, strict=True):
            if not dropped:
                kept.append([not b["chrome"] for b in blocks])
                continue
            _, page, pairs = align(reference, tree)
            slot = {there: node for node, there in pairs}
            parent = [-1] * len(page.tags)
            for node, children in enumerate(page.children):
                for child in children:
                    parent[child] = node
            lists, items = set(lists), set(items)
            in_list = [False] * len(page.tags)
            for node in range(1, len(page.tags)):  # parents come first
                above = parent[node]
                item = slot.get(node) is None or slot[node] in items
                in_list[node] = in_list[above] or (item and slot.get(above) in lists)
            dropped = {d["node"]: d["digest"] for d in dropped}
            flags = []
            for b in blocks:
                node = slot.get(b["node"])
                template = node in dropped and dropped[node] in (None, b["digest"])
                flags.append(not b["chrome"] and not (template and not in_list[b["node"]]))
            kept.append(flags)
        made = pa.array(kept, pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([*batch.select(ROW).columns, made], names=[*ROW, "kept"])


def _distinct(trees: DataFrame) -> DataFrame:
    """Of the pages of a host that have the same block texts, one each."""
    paged = trees.withColumn("page", F.xxhash64(F.transform("blocks", lambda b: b["digest"])))
    place = F.struct(*ROW)
    groups = paged.groupBy("host", "page").agg(F.count("*").alias("many"), F.min(place).alias("kept"))
    # only what stands more than once is joined, and may have any share of the pages
    groups = groups.filter("many > 1").select(
        F.col("host").alias("_host"), F.col("page").alias("_page"), "kept"
    )
    same = (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page"))
    told = paged.join(stage(groups, "copies"), same, "left")
    return told.filter(F.col("kept").isNull() | (F.col("kept") == place)).select(*trees.columns)


def wrappers(trees: DataFrame) -> DataFrame:
    """Per host: its reference tree, the nodes to drop (with a digest: that text only),
    its lists and the nodes with siblings of their shape on some page."""
    trees = _distinct(trees)
    shapes = trees.groupBy("host", F.xxhash64("tree").alias("shape")).agg(
        F.count("*").alias("pages"), F.min("tree").alias("tree")
    )
    commonest = F.max(F.struct("pages", (-F.length("tree")).alias("short"), "tree"))
    hosts = shapes.groupBy("host").agg(
        commonest.alias("best"), F.sum("pages").alias("all_pages")
    )
    hosts = stage(
        hosts.select("host", F.col("best.tree").alias("reference"), "all_pages"), "references"
    )
    aligned = trees.join(hosts.select("host", "reference"), "host").select(
        "host", "tree", "blocks", "reference"
    )
    slots = aligned.mapInArrow(
        _slots,
        "host string, node int, digest bigint, chars bigint, linked bigint,"
        " children int, alike boolean",
    )
    by_text = slots.groupBy("host", "node", "digest").agg(
        F.count("*").alias("pages"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.min("children").alias("least"),
        F.max("children").alias("most"),
        F.max("alike").alias("alike"),
    )
    by_node = by_text.groupBy("host", "node").agg(
        F.sum("pages").alias("pages"),
        F.max(F.struct("pages", "digest")).alias("top"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.max("alike").alias("alike"),
    )
    told = by_node.join(hosts.select("host", "all_pages"), "host")
    enough = (F.col("all_pages") >= ENOUGH) & (F.col("chars") > 0)
    constant = enough & (F.col("top.pages") >= CONSTANT * F.col("all_pages"))
    menu = enough & (F.col("linked") >= LINKED * F.col("chars"))
    digest = F.when(~menu, F.col("top.digest"))
    described = told.groupBy("host").agg(
        F.collect_list(
            F.when(constant | menu, F.struct("node", digest.alias("digest")))
        ).alias("dropped"),
        F.collect_list(F.when(F.col("least") < F.col("most"), F.col("node"))).alias("lists"),
        F.collect_list(F.when(F.col("alike"), F.col("node"))).alias("items"),
    )
    return hosts.select("host", "reference").join(described, "host")


def extract(pages: DataFrame, stored: bool = False) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    if not stored:
        pages = stage(pages.select("page_id", "url", "html"), "pages")
    rows = numbered(pages, "page_id", "url", "html", stored=True)
    trees = rows.select(*ROW, host(F.col("url")).alias("host"), "html").mapInArrow(
        _trees, f"row_file bigint, row_index bigint, host string, tree string, blocks {BLOCKS}"
    )
    trees = stage(trees, "trees")
    told = stage(wrappers(trees), "wrappers")
    kept = trees.join(told, "host").select(
        *ROW, "tree", "blocks", "reference", "dropped", "lists", "items"
    )
    kept = kept.mapInArrow(_kept, "row_file bigint, row_index bigint, kept array<boolean>")
    texts = rows.select(*ROW, F.col("page_id").cast("bigint"), "url", "html").mapInArrow(
        _texts,
        "row_file bigint, row_index bigint, page_id bigint, url string, texts array<string>",
    )
    chosen = F.filter("texts", lambda text, i: F.get("kept", i))
    text = F.array_join(chosen, "\n")
    joined = texts.join(kept, ROW).select("page_id", "url", text.alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("bigint"))
