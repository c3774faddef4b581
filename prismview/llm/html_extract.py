"""Main-text extraction by a site style tree.

The pages of a host are merged into one tree whose element nodes are places in the
page with their presentation (tags, classes, ids). For every node the tree counts in
how many of the host's distinct pages it occurs, which presentation styles its
children have there, in how many pages each piece of its content recurs, and how much
of the host's text it holds.

* Presentation importance of a node on m pages: the entropy, to the base m, of the
  styles of its children; 1 if m = 1.
* Content importance of a leaf: 1 minus the mean entropy, to the base m, of its
  contents over the pages that hold them. A content on k pages has entropy log k / log m.
* Composite importance of a leaf: (1 - g^l) presentation + g^l content, where l is the
  number of styles of its parent and g = 0.9.

One rule holds for every leaf of every host: it is removed, with all its blocks, if its
importance times its prior is below LOW. Its importance is the lesser of composite and
content; 1 where fewer than LEAST_PAGES pages tell nothing, or where the leaf holds
half of the host's text or more, for then the site repeats the article itself. Its prior is

* NAMED if an element around it says by tag, class, id, role or style that it is a menu,
  header, footer, sidebar, notice, advert, form or comment. Menus and adverts change from
  page to page, so entropy alone calls them important. The tree overturns names of elements
  that hold MOST of the host's text: that is no menu, whatever it is called.
* OUTSIDE if the page marks an article or main element and the leaf is not in one. The
  tree overturns the mark where elements without a name hold MOST of what these pages have
  outside names, and stand outside the marks.
* 1 otherwise.

Where pages mark no main element, single contents that recur on most pages of their leaf
go as well; inside a marked one they stay, as articles may share a passage.

Counts are sums over (node, content) that are combined in each batch before the shuffle,
and blocks meet the noise entries by salted keys, so a host that holds a third of all
pages meets in no single task. Nothing is broadcast but the slot numbers of ``rows_with``.
Pages are read once; their blocks are kept in the shared folder, and texts travel compressed.

A null html is an empty page and gives an empty text; a null url belongs to the host
"". Equal pages of a host count once in the tree, and each gets its row, also for null
or repeated ids. An empty table gives an empty result. Other columns are ignored,
whatever their names. Very long pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismview.llm.html_tree import INSIDE, OUTSIDE, UNMARKED, Block, read_blocks
from prismview.llm.scratch import rows_with, rows_without, shared_folder, written

#: Fewest distinct pages that tell anything about a node; weighted importance below which a node is noise; entropy from which a content is.
LEAST_PAGES, LOW, RECURS = 5, 0.2, 0.8
DAMPING = 0.9
#: Priors, and shares of a host's text that overturn them.
PRIOR_NAMED, PRIOR_OUTSIDE, HALF, MOST = 0.1, 0.1, 0.5, 0.9
#: The item of noise entries that stand for a whole leaf; parts of a leaf's blocks.
BRANCH, SALTS = 0, 16

#: ``node_first`` and ``item_first``: the first block of its page with that node, with that node and item.
BLOCK = "node long, item long, node_first int, item_first int, size long, parent long, named long, state int"
PAGE = f"row long, chunk long, place long, host long, page long, ids array<long>, urls array<string>, texts binary, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, styles array<struct<node:long,style:long>>"
#: Pages and characters of a chunk, whose texts are compressed and travel together, in the row of its first page.
CHUNK_PAGES, CHUNK_CHARS = 32, 1 << 20
RESULT = "page_id long, url string, text string, n_chars long"


def host_of(url: Column) -> Column:
    name = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return name


def packed(pages: list[list[str]]) -> bytes:
    """The texts of a chunk as they travel: compressed, whole."""
    return zstandard.compress(json.dumps(pages, ensure_ascii=False).encode(), 6)


def unpacked(data: bytes) -> list[list[str]]:
    return json.loads(zstandard.decompress(data))


def chunks_of(texts: list[list[str]]) -> list[int]:
    """The first page of each page's chunk."""
    first, size, out = 0, 0, []
    for i, own in enumerate(texts):
        if i - first >= CHUNK_PAGES or size > CHUNK_CHARS:
            first, size = i, 0
        size += sum(map(len, own))
        out.append(first)
    return out


def facts(blocks: list[Block]) -> list[tuple]:
    """BLOCK tuples of a page's blocks."""
    nodes, items, out = set(), set(), []
    for b in blocks:
        item = hashed(b.text)
        out.append((b.node, item, int(b.node not in nodes), int((b.node, item) not in items), len(b.text), b.parent, b.named, b.state))
        nodes.add(b.node)
        items.add((b.node, item))
    return out


def hashed(*parts: str) -> int:
    return (xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)) or 1


def lists_of(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Rows of tuples as a list column of structs."""
    flat = list(zip(*(t for r in rows for t in r), strict=True)) or [()] * kind.num_fields
    columns = [pa.array(c, kind.field(i).type) for i, c in enumerate(flat)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


BLOCK_TYPE = pa.struct([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (c.split() for c in BLOCK.split(", "))])
STYLE_TYPE = pa.struct([("node", pa.int64()), ("style", pa.int64())])


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``page_id, url, html, host`` to PAGE rows; numbers them by task."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for whole in batches:
        for first in range(0, whole.num_rows, 200):  # bounds the blocks held at once
            batch = whole.slice(first, 200)
            hosts, pages = batch["host"].to_pylist(), [p or "" for p in batch["html"].to_pylist()]
            read = [read_blocks(p, h) for p, h in zip(pages, hosts, strict=True)]
            texts = [[b.text for b in blocks] for blocks, _ in read]
            first = chunks_of(texts)
            of = [[j for j in range(i, len(first)) if first[j] == i] if first[i] == i else None for i in range(len(first))]
            ids, urls = batch["page_id"].to_pylist(), batch["url"].to_pylist()
            columns = {
                "row": range(row, row + len(pages)), "chunk": [row + f for f in first], "place": [i - f for i, f in enumerate(first)], "host": map(hashed, hosts),
                "page": [hashed(h, p) for h, p in zip(hosts, pages, strict=True)],
            }
            made = [pa.array(c, pa.int64()) for c in columns.values()]
            made += [pa.array([c and [ids[j] for j in c] for c in of], pa.list_(pa.int64())), pa.array([c and [urls[j] for j in c] for c in of], pa.list_(pa.string()))]
            made += [pa.array([c and packed([texts[j] for j in c]) for c in of], pa.binary()), lists_of([facts(blocks) for blocks, _ in read], BLOCK_TYPE), lists_of([s for _, s in read], STYLE_TYPE)]
            yield pa.RecordBatch.from_arrays(made, names=[*columns, "ids", "urls", "texts", "blocks", "styles"])
            row += len(pages)


def leaves_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree's leaves with their importances, and ``node, item, k`` of contents on at least LEAST_PAGES ^ RECURS pages. ``pages``: PAGE rows."""
    rows = pages.select("row", "host", "page", "blocks", "styles")
    first = pages.groupBy("page").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("page", "first")
    again = rows_with(pages.select("row", "page"), first, "page").join(first, "page").filter("row <> first").select("row")
    once = rows_without(rows, again, "row")  # equal pages of a host count once
    blocks = once.select("host", F.explode("blocks").alias("b")).select("host", "b.*")
    items = blocks.filter("item_first = 1").groupBy("node", "item").agg(F.count("*").alias("k"))
    contents = items.groupBy("node").agg(F.sum(F.log("k")).alias("logs"), F.count("*").alias("items"))
    # Entropies as sums over a node's items: no join brings all items of a node together.
    own = [F.sum("node_first").alias("m"), F.sum(F.col("size") * F.col("item_first")).alias("size"), *[F.min(c).alias(c) for c in ("host", "parent", "named", "state")]]
    leaf = blocks.groupBy("node").agg(*own).join(contents, "node")
    styles = once.select(F.explode("styles").alias("s")).groupBy("s.node", "s.style").agg(F.count("*").alias("k"))
    inner = styles.groupBy(F.col("node").alias("parent")).agg(F.sum("k").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("weighted"), F.count("*").alias("styles"))
    base, many = F.log("pages"), F.col("pages") > 1
    presentation = F.when(many, (F.col("pages") * base - F.col("weighted")) / F.col("pages") / base).otherwise(1.0)
    leaf = leaf.join(inner.select("parent", "styles", presentation.alias("presentation")), "parent", "left")
    content = F.when(F.col("m") > 1, 1 - F.col("logs") / F.col("items") / F.log("m")).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.coalesce("styles", F.lit(1)))
    composite = (1 - weight) * F.coalesce("presentation", F.lit(1.0)) + weight * content
    leaf = leaf.select("node", "host", "named", "state", "m", "size", content.alias("content"), composite.alias("composite"))
    return leaf, items.filter(F.col("k") >= LEAST_PAGES**RECURS)


def judged(leaf: DataFrame) -> DataFrame:
    """``node, m, state, prior, importance`` of every leaf."""
    plain = F.col("named") == 0
    total = lambda when: F.sum(F.when(when, F.col("size")).otherwise(0))
    hosts = leaf.groupBy("host").agg(F.sum("size").alias("all"), total(plain & (F.col("state") != UNMARKED)).alias("marked"), total(plain & (F.col("state") == OUTSIDE)).alias("outside"))
    names = leaf.filter("named <> 0").groupBy("named").agg(F.sum("size").alias("held"))
    told = leaf.join(hosts, "host").join(names, "named", "left")
    named = ~plain & (F.coalesce("held", F.lit(0)) < MOST * F.col("all"))
    outside = (F.col("state") == OUTSIDE) & (F.col("outside") < MOST * F.col("marked"))
    importance = F.when((F.col("m") < LEAST_PAGES) | (F.col("size") >= HALF * F.col("all")), 1.0).otherwise(F.least("composite", "content"))
    return told.select("node", "m", "state", F.when(named, PRIOR_NAMED).when(outside, PRIOR_OUTSIDE).otherwise(1.0).alias("prior"), importance.alias("importance"))


def noise_of(pages: DataFrame, folder: str) -> DataFrame:
    """``node, item``: a leaf to remove (BRANCH), or a content that recurs on a leaf. ``pages``: PAGE rows."""
    leaf, contents = leaves_of(pages)
    told = written(judged(written(leaf, "leaves", folder)), "judged", folder)
    low = told.filter(F.col("prior") * F.col("importance") < LOW).select("node", F.lit(BRANCH).cast("long").alias("item"))
    recurs = contents.join(told.filter((F.col("m") >= LEAST_PAGES) & (F.col("state") == UNMARKED)).select("node", "m"), "node").filter(F.log("k") >= RECURS * F.log("m")).select("node", "item")
    return written(low.union(recurs), "noise", folder)


def hits(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """``chunk, drop``: the blocks of a chunk that are noise, as page << 32 | block."""
    keyed = lambda salt, item: F.xxhash64("node", item, salt)
    entries = noise.select("node", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).select(keyed(F.col("salt"), F.col("item")).alias("key"))
    blocks = pages.select("row", "chunk", "place", F.posexplode(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["item"].alias("item"), b["state"].alias("state")))).alias("at", "b"))
    blocks = blocks.select("chunk", F.shiftleft("place", 32).bitwiseOR(F.col("at")).alias("at"), "b.node", "b.state", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.col("b.item").alias("own"))
    asks = F.when(F.col("state") == UNMARKED, F.array(F.lit(BRANCH).cast("long"), F.col("own"))).otherwise(F.array(F.lit(BRANCH).cast("long")))
    asked = blocks.withColumn("item", F.explode(asks)).select("chunk", "at", keyed(F.col("salt"), F.col("item")).alias("key"))
    return rows_with(asked, entries, "key").groupBy("chunk").agg(F.collect_set("at").alias("drop"))


def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a chunk at a time
            ids, urls, texts, drop = (batch[c][i].as_py() for c in ("ids", "urls", "texts", "drop"))
            gone = set(drop or ())
            made = ["\n\n".join([t for at, t in enumerate(own) if place << 32 | at not in gone]) for place, own in enumerate(unpacked(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``."""
    folder = shared_folder(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url").cast("string")).alias("host"))
    read = written(rows.mapInArrow(read_pages, PAGE), "pages", folder, batch_rows=200)
    drops = hits(read, noise_of(read, folder))
    texts = read.filter("row = chunk").select("chunk", "ids", "urls", "texts").join(drops, "chunk", "left")
    return texts.select("ids", "urls", "texts", "drop").mapInArrow(join_blocks, RESULT)


__all__ = ["INSIDE", "Block", "extract", "host_of", "judged", "leaves_of", "noise_of", "read_pages"]
