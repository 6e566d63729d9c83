"""Main texts of pages by equivalence classes: what a host's pages share is deduced as a template, what is left are slots.

1. Tokens (opened elements by their place, blocks of text by place and text) get their occurrence vector over the pages of their
   host, as two sums of count times a random number of the page: equal vectors have equal sums, and sums are combined before the shuffle.
2. Tokens of a host with equal vectors, on enough of its pages, form a class. Tokens that stand once on each of their pages order the
   template: they are valid where they have the same rank in their class on all its pages. Repeated tokens nest in it: they are valid
   where they always stand in the same gap of the ordering ones. Others leave the template.
3. The text between template tokens belongs to slots, named by place in the tree and the template token before. By slot a host's pages tell how much
   text and how much linked text it has, so one page with a short article and long comments is read like its siblings.
4. A page's article is what a marked article holds, or else the deepest container with most of the host's usual text, without
   elements that are named as menus, adverts and so on, without slots of links, and without blocks that belong to the template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored
from pagemill.llm.htmltree import Block, Node, parse

#: A task sends what it has counted when it holds this many sums.
_HELD = 200_000
_SIGN = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


class _Counts:
    """Sums by (host, key), sent as rows of a record batch whenever there are many."""

    def __init__(self, names: list[str]):
        self.names, self.sums = names, {}

    def add(self, host: str, key: tuple, values: tuple) -> None:
        have = self.sums.get((host, *key))
        self.sums[(host, *key)] = values if have is None else tuple(a + b for a, b in zip(have, values, strict=True))

    def full(self) -> bool:
        return len(self.sums) >= _HELD

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in self.sums.items()), strict=True)) or [()] * len(self.names)
        self.sums = {}
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=self.names)


def _token_counts(tokens: list[Node | Block]) -> dict[int, int]:
    counts: dict[int, int] = {}
    for t in tokens:
        counts[t.code] = counts.get(t.code, 0) + 1
    return counts


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, n_pages, total, v1, v2): by token of a host its pages, its occurrences and its vector's two sums. Token 0 stands once on every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(["host", "token", "n_pages", "total", "v1", "v2"])
        for batch in batches:
            for host, row, html in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "html")), strict=True):
                page = xxhash.xxh64_intdigest((html or "").encode("utf-8", "replace"), row % (1 << 64))
                one, two = page & 0x7FFFFFFF, page >> 33
                for token, n in [(0, 1), *_token_counts(parse(html)).items()]:
                    counts.add(host, (_signed(token),), (1, n, n * one, n * two))
                if counts.full():
                    yield counts.batch()
        yield counts.batch()

    schema = "host string, token long, n_pages long, total long, v1 long, v2 long"
    return pages.where("host is not null").mapInArrow(run, schema).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("n_pages", "total", "v1", "v2")))


def equivalence_classes(vectors: DataFrame, min_pages: int, min_share: float, min_tokens: int) -> DataFrame:
    """(host, n_host, token, class, once): tokens on at least min_pages and min_share of their host's pages that share their vector with min_tokens tokens.

    A host has at most (distinct tokens of a mean page) / min_share such tokens, however many its pages are.
    """
    hosts = vectors.where("token = 0").select("host", F.col("n_pages").alias("n_host"))
    common = vectors.where(f"token <> 0 and n_pages >= {min_pages}").join(hosts, "host").where(F.col("n_pages") >= F.col("n_host") * min_share)
    named = common.withColumn("class", F.xxhash64("v1", "v2", "n_pages", "total")).withColumn("once", F.col("n_pages") == F.col("total"))
    large = named.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_tokens).drop("size")
    return named.join(large, ["host", "class"]).select("host", "n_host", "token", "n_pages", "class", "once")


def _with_host_table(pages: DataFrame, table: DataFrame, limit_bytes: int, row_bytes: Column, salts: int = 64) -> DataFrame:
    """pages with the row of their host, broadcast where all rows together are small; else dealt out by host and one of `salts`
    parts of its pages, so that no task gets a host whole."""
    size = table.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first().n
    if size <= limit_bytes:
        return pages.join(F.broadcast(table), "host", "left")
    parts = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("part", F.pmod(F.col("row"), F.lit(salts)).cast("int")).join(parts, ["host", "part"], "left").drop("part")


@dataclass
class _Template:
    """What a task knows of a host: each template token's class and whether it orders the template; the weights of slots."""

    token_class: dict[int, int]
    once: set[int]
    weights: dict[int, float]
    linked: set[int]


_NONE = _Template({}, set(), {}, set())


def _templates(batch: pa.RecordBatch) -> Iterator[tuple[int, _Template]]:
    """The template of each row's host, made once for neighbouring rows of a host."""
    made: dict[str, _Template] = {}
    names = batch.schema.names
    for i, host in enumerate(batch.column("host").to_pylist()):
        if host is None:
            yield i, _NONE
            continue
        if host not in made:
            tokens = [(t["token"], t["class"], t["once"]) for t in (batch.column("tokens")[i].as_py() or ())]
            slots = batch.column("slots")[i].as_py() or () if "slots" in names else ()
            made[host] = _Template({t: c for t, c, _ in tokens}, {t for t, _, once in tokens if once}, {s["slot"]: s["weight"] for s in slots}, {s["slot"] for s in slots if s["links"]})
        yield i, made[host]


def _slots(tokens: list[Node | Block], template: _Template) -> Iterator[tuple[Block, bool, int, int]]:
    """(block, belongs to the template, its slot after the last ordering token, its slot by place alone)."""
    after = 0
    for t in tokens:
        token = _signed(t.code)
        if token in template.once:
            after = t.code
        if isinstance(t, Block):
            yield t, token in template.token_class, _signed(xxhash.xxh64_intdigest(after.to_bytes(8), t.node.code)), _signed(t.node.code)


def template_orders(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From pages with their host's classes (tokens): on how many pages a token stands at which place (host, token, at, n), for ordering
    tokens the rank in their class, for repeated ones the ordering token before; and by slot its pages and characters outside of the
    template (host, slot, n_pages, chars, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(["host", "kind", "key", "other", "n", "chars", "linked"])
        for batch in batches:
            hosts, htmls = batch.column("host"), batch.column("html")
            for i, template in _templates(batch):
                host, tokens = hosts[i].as_py(), parse(htmls[i].as_py())
                rank, after, places = {}, 0, set()
                for token in (_signed(t.code) for t in tokens):
                    if token in template.once:
                        own = template.token_class[token]
                        rank[own] = rank.get(own, 0) + 1
                        places.add((token, rank[own]))
                        after = token
                    elif token in template.token_class:
                        places.add((token, after))
                for token, at in places:
                    counts.add(host, (0, token, at), (1, 0, 0))
                chars: dict[int, list[int]] = {}
                for block, fixed, slot, place in _slots(tokens, template):
                    for key in (slot, place):
                        have = chars.setdefault(key, [0, 0])
                        have[0] += 0 if fixed else len(block.text)
                        have[1] += 0 if fixed else block.linked
                for key, (n, linked) in chars.items():
                    counts.add(host, (1, key, 0), (1, n, linked))
                if counts.full():
                    yield counts.batch()
        yield counts.batch()

    schema = "host string, kind long, key long, other long, n long, chars long, linked long"
    sums = stored(pages.where("host is not null").mapInArrow(run, schema).groupBy("host", "kind", "key", "other").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked"))))
    orders = sums.where("kind = 0").select("host", F.col("key").alias("token"), F.col("other").alias("at"), "n")
    return orders, sums.where("kind = 1").select("host", F.col("key").alias("slot"), F.col("n").alias("n_pages"), "chars", "linked")


def valid_tokens(classes: DataFrame, orders: DataFrame) -> DataFrame:
    """classes without tokens that have no fixed place: an ordering token needs the same rank among those of its class on all its
    pages, a repeated one nests in the template where all its occurrences are in one gap."""
    by_token = orders.groupBy("host", "token").agg(F.count(F.lit(1)).alias("places"))
    return classes.join(by_token.where("places = 1"), ["host", "token"]).drop("places")


def usual_slots(slots: DataFrame, hosts: DataFrame, min_pages: int, min_share: float, link_share: float) -> DataFrame:
    """(host, slot, weight, links): by slot the mean text outside of the template and whether most of it is linked, for slots on enough of their host's
    pages to tell; others are judged by the page itself. A host has at most (slots of a mean page) / min_share of them."""
    enough = slots.join(hosts, "host").where((F.col("n_pages") >= min_pages) & (F.col("n_pages") >= F.col("n_host") * min_share))
    return enough.select("host", "slot", (F.col("chars") / F.col("n_pages")).alias("weight"), (F.col("linked") > F.col("chars") * link_share).alias("links"))


Found = tuple[Block, bool, int]


def _masses(found: list[Found], weights: dict[int, float]) -> dict[Node, float]:
    """By element the usual text of the slots in it."""
    total: dict[Node, float] = {}
    for key, node in {key: block.node for block, _, key in found}.items():
        total[node] = total.get(node, 0.0) + weights[key]
    for node in list(total):
        while (node := node.parent) is not None and node not in total:
            total[node] = 0.0
    for node in sorted(total, key=lambda x: -x.depth):
        if node.parent is not None:
            total[node.parent] += total[node]
    return total


def _deepest(total: dict[Node, float], share: float) -> Node:
    """Where one comes by going from the page to the container in it with most text, as long as that has `share` of the text."""
    inner: dict[Node, list[Node]] = {}
    for node in total:
        if not node.leaf and node.parent is not None:
            inner.setdefault(node.parent, []).append(node)
    at = next(x for x in total if x.parent is None)
    while at in inner and total[best := max(inner[at], key=total.__getitem__)] >= share * total[at]:
        at = best
    return at


def _within(nodes: set[Node], container: Node) -> set[Node]:
    """Those of the nodes that are the container or lie in it; each element on the way is looked at once."""
    known = {container: True}
    for node in nodes:
        chain = []
        while node is not None and node not in known:
            chain.append(node)
            node = node.parent
        known.update(dict.fromkeys(chain, node is not None and known[node]))
    return {n for n in nodes if known[n]}


def main_blocks(tokens: list[Node | Block], template: _Template, container_share: float = 0.6, marked_share: float = 0.3, fixed_share: float = 0.5) -> list[str]:
    """The blocks of a page's article, in page order.

    Blocks in elements named as something else go, and slots of links. Forms count as such, unless the page has nothing outside of them. A marked article
    is taken if it has marked_share of the text, else a marked main part; failing both, the deepest container with container_share of the
    text. Blocks of the template go, unless they are more than fixed_share of what would be left: then pages repeat their article.
    """
    found: list[Found] = []
    own: dict[int, list[int]] = {}
    for block, fixed, slot, place in _slots(tokens, template):
        key = slot if slot in template.weights else place
        found.append((block, fixed, key))
        have = own.setdefault(key, [0, 0])
        have[0] += len(block.text)
        have[1] += block.linked
    links = {k for k, (n, linked) in own.items() if (k in template.linked if k in template.weights else linked > 0.5 * n)}
    kept = [x for x in found if x[0].node.out == 0 and x[2] not in links] or [x for x in found if x[0].node.out == 1 and x[2] not in links]
    if not kept:
        return []
    weights = {k: template.weights.get(k, float(n)) + 1e-6 for k, (n, _) in own.items()}
    in_all = sum(weights[k] for k in {x[2] for x in kept})
    for level in (2, 1):
        marked = [x for x in kept if x[0].node.main >= level]
        if sum(weights[k] for k in {x[2] for x in marked}) >= marked_share * in_all:
            break
    else:
        marked = []
    kept = marked or kept
    if not marked or level == 1:
        top = _deepest(_masses(kept, weights), container_share)
        inside = _within({x[0].node for x in kept}, top)
        kept = [x for x in kept if x[0].node in inside]
    data = [x for x in kept if not x[1]]
    if sum(len(b.text) for b, _, _ in data) >= (1 - fixed_share) * sum(len(b.text) for b, _, _ in kept):
        kept = data
    return [b.text for b, _, _ in kept]


def main_texts(pages: DataFrame, min_pages: int = 4, min_share: float = 0.5, min_tokens: int = 2, slot_share: float = 0.05, link_share: float = 0.5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), one row for every row of pages: the main text as blocks joined by two line feeds, and its code points.

    Null, empty and unreadable pages have an empty text. Pages without a host (null url) and those of hosts with fewer than min_pages pages are read by
    themselves. Repeated ids and repeated rows are pages of their own. Of a host's copies of one article nothing is lost: text that they share is only left out beside
    as much other text. Other columns are not read. The host's table goes to every task up to broadcast_bytes for all hosts, else with its pages.
    """
    given = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = given.withColumn("host", host_of(F.col("url"))).withColumn("row", F.xxhash64("page_id", "html"))
    vectors = stored(occurrence_vectors(hosted.select("host", "row", "html")).where(f"token = 0 or n_pages >= {min_pages}"))
    hosts = vectors.where("token = 0").select("host", F.col("n_pages").alias("n_host"))
    classes = stored(equivalence_classes(vectors, min_pages, min_share, min_tokens))

    def by_host(tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("host").agg(F.collect_list(F.struct("token", "class", "once")).alias("tokens"))

    first = stored(by_host(classes))
    orders, slots = template_orders(_with_host_table(hosted.select("host", "row", "html"), first, broadcast_bytes, F.size("tokens") * 24))
    usual = usual_slots(slots, hosts, min_pages, slot_share, link_share).groupBy("host").agg(F.collect_list(F.struct("slot", "weight", "links")).alias("slots"))
    known = stored(by_host(valid_tokens(classes, orders)).join(usual, "host", "full"))
    told = _with_host_table(hosted, known, broadcast_bytes, F.greatest(F.size("tokens"), F.lit(0)) * 24 + F.greatest(F.size("slots"), F.lit(0)) * 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column("html")
            texts = ["\n\n".join(main_blocks(parse(htmls[i].as_py()), template)) for i, template in _templates(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return told.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
