"""Occurrences and records of every distinct term, by burst tries.

Each task walks its records through a burst trie: a container holds the counters of the terms below one prefix and
bursts, at the next character after what all of them share, when it exceeds BURST terms. What a task ships is not rows
but compact subtries (prefix, suffix -> counters), and the weight (terms below) of every prefix that burst or holds a
container.

Weights add up over the tasks. The prefixes with more than ROUTED entries in all, the ROUTES heaviest of them, are the
routing table: adaptive prefixes, deep where terms are many. It is bounded whatever the data (ROUTES prefixes of at most
DEPTH characters), and it needs no closure: a term's subtree is named by the longest routing prefix that it begins with
and the character after it, which every task works out alike. Tasks route and merge the subtries they read, so a
partition ships each term once; then equal names are merged. Beyond the table's reach (a subtree of more than PIECE
entries, whatever its terms share) a subtree is cut by a hash of the term, so no merge meets more than about PIECE
entries, unless they are of one term.

Defined results: terms keep their case and lose white space at both ends; null and blank terms are none; a null count
is 0; a term repeated in a record counts as one record with its counts added; arrays of unequal length lack counts or
ratios at the end; null keys are keys; of versions with equal written_at the one with the greater hash holds.
"""

from __future__ import annotations

import math
import os
import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.common import settle

#: Terms of a container before it bursts; entries of all tasks below a prefix from which it routes; most routing prefixes, and their greatest length; terms a task holds before it ships them; entries of a merge.
BURST, ROUTED, ROUTES, DEPTH, FLUSH, PIECE = 32, 32, 65_536, 200, 500_000, 200_000


def _merge(into: list, c: list) -> None:
    into[0] += c[0]
    into[1] += c[1]
    into[2] = c[2] if into[2] is None else into[2] if c[2] is None else min(into[2], c[2])
    into[3] = c[3] if into[3] is None else into[3] if c[3] is None else max(into[3], c[3])


class BurstTrie:
    """Counters [occurrences, records, lowest, highest] by term. A Container maps suffixes to counters; a node is [what all terms below share, child by next character]; the child of the empty key holds the term that ends there."""

    class Container(dict):
        """suffix -> counters."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.terms = burst, self.Container(), 0

    def _grown(self, box: Container) -> list:
        shared = os.path.commonprefix([min(box), max(box)])
        children: dict = {}
        for suffix, c in box.items():
            rest = suffix[len(shared) :]
            children.setdefault(rest[:1], self.Container())[rest[1:]] = c
        return [shared, children]

    def add(self, term: str, c: list) -> None:
        place, key, node, at = self.__dict__, "root", self.root, 0
        while True:
            if isinstance(node, self.Container):
                if (have := node.get(term[at:])) is not None:
                    return _merge(have, c)
                if len(node) < self.burst or key == "":
                    node[term[at:]] = list(c)
                    self.terms += 1
                    return None
                node = place[key] = self._grown(node)
            shared, children = node
            if not term.startswith(shared, at):  # the term leaves the node's shared stretch: it becomes two nodes
                k = len(os.path.commonprefix([shared, term[at : at + len(shared)]]))
                node[:] = [shared[:k], {shared[k]: [shared[k + 1 :], children]}]
                continue
            at += len(shared)
            place, key = children, term[at : at + 1]
            node = children.setdefault(key, self.Container())
            at += len(key)

    def parts(self) -> Iterator[tuple[str, bool, Container | None, int]]:
        """(prefix, ends, container, terms) of every container, and of every node, with container None. ends: it holds the term equal to the prefix, and no other."""
        todo: list = [("", False, self.root, [])]
        nodes = []
        while todo:
            prefix, ends, node, above = todo.pop()
            if isinstance(node, self.Container):
                for count in above:
                    count[0] += len(node)
                yield prefix, ends, node, len(node)
            else:
                prefix += node[0]
                nodes.append((prefix, own := [0]))
                todo += [(prefix + k, not k, v, [*above, own]) for k, v in node[1].items()]
        yield from ((prefix, False, None, count[0]) for prefix, count in nodes)


def latest(token_preference: DataFrame) -> DataFrame:
    """The version with the latest written_at of each (run_id, feature): token, token_Count, token_Global_Ratio."""
    row = F.struct("token", "token_Count", "token_Global_Ratio")
    return token_preference.groupBy("run_id", "feature").agg(F.max_by(row, F.struct("written_at", F.xxhash64(row))).alias("r")).select("r.*")


PARTS = "prefix string, ends boolean, subtrie binary, terms long, records long"


def _shipped(trie: BurstTrie) -> list[tuple]:
    return [(p, ends, None if box is None else pickle.dumps(dict(box)), n, 0) for p, ends, box, n in trie.parts() if n]


def _worker(batches: Iterator[pd.DataFrame], burst: int, flush: int) -> Iterator[pd.DataFrame]:
    trie, records, columns = BurstTrie(burst), 0, ["prefix", "ends", "subtrie", "terms", "records"]
    for b in batches:
        if trie.terms > flush:
            yield pd.DataFrame(_shipped(trie), columns=columns)
            trie = BurstTrie(burst)
        for terms, counts, ratios in zip(b["token"], b["token_Count"], b["token_Global_Ratio"]):
            own: dict = {}
            n, m = 0 if counts is None else len(counts), 0 if ratios is None else len(ratios)
            for i, t in enumerate(() if terms is None else terms):
                if t is None or not (t := t.strip()):
                    continue
                k = counts[i] if i < n else None
                r = ratios[i] if i < m else None
                k = 0 if k is None or k != k else int(k)
                r = None if r is None or math.isnan(r) else float(r)
                _merge(own.setdefault(t, [0, 1, None, None]), [k, 0, r, r])
            records += bool(own)
            for t, c in own.items():
                trie.add(t, c)
    yield pd.DataFrame([*_shipped(trie), (None, False, None, 0, records)], columns=columns)


class Routing:
    """Names the subtree of a term: the longest routing prefix that it begins with, and the next character."""

    def __init__(self, prefixes: set[str]):
        self.prefixes, self.lengths = prefixes, sorted({len(p) for p in prefixes}, reverse=True)

    def of(self, term: str) -> str:
        longest = next((n for n in self.lengths if n <= len(term) and term[:n] in self.prefixes), 0)
        return term[: longest + 1]


def routing_prefixes(parts: DataFrame, routed: int = ROUTED, routes: int = ROUTES) -> set[str]:
    """The heaviest prefixes with more than `routed` entries, at most `routes`: a bounded table."""
    heavy = parts.where(~F.col("ends") & (F.length("prefix").between(1, DEPTH))).groupBy("prefix").agg(F.sum("terms").alias("n")).where(F.col("n") > routed)
    return {r.prefix for r in heavy.orderBy(F.desc("n"), "prefix").limit(routes).collect()}


def _routed(parts: DataFrame, prefixes: set[str], flush: int) -> DataFrame:
    """(route, subtrie, terms): the subtries that a task reads, merged by route."""
    shared = parts.sparkSession.sparkContext.broadcast(prefixes)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        routing = Routing(shared.value)
        boxes: dict = {}
        held = 0
        for b in batches:
            for prefix, blob in zip(b["prefix"], b["subtrie"]):
                for suffix, c in pickle.loads(blob).items():
                    box = boxes.setdefault(routing.of(prefix + suffix), {})
                    if (have := box.get(prefix + suffix)) is None:
                        box[prefix + suffix] = c
                        held += 1
                    else:
                        _merge(have, c)
            if held > flush:
                yield _boxes(boxes)
                boxes, held = {}, 0
        yield _boxes(boxes)

    return parts.where("subtrie is not null").select("prefix", "subtrie").mapInPandas(route, "route string, subtrie binary, terms long")


def _boxes(boxes: dict) -> pd.DataFrame:
    return pd.DataFrame([(r, pickle.dumps(box), len(box)) for r, box in boxes.items()], columns=["route", "subtrie", "terms"])


def _pieces(routed: DataFrame, piece: int) -> DataFrame:
    """(route, piece, subtrie): subtrees with more than `piece` entries in all cut by a hash of the term."""
    sizes = routed.groupBy("route").agg(F.ceil(F.sum("terms") / piece).cast("int").alias("cuts")).where("cuts > 1")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for route, blob, n in zip(b["route"], b["subtrie"], b["cuts"]):
                if n == 1:
                    out.append((route, 0, blob))
                    continue
                boxes: dict = {}
                for term, c in pickle.loads(blob).items():
                    boxes.setdefault(zlib.crc32(term.encode("utf-8", "surrogatepass")) % n, {})[term] = c
                out += [(route, i, pickle.dumps(box)) for i, box in boxes.items()]
            yield pd.DataFrame(out, columns=["route", "piece", "subtrie"])

    return routed.join(sizes, "route", "left").select("route", "subtrie", F.coalesce("cuts", F.lit(1)).alias("cuts")).mapInPandas(cut, "route string, piece int, subtrie binary")


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    whole: dict = {}
    for blob in pdf["subtrie"]:
        for term, c in pickle.loads(blob).items():
            if (have := whole.get(term)) is None:
                whole[term] = c
            else:
                _merge(have, c)
    return pd.DataFrame([(t, *c) for t, c in whole.items()], columns=["token", "total", "records", "lowest", "highest"]).astype({"lowest": "float64", "highest": "float64"})


def subtries(token_preference: DataFrame, burst: int = BURST, flush: int = FLUSH) -> DataFrame:
    """What the tasks ship: (prefix, ends, subtrie, terms, records), settled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _worker(batches, burst, flush)

    return settle(latest(token_preference).mapInPandas(work, PARTS))


def merge_groups(parts: DataFrame, prefixes: set[str], flush: int = FLUSH, piece: int = PIECE) -> DataFrame:
    """(route, piece, subtrie): what is merged together."""
    return _pieces(settle(_routed(parts, prefixes, flush)), piece)


def term_counts(token_preference: DataFrame, burst: int = BURST, routed: int = ROUTED, routes: int = ROUTES, flush: int = FLUSH, piece: int = PIECE) -> DataFrame:
    """(token, total, records, lowest, highest, mark): mark is rare (fewer than 3 records or a total below 5), common (in more than half of the records that have a term), or null; rare goes first."""
    parts = subtries(token_preference, burst, flush)
    records = parts.agg(F.sum("records")).first()[0] or 0
    groups = merge_groups(parts, routing_prefixes(parts, routed, routes), flush, piece)
    terms = groups.groupBy("route", "piece").applyInPandas(_merged, "token string, total long, records long, lowest double, highest double")
    return terms.withColumn("mark", F.when((F.col("records") < 3) | (F.col("total") < 5), "rare").when(F.col("records") * 2 > records, "common"))
