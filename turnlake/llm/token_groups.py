"""N-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word shingles. Two steps find every link.

Partition. If two sets are similar enough, they differ in at most k shingles.
Shingle space is cut into k + 1 + spare parts, so the two agree wholly in more than
spare of them: documents that share the contents of a part come together. Parts
depend on the size of a set, by bands; a set near the lower end of the next band is
cut for that one too. As long as a set has no more than spare parts that are empty
or shared by very many, it agrees with a similar one in another part, and these
can be left out; only sets with more of them meet there, and are linked at once.
Sets that have no more than spare parts in common with any others have no link.
Near copies share most of their parts, so what goes on is each list of documents
that come together, once, with the number of its parts; parts are dealt out a share
at a time, and a share's shuffle is gone before the next.
Those who come together compare sketches, how many of their
shingles fall into each of 64 classes: the differences of these counts add up to
no more than the number of shingles in which the sets differ. Chains of possible
links make neighbourhoods, which no link leaves.

Search. Within a neighbourhood similar documents form groups. A matrix leads
from tokens (the rarest ones of each member, as many as one of which any link
must share) to groups, and each group stores the union of its members' tokens.
A document meets the groups that the matrix names; the overlap with a group's
union bounds that with each member, so only groups that reach the needed overlap
are opened and compared member by member. Groups that are connected already are
passed over. Neighbourhoods beyond a size are cut into blocks, and each pair of
blocks is searched: the work spreads, and no link is lost.

Equal sets are linked by their fingerprints and need no search.

Defined results: null, empty and blank texts have no shingles and no links;
documents with fewer words than a shingle have one, of all their words; rows that
share a doc_id share its links; rows without doc_id have no component; texts of any
length are searched whole; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, slices, small, table, tidy, written
from .links import components
from .shingles import U, mix, shingle_hashes

#: Least similarity as a fraction, and words in a shingle, of the contract.
NEED, OF = 90, 100
WORDS = 3
#: Ratio of the largest to the smallest size in a band.
BAND = 1.5
#: Classes of a sketch, and documents under one part that compare sketches; a part with more is crowded.
CLASSES, CROWD = 64, 512
#: Of so many parts, one more is spare.
SPARE = 4
#: Shares in which parts are dealt out, a power of two.
SHARES = 4
#: Shingles in a block of a large neighbourhood, and aimed at in one search.
BLOCK = 700_000
#: Rows that a task remembers to know repeated ones; beyond it, it forgets them, and they come twice, which changes nothing.
KNOWN = 500_000


def _bands(largest: int) -> list[tuple[int, int]]:
    low, out = 1, []
    while not out or out[-1][1] < largest:
        out.append((low, max(low, int(low * BAND))))
        low = out[-1][1] + 1
    return out


def signatures(shingles: np.ndarray, need: int, of: int) -> list[dict]:
    """For each band in which an ordered set of hashes may have links, a number for the contents of each part.

    spare: how many of the listed parts the set can do without; empty parts are not
    listed unless there are more of them than the set can do without, which makes it
    negative.
    """
    n = len(shingles)
    bands = _bands(2 * n + 2)
    own = next(i for i, (_, high) in enumerate(bands) if n <= high)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles * U(0x9E3779B97F4A7C15)))))
    out = []
    for band in (own, own + 1):
        low, high = bands[band]
        if band > own and of * n < need * low:
            break
        # |A| + |B| <= 2 high, and they differ in at most (of - need) / (of + need) of that
        differ = 2 * high * (of - need) // (of + need)
        spare = differ // SPARE
        parts = differ + 1 + spare
        part = ((shingles >> U(32)) * U(parts)) >> U(32)
        at = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
        key = (np.arange(parts).astype(np.uint64) * U(0x2545F4914F6CDD1D) + U(band + 1)) * U(0xD6E8FEB86659FD93)
        found, empty = mix(sums[at[1:]] - sums[at[:-1]] + mix(key)), at[1:] == at[:-1]
        found = (found & ~U(1)) | U(band & 1)  # tells the two bands of a set apart
        spare -= int(empty.sum())
        out.append({"band": band, "spare": spare, "parts": (found[~empty] if spare >= 0 else found).view(np.int64)})
    return out


SIGNATURES = "array<struct<band:int,spare:int,parts:array<bigint>>>"


def described(docs: DataFrame, words: int = WORDS, need: int = NEED, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, fingerprint (f, g; null for empty sets), sketch and signatures of each row; a written table.

    A task lists the signatures of equal sets once, with the first row that has a doc_id; rows without one have none.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, hashes in zip(batch["doc_id"], shingle_hashes(batch["text"].tolist(), words), strict=True):
                own = np.unique(hashes)
                if not len(own):
                    rows.append((doc_id, 0, None, None, None, []))
                    continue
                f, g = (int(mix(own ^ U(x)).sum(dtype=np.uint64).astype(np.int64)) for x in (1, 2))
                # counts beyond a byte are cut, which makes differences smaller, never larger
                sketch = np.minimum(np.bincount((own & U(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()
                if doc_id is None or (f, g) in seen:
                    rows.append((doc_id, len(own), f, g, sketch, []))
                    continue
                rows.append((doc_id, len(own), f, g, sketch, signatures(own, need, of)))
                seen.add((f, g))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "f", "g", "sketch", "signatures"]).astype({"f": "Int64", "g": "Int64"})

    # doc_id as text, since pandas has no whole numbers with nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(describe, f"doc_id string, n_shingles long, f long, g long, sketch binary, signatures {SIGNATURES}")
    return written(rows.withColumn("doc_id", F.col("doc_id").cast("long")))


def possible_links(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, need: int, of: int) -> list[tuple[int, int]]:
    """Links between documents whose sizes and sketches allow one, enough to connect all that are connected."""
    links, left = [], np.argsort(nodes, kind="stable")
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            n, m = int(sizes[at]), sizes[left]
            far = np.abs(sketches[left] - sketches[at]).sum(1)
            near = (of * np.minimum(n, m) >= need * np.maximum(n, m)) & ((of + need) * far <= (of - need) * (n + m))
            links += [(int(nodes[at]), int(x)) for x in nodes[left[near]]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def _possible(need: int, of: int):
    """From rows (signature, node, n, sketch) in order of signatures, few for each: possible links among those under one signature."""

    def pairs(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        # two documents under a signature, the usual case, are compared all at once
        lo = starts[ends - starts == 2]
        n, m = sizes[lo], sizes[lo + 1]
        far = np.abs(sketches[lo] - sketches[lo + 1]).sum(1)
        near = lo[(of * np.minimum(n, m) >= need * np.maximum(n, m)) & ((of + need) * far <= (of - need) * (n + m))]
        out = set(zip(nodes[near].tolist(), nodes[near + 1].tolist(), strict=True))
        seen: set[bytes] = set()  # the same documents often share several parts
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if hi - lo > 2 and (own := nodes[lo:hi].tobytes()) not in seen:
                seen.add(own)
                out.update(possible_links(nodes[lo:hi], sizes[lo:hi], sketches[lo:hi], need, of))
        return out

    def find(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the rows of the last signature: more may follow
        for batch in rows:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(batch):
                signature = batch["signature"].to_numpy()
                starts = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
                yield linked(batch, starts[:-1], starts[1:])
                held = batch.iloc[int(starts[-1]) :]
        if held is not None:
            yield linked(held, np.array([0]), np.array([len(held)]))

    def linked(batch: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        sketches = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(-1, CLASSES).astype(np.int16)
        found = pairs(batch["node"].to_numpy(), batch["n"].to_numpy(), sketches, starts, ends)
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return find


def _met(rows: DataFrame) -> DataFrame:
    """From rows (signature, node): the lists of nodes under one signature, each with the signatures' band and their number (rows), and the crowded signatures; a written table.

    Of a signature CROWD + 1 rows are enough to know that it is crowded, so no more
    of them travel from any task, however many documents have it.
    """
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("signature").orderBy("node"))).where(F.col("place") <= CROWD + 1)
    shared = ranked.withColumn("rows", F.count("*").over(W.partitionBy("signature"))).where("rows > 1")
    lists = shared.groupBy("signature").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    crowded = F.size("nodes") > CROWD
    half = F.col("signature").bitwiseAND(1).alias("band")
    return written(lists.select(F.when(crowded, F.col("signature")).alias("signature"), F.when(~crowded, F.col("nodes")).alias("nodes"), half).groupBy("signature", "nodes", "band").agg(F.count("*").alias("rows")))


def neighbourhoods(described_: DataFrame, need: int = NEED, of: int = OF) -> DataFrame:
    """node and component of documents that may be linked, directly or in a chain."""
    half = F.col("signature").bitwiseAND(1)
    each = described_.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.explode("signatures").alias("s"))
    rows = each.select("node", F.explode("s.parts").alias("signature"))
    share = F.shiftrightunsigned("signature", 64 - (SHARES.bit_length() - 1)) if SHARES > 1 else F.lit(0)
    shares = [_met(rows.where(share == k)) for k in range(SHARES)]
    shared = functools.reduce(DataFrame.unionByName, shares)
    crowded = written(shared.where("signature IS NOT NULL").select("signature"))
    met = rows.join(small(crowded), "signature").withColumn("band", half)
    few = shared.where("nodes IS NOT NULL").groupBy("nodes", "band").agg(F.sum("rows").alias("rows"))
    few = written(few.withColumn("signature", F.xxhash64("nodes", "band")))
    drop(*shares)
    member = few.select("signature", F.explode("nodes").alias("node"), "band", "rows")
    # how many parts of each document others have too, few or very many, and how many it can do without
    spare = each.groupBy("node", F.col("s.band").bitwiseAND(1).cast("long").alias("band")).agg(F.min("s.spare").alias("spare"))
    counted = member.groupBy("node", "band").agg(F.sum("rows").alias("few"), F.lit(0).cast("long").alias("many"))
    counted = counted.unionByName(met.groupBy("node", "band").agg(F.lit(0).cast("long").alias("few"), F.count("*").alias("many")))
    counted = counted.groupBy("node", "band").agg(F.sum("few").alias("few"), F.sum("many").alias("many")).join(spare, ["node", "band"])
    # with no more common parts than that, a document is like none; with more crowded ones, it may be like one under these alone
    hopeful = written(counted.where(F.col("few") + F.col("many") > F.col("spare")))
    bound = written(met.join(hopeful.where("many > spare").select("node", "band"), ["node", "band"]).select("signature", "node"))
    first = bound.groupBy("signature").agg(F.min("node").alias("first"))
    at_once = bound.join(first, "signature").select(F.col("first").alias("a"), F.col("node").alias("b"))
    sketches = described_.where("doc_id IS NOT NULL AND n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch").distinct()
    hoping = hopeful.select("node", "band").join(sketches, "node")
    met_few = member.select("signature", "node", "band").join(hoping, ["node", "band"]).repartition("signature").sortWithinPartitions("signature", "node")
    links = written(met_few.select("signature", "node", "n", "sketch").mapInPandas(_possible(need, of), "a long, b long").unionByName(at_once).distinct())
    drop(few, crowded, hopeful, bound)
    return components(links)


def search_block(ids: np.ndarray, sets: list[np.ndarray], need: int = NEED, of: int = OF) -> list[tuple[int, int]]:
    """Links between the given sets, enough of them to connect all that are connected."""
    if len(sets) < 2:
        return []
    tokens, local, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(tokens))  # rare ones first
    shared = np.zeros(len(tokens), bool)
    shared[rank] = count > 1
    local = rank[local]
    ends = np.cumsum([len(s) for s in sets])
    own = [np.sort(x) for x in np.split(local, ends[:-1])]
    mine = np.zeros(len(tokens), bool)
    leads: dict[int, set[int]] = defaultdict(set)  # the matrix: token to groups
    unions: list[np.ndarray] = []
    members: list[list[int]] = []
    parent: list[int] = []
    links = []

    def top(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    for d in sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i])):
        q = own[d]
        n = len(q)
        if not n:
            continue
        least = -(-need * n // of)  # of its shingles that a linked document shares
        rare = q[: n - least + 1]
        rare = rare[shared[rare]].tolist()
        home = None
        mine[q] = True
        for g in sorted({g for t in rare for g in leads.get(t, ())}):
            if home is not None and top(g) == top(home):
                continue
            if np.count_nonzero(mine[unions[g]]) < least:
                continue
            group = [m for m in members[g] if of * len(own[m]) >= need * n]
            if not group:
                continue
            sizes = np.array([len(own[m]) for m in group])
            common = np.add.reduceat(mine[np.concatenate([own[m] for m in group])].astype(np.int64), np.cumsum(sizes) - sizes)
            linked = np.flatnonzero(of * common >= need * (n + sizes - common))
            if len(linked):
                links.append((int(ids[d]), int(ids[group[linked[0]]])))
                if home is None:
                    home = g
                else:
                    parent[top(g)] = top(home)
        mine[q] = False
        if home is None:
            home = len(members)
            members.append([])
            parent.append(home)
            unions.append(q)
        else:
            unions[home] = np.union1d(unions[home], q)
        members[home].append(d)
        for t in rare:
            leads[t].add(home)
    return links


def similar_links(docs: DataFrame, described_: DataFrame, words: int = WORDS, need: int = NEED, of: int = OF, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all documents whose different sets are similar enough."""
    return links_within(neighbourhoods(described_, need, of), docs, described_, words, need, of, block)


def links_within(near: DataFrame, docs: DataFrame, described_: DataFrame, words: int = WORDS, need: int = NEED, of: int = OF, block: int = BLOCK) -> DataFrame:
    """The links (a, b) in neighbourhoods."""
    sizes = described_.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n"))
    near = written(near.join(sizes, "node"))
    whole = near.groupBy("component").agg(F.sum("n").alias("n"))
    # large neighbourhoods are cut into blocks, small ones share a search
    together = max(1, -(-int(whole.where(F.col("n") <= block).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // block))
    whole = whole.select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = near.select("node", "component").join(whole, "component")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "component", "blocks", own.alias("own"), other)
    alone = F.col("blocks") == 1
    placed = written(placed.select(
        "node",
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(together))).otherwise(F.col("component")).alias("bundle"),
        F.when(alone, -1).otherwise(F.least("own", "other")).alias("i"),
        F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("j"),
    ))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            # a repeated row goes on once from each task
            own = list(zip(batch["node"], batch["bundle"], batch["i"], batch["j"], map(hash, batch["text"]), strict=True))
            batch = batch[[x not in seen and not seen.add(x) for x in own]]
            if len(seen) > KNOWN:
                seen.clear()
            yield batch[["node", "bundle", "i", "j"]].assign(shingles=[np.unique(h).view(np.int64) for h in shingle_hashes(batch["text"].tolist(), words)])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = search_block(group["node"].to_numpy(), [np.asarray(s, np.int64) for s in group["shingles"]], need, of)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(placed), F.col("doc_id") == F.col("node")).select("node", "bundle", "i", "j", "text")
    return texts.mapInPandas(sets, "node long, bundle long, i int, j int, shingles array<long>").groupBy("bundle", "i", "j").applyInPandas(search, "a long, b long")


def equal_links(described_: DataFrame) -> DataFrame:
    """Links (a, b) from each document to the first one with an equal set."""
    rows = described_.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "f", "g")
    first = written(rows.groupBy("n_shingles", "f", "g").agg(F.min("doc_id").alias("a"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    return rows.join(small(first), ["n_shingles", "f", "g"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))


def join(docs: DataFrame, words: int = WORDS, need: int = NEED, of: int = OF) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    with tidy(docs.sparkSession):
        signed = described(docs, words, need, of)
        rows = written(signed.drop("signatures"))
        near = neighbourhoods(signed, need, of)
        drop(signed)  # parts take as much room as texts
        linked = components(equal_links(rows).unionByName(links_within(near, docs, rows, words, need, of)))
        linked = written(linked.where("node <> component"))
    out = rows.select("doc_id", "n_shingles").join(small(linked), F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) AS m ON m.a = d.doc_id
"""
