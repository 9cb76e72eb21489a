"""Suffix-array deduplication with run-length indexes.

A byte is removed if a string of LENGTH bytes that covers it also starts
somewhere else, in any document. Three steps find all such strings.

Copies. Texts that are there more than once are repeated as a whole; a task hands
on the stretches of only one of them, so that groups of copies do not grow.

Routing. In each window of LENGTH bytes the k-gram with the least hash is the
anchor (the first of equal ones). Equal windows have the same anchor at the same
offset, so they meet under a key made of the offset's interval and of the bytes
that all windows with such offsets share. Keys that occur once are dropped.
Stretches (the union of a document's windows under one key) with equal bytes are
repeated as a whole; one of them goes on as a witness. Keys with very many
different stretches are keyed anew by shorter intervals and longer shared bytes,
until at last the interval is one offset and the shared bytes are the window.

Index. The different stretches are dealt into blocks of bounded size by their
keys, large keys alone. A block sorts its suffixes, builds the run-compressed
Burrows-Wheeler transform and keeps, for the first and last suffix of each run,
its position and how far it agrees with the neighbour outside the run. Everything
else follows from these samples: streaming over the block, the matching
statistics at a position are those of the sample before it less the distance.
Positions with LENGTH or more are marked.

Passages are the second thing that is found: maximal runs of bytes that strings
of PASSAGE bytes cover, with more than WORDS whole words. Longer strings that
repeat lie within such runs, so the search for LENGTH goes over these runs alone.

Defined results: null text counts as empty; texts shorter than LENGTH keep all;
repeated rows repeat each other, so all of their bytes go if they are that long;
null ids are allowed; texts of any length are searched whole, in overlapping
pieces; an empty table gives an empty result; in deduplicated() further columns
stay, and characters of which only some bytes stay are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, slices, small, table, unused, written
from .shingles import U, mix

LENGTH = 400
#: A passage is a run covered by repeated strings of so many bytes that has more than so many words.
PASSAGE, WORDS = 250, 50
#: Bytes of an anchor.
GRAM = 16
#: Bytes read at once, and at most (positions in a piece take the lower bits of a number).
CHUNK, PIECE_BITS = 1 << 17, 24
#: Bytes in a block of the index; a search takes some 120 bytes for each.
BLOCK = 500_000
#: A key with more different stretches is keyed anew.
CROWD = 1000
_MULTIPLIERS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Two polynomials over bytes: their bases, and a random number for each byte.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_RANDOM = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**64, (2, 256), dtype=np.uint64)


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place on as a number; data ends with eight bytes more than places."""
    out = np.empty(len(data) - 8, np.uint64)
    raw = data.tobytes()
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(raw, f"{order}u8", (len(out) - k + 7) // 8, k)
    return out


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """The place of the anchor of each window of data."""
    words = _words(np.concatenate((data, np.zeros(8, np.uint8))), "<")
    n = len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h += words[k : k + n] * _MULTIPLIERS[k // 8]
    h = (mix(h) >> U(PIECE_BITS) << U(PIECE_BITS)) | np.arange(n, dtype=np.uint64)
    wide, step = length - gram + 1, 1  # the least of the numbers in each span of so many
    while 2 * step <= wide:
        h = np.minimum(h[: len(h) - step], h[step:])
        step *= 2
    h = np.minimum(h[: len(h) - (wide - step)], h[wide - step :]) if wide > step else h
    return (h & U((1 << PIECE_BITS) - 1)).astype(np.int64)


def interval(length: int, level: int, gram: int = GRAM) -> int:
    """How many offsets share a key at a level."""
    return -(-(length - gram + 1) // 2**level)


def _key(text: bytes, at: int, slot: int, width: int, length: int) -> int:
    """The key of windows whose anchor, at the given place, has an offset in the slot."""
    least, most = slot * width, min(length - GRAM, slot * width + width - 1)
    return xxhash.xxh3_64_intdigest(text[at - least : at - most + length], seed=slot * 1024 + width)


@functools.cache
def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * CHUNK, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Hashes:
    """Polynomial hashes of any ranges of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, number: int):
        base = _BASES[number]
        self.inverse = _powers(pow(base, -1, 2**64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[number][data] * _powers(base)[: len(data)])))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def stretches(texts: list[bytes], length: int) -> tuple[list[int], dict[str, np.ndarray]]:
    """The first level. For each text how many stretches, and of all: key, same (hash of its bytes), at (anchor), lo and hi (first and last window)."""
    width = interval(length, 1)
    counts = [0] * len(texts)
    out: dict[str, list] = {k: [] for k in ("key", "same", "at", "lo", "hi")}
    pieces = []  # (text, offset, bytes)

    def flush() -> None:
        if not pieces:
            return
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        at = anchors(data, length)
        sizes = np.array([len(p) for _, _, p in pieces])
        begins = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(pieces)), np.maximum(0, sizes - length + 1))
        start = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes, strict=True)])
        at = at[start]
        slot = (at - start) // width
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (slot[1:] != slot[:-1]) | (piece[1:] != piece[:-1]))))
        lo, hi = start[new], start[np.append(new[1:], len(at)) - 1]
        at, slot, piece = at[new], slot[new], piece[new]
        least = slot * width
        most = np.minimum(length - GRAM, least + width - 1)
        first, second = (_Hashes(data, k) for k in (0, 1))
        shift = np.array([offset for _, offset, _ in pieces])[piece] - begins[piece]
        out["key"].append(mix(first(at - least, at - most + length) + mix((slot * 1024 + width).astype(np.uint64))))
        out["same"].append(first(lo, hi + length) ^ mix(second(lo, hi + length)))
        out["at"].append(at + shift)
        out["lo"].append(lo + shift)
        out["hi"].append(hi + shift)
        for text, n in zip((p[0] for p in pieces), np.bincount(piece, minlength=len(pieces)).tolist(), strict=True):
            counts[text] += n
        pieces.clear()

    total = 0
    for i, text in enumerate(texts):
        for offset in range(0, len(text) - length + 1, CHUNK):
            raw = text[offset : offset + CHUNK + length - 1]
            if total + len(raw) > CHUNK:
                flush()
                total = 0
            pieces.append((i, offset, raw))
            total += len(raw)
    flush()
    return counts, {k: np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64) if k in ("key", "same") else np.concatenate([np.zeros(0, np.int32), *v]).astype(np.int32) for k, v in out.items()}


def suffix_order(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the eight bytes from each place on. data: texts, each with a zero byte behind it; left: bytes to the text's end.

    Ends sort before bytes, and among themselves by place, so no two suffixes are equal.
    """
    n = len(data)
    words = _words(np.concatenate((data, np.zeros(8, np.uint8))), ">")
    short = np.flatnonzero(left < 8)
    words[short] &= ~((U(1) << (U(8) * (U(8) - np.maximum(left[short], 1).astype(np.uint64)))) - U(1))
    words[left == 0] = 0
    first = np.concatenate((short[np.lexsort((short, left[short]))], np.flatnonzero(left >= 8)))
    order = first[np.argsort(words[first], kind="stable")]
    own = left[order] < 8
    new = np.concatenate(([True], (words[order[1:]] != words[order[:-1]]) | own[1:] | own[:-1]))
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    starts = np.maximum.accumulate(np.where(new, slots, 0))
    rank[order] = starts
    depth = 8
    while True:
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order, words
        at = order[slots]
        both = rank[at] * n + rank[at + depth]
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        depth *= 2


def agreement(a: np.ndarray, b: np.ndarray, words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        p, q = a[open_] + out[open_], b[open_] + out[open_]
        most = np.minimum(left[p], left[q])
        full = (words[p] == words[q]) & (most >= 8)
        done = ~full
        differ = (words[p[done]] ^ words[q[done]]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        out[open_[done]] += np.minimum(np.where(differ.any(1), differ.argmax(1), 8), most[done])
        out[open_[full]] += 8
        open_ = open_[full]
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts with samples at the ends of its runs."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        left = np.repeat(self.begins + self.sizes, self.sizes + 1) - np.arange(len(data))
        order, words = suffix_order(data, left)
        # the byte before each suffix; a text's first suffix has none and stands alone
        before = np.where(order > 0, data[order - 1], 0).astype(np.int16)
        first = np.zeros(len(data), bool)
        first[self.begins] = True
        heads = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | first[order[1:]] | first[order[:-1]])))
        self.bytes = before[heads]
        self.lengths = np.diff(np.append(heads, len(order)))
        inner = heads[1:]
        shared = agreement(order[inner - 1], order[inner], words, left)
        #: Places of the first and last suffix of each run, and how far each agrees with its neighbour in the next run.
        self.head, self.head_match = order[heads], np.concatenate(([0], shared))
        self.tail, self.tail_match = order[np.append(inner, len(order)) - 1], np.append(shared, 0)
        self.n = len(data)

    def matching_statistics(self) -> np.ndarray:
        """For each place how long a string starts there that also starts elsewhere, from the samples alone."""
        place = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for at, match in ((self.head, self.head_match), (self.tail, self.tail_match)):
            reach = np.full(self.n, -1)
            reach[at] = at + match
            sample = np.maximum.accumulate(np.where(reach >= 0, place, 0))
            best = np.maximum(best, reach[sample] - place)
        return best

    def repeated(self, length: int) -> list[list[tuple[int, int]]]:
        """For each text the spans that strings of the length cover which start twice or more in all the texts."""
        starts = np.flatnonzero(self.matching_statistics() >= length)
        out: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        if len(starts):
            new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > length) | (np.diff(np.searchsorted(self.begins, starts, "right")) > 0))))
            for lo, hi in zip(starts[new], starts[np.append(new[1:], len(starts)) - 1], strict=True):
                text = int(np.searchsorted(self.begins, lo, "right")) - 1
                out[text].append((int(lo - self.begins[text]), int(hi - self.begins[text]) + length))
        return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


BLANKS = b" \t\n\x0b\x0c\r"
#: What names a text: its number and a hash.
ID = ["id", "hash"]
ROW = "id long, hash long, level int, key long, same long, at int, lo int, hi int"
#: Texts that a task knows by their hashes; beyond it, it forgets them, and copies come twice, which changes nothing.
KNOWN = 1_000_000


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(raw).alias("hash"), raw.alias("raw"))


def _spread(texts: DataFrame, length: int) -> DataFrame:
    """All stretches at the first level; of equal texts in a task, those of one."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole, "raw")):
            fresh = []
            for raw in batch["raw"]:
                name = xxhash.xxh3_128_digest(raw)
                fresh.append(name not in seen)
                seen.add(name)
            if len(seen) > KNOWN:
                seen.clear()
            batch = batch[np.array(fresh, bool)]
            counts, columns = stretches(batch["raw"].tolist(), length)
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), counts), "hash": np.repeat(batch["hash"].to_numpy(), counts), "level": np.int32(1), **columns})

    return written(texts.select(*ID, "raw").mapInPandas(spread, ROW))


def _copies(texts: DataFrame, length: int) -> DataFrame:
    """Spans (id, hash, lo, hi) of texts that are there more than once: all of them; written."""
    names = written(texts.select(*ID, F.xxhash64("raw").alias("one"), F.xxhash64(F.lit(1), "raw").alias("two"), F.octet_length("raw").cast("long").alias("n")).where(F.col("n") >= length))
    often = written(names.groupBy("one", "two", "n").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    out = written(names.join(often, ["one", "two", "n"], "left_semi").select(*ID, F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    drop(names, often)
    return out


def _sorted_out(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """From stretches, a written table that goes: those repeated as a whole, and one of each different kind under keys with several, with the key's kinds and bytes; both written."""
    # sides of joins are tables of their own, so that a key with very many rows can be split
    often = written(rows.groupBy("level", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    live = written(rows.join(often, ["level", "key"]))
    drop(rows, often)
    own = [c for c in live.columns if c not in ("level", "key", "same")]
    kinds = written(live.groupBy("level", "key", "same").agg(F.count("*").alias("n"), F.min(F.struct(*own)).alias("one")))
    whole = written(live.join(kinds.where("n > 1").select("level", "key", "same"), ["level", "key", "same"], "left_semi").select(*ID, "lo", "hi"))
    size = F.col("one.hi") - F.col("one.lo") + length
    several = written(kinds.groupBy("level", "key").agg(F.count("*").alias("kinds"), F.sum(size.cast("long")).alias("bytes")).where("kinds > 1"))
    one = written(kinds.join(several, ["level", "key"]).select("level", "key", "kinds", "bytes", "one.*"))
    drop(live, kinds, several)
    return whole, one


def _blocks(stretches_: DataFrame) -> int:
    """How many blocks the small keys of these stretches need."""
    total = stretches_.where(~_large()).agg(F.coalesce(F.sum(F.col("bytes") / F.col("kinds")), F.lit(0.0))).first()[0]
    return max(1, -(-int(total) // BLOCK))


def _large() -> Column:
    """Whether a key has a block of its own: many small keys even out, few large ones do not."""
    return F.col("bytes") > BLOCK // 8


def _block(first: int, blocks: int) -> Column:
    """The block of a stretch by its key; null if the key is crowded."""
    number = F.xxhash64("level", "key")
    return F.when(F.col("kinds") <= CROWD, F.when(_large(), number).otherwise(first + F.pmod(number, F.lit(blocks))))


#: Stretches with their bytes. block: where they are searched, null if their key is crowded.
PART = "block long, id long, hash long, level int, at int, lo int, hi int, part binary"
NAMES = [c.split()[0] for c in PART.split(", ")]


def _with_parts(texts: DataFrame, one: DataFrame, blocks: int, length: int) -> DataFrame:
    """Stretches of the first level with their bytes; the only time that texts meet stretches."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in slices(whole, "raw")):
            rows = []
            for id_, hash_, raw, found in zip(batch["id"], batch["hash"], batch["raw"], batch["found"], strict=True):
                if (id_, hash_) in seen:  # a repeated row
                    continue
                seen.add((id_, hash_))
                spans = defaultdict(list)
                for x in found:
                    if x["block"] is None:
                        rows.append((None, id_, hash_, x["level"], x["at"], x["lo"], x["hi"], raw[x["lo"] : x["hi"] + length]))
                    else:
                        spans[x["block"]].append((x["lo"], x["hi"] + length))
                rows += [(b, id_, hash_, 0, 0, lo, hi - length, raw[lo:hi]) for b, s in spans.items() for lo, hi in _merged(s)]
            if len(seen) > KNOWN:
                seen.clear()
            yield pd.DataFrame(rows, columns=NAMES).astype({"block": "Int64"})

    found = one.withColumn("block", _block(0, blocks)).groupBy(*ID).agg(F.collect_list(F.struct("block", "level", "at", "lo", "hi")).alias("found"))
    return written(texts.select(*ID, "raw").join(found, ID).mapInPandas(cut, PART))


def _respread(crowded: DataFrame, length: int) -> DataFrame:
    """Crowded stretches keyed by the next level's intervals, with their bytes."""

    def respread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole, "part")):
            rows = []
            for id_, hash_, level, at, first, last, raw in zip(*(batch[c] for c in ("id", "hash", "level", "at", "lo", "hi", "part")), strict=True):
                width, hi = interval(length, level + 1), last
                while hi >= first:
                    slot = (at - hi) // width
                    lo = max(first, at - (slot * width + width - 1))
                    part = raw[lo - first : hi - first + length]
                    key, same = _key(raw, at - first, slot, width, length), xxhash.xxh3_64_intdigest(part)
                    rows.append((id_, hash_, level + 1, key - (key >> 63 << 64), same - (same >> 63 << 64), at, lo, hi, part))
                    hi = lo - 1
            yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in ROW.split(", ")), "part"])

    return written(crowded.mapInPandas(respread, ROW + ", part binary"))


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """Spans (id, hash, lo, hi) repeated among the given stretches, block by block."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        # within a block every place of a text is there once: overlapping stretches become one
        whole: list[list] = []
        for id_, hash_, lo, part in sorted(zip(group["id"], group["hash"], group["lo"], group["part"], strict=True), key=lambda x: x[:3]):
            if whole and whole[-1][:2] == [id_, hash_] and lo <= (end := whole[-1][2] + len(whole[-1][3])):
                whole[-1][3] += part[max(0, end - lo) :]
            else:
                whole.append([id_, hash_, lo, part])
        found = RunIndex([x[3] for x in whole]).repeated(length)
        rows = [(i, h, s + lo, s + hi) for (i, h, s, _), spans in zip(whole, found, strict=True) for lo, hi in spans]
        return pd.DataFrame(rows, columns=["id", "hash", "lo", "hi"]).astype("int64")

    return parts.groupBy("block").applyInPandas(search, "id long, hash long, lo long, hi long")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans (id, hash, lo, hi) that touch or overlap as one: a long text of one letter has as many as letters."""
    order = W.partitionBy(*ID).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(F.col("lo") <= before, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*ID, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def repeated(texts: DataFrame, length: int) -> DataFrame:
    """id, hash and spans (lo, hi) of the texts (id, hash, raw) in which something is repeated; a written table."""
    ends = (*ID, F.col("lo").cast("long").alias("lo"), (F.col("hi") + length).cast("long").alias("hi"))
    whole, one = _sorted_out(_spread(texts, length), length)
    first = _blocks(one.where(F.col("kinds") <= CROWD))
    parts = _with_parts(texts, one, first, length)
    copies = _copies(texts, length)
    spans, crowded = copies.unionByName(whole.select(*ends)), parts.where("block IS NULL").drop("block")
    later, made = None, [copies, whole, one, parts]
    while not crowded.isEmpty():  # at the last level stretches under one key are equal
        whole, one = _sorted_out(_respread(crowded, length), length)
        later = one if later is None else later.unionByName(one)
        spans, crowded = spans.unionByName(whole.select(*ends)), one.where(F.col("kinds") > CROWD).select(*NAMES[1:])
        made += [whole, one]
    searched = parts.where("block IS NOT NULL").select("block", *ID, "lo", "part")
    if later is not None:
        placed = later.where(F.col("kinds") <= CROWD)
        searched = searched.unionByName(placed.select(_block(first, _blocks(placed)).alias("block"), *ID, "lo", "part"))
    out = written(_joined(spans.unionByName(_indexed(searched, length))).groupBy(*ID).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    drop(*made)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, hash and spans of the texts of docs (doc_id, text) in which something is repeated; a written table."""
    return repeated(_texts(docs), length)


def passages(docs: DataFrame, passage: int = PASSAGE, length: int = LENGTH) -> DataFrame:
    """id, hash, spans covered by repeated strings of passage bytes, and long, those covered by strings of length, which is no less."""
    found = repeated_spans(docs, passage)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole, "raw")):
            rows = [
                (id_, hash_, lo, raw[lo:hi])
                for id_, hash_, raw, spans in zip(batch["id"], batch["hash"], batch["raw"], batch["spans"], strict=True)
                for lo, hi in _runs(spans) if hi - lo >= length
            ]
            yield pd.DataFrame(rows, columns=["id", "text_hash", "start", "raw"])

    enough = F.exists("spans", lambda x: x["hi"] - x["lo"] >= length)
    cut = written(_texts(docs).join(found.where(enough), ID).mapInPandas(runs, "id long, text_hash long, start long, raw binary").withColumn("hash", F.xxhash64("text_hash", "start")))
    inner = repeated(cut.select(*ID, "raw"), length)
    inner = inner.join(cut.select(*ID, "text_hash", "start").distinct(), ID).select("id", F.col("text_hash").alias("hash"), F.transform("spans", lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    inner = inner.groupBy(*ID).agg(F.flatten(F.collect_list("spans")).alias("long"))
    out = written(found.join(inner, ID, "left"))
    drop(found, cut)
    return out


def _runs(spans) -> list[tuple[int, int]]:
    """Spans of a row, null without any, as maximal runs."""
    return _merged((x["lo"], x["hi"]) for x in spans) if spans is not None else []


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in gone:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def _wordy(raw: bytes, spans, words: int) -> list[tuple[int, int]]:
    """The maximal runs of the spans that hold more than so many whole words."""
    out = []
    for lo, hi in _runs(spans):
        # a word that goes on beyond an end of the run is not whole
        parts = sum(0 < edge < len(raw) and len(raw[edge - 1 : edge + 1].translate(None, BLANKS)) == 2 for edge in (lo, hi))
        if len(raw[lo:hi].split()) - parts > words:
            out.append((lo, hi))
    return out


def removals(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id, text), and its passages: n_passages and n_passage_bytes."""
    spans = passages(docs, passage, length)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole, "raw")):
            rows = []
            for doc_id, raw, long, found in zip(batch["doc_id"], batch["raw"], batch["long"], batch["spans"], strict=True):
                gone = _runs(long)
                kept = _without(raw, gone)
                marked = _wordy(raw, found, words)
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(marked), sum(hi - lo for lo, hi in marked)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]).astype({"doc_id": "Int64"})

    rows = _texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    joined = rows.join(spans, ID, "left").select("doc_id", "raw", "long", "spans")
    return joined.mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def deduplicated(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with text less its repeated bytes, or of these only runs of more than so many words; all other columns as they are."""
    own = unused(docs, "id", "hash", "spans")
    # few rows are sent to the texts, so that these stay where they are
    spans = small(repeated_spans(docs.select("doc_id", "text"), length)).select(*(F.col(c).alias(name) for c, name in zip(("id", "hash", "spans"), own, strict=True)))

    @F.pandas_udf("string")
    def kept(raws: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(raw, _wordy(raw, s, words) if words else _runs(s)).decode("utf-8", "ignore") for raw, s in zip(raws, spans, strict=True)], dtype=object)

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(own[0])) & (F.xxhash64(raw) == F.col(own[1]))
    left = F.when(F.col(own[2]).isNull(), F.col("text")).otherwise(kept(raw, own[2]))
    return docs.join(spans, same, "left").withColumn("text", left).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
