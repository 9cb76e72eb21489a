"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a model span a lattice over the text. Forward Viterbi gives the
best score up to each place; a backward A-star search from the end uses these
scores as its heuristic. As they are exact, complete segmentations leave the
queue in order of their scores, the best first.

No piece of the model has a space after another character, so every lattice
falls apart before the first space of a run (and around line breaks if no piece
holds one). Each distinct part gets its best segmentation and the loss of its
second best. The N best of the whole text differ from the best in few parts,
those with the least losses; there the search gives the alternatives, which are
combined to the exact N best.

A way that leaves the best one enters some place of it, seen from the end for
the first time, by another piece. So the runner-up of the forward pass at the
places of the best way gives the loss of the second best, and the N - 1 least of
these losses bound the search: what loses more never enters the queue.

Characters without a piece are spelled in byte pieces. As in the model's own
rules a text gets one space in front; decoding takes it off again, so decoding
what was encoded gives back the text, whatever its characters.

Defined results: null and empty texts have one segmentation without pieces, of
score 0, and decode to the empty text; texts with fewer than N segmentations have
as many as there are; segmentations of equal score come in an order that is the
same on every run; texts of any length are encoded whole, those without spaces as
one part; repeated rows are encoded alike; an empty table gives an empty result;
further columns stay where they are wanted.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MODEL = "piece_bpe_32k.model"
N_BEST = 3
#: What a character without a piece costs beside the worst piece.
UNKNOWN = 10.0
#: Parts whose segmentations a task remembers; beyond it, it starts afresh with the next texts.
REMEMBERED = 300_000
MARK = "▁"
#: Bytes of texts that are cut up at once, parts that are searched at once, and the longest part that is searched with others.
CHUNK, GROUP, AT_ONCE = 1 << 18, 10_000, 48
#: Hashing of pieces: table size, base of the polynomial over characters, spread of places.
TABLE_BITS, BASE, SPREAD = 18, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
INF = float("inf")


class Pieces:
    """The pieces of a model, with spaces in place of the model's marks."""

    def __init__(self, model: str):
        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        ids = range(m.vocab_size())
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        # a piece of a single character besides the marks stands for text; marks in texts have no piece
        self.id = {m.id_to_piece(i).replace(MARK, " "): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.score = {piece: m.get_score(i) for piece, i in self.id.items()}
        self.prepare()

    def prepare(self) -> None:
        """A table of hashed pieces and beginnings of pieces, and where texts fall apart."""
        self.longest = max(map(len, self.id))
        self.unknown = min(s for s in self.score.values() if s > -1e8) - UNKNOWN
        bytes_ = {i: bytes([b]) for b, i in self.byte.items()} | {i: piece.encode() for piece, i in self.id.items()}
        self.bytes = [bytes_.get(i, b"") for i in range(max(bytes_) + 1)]
        #: Proper beginnings of pieces: a search goes on only behind these.
        self.begins = {piece[:k] for piece in self.id for k in range(1, len(piece))}
        pieces = list(self.id)
        number = {piece: i for i, piece in enumerate(pieces)}
        self.ids = np.array([self.id[x] for x in pieces], np.int32)
        self.scores = np.array([self.score[x] for x in pieces])
        size = 1 << TABLE_BITS
        self.used, self.hashed = np.zeros(size, bool), np.zeros(size, np.uint64)
        self.number, self.longer = np.full(size, -1, np.int32), np.zeros(size, bool)
        for piece in self.begins | set(pieces):
            h = 0
            for c in piece:
                h = (h * BASE + ord(c) + 1) % 2**64
            at = self._slot(h)
            while self.used[at]:
                at = (at + 1) % size
            self.used[at], self.hashed[at], self.number[at], self.longer[at] = True, h, number.get(piece, -1), piece in self.begins
        if any(" " in piece.lstrip(" ") for piece in self.id):
            raise ValueError("a piece has a space after another character")
        self.parts = re.compile(r" +[^ ]*|[^ ]+" if any("\n" in piece for piece in self.id) else r" +[^ \n]*|\n|[^ \n]+")

    @staticmethod
    def _slot(h):
        return (h * SPREAD % 2**64) >> (64 - TABLE_BITS) if isinstance(h, int) else ((h * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash in the table, -1 without one."""
        at = self._slot(h)
        right = self.hashed[at] == h
        out = np.where(right & self.used[at], at, -1)
        open_ = np.flatnonzero(~right & self.used[at])
        while len(open_):  # taken by another piece: the next place
            at[open_] = (at[open_] + 1) % len(self.hashed)
            there = at[open_]
            right = self.used[there] & (self.hashed[there] == h[open_])
            out[open_[right]] = there[right]
            open_ = open_[self.used[there] & ~right]
        return out

    def forward(self, part: str) -> tuple[array, array, array]:
        """For each place the best score up to it, where its last piece starts, and the best score with another last piece."""
        n, find, begins = len(part), self.score.get, self.begins
        ahead, runner, came = array("d", [-INF]) * (n + 1), array("d", [-INF]) * (n + 1), array("l", [0]) * (n + 1)
        ahead[0] = 0.0
        for start in range(n):
            base = ahead[start]
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = part[start:end]
                score = self.unknown if (known := find(piece)) is None and end == start + 1 else known
                if score is not None:
                    total = base + score
                    if total > ahead[end]:
                        ahead[end], runner[end], came[end] = total, ahead[end], start
                    elif total > runner[end]:
                        runner[end] = total
                if piece not in begins:
                    break
        return ahead, came, runner

    def _spelled(self, piece: str) -> tuple[int, ...]:
        return (self.id[piece],) if piece in self.id else tuple(self.byte[b] for b in piece.encode())

    def best(self, part: str) -> tuple[np.ndarray, float, float]:
        """(ids, score) of the best segmentation, and how much less the second best scores."""
        ahead, came, runner = self.forward(part)
        path, end, loss = [], len(part), INF
        while end:
            path.append((came[end], end))
            loss = min(loss, ahead[end] - runner[end])
            end = came[end]
        return np.array([i for start, end in reversed(path) for i in self._spelled(part[start:end])], np.int32), ahead[-1], loss

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations: (score, ids), the best first."""
        ahead, came, runner = self.forward(part)
        losses, end = [], len(part)
        while end:
            losses.append(ahead[end] - runner[end])
            end = came[end]
        least = heapq.nsmallest(n - 1, losses)
        most = (least[-1] if len(least) == n - 1 and least else 0.0 if n == 1 else INF) + 1e-6
        # (loss of the best way through, place, number, score from place on, pieces from place on)
        queue: list[tuple[float, int, int, float, tuple]] = [(0.0, len(part), 0, 0.0, ())]
        found: list[tuple[float, tuple[int, ...]]] = []
        number = 0
        while queue and len(found) < n:
            _, place, _, behind, rest = heapq.heappop(queue)
            if not place:
                ids: list[int] = []
                while rest:
                    ids += self._spelled(rest[0])
                    rest = rest[1]
                found.append((behind, tuple(ids)))
                continue
            for start in range(max(0, place - self.longest), place):
                piece = part[start:place]
                score = self.unknown if (known := self.score.get(piece)) is None and start == place - 1 else known
                if score is not None and (loss := ahead[-1] - (ahead[start] + score + behind)) <= most:
                    number += 1
                    heapq.heappush(queue, (loss, start, number, score + behind, (piece, rest)))
        return found

    def learn(self, parts: Iterable[str], memory: Memory) -> None:
        """Puts best(part) of all parts into memory: many are searched at once, the longest apart."""
        parts = sorted(parts, key=len, reverse=True)
        first = next((i for i, x in enumerate(parts) if len(x) <= AT_ONCE), len(parts))
        for part in parts[:first]:
            ids, score, loss = self.best(part)
            memory.add([part], ids, [len(ids)], [score], [loss])
        for start in range(first, len(parts), GROUP):
            self._learn(parts[start : start + GROUP], memory)

    def _learn(self, parts: list[str], memory: Memory) -> None:
        """The same as best(), place by place over all parts, which come with falling lengths."""
        size = np.array([len(x) for x in parts])
        rows, most = len(parts), int(size[0])
        text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        reach = [int(np.searchsorted(-size, -i, "right")) for i in range(most + 1)]  # rows with at least so many characters
        ahead, runner = np.full((most + 1, rows), -np.inf), np.full((most + 1, rows), -np.inf)
        ahead[0] = 0
        came, piece = np.zeros((most + 1, rows), np.int16), np.full((most + 1, rows), -1, np.int32)
        for start in range(most):
            row, h = np.arange(reach[start + 1]), np.zeros(reach[start + 1], np.uint64)
            for end in range(start + 1, min(most, start + self.longest) + 1):
                n = int(np.searchsorted(row, reach[end]))  # shorter parts drop out
                row = row[:n]
                if not n:
                    break
                h = h[:n] * np.uint64(BASE) + text[begin[row] + end - 1]
                slot = self.lookup(h)
                number = np.where(slot >= 0, self.number[slot], -1)
                on, taken = row, number
                if end > start + 1:
                    on, taken = row[number >= 0], number[number >= 0]
                if len(on):
                    total = ahead[start, on] + np.where(taken >= 0, self.scores[taken], self.unknown)
                    now = ahead[end, on]
                    better = total > now
                    runner[end, on] = np.where(better, now, np.maximum(runner[end, on], total))
                    won = on[better]
                    ahead[end, won], came[end, won], piece[end, won] = total[better], start, taken[better]
                longer = (slot >= 0) & self.longer[slot]
                row, h = row[longer], h[longer]
        loss, way = np.full(rows, np.inf), np.full((most + 1, rows), -2, np.int32)  # the pieces of the best way, by their starts
        at, row = size.copy(), np.arange(rows)
        while len(row):
            np.minimum.at(loss, row, ahead[at, row] - runner[at, row])
            before = came[at, row].astype(np.int64)
            way[before, row] = piece[at, row]
            more = before > 0
            at, row = before[more], row[more]
        row, at = np.nonzero(way.T > -2)
        found = way[at, row]
        ids, sizes = self.ids[found], np.bincount(row, minlength=rows)
        if spelled := set(row[found < 0].tolist()):  # characters without a piece
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for i in spelled:
                each[i] = self.best(parts[i])[0]
            ids, sizes = np.concatenate(each), [len(x) for x in each]
        memory.add(parts, ids, sizes, ahead[size, np.arange(rows)], loss)

    def encode(self, texts: list[str | None], n: int, memory: Memory) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text the n best segmentations: (score, ids), the best first."""
        at = 0
        while at < len(texts):
            cut, total = [], 0
            while at < len(texts) and (not cut or total < CHUNK):
                cut.append(self.parts.findall(f" {texts[at]}") if texts[at] else [])
                total += len(texts[at] or "")
                at += 1
            if len(memory.number) > REMEMBERED:
                memory.clear()
            self.learn(set().union(*cut).difference(memory.number), memory)
            for parts in cut:
                yield self._joined(parts, n, memory)

    def _joined(self, parts: list[str], n: int, memory: Memory) -> list[tuple[float, np.ndarray]]:
        if not parts:
            return [(0.0, np.zeros(0, np.int32))]
        number = np.fromiter(map(memory.number.__getitem__, parts), np.int64, len(parts))
        ids, ends = memory.joined(number)
        score = float(memory.score[number].sum())
        if n == 1:
            return [(score, ids)]
        # the n best of all differ from the best in few parts: those where an alternative costs least
        own, places = np.unique(number, return_index=True)
        losses = memory.loss[own]
        at = np.flatnonzero(losses <= np.partition(losses, min(n - 2, len(own) - 1))[min(n - 2, len(own) - 1)])
        ways: list[tuple[float, tuple]] = [(0.0, ())]  # (loss, what is changed where)
        for _, place in sorted((losses[i], places[i]) for i in at)[: n - 1]:
            others = memory.ways(parts[place], n, self)
            for where in np.flatnonzero(number == number[place])[: n - 1].tolist():
                ways = heapq.nsmallest(n, [(loss + others[0][0] - s, (*changed, (where, k)) if k else changed) for loss, changed in ways for k, (s, _) in enumerate(others)])
        out = [(score, ids)]
        for loss, changed in ways[1:]:
            pieces, done = [], 0
            for where, k in sorted(changed):
                pieces += [ids[done : ends[where]], np.array(memory.ways(parts[where], n, self)[k][1], np.int32)]
                done = ends[where + 1]
            out.append((score - loss, np.concatenate([*pieces, ids[done:]])))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


class Memory:
    """Best segmentations of parts in flat arrays, and the n best of those that were asked for."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self._ways: dict[tuple[str, int], list] = {}

    def add(self, parts: list[str], ids: np.ndarray, sizes, scores, losses) -> None:
        """New parts with their ids one after another."""
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.score, self.loss = np.append(self.score, scores), np.append(self.loss, losses)

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts one after another, and where each part's begin, with the end of all."""
        start, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends

    def ways(self, part: str, n: int, pieces: Pieces) -> list[tuple[float, tuple[int, ...]]]:
        if (part, n) not in self._ways:
            if len(self._ways) >= REMEMBERED // 30:
                self._ways.clear()
            at = self.number[part]
            first = tuple(self.ids[self.ends[at] : self.ends[at + 1]].tolist())
            # of equally good ones the search may meet another first
            others = [way for way in pieces.n_best(part, n) if way[1] != first]
            self._ways[part, n] = [(float(self.score[at]), first), *others[: n - 1]]
        return self._ways[part, n]


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK bytes of text, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(total // CHUNK, prepend=0)) if len(total) else []
    bounds = sorted({0, *(int(c) + 1 for c in cuts), len(total)})
    return zip(bounds, bounds[1:], strict=False)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind)))


def _each(docs: DataFrame, keep: list[str], model: str, n: int, fields: T.StructType, made: Callable) -> DataFrame:
    """The columns keep of docs and what made(pieces, texts, their segmentations) gives; a slice of texts at a time is held as strings."""
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, memory = Pieces(model), Memory()
        for batch in batches:
            for lo, hi in _slices(batch.column(len(keep))):
                part = batch.slice(lo, hi - lo)
                texts = part.column(len(keep)).to_pylist()
                columns = made(pieces, texts, pieces.encode(texts, n, memory))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=[*keep, *fields.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], *fields]))


def segmented(docs: DataFrame, keep: list[str], model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The columns keep of docs with segmentations: array of the n best (score, ids) of the whole text, the best first."""
    kind = T.ArrayType(T.StructType().add("score", T.DoubleType()).add("ids", T.ArrayType(T.IntegerType())))

    def made(pieces: Pieces, texts: list, found: Iterator) -> list[pa.Array]:
        all_ = list(found)
        flat = [way for ways in all_ for way in ways]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in all_])]).astype(np.int32)
        both = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), _lists([i for _, i in flat], np.int32)], ["score", "ids"])
        return [pa.ListArray.from_arrays(pa.array(ends), both)]

    return _each(docs, keep, model, n, T.StructType().add("segmentations", kind), made)


def encode_rows(docs: DataFrame, keep: list[str], model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The columns keep of docs with ids of the best segmentation and scores of the n best."""
    fields = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("scores", T.ArrayType(T.DoubleType()))

    def made(pieces: Pieces, texts: list, found: Iterator) -> list[pa.Array]:
        ids, scores = [], []
        for ways in found:
            ids.append(ways[0][1])
            scores.append(np.array([s for s, _ in ways]))
        return [_lists(ids, np.int32), _lists(scores, np.float64)]

    return _each(docs, keep, model, n, fields, made)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of piece ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model)
        for batch in batches:
            yield pd.Series([pieces.decode(x) if x is not None and len(x) else "" for x in batch], dtype=object)

    return decode(ids)


def digests(docs: DataFrame, keep: list[str], model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """The columns keep of docs with ways: of each segmentation in segmented() its score, number of pieces, digest, and whether it decodes to the text."""
    way = T.StructType().add("score", T.DoubleType()).add("n_pieces", T.LongType()).add("ids_sha256", T.StringType()).add("restored", T.BooleanType())

    def made(pieces: Pieces, texts: list, found: Iterator) -> list[pa.Array]:
        rows = [
            [{"score": s, "n_pieces": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), "restored": pieces.decode(ids.tolist()) == (text or "")} for s, ids in ways]
            for text, ways in zip(texts, found, strict=True)
        ]
        kind = pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("restored", pa.bool_())])
        return [pa.array(rows, pa.list_(kind))]

    return _each(docs, keep, model, n, T.StructType().add("ways", T.ArrayType(way)), made)


def query(spark, sf_dir: str) -> DataFrame:
    rows = digests(table(spark, sf_dir, "documents"), ["doc_id"])
    ways = [F.get("ways", k) for k in range(N_BEST)]
    named = [("best", ways[0]), ("second", ways[1]), ("third", ways[2])]
    return rows.select(
        "doc_id",
        F.size("ways").cast("long").alias("n_ways"),
        ways[0]["n_pieces"].alias("n_pieces"),
        *(w["score"].alias(f"{name}_score") for name, w in named),
        *(w["ids_sha256"].alias(f"{name}_sha256") for name, w in named),
        F.forall("ways", lambda w: w["restored"]).alias("restored"),
    )
