"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document. It has one anchor, the leftmost
of its least (by hash) ``PHRASE``-word phrases, and consecutive windows with the same anchor
make one stretch: every window lies in exactly one, and equal windows have equal anchors.

1. Anchors found twice or more are recurring (one pass, hashes only).
2. Every document's stretches of recurring anchors go, with their words and their place, to
   the shard of the anchor. A task sends equal stretches once, and again only for a smaller
   place; where it holds a smaller place of the same stretch itself, all windows at the later
   one are repeats. So the copies of one text are no more rows than tasks.
3. A shard confirms its passages, the windows found in two places, compiles them to
   Aho-Corasick automata over words (``PATTERNS`` at most each, all windows of an anchor in
   one), and streams every stretch past the automaton of its anchor. The matches are the
   occurrences: the least place of a passage is its first, all others are marked.
4. A last pass over the texts looks up the marks of its own places and removes their words.

Marks are sorted hash arrays dealt by document, which workers map; no whole text is shuffled,
and shards follow the size of the texts. Places are compared on the input, never on what is left.

Ids are integers. Edge cases: a null or empty text has no words and keeps the empty text;
texts shorter than a window lose nothing; rows that repeat an id count as one document, so
a word place of one never erases the same place of another; rows with a null id are taken
as the last document; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import HashArrays, pack, packed_schema, ranges, reduced, run_starts, units, unpack
from .common import shards_for
from .wordhash import grams, mix, spans, utf8_parts, words

WINDOW, PHRASE, PATTERNS = 20, 8, 20_000
BLOCK_BYTES, SHARD_BYTES = 1 << 21, 12 << 20
LAST = np.iinfo(np.int64).max
U64 = np.uint64


class Block:
    """Words and stretches of consecutive rows (id, text) of one batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, window: int):
        self.data, self.window = data, window
        self.word, self.start, self.end, self.ptr = words(data, offsets)
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.ptr))  # of each word
        k = min(PHRASE, window)
        phrase, phrase_word, phrase_ptr = grams(self.word, self.ptr, k)
        at, low, high = units(phrase, phrase_ptr, window - k + 1)
        self.anchor, self.low, self.high = phrase[at], phrase_word[low], phrase_word[high]  # windows start at words low to high
        row = self.row[self.low]
        self.doc, self.pos = ids[row], self.low - self.ptr[row]

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("anchor", "low", "high", "doc", "pos"):
            setattr(self, name, getattr(self, name)[chosen])

    def keys(self) -> np.ndarray:
        """Hash of the words of each stretch: its first and last window overlap, so they hold all of them."""
        out = (self.high - self.low).astype(U64)
        for start in (self.low, self.high):
            for i in range(self.window):
                out = out * U64(0x9E3779B97F4A7C15) + self.word[start + i]
        return mix(out ^ self.anchor)


def blocks(batch: pa.RecordBatch, window: int) -> Iterator[tuple[Block, int, int, np.ndarray, np.ndarray]]:
    """Blocks of a batch (id, text): (block, first row, end row, bytes, offsets)."""
    ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(LAST))
    data, offsets = utf8_parts(batch.column(1))
    for a, b in spans(offsets, BLOCK_BYTES):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield Block(part, at, ids[a:b], window), a, b, part, at


def _recurring(texts: DataFrame, window: int, n_shards: int) -> HashArrays:
    anchors = HashArrays.named(texts, "phrases", {}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *_ in blocks(batch, window):
                key, count = np.unique(block.anchor, return_counts=True)
                yield pack(key, [np.minimum(count, 2).astype(np.uint8)], n_shards)

    def merge(rows: pa.Table):
        key, count = unpack(rows, [U64, np.uint8])
        order = np.argsort(key, kind="stable")
        start = run_starts(key[order])
        return key[order][start][reduced(np.add, count[order].astype(np.int64), start) > 1], {}

    anchors.fill(texts.mapInArrow(send, packed_schema(2)), merge)
    return anchors


class Least:
    """The least place of each stretch that a task has met."""

    def __init__(self):
        self.key, self.doc, self.pos = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of one row for each stretch whose least place is new, whether each row's place is not the least)."""
        before = len(self.key)
        every = [np.concatenate(x) for x in ((self.key, key), (self.doc, doc), (self.pos, pos))]
        order = np.lexsort((*every[:0:-1], every[0]))  # equal places keep their order: a known one comes first
        one = order[run_starts(every[0][order])]
        self.key, self.doc, self.pos = (x[one] for x in every)
        at = np.searchsorted(self.key, key)
        return one[one >= before] - before, (self.doc[at] != doc) | (self.pos[at] != pos)


def _pack(shard: np.ndarray, cols: list[np.ndarray], n_shards: int) -> list[list[bytes]]:
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    return [[c[order[cut[s] : cut[s + 1]]].tobytes() for s in range(n_shards)] for c in cols]


STRETCH = [U64, U64, np.int64, np.int32, np.uint8, np.uint32, np.uint8]  # key, anchor, document, word place, windows, bytes, text
MARK = [U64, np.int64, np.int32, np.uint8]  # key, document, word place, windows: all of them repeats


def _stretches(texts: DataFrame, anchors: HashArrays, window: int, n_shards: int) -> DataFrame:
    """Stretches by shard of their anchor, and marks that need no automaton by shard of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = Least()
        for batch in batches:
            for block, *_ in blocks(batch, window):
                block.keep(anchors.lookup(block.anchor)[0])
                key, n = block.keys(), (block.high - block.low + 1).astype(np.uint8)
                one, later = least.meet(key, block.doc, block.pos)
                first, last = block.start[block.low[one]], block.end[block.high[one] + window - 1]
                shard = (block.anchor[one] % U64(n_shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                one, first, size, shard = one[order], first[order], (last - first)[order], shard[order]
                cols = _pack(shard, [key[one], block.anchor[one], block.doc[one], block.pos[one].astype(np.int32), n[one], size.astype(np.uint32)], n_shards)
                cut = np.searchsorted(shard, np.arange(n_shards + 1))
                cols.append([block.data[ranges(first[a:b], size[a:b])].tobytes() for a, b in zip(cut, cut[1:])])
                cols += _pack((_deal(block.doc[later]) % U64(n_shards)).astype(np.int64), [key[later], block.doc[later], block.pos[later].astype(np.int32), n[later]], n_shards)
                used = [s for s in range(n_shards) if cols[0][s] or cols[-1][s]]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array([c[s] for s in used], pa.binary()) for c in cols], names=names)

    names = ["shard", *[f"b{i}" for i in range(len(STRETCH) + len(MARK))]]
    return texts.mapInArrow(run, packed_schema(len(names) - 1))


def occurrences(number: np.ndarray, ptr: np.ndarray, passage: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start words, passages) of every occurrence of passages in streams of word numbers (from 1 on), by one automaton.

    ``passage`` are the start words of one example of each.
    """
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for i, pattern in enumerate(number[passage[:, None] + np.arange(window)].tolist()):
        machine.add_word(tuple(pattern), i)
    machine.make_automaton()
    gap = np.zeros(len(number) + len(ptr) - 1, np.int64)  # a 0 after each stream, so no match crosses
    place = np.arange(len(number)) + np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    gap[place] = number
    found = np.array(list(machine.iter(tuple(gap.tolist()))), np.int64).reshape(-1, 2)
    back = np.zeros(len(gap), np.int64)
    back[place] = np.arange(len(number))
    return back[found[:, 0]] - (window - 1), found[:, 1]


def _located(window: int, patterns: int):
    """Marks (key, doc, pos, bits) of the stretches of a shard, by its automata."""

    def run(rows: pa.Table) -> pa.Table:
        *cols, text = unpack(rows.select([f"b{i}" for i in range(len(STRETCH))]), STRETCH)
        done = [np.concatenate([np.frombuffer(x, t) for x in rows.column(f"b{len(STRETCH) + i}").to_pylist()]) for i, t in enumerate(MARK)]
        out = [done[:3] + [(np.int64(1) << done[3].astype(np.int64)) - 1]]
        key, anchor, doc, pos, _, size = cols
        size, low = size.astype(np.int64), np.cumsum(size.astype(np.int64)) - size
        order = np.lexsort((pos, doc, key, anchor))  # one stream for equal stretches; their places follow, least first
        lead = order[run_starts(key[order], anchor[order])]
        places = np.append(run_starts(key[order], anchor[order]), len(order))
        data, at = text[ranges(low[lead], size[lead])], np.concatenate([[0], np.cumsum(size[lead])])
        word, _, _, ptr = words(data, at)
        if len(word):
            _, number = np.unique(word, return_inverse=True)
            number = number + 1
            same, start, wptr = grams(word, ptr, window)
            stream = np.repeat(np.arange(len(lead)), np.diff(wptr))
            # passages: windows with two places or more, whatever stretches they are in
            sort = np.argsort(same, kind="stable")
            begin = run_starts(same[sort])
            many = reduced(np.add, np.diff(places)[stream[sort]], begin) > 1
            passage = sort[begin[many]]
            passage = passage[np.argsort(stream[passage], kind="stable")]
            # automata of whole anchors
            anchor_of = np.cumsum(np.bincount(run_starts(anchor[lead]), minlength=len(lead)))[: len(lead)] - 1
            per_anchor = np.bincount(anchor_of[stream[passage]], minlength=anchor_of[-1] + 1)
            machine_of = (np.cumsum(per_anchor) - per_anchor) // patterns
            for m in np.unique(machine_of[anchor_of[stream[passage]]]):
                streams = np.flatnonzero(machine_of[anchor_of] == m)
                a, b = ptr[streams[0]], ptr[streams[-1] + 1]
                mine = start[passage[machine_of[anchor_of[stream[passage]]] == m]]
                found, which = occurrences(number[a:b], ptr[streams[0] : streams[-1] + 2] - a, mine - a, window)
                of = np.searchsorted(ptr, found + a, "right") - 1
                out.append(_marks(of, found + a - ptr[of], which, places, order, key, doc, pos))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"key": cols[0].view(np.int64), "doc": cols[1], "pos": cols[2].astype(np.int32), "bits": cols[3].astype(np.int64)})

    return run


def _marks(stream, shift, passage, places, order, key, doc, pos) -> list[np.ndarray]:
    """(key, doc, pos, bits) of the places at which occurrences, stream by stream, are not the first of their passage."""
    least = order[places[stream]]
    first_doc, first_pos = doc[least], pos[least] + shift
    by = np.lexsort((first_pos, first_doc, passage))
    begin = run_starts(passage[by])
    top = np.zeros(int(passage.max(initial=-1)) + 1, np.int64)
    top[passage[by[begin]]] = by[begin]
    first_doc, first_pos = first_doc[top[passage]], first_pos[top[passage]]
    count = places[stream + 1] - places[stream]
    each, place = np.repeat(np.arange(len(stream)), count), order[ranges(places[stream], count)]
    later = (first_doc[each] < doc[place]) | ((first_doc[each] == doc[place]) & (first_pos[each] < pos[place] + shift[each]))
    each, place = each[later], place[later]
    by = np.argsort(place, kind="stable")
    begin = run_starts(place[by])
    bits = reduced(np.add, np.int64(1) << shift[each[by]], begin)
    place = place[by[begin]]
    return [key[place], doc[place], pos[place], bits]


def _deal(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view(U64) if doc.flags.c_contiguous else np.ascontiguousarray(doc).view(U64))


def _mark_key(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(_deal(doc) + pos.astype(U64)))


def marks(texts: DataFrame, anchors: HashArrays, window: int, n_shards: int, patterns: int = PATTERNS) -> HashArrays:
    """For each stretch at a place (document, first word): bits of its windows that start earlier elsewhere."""
    stretches = _stretches(texts, anchors, window, n_shards)
    found = stretches.groupBy("shard").applyInArrow(_located(window, patterns), "key long, doc long, pos int, bits long")
    out = HashArrays.named(texts, "marks", {"bits": "uint16" if window - PHRASE < 16 else "uint64"}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, pos, bits = (np.asarray(batch.column(i)) for i in range(4))
            yield pack(_mark_key(key.view(U64), doc, pos), [bits], n_shards, (_deal(doc) % U64(n_shards)).astype(np.int64))

    def merge(rows: pa.Table):
        key, bits = unpack(rows, [U64, np.int64])
        order = np.argsort(key, kind="stable")
        start = run_starts(key[order])
        return key[order][start], {"bits": reduced(np.bitwise_or, bits[order], start)}

    out.fill(found.mapInArrow(send, packed_schema(2)), merge)
    return out


def covered(block: Block, anchors: HashArrays, found: HashArrays) -> np.ndarray:
    """Whether each word of the block lies in a marked window."""
    block.keep(anchors.lookup(block.anchor)[0])
    hit, got = found.lookup(_mark_key(block.keys(), block.doc, block.pos), _deal(block.doc))
    low, bits = block.low[hit], got["bits"][hit].astype(U64)
    begins = np.zeros(len(block.word), np.int64)
    for t in range(int((block.high - block.low).max(initial=-1)) + 1):
        begins[low[(bits >> U64(t)) & U64(1) > 0] + t] = 1
    total = np.concatenate([np.zeros(block.window, np.int64), np.cumsum(begins)])
    return total[block.window :] > total[: -block.window]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out_col: str = "kept_text", digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept text or its SHA-256) of every row; kept words are joined by one space."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_shards = shards_for(texts, "text", SHARD_BYTES)
    anchors = _recurring(texts, window, n_shards)
    found = marks(texts, anchors, window, n_shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, data, at in blocks(batch, window):
                gone = covered(block, anchors, found)
                raw, texts_ = data.tobytes(), []
                for i in range(b - a):
                    mask = gone[block.ptr[i] : block.ptr[i + 1]]
                    each = raw[at[i] : at[i + 1]].split()  # bytes.split() parts at the same six bytes
                    kept = b" ".join(compress(each, (~mask).tolist()) if mask.any() else each)
                    texts_.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
                n = np.diff(block.ptr)
                removed = np.bincount(block.row, weights=gone, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed), pa.array(texts_, pa.string())], names=["id", "n_words", "n_removed", "out"])

    out = texts.mapInArrow(run, "id long, n_words long, n_removed long, out string")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", F.col("out").alias(out_col))
