"""Benchmark passages in documents, exact or lightly edited, by q-gram filtering on diagonals and banded alignment.

Texts are compared in lower case with every run of other characters than letters and digits as one space. An occurrence
of an item of m characters with at most e edits shares at least m - q + 1 - q * e of its q-grams with the document, on
diagonals (place in the document less place in the item) at most e apart. Diagonals are therefore counted in bands of
2(e + 1), once from 0 and once shifted by half a band, so that one band holds all of an occurrence; only regions whose
count reaches the bound are aligned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, documents_of, map_chunks, mix

Q, EDITS = 10, 0.08
#: Bytes of documents searched at once: every character takes some dozens of bytes while it is.
CHUNK = 1 << 20
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 4 << 20
_OTHER = re.compile(r"[\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)
HITS = "doc_id long, item_id long, edits long, start long, length long, item_chars long"


def normalized(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    run, m, out, held = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if q & m:
            if out is None:
                out = run
            else:
                n = min(len(run) - held, len(out))
                out = run[held : held + n] + out[:n] * np.uint64(pow(int(_B), m, 1 << 64))
            held += m
        if 2 * m > q:
            return mix(out[: len(codes) - q + 1])
        run = run[m:] + run[:-m] * np.uint64(pow(int(_B), m, 1 << 64))
        m *= 2


def aligned(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item in the region, if it has at most so many edits; a banded alignment.

    Cell (i, d) is the item's first i characters against the region up to place i + d; the region's ends are free. Of equal
    places the first end is taken, and the later start.
    """
    m, width = len(item), len(region) - len(item) + 2 * edits + 1
    if width <= 0:
        return None
    big = m + len(region) + 1
    shift = np.arange(width)
    padded = np.full(m + width + edits, 0xFFFFFFFF, np.uint32)
    padded[edits : edits + len(region)] = region  # place p of the region at p + edits; d from -edits on
    cost = np.where(shift < edits, big, 0)
    start = shift - edits
    for i in range(m):
        diagonal = cost + (padded[i : i + width] != item[i])
        above = np.full(width, big)
        above[:-1] = cost[1:] + 1
        from_ = start.copy()
        better = above < diagonal
        from_[:-1] = np.where(better[:-1], start[1:], from_[:-1])
        best = np.minimum(diagonal, above)
        # gaps in the item: from the left within the row
        key = (best - shift) * (4 * big) + (2 * big - from_)
        run = np.minimum.accumulate(key)
        low = run // (4 * big)
        cost, start = low + shift, 2 * big - (run - low * (4 * big))
    ends = m + shift - edits
    cost = np.where((ends < 0) | (ends > len(region)), big, cost)
    at = int(cost.argmin())
    return (int(cost[at]), int(start[at]), int(ends[at])) if cost[at] <= edits else None


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids, self.texts = q, [], []
        #: Items too short for a q-gram, by their words.
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in items:
            t = normalized(text)
            if 0 < len(t) < q:
                self.short.setdefault(tuple(t.split(" ")), []).append(item_id)
            if len(t) >= q:
                self.ids.append(item_id)
                self.texts.append(_codes(t))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        # no more edits than leave one shared q-gram sure
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.bound = self.size - q + 1 - q * self.edits
        grams = [_grams(t, q) for t in self.texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.last = np.r_[self.first[1:], len(every)] if len(self.keys) else self.first
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search_short(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """As search, for items too short for a q-gram: whole words, exactly."""
        out = []
        for n in {len(k) for k in self.short}:
            for d, text in enumerate(texts):
                words, at, seen = text.split(" "), 0, set()
                for i in range(len(words) - n + 1):
                    found = tuple(words[i : i + n])
                    if found in self.short and found not in seen:
                        seen.add(found)
                        m = len(" ".join(found))
                        out += [(d, item_id, 0, at, m, m) for item_id in self.short[found]]
                    at += len(words[i]) + 1
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item_id, edits, start, length, item_chars) of the best occurrence of each item in each text."""
        return self.search_short(texts) + self.search_long(texts)

    def search_long(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        if not len(self.keys):
            return []
        codes = [_codes(t) for t in texts]
        starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
        gap = np.array([10], np.uint32)  # a line break, which normalized texts never hold
        joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
        h = _grams(joined, self.q)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return []
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        real = self.keys[at] == h[maybe]
        maybe, at = maybe[real], at[real]
        found = set()
        # the postings of all hits, in slices of bounded size
        sizes = self.last[at] - self.first[at]
        ends = np.cumsum(sizes)
        counts: dict = {}
        step = 1 << 22
        low = 0
        while low < len(maybe):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, "right")))
            n = sizes[low:high]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.first[at[low:high]], n) + inner
            item = self.item[entry]
            diagonal = np.repeat(maybe[low:high], n) - self.place[entry]
            half = self.edits[item] + 1
            for shifted in (0, 1):
                band = (diagonal + shifted * half) // (2 * half)
                key = (item << 40) | ((band + 1) << 1) | shifted
                keys, c = np.unique(key, return_counts=True)
                # a band may go on in the next slice: low counts are carried there
                if low == 0 and high >= len(maybe):
                    found.update(keys[c >= self.bound[keys >> 40]].tolist())
                else:
                    for k, x in zip(keys.tolist(), c.tolist(), strict=True):
                        counts[k] = counts.get(k, 0) + x
            low = high
        found.update(k for k, x in counts.items() if x >= self.bound[k >> 40])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in sorted(found):
            item, band, shifted = k >> 40, ((k >> 1) & ((1 << 39) - 1)) - 1, k & 1
            e, m = int(self.edits[item]), int(self.size[item])
            d0 = band * 2 * (e + 1) - shifted * (e + 1)
            low, high = max(d0 - e, 0), min(d0 + 2 * (e + 1) + m + 2 * e, len(joined))
            for doc in range(int(np.searchsorted(starts, low, "right")) - 1, len(codes)):
                a, b = max(low, int(starts[doc])), min(high, int(starts[doc]) + len(codes[doc]))
                if int(starts[doc]) >= high:
                    break
                if b - a < m - e:
                    continue
                hit = aligned(self.texts[item], joined[a:b], e)
                if hit:
                    place = (hit[0], a + hit[1] - int(starts[doc]), hit[2] - hit[1])
                    if (doc, item) not in best or place < best[doc, item]:
                        best[doc, item] = place
        return [(d, self.ids[i], *x, int(self.size[i])) for (d, i), x in best.items()]


def _search(items: list[tuple[int, str]], q: int, rate: float):
    held: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Index(items, q, rate))
        ids = batch.column("doc_id").to_pylist()
        hits = held[0].search([normalized(t) for t in batch.column("text").to_pylist()])
        cols = list(zip(*((ids[d], *x) for d, *x in hits), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "start", "length", "item_chars"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edits, start, length, item_chars): the best occurrence of each item in each document.

    An item occurs where its normalized text aligns with at most rate * item_chars edits (fewer for items so short that no
    shared q-gram would be sure). start and length are in the normalized document. Items of fewer than q normalized
    characters occur where their words stand exactly; items without letters or digits nowhere. Null texts hold nothing; null ids are passed on; rows that repeat an
    id are searched one by one; empty tables give no rows; other columns are ignored. Texts are searched whole. Ties go to
    the earliest place.
    """
    docs = documents_of(docs, id_col, text_col)
    items = Scratch(docs.sparkSession).keep_compact(benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for i in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()]
        part = map_chunks(docs, _search(block, q, rate), HITS, limit=CHUNK)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark item occurs. Rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    leaks = scratch.keep(find_leaks(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(scratch.maybe_broadcast(leaks), "doc_id", "left_anti").select(*docs.columns)
