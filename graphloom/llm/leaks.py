"""Test items that stand in a corpus: MinHash containment search over windows of the texts, verified by exact shingles in order."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.components import connected_components
from graphloom.shared import cut, drop

#: Letters of a shingle; blanks, signs and line breaks are taken out of the texts before.
SHINGLE = 12
#: Hash functions, and how many minima a window must share with an item to be looked at.
HASHES, AGREE = 16, 2
#: A shingle that stands in so many different items is a line of instruction or a stock phrase: it finds nothing.
COMMON_ITEMS = 4
#: Copies of an item count as one there: texts that agree in half of BANDS x ROWS MinHashes, looked at if they agree in all of a band.
BANDS, ROWS = 32, 4
#: Share of an item that a passage must span: a third, less the letters at its ends that may be altered.
LEAST = 0.3
#: Letters that may be altered between two pieces of a passage; letters of other text that may interrupt it once.
LOOSE, BREAK = 120, 1500
#: Share of the rare shingles of a passage that must stand unaltered.
DENSE = 0.55
#: Bytes of items searched for in one pass over the corpus. More are searched in several passes.
PASS_BYTES = 8_000_000
#: Letters normalised at a time.
BLOCK = 400_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGNS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_MORE_SIGNS = re.compile("[\u0080-\u00bf\u02b0-\u036f\u2000-\u206f\u20d0-\u20ff\u3000-\u303f\ufe00-\ufe0f\ufeff-\ufeff]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_COPY_MULTIPLIERS = (np.random.default_rng(13).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MULTIPLIERS = (np.random.default_rng(12).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def letters(text: str | None) -> bytes:
    """Letters and digits of a text, lower case and without accents, as UTF-8."""
    if not text:
        return b""
    if not text.isascii():
        text = _MORE_SIGNS.sub("", unicodedata.normalize("NFKD", text.replace("ß", "ss")).lower())
    return text.encode().translate(_TABLE, _SIGNS)


def shingles(data: bytes) -> np.ndarray:
    """The 64-bit hash of the shingle at each place."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < SHINGLE:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view("<u8").ravel()
    h = x[: len(b) - SHINGLE + 1] * _M1 ^ x[SHINGLE - 8 :] * _M2
    h ^= h >> np.uint64(29)
    return h * _M3


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    table = np.zeros(1 << width, bool)
    table[values >> np.uint64(64 - width)] = True
    return table


class Items:
    """The items of one pass, ready to be searched for. Kept by size class: the window of a class is at most a third of its items."""

    WIDTH = 22

    def __init__(self, ids: list, texts: list[str], common: np.ndarray | None = None):
        """common: sorted shingles that find nothing, from all passes; if None, they are counted over these texts."""
        self.ids, self.words = ids, [max(1, len(t.split())) for t in texts]
        self.data = [letters(t) for t in texts]
        self.grams = [shingles(d) for d in self.data]
        if common is None:
            each = [np.unique(g) for g in self.grams]
            all_grams, n = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
            common = all_grams[n >= COMMON_ITEMS]
        self.common = common
        self.common_bits = _bits(self.common, self.WIDTH)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, d in enumerate(self.data):
            if len(d) >= SHINGLE:
                by.setdefault(self.window(len(d)), []).append(i)
        for w, own in sorted(by.items()):
            keys, item = [], []
            for i in own:
                g = self.masked(self.grams[i])
                for k, m in enumerate(_MULTIPLIERS):
                    low = np.unique(self._minima(g * m, w))
                    low = low[low > 0]
                    keys.append(self.key(low, k))
                    item.append(np.full(len(low), i, np.int32))
            keys, item = np.concatenate(keys), np.concatenate(item)
            o = np.argsort(keys, kind="stable")
            self.classes[w] = keys[o], item[o], _bits(keys, self.WIDTH)
        self.order = [np.argsort(g, kind="stable") for g in self.grams]
        self.rare = [self.masked(g) != 0 for g in self.grams]
        self.needed = np.array([self._needed(r, len(d)) for r, d in zip(self.rare, self.data)])
        grams = np.concatenate([*[g[r] for g, r in zip(self.grams, self.rare)], np.zeros(0, np.uint64)])
        o = np.argsort(grams, kind="stable")
        self.rare_grams, self.rare_bits = grams[o], _bits(grams, self.WIDTH)
        self.rare_item = np.repeat(np.arange(len(ids)), [r.sum() for r in self.rare])[o]
        self.rare_place = np.concatenate([*[np.flatnonzero(r) for r in self.rare], np.zeros(0, np.int64)])[o]

    @staticmethod
    def _needed(rare: np.ndarray, size: int) -> float:
        """Fewest rare shingles that a document must share with an item to hold a passage of it."""
        w = max(1, int(LEAST * size) - SHINGLE)
        upto = np.concatenate([[0], np.cumsum(rare)])
        return DENSE * float((upto[w:] - upto[:-w]).min()) if len(upto) > w else 0.0

    @staticmethod
    def window(size: int) -> int:
        w = 16
        while w * 2 * 3 <= size and w < 1024:
            w *= 2
        return w

    @staticmethod
    def key(low: np.ndarray, k: int) -> np.ndarray:
        return (low ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _M3

    @staticmethod
    def _minima(h: np.ndarray, w: int) -> np.ndarray:
        """The MinHash of every window of w places (a power of two), by doubling; of the whole where it is shorter.

        Hashes are ordered from the highest down, so that 0, which stands for a common shingle, is never chosen.
        """
        n = 1
        while n < w and len(h) > n:
            h, n = np.maximum(h[:-n], h[n:]), n * 2
        return h

    def masked(self, g: np.ndarray) -> np.ndarray:
        """g with 0 for common shingles."""
        if not len(self.common):
            return g
        maybe = np.flatnonzero(self.common_bits[g >> np.uint64(64 - self.WIDTH)])
        at = np.minimum(np.searchsorted(self.common, g[maybe]), len(self.common) - 1)
        g = g.copy()
        g[maybe[self.common[at] == g[maybe]]] = 0
        return g

    def search(self, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The pairs (doc * items + item, sorted) of documents and items of which windows share AGREE minima.

        g: the shingles of many documents one after the other, common ones 0; doc: whose each is.
        """
        found = []
        if not len(g) or not self.classes:
            return np.zeros(0, np.int64)
        least = min(self.classes, default=16) // 2
        pad = -len(g) % least
        if pad:
            g = np.concatenate([g, np.zeros(pad, np.uint64)])
        blocks = np.empty((HASHES, len(g) // least), np.uint64)
        for k, m in enumerate(_MULTIPLIERS):
            blocks[k] = (g * m).reshape(-1, least).max(1)
        owner = doc[np.arange(blocks.shape[1]) * least]
        for w, (keys, item, bits) in self.classes.items():
            low, n = blocks, least
            while n < w // 2:  # blocks of half a window
                m = low.shape[1] // 2 * 2
                low = np.concatenate([np.maximum(low[:, 0:m:2], low[:, 1:m:2]), low[:, m:]], 1)
                n *= 2
            own = owner[:: n // least][: low.shape[1]]
            if low.shape[1] > 1:
                low = np.concatenate([np.maximum(low[:, :-1], low[:, 1:]), low[:, -1:]], 1)
            for_key = np.stack([self.key(low[k], k) for k in range(HASHES)])
            hit = bits[for_key >> np.uint64(64 - self.WIDTH)] & (low > 0)
            win = np.nonzero(hit)[1]
            value = for_key[hit]
            lo, hi = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
            size = hi - lo
            at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pair, count = np.unique(np.repeat(win, size).astype(np.int64) * len(self.ids) + item[at], return_counts=True)
            pair = pair[count >= AGREE]
            win, it = pair // len(self.ids), pair % len(self.ids)
            found.append(own[win] * len(self.ids) + it)
            found.append(own[np.minimum(win + 1, len(own) - 1)] * len(self.ids) + it)  # a window may reach into the next document
        return np.unique(np.concatenate(found))

    def likely(self, pairs: np.ndarray, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Those of the pairs of search() that share enough different rare shingles to hold a passage."""
        n, width = len(self.ids), max(map(len, self.grams)) + 1
        at = np.flatnonzero(self.rare_bits[g >> np.uint64(64 - self.WIDTH)])
        lo, hi = np.searchsorted(self.rare_grams, g[at], "left"), np.searchsorted(self.rare_grams, g[at], "right")
        size = hi - lo
        places = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pair = np.repeat(doc[at], size) * n + self.rare_item[places]
        near = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        mine = pairs[near] == pair
        shared = np.unique(near[mine] * width + self.rare_place[places[mine]]) // width
        count = np.bincount(shared, minlength=len(pairs))
        return pairs[count >= self.needed[pairs % n]]

    def share(self, g: np.ndarray, i: int) -> float:
        """Share of item i that stands in order in a document of shingles g: see best_passage()."""
        order, mine = self.order[i], self.grams[i]
        sorted_ = mine[order]
        lo, hi = np.searchsorted(sorted_, g, "left"), np.searchsorted(sorted_, g, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return 0.0
        size = (hi - lo)[at]
        places = np.repeat(lo[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return best_passage(np.repeat(at, size), order[places], self.rare[i], len(self.data[i]))


def best_passage(d: np.ndarray, i: np.ndarray, rare: np.ndarray, size: int) -> float:
    """The longest passage of an item of `size` letters that a document holds, as a share of the item.

    (d, i): places in document and item where shingles agree; rare: for each place of the item, whether its shingle is
    not a common one. Shingles that agree one after the other make a piece, which counts if three of them are rare. A
    passage is a chain of pieces in order with at most LOOSE letters between them on both sides, but for one
    interruption of up to BREAK letters in the document. It holds if its pieces contain at least DENSE of the rare
    shingles between its ends, so sentences that share no more than their build make none. All pieces take part, however many.
    """
    o = np.lexsort((d, d - i))
    d, i = d[o], i[o]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(d) > 1)]))
    weight = np.add.reduceat(rare[i].astype(np.int64), head)
    long = np.diff(np.append(head, len(d)))
    some = weight >= 3
    d0, i0, n, weight = d[head][some], i[head][some], long[some] + SHINGLE - 1, weight[some]
    o = np.argsort(d0, kind="stable")
    d0, i0, n, weight = d0[o].tolist(), i0[o].tolist(), n[o].tolist(), weight[o].tolist()
    before_i = np.concatenate([[0], np.cumsum(rare)]).tolist()
    near = LOOSE + SHINGLE
    best = 0.0
    ended: dict[int, list[int]] = {}  # pieces by where they end in the item: a next one looks at two entries only
    state: list[tuple[list[tuple[int, int]], list[tuple[int, int]]]] = []  # by interruptions: see _longest()
    for k in range(len(d0)):
        mine: tuple[list[tuple[int, int]], list[tuple[int, int]]] = ([(weight[k], i0[k])], [])
        slot = (i0[k] - LOOSE) // near
        for at in (slot, slot + 1):
            if at not in ended:
                continue
            ended[at] = [j for j in ended[at] if d0[k] - d0[j] - n[j] <= BREAK + LOOSE]  # the others are too far back for all that follow
            for j in ended[at]:
                gap_d, gap_i = d0[k] - d0[j] - n[j], i0[k] - i0[j] - n[j]
                if gap_i > LOOSE or gap_i <= -SHINGLE or gap_d <= -SHINGLE:
                    continue
                far = gap_d > LOOSE
                for broken in (0,) if far else (0, 1):
                    mine[broken or int(far)].extend((w + weight[k], s) for w, s in state[j][broken])
        state.append((_longest(mine[0], before_i), _longest(mine[1], before_i)))
        ended.setdefault((i0[k] + n[k]) // near, []).append(k)
        end = i0[k] + n[k]
        upto = before_i[min(end - SHINGLE + 1, len(rare))]
        for w, s in state[k][0] + state[k][1]:
            if w >= DENSE * (upto - before_i[s]):
                best = max(best, (end - s) / size)
    return best


def _longest(chains: list[tuple[int, int]], before: list[int]) -> list[tuple[int, int]]:
    """Of chains (rare shingles in pieces, start in the item) with one end those that may grow to the longest passage: no other starts as early and is as dense."""
    if len(chains) < 2:
        return chains
    kept, most = [], -1.0
    for w, s in sorted(chains, key=lambda c: (c[1], -c[0])):
        if w + DENSE * before[s] > most:
            kept.append((w, s))
            most = w + DENSE * before[s]
    return kept


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, t) with a key k that equal letters share."""
    for b in batches:
        keys = [hashlib.md5(letters(t)).hexdigest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string())], ["i", "t", "k"])


def _text_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k and g, each different shingle of its text, of (k, t)."""
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g = np.unique(shingles(letters(t)))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64))], ["k", "g"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, its MinHashes and their bands, of (k, t); texts too short for a shingle have none."""
    for b in batches:
        keys, low, bands = [], [], []
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g = shingles(letters(t))
            if len(g):
                mine = np.array([(g * m).max() for m in _COPY_MULTIPLIERS])
                keys.append(k)
                low.append(mine.view(np.int64).tolist())
                bands.append([hashlib.md5(bytes([n]) + x.tobytes()).hexdigest() for n, x in enumerate(mine.reshape(BANDS, ROWS))])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(low, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.string()))], ["k", "low", "bands"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The shingles, sorted, that stand in COMMON_ITEMS or more of the texts (k, t; different letters), where near-copies count as one.

    Near-copies agree in half of their MinHashes. Texts meet the least one of each band; links are closed by components.
    """
    signs = cut(texts.mapInArrow(_signatures, "k string, low array<long>, bands array<string>"), "signatures")
    band = signs.select("k", F.explode("bands").alias("band"))
    least = band.groupBy("band").agg(F.min("k").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    met = band.join(least, "band").where("k <> lead").select("k", "lead").distinct()
    both = met.join(signs.select("k", "low"), "k").join(signs.select(F.col("k").alias("lead"), F.col("low").alias("other")), "lead")
    links = cut(both.where(F.size(F.filter(F.zip_with("low", "other", lambda a, b: a == b), lambda x: x)) * 2 >= BANDS * ROWS).select("k", "lead"), "links")
    stands = texts.mapInArrow(_text_shingles, "k string, g long")
    groups = None
    if not links.isEmpty():
        groups = connected_components(links, "k", "lead")
        stands = stands.join(groups.withColumnRenamed("vertex", "k"), "k", "left").select("g", F.coalesce("component", "k").alias("k")).distinct()
    found = stands.groupBy("g").count().where(F.col("count") >= COMMON_ITEMS).select("g").toArrow()["g"].to_numpy()
    for d in (signs, links, groups):
        drop(d)
    return np.sort(found.astype(np.int64).view(np.uint64))


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, share of every document that holds a passage of an item of at least a third of it.

    Texts are compared as streams of letters and digits without case, accents, signs, blanks or line ends. Items are
    partitioned by size; a document is cut into windows of a third of the items of each class, half overlapping, and the
    window's HASHES minima are looked up among those of the items' windows. Shingles of COMMON_ITEMS different items or more
    find nothing, so that lines of instruction and stock phrases don't count; they are counted over all items before the
    passes, and copies and near-copies of an item count as one (common_shingles). Pairs that agree in AGREE minima are verified
    by their exact shingles in order (best_passage).

    Null, empty and very short texts on either side match nothing; repeated documents count each; repeated items too:
    a text is searched for once, for all its items. No shuffle of documents: the items go to all tasks, PASS_BYTES of them in each pass over the corpus.
    """
    spark = docs.sparkSession

    known = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-int(total) // PASS_BYTES))
    keyed = known.mapInArrow(_keyed, T.StructType([known.schema["i"], T.StructField("t", T.StringType()), T.StructField("k", T.StringType())]))
    texts = cut(keyed.groupBy("k").agg(F.min("t").alias("t"), F.collect_set("i").alias("i")), "items")  # the ids of a text, which go to all tasks anyway
    common = spark.sparkContext.broadcast(common_shingles(texts.select("k", "t")))
    schema = T.StructType([docs.select(doc_id).schema[0], items.select(item_id).schema[0], T.StructField("share", T.DoubleType())])
    out = None
    for p in range(passes):
        part = texts.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == p).orderBy("k").toArrow()
        sent = spark.sparkContext.broadcast((part["i"].to_pylist(), part["t"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Items(*sent.value, common.value)
            for batch in batches:
                ids, texts, lo = batch.column(0), [letters(t) for t in batch.column(1).to_pylist()], 0
                rows, found, shares = [], [], []
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size < BLOCK):
                        size, hi = size + len(texts[hi]), hi + 1
                    grams = [shingles(t) for t in texts[lo:hi]]
                    doc = np.repeat(np.arange(hi - lo), [len(g) for g in grams])
                    g = own.masked(np.concatenate(grams))
                    pairs = own.search(g, doc)
                    for pair in own.likely(pairs, g, doc).tolist() if len(pairs) else []:
                        d, i = divmod(pair, len(own.ids))
                        s = own.share(grams[d], i)
                        if s >= LEAST:
                            rows.extend([lo + d] * len(own.ids[i]))
                            found.extend(own.ids[i])
                            shares.extend([s] * len(own.ids[i]))
                    lo = hi
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(found, pa.int64()).cast(part_type), pa.array(shares, pa.float64())], [doc_id, item_id, "share"])

        part_type = part["i"].type.value_type
        one = docs.select(doc_id, text).where(F.length(text) >= SHINGLE).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    drop(texts)
    return out
