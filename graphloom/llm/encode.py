"""Encoding a corpus with a public byte-level BPE tokenizer: ranked merges folded over the corpus' distinct words."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shared import cut, drop

#: Blanks as Unicode has them; Java's \s holds the ASCII ones only.
_S = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The pattern byte_bpe_50k cuts texts into words with (fixed by that tokenizer).
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words in the dictionary that goes to all tasks, at most: the most frequent ones. The ids of all others are joined to the texts that hold them.
DICTIONARY_WORDS = 400_000
#: A fold costs the square of a word's length, so longer runs without any boundary are merged where they stand, with a heap.
FOLD_BYTES = 1000

_SLOTS = 1 << 17


class Ranks:
    """A tokenizer file (tokenizers' JSON, byte-level BPE): ids of the single bytes, and ranked merges as pair -> id."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        # byte-level vocabularies write bytes that don't print as the code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_ids = [vocab[letter[b]] for b in range(256)]
        back = {c: b for b, c in letter.items()}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, by a heap of ranked pairs over a linked list: n log n steps."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def slots(self) -> list[int]:
        """The merges as one hash table: slot -> (pair + 1) << 31 | id, each pair in one of its two slots, 0 where empty."""
        table = [0] * _SLOTS
        for (a, b), (rank, to) in self.merges.items():
            entry = (a * 65536 + b + 1) << 31 | to if rank == to - 256 else None
            if entry is None:
                raise ValueError("the ids of this tokenizer don't follow the ranks of its merges")
            at = _slot(a * 65536 + b, 0)
            for _ in range(500):
                entry, table[at] = table[at], entry
                if not entry:
                    break
                p = (entry >> 31) - 1
                at = _slot(p, 1) if at == _slot(p, 0) else _slot(p, 0)
            else:
                raise ValueError("no place for a merge")
        return table


#: Multipliers below 2**31, so that a product with a pair of 16-bit ids stays below 2**63.
_FACTORS = (1640531527, 2127912213)
_SHIFT = 29


def _slot(pair: int, which: int) -> int:
    return (pair * _FACTORS[which] >> _SHIFT) & (_SLOTS - 1)


def fold_merges(word: Column, ranks: Ranks) -> Column:
    """Ids of a word (a string column) as a fold of ranked merges over its bytes.

    The rank map is a literal, laid out as a hash table in an array so that a look-up doesn't search it. Each step of
    the fold merges the pair of lowest rank where it stands first; there are at most as many as the word has bytes.
    """
    table = F.split(F.lit(",".join(map(str, ranks.slots()))), ",").cast("array<bigint>")
    first = F.array(*map(F.lit, ranks.byte_ids))
    raw = F.hex(F.encode(word, "UTF-8"))
    ids = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.get(first, F.conv(F.substring(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))

    def found(acc: Column, i: Column) -> Column:
        pair = F.get(acc, i).cast("long") * 65536 + F.get(acc, i + 1)
        one, two = (F.get(table, F.shiftright(pair * F.lit(f), _SHIFT).bitwiseAND(F.lit(_SLOTS - 1)).cast("int")) for f in _FACTORS)
        is_pair = lambda e: F.shiftright(e, 31) == pair + 1
        to = F.when(is_pair(one), one).when(is_pair(two), two)
        return to.bitwiseAND(F.lit((1 << 31) - 1)) * 65536 + i  # the lowest rank first, then the first place

    def step(acc: Column, _: Column) -> Column:
        now = acc.ids
        best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(now) - 2), lambda i: found(now, i)))

        def merge(best: Column) -> Column:
            i = best.bitwiseAND(F.lit(65535)).cast("int")
            joined = F.concat(F.slice(now, 1, i), F.array(F.shiftright(best, 16).cast("int")), F.slice(now, i + 3, F.lit(100000)))
            return F.struct(F.when(best.isNull(), now).otherwise(joined).alias("ids"), (best.isNull() | (F.size(now) < 3)).alias("done"))

        return F.when(acc.done, acc).otherwise(F.get(F.transform(F.array(best), merge), F.lit(0)))

    start = F.struct(ids.alias("ids"), F.lit(False).alias("done"))
    return F.when(F.octet_length(word) > 1, F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step, lambda acc: acc.ids)).otherwise(ids)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def dictionary(docs: DataFrame, ranks: Ranks, text: str = "text") -> DataFrame:
    """word, n, ids: the distinct words of the whole corpus up to FOLD_BYTES long, how often they occur, and the fold's ids."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("word")).where(F.octet_length("word") <= FOLD_BYTES)
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut(counts.repartition(tasks, "word").select("word", "n", fold_merges(F.col("word"), ranks).alias("ids")), "dictionary")
    drop(counts)
    return out


def _least_frequent(words: DataFrame, most: int) -> int:
    """The power of two that words must occur as often as, so that there are at most `most` of them; 0 if all fit."""
    by = words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # at most 64 rows
    total = 0
    for r in by:
        total += r["count"]
        if total > most:
            return 2 ** (r["b"] + 1)
    return 0


def encode_corpus(docs: DataFrame, tokenizer: str, keys: list[str], text: str = "text", most: int = DICTIONARY_WORDS) -> DataFrame:
    """keys and ids (array of int): the ids of every text by the byte-level BPE in the file `tokenizer`, without special tokens.

    Null and empty texts get an empty list; blank texts are encoded as they are; strings that look like special tokens
    are ordinary text. Repeated rows give repeated rows; other columns are ignored.

    The merges run once per distinct word of the corpus, as a fold (see fold_merges). The ids of the `most` most frequent words
    go to all tasks, which leave a mark where a text holds another; the ids of those are joined to the marks. Runs of more
    than FOLD_BYTES without a boundary are merged in place.
    """
    spark = docs.sparkSession
    ranks = Ranks(tokenizer)
    coded = dictionary(docs, ranks, text)
    least = _least_frequent(coded, most)
    known = coded.where(F.col("n") >= least).select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as w:
        w.write_table(known)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    schema = docs.select(*keys).schema.add("ids", T.ArrayType(T.IntegerType())).add("_missing", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        words, ids = table["word"].combine_chunks(), table["ids"].combine_chunks().cast(pa.list_(pa.int32()))
        own: dict[str, list[int]] = {}
        for batch in batches:
            lists = batch.column("_words")
            flat = lists.flatten()
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            coded = flat.dictionary_encode()
            at = pc.index_in(coded.dictionary, value_set=words)
            missing = np.flatnonzero(np.asarray(pc.is_null(at)))
            all_ids, marked = ids, [[] for _ in range(len(lists))]
            if len(missing):
                new = []
                for k, x in enumerate(coded.dictionary.take(pa.array(missing)).to_pylist()):
                    if len(x.encode()) <= FOLD_BYTES:
                        new.append([-1 - k])
                    else:
                        if x not in own:
                            own[x] = ranks.encode_word(x.encode())
                        new.append(own[x])
                all_ids = pa.concat_arrays([ids, pa.array(new, pa.list_(pa.int32()))])
                places = np.asarray(pc.fill_null(at, 0)).copy()
                places[missing] = len(ids) + np.arange(len(missing))
                at = pa.array(places)
                if len(own) > 200_000:
                    own.clear()
            got = all_ids.take(at.take(coded.indices))
            values = got.flatten()
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(got)), dtype=np.int64)])[bounds]
            marks = np.flatnonzero(np.asarray(values) < 0)
            if len(marks):  # numbered anew within each text
                values, names = np.asarray(values).copy(), coded.dictionary.take(pa.array(missing)).to_pylist()
                for i, row in zip(marks.tolist(), (np.searchsorted(sizes, marks, "right") - 1).tolist()):
                    mine = marked[row]
                    mine.append(names[-1 - values[i]])
                    values[i] = -len(mine)
                values = pa.array(values)
            out = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, out, pa.array(marked, pa.list_(pa.string()))], [*keys, "ids", "_missing"])

    words = docs.select(*keys, F.coalesce(words_of(F.col(text)), F.array().cast("array<string>")).alias("_words"))
    marked = words.mapInArrow(run, schema)
    if not least:
        drop(coded)
        return marked.select(*keys, "ids")
    return _filled(cut(marked, "marked"), coded.where(F.col("n") < least).select("word", F.col("ids").alias("_ids")), keys)


def _filled(marked: DataFrame, rare: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a cut table with the ids of rare words for their marks: -1 for the first of _missing, and so on. Rows without marks take no part in the join."""
    rows = marked.select(*keys, "ids", "_missing", F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("_row"))
    whole, open_ = rows.where(F.size("_missing") == 0), rows.where(F.size("_missing") > 0)
    each = open_.select("_row", F.posexplode("_missing").alias("_k", "word")).join(rare, "word")
    parts = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_k", "_ids"))).alias("_parts"))  # no more than the text holds
    full = F.flatten(F.transform("ids", lambda x: F.when(x < 0, F.get("_parts", -x - 1)["_ids"]).otherwise(F.array(x))))
    return whole.select(*keys, "ids").unionByName(open_.join(parts, "_row").select(*keys, full.alias("ids")))


def decode_ids(ids: Column, ranks: Ranks) -> Column:
    """The text of a column of ids: the bytes of all tokens put together, read as UTF-8. Null for null; ids unknown to the tokenizer are left out."""
    table = F.split(F.lit(",".join(ranks.bytes.get(i, b"").hex() for i in range(max(ranks.bytes) + 1))), ",")
    whole = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.decode(F.unhex(whole), "UTF-8")
