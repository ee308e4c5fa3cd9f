"""Splitting oversized texts at natural boundaries, by pointer doubling over tables of boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One token: a run of ASCII letters, digits and underscores, or one other character that is no blank.
TOKEN = r"[0-9A-Za-z_]+|[^ \t\n\r0-9A-Za-z_]"
#: Characters handled at a time by one task.
BLOCK_CHARS = 2_000_000

_BLANK = np.array([9, 10, 13, 32])
_ENDERS = np.array([ord(c) for c in ".!?…"])
_WIDE_ENDERS = np.array([ord(c) for c in "。！？"])
_CLOSERS = np.array([ord(c) for c in "\"')]»”’"])


def tokens_of(chars: np.ndarray) -> np.ndarray:
    """Where the tokens of a text, given as code points, begin."""
    word = ((chars >= 48) & (chars <= 57)) | ((chars >= 65) & (chars <= 90)) | ((chars >= 97) & (chars <= 122)) | (chars == 95)
    start = ~word & ~np.isin(chars, _BLANK)
    inner = word.copy()
    inner[1:] &= ~word[:-1]
    return np.flatnonzero(start | inner)


def _pauses(chars: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Tokens before which the text pauses: after a line end, or after the end of a sentence (with closing marks) and a blank."""
    if len(tok) < 2:
        return np.zeros(0, np.int64)
    lines = np.cumsum(np.concatenate([[0], (chars == 10) | (chars == 13)]))
    newline = lines[tok[1:]] > lines[tok[:-1]]
    blank = np.isin(chars[tok[1:] - 1], _BLANK)
    last = chars[tok[:-1]]
    end = np.isin(last, _ENDERS)
    closed = np.isin(last, _CLOSERS)
    closed[1:] &= end[:-1]
    closed[:1] = False
    return np.flatnonzero(newline | (blank & (end | closed)) | np.isin(last, _WIDE_ENDERS)) + 1


def greedy_cuts(begin: np.ndarray, end: np.ndarray, natural: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) token of every piece of many texts at once.

    Text i holds the tokens begin[i] to end[i]; natural holds the sorted places where a cut is natural. From a piece's
    start the legal successor is the farthest natural place within the limit that lies beyond the overlap, the text's
    end if that is within the limit, or else the hard cut at the limit. The next piece starts `overlap` before it.
    """
    step = limit - overlap
    nat = np.unique(np.concatenate([begin[:1], natural, end]))

    def text_end(s: np.ndarray) -> np.ndarray:
        return end[np.searchsorted(begin, s, "right") - 1]

    # the states are all places where a piece can start: text starts, before natural cuts, and along series of hard cuts
    inside = natural - overlap
    inside = inside[inside > begin[np.searchsorted(begin, natural, "right") - 1]]
    state = np.unique(np.concatenate([begin, inside]))
    following = nat[np.minimum(np.searchsorted(nat, np.minimum(state + overlap, text_end(state) - 1), "right"), len(nat) - 1)]
    hard = np.maximum(0, -(-(following - limit - state) // step))
    series = np.repeat(state, hard) + step * (np.arange(hard.sum()) - np.repeat(np.cumsum(hard) - hard, hard) + 1)
    state = np.unique(np.concatenate([state, series]))
    stop = text_end(state)
    reach = np.minimum(state + limit, stop)
    far = nat[np.searchsorted(nat, reach, "right") - 1]
    to = np.where(reach == stop, stop, np.where(far > state + overlap, far, reach))
    jump = np.where(to == stop, np.arange(len(state)), np.searchsorted(state, to - overlap))
    reached = np.zeros(len(state), bool)
    reached[np.searchsorted(state, begin)] = True
    while True:  # after round k all pieces up to number 2**k of each text are known
        reached[jump[reached]] = True
        twice = jump[jump]
        if np.array_equal(twice, jump):
            break
        jump = twice
    return state[reached], to[reached]


def _pieces(texts: list[str], limit: int, overlap: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its text's number, its own text, its first and last (exclusive) token; and the tokens of each text."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    tok = tokens_of(chars)
    first = np.searchsorted(tok, at)
    n = np.diff(first)
    some = np.flatnonzero(n > 0)
    begin, end = first[some], first[some + 1]
    natural = _pauses(chars, tok)
    natural = natural[~np.isin(natural, begin)]
    a, b = greedy_cuts(begin, end, natural, limit, overlap)
    k = some[np.searchsorted(begin, a, "right") - 1]
    place = np.append(tok, 0)
    left = np.where(a == first[k], 0, place[a] - at[k])
    right = np.where(b == first[k + 1], at[k + 1] - 1 - at[k], place[b] - at[k])
    return k, [texts[i][x:y] for i, x, y in zip(k.tolist(), left.tolist(), right.tolist())], a - first[k], b - first[k], n


def split_oversized(rows: DataFrame, keys: list[str], limit: int = 500, overlap: int = 50, text: str = "text", start: str = "token_start", end: str = "token_end") -> DataFrame:
    """The pieces of all rows of more than `limit` tokens: keys, piece (from 0), text, token_start, token_end, offsets.

    Each piece has at most `limit` tokens; two pieces that follow each other share exactly `overlap` tokens; without the
    shared tokens the texts of all pieces joined give the row's text. Cuts are made at the farthest line or sentence end
    within the limit, and between any two tokens where there is none.

    token_start and token_end count from the row's own offset if that is right (offsets: given), from the smaller one if
    start and end are swapped (swapped), or else from 0 at the row's start (local). Null, empty and blank texts and those within the
    limit give no pieces; repeated rows give repeated pieces; other columns of rows are ignored.

    No shuffle: a text's table of boundaries lies with the text, those of many texts are doubled together.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kept = [F.col(k) for k in keys]
    big = rows.select(*kept, F.col(text).alias("_text"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    big = big.where((F.octet_length("_text") > limit) & (F.regexp_count("_text", F.lit(TOKEN)) > limit))
    more = [T.StructField("piece", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_start", T.LongType()), T.StructField("token_end", T.LongType()), T.StructField("offsets", T.StringType())]
    schema = T.StructType([*big.select(*keys).schema, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column("_text").to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_CHARS):
                    size, hi = size + len(texts[hi]), hi + 1
                part = batch.slice(lo, hi - lo)
                k, cut, a, b, n = _pieces(texts[lo:hi], limit, overlap)
                s, e = (np.array([-1 if x is None else x for x in part.column(c).to_pylist()], np.int64) for c in ("_start", "_end"))
                given, swapped = (s >= 0) & (e - s == n), (e >= 0) & (s - e == n)
                base = np.where(given, s, np.where(swapped, e, 0))[k]
                kind = np.where(given, "given", np.where(swapped, "swapped", "local"))[k]
                piece = np.arange(len(k)) - np.searchsorted(k, k)
                old = part.select(keys).take(pa.array(k))
                new = [pa.array(piece, pa.int32()), pa.array(cut, pa.string()), pa.array(base + a), pa.array(base + b), pa.array(kind.tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([*old.columns, *new], [*keys, *[f.name for f in more]])
                lo = hi

    return big.mapInArrow(run, schema)


def joined_pieces(pieces: DataFrame, keys: list[str], overlap: int = 50) -> DataFrame:
    """keys, text, longest: the text that the pieces of split_oversized() were cut from, put together without the tokens they share, and the tokens of its longest piece.

    Repeated pieces count once; the pieces of a row are a bounded group, since they make one text.
    """
    shared = r"\A(?:(?:[0-9A-Za-z_]++|[^ \t\n\r0-9A-Za-z_])[ \t\n\r]*+){%d}" % overlap
    rest = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.regexp_replace("text", shared, ""))
    one = pieces.select(*keys, "piece", "text").distinct().select(*keys, "piece", rest.alias("rest"), F.regexp_count("text", F.lit(TOKEN)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("piece", "rest")))
    return one.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x.rest), "").alias("text"), F.max("n").alias("longest"))
