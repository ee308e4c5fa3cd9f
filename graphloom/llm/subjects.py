"""Subject areas of documents: class-association rules mined by parallel FP-growth, and evidence of the rules that match each sentence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.shared import cut, drop, trimmed

#: Labelled documents that rules are mined from; of more, those whose ids hash lowest.
LABELLED = 20_000
#: Sentences a rule must hold in, at least, however large the sample, which LABELLED bounds; its confidence; what it must add to that of all rules it contains.
SUPPORT, CONFIDENCE, GAIN = 6, 0.6, 0.02
#: Words of a rule, at most: see the README for what longer ones change.
LENGTH = 2
#: Sentences to each part of the items that FP-growth mines apart; every part gets its own copy of the sentences with its items.
PART_ROWS = 250_000
#: Share of the sentences on any subject that makes a document deal with one.
SHARE = 0.25
NONE = "(none)"

_FRONT = re.compile(r"\A﻿?(---|\+\+\+)[ \t]*\r?\n.*?\r?\n\1[ \t]*(\r?\n|\Z)", re.S)
_LINES = re.compile(r"[\r\n]+")
_END = re.compile(r"[.!?…。][\"'”»)\]]*\s+(?=[^\W\d_a-zß-öø-ÿ]|[\d¿¡(\[\"'“„«-])")
_WORD = re.compile(r"\w\w+")


def sentences(text: str | None) -> list[str]:
    """Lines and sentences of a text after its front matter. A question mark inside a sentence, before a small letter, ends none."""
    out = []
    for line in _LINES.split(_FRONT.sub("", text, count=1)) if text else ():
        a = 0
        for m in _END.finditer(line):
            out.append(line[a : m.end()].rstrip())
            a = m.end()
        out.append(line[a:])
    return [s for s in out if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject: each label once, as `subjects` spells it, NONE for null. Misspelt labels go to the one subject within two letters; others are left out."""
    given = F.lower(trimmed(F.col("given")))
    raw = labels.select("doc_id", F.col("subject").alias("given")).distinct()
    areas = F.broadcast(subjects.select("subject").where("subject is not null").distinct())  # the areas are few by definition
    names = raw.where("given is not null").select("given").distinct().join(areas, F.levenshtein(given, F.lower("subject")) <= 2)
    best = names.groupBy("given").agg(F.min(F.struct(F.levenshtein(given, F.lower("subject")).alias("d"), "subject")).alias("m")).select("given", "m.subject")
    return raw.join(best, "given", "left").select("doc_id", F.when(F.col("given").isNull(), F.lit(NONE)).otherwise(F.col("subject")).alias("subject")).where("subject is not null").distinct()


class Rules:
    """Words, and rules {words} -> log odds per subject."""

    def __init__(self, rules: list[tuple[list[str], str, float]]):
        self.given = rules
        self.one: dict[str, list[tuple[str, float]]] = {}
        self.more: dict[str, list[tuple[frozenset[str], str, float]]] = {}
        for items, subject, confidence in rules:
            odds = math.log(confidence / (1 - confidence))
            if len(items) == 1:
                self.one.setdefault(items[0], []).append((subject, odds))
            else:
                self.more.setdefault(min(items), []).append((frozenset(items), subject, odds))
        self.vocabulary = frozenset([*self.one, *(w for k in self.more.values() for r in k for w in r[0])])
        self.known: dict[frozenset[str], str | None] = {}

    def subject(self, sentence: list[str]) -> str | None:
        """The subject of most evidence: the sum of log odds of all matching rules for it; none if there are no such rules."""
        mine = self.vocabulary.intersection(sentence)
        if not mine:
            return None
        if mine not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            score: dict[str, float] = {}
            for w in sorted(mine):
                for s, odds in self.one.get(w, ()):
                    score[s] = score.get(s, 0.0) + odds
                for items, s, odds in self.more.get(w, ()):
                    if items <= mine:
                        score[s] = score.get(s, 0.0) + odds
            best = max(score, key=lambda s: (score[s], s), default=None)
            self.known[mine] = None if best == NONE else best
        return self.known[mine]


def telling_words(rows: DataFrame) -> list[str]:
    """Words that may lead to a rule, of rows of words and classes: those of SUPPORT sentences at least whose best class is clearly likelier with them than without."""
    per = rows.select(F.explode("classes").alias("class"), F.col("words").alias("ws")).select("class", F.explode("ws").alias("w")).groupBy("w", "class").count()
    sizes = {r["class"]: r["count"] for r in rows.select(F.explode("classes").alias("class")).groupBy("class").count().collect()}
    total = sum(sizes.values())
    if not total:
        return []
    prior = F.element_at(F.create_map(*[x for c, k in sizes.items() for x in (F.lit(c), F.lit(k / total))]), F.col("class"))
    stats = per.groupBy("w").agg(F.sum("count").alias("n"), F.collect_list(F.struct("class", "count")).alias("c")).where(F.col("n") >= SUPPORT).select("w", "n", F.inline("c"))  # as many as there are subjects
    expected = F.col("n") * prior
    good = stats.where((F.col("class") != NONE) & (F.col("count") > 2 * expected) & (F.col("count") >= SUPPORT / 2) & (F.col("count") - expected > 2 * F.sqrt(expected)))
    return sorted(r["w"] for r in good.select("w").distinct().collect())  # words of at least SUPPORT sentences of a bounded sample


def frequent_sets(baskets: DataFrame, least: int, length: int = LENGTH) -> list[tuple[str, ...]]:
    """The sorted sets of 2 to `length` items that stand together in `least` rows of baskets (column items) at least, by parallel FP-growth."""
    n = baskets.count()
    if n < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, numPartitions=max(2, n // PART_ROWS)).fit(baskets)
    few = model.freqItemsets.where(F.size("items").between(2, length)).select(F.array_sort("items").alias("items"))
    return sorted(tuple(r["items"]) for r in few.toLocalIterator())


def _contained(items: list[str], nodes: dict) -> Iterator[tuple[str, ...]]:
    """The sets of a prefix tree that sorted items contain. All prefixes of a frequent set are in the tree, since they are as frequent."""
    stack = [((), 0, nodes)]
    while stack:
        found, k, node = stack.pop()
        for i in range(k, len(items)):
            below = node.get(items[i])
            if below is not None:
                more = (*found, items[i])
                yield more
                stack.append((more, i + 1, below))


def count_sets(baskets: DataFrame, sets: list[tuple[str, ...]], rules: list[tuple[list[str], str, float]] | None = None) -> list[tuple[tuple[str, ...], str, float]]:
    """How sure each of the sets makes a class: (set, class, smoothed confidence), of SUPPORT sentences and hardly less than CONFIDENCE at least.

    baskets: items (sorted), classes and n, the number of such sentences. A sentence has all its classes, or with rules one
    of its own: the one they point to, but for one that its document does not carry although it carries several.
    Counted in every task and added up.
    """
    sent = baskets.sparkSession.sparkContext.broadcast((sets, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, given = sent.value
        tree: dict = {}
        for s in sets:
            node = tree
            for w in s:
                node = node.setdefault(w, {})
        rules = None if given is None else Rules(given)
        count: dict[tuple[tuple[str, ...], str], int] = {}
        for b in batches:
            for items, classes, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                if rules is not None:
                    own = rules.subject(items)
                    classes = [NONE if own is None else own if own in classes or len(classes) < 3 else classes[0]]
                for s in _contained(items, tree):
                    for c in classes:
                        count[s, c] = count.get((s, c), 0) + n
        s, c, n = ([s for s, _ in count], [c for _, c in count], list(count.values()))
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.list_(pa.string())), pa.array(c, pa.string()), pa.array(n, pa.int64())], ["s", "c", "n"])

    part = baskets.select("items", "classes", "n").mapInArrow(run, "s array<string>, c string, n long")
    n = part.groupBy("s", "c").agg(F.sum("n").alias("n")).groupBy("s").agg(F.sum("n").alias("all"), F.collect_list(F.struct("c", "n")).alias("x")).select("s", "all", F.inline("x"))  # as many as there are classes
    sure = n.select("s", "c", ((F.col("n") + 0.5) / (F.col("all") + 1.0)).alias("p")).where((F.col("n") >= SUPPORT) & (F.col("p") > CONFIDENCE - GAIN))
    return [(tuple(r["s"]), r["c"], r["p"]) for r in sure.toLocalIterator()]  # no more than there are sets


def prune(sure: list[tuple[tuple[str, ...], str, float]]) -> list[tuple[list[str], str, float]]:
    """Rules of CONFIDENCE, without those that add no more than GAIN to the confidence of a rule for the same class that they contain."""
    known = {(s, c): p for s, c, p in sure}
    out = []
    for (s, c), p in known.items():
        within = max((known.get((x, c), 0.0) for k in range(1, len(s)) for x in combinations(s, k)), default=0.0)
        if p >= CONFIDENCE and p > within + GAIN:
            out.append((list(s), c, min(p, 0.995)))
    return sorted(out)


def train_rules(docs: DataFrame, labels: DataFrame, subjects: DataFrame, labelled: int = LABELLED, rounds: int = 2, length: int = LENGTH) -> Rules:
    """Rules from at most `labelled` labelled documents.

    Sets of words are mined once from their sentences, which are then kept as distinct baskets of telling words. In the
    first round every sentence of a document has the document's labels for classes. Then the rules found give each sentence
    its own class, NONE where no rule matches; the sets are counted again with these classes, so that confidences hold for sentences.
    """
    mine = cut(clean_labels(labels, subjects), "labels")
    chosen = mine.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    per_doc = mine.join(chosen, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("classes"))
    text = docs.select("doc_id", "text").join(per_doc, "doc_id").select("text", "classes").where("text is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for k, t in enumerate(b.column(0).to_pylist()):
                for s in sentences(t):
                    w = sorted(set(words(s)))
                    if w:
                        rows.append(w)
                        of.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), b.column(1).take(pa.array(of, pa.int64()))], ["words", "classes"])

    rows = cut(text.mapInArrow(split, "words array<string>, classes array<string>"), "sentences")
    telling = telling_words(rows)
    sent = docs.sparkSession.sparkContext.broadcast(telling)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            keep = np.asarray(pc.is_in(coded.dictionary, value_set=known))[np.asarray(coded.indices)] if len(flat) else np.zeros(0, bool)
            upto = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(keep))), b.column(1)], ["items", "classes"])

    baskets = cut(rows.mapInArrow(only, "items array<string>, classes array<string>").where(F.size("items") > 0), "baskets")
    sets = [*[(w,) for w in telling], *frequent_sets(baskets.select("items").where(F.size("items") > 1), SUPPORT, length)]
    counted = cut(baskets.groupBy("items", "classes").agg(F.count("*").alias("n")), "counted")
    rules = None
    for _ in range(rounds):
        rules = prune(count_sets(counted, sets, rules))
    for d in (rows, mine, baskets, counted):
        drop(d)
    return Rules(rules)


def subject_shares(docs: DataFrame, rules: Rules, least: float = SHARE) -> DataFrame:
    """doc_id, subject, n, of, share: subjects of at least the share `least` of the document's sentences that deal with any.

    Null, empty and blank texts, and texts without such sentences, give no rows. Repeated documents are judged each.
    No shuffle: the rules, bounded by the labelled sample's size over SUPPORT, go to all tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rules.given)
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("subject", T.StringType()), T.StructField("n", T.LongType()), T.StructField("of", T.LongType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(sent.value)
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                count: dict[str, int] = {}
                for s in sentences(t):
                    subject = rules.subject(words(s))
                    if subject is not None:
                        count[subject] = count.get(subject, 0) + 1
                of = sum(count.values())
                for s, n in sorted(count.items()):
                    if n >= least * of:
                        at.append(k)
                        rows.append((s, n, of, n / of))
            subject, n, of, share = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(subject, pa.string()), pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "subject", "n", "of", "share"])

    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)
