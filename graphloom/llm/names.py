"""Variant spellings of names: forms of a name, a metric-space join of the forms, and the entities they make."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.shared import cut, drop, salted_lookup

PERSONS = ("Person", "SoftwareEngineer", "Researcher", "Lawyer", "Coach", "Nurse", "Teacher")
ORGANISATIONS = ("Organization", "Company", "Institute", "Club")

# Everyday short forms of given names, titles, words of organisations' names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander alexandra", "andy": "andrew", "barb": "barbara", "becca": "rebecca", "becky": "rebecca", "bella": "isabella",
    "ben": "benjamin", "benny": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "cathy": "catherine", "charlie": "charles charlotte", "chris": "christopher", "chuck": "charles", "cindy": "lucinda", "dan": "daniel", "dani": "daniela", "danny": "daniel", "dave": "david",
    "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "ed": "edward", "eddie": "edward", "eliza": "elizabeth", "fran": "francesca", "fred": "frederick", "freddie": "frederick",
    "gabe": "gabriel", "greg": "gregory", "gwen": "gwendolyn", "hettie": "henrietta", "iggy": "ignatius", "jim": "james", "jo": "josephine", "joe": "joseph", "jon": "jonathan", "josie": "josephine",
    "kate": "katharina", "kathi": "katharina", "kathy": "katharina", "kechi": "nkechi", "ken": "kenneth", "kenny": "kenneth", "kit": "christopher", "len": "leonard", "leo": "leonard", "liz": "elizabeth",
    "lottie": "charlotte", "lucy": "lucinda", "maggie": "margaret", "matt": "matthew matthias", "matze": "matthias", "meg": "margaret", "mike": "michael", "mina": "wilhelmina", "nat": "nathaniel",
    "nate": "nathaniel", "nick": "nicholas", "nicky": "nicolette", "nikki": "nicolette", "pat": "patricia", "peggy": "margaret", "quin": "quentin", "rob": "robert", "sam": "samuel", "seun": "oluwaseun", "stef": "stephanie", "steffi": "stephanie",
    "steve": "stephen", "tabby": "tabitha", "tavi": "octavia", "ted": "theodore edward", "thandi": "thandiwe", "theo": "theodore", "toni": "antonia", "tony": "anthony", "tricia": "patricia", "ulla": "ursula",
    "uschi": "ursula", "vicky": "victoria", "vic": "victoria", "will": "william", "willa": "wilhelmina", "xavi": "xaver", "yola": "yolanda", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
TITLES = frozenset("dr prof professor mr mrs ms miss eng ing dipl phd msc mba md ma bsc jr sr herr frau sir".split())
LEGAL = frozenset("ltd limited gmbh gesellschaft mbh inc incorporated corp corporation co company group plc llc ag sa the".split())
SHORT_KINDS = {"intl": "international", "labs": "laboratories", "mfg": "manufacturing", "ptnrs": "partners", "rlys": "railways", "svcs": "services", "tech": "technologies"}
GENERAL = frozenset({"", "unknown", "n/a", "none", "-", "?", "tbd", "not available", "boss", "the boss", "team lead", "client a", "the company", "hq"})

#: A word that stands beside so many different others in names of organisations, and beside one in SHARE of all names, is a kind of business; a coined word stands beside a few.
PARTNERS, SHARE = 8, 0.001
#: Of two such words, one that is a short form or a misspelling of the other is none of its own if the other stands beside so many times as many.
FOREMOST = 5


def _plain(name: str) -> str:
    name = unicodedata.normalize("NFKD", name.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l"))
    return "".join(c for c in name if not unicodedata.combining(c))


def _letters(token: str) -> str:
    """A word in small letters; digits within it are misread letters, ph is f."""
    t = token.lower()
    return re.sub("[^a-z]", "", t.replace("0", "o").replace("1", "l")).replace("ph", "f") if re.search("[a-z]", t) else ""


def person_forms(name: str) -> list[tuple[str, str, str]]:
    """(mode, given, family) that a person's name can stand for.

    full: both parts known; alt: the given name is one of several, joined by |; init: only its first letter is known.
    Nothing for a single word that is no account name (first letter, family name and a mark), and for general aliases.
    """
    name = _plain(name).strip().rstrip(".").strip()
    if name.lower() in GENERAL or "@" in name:
        return []
    if "," in name:
        last, _, first = name.partition(",")
        if not first.strip() or not last.strip():
            return []
        name = first + " " + last
    name = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name)
    raw = [t for t in re.split(r"\s+", name) if t and (re.sub("[^a-z]", "", t.lower()) not in TITLES or "." in t[:-1])]
    raw = [t for t in raw if re.search("[A-Za-z]", t)]
    if len(raw) == 1:
        m = re.fullmatch(r"([a-z])([a-z]{4,}?)(?:_[a-z]|\d)?", raw[0].lower())
        return [("init", m[1], m[2])] if m and raw[0][0].islower() or m and raw[0].isupper() and re.search(r"[_\d]", raw[0]) else []
    if len(raw) < 2:
        return []
    dotted = lambda t: bool(re.fullmatch(r"(?:[A-Za-z]\.?){1,3}", t)) and (len(t) <= 1 or "." in t)
    words = [t for t in raw if not dotted(t)]
    if len(words) == len(raw) or not dotted(raw[0]) and not dotted(raw[-1]):
        if len(words) < 2:
            return []
        first, last = _letters(words[0]), "".join(map(_letters, words[1:]))
        if not first or not last:
            return []
        known = [x.replace("ph", "f") for x in NICKNAMES.get(first, first).split()]
        return [("full" if len(known) == 1 else "alt", "|".join(known), last)]
    if dotted(raw[0]) or dotted(raw[-1]):
        mark = raw[0] if dotted(raw[0]) else raw[-1]
        if len(words) >= 1:
            if dotted(raw[-1]) and len(words) >= 2 and not dotted(raw[0]) and "." not in raw[-1]:
                return []
            return [("init", _letters(mark)[:1], "".join(map(_letters, words)))]
    return []


def _near(a: str, b: str) -> bool:
    """One letter more, less, other or two neighbours swapped, at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or y[1:] == x or x[1:] == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


class Kinds:
    """Kinds of business: words, and phrases of two of them."""

    def __init__(self, words: Iterable[str], phrases: Iterable[str] = ()):
        self.words, self.phrases = frozenset(words), sorted(set(phrases))
        self.tails = sorted({*self.words, *self.phrases}, key=lambda k: (-len(k), k))
        self.known: dict[tuple[str, bool, bool], str | None] = {}

    def of(self, token: str, raw: str) -> str | None:
        """The words that a word stands for: itself, misspelt, shortened, or the initials of a phrase."""
        key = token, raw.isupper(), raw.endswith(".")
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._of(*key)
        return self.known[key]

    def _of(self, token: str, shouted: bool, dotted: bool) -> str | None:
        if token in self.words:
            return token
        if SHORT_KINDS.get(token) in self.words:
            return SHORT_KINDS[token]
        for holds, long in (
            (shouted and len(token) >= 2, [k for k in self.phrases if "".join(w[0] for w in k.split()) == token]),
            (dotted and len(token) >= 3, [w for w in self.words if w.startswith(token)]),
            (len(token) >= 6, [w for w in self.words if _near(token, w)]),
        ):
            if holds and len(long) == 1:
                return long[0]
        return None


def _tokens(name: str) -> list[tuple[str, str]]:
    """(letters, as written) of the words of an organisation's name but for legal forms; nothing for general aliases."""
    name = _plain(name).strip()
    if name.lower() in GENERAL or "@" in name:
        return []
    raw = re.split(r"[\s,]+", re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name))
    return [(t, r) for r in raw if (t := _letters(r)) and t not in LEGAL]


def organisation_forms(name: str, known: Kinds) -> list[tuple[str, str, str]]:
    """(full, kind of business, coined part) of an organisation's name, whatever their order; its legal form doesn't count.

    A name of several words of which none is a known kind stands for all of them, in any order. One word alone gives nothing.
    """
    coined, kinds = [], []
    shouted = name.isupper()
    for t, raw in _tokens(name):
        k = known.of(t, raw.lower() if shouted and len(t) > 3 else raw)
        if k:
            kinds += k.split()
        else:
            coined.append(t)
    if coined and not kinds:  # written in one word
        for k in known.tails:
            tail = k.replace(" ", "")
            if coined[-1].endswith(tail) and len(coined[-1]) > len(tail) + 2:
                coined[-1] = coined[-1][: -len(tail)]
                kinds = k.split()
                break
    if not kinds:
        return [("full", "", "".join(sorted(coined)))] if len(coined) > 1 else []
    return [("full", " ".join(sorted(set(kinds))), "".join(coined))] if len("".join(coined)) > 2 else []


def _named(nodes: DataFrame, persons: tuple[str, ...], organisations: tuple[str, ...]) -> DataFrame:
    """id, sort (p or o), name: the distinct names and aliases under each id. Records of other types, without id or name have none."""
    sort = F.when(F.col("type").isin(*persons), "p").when(F.col("type").isin(*organisations), "o")
    name = F.element_at("attributes", F.lit("name")).getField("value")
    every = F.explode(F.concat(F.array(name), F.coalesce("aliases", F.array().cast("array<string>"))))
    return nodes.where(F.col("id").isNotNull()).select("id", sort.alias("sort"), every.alias("name")).where("sort is not null and name is not null").distinct()


def learned_kinds(names: DataFrame) -> Kinds:
    """The kinds of business that the names (name) of organisations show: words beside PARTNERS different others at least, and beside one in SHARE of all names.

    So the words are no more than the square of a name's length over SHARE, however many names there are. Phrases are two
    such words that follow each other in as many names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n in b.column(0).to_pylist():
                words = [t for t, _ in _tokens(n)]
                out += [(x, y, k + 1 == m) for k, x in enumerate(words) for m, y in enumerate(words) if x != y]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else ((),) * 3, (pa.string(), pa.string(), pa.bool_()))], ["word", "other", "next"])

    distinct = names.select("name").distinct()
    pairs = cut(distinct.mapInArrow(run, "word string, other string, next boolean"), "pairs")
    least = max(PARTNERS, SHARE * distinct.count())
    count = {r["word"]: r["n"] for r in pairs.groupBy("word").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= least).collect()}
    both = [(r["word"], r["other"]) for r in pairs.where("next").groupBy("word", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()]
    drop(pairs)
    short = lambda w, v: v != w and count[v] >= FOREMOST * count[w] and (v.startswith(w) or SHORT_KINDS.get(w) == v or len(w) >= 6 and _near(w, v))
    phrases = [(a, b) for a, b in both if a in count and b in count]
    words = {w for w in count if not any(short(w, v) for v in count) and not any(a[0] + b[0] == w for a, b in phrases)}
    return Kinds(words, [f"{a} {b}" for a, b in phrases if a in words and b in words])


def name_forms(nodes: DataFrame, persons: tuple[str, ...] = PERSONS, organisations: tuple[str, ...] = ORGANISATIONS, kinds: Kinds | None = None) -> DataFrame:
    """id, sort (p or o), mode, part, stem: the distinct forms of the names and aliases under each id. Kinds of business are learned from the names where none are given."""
    rows = cut(_named(nodes, persons, organisations), "names")
    kinds = kinds or learned_kinds(rows.where("sort = 'o'"))
    words, phrases = sorted(kinds.words), kinds.phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Kinds(words, phrases)
        for b in batches:
            out = []
            for i, s, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                out += [(i, s, *f) for f in (person_forms(n) if s == "p" else organisation_forms(n, known))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ([],) * 5)], ["id", "sort", "mode", "part", "stem"])

    out = cut(rows.mapInArrow(run, "id string, sort string, mode string, part string, stem string").distinct(), "forms")
    drop(rows)
    return out


def pivot_cells(key: Column) -> Column:
    """The cells (array of long) of a key: two keys within one edit of each other share one.

    Pivots are the strings aaa..., bbb..., one for every character and longer than any key. The distance of a key to a pivot
    is its length less how often the character stands in it, whatever the order, so these distances need no edit matrix. A
    cell is the tuple of the distances to all pivots in rings of width one, shown as a sum of hashes. By the triangle
    inequality one edit moves no distance by more than one, and that to the nearest string of any set of characters neither:
    so of two keys within one edit, either lacks at most one character of the other. A key is at home in its own cell and
    repeated in those of one character less, as many as it has different ones: there it meets every key within the radius.
    """
    letters = F.filter(F.split(key, ""), lambda c: c != "")
    far = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))
    home = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc + far(c))
    return F.concat(F.array(home), F.transform(F.array_distinct(letters), lambda c: home - far(c)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether the Damerau-Levenshtein distance of two texts is one: a letter more, less or other, or two neighbours swapped."""
    d = F.levenshtein(a, b, 2)
    differ = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first, second = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swapped = (F.size(differ) == 2) & (second == first + 1) & (F.substring(a, first, F.lit(1)) == F.substring(b, second, F.lit(1))) & (F.substring(b, first, F.lit(1)) == F.substring(a, second, F.lit(1)))
    return (d == 1) | ((d == 2) & (F.length(a) == F.length(b)) & swapped)


def near_keys(keys: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of the distinct texts in column `key` that differ by one edit: a metric-space join of radius one.

    Keys are partitioned by their distances to the pivots and repeated over the borders (pivot_cells); inside each cell the
    exact metric decides. No pair is lost, and a cell holds only keys of almost the same letters, however many keys there are.
    """
    cells = cut(keys.select("key", F.explode(pivot_cells(F.col("key"))).alias("cell")), "cells")
    pairs = cells.join(cells.select("cell", F.col("key").alias("other")), "cell").where((F.col("key") < F.col("other")) & (F.abs(F.length("key") - F.length("other")) <= 1))
    out = cut(pairs.where(one_edit(F.col("key"), F.col("other"))).select(F.col("key").alias("a"), F.col("other").alias("b")).distinct(), "near")
    drop(cells)
    return out


def entities(forms: DataFrame) -> DataFrame:
    """id, entity: ids whose names mean the same person or organisation share an entity.

    Ids are linked through full forms they share or that differ by one edit, and what is linked is closed under linking:
    over distinct forms only, which are linked where they are near or stand under one id.
    An id that has no full form goes to the one entity that its alternatives or its first letter with the family name
    allow; if there are several it stays alone, if there is none it joins the ids of the same first letter and family name.
    """
    forms = cut(forms.withColumn("key", F.concat_ws(" ", "sort", "part", "stem")), "keyed")
    full = forms.where("mode = 'full'")
    keys = cut(full.select("key", "sort", "part", "stem").distinct(), "keys")
    near = near_keys(keys)
    first = cut(full.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("last")), "first")
    several = full.select("id", F.col("key").alias("b")).join(first.where("key <> last").select("id", F.col("key").alias("a")), "id").where("a <> b").select("a", "b").distinct()
    links = cut(near.select("a", "b").unionByName(several), "links")
    comp = connected_components(links)
    known = cut(keys.join(comp.withColumnRenamed("vertex", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "known")
    named = cut(salted_lookup(first.select("id", "key"), known.select("key", "component"), ["key"], "inner").select("id", F.concat(F.lit("k "), "component").alias("entity")), "named")
    rest = forms.where("mode <> 'full'").join(named, "id", "left_anti")
    whole = rest.select("id", "sort", "stem", "mode", F.explode(F.split("part", r"\|")).alias("part"))
    by_name = whole.where("mode = 'alt'").join(known.select("sort", "part", "stem", "component"), ["sort", "part", "stem"], "left")
    letter = known.groupBy("sort", F.substring("part", 1, 1).alias("part"), "stem").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    by_letter = whole.where("mode = 'init'").join(letter, ["sort", "part", "stem"], "left")
    own = F.concat(F.lit("n "), F.concat_ws(" ", "sort", F.substring("part", 1, 1), "stem"))
    cands = by_name.select("id", F.col("component").alias("lo"), F.col("component").alias("hi"), own.alias("own")).unionByName(by_letter.select("id", "lo", "hi", own.alias("own")))
    judged = cands.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("own").alias("own"))
    entity = F.when(F.col("lo").isNull(), F.col("own")).when(F.col("lo") == F.col("hi"), F.concat(F.lit("k "), "lo")).otherwise(F.concat(F.lit("i "), "id"))
    out = cut(named.unionByName(judged.select("id", entity.alias("entity"))), "entities")
    for d in (forms, keys, near, first, links, comp, known, named):
        drop(d)
    return out


def entity_pairs(members: DataFrame) -> DataFrame:
    """id_a, id_b (id_a < id_b by bytes): all pairs of ids within an entity."""
    b = members.select("entity", F.col("id").alias("id_b"))
    return members.withColumnRenamed("id", "id_a").join(b, "entity").where("id_a < id_b").select("id_a", "id_b").distinct()
