"""The part of Turtle that ontologies and thesauri use: prefixes, triples with ; and ,, names, literals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s+|#[^\n]*|(<[^>]*>)|("""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")(?:@[\w-]+|\^\^\S+?(?=[\s;,.]))?|(@prefix|@base|PREFIX|BASE)\b|([;,.\[\]])(?=\s|$|[;,.])|((?:[^\s;,<>"\[\]]|\.(?=\w))+?)(?=\s|[;,]|\.(?:\s|$)|$)', re.S)


def triples(text: str) -> list[tuple[str, str, str, bool]]:
    """(subject, predicate, object, whether the object is a literal) with names written out. Malformed parts raise ValueError."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"no Turtle at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastindex:
            tokens.append((m.lastindex, m.group(m.lastindex)))
    prefixes: dict[str, str] = {}

    def name(kind: int, t: str) -> str:
        if kind == 1:
            return t[1:-1]
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        p, _, local = t.partition(":")
        return prefixes.get(p, p + ":") + local

    out, k = [], 0
    while k < len(tokens):
        kind, t = tokens[k]
        if kind == 3:
            if t.lower().endswith("prefix"):
                prefixes[tokens[k + 1][1].rstrip(":")] = tokens[k + 2][1][1:-1]
                k += 3
            else:
                k += 2
            if k < len(tokens) and tokens[k][1] == ".":
                k += 1
            continue
        s, k, p = name(kind, t), k + 1, ""
        expect = "p"
        while k < len(tokens):
            kind, t = tokens[k]
            k += 1
            if kind == 4 and t == ".":
                break
            if kind == 4:
                expect = "p" if t == ";" else "o"
            elif expect == "p":
                p, expect = name(kind, t), "o"
            elif kind == 2:
                body = t[3:-3] if t.startswith('"""') else t[1:-1]
                out.append((s, p, re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body), True))
            else:
                out.append((s, p, name(kind, t), False))
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object, literal of a Turtle file."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).toLocalIterator())
    return spark.createDataFrame(triples(text), "subject string, predicate string, object string, literal boolean")


def _local(c):
    return F.regexp_replace(c, "^.*[/#:]", "")


def base_schema(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locked concepts (type, parent) and properties (name, domain, range) of RDFS and OWL triples."""
    rest = lambda end: F.col("predicate").endswith(end)
    kind = lambda *names: t.where(rest("#type") & F.col("object").rlike("(" + "|".join(names) + ")$")).select("subject").distinct()
    up = t.where(rest("#subClassOf")).groupBy("subject").agg(F.min("object").alias("parent"))
    concepts = kind("#Class").join(up, "subject", "left").select(_local(F.col("subject")).alias("type"), _local(F.col("parent")).alias("parent"))
    ends = [t.where(rest(f"#{e}")).groupBy("subject").agg(F.min("object").alias(e)) for e in ("domain", "range")]
    props = kind("#ObjectProperty", "#Property").join(ends[0], "subject", "left").join(ends[1], "subject", "left")
    return concepts, props.select(_local(F.col("subject")).alias("name"), _local(F.col("domain")).alias("domain"), _local(F.col("range")).alias("range"))


def synonyms(t: DataFrame) -> DataFrame:
    """a, b, relation: exact and close matches in both directions, broader and narrower as written."""
    rel = F.regexp_extract("predicate", "#(exact|close|broad|narrow)(?:Match|er)$", 1)
    s = t.select(_local(F.col("subject")).alias("a"), _local(F.col("object")).alias("b"), rel.alias("relation")).where("relation <> ''")
    both = s.where("relation in ('exact', 'close')")
    return s.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation")).distinct()
