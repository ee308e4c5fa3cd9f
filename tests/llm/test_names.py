import itertools
import random

from pyspark.sql import functions as F

from graphloom.llm.names import Kinds, entities, entity_pairs, learned_kinds, name_forms, near_keys, organisation_forms, person_forms, pivot_cells

NODE = "id string, type string, attributes map<string,struct<value:string,confidence:double>>, aliases array<string>, key string"


def node(i, kind, name, *aliases):
    return (i, kind, {"name": (name, 1.0)} if name != "-" else None, list(aliases) or None, "x")


def test_person_forms():
    full = ("full", "ignatius", "vyrevodu")
    for n in ("Ignatius Vyrevodu", " vyrevodu,  IGNATIUS.", "Dr. Iggy Vyrevodu", "Ignatius Vyre Vodu", "Ignatius T. Vyrevødu", "IGNATIUS VYREVÓDU PhD", "IgnatiusVyrevodu", "Ignatius Vyrev0du"):
        assert person_forms(n) == [full], n
    for n in ("I. Vyrevodu", "Mr I. Vyrevodu", "Vyrevodu I.T.", "ivyrevodu", "ivyrevodu1", "ivyrevodu_t", "IVYREVODU1"):
        assert person_forms(n) == [("init", "i", "vyrevodu")], n
    assert person_forms("Ted Vyrevodu") == [("alt", "theodore|edward", "vyrevodu")]
    for n in ("", " ", "Kenneth", "the boss", "N/A", "a@b.example", "Vyrevodu,", "Dr", "Vyrevodu", "漢字"):
        assert person_forms(n) == [], n


KINDS = Kinds(["associates", "athletics", "club", "engineering", "insurance", "partners"], ["athletics club"])


def test_kinds_are_learned(spark):
    rng = random.Random(7)
    coined = ["".join(rng.choice("bdfgkmnprstvz") + rng.choice("aeiouy") for _ in range(4)) for _ in range(120)]
    names = [f"{c.title()} {k} {legal}".strip() for i, c in enumerate(coined) for k in [("Quarries", "Salvage Yard")[i % 2]] for legal in ("", "Ltd", "GmbH")] + ["HQ", "info@x.example", "Alone", ""]
    known = learned_kinds(spark.createDataFrame([(n,) for n in names], "name string"))
    assert known.words == {"quarries", "salvage", "yard"} and known.phrases == ["salvage yard"]
    x = coined[1]
    for n in (f"{x.title()} Salvage Yard", f"The Salvage Yard {x}", f"{x.upper()} SY", f"{x.title()}SalvageYard Ltd", f"{x.title()} Salv. Yard"):
        assert organisation_forms(n, known) == [("full", "salvage yard", x)], n
    assert learned_kinds(spark.createDataFrame([], "name string")).words == frozenset()
    # many names write the kind shortened: the short word is no kind of its own
    more = names + [f"{c.title()} Salv Yard" for c in coined[1:16:2]]
    assert learned_kinds(spark.createDataFrame([(n,) for n in more * 2], "name string")).words == {"quarries", "salvage", "yard"}


def test_organisation_forms():
    for n in ("Tizerufis Associates Ltd", "Associates Tizerufis", "The Tizerufis Associates Group", "TizerufisAssociates Gesellschaft mbH", "TIZERUFISASSOCIATES", "Tize Rufis Assoc. Inc.", "tizerufis asociates"):
        assert organisation_forms(n, KINDS) == [("full", "associates", "tizerufis")], n
    assert organisation_forms("Mipunamo AC", KINDS) == organisation_forms("Mipunamo Athletics Club", KINDS) == [("full", "athletics club", "mipunamo")]
    assert organisation_forms("Acme Motors Ltd", KINDS) == organisation_forms("The Motors, Acme", KINDS) == [("full", "", "acmemotors")]
    for n in ("", "Tizerufis", "Associates", "HQ", "the company"):
        assert organisation_forms(n, KINDS) == [], n


def test_entities(spark):
    rows = [
        node("p1", "Person", "Francesca Vifugive"), node("p2", "Lawyer", "Vifugive, Fran"), node("p3", "Person", "Francesca Viefugive"), node("p4", "Nurse", "fvifugive"), node("p5", "Person", "Francesac Vifugive", "boss"),
        node("p6", "Person", "Albert Vifugive"), node("p7", "Person", "Robert Vifugive", "info@x.example"), node("p8", "Person", "unknown", "boss"), node("p9", "Person", None), node("p10", "Person", "-"), node("p11", "Person", "Bert Vifugive"),
        node("o1", "Company", "Zagupyni Engineering"), node("o2", "Club", "Zagu Pyni Engineering Ltd"), node("o3", "Company", "Zagupyni Insurance", "HQ"), node("t1", "Technology", "Francesca Vifugive"), node(None, "Person", "Francesca Vifugive"),
        node("q1", "Person", "Q. Nosuchone"), node("q2", "Person", "qnosuchone"), node("p1", "Person", "Francesca Vifugive"),
    ]
    got = {tuple(r) for r in entity_pairs(entities(name_forms(spark.createDataFrame(rows, NODE), kinds=KINDS))).collect()}
    same = [{"p1", "p2", "p3", "p4", "p5"}, {"o1", "o2"}, {"q1", "q2"}]
    assert got == {p for s in same for p in itertools.combinations(sorted(s), 2)}
    assert entity_pairs(entities(name_forms(spark.createDataFrame([], NODE)))).count() == 0


def test_every_id_is_an_entity(spark, tmp_path):
    from graphloom.llm.queries import p5_entities

    rows = [node("p1", "Person", "Francesca Vifugive"), node("p2", "Lawyer", "Vifugive, Fran"), node("t1", "Technology", "Rust"), node("p3", "Person", None), node(None, "Person", "x y")]
    spark.createDataFrame(rows, NODE).write.parquet(f"{tmp_path}/nodes.parquet")
    assert {tuple(r) for r in p5_entities(spark, str(tmp_path)).collect()} == {("p1", "p1", 2), ("p2", "p1", 2), ("t1", "t1", 1), ("p3", "p3", 1)}


def osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near_keys_equal_brute_force(spark):
    rng = random.Random(4)
    keys = {"p " + rng.choice(["mei", "ravi"]) + " " + "".join(rng.choice("bdk") + rng.choice("ae") for _ in range(rng.randint(2, 5))) for _ in range(120)} | {"", "a", "ab", "ba", "b", "aé", "éa", "漢字", "字漢", "漢"}
    keys |= {k[:i] + c + k[i + 1 :] for k in sorted(keys) for i in (0, len(k) // 2) for c in "xa" if k}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys, key=lambda k: k.encode()), 2) if osa(a, b) == 1}
    got = [tuple(r) for r in near_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    assert near_keys(spark.createDataFrame([], "key string")).count() == 0


def test_pivots_are_far_by_what_is_missing(spark):
    words = ["banana", "b", "", "ananas", "xyz"]
    rows = spark.createDataFrame([(w, c) for w in words for c in "abz"], "w string, c string")
    n = F.lit(9)
    differing = rows.where(F.levenshtein("w", F.repeat("c", n)) != n - (F.length("w") - F.length(F.replace("w", "c", F.lit("")))))
    assert differing.count() == 0
    cells = {r.w: set(r.x) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", pivot_cells(F.col("w")).alias("x")).collect()}
    assert len(cells["banana"]) == 4 and len(cells[""]) == 1 and not cells["banana"] & cells["xyz"]
