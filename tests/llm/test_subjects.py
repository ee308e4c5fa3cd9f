import random

from graphloom.llm.subjects import Rules, clean_labels, sentences, subject_shares, train_rules, words

AREAS = {"science": ["microscope", "enzyme", "pollen", "isotope"], "sport": ["referee", "penalty", "goalkeeper", "stadium"], "law": ["court filing", "plea", "verdict", "court clerk"]}


def text(rng, areas):
    lines = []
    for _ in range(rng.randint(6, 14)):
        a = rng.choice(areas)
        lines.append(rng.choice(["Both the {} and the {} were late.", "Nobody asked about the {} since May; the {} can wait."]).format(*rng.sample(AREAS[a], 2)))
        lines.append(rng.choice(["The court surface was dry.", "Nobody had further remarks.", "The call was moved to Monday."]))
    return "---\ncategory: sport\n---\n" + " ".join(lines)


def test_sentences():
    assert sentences("---\na: b\n---\nOne. Two? three says X! Four\nfive") == ["One.", "Two? three says X!", "Four", "five"]
    assert sentences(None) == sentences("") == sentences(" \n ") == []
    assert words("Über die Klasse, 3 Mal a X-ray") == ["über", "die", "klasse", "mal", "ray"]


def test_learned_rules_and_held_out_accuracy(spark):
    rng = random.Random(1)
    names = list(AREAS)
    truth = {i: [names[i % 3]] if i % 4 else [names[i % 3], names[(i + 1) % 3]] for i in range(400)}
    docs = [(i, text(rng, a)) for i, a in truth.items()] + [(900, None), (901, ""), (902, "Nobody had further remarks."), (903, "  ")]
    labels = [(i, rng.choice(truth[i]) if rng.random() > 0.1 else rng.choice(names)) for i in range(250)]
    labels = [(i, s.upper() if i % 7 == 0 else s[:-1] if i % 11 == 0 else s + " ") for i, s in labels] + [(902, None), (9999, "law"), (3, "weather")]
    schema = "doc_id long, text string"
    d = spark.createDataFrame([(*r, "x", "y", 1) for r in docs], schema + ", classes string, subject string, of int")
    areas = spark.createDataFrame([(n, "") for n in names], "subject string, description string")
    lab = spark.createDataFrame([(i, s, "r") for i, s in labels], "doc_id long, subject string, rater string")
    rules = train_rules(d, lab, areas)
    got: dict = {}
    for r in subject_shares(d, rules).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.share >= 0.25 and 0 < r.n <= r.of
    held = [i for i in range(250, 400)]
    right = sum(got.get(i) == set(truth[i]) or (len(truth[i]) == 2 and got.get(i, set()) <= set(truth[i]) and bool(got.get(i))) for i in held)
    assert right >= 0.95 * len(held)
    assert not {900, 901, 902, 903} & set(got)


def test_labels_and_empty_tables(spark):
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string")
    lab = spark.createDataFrame([(1, "LAW "), (1, "law"), (2, "spor"), (3, None), (4, "cooking"), (5, "la")], "doc_id long, subject string")
    assert sorted(map(tuple, clean_labels(lab, areas).collect())) == [(1, "law"), (2, "sport"), (3, "(none)"), (5, "law")]
    docs = spark.createDataFrame([], "doc_id long, text string")
    rules = train_rules(docs, lab, areas)
    assert subject_shares(docs, rules).count() == 0


def test_evidence():
    r = Rules([(["a"], "x", 0.7), (["b"], "y", 0.9), (["a", "b"], "x", 0.95)])
    assert r.subject(["a"]) == "x" and r.subject(["b"]) == "y" and r.subject(["b", "a", "a"]) == "x" and r.subject(["c"]) is None


def test_rare_words_give_rules_in_a_large_sample_too(spark):
    from pyspark.sql import functions as F

    from graphloom.llm.subjects import NONE, count_sets, frequent_sets, prune, telling_words

    few = [(["a"], ["quasar", f"x{k}"]) for k in range(12)] + [(["b"], ["ledger", f"y{k}"]) for k in range(12)]
    many = spark.range(200_000).select(F.array(F.lit(NONE)).alias("classes"), F.array().cast("array<string>").alias("words"))
    rows = spark.createDataFrame(few, "classes array<string>, words array<string>").unionByName(many)
    telling = telling_words(rows)
    assert telling == ["ledger", "quasar"]
    baskets = rows.select(F.array_intersect("words", F.lit(telling)).alias("items"), "classes").where(F.size("items") > 0).groupBy("items", "classes").agg(F.count("*").alias("n"))
    assert {(*r[0], r[1]) for r in prune(count_sets(baskets, [(w,) for w in telling]))} == {("quasar", "a"), ("ledger", "b")}
    assert frequent_sets(baskets.select("items"), 6) == []


def test_sets_and_redundant_rules(spark):
    import random
    from collections import Counter
    from itertools import combinations

    from graphloom.llm.subjects import count_sets, frequent_sets, prune

    rng = random.Random(4)
    rows = [(sorted(rng.sample("abcdefg", rng.randint(1, 5))),) for _ in range(200)]
    counts = Counter(x for (items,) in rows for k in (2, 3) for x in combinations(items, k))
    baskets = spark.createDataFrame(rows, "items array<string>")
    sets = frequent_sets(baskets, 20, 3)
    assert sets == sorted(s for s, n in counts.items() if n >= 20)
    assert frequent_sets(baskets, 20) == [s for s in sets if len(s) == 2]
    # a and b together mean x, apart nothing; c always means y, so c with d tells no more
    many = [(["a", "b"], ["x"], 40), (["a"], ["y"], 40), (["b"], ["z"], 40), (["c"], ["y"], 30), (["c", "d"], ["y"], 30), (["d"], ["z"], 90), (["e"], ["x"], 5)]
    table = spark.createDataFrame(many, "items array<string>, classes array<string>, n long")
    rules = prune(count_sets(table, [("a",), ("b",), ("c",), ("d",), ("e",), ("a", "b"), ("c", "d")]))
    assert [(s, c) for s, c, _ in rules] == [(["a", "b"], "x"), (["c"], "y"), (["d"], "z")]
    # with rules a sentence has one class of its own
    own = count_sets(table, [("c",), ("d",)], [(["c"], "y", 0.9)])
    assert {(s, c) for s, c, _ in own} == {(("c",), "y"), (("d",), "(none)")}
