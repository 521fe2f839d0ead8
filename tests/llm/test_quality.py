import random

import numpy as np

from quillmesh.llm import quality as Q

WORDS = "the build is slow because an index of all pages has to be read again and it was not kept by the team".split()


def prose(r):
    return " ".join(" ".join(r.sample(WORDS, 12)).capitalize() + "." for _ in range(r.randint(2, 12)))


def make(r, kind):
    if kind == "prose":
        return prose(r)
    if kind == "list":
        return "\n".join(f"{r.choice('-*+')} {r.choice(WORDS)} {r.choice(WORDS)}" for _ in range(r.randint(6, 30)))
    if kind == "table":
        return "\n".join(f"| {i} | {r.choice(WORDS)} | {r.random():.3f} |" for i in range(r.randint(6, 30)))
    return r.choice(["=-" * 60, " ".join("".join(r.choices("bcdfgkwxz", k=7)) for _ in range(60)), "https://x.example/?a=1 " * 30])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1.0) for i, t in rows], "doc_id long, text string, kind string, n_chars double")


def test_held_out_accuracy(spark):
    r = random.Random(5)
    data = [(i, k, make(r, k)) for i, k in enumerate(r.choices(["prose", "list", "table", "junk"], [6, 2, 1, 1], k=400))]
    labels = spark.createDataFrame([(i, f" {k.title()}", None) for i, k, _ in data if i % 2], "doc_id long, kind string, labeled_on date")
    got = {x["doc_id"]: x["kind"] for x in Q.kinds(docs(spark, [(i, t) for i, _, t in data]), labels).select("doc_id", "kind").collect()}
    test = [(i, k) for i, k, _ in data if not i % 2]
    assert sum(got[i] == k for i, k in test) / len(test) > 0.97


def test_figures(spark):
    text = "A line of words.\r\n- item one\n\n| 1 | x | 2 |\nDone, is it? Yes."
    f = Q.with_figures(docs(spark, [(1, text), (2, None), (3, " \n\t "), (4, "x")])).toPandas().set_index("doc_id")
    assert list(f.index) == [1, 4]
    a = f.loc[1]
    assert (a.n_lines, a.n_words, a.punct_lines) == (4, 18, 0.5) and abs(a.list_chars - 8 / a.n_words / a.mean_word) < 1e-9
    assert a.table_chars > 0 and a.common_words > 0 and not f.isna().any().any()


def test_long_texts_take_linear_time(spark):
    long = ["a  " * 40_000, "x" * 200_000, "|" * 100_000, "1, " * 60_000, "a: " * 50_000, "。" * 50_000, "- " * 60_000]
    f = Q.with_figures(docs(spark, list(enumerate(long)))).toPandas()
    assert len(f) == len(long) and not f.isna().any().any()


def test_induction_on_separable_and_empty_data():
    x = np.array([[v, v % 3] for v in range(60)], float)
    kinds = np.array(["a" if v < 20 else "b" for v in range(60)])
    rules, default = Q.induce(x, kinds, ["u", "v"])
    assert default == "b" and [r.kind for r in rules] == ["a"] and rules[0].conditions[0].name == "u" and not rules[0].conditions[0].above
    assert Q.case_sql(*Q.induce(np.empty((0, 2)), np.array([], str), ["u", "v"])) == "'prose'"


def test_no_labels_means_prose(spark):
    d = docs(spark, [(1, "- a\n- b")])
    none = spark.createDataFrame([], "doc_id long, kind string, labeled_on date")
    assert [r["kind"] for r in Q.kinds(d, none).select("kind").collect()] == ["prose"]
    assert Q.kinds(d.limit(0), none).count() == 0


def test_figures_inside_the_case_give_the_same_kinds(spark):
    r = random.Random(9)
    data = [(i, k, make(r, k)) for i, k in enumerate(r.choices(["prose", "list", "table", "junk"], [4, 2, 2, 1], k=120))]
    labels = spark.createDataFrame([(i, k, None) for i, k, _ in data if i % 2], "doc_id long, kind string, labeled_on date")
    d = docs(spark, [(i, t) for i, _, t in data])
    assert sorted(Q.only_kinds(d, labels).collect()) == sorted(Q.kinds(d, labels).select("doc_id", "kind").collect())
