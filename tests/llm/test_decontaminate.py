import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from changeflow.llm import decontaminate as D
from changeflow.llm.common import read
from .llm_fixtures import SF_MID

QUESTION = "A farmer named Alice has 12 apples and 30 pears in a basket of 45 kg, and gives Alice 12 of the fruits to a friend."


def found(docs, bench):
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_exact, r.item_windows) for r in D.contaminated(docs, bench).collect()}


def test_words_numbers_names_and_units_become_slots(spark):
    df = spark.createDataFrame([(QUESTION,), (None,), ("ABC def-Ghi; 3.5km 7 kg 1st",)], "t string")
    a, b, c = (r.x for r in df.select(D.tokens(F.col("t")).alias("x")).collect())
    assert a[:7] == ["a", "farmer", "named", D.NAME + "alice", "has", D.NUMBER + "12", "apples"]
    assert D.UNIT + "kg" in a and b == []
    assert c == ["abc", "def", "ghi", D.NUMBER + "3", D.NUMBER + "5", D.UNIT + "km", D.NUMBER + "7", D.UNIT + "kg", D.NUMBER + "1", "st"]


def test_other_values_are_found_if_they_map_one_to_one(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, "unrelated words that no document holds at all in any order whatever")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Some text before. " + QUESTION + " And after."),
        (11, "Before it. " + QUESTION.replace("12", "99").replace("Alice", "Robert").replace("30", "7").replace("kg", "pounds")),
        (12, QUESTION.replace("12", "99", 1).replace("Alice", "Carol", 1).replace("kg", "99").replace("30", "8")),  # neither name nor number agrees
        (13, QUESTION.upper()),
        (14, "A farmer named Alice has 12 apples but nothing else of the question is here"),
        (15, "  ".join(QUESTION.split()).replace(",", ";")),
    ], "doc_id long, text string")
    got = found(docs, bench)
    whole = got[10, 1][2]
    assert set(got) == {(10, 1), (11, 1), (13, 1), (15, 1)}
    assert got[10, 1][:2] == got[13, 1][:2] == got[15, 1][:2] == (whole, whole) and got[11, 1] == (whole, 0, whole)


def test_short_items_and_odd_rows(spark, odd, no_docs):
    bench = spark.createDataFrame([(1, "twelve one two three four five six seven eight"), (2, "of this one is here"), (None, "eleven twelve one two three four five six"), (4, None), (5, ""), (1, "seven eight nine ten eleven twelve the end of")], "item_id long, text string")
    got = found(odd, bench)
    ids = {5, 2**60 + 1}
    assert set(got) == {(i, j) for i in ids for j in (1, 2, None)} | {(None, 1), (None, None)}
    left = D.without_benchmark(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert D.contaminated(no_docs, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(odd, empty).count() == 0 and D.without_benchmark(odd, empty).count() == odd.count()


def test_query_matches_brute_force(spark):
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    index, size = collections.defaultdict(set), {}
    for r in read(spark, SF_MID, "benchmark").collect():
        w = words(r.text)
        size[r.item_id] = len(w) - 7
        for j in range(len(w) - 7):
            index[tuple(w[j : j + 8])].add((r.item_id, j))
    want = {}
    for r in read(spark, SF_MID, "documents").collect():
        w, hits = words(r.text), collections.defaultdict(set)
        for j in range(len(w) - 7):
            for item, at in index.get(tuple(w[j : j + 8]), ()):
                hits[item].add(at)
        want.update({(r.doc_id, i): len(at) for i, at in hits.items() if len(at) >= size[i] / 2})
    got = {(r.doc_id, r.item_id): r.n_exact for r in D.op5_decontaminate(spark, SF_MID).collect()}
    # The word before a copied passage can make its first word look like a name inside a sentence: one window fewer.
    assert got.keys() == want.keys() and got and all(want[k] - 1 <= got[k] <= want[k] for k in got)


def test_items_of_slots_are_found_by_their_values(spark):
    sums = "Compute 12 + 35 * 7 and 4 - 18 / 3 with 250 * 16"
    bench = spark.createDataFrame([(1, sums), (2, "12 7 1984 33 60 5 41 9 100 28"), (3, "one generic phrase of eight words is here 12 44 9 31 77 58 6 21 35 64 8 93")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "Before it. " + sums + " And after."),
        (11, "Others: Compute 99 + 15 * 8 and 5 - 28 / 6 with 150 * 11"),
        (12, "a list 12 7 1984 33 60 5 41 9 100 28 of figures"),
        (13, "here one generic phrase of eight words is here and no figures follow"),
        (14, "COPY " + sums.upper()),
    ], "doc_id long, text string")
    got = found(docs, bench)
    # The same sums with other numbers are the question re-parameterised: their operators and words agree.
    assert set(got) == {(10, 1), (11, 1), (14, 1), (12, 2)}
    assert all(w == e == whole for k, (w, e, whole) in got.items() if k[0] != 11) and got[11, 1][1] == 0


def test_sums_with_other_numbers_are_found_and_tables_are_not(spark):
    items = ["Compute 12 + 35 * 7 - 4 and then 9 * 3 + 8", "Solve 3x + 5 = 20 for x", "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109",
             "Version v1 v2 v3 v4 v5 v6 v7 v8 v9 v10", "row 1 2 3 4 5 6 7 8 9 10 11 12", "a 1 a 2 a 3 a 4 a 5 a 6 a 7 a 8"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "First: Compute 15 + 21 * 6 - 2 and then 8 * 5 + 11, please."), (11, "Now solve 7x + 2 = 16 for x"), (12, "solve 7x+2=16 for x"),
        (20, " ".join(f"w{500 + 37 * i}" for i in range(60))), (21, "Changes: " + " ".join(f"v{3 * i + 3}" for i in range(40))),
        (22, "row " + " ".join(str(7 * i) for i in range(40))), (23, " ".join(f"a {50 + i}" for i in range(30))),
        (24, "On 3 + 4 days in 2024 we saw 5 - 6 birds, and 7 * 8 is 56 while 9 / 3 = 3"),
    ], "doc_id long, text string")
    assert set(found(docs, bench)) == {(10, 0), (11, 1), (12, 1)}


def test_recall_of_other_values_on_arithmetic_and_stories(spark):
    rng = random.Random(4)
    stories = ["{a} buys {x} pens at {y} cents each and sells {z} of them to {b}; how many cents does {a} have left?",
               "Compute {x} + {y} * {z} - {w} and write the result as one whole number", "What is {x} * {y} + {z} / {w} = ?",
               "A train leaves {a} at {x} kmh and a car leaves {b} at {y} kmh; after {z} hours how far apart are they?"]
    names = ["Alice", "Robert", "Carla", "Dmitri", "Erin", "Farid"]
    def filled(s):
        a, b = rng.sample(names, 2)
        x, y, z, w = rng.sample(range(2, 4000), 4)
        return s.format(a=a, b=b, x=x, y=y, z=z, w=w)
    bench = spark.createDataFrame([(i, filled(s)) for i, s in enumerate(stories)], "item_id long, text string")
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    noise = lambda n: " ".join(rng.choice([*plain, str(rng.randrange(3000))]) for _ in range(n))
    rows = [(k * 10 + i, noise(40) + " " + filled(s) + " " + noise(40)) for k in range(50) for i, s in enumerate(stories)]
    rows += [(10_000 + k, noise(120)) for k in range(200)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    right = [k for k in got if k[0] < 10_000 and k[0] % 10 == k[1]]
    assert len(right) >= 0.9 * 200 and not any(k[0] >= 10_000 for k in got)


def test_names_and_numbers_of_any_place_and_shape(spark):
    story = "Tom has 1,200 apples in a box. Tom gives 30 of them to a friend. \"Mary eats 12 of the apples\" he says. How many are left?"
    bench = spark.createDataFrame([(1, story)], "item_id long, text string")
    other = story.replace("Tom", "Robert").replace("Mary", "Carla")
    docs = spark.createDataFrame([
        (10, other),
        (11, other.replace("1,200", "3.5")),
        (12, story.replace(". ", " ").replace("?", "").replace('"', "")),
        (13, story.replace("12", "7").replace("30", "7").replace("1,7", "1,2")),
    ], "doc_id long, text string")
    got = found(docs, bench)
    whole = got[10, 1][2]
    assert {k[0] for k, v in got.items() if v[0] == whole} >= {10, 11, 12, 13}
    assert got[12, 1] == (whole, whole, whole)
    (a,) = (r.x for r in docs.limit(1).select(D.tokens(F.lit("Paid 1,200.50 km, 3.5 and 1,2 in 2024."), whole=True).alias("x")).collect())
    assert a == [D.NAME + "paid", D.NUMBER + f"1200{D.POINT}50", D.UNIT + "km", D.NUMBER + f"3{D.POINT}5", "and", D.NUMBER + "1", D.NUMBER + "2", "in", D.NUMBER + "2024"]


def test_near_copies_and_part_passages(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    short, middle, long = words[:15], words[20:58], words[60:]
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(middle)), (3, " ".join(long)), (4, " ".join(words[:8]))], "item_id long, text string")
    text = lambda w, edits=(): " ".join(["before", "it"] + [f"other{chr(97 + i)}" if i in edits else x for i, x in enumerate(w)] + ["after", "it"])
    docs = spark.createDataFrame([
        (10, text(short, {7})), (11, text(middle, {8, 19})), (12, text(middle, {4, 9, 14, 19, 24, 29})),
        (13, text(middle[:12] + ["put", "in"] + middle[12:20] + middle[21:])), (14, text(long[:29])), (15, text(words[:8], {4})),
        (20, text(middle[:14])), (21, text(long[:15] + ["x"] * 20 + long[40:55])), (22, text(middle, set(range(0, 38, 2)))), (23, text(words[:3])),
    ], "doc_id long, text string")
    assert set(found(docs, bench)) == {(10, 1), (10, 4), (11, 2), (12, 2), (13, 2), (14, 3), (15, 4)}


def test_no_python_in_plan(spark, odd):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    plan = D.matches(odd, bench)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("EvalPython", "InPandas", "InArrow")) and "CartesianProduct" not in plan


def seeded(spark, *texts, sizes=(4,)):
    """The hashes at each place of each text's tokens."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").select("doc_id", D.tokens(F.col("t"), whole=True).alias("toks"))
    out = [collections.defaultdict(list) for _ in texts]
    for r in D._seeded(df, list(sizes), "doc_id").collect():
        out[r.doc_id][r.pos].append(r.h)
    return out


def test_seeds(spark):
    """Slots meet by their types where words tell enough, by their values where they do not; no run passes the end."""
    a, b, c, d, e, f, g = seeded(spark, "with Tom has 12 apples", "with Anna has 7 apples", "with tom has 12 apples", "12 7 5 has", "12 7 6 has", "one two", "")
    assert sorted(a) == sorted(b) == [0, 1] and len(f) == len(g) == 0
    assert set(a[0]) & set(b[0]) and set(a[0]) & set(c[0]) and not set(b[0]) & set(c[0])
    assert len(a[0]) == 2 and len(c[0]) == 1
    assert len(d[0]) == 1 and d[0] != e[0]
    (short,) = seeded(spark, "one two three", sizes=(1, 2, 3, 4))
    assert [len(short[p]) for p in range(3)] == [3, 2, 1]


@pytest.fixture()
def unadaptive(spark):
    """Plans are final before they run, so their code can be looked at."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_runs_are_hashed_by_compiled_code(spark, unadaptive):
    """No run is hashed inside a lambda, and no method is too long for the JVM to compile (8,000 bytes)."""
    import contextlib
    import io

    df = spark.createDataFrame([(1, ["a"])], "doc_id long, toks array<string>")
    for sizes in ([4], [1, 2, 3, 4]):
        runs = D._seeded(df, sizes, "doc_id")
        plan = runs._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and plan.count("transform(") == 1
        code = io.StringIO()
        with contextlib.redirect_stdout(code):
            runs.explain("codegen")
        lengths = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code.getvalue())]
        assert lengths and max(lengths) < 8000
