"""Expressions on hand-computed rows, arms against brute force, and plans end to end."""

import random

import pytest
from pyspark.sql import functions as F

from pairwright import schemas
from pairwright.functions import stats
from pairwright.functions import text as T
from pairwright.operators import fragments, lookup, outliers, similarity, split, tiles
from pairwright.plans import cliffs, descriptions, inference, qa, scoring
from pairwright.sources import files

SCORES = [
    # gold, pred, EM, precision, recall, F1, edit mean, unigram
    ("A.B.C", "C.A.B", 1, 1, 1, 1, 0, 1),
    ("A.A.B", "A.B.B", 0, 1, 1, 1, 0, 0.8),
    ("A.B", "A", 0, 1, 0.5, 2 / 3, 0, 1),
    ("", "A", 0, 0, 1, 0, 1, 0),
    ("A", "", 0, 0, 0, 0, 1, 0),
    ("", "", 0, 1, 1, 1, 0, 0),
    ("CC1.N1", "CO1.N1", 0, 0.5, 0.5, 0.5, 0.5, 5 / 6),
    (" C C . N ", "CC.N", 1, 1, 1, 1, 0, 1),
    ("ab.cde", "abx.zzz", 0, 0, 0, 0, 2, 3 / 7),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(SCORES)], "i int, gold string, pred string")
    g, p = F.col("gold"), F.col("pred")
    s, f = T.set_scores(T.scoring_tokens(g), T.scoring_tokens(p)), scoring.fragment_scores(g, p)
    em = f["fragment_EM"]
    rows = df.select("i", em, s["precision"], s["recall"], s["f1"], T.fragment_edit_mean(g, p), T.unigram_precision(g, p)).collect()
    for r in rows:
        assert list(r[1:]) == pytest.approx(list(SCORES[r[0]][2:]))


@pytest.mark.parametrize("values, want, one", [([1, 2, 3, 4, 100], (2, 4, 2, -1, 7), 7), ([5, 5, 5, 5], (5, 5, 0, 5, 5), 27), ([1, 2, 3], (1.5, 2.5, 1, 0, 4), 27), ([2, 4, 4, 5, 9, 30], (4, 8, 4, -2, 14), 14), ([], (None,) * 5, 27), ([None, "x", "1", "2", "3", "4", "100", "NaN"], (2, 4, 2, -1, 7), 7)])
def test_fences(spark, values, want, one):
    if values == [None, "x", "1", "2", "3", "4", "100", "NaN"]:
        df = spark.createDataFrame([(v,) for v in values], "x string")
        want, one = (2, 4, 2, -1, 7), 7
        df = df.filter("x IS NULL OR x <> '1'").union(spark.createDataFrame([("1",)], "x string"))
    else:
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = stats.two_sided_fences(df, ["x"]).collect()[0]
    assert (r["q1"], r["q3"], r["iqr"], r["lower_fence"], r["upper_fence"]) == want
    assert stats.upper_fence(df, F.col("x"), 27).collect()[0]["fence"] == one


@pytest.mark.parametrize("accuracy, most", [(10_000, 20_000), (20, 3)])
def test_quantiles_of_ties_and_spans(spark, accuracy, most):
    """Ties at the ranks, one value, two heavy values with the rank between them, wide spans; small sketches must narrow and widen."""
    import duckdb

    rng = random.Random(1)
    columns = {"ties": [float(rng.randint(0, 5)) for _ in range(400)], "halves": [0.0] * 301 + [1.0] * 99, "border": [0.0] * 101 + [7.0] * 299, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)], "one": [3.5] * 400, "even": [i / 7 for i in range(400)], "none": [None] * 400, "few": [None] * 398 + [1.0, 2.0]}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = stats.exact_quantiles(df, list(columns), (0.25, 0.5, 0.75), accuracy, most)
    for c, values in columns.items():
        duck = duckdb.execute("SELECT [quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)] FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchone()[0]
        assert got[c] == pytest.approx(duck) if c != "none" else got[c] == [None] * 3


def test_quantiles_of_many_distinct_values(spark):
    """10 M distinct values: the exact ranks, and no plan that gathers all values in one aggregate."""
    n = 10_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % 10_000_019).cast("double").alias("x"))
    values = sorted(i * 7919 % 10_000_019 for i in range(n))
    got = stats.exact_quantiles(df, ["x"])["x"]
    for q, p in zip(got, (0.25, 0.75), strict=True):
        k = int(p * (n - 1))
        assert q == values[k] + (values[k + 1] - values[k]) * (p * (n - 1) - k)


def test_outliers_keep_missing(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, None, float("nan")])], "i int, x double").withColumn("y", F.lit(None).cast("double"))
    kept, dropped = outliers.split_outliers(df, ["x", "y"])
    assert [r["i"] for r in dropped.collect()] == [4] and kept.count() == 6


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(T.str_or_empty(F.lit("　 NaN\n"), nan_words=True)) == "" and one(T.str_or_empty(F.lit(" nan "))) == "nan"
    assert one(T.alias_coalesce(F.lit("  "), F.lit(" b "))) == "b" and one(T.alias_coalesce(F.lit(None), F.lit(None))) == ""
    assert one(T.fragment_set(F.lit(" B .A..B"))) == ["A", "B"] and one(T.fragment_count(F.lit("B.B"))) == 2
    assert one(T.python_repr(F.lit("a'b\\"))) == repr("a'b\\") and one(T.python_repr(F.lit("a'\""))) == repr("a'\"") and one(T.python_repr(F.lit("C"))) == "'C'"
    assert one(T.edit_similar(F.lit("CCCCCCCCCC"), F.lit("CCCCCCCCCN"))) and not one(T.edit_similar(F.lit("CCCCCCCCC"), F.lit("CCCCCCCCN")))
    assert one(T.ring_digits(F.lit("C1C%12[13C]2"))) == [12, 1, 2] and one(T.unpaired_rings(F.lit("C1CC1C%11"))) == [11]
    for raw, want in (('{"answer":"x"}', "x"), ('text {"answer":"x"} tail', "x"), ("{bad", "{bad"), ("", ""), (" y ", "y")):
        assert one(T.extract_answer(F.lit(raw))) == want
    assert one(T.prs(F.lit(1.0), F.lit(float("nan")))) == 0 and one(T.prs(F.lit(1.0), F.lit(1.0))) == 1
    with pytest.raises(ValueError):
        T.score_from_distance(F.lit(1), "cubic")


def pair_ids(df):
    return sorted((r["l"]["id"], r["r"]["id"]) for r in df.collect())


#: Every rule and mix of rules over columns t, s, b.
MIXES = [[similarity.EditRule("t")], [similarity.SetRule("s", 5)], [similarity.BitRule("b", 5)], [similarity.EditRule("t"), similarity.SetRule("s", 8)], [similarity.SetRule("s", 5), similarity.BitRule("b", 8)], [similarity.EditRule("t"), similarity.SetRule("s"), similarity.BitRule("b", 7)]]


@pytest.mark.parametrize("cell", [similarity.CELL, 2])
def test_join_with_repeated_rows(spark, monkeypatch, cell):
    """Rows that are equal in all columns or in the compared ones, on either side or both; with tiny cells every key is heavy."""
    monkeypatch.setattr(similarity, "CELL", cell)
    monkeypatch.setattr(similarity.meet, "__defaults__", (cell,))
    monkeypatch.setattr(similarity.edit_candidates, "__defaults__", (cell,))
    schema = "id int, g string, t string, s array<string>, b array<bigint>"
    one, same = ("g", "abcdefghijklmnopqrst", ["a", "b"], [7, 0]), ("g", "abcdefghijklmnopqrsX", ["b", "c"], [7, 1])
    base = [one, same, ("g", "abcdefghijXlmnopqrst", ["b", "c", "x"], [3, 0]), ("h", *one[1:]), (None, *one[1:]), ("g", None, None, None), ("g", "", [], []), ("g", "short", ["a", None, "a"], [0, 0])]
    rows = lambda times, at: spark.createDataFrame([(at, *r) if at else (i, *r) for i, r in enumerate(base) for _ in range(times)], schema)
    repeats = [(rows(2, 0), rows(1, 0)), (rows(1, 0), rows(3, 0)), (rows(2, 5), rows(2, 0))]
    for k, rules in enumerate(MIXES):
        left, right = repeats[(k + cell) % 3]
        want = pair_ids(similarity.brute_force(left, right, ["g"], rules))
        assert want and pair_ids(similarity.similarity_join(left, right, ["g"], rules)) == want


@pytest.mark.parametrize("column", ["t", "s", "b"])
def test_join_under_skew(spark, monkeypatch, column):
    """One prefix, one item or one bit that all rows share, in one group that holds nearly all rows."""
    monkeypatch.setattr(similarity.meet, "__defaults__", (8,))
    monkeypatch.setattr(similarity.edit_candidates, "__defaults__", (8,))
    rng = random.Random(11)

    def rows(n, at):
        out = []
        for i in range(n):
            tail = "".join(rng.choice("ABC") for _ in range(rng.choice([4, 10, 11])))
            items = ["all", *rng.sample([f"w{k}" for k in range(6)], rng.randint(0, 3))]
            out.append((at + i, "g" if i % 20 else "h", "C" * 24 + tail, items, [1 | 1 << rng.randrange(6), rng.getrandbits(2)]))
        return spark.createDataFrame(out, "id int, g string, t string, s array<string>, b array<bigint>")

    left, right = rows(90, 0), rows(110, 1000)
    rules = {"t": [similarity.EditRule("t")], "s": [similarity.SetRule("s", 6)], "b": [similarity.BitRule("b", 6)]}[column]
    want = pair_ids(similarity.brute_force(left, right, ["g"], rules))
    assert want and pair_ids(similarity.similarity_join(left, right, ["g"], rules)) == want


def test_a_heavy_key_meets_in_cells(spark):
    """A key with half of all rows is dealt to cells of a bounded size, and each pair of rows meets once."""
    left = spark.range(400).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(300).select(F.col("id").alias("rid"), F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"))
    met = similarity.meet(left, right, ["k"], "id", "rid", 16)
    assert met.count() == met.distinct().count() == left.join(right, "k").count()
    cells = met.filter("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(13)).alias("i"), F.pmod(F.xxhash64("rid"), F.lit(10)).alias("j")).count().collect()
    assert len(cells) == 130 and max(r["count"] for r in cells) < 3 * 200 * 150 / 130


def test_positions_spare_candidates(spark):
    """The positional bound and the owner item leave a fraction of the pairs that share an item of their prefixes."""
    rng = random.Random(4)
    rows = [(i, "g", sorted({f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(8, 20))})) for i in range(300)]
    df = spark.createDataFrame(rows, "__id long, g string, s array<string>")
    items = F.col("s")
    a, b = similarity._prefixes(df, df, ["g"], items, 8)
    plain = a.join(b.select("g", "__key", F.col("__id").alias("rid")), ["g", "__key"]).count()
    found = similarity.set_candidates(df, df, ["g"], items, 8)
    assert found.count() == found.distinct().count() and 3 * found.count() < plain


def test_arms_equal_brute_force(spark):
    rng = random.Random(2)

    def rows(n, at):
        out = []
        for i in range(n):
            base = "".join(random.Random(i % 7).choice("CNO()=1c") for _ in range(rng.choice([0, 5, 12, 25, 40])))
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("CN")
            if rng.random() < 0.3 and t:
                t.insert(rng.randrange(len(t)), "F")
            words = [rng.getrandbits(63) & random.Random(i % 5).getrandbits(63) | random.Random(i % 3).getrandbits(60) for _ in range(2)]
            out.append((at + i, rng.choice("ab"), "".join(t) if rng.random() > 0.05 else None, [f"w{(i % 9) + k}" for k in range(rng.randint(0, 10))], words if rng.random() > 0.1 else None))
        return spark.createDataFrame(out, "id int, g string, t string, s array<string>, b array<bigint>")

    left, right = rows(60, 0), rows(60, 1000)
    key = pair_ids
    for rules in ([similarity.EditRule("t")], [similarity.SetRule("s", 8)], [similarity.BitRule("b", 9)], [similarity.EditRule("t"), similarity.SetRule("s"), similarity.BitRule("b", 7)]):
        want = key(similarity.brute_force(left, right, ["g"], rules))
        assert key(similarity.similarity_join(left, right, ["g"], rules)) == want
        assert want
    none = similarity.similarity_join(left, right.withColumn("b", F.lit(None).cast("array<bigint>")), ["g"], [similarity.EditRule("t")], need_bitmap="b")
    assert none.count() == 0


def slow_split(groups, n):
    """Groups in order of (size, first index); the test side takes one while it fits."""
    test, size = set(), 0
    for _, _, g in sorted(groups):
        k = next(x[0] for x in groups if x[2] == g)
        if size + k <= 0.1 * n:
            test.add(g)
            size += k
    return test


def test_split_is_the_greedy_one(spark):
    rng = random.Random(3)
    for _ in range(3):
        own = [(i, rng.choice([None, *[f"g{rng.randint(0, 25)}" for _ in range(3)]])) for i in range(rng.randint(1, 120))]
        df = spark.createDataFrame(own, "i int, g string")
        sizes = {}
        for i, g in own:
            if g is not None:
                k, first = sizes.get(g, (0, i))
                sizes[g] = (k + 1, first)
        want = slow_split([(k, f, g) for g, (k, f) in sizes.items()], len(own))
        got = {r["i"]: r["split"] for r in split.grouped_split(df, "g", "i").collect()}
        assert got == {i: "test" if g in want else "train" for i, g in own}


def test_fixture_split_and_shuffle(spark):
    rows = [(0, "g1"), (3, "g2"), (1, "g3"), (2, "g3"), *[(i, "g4") for i in range(4, 10)], *[(i, None) for i in range(10, 20)]]
    got = split.grouped_split(spark.createDataFrame(rows, "i int, g string"), "g", "i").filter("split = 'test'").collect()
    assert {r["g"] for r in got} == {"g1", "g2"}


def test_shuffle_is_a_permutation_at_every_size(spark):
    for n in (1, 2, 3, 5, 17, 100, 101, 1000, 20_011):
        df = spark.range(n).select("id", F.concat(F.lit("r"), "id").alias("v"))
        one, again, other = ([r["id"] for r in split.seeded_shuffle(df, seed).orderBy("v").collect()] for seed in (5, 5, 6))
        assert sorted(one) == list(range(n)) and one == again
        assert n < 100 or one != other
    # neighbours are torn apart: the mean distance of two in a row is near a third of the range
    place = {r["v"]: r["id"] for r in split.seeded_shuffle(df, 5).collect()}
    assert 0.3 < sum(abs(place[f"r{i}"] - place[f"r{i + 1}"]) for i in range(n - 1)) / (n - 1) / n < 0.37
    assert split.seeded_shuffle(df.limit(0), 5).count() == 0


def test_split_where_all_groups_have_one_size(spark):
    """Many groups of one row: the first tenth by index, and no window over all of them in the plan."""
    df = spark.range(30_000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("part"), F.concat(F.lit("g"), "id").alias("g"))
    out = split.grouped_split(df, "g", "i")
    assert [r[0] for r in out.filter("split = 'test'").agg(F.max("i")).collect()] == [2999] and out.filter("split = 'test'").count() == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "first_idx ASC" not in plan
    within = split.grouped_split(df, "g", "i", within=["part"]).filter("split = 'test'").groupBy("part").agg(F.count("*").alias("n"), F.max("i").alias("m")).collect()
    assert sorted(tuple(r) for r in within) == [(0, 1000, 2997), (1, 1000, 2998), (2, 1000, 2999)]


def test_lookups(spark):
    m = lookup.last_wins(spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("nan", "3", 2), (" ", "4", 3)], "k string, v string, o int"), "k", "v", "o")
    assert [tuple(r) for r in m.collect()] == [("a", "2")]
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("e", "x")], "t string, c string")
    exact = spark.createDataFrame([("a", "A"), ("e", "")], "k string, v string")
    canonical = spark.createDataFrame([("x", "X")], "k string, v string")
    got = {r["t"]: r["out"] for r in lookup.fallback_lookup(df, "t", F.col("c"), exact, canonical, "out").collect()}
    assert got == {"a": "A", "b": "X", "c": "", "e": ""}
    preds = spark.createDataFrame([(1, "x", "r"), (2, "", ""), (3, "ERROR: t", ""), (4, "y", "ERROR: z")], "id long, pred string, raw string")
    assert [r["id"] for r in lookup.done_ids(preds).collect()] == [1]


def test_filters(spark):
    pairs = spark.createDataFrame([("d", "e", "t1", "n1", "A.B", "A.C"), ("d", "e", "t2", "n2", "A", "A"), ("d", "e", "t3", "n3", "A", "B"), ("d", "e", "t4", "n4", f"A.{'x' * 40}", "A")], schemas.PAIRS_SAFE)
    c = fragments.compare(pairs)
    assert c.columns == list(schemas.COMPARED_COLUMNS)
    assert c.filter("toxic_smiles = 't1'").collect()[0]["unique_safe"] == '[{"fragment":"B","reason":"only_toxic"},{"fragment":"C","reason":"only_nontoxic"}]'
    assert {r["toxic_smiles"] for r in fragments.conserved_core(c).collect()} == {"t1", "t4"}
    assert {r["toxic_smiles"] for r in fragments.filter_pairs(c, fixed=True).collect()} == {"t1"}
    assert {r["toxic_smiles"] for r in fragments.filter_pairs(c).collect()} == {"t1"}
    with pytest.raises(ValueError, match="missing columns: n_common_safe"):
        fragments.conserved_core(pairs)


def test_filters_by_counts_and_by_texts(spark):
    """Pairs from hashes and lengths alone pass the same filters as pairs whose texts are compared."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, rng.choice("xy"), i % 3 == 0, ".".join(rng.choice("abcdefgh") * rng.choice((1, 1, 1, 2, 9)) for _ in range(rng.randint(1, 7)))) for i in range(60)], "id bigint, g string, bad boolean, text string")
    facts = fragments.fragment_facts(docs, "text")
    sides = (facts.filter("bad"), facts.filter("NOT bad"), ["g"], "id")
    short = fragments.common_pairs(*sides)
    a, b = docs.filter("bad").select("g", F.col("id").alias("toxic_id"), F.col("text").alias("toxic_safe")), docs.filter("NOT bad").select("g", F.col("id").alias("nontoxic_id"), F.col("text").alias("nontoxic_safe"))
    texts = a.join(b, "g").select(F.lit("d").alias("dataset_name"), F.col("g").alias("endpoint"), F.col("toxic_id").cast("string").alias("toxic_smiles"), F.col("nontoxic_id").cast("string").alias("nontoxic_smiles"), "toxic_safe", "nontoxic_safe")
    long = fragments.compare(texts)
    ids = lambda df: sorted((int(r[0]), int(r[1])) for r in df.collect())
    core = fragments.conserved_core
    fixed = lambda d: d.filter("n_only_toxic_safe <= 2 AND n_only_nontoxic_safe <= 2")
    same = (
        (core, core),
        (fragments.filter_pairs, lambda d: fragments.tukey_counts(fragments.tukey_length_pairs(d, *sides))),
        (lambda d: fragments.filter_pairs(d, fixed=True, length=3, count=2), lambda d: fixed(fragments.without_long_pairs(core(d), *sides, 2))),
        (lambda d: fragments.tukey_length(core(d)), lambda d: fragments.tukey_length_pairs(d, *sides)),
    )
    for by_text, by_count in same:
        want = ids(by_text(long).select("toxic_smiles", "nontoxic_smiles"))
        assert ids(by_count(short).select("toxic_id", "nontoxic_id")) == want and want
    weights = {r["x"]: r["w"] for r in fragments.length_weights(short, *sides).collect()}
    assert weights == {r["x"]: r["n"] for r in fragments.token_lengths(core(long)).groupBy("x").agg(F.count("*").alias("n")).collect()}


def test_grams_of_neighbours(spark):
    """Grams of whole characters, joined from neighbours: no substring counts its way from the start of the text."""
    texts = ["", "a", "ab", "a b c", "é🙂x🙂🙂 y", "\u0301ab", "xyz" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[T.char_ngrams(F.col("t"), n).alias(f"g{n}") for n in (1, 2, 3)])
    assert "substring" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in df.collect():
        s = r["t"].replace(" ", "")
        assert [r[f"g{n}"] for n in (1, 2, 3)] == [[s[i : i + n] for i in range(len(s) - n + 1)] for n in (1, 2, 3)]


def test_repeated_rows_are_counted_and_spread_last(spark, monkeypatch):
    """Rows of few values: pairs are counted on the values, and made in many tasks behind the last shuffle, in packs."""
    from pairwright.operators import cells

    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), [rng.getrandbits(6) for _ in range(2)] if i % 9 else None, rng.choice(["abcdefghijk", "abcdefghijx", "zz"])) for i in range(240)]
    df = spark.createDataFrame([(*r[:2], r[2] and [r[2][0] - 32, r[2][1]], r[3]) for r in rows], "id bigint, g string, b array<bigint>, t string")
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    for rules in ([similarity.BitRule("b", 5), similarity.EditRule("t")], [similarity.BitRule("b", 3)]):
        want = sorted((r["l"]["id"], r["r"]["id"]) for r in similarity.brute_force(left, right, ["g"], rules).collect())
        counted = similarity.counted_join(left.drop("id"), right.drop("id"), ["g"], rules)
        assert want and counted.agg(F.sum("n")).first()[0] == len(want) and counted.count() < len(want) or len(rules) == 1
        monkeypatch.setattr(similarity, "PACK", 3)
        monkeypatch.setattr(similarity, "TASK", 500)
        monkeypatch.setattr(cells.dealt, "__defaults__", (7,))
        made = similarity.similarity_join(left, right, ["g"], rules)
        assert made.rdd.getNumPartitions() == 1 + len(want) // 500
        assert sorted((r["l"]["id"], r["r"]["id"]) for r in made.collect()) == want


@pytest.mark.parametrize("block, wide, slice_", [(2, 4096, 4_000_000), (3, 0, 4_000_000), (2048, 4096, 5)])
def test_pairs_made_in_cells(spark, monkeypatch, block, wide, slice_):
    """Pairs of blocks give the rows of the texts' own comparison, and no pair is shuffled behind them."""
    from pairwright.operators import cells

    monkeypatch.setattr(cells.dealt, "__defaults__", (block,))
    monkeypatch.setattr(cells, "WIDE", wide)
    monkeypatch.setattr(cells, "SLICE", slice_)
    texts = ["a.bb.ccc", "a.bb", " a . dd\"\t.é\x01", "ccc.eeee", "", "zz", "bb.ccc.ffffff", "a", "a.a..bb"]
    docs = spark.createDataFrame([(i, ("x", "y", None)[i % 11 % 3], t, i % 2) for i, t in enumerate(texts * 3)], "id bigint, g string, t string, toxic int")
    left, right = docs.filter("toxic = 1"), docs.filter("toxic = 0")
    facts = fragments.fragment_facts(left, "t"), fragments.fragment_facts(right, "t")
    rows = left.alias("l").join(right.alias("r"), F.col("l.g") == F.col("r.g")).select(F.lit("documents").alias("dataset_name"), F.col("l.g").alias("endpoint"), F.col("l.id").cast("string").alias("toxic_smiles"), F.col("r.id").cast("string").alias("nontoxic_smiles"), F.col("l.t").alias("toxic_safe"), F.col("r.t").alias("nontoxic_safe"))
    want = fragments.compare(rows).filter("n_common_safe > 0")
    columns = want.columns
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    made = fragments.compare_in_cells((left, right), facts, "g", "id", "t", columns)
    assert key(want) and key(made) == key(want) and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    digests = fragments.compare_in_cells((left, right), facts, "g", "id", "t", columns, digests=True)
    told = ("common_safe_fragments", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments", "toxic_safe_fragments", "nontoxic_safe_fragments", "unique_safe")
    assert key(digests) == key(want.withColumns({c: F.sha2(c, 256) for c in told}))
    short = fragments.fixed_thresholds(fragments.conserved_core(want), 3, 2)
    assert key(fragments.compare_in_cells((left, right), facts, "g", "id", "t", columns, most=2, counts=(2, 2), core=True)) == key(short)
    columns = ["toxic_id", "nontoxic_id", "n_common_safe", "n_only_toxic_safe", "n_only_nontoxic_safe"]
    ids = lambda df: df.withColumns({c: F.col(c.replace("_id", "_smiles")).cast("bigint") for c in columns[:2]})
    counts = fragments.counted_pairs(*facts, ["g"], "id")
    assert key(counts) == key(ids(want)) and "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert key(fragments.counted_pairs(*facts, ["g"], "id", 2)) == key(ids(fragments.fixed_thresholds(want, 3, 99)))


@pytest.mark.parametrize("held", [1 << 25, 3000])
def test_a_cell_makes_each_half_once(monkeypatch, held):
    """Pairs with the same fragments in common share what is made for either text; a memo that forgets changes no row."""
    import hashlib
    import json
    from collections import Counter
    from types import SimpleNamespace

    import pyarrow as pa

    from pairwright.operators import cells

    begun = []
    monkeypatch.setattr(cells, "hashlib", SimpleNamespace(sha256=lambda *x: begun.append(1) or hashlib.sha256(*x)))
    monkeypatch.setattr(cells, "HELD", held, raising=False)
    rng = random.Random(9)
    sides = [[".".join([rng.choice(["hot", "hot.warm"]), *[f'{who}"{i}{k}' for k in range(rng.randint(0, 5))]]) for i in range(60)] for who in "ab"]
    sides = [[*x, *x[:7], "hot", "hot"] for x in sides]
    tables = [pa.table({"id": list(range(at, at + len(x))), "text": x, "endpoint": ["g"] * len(x)}) for at, x in zip((0, 1000), sides, strict=True)]
    columns = ["unique_safe", "common_safe_fragments", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments"]
    cell = cells.text_cell(["toxic_smiles", "nontoxic_smiles", *columns], True, None, None, False)
    plain = lambda x: x.to_pylist() if isinstance(x, pa.Array) else x
    made = Counter(r for out in cell(*tables) for r in zip(*[plain(out[c]) for c in ("toxic_smiles", "nontoxic_smiles", *columns)], strict=True))

    def row(i, j):
        a, b = (set(t.split(".")) for t in (sides[0][i], sides[1][j]))
        items = [{"fragment": x, "reason": why} for xs, why in ((a - b, "only_toxic"), (b - a, "only_nontoxic")) for x in sorted(xs)]
        texts = [json.dumps(items, separators=(",", ":")), *[".".join(sorted(x)) for x in (a & b, a - b, b - a)]]
        return (str(i), str(1000 + j), *[hashlib.sha256(t.encode()).hexdigest() for t in texts])

    assert made == Counter(row(i, j) for i in range(69) for j in range(69))
    assert held < 1 << 25 or len(begun) < 69 * 69 / 5


def test_texts_against_python(spark):
    """Quoting and edit means on any text, against Python."""
    odd = ["a'b\\", "tab\tline\r\nend", "\x00\x1f\x7f\x85\xa0é漢🙂", "zero\u200bwidth \u2028 sep", "'\"", "", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    assert {r["i"]: r["q"] for r in df.select("i", T.python_repr(F.col("t")).alias("q")).collect()} == {i: repr(t) for i, t in enumerate(odd)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    tokens = lambda t: [x for x in t.strip().replace(" ", "").split(".") if x]
    pairs = [("é.b", "b.e"), ("", "ab"), ("ab", ""), ("漢字.ab.c", " 漢子 . abc"), ("a.b", "a.b")]
    got = spark.createDataFrame(pairs, "g string, p string").select("g", "p", T.fragment_edit_mean(F.col("g"), F.col("p")).alias("x")).collect()
    for r in got:
        g, p = tokens(r["g"]), tokens(r["p"])
        assert r["x"] == (sum(min(distance(x, y) for y in g) for x in p) / len(p) if g and p else distance(r["g"].strip(), r["p"].strip()))


def test_query_without_sql_against_python(spark, data):
    """fragment_lev on the whole table."""
    from pairwright.plans import queries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    turns = sorted((r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{data}/conversations.parquet").collect())
    want, tokens = {}, lambda t: [x for x in t.strip().replace(" ", "").split(".") if x]
    for (c, n, gold), (c2, _, pred) in zip(turns, turns[1:]):
        if c == c2 and len(gold) + len(pred) < 600:
            g, p = tokens(gold), tokens(pred)
            want[c, n] = sum(min(distance(x, y) for y in g) for x in p) / len(p) if g and p else distance(gold.strip(), pred.strip())
    got = {(r["conv_id"], r["turn"]): r["edit"] for r in queries.fragment_lev(spark, data).collect()}
    assert len(want) > 5 and set(want) <= set(got)
    assert all(got[k] == pytest.approx(x) for k, x in want.items())


def test_a_set_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    """Readers see the old set until the switch, also when the writer fails before it or between its two steps; a set may be made from the one in force."""
    folder, schema = str(tmp_path / "sink"), "id bigint, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    now = lambda: sorted(tuple(r) for r in files.read_current(spark, folder, schema, allow_missing=True).collect())
    assert now() == []
    with pytest.raises(Exception, match="CURRENT"):
        files.read_current(spark, folder, schema)
    files.replace_jsonl(frame((1, "a"), (2, None)), folder)
    assert now() == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        files.replace_jsonl(frame((3, "c")).withColumn("v", F.raise_error(F.lit("lost"))), folder)
    assert now() == [(1, "a"), (2, None)]
    staged = files.stage_jsonl(frame((4, "d")), folder)  # the writer ends here
    assert now() == [(1, "a"), (2, None)]
    files.switch_to(spark, folder, staged)
    assert now() == [(4, "d")]
    files.replace_jsonl(files.read_current(spark, folder, schema).unionByName(frame((5, "e"))), folder)
    assert now() == [(4, "d"), (5, "e")]
    files.replace_jsonl(frame().limit(0), folder)
    assert now() == []


def test_tiles_hold_each_pair_once(spark):
    """Round trip to (i, j), bounded tiles, tiles that are there already, rows without index or group, an empty side."""
    side = lambda n, at: [("g", i, f"{at}{i}") for i in range(n)] + [("h", 3, f"{at}h"), (None, 1, "x"), ("g", None, "x")]
    frame = lambda rows: spark.createDataFrame(rows, "g string, k int, t string")
    left, right, score = frame(side(23, "a")), frame(side(14, "b")), {"both": lambda a, b: F.concat(a["t"], b["t"]), "same": lambda a, b: a["k"] == b["k"]}
    made = tiles.score_tiles(left, right, ["g"], "k", score, edge=5)
    rows = made.collect()
    assert len(rows) == 5 * 3 + 1 and max(len(r["both"]) for r in rows) == 25
    got = {(r["g"], r["i"], r["j"]): (r["both"], r["same"]) for r in tiles.pairs_of(made, ["g"], list(score)).collect()}
    want = {("g", i, j): (f"a{i}b{j}", i == j) for i in range(23) for j in range(14)} | {("h", 3, 3): ("ahbh", True)}
    assert got == want
    done = made.filter("tile_i < 2").select("g", "tile_i", "tile_j")
    rest = tiles.score_tiles(left, right, ["g"], "k", score, edge=5, done=done)
    assert sorted((r["g"], r["tile_i"], r["tile_j"]) for r in rest.collect()) == sorted((r["g"], r["tile_i"], r["tile_j"]) for r in rows if r["tile_i"] >= 2)
    assert tiles.score_tiles(left.limit(0), right, ["g"], "k", score).count() == 0


def test_pair_scores_and_missing(spark):
    from pairwright.chem.base import PureBackend

    rows = [("d", "e", "toxic", 0, "CCO"), ("d", "e", "toxic", 1, "c1ccccc1"), ("d", "e", "nontoxic", 0, "CCO"), ("d", "e", "nontoxic", 1, "C(")]
    made = cliffs.pair_scores(spark.createDataFrame(rows, "dataset string, endpoint string, label string, idx int, smiles string"), PureBackend())
    got = {(r["i"], r["j"]): r for r in tiles.pairs_of(made, ["dataset_name", "endpoint"], list(cliffs.SCORES)).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert got[0, 0]["circular_similarity"] == 1 and got[0, 0]["edit_similarity"] == 1 and got[0, 0]["scaffold_similarity"] is None and got[0, 1]["circular_similarity"] is None
    df = spark.createDataFrame([("a", 1.0), (" ", float("nan")), (None, None)], "x string, y double")
    assert {r["column"]: (r["n_missing"], r["n_rows"]) for r in stats.missing_counts(df, ["x", "y"]).collect()} == {"x": (2, 3), "y": (2, 3)}


def test_descriptions(spark):
    rows = [("", "tox21_NR-AR"), ("", "TOX21_NR-AR"), ("x", "cardiac disorders"), ("x", "Cardiac disorders"), ("x", "AMES"), ("herg", ""), ("tox21", "SR-p53"), ("tox21", "zz"), ("sider", "q"), ("metabolism", "cyp1a2_veith"), ("", ""), ("zzz", "q")]
    got = [r["description"] for r in descriptions.with_description(spark.createDataFrame(rows, "dataset_name string, endpoint string")).collect()]
    by = dict(zip(rows, got, strict=True))
    assert "androgen" in by["", "tox21_NR-AR"] and by["", "TOX21_NR-AR"] == descriptions._TOX21_ANY
    assert "'cardiac disorders'" in by["x", "cardiac disorders"] and "'Cardiac disorders'" in by["x", "Cardiac disorders"]
    assert "Ames" in by["x", "AMES"] and "hERG" in by["herg", ""] and "p53" in by["tox21", "SR-p53"] and by["tox21", "zz"] == descriptions._TOX21_ANY
    assert "'q'" in by["sider", "q"] and "CYP1A2" in by["metabolism", "cyp1a2_veith"] and by["", ""] == by["zzz", "q"] == ""
    with pytest.raises(Exception, match="no description of zzz/q"):
        descriptions.require_descriptions(descriptions.with_description(spark.createDataFrame([("zzz", "q")], "dataset_name string, endpoint string"))).collect()


def _replay_client():
    """A class made in a function travels to the workers by value; they can't import this module."""

    class Client:
        """Replies known beforehand, asked questions noted in a file; raises for others, and ends the task at a question of its own."""

        def __init__(self, replies, log=None, fatal=None):
            self.replies, self.log, self.fatal = replies, log, fatal

        def complete(self, system, user, schema=None, temperature=0.0):
            if user == self.fatal:
                raise SystemExit("the machine is gone")
            if self.log:
                with open(self.log, "a") as f:
                    f.write(user + "\n")
            return self.replies[user]

    return Client


ReplayClient = _replay_client()


def test_a_lost_run_keeps_its_answers(spark, tmp_path):
    """A run that dies in its third batch and is started again: no question of a kept batch is asked twice, and all are answered."""
    n, log, folder = 40, str(tmp_path / "log"), str(tmp_path / "out")
    ask = spark.createDataFrame([(i, f"q{i}", '{"answer": "O5"}', "d", "e", i) for i in range(n)], "id bigint, question string, answer string, dataset_name string, endpoint string, source_index bigint")
    replies = {f"q{i}": '{"answer": "O5"}' for i in range(n)}
    options = inference.Options(retries=1, sleep=0.0, batch_size=2, callers=2, keep_every=8)
    write = lambda out: out.write.mode("append").json(folder)
    Client = ReplayClient
    run = lambda client, done=None: inference.answer_in_batches(ask, write, client, "m", "task1", "single_step", done, options=options)
    with pytest.raises(Exception):
        run(lambda: Client(replies, log, "q19"))
    kept = spark.read.json(folder)
    assert sorted(r["id"] for r in kept.collect()) == list(range(16))
    assert run(lambda: Client(replies, log), kept) == 3
    assert sorted(r["id"] for r in spark.read.json(folder).collect()) == list(range(n))
    asked = open(log).read().split()
    assert set(asked) == set(replies) and all(asked.count(f"q{i}") == 1 for i in [*range(16), *range(24, n)])
    assert run(lambda: Client(replies, log), spark.read.json(folder)) == 0


def test_a_call_is_paid_for_once():
    """Only a client without the schema argument is asked in another form; other failures are retried as they are."""
    seen, waits = [], []

    class Plain:
        def complete(self, system, user, temperature):
            seen.append("plain")
            return "yes"

    class Failing:
        def complete(self, system, user, schema=None, temperature=0.0):
            seen.append(schema)
            raise TypeError("other") if len(seen) < 3 else RuntimeError("down")

    options = inference.Options(retries=3, sleep=1.0)
    assert inference.call(Plain(), "s", "u", {"a": 1}, options, waits.append) == "yes" and seen == ["plain"] and not waits
    seen.clear()
    assert inference.call(Failing(), "s", "u", {"a": 1}, options, waits.append) == "ERROR: down"
    assert seen == [{"a": 1}] * 3 and waits == [1.0, 2.0, 3.0]
    assert inference.Options(batch_size=8, callers=4, rate=16.0).pause == 2.0 and inference.Options(rate=None).pause == 0.25


def test_questions_inference_and_summary(spark):
    rows = [(0, "ames", "", "CCO", "CCN", "C5.O5", "C5.N5", "O5", "N5"), (1, "", "", "a", "b", "c", "d", "e", "f"), (2, "ames", "", "CCCO", "CCCN", "C5.O5", "C5.N5", "O5", "N5.F")]
    pairs = spark.createDataFrame(rows, "row_idx bigint, dataset_name string, endpoint string, toxic_smiles string, nontoxic_smiles string, toxic_safe string, nontoxic_safe string, only_toxic_safe_fragments string, only_nontoxic_safe_fragments string")
    out = qa.build_all(pairs)
    assert out.count() == 10
    single = out.filter("task = 'task2' AND step = 'single_step'").collect()
    assert [(r["id"], r["source_index"]) for r in single] == [(0, 0)] and "SMILES = 'CCO'" in single[0]["question"]
    assert qa.skipped(pairs).collect()[0]["n_skipped"] == 1
    ask = qa.build_task(pairs, "task1").withColumn("id", F.col("source_index"))
    replies = {r["question"]: '{"answer": "O5"}' for r in ask.collect()}
    options, Client = inference.Options(retries=1, sleep=0.0), ReplayClient
    got = inference.run_inference(ask, lambda: Client(replies), "m", "task1", "single_step", options=options)
    s = scoring.summarize(got, scoring.metric_keys("task1", "single_step")).collect()[0]
    assert (s["total"], s["correct"], s["fragment_EM"], s["fragment_EM_Acc"]) == (2, 2, 1.0, 100.0)
    failed = inference.run_inference(ask, lambda: Client({}), "m", "task1", "multi_step", options=options).collect()
    assert all(r["pred"] is None and r["raw"].startswith("ERROR:") and r["fragment_F1"] == 0 for r in failed)
    done = spark.createDataFrame([(0, "O5", "x")], "id bigint, pred string, raw string")
    assert [r["id"] for r in inference.run_inference(ask, lambda: Client(replies), "m", "task1", "single_step", done=done, options=options).collect()] == [2]
    with pytest.raises(ValueError):
        scoring.metric_keys("task9", "single_step")


def test_molecule_scores_and_cliffs(spark):
    from pairwright.chem.base import PureBackend

    preds = spark.createDataFrame([(0, "CCO", "OCC"), (1, "CCO", "C("), (2, "CCO", "CCN")], "id bigint, gold string, pred string")
    rows = spark.createDataFrame([(0, "CCO"), (1, "CCO"), (2, "CCO")], "row_idx bigint, toxic_smiles string")
    got = {r["id"]: r for r in scoring.score_predictions(preds, "task3", "single_step", PureBackend(), rows).collect()}
    assert [got[0][k] for k in scoring.TASK3] == [1, 1, 0, 1, 1, 1, 1, 1]
    assert got[1]["validity"] == 0 and got[1]["levenshtein"] == 0 and got[1]["prs_property_score"] == 0
    assert got[2]["exact_match"] == 0 and 0 < got[2]["morgan_fts"] < 1 and got[2]["correct"] == 0
    mol = spark.createDataFrame([("d", "e", "toxic", f"CC(=O)N{'C' * n}OCCc1ccccc1") for n in (8, 9)] + [("d", "e", "nontoxic", f"CC(=O)N{'C' * n}OCCc1ccccc1") for n in (8, 9, 10)] + [("toxcast_df", "e", s, "CCO") for s in ("toxic", "nontoxic")], "dataset string, endpoint string, label string, smiles string")
    pairs = cliffs.mine_pairs(mol, PureBackend())
    assert pairs.count() == 6 and pairs.filter("dataset_name = 'toxcast_df'").count() == 0
    final = cliffs.build_cliffs(pairs, PureBackend())
    assert final.columns == list(schemas.FINAL_COLUMNS)


def test_files(spark, tmp_path):
    rows = [("a,b", 'say "hi"', "x\ny"), ("", None, "z")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", required=("p", "q"), index=True)
    assert sorted((r["p"] or "", r["q"] or "", r["r"]) for r in back.collect()) == sorted((a or "", b or "", c) for a, b, c in rows)
    with pytest.raises(ValueError, match="missing columns: zz"):
        files.read_csv(spark, f"{tmp_path}/c", required=("zz",))
    assert files.read_csv_or_none(spark, f"{tmp_path}/none") is None
    (tmp_path / "x.jsonl").write_text('\n$ {"a": 1}\n{"a": 2}\nbad\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="."):
        files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", skip_bad=False).collect()
    assert files.read_jsonl(spark, f"{tmp_path}/no.jsonl", "a int", allow_missing=True).count() == 0
    files.write_jsonl(spark.createDataFrame([("é", "s", "t")], "v string, split string, task string"), f"{tmp_path}/j", ("split", "task"))
    assert (tmp_path / "j" / "split=s" / "task=t").is_dir()
    assert files.read_shards(spark, f"{tmp_path}/c/*.csv").count() == 2
    assert files.qa_path("r", "test", "task1", "single") == "r/test/task1_toxic_fragment_identification/both_repre/single_step/task1_toxic_fragment_identification_qa.jsonl"
    assert files.qa_path("r", "test", "task3", "multi", flat=True) == "r/test/test_task3_smiles_gen_multi.jsonl"
    assert files.bundle_name("../a/b", descriptions=False) == "ab_no_desc" and files.parse_tasks("task1, task1,task2") == ["task1", "task2"]
    for bad in (lambda: files.under_root("/etc", str(tmp_path)), lambda: files.parse_tasks("nope"), lambda: files.normal_step("x")):
        with pytest.raises(ValueError):
            bad()
    assert files.append_or_reset(3, False, True) == "append" and files.append_or_reset(0, False, True) == "overwrite"
    assert [r["row_idx"] for r in schemas.with_row_index(spark.range(0, 50, 1, 7)).orderBy("id").collect()] == list(range(50))


def test_stream_equals_batch(spark, tmp_path):
    from pairwright.streaming import rescore

    rows = [("m", "task1", "single_step", i, "d", "e", i, "A.B", p, "") for i, p in enumerate(["B.A", "A", ""])]
    df = spark.createDataFrame(rows, rescore.SCHEMA)
    df.write.json(f"{tmp_path}/in")
    rescore.score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", "task1", "single_step").awaitTermination()
    key = lambda x: sorted((r["id"], r["fragment_EM"], r["correct"]) for r in x.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(scoring.score_predictions(df, "task1", "single_step"))
    assert rescore.summary_of(spark, f"{tmp_path}/out", "task1", "single_step").collect()[0]["total"] == 3


def test_cli_split(spark, tmp_path):
    from pairwright import cli

    df = spark.createDataFrame([(f"C{'C' * (i % 3)}c1ccccc1" if i % 2 else f"{'C' * i}O",) for i in range(1, 21)], "toxic_smiles string")
    files.write_csv(df.coalesce(1), f"{tmp_path}/in")
    both = cli.run(spark, cli.parser().parse_args(["split", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--backend", "pure"]))
    assert both.count() == 20 and files.read_csv(spark, f"{tmp_path}/out/train").count() == 20


def test_cli_questions_and_answers(spark, tmp_path):
    """Questions by split, answers from a client, and a second run that asks for nothing again."""
    from pairwright import cli

    client = tmp_path / "fixed_client.py"
    client.write_text("class Client:\n    def complete(self, system, user, schema, temperature):\n        return '{\"answer\": \"O5\"}'\n")
    spark.sparkContext.addPyFile(str(client))
    rows = [("ames", "", "CCO", "CCN", "C5.O5", "C5.N5", "O5", "N5")] * 3
    df = spark.createDataFrame(rows, "dataset_name string, endpoint string, toxic_smiles string, nontoxic_smiles string, toxic_safe string, nontoxic_safe string, only_toxic_safe_fragments string, only_nontoxic_safe_fragments string")
    files.write_csv(df, f"{tmp_path}/all")
    files.write_csv(df.limit(1), f"{tmp_path}/test")
    run = lambda *args: cli.run(spark, cli.parser().parse_args([*args, "--backend", "pure"]))
    made = run("qa", "--input", f"{tmp_path}/all", "--output", f"{tmp_path}/qa", "--tasks", "task1", "--split", "all", "--qa-set", "own", "--test-input", f"{tmp_path}/test")
    assert made.count() == 4
    questions = f"{tmp_path}/qa/own/train/task=task1/step=single_step"
    args = ("infer", "--input", questions, "--output", f"{tmp_path}/out", "--model", "m", "--client", "fixed_client:Client", "--task", "task1", "--sleep", "0", "--retries", "1")
    assert run(*args, "--num-samples", "2").count() == 2
    assert run(*args).count() == 1 and run(*args).count() == 0
    stored = files.read_jsonl(spark, f"{tmp_path}/out", cli.RECORDS)
    assert sorted((r["id"], r["pred"], r["correct"]) for r in stored.collect()) == [(k, "O5", 1) for k in range(3)]
    assert run(*args, "--reset").count() == 3


def test_safe_validity(spark):
    from pairwright.chem.base import PureBackend

    df = spark.createDataFrame([(0, "CCO"), (1, "C5.O5"), (2, "C("), (3, ""), (4, None)], "i int, t string")
    assert {r["i"]: r["validity"] for r in scoring.safe_validity(df, "t", PureBackend()).collect()} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
