"""Small hand-made cases of the operators."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrywork.functions import paths as P
from quarrywork.operators import budgets as B
from quarrywork.operators import forest
from quarrywork.operators import graph as G
from quarrywork.operators import ordered
from quarrywork.operators import rollups as R
from quarrywork.sources import tree as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_path_parts(spark):
    assert one(spark, P.extension_of(F.col("p")), p="a/B.TS") == "ts"
    assert one(spark, P.extension_of(F.col("p")), p=".gitignore") == ""
    assert one(spark, P.parent_path(F.col("p")), p="a/b/c") == "a/b"
    assert one(spark, P.ancestors(F.col("p")), p="a/b/c") == ["a/b", "a", ""]
    assert one(spark, P.join_path(F.lit("a/b"), F.col("p")), p="../../../x") is None
    assert one(spark, P.join_path(F.lit("a/b"), F.col("p")), p="./../c") == "a/c"


def test_lines(spark):
    for text, n in (("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\rb", 1), ("\n\n", 2)):
        assert one(spark, P.count_lines(F.col("t")), t=text) == n
    assert one(spark, P.estimate_lines(F.col("n"), F.lit("python")), n=48) == 2


def test_categories(spark):
    cases = {
        "node_modules/a.js": "vendor", "img/a.png": "asset", "src/a.test.ts": "test", "tests/x.py": "test", "dist/a.js": "build", "docs/a.css": "docs",
        "docs/a.py": "source", "README": "docs", ".eslintrc": "config", "a.sql": "data", "Dockerfile.dev": "build",
    }
    df = spark.createDataFrame(list(cases.items()), ["path", "want"])
    wrong = df.filter(P.detect_category(F.col("path"), P.detect_language(F.col("path"))) != F.col("want")).collect()
    assert wrong == []


def test_unsafe_paths(spark):
    bad = ["", "/a", "a//b", "a/", "./a", "a/..", "a/%2E%2e/b", "a\x00b", "x" * 1025]
    df = spark.createDataFrame([(p,) for p in [*bad, "ok/a b.txt"]], ["path"])
    assert [r[0] for r in df.filter(P.acceptable(F.col("path"))).collect()] == ["ok/a b.txt"]


def test_first_entry_wins_in_any_order(spark):
    rows = [("r", "a.py", "file", 5, 2), ("r", "a.py", "file", 9, 1), ("r", "b", "symlink", 1, 3), ("r", "m", "submodule", 0, 4)]
    for order in (rows, rows[::-1]):
        tree = spark.createDataFrame(order, ["repo_id", "path", "type", "size", "ordinal"])
        assert [(r.path, r.size) for r in T.build_inventory(tree).collect()] == [("a.py", 9)]


def test_only_generated_files_all_count(spark):
    inventory = T.classify(spark.createDataFrame([("r", "vendor/a.js", 10)], ["repo_id", "path", "size"]))
    assert R.own_files(inventory).count() == 1


def test_cycles(spark):
    ring = [("r", f"n{i:03}", f"n{(i + 1) % 60:03}") for i in range(60)]
    more = [("r", "a", "b"), ("r", "b", "a"), ("r", "b", "n000"), ("r", "x", "y"), ("r", "y", "z"), ("r", "s", "s"), ("q", "a", "b")]
    edges = spark.createDataFrame(ring + more, ["repo_id", "source", "target"])
    found = [(r.repo_id, r.first, r.size, r.edges) for r in G.import_cycles(edges).orderBy("place").collect()]
    assert found == [("r", "n000", 60, 60), ("r", "a", 2, 2)]


def test_no_cycles(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c")], ["repo_id", "source", "target"])
    assert G.import_cycles(edges).count() == 0


def greedy(sizes, left):
    taken = []
    for x in sizes:
        taken.append(x <= left)
        left -= x * taken[-1]
    return taken


def test_byte_budget_takes_what_fits(spark, monkeypatch):
    rng, rows, want = random.Random(3), [], {}
    cases = [[], [0, 0, 5, 0], [7, 7, 7], [x for k in range(200, 0, -1) for x in (1, k)], [1 << 40, 3, 1 << 33, 2]]
    cases += [[rng.choice((rng.randrange(4), rng.randrange(50), rng.randrange(3000))) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    budgets = {}
    for i, sizes in enumerate(cases):
        budgets[f"r{i}"] = rng.choice((0, 1, 7, 300, 5000, sum(sizes)))
        rows += [(f"r{i}", 3 * j - 5, x, "z") for j, x in enumerate(sizes)]
        want |= {(f"r{i}", 3 * j - 5): t for j, (x, t) in enumerate(zip(sizes, greedy(sizes, budgets[f"r{i}"])))}
    df = spark.createDataFrame([*rows, ("no budget", 1, 1, "z")], "repo_id string, place int, size long, left string").drop("left")
    left = spark.createDataFrame(list(budgets.items()), "repo_id string, left long")
    want["no budget", 1] = False
    for few in (B.FEW, 0):
        monkeypatch.setattr(B, "FEW", few)
        assert {(r.repo_id, r.place): r.taken for r in B.byte_budget(df, left).collect()} == want
    assert {(r.place, r.taken) for r in B.byte_budget(df.filter("repo_id = 'r2'"), 15).collect()} == {(-5, True), (-2, True), (1, False)}


def test_byte_budget_rounds_do_not_grow_with_the_items(spark, monkeypatch):
    """Sizes 1, k, 1, k - 1, ... with room for half of them: every larger item just misses."""
    rounds = []
    monkeypatch.setattr(B, "_all_that_fit", lambda df, f=B._all_that_fit: rounds.append(1) or f(df))
    n = 100_000
    items = spark.range(2 * n).select(F.lit("r").alias("repo_id"), F.col("id").alias("place"), F.when(F.col("id") % 2 == 0, 1).otherwise(n - F.col("id") / 2).cast("long").alias("size"))
    got = B.byte_budget(items, n).filter("taken").agg(F.count("*"), F.sum("size")).first()
    sizes = [x for j in range(n) for x in (1, int(n - (2 * j + 1) / 2))]
    taken = [x for x, t in zip(sizes, greedy(sizes, n)) if t]
    assert got[:] == (len(taken), sum(taken)) and len(rounds) <= n.bit_length()


def test_places_over_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = ordered.placed(rows, "g", [F.desc("x")])
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"))))
    assert sorted(map(tuple, got.select("g", "x", "place").collect())) == sorted(map(tuple, plain.collect()))


def reachable(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b), todo.append(b)
        reach[n] = seen
    return reach


def test_components_in_tasks_and_over_tasks(spark, monkeypatch):
    rng = random.Random(21)
    want, rows = {}, []
    for repo in range(6):
        edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(20 + 12 * repo)}
        edges = {(a, b) for a, b in edges if a != b}
        reach = reachable(edges)
        for n, seen in reach.items():
            own = {m for m in seen if n in reach[m]}
            if len(own) > 1:
                want[f"r{repo}", n] = max(own)
        rows += [(f"r{repo}", a, b) for a, b in edges]
    df = spark.createDataFrame(rows, "repo_id string, source string, target string")
    for small in (G.SMALL, 45):
        monkeypatch.setattr(G, "SMALL", small)
        got = {(r.repo_id, r.node): r.component for r in G.strong_components(df).collect()}
        sizes = {}
        for (repo, _), c in got.items():
            sizes[repo, c] = sizes.get((repo, c), 0) + 1
        assert {k: c for k, c in got.items() if sizes[k[0], c] > 1} == want


def test_forest_by_doubling(spark):
    """Chains, stars and rings with trees below them, against a walk."""
    rng = random.Random(17)
    up = {("a", i): i - 1 if i else None for i in range(900)} | {("b", i): rng.randrange(i) if i else None for i in range(200)}
    up |= {("c", 0): None} | {("c", i): i % 9 + 1 if i < 10 else rng.randrange(1, i) for i in range(1, 80)}
    rows = spark.createDataFrame([(g, i, u) for (g, i), u in up.items()], "g string, id int, up int")

    def above(g, i):
        seen = []
        while i is not None and i not in seen:
            seen.append(i)
            i = up[g, i]
        return seen, i is None

    found, lost = forest.depths(rows, ["g"])
    assert {(r.g, r.id): r.depth for r in found.collect()} == {k: len(above(*k)[0]) - 1 for k in up if above(*k)[1]}
    assert {(r.g, r.id) for r in lost.collect()} == {k for k in up if not above(*k)[1]}
    assert {(r.g, r.id): r.least for r in forest.least_above(rows, ["g"], F.col("id") * 7 % 101).collect()} == {(g, i): min(j * 7 % 101 for j in above(g, i)[0]) for g, i in up}
    flagged = {("a", 880), ("b", 150), ("b", 3)}
    tree = rows.filter("g <> 'c'")
    got = forest.any_below(tree, ["g"], F.expr("g = 'a' AND id = 880 OR g = 'b' AND id IN (3, 150)"), 899)
    assert {(r.g, r.id) for r in got.collect()} == {(g, j) for g, i in flagged for j in above(g, i)[0]}


def test_redaction_works_each_step_out_once(spark):
    from quarrywork.functions import text as X

    texts = ["ghp_a1 x ghs_b", "ghp_ github_pat_x", "Bearer a.b, BASIC ghp_x; my_basic c basic", "https://u:ghp_p@h/?token=bearer x&sig=1=2", "https://u:basic p@h", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.redact_secrets(F.col("t")).alias("r"))
    assert [r.r for r in df.orderBy("i").collect()] == [
        "[REDACTED] x [REDACTED]", "ghp_ [REDACTED]", "Bearer [REDACTED], BASIC [REDACTED]; my_basic c basic", "https://[REDACTED]@h/?token=[REDACTED] [REDACTED]", "https://u:basic [REDACTED]", None, ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2
