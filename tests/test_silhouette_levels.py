import random

from locuslake.operators import evaluate, graph


def test_labelings_together_equal_each_alone(spark):
    r = random.Random(9)
    rows = {(min(a, b), max(a, b)): r.randint(0, 12) for a, b in ((r.randint(0, 30), r.randint(0, 30)) for _ in range(120)) if a != b}
    both = graph.symmetrised(spark.createDataFrame([(u, v, w) for (u, v), w in rows.items()], "u long, v long, w int"))
    lab = [(level, x, x % (2 + level)) for level in range(3) for x in range(31)]
    lab.append(lab[0])  # a sample listed twice
    labels = spark.createDataFrame(lab, "level int, id long, label long")
    together = evaluate.silhouettes(both, labels, ("level",))
    got = sorted(tuple(x) for x in together.select("level", "id", "label", "s").collect())
    want = sorted((d, x.id, x.label, x.s) for d in range(3) for x in evaluate.silhouettes(both, labels.where(f"level = {d}")).collect())
    assert got == want
    # pairs are listed by labeling after they have been moved, not before
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(theirs" in plan
