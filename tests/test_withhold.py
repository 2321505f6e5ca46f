import random

from lectern.operators import withhold as W


def in_turn(hits, runs, refusals, most):
    """Run by run, step by step, with a set of what was shown."""
    out = {}
    for run in {h[1] for h in hits}:
        chosen, asked = runs.get(run, (None, None))
        log = []
        for step in sorted({h[2] for h in hits if h[1] == run}):
            now = [h for h in hits if h[1] == run and h[2] == step]
            resumed = asked is not None and step > asked
            shown = {h[4:6] + (h[6][:2500] if h[6] is not None else None,) for h in log if h[3] and not (resumed and h[4] == chosen and h[2] <= asked)}
            last = [b for _, _, b in sorted((s, o, b) for r, s, o, b in refusals if r == run and s < step)][-most:]
            exempt = lambda h: h[4] is not None and any(b in (h[4], h[4].split(" — ")[0]) for b in last)
            held = {h[0] for h in now if h[3] and h[4:6] + (h[6][:2500] if h[6] is not None else None,) in shown and not exempt(h)}
            if len(held) == len(now):
                held = set()
            out |= {h[0]: h[0] in held for h in now}
            log += now
    return out


def test_withheld_is_a_run_in_turn(spark):
    rng = random.Random(6)
    books = ["A — X", "B — Y", "C", None]
    hits = [(i, rng.randrange(12), rng.randrange(6), rng.random() < 0.7, rng.choice(books), rng.choice(["s", None]), rng.choice(["t", "u" * 2500 + "v", "u" * 2500 + "w", None])) for i in range(500)]
    runs = {r: (rng.choice(books[:3]), rng.randrange(5)) for r in range(0, 12, 2)}
    refusals = [(rng.randrange(12), rng.randrange(6), o, rng.choice(["A", "A — X", "B", "B — Z", "C", "Q", "Q", "Q"])) for o in range(60)]
    got = W.withheld(
        spark.createDataFrame(hits, "hit_id int, run int, step int, card boolean, book string, section string, text string"),
        spark.createDataFrame([(r, *x) for r, x in runs.items()], "run int, chosen string, asked_step int"),
        spark.createDataFrame(refusals, "run int, step int, ord int, book string"), 3,
    )
    want = in_turn(hits, runs, refusals, 3)
    found = {r.hit_id: r.withheld for r in got.collect()}
    assert found == want and 60 < sum(want.values()) < 400
