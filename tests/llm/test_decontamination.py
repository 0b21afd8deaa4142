import random

from sparkveil.llm import decontamination as d

from . import brute

DOCS = "doc_id long, text string, item_id string, overlap string, words string"
BENCH = "item_id long, text string, doc_id string, words string"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", None, None) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x", None) for i, t in items], BENCH)


def want(docs, items):
    out = {}
    for i, t in docs:
        for k, b in items:
            if (found := brute.leak(brute.tokens(t), brute.tokens(b))) is not None:
                old = out.get((i, k), (0, 10**9))
                out[i, k] = (max(old[0], found[0]), min(old[1], found[1]))
    return sorted((*k, *v) for k, v in out.items())


def test_masks_see_any_two_substitutions():
    for a in range(13):
        for b in range(13):
            ignored = {k % 4 for k in (a, b)}
            assert any(not ignored & set(kept) for kept in d.masks(13, 2))


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"wört{k}" for k in range(60)] + ["the", "of", "12"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(14, 40)))) for k in range(12)]
    items += [(100, "five short words of item"), (101, "too short"), (102, None), (103, ""), (104, "one, two! three four five - six seven eight")]
    docs = []
    for k in range(120):
        words = say(rng.randrange(0, 80))
        if k % 2:
            part = brute.tokens(rng.choice(items[:12])[1])[rng.choice([0, 0, 3]) :][: rng.choice([11, 12, 13, 14, 40])]
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                part[rng.randrange(len(part))] = "swapped"
            words[len(words) // 2 :] = part
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w.upper() if k % 5 == 0 else w for w in words)))
    docs += [(200, "here are FIVE short -- words; of item and more"), (201, "four short words of item"), (202, "one two three four five six seven eight"), (203, None), (204, ""), (205, "word " * 3000 + items[0][1])]
    docs += [(206, "one two three four five swapped seven eight"), (207, "one two swapped four five swapped seven eight"), (208, "five short swapped of item")]
    docs += [(1, docs[1][1]), (None, items[2][1]), (None, "nothing")]
    got = d.leaks(*frames(spark, docs, items), ["doc_id"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["item_id"], r["overlap"], r["doc_start"]) for r in got), key=key) == sorted(want([x for x in docs if x[0] is not None], items) + [(None, *w[1:]) for w in want([(0, items[2][1])], items)], key=key)
    some = d.leaks(*frames(spark, docs, items), ["doc_id"], block_windows=7)
    assert sorted(map(str, some.collect())) == sorted(map(str, got)), "in blocks"


def test_remove_leaks(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, f"before {passage} after"), (2, "clean text"), (2, f"{passage}"), (None, passage), (None, "clean too"), (3, None)]
    df, bench = frames(spark, docs, [(1, passage)])
    for rows in (d.BROADCAST_ROWS, 0):
        left = d.remove_leaks(df, bench, broadcast_rows=rows)
        assert left.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(2, "clean text"), (None, "clean too"), (3, None)], key=str)
    assert d.remove_leaks(df, bench.limit(0)).count() == len(docs) and d.remove_leaks(df.limit(0), bench).count() == 0


def test_native_plan(spark, sf):
    plan = d.op9_decontaminate(spark, sf)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
