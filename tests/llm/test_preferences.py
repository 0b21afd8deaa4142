from sparkveil.llm import preferences

TURNS = "pair_id long, side int, conv_id long, turn long, role string, text string, c string, prompt string"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_pairs(spark):
    shared = [("system", "Be brief."), ("user", "Hello\nthere")]
    talks = {
        (1, 0): [*shared, ("assistant", "Hi!"), ("user", "More"), ("assistant", "Ok \U0001f600")],
        (1, 1): [*shared, ("assistant", "What?")],
        (2, 0): [("user", "Only chosen")],
        (3, 1): [("assistant", "Only rejected")],
        (4, 0): shared, (4, 1): shared,
        (5, 0): [(None, None), ("user", "a")], (5, 1): [(None, None), ("user", "b")],
        (6, 0): [("user", "x")], (6, 1): [("user", "x"), ("assistant", "y" * 100_000)],
    }
    rows = [(p, s, 10 * p + s, k, r, t, "clash", "clash") for (p, s), turns in talks.items() for k, (r, t) in enumerate(turns)]
    got = {r["pair_id"]: r for r in preferences.pairs(spark.createDataFrame(rows[::-1], TURNS)).collect()}
    assert set(got) == {p for p, _ in talks}
    for p, r in got.items():
        sides = [talks.get((p, s)) for s in (0, 1)]
        n = 0
        while all(s is not None and n < len(s) for s in sides) and sides[0][n] == sides[1][n]:
            n += 1
        assert (r["n_shared"], r["prompt"]) == (n, render((sides[0] or [])[:n]))
        for name, s in zip(("chosen", "rejected"), sides):
            if s is None:
                assert r[name] is None and r[f"{name}_mask"] is None and r[f"{name}_conv"] is None
                continue
            assert r[name] == render(s[n:])
            at, trained = 0, ""
            for run in r[f"{name}_mask"]:
                trained += r[name][at : at + run["n_chars"]] if run["train"] else ""
                at += run["n_chars"]
            assert at == len(r[name])
            assert trained == "".join(f"{t}<|end|>\n" for role, t in s[n:] if role == "assistant")


def test_ties_and_rows_without_a_conversation(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, "user", "z"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = preferences.pairs(preferences.neighbours(df)).collect()
    assert r["chosen"] == render([("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert preferences.pairs(preferences.neighbours(df.limit(0))).count() == 0


def test_native_plan(spark, sf):
    plan = preferences.op6_preferences(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Join"))
