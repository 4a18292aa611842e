from collections import defaultdict

from relspark.llm import chat
from tests.test_entry import same

SCHEMA = "pair_id long, turn long, role string, text string, rank int, place string"


def test_query(spark, sf):
    same(spark, sf, "op6", chat.op6_chat, chat.SQL)


def sort_key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")


def brute(chosen, rejected):
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (chosen, rejected), strict=True):
        for pair, _, role, text in sorted(rows, key=sort_key):
            side[pair].append((role, text))
    out = []
    for pair in {*sides[0], *sides[1]}:
        a, b = sides[0][pair], sides[1][pair]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        for part, turns in (("prompt", enumerate(a[:k])), ("chosen", enumerate(a[k:], k)), ("rejected", enumerate(b[k:], k))):
            for place, (role, text) in turns:
                head = f"<|{role or ''}|>\n"
                learnt = part != "prompt" and role == "assistant"
                span = (len(head), len(head) + len(text or "") + 7) if learnt else (None, None)
                out.append((pair, part, place, role, f"{head}{text or ''}<|end|>\n", *span))
    return sorted(out, key=str)


def test_pairs(spark):
    shared = [(2, 0, "user", "same"), (2, 1, "assistant", "same"), (None, 0, None, "n"), (6, 0, "user", "u"), (6, 1, "assistant", "a")]
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "good é"), (3, 0, "user", "x"), (None, 1, "assistant", None)]
    a += [*shared, (4, 5, "user", "only here"), (6, 0, "user", "u")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (3, 0, "user", "y"), (3, 1, "assistant", "z"), (None, 1, "assistant", "")]
    b += [*shared, (5, 0, "assistant", "only there")]
    frame = lambda rows: spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    out = sorted((tuple(r) for r in chat.preference(frame(a), frame(b)).collect()), key=str)
    assert out == brute(a, b)
    assert chat.preference(frame(a).limit(0), frame(b).limit(0)).count() == 0


def test_loss_covers_the_reply(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "r"), (2, 1, "assistant", "other"), (2, 2, "user", "bye"), (3, 0, "user", "none")]
    df = spark.createDataFrame(turns, "pair_id long, turn long, role string, text string")
    rows = chat.against_next_reply(df).collect()
    covered = {(r.pair_id, r.part): r.rendered[r.loss_from : r.loss_to] for r in rows if r.loss_from is not None}
    assert covered == {(1, "chosen"): "good<|end|>", (1, "rejected"): "other<|end|>", (2, "chosen"): "other<|end|>", (2, "rejected"): "good<|end|>"}
    assert sum(r.part == "prompt" for r in rows) == 3


def brute_replies(turns):
    """Chosen and rejected turns, numbered anew, from plain lists."""
    talks = defaultdict(list)
    for pair, _, role, text in sorted(turns, key=sort_key):
        talks[pair].append((role, text))
    order = sorted((p for p, t in talks.items() if any(role == "assistant" for role, _ in t)), key=lambda p: (p is None, p or 0))
    at = {p: max(k for k, (role, _) in enumerate(talks[p]) if role == "assistant") for p in order}
    rejected = dict(talks)
    for k, p in enumerate(order):
        after = order[(k + 1) % len(order)]
        rejected[p] = [*talks[p][: at[p]], talks[after][at[after]]]
    return [[(p, k, *x) for p, t in side.items() for k, x in enumerate(t)] for side in (talks, rejected)]


def test_next_replies_with_nulls_ties_and_repeated_rows(spark):
    turns = [
        (1, 0, "user", "q"), (1, None, "assistant", "no number"), (1, 1, "user", "more"),
        (2, None, "user", "x"), (2, None, "assistant", "y"), (2, None, "user", "z"),
        (3, 0, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "c"), (3, 1, "assistant", "b"), (3, 1, "user", "w"),
        (None, 0, "user", "n"), (None, 1, "assistant", None), (None, 1, "assistant", None), (4, 0, None, "only"),
        (5, 0, "assistant", "y"), (6, 2, "assistant", "y"), (6, 3, "user", "bye"),
        *[(7, 1, "user", "same")] * 50, (7, 2, "assistant", "end"), (8, 1, "assistant", ""),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "pair_id long, turn long, role string, text string, place int")
    assert sorted((tuple(r) for r in chat.against_next_reply(df).collect()), key=str) == brute(*brute_replies(turns))


def test_sides_with_nulls_ties_and_repeated_rows(spark):
    both = [(1, None, "user", "q"), (1, 0, "user", "p"), (1, 0, "user", "p"), (3, None, "assistant", "r")]
    a = [*both, (1, 0, "user", None), *[(2, 0, "user", "x")] * 3]
    b = [*both, (1, 0, "user", ""), (2, 5, "user", "x"), (2, 6, "user", "x"), (3, None, "assistant", "r")]
    frame = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in chat.preference(frame(a), frame(b)).collect()), key=str) == brute(a, b)


def test_texts_cross_few_shuffles(spark, sf):
    plan = chat.op6_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2") <= 2 and "Python" not in plan and "Pandas" not in plan
