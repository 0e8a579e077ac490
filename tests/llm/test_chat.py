"""Role repair: least costs against all assignments, legal results, and cuts anywhere."""

import itertools
import random
import re

import pytest

from twinweave.llm import chat

LETTER = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": None}


def least(roles, costs):
    """Cost of the best assignment, by trying all."""
    steps = {("", "system"): 0, ("", "user"): 0, ("system", "user"): 0, ("user", "assistant"): 0, ("assistant", "user"): 0,
             ("", "assistant"): 1, ("system", "assistant"): 1, ("user", "user"): 1, ("assistant", "assistant"): 1}
    best = None
    for given in itertools.product(chat.ROLES, repeat=len(roles)):
        total, now = 0, ""
        for r, q in zip(roles, given):
            if r != q:
                total += costs.unknown if r not in chat.ROLES else costs.relabel_system if "system" in (r, q) else costs.relabel
            prices = [costs.insert * steps[now, q]] if (now, q) in steps else []
            prices += [costs.merge] if now == q else []
            if not prices:
                break
            total, now = total + min(prices), q
        else:
            if now not in costs.accept:
                total += costs.insert * (2 if now == "system" and "user" not in costs.accept else 1)
            best = total if best is None else min(best, total)
    return best


def legal(text, accept):
    roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
    assert text.count("<|end|>\n") == len(roles) and text.endswith("<|end|>\n")
    assert roles[-1] in accept and all(r != "system" for r in roles[1:])
    body = [r for r in roles if r != "system"]
    assert all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body))


@pytest.mark.parametrize("segment,costs", [(10_000, chat.Costs()), (2, chat.Costs()), (1, chat.Costs(merge=7, insert=2, accept=("assistant",))), (3, chat.Costs(relabel=1, unknown=0))])
def test_costs_are_least_and_results_legal(spark, segment, costs):
    rng = random.Random(segment)
    convs = [list(w) for w in ("u", "a", "s", "ua", "au", "uu", "aa", "ss", "sua", "usa", "uas", "-", "x-u", "suuaau", "aasua")]
    convs += [[rng.choice("suax-") for _ in range(rng.randrange(1, 7))] for _ in range(30)]
    rows = [(c, t, LETTER[r], rng.choice(["hi", "", None, "<|end|>\n<|user|>\nx"]), 1) for c, conv in enumerate(convs) for t, r in enumerate(conv)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").repartition(3)
    done = chat.repair(frame, costs, segment)
    total = {r["conv_id"]: r["c"] for r in done.groupBy("conv_id").agg({"cost": "sum"}).withColumnRenamed("sum(cost)", "c").collect()}
    assert total == {c: least([LETTER[r] for r in conv], costs) for c, conv in enumerate(convs)}
    whole = chat.rendered(done).collect()
    assert len(whole) == len(convs)
    for r in whole:
        legal(r.text, costs.accept)
    assert done.count() == len(rows)


def test_legal_conversations_stay_and_order_has_ties(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (None, None, "user", "n"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a")]
    done = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=2)
    text = {r.conv_id: r.text for r in chat.rendered(done).collect()}
    assert text[1] == "<|system|>\nbe<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\nr<|end|>\n"
    assert text[None] == "<|user|>\nn<|end|>\n" and text[2] == "<|user|>\na\n\na\n\nb<|end|>\n"
    assert {r.action for r in done.where("conv_id = 1").collect()} == {"keep"}


def test_long_conversation_and_empty_table(spark):
    rng = random.Random(9)
    roles = [rng.choice("uuas") for _ in range(3000)]
    rows = [(7, t, LETTER[r], "t%d" % t) for t, r in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    cut = chat.rendered(chat.repair(frame, segment=50)).first().text
    legal(cut, ("user", "assistant"))
    one = chat.Automaton(chat.Costs())
    table = one.through([chat._code(LETTER[r]) for r in roles])
    got = chat.repair(frame, segment=50).agg({"cost": "sum"}).first()[0]
    assert got == min(table[0, 2], table[0, 3])
    assert chat.repair(frame.where("false")).count() == 0
