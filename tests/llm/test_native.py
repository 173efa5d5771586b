"""Decontamination, tool calls and mixing: brute force, hard rows, and no Python in their plans."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from custos.llm import decontaminate, mixing, toolcalls


def shingle_set(text, k=5):
    w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_containment_equals_brute_force(spark):
    import random
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(120)}"
    items = [(i % 37, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(45)] + [(50, None), (51, "w1 w2"), (52, "")]
    docs = []
    for i in range(120):
        text = [word() for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.6:
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randrange(3)):
                if part:
                    part[rnd.randrange(len(part))] = "CHANGED"
            text[rnd.randrange(len(text) + 1):0] = part
        docs.append((i, " ".join(text).title() if i % 9 == 0 else "\n".join(text)))
    docs += [(200, None), (201, ""), (202, "W1 w2"), (None, items[0][1] or "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted({(str(i), j, len(y), len(y & shingle_set(t))) for i, t in docs for j, u in items for y in [shingle_set(u)]
                   if y and 100 * len(y & shingle_set(t)) >= 80 * len(y)})
    got = sorted({(str(r.doc_id), r.item_id, r.n_shingles, r.n_found) for r in decontaminate.contained_items(d, b).collect()})
    assert got == want and len(want) > 20


def test_decontamination_hard_rows(spark, documents, nothing):
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7", 0), (None, "no id here", 0), (2, None, 0)], "item_id bigint, text string, mark int")
    kept = decontaminate.drop_contaminated(documents, items)
    assert kept.columns == documents.columns
    assert kept.count() == documents.count() - 5  # documents 1, 2, 3, 14 and the one without id
    assert decontaminate.drop_contaminated(documents, items.where("false")).count() == documents.count()
    assert decontaminate.drop_contaminated(nothing, items).count() == 0


def brute_budget(leaves, levels, weights, budget, epochs):
    """Top-down water-filling with exact integers: leaf -> budget."""
    def share(nodes, total, depth):
        if depth == len(levels):
            return {n: total for n in nodes}
        group = defaultdict(list)
        for n in nodes:
            group[n[depth]].append(n)
        cap = {g: epochs * sum(leaves[n] for n in ns) for g, ns in group.items()}
        group = {g: ns for g, ns in group.items() if cap[g] > 0}
        got, rest, left = {}, dict.fromkeys(group), total
        while rest:
            w = sum(weights[depth][g] for g in rest)
            full = [g for g in rest if cap[g] * w <= left * weights[depth][g]]
            if not full:
                got |= {g: left * weights[depth][g] // w for g in rest}
                break
            g = min(full, key=lambda g: (cap[g] / weights[depth][g], g))
            got[g], left = cap[g], left - cap[g]
            del rest[g]
        out = {}
        for g, ns in group.items():
            out |= share(ns, got[g], depth + 1)
        return out
    return share(list(leaves), budget, 0)


@pytest.mark.parametrize("budget", [0, 50, 500, 2000, 5000, 10**6])
def test_budgets_equal_brute_force(spark, budget):
    import random
    rnd = random.Random(budget)
    leaves = {(d, l, s): rnd.choice([0, 3, 40, 200]) for d in "ab" for l in ("x", "y", "z") for s in ("1", "2", "3") if rnd.random() < 0.8}
    weights = [{"a": 3, "b": 1}, {"x": 1, "y": 2, "z": 5}, {"1": 1, "2": 1, "3": 4}]
    rows = [(*k, v, weights[0][k[0]], weights[1][k[1]], weights[2][k[2]]) for k, v in leaves.items()]
    df = spark.createDataFrame(rows, "d string, l string, s string, tokens bigint, w_d bigint, w_l bigint, w_s bigint")
    got = {(r.d, r.l, r.s): r.budget for r in mixing.budgets(df, ["d", "l", "s"], budget, 3).collect()}
    want = brute_budget(leaves, "dls", weights, budget, 3)
    assert got == {k: want.get(k, 0) for k in leaves}
    assert sum(got.values()) <= min(budget, 3 * sum(leaves.values()))


def test_leaf_takes_whole_epochs_and_the_longest_prefix(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["en", None][i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = mixing.mix(df, {"l": F.col("lang")}, {"l": F.lit(1)}, percent=130, max_epochs=3, seed="s")
    got = {r.doc_id: r.copies for r in out.collect()}
    for lang in ("en", None):
        leaf = {i: len(t.split()) for i, t, x in rows if x == lang}
        total = sum(leaf.values())
        budget = out.where(F.col("lang").eqNullSafe(F.lit(lang))).first().leaf_budget
        whole, rest = divmod(budget, total)
        want = dict.fromkeys(leaf, whole)
        for i in sorted(leaf, key=lambda i: hashlib.md5(f"s|{whole}|{i}".encode()).hexdigest()):
            rest -= leaf[i]
            if rest < 0:
                break
            want[i] += 1
        assert {i: n for i, n in got.items() if i in leaf} == {i: n for i, n in want.items() if n}


def test_mixing_hard_rows(spark, documents, nothing):
    levels, weights = {"a": F.col("lang"), "b": F.col("source")}, {"a": F.lit(2), "b": F.lit(1)}
    out = mixing.mix(documents, levels, weights, percent=300, max_epochs=3)
    assert out.columns == [*documents.columns, "_n_tokens", "_copies", "leaf_budget"]
    some = documents.join(out.select("lang", "source").distinct(), documents["lang"].eqNullSafe(out["lang"])
                          & documents["source"].eqNullSafe(out["source"]), "left_semi")
    assert out.count() == some.count() and {r["_copies"] for r in out.collect()} == {3}
    assert mixing.mix(nothing, levels, weights).count() == 0


CALLS = "conversation bigint, call_id string, tool string, arguments string, parents array<string>"
SCHEMAS = [("t", "x", "number", True), ("t", "y", "string", False), ("t", "z", "array", False)]


def linked(spark, calls, results=(), schemas=SCHEMAS):
    return toolcalls.link(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), "call_id string, seq bigint, content string"),
                          spark.createDataFrame(list(schemas), "tool string, name string, type string, required boolean")).collect()


def test_linking_order_and_validation(spark):
    rows = linked(spark, [
        (1, "a", "t", '{"x": 1}', None), (1, "b", "t", '{"y":"é\\n", "x":2.50}', ["a"]), (1, "c", "t", "{}", ["b", "a", "zz"]),
        (1, "d", "t", '{"x":"no","q":1}', ["e"]), (1, "e", "t", '{"x":1,"z":[1, {"k":null}]}', ["d"]), (2, "f", "u", "[1]", ["f2", None]),
        (2, "g", "t", "oops", ["d"]), (2, None, "t", None, ["a"]), (2, "h", None, '{"x":null}', [])],
        [("a", 2, "late"), ("a", 1, "first"), ("b", 1, None), (None, 1, "lost"), ("none", 1, "orphan")])
    by = {r.call_id: r for r in rows}
    assert {k: by[k].level for k in "abcdefgh"} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0, "g": None, "h": 0}
    assert by["a"].n_results == 2 and by["b"].n_results == 1 and by["c"].n_results == 0 and by[None].level == 0
    assert by["a"].valid and by["b"].valid and by["c"].problems == ["missing x"]
    assert by["d"].problems == ["cycle", "wrong type x", "unexpected q"] and by["e"].problems == ["cycle"]
    assert by["f"].problems == ["arguments are no object", "unknown tool"] and by["g"].problems == ["cycle", "arguments are no object"]
    assert by["h"].problems == ["unknown tool"] and by[None].problems == ["arguments are no object"]
    assert by["a"].message == '{"arguments":{"x":1},"id":"a","result":"first","tool":"t"}'
    assert by["b"].message == '{"arguments":{"x":2.5,"y":"é\\n"},"id":"b","result":null,"tool":"t"}'
    assert by["g"].message == '{"arguments":"oops","id":"g","result":null,"tool":"t"}'
    for r in rows:
        assert list(json.loads(r.message)) == ["arguments", "id", "result", "tool"]


def test_every_result_is_a_row(spark):
    calls = spark.createDataFrame([(1, "a", "t", "{}", None), (2, "a", "t", "{}", None), (1, "b", "t", "{}", None)], CALLS)
    results = [("a", 2, "late"), ("a", 1, 'fir"st'), ("b", 1, None), (None, 1, "lost"), ("none", 1, "orphan"), ("a", 1, 'fir"st')]
    table = spark.createDataFrame(results, "call_id string, seq bigint, content string")
    rows = toolcalls.result_messages(calls, table).collect()
    assert [list(json.loads(r.message)) for r in rows] == [["content", "id", "seq"]] * len(results)
    got = [(m["id"], m["seq"], m["content"], r.problems) for r in rows for m in [json.loads(r.message)]]
    assert sorted(got, key=repr) == sorted([(*r, [] if r[0] in ("a", "b") else ["no such call"]) for r in results], key=repr)
    assert toolcalls.result_messages(calls.where("false"), table.where("false")).count() == 0
    # nothing of a hot identifier goes
    hot = spark.range(5000).select(F.lit("a").alias("call_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("content"))
    assert toolcalls.result_messages(calls, hot).select("message").distinct().count() == 5000


def test_a_long_chain_and_empty_tables(spark):
    rows = linked(spark, [(1, str(i), "t", '{"x":1}', [str(i - 1)]) for i in range(9)] + [(1, "3", "t", '{"x":1}', ["2"])])
    assert {(r.call_id, r.level) for r in rows} == {(str(i), i) for i in range(9)} and len(rows) == 10
    assert linked(spark, []) == [] and linked(spark, [], [("a", 1, "x")], []) == []


def test_thousands_of_turns_in_few_rounds(spark, monkeypatch):
    """Each turn names the three before it; the levels take few tables, however long the conversation."""
    made = []
    table = toolcalls.Scratch.table
    monkeypatch.setattr(toolcalls.Scratch, "table", lambda self, *a, **k: made.append(1) or table(self, *a, **k))
    calls = spark.range(5000).select(F.concat(F.lit("9:"), "id").alias("call_id"), F.transform(
        F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.concat(F.lit("9:"), F.col("id") - k)).alias("parents"))
    got = {r.call_id: r.level for r in toolcalls.levels(calls).collect()}
    assert got == {f"9:{i}": i for i in range(5000)} and len(made) < 40


def test_levels_equal_longest_paths(spark):
    """Random graphs with short cuts, with and without cycles, against longest paths by definition."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        n = rng.randint(2, 9)
        for c in range(n):
            others = range(n) if g % 3 == 0 else range(c)
            rows.append((f"{g}:{c}", [f"{g}:{p}" for p in others if rng.random() < 0.5]))
    parents = {c: set(p) & {c for c, _ in rows} for c, p in rows}
    want, level = {}, 0
    while new := {c for c in parents if c not in want and parents[c] <= set(want)}:
        want |= dict.fromkeys(new, level)
        level += 1
    got = toolcalls.levels(spark.createDataFrame(rows, "call_id string, parents array<string>")).collect()
    assert {r.call_id: r.level for r in got} == want and len(got) == len(want) < len(rows)


@pytest.mark.parametrize("name", ["op6_decontaminate", "op7_tool_calls", "op8_mixing", "op13_url_filter"])
def test_plans_have_no_python(spark, name):
    from custos.llm.queries import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
