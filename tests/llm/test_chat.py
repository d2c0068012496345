import random
import re
from itertools import product

from pyspark.sql import functions as F

from thalweg.llm import chat as C


def legal(roles):
    return re.fullmatch("s?(ua)*", "".join(r[0] for r in roles)) is not None and roles != ["system"]


def brute(codes):
    """Least cost over all repairs, by trying every role, merge and gap for each turn."""
    frontier = {"": (0, ())}  # the last role tells all that the rest depends on
    for c in codes:
        new = {}
        for cost, done in frontier.values():
            for role in C.ROLES:
                change = 0 if C._NAMES.get(c) == role else C.NAME if c == "?" else C.RELABEL
                options = [(done + gap + (role,), cost + change + C.INSERT * len(gap)) for n in range(3) for gap in product(C.ROLES, repeat=n)]
                if done and done[-1] == role:
                    options.append((done, cost + change + C.MERGE))
                for roles, total in options:
                    if re.fullmatch("s?(ua)*u?", "".join(r[0] for r in roles)) and total < new.get(roles[-1], (1 << 30,))[0]:
                        new[roles[-1]] = (total, roles)
        frontier = new
    return min(cost + {"system": 4, "user": 2, "assistant": 0}[last] for last, (cost, _) in frontier.items())


def parse(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def check(rows, segment, spark):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    out = C.repair(df, segment=segment).collect()
    assert len(out) == len(rows)
    convs = {}
    for r in out:
        convs.setdefault(r.conv_id, []).append(r)
    costs = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [(r.turn is not None, r.turn) for r in own] == sorted((r.turn is not None, r.turn) for r in own)
        text = "".join(r.piece for r in own)
        turns = parse(text)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns) == text
        assert legal([a for a, _ in turns])
        source = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        assert re.sub(r"\n", "", "".join(b for _, b in turns)) == "".join(r[3] or "" for r in source)
        codes = "".join(C.role_code(r[2]) for r in source)
        assert {r.cost for r in own} == {brute(codes)}, codes
        costs[conv] = own[0].cost
    return costs


def test_least_cost_and_rendering(spark):
    r = random.Random(3)
    names = ["user", "assistant", "system", "human", "gpt", "tool", None, " User "]
    rows = []
    for conv in range(150):
        for turn in range(r.randrange(1, 12)):
            rows.append((conv if conv else None, turn, r.choice(names), r.choice(["hi", "", None, f"t{turn}"]), 0))
    a = check(rows, 4096, spark)
    assert a == check(rows, 3, spark)


def test_known_repairs():
    def roles(codes):
        (states, cost) = C.chain([C.matrix(codes)])
        moves = [C.moves(c)[k] for c, k in zip(codes, C.path(codes, states[0], states[1]))]
        return [(m[3], m[4], m[5]) for m in moves], cost

    assert roles("ua") == ([("keep", "user", ()), ("keep", "assistant", ())], 0)
    assert roles("uua")[1] == 1 and roles("uua")[0][1][0] == "merge"
    assert roles("u")[1] == 2 and roles("a")[1] == 2 and roles("s")[1] == 4
    assert roles("?a") == ([("relabel", "user", ()), ("keep", "assistant", ())], 1)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(empty).collect() == []
    long = [(1, k, "user" if k % 2 == 0 else "assistant", "x", 0) for k in range(9000)]
    df = spark.createDataFrame(long + [(2, None, None, None, 0), (2, None, None, None, 0)], "conv_id long, turn long, role string, text string, n int")
    out = C.repair(df).collect()
    assert {r.cost for r in out if r.conv_id == 1} == {0} and sum(r.conv_id == 2 for r in out) == 2


def test_order_roles_and_segments(spark):
    """Null turns come first, then negative ones; white space around roles is no part of them; equal turns spread over segments."""
    rows = [(1, 0, "user", "c", 0), (1, -3, "assistant\t", "b", 0), (1, None, "user\n", "a", 0), (1, 5, "assistant", "d", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int").withColumn("m", F.lit(1)).withColumn("tie", F.lit(1))
    out = {r.text: r for r in C.repair(df).withColumn("text", F.regexp_extract("piece", "([a-d])<|([a-d])$", 0)).collect()}
    assert {r.cost for r in out.values()} == {0} and {r.action for r in out.values()} == {"keep"}
    assert {r.turn: (r.role, r.n_inserted) for r in out.values()} == {None: ("user", 0), -3: ("assistant", 0), 0: ("user", 0), 5: ("assistant", 0)}
    same = spark.createDataFrame([(None, None, "user", "x", 0)] * 50 + [(7, 1, "tool", None, 0)] * 9, "conv_id long, turn long, role string, text string, n int")
    check([tuple(r) for r in same.collect()], 4, spark)
    assert {r.cost for r in C.repair(same, segment=4).collect() if r.conv_id is None} == {49 + 2}
    assert C.repair(same, segment=4).where("conv_id is null").count() == 50


def test_rendering_where_turns_repeat(spark):
    """Positions put the pieces of one turn, of null turns and of turns that are no numbers together."""
    rows = [("1", "0", "user", "hello"), ("1", "0", "user", "again"), ("1", "0", "user", "there"), ("1", "x", "system", "rules"), ("1", None, "user", "late"), ("1", "2", "gpt", "yes")]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string").selectExpr("*", "7 as position", "1 as first")
    for segment in (4096, 2):
        out = sorted(C.repair(df, segment=segment).collect(), key=lambda r: r.position)
        assert [r.position for r in out] == list(range(6))
        turns = parse("".join(r.piece for r in out))
        assert [a for a, _ in turns] == ["system", "user", "assistant"]
        assert sorted(turns[1][1].split("\n")) == ["again", "hello", "late", "there"]
