"""Line rules, measures and what is made of them."""

import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.measures import measure_format, register_measure_format
from fleetlens.operators.lines import split_lines
from fleetlens.operators.telemetry import (
    measure_wide,
    node_error_text,
    node_series,
    op_mix,
    parse_measures,
    series_points,
    split_rejects,
    throughput,
    with_op_code,
)

ACCEPTED = {
    "[READ], 1000, 5.25, 120": ("READ", 1000, 5.25, 120),
    "[INSERT],2000,3,7,extra": ("INSERT", 2000, 3.0, 7),
    "[UPDATE], 10, 1.5, 3\t": ("UPDATE", 10, 1.5, 3),
    "[READ]x], 10, 1.5, 3": ("READ", 10, 1.5, 3),
    "[SCAN] , 10 ,\t1.5 , 3 , , ,": ("SCAN", 10, 1.5, 3),
    "[DELETE], 0, 0.5, 2147483647": ("DELETE", 0, 0.5, 2147483647),
    "[READ], 9999999999999, 1.25, 0000000000012": ("READ", 9999999999999, 1.25, 12),
    "[READ], 10, 1.5, 3\n": ("READ", 10, 1.5, 3),
    "[READ], 10, 1.5, 3\x00\x1f": ("READ", 10, 1.5, 3),
}
REJECTED = [
    " [READ], 10, 1.5, 3",
    "[READ], 10, 1.5",
    "[READ], 10, 1.5,",
    "[READ], 10, 1.5, 3.5",
    "[READ], 1.5, 1.5, 3",
    "[READ], 10, -1, 3",
    "[READ], 10, 1e3, 3",
    "[READ], 10, 1., 3",
    "[READ], 10, .5, 3",
    "[READ], 10, +1, 3",
    "[READ], 10, 1.5, 2147483648",
    "[READ], 12345678901234, 1.5, 3",
    "[READ], 10, 12345678901234, 3",
    "[read], 10, 1.5, 3",
    "[CLEANUP], 10, 1.5, 3",
    "[OVERALL], RunTime(ms), 10110",
    "[READ, 10, 1.5, 3]",
    "[READ]x, 10, 1.5, 3",
    "[READx], 10, 1.5, 3",
    "[READ ], 10, 1.5, 3",
    "[READ], 1, 1.5, 3\n[READ], 2, 1.5, 3",
    "[READ], 1, 1.5, 3, a\nb",
    "[READ],\n1, 1.5, 3",
    "[READ], ١, 1.5, 3",
    "[READ],, 1.5, 3",
    "",
    None,
]


def _rule(line):
    """The rule, clause by clause."""
    blanks = "".join(map(chr, range(33)))
    if not line or line[0] != "[" or "]" not in line or "," not in line:
        return None
    body = line.strip(blanks)
    if "\n" in body:
        return None
    tokens = [t.strip(blanks) for t in body.split(",")]
    if len(tokens) < 4 or tokens[0][:1] != "[" or tokens[0][-1:] != "]":
        return None
    if not re.fullmatch("[0-9]{1,13}", tokens[3]) or int(tokens[3]) > 2147483647:
        return None
    if not re.fullmatch(r"[0-9]{1,13}(\.[0-9]+)?", tokens[2]) or not re.fullmatch("[0-9]{1,13}", tokens[1]):
        return None
    op = body[1 : body.index("]")]
    if op not in ("INSERT", "UPDATE", "DELETE", "SCAN", "READ"):
        return None
    return op, int(tokens[1]), float(tokens[2]), int(tokens[3])


def _lines(spark, lines):
    rows = [("n", i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "node string, seq long, line string")


def test_accepted_and_rejected_lines(spark):
    lines = [*ACCEPTED, *REJECTED]
    got = {r.seq: (r.op, r.time, r.avg_latency, r.ops) for r in parse_measures(_lines(spark, lines)).collect()}
    want = {i: ACCEPTED[line] for i, line in enumerate(lines) if line in ACCEPTED}
    assert got == want
    assert {i: m for i, line in enumerate(lines) if (m := _rule(line))} == want


def test_rule_on_mutated_lines(spark):
    import random

    rng = random.Random(7)
    alphabet = "[]READINSERT,.0129 \t\nx"
    base = list(ACCEPTED)
    lines = []
    for _ in range(3000):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(line) + 1)
            line[at : at + rng.randint(0, 1)] = rng.choice(alphabet)
        lines.append("".join(line))
    got = {r.seq: (r.op, r.time, round(r.avg_latency, 3), r.ops) for r in parse_measures(_lines(spark, lines)).collect()}
    want = {i: m for i, line in enumerate(lines) if (m := _rule(line))}
    assert got.keys() == want.keys() and len(want) > 300
    for i, (op, time, mean, count) in want.items():
        assert got[i][:2] == (op, time) and got[i][3] == count and got[i][2] == pytest.approx(mean, rel=1e-6, abs=1e-3)


def test_lines_of_a_text(spark):
    cases = {
        "a\r\nb\n": ["a", "", "b"],
        "a\n\n": ["a", ""],
        "": [],
        None: [],
        "abcde": ["abcd", "e"],
        "abcd\n": ["abcd", ""],
        "abcd": ["abcd"],
        "abcdefgh\nx": ["abcd", "efgh", "", "x"],
        "\n": [""],
        "é€😀é€\rz": ["é€😀é", "€", "z"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    got = {i: [] for i in range(len(cases))}
    for r in split_lines(df, "t", max_chars=4).orderBy("id", "line_no").collect():
        assert r.line_no == len(got[r.id])
        got[r.id].append(r.line)
    assert list(got.values()) == list(cases.values())


def test_line_is_cut_at_one_mebi_characters(spark):
    cap = 1 << 20
    df = spark.createDataFrame([(1, "x" * (cap + 1)), (2, "x" * cap + "\n")], "id long, t string")
    got = split_lines(df, "t").select("id", "line_no", F.length("line").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, cap), (1, 1, 1), (2, 0, cap), (2, 1, 0)]


def test_every_line_is_measure_or_reject(spark):
    lines = spark.createDataFrame(
        [("a", 0, "[READ], 1, 1, 1"), ("a", 1, "oops"), ("b", 0, "[READ], 1, 1, 1"), ("b", 1, "[READ], 2, 1, 1"), ("b", 2, None)],
        "node string, seq long, line string",
    )
    failures = spark.createDataFrame([("b", 1)], "node string, failed_from long")
    measures, rejects = split_rejects(lines, failures)
    assert sorted((r.node, r.seq) for r in measures.collect()) == [("a", 0), ("b", 0)]
    assert sorted((r.node, r.seq) for r in rejects.collect()) == [("a", 1), ("b", 1), ("b", 2)]
    measures, rejects = split_rejects(lines)
    assert (measures.count(), rejects.count()) == (3, 2)


def test_wide_form_has_zero_for_absent(spark):
    wide = measure_wide(parse_measures(_lines(spark, ["[INSERT], 5, 1.5, 3"]))).first()
    assert (wide.insertcount, wide.insertaverage, wide.readcount, wide.readaverage, wide.time) == (3, 1.5, 0, 0.0, 5)
    assert [f for f in wide.asDict() if f.endswith("count")] == [
        f"{op}count" for op in ("insert", "update", "delete", "scan", "read")
    ]


def test_codes_of_operation_types(spark):
    lines = [f"[{op}], 1, 1, 1" for op in ("SCAN", "INSERT", "UPDATE", "DELETE", "READ")]
    got = with_op_code(parse_measures(_lines(spark, lines))).orderBy("seq").collect()
    assert [r.op_code for r in got] == [1, 2, 3, 4, 5]


def test_error_text_is_whole_and_in_order(spark):
    rows = [(n, i, f"<{i}>") for n in ("bad", "good") for i in range(1000)]
    rejects = spark.createDataFrame(rows, "node string, seq long, line string").repartition(7)
    status = spark.createDataFrame([("bad", 1), ("good", 0)], "node string, exit_status int")
    parts = node_error_text(rejects, status, lines_per_part=64).orderBy("part").collect()
    assert {p.node for p in parts} == {"bad"} and max(p.lines for p in parts) == 64
    assert "".join(p.error_text for p in parts) == "".join(f"<{i}>" for i in range(1000))


def test_series_shows_insert_values_only(spark):
    measures = parse_measures(_lines(spark, ["[READ], 1500, 2.5, 9", "[INSERT], 2500, 3.5, 4"]))
    assert [(r.x, r.y) for r in series_points(measures).orderBy("seq").collect()] == [(1.5, 0.0), (2.5, 4.0)]
    assert [(r.x, r.y) for r in series_points(measures, "latency", only_matching=True).collect()] == [(2.5, 3.5)]
    assert [(r.x, r.y) for r in series_points(measures, op="READ").orderBy("seq").collect()] == [(1.5, 9.0), (2.5, 0.0)]
    (series,) = node_series(measures).collect()
    assert [(p.x, p.y) for p in series.points] == [(1.5, 0.0), (2.5, 4.0)]


def test_throughput_weighs_latency_by_count(spark):
    lines = ["[READ], 0, 1, 1", "[READ], 999, 4, 3", "[READ], 1000, 7, 2", "[SCAN], 10, 5, 0"]
    rows = {(r.op, r.window_start): r for r in throughput(parse_measures(_lines(spark, lines)), 1000).collect()}
    first = rows["READ", 0]
    assert (first.measures, first.operations, first.ops_per_second, first.mean_latency) == (2, 4, 4.0, 3.25)
    assert rows["READ", 1000].mean_latency == 7.0 and rows["SCAN", 0].mean_latency is None


def test_op_mix_keeps_both_sides(spark):
    measures = parse_measures(_lines(spark, ["[READ], 0, 1, 3", "[SCAN], 0, 1, 1"]))
    wanted = spark.createDataFrame([("READ", 0.5), ("UPDATE", 0.5)], "op string, share double")
    got = {r.op: (r.operations, r.observed, r.requested, r.gap) for r in op_mix(measures, wanted).collect()}
    assert got == {"READ": (3, 0.75, 0.5, 0.25), "SCAN": (1, 0.25, 0.0, 0.25), "UPDATE": (0, 0.0, 0.5, -0.5)}


def test_formats_are_pluggable(spark):
    def plain(line):
        n = line.try_cast("long")
        return F.struct(n.alias("time"), F.when(n.isNotNull(), F.lit("READ")).alias("op"), F.lit(1).alias("ops"), F.lit(0).cast("float").alias("avg_latency"))

    register_measure_format("plain number", plain)
    got = parse_measures(_lines(spark, ["12", "x"]), "plain number").collect()
    assert [(r.seq, r.time, r.op) for r in got] == [(0, 12, "READ")]
    with pytest.raises(ValueError):
        register_measure_format("plain number", lambda line: line)
    with pytest.raises(ValueError):
        measure_format("unknown")


def test_format_is_evaluated_in_one_operator(spark):
    """Its parts are common subexpressions of that one projection; no filter repeats them."""
    plan = parse_measures(_lines(spark, ["x"]).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert [line.strip("+- ")[:7] for line in plan.splitlines() if "RLIKE" in line] == ["Project"]
