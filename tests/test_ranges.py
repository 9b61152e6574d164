"""Records of one file that many tasks read, against readers that take a file as a whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyform.sources import ranges
from tallyform.sources.readers import read_delimited, read_json
from tallyform.workload import queries


@pytest.fixture(params=[61])
def small_ranges(spark, request):
    """Byte ranges so small that most records cross some."""
    with_small = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    for k, v in with_small.items():
        spark.conf.set(k, v)
    yield request.param
    for k in with_small:
        spark.conf.unset(k)


def messy(rnd, sep, eol):
    def value():
        kind = rnd.random()
        body = "".join(rnd.choices(["a", "é", " ", "x1", "日", ".", "-"], k=rnd.randint(0, 6)))
        if kind < 0.35:
            return body
        if kind < 0.45:
            return body + 'b"' + body  # a quote inside of a value that does not begin with one
        inner = "".join(rnd.choices(["a", sep, '""', "\n", eol, " ", "long " * 10, f'{sep}""'], k=rnd.randint(0, 6)))
        return f'"{inner}"'

    lines = [sep.join(["id", "one", "two"])]
    for i in range(30):
        fields = [str(i), value(), value()]
        if rnd.random() < 0.1:
            fields.append("more")
        lines.append(sep.join(fields[: rnd.choice([1, 2, 3, 3, 3, 3, 3, 4])]))
        if rnd.random() < 0.1:
            lines.append("")
    return eol.join(lines) + (eol if rnd.random() < 0.5 else "")


@pytest.mark.parametrize("seed", range(3))
def test_delimited_text_equals_a_reader_of_whole_files(spark, tmp_path, small_ranges, seed):
    rnd = random.Random(seed)
    sep, eol = rnd.choice(",;|\t"), ["\n", "\r\n"][seed % 2]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"f{k}.csv").write_bytes(messy(rnd, sep, eol).encode())
    path = str(tmp_path / "in")
    one = read_delimited(spark, path, sep, split_lines=False, index="pos", drop_blank=False)
    many = read_delimited(spark, path, sep, index="pos", drop_blank=False)
    assert ranges.pieces(spark, path, "\n").rdd.getNumPartitions() > 3
    # the other reader turns line ends inside of values into the file's own
    plain = [F.translate(F.col(f"`{c}`").cast("string"), "\r", "") for c in one.columns]
    assert sorted(map(repr, many.select(*plain).collect())) == sorted(map(repr, one.select(*plain).collect()))


def test_every_range_of_a_long_quoted_value(spark, tmp_path, small_ranges):
    text = "line\n" * 300
    (tmp_path / "x.csv").write_text(f'id,t\n1,"{text}"\n2,b\n')
    rows = {r.id: r.t for r in read_delimited(spark, str(tmp_path / "x.csv"), rest=None).collect()}
    assert rows == {"1": text, "2": "b"}


def test_state_behind_a_line():
    cases = [
        ('a,b', False, False), ('"a', False, True), ('"a"', False, False), ('a"b', False, False), ('x,"', False, True), ('"a""', False, True), ('"a"""', False, False),
        ('"a"b"c', False, False), ('"a",",', False, True), ('b', True, True), ('b"', True, False), ('b""', True, True), ('b"",c', True, True), ('b",c', True, False), ('b","', True, True), ('', True, True), ('', False, False),
    ]
    for line, before, after in cases:
        assert ranges.ends_inside(line, before, ",") == after, (line, before)


def value(rnd, depth):
    text = "".join(rnd.choices(["a", "}", "{", "[", "]", '"', "\\", "\n", "é", ":", ',"data":[', "日"], k=rnd.randint(0, 6)))
    kind = rnd.randint(0, 6 if depth else 3)
    if kind < 4:
        return [text, rnd.randint(0, 99), None, True][kind]
    if kind == 4:
        return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {f"k{n}{rnd.choice(['', '}', chr(34)])}": value(rnd, depth - 1) for n in range(rnd.randint(0, 3))}


def records(rnd, n):
    return [{"id": i, "v": value(rnd, 3)} if rnd.random() < 0.9 else value(rnd, 2) for i in range(n)]


def shown(found):
    return sorted(json.dumps(x, sort_keys=True) for x in found if isinstance(x, dict))


@pytest.mark.parametrize("seed", range(3))
def test_documents_equal_a_parser_of_whole_files(spark, tmp_path, small_ranges, seed):
    rnd = random.Random(seed)
    (tmp_path / "in").mkdir()
    want, indent = [], [None, 1, None, 2][seed]
    for k in range(3):
        found = records(rnd, 15)
        want += found
        document = found
        if k % 2:
            lists = [("orders", records(rnd, 3)), ("records", found), ("other", records(rnd, 4)), ("meta", {"records": [{"x": {"y": 1}}], "z": {"a": {"b": 2}}}), ("n", 1), ("deep", [[{"a": [{}]}]])]
            rnd.shuffle(lists)
            document = dict(lists)
        (tmp_path / "in" / f"f{k}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=bool(k % 2)) + "\n" * (k % 3), encoding="utf-8")
    got, bare = ranges.document_records(spark, str(tmp_path / "in"), ("records", "data", "orders"))
    assert shown(json.loads(r.text) for r in got.collect()) == shown(want) and bare == []


def test_documents_without_records(spark, tmp_path, small_ranges):
    path = tmp_path / "x.json"
    path.write_text('{"id": 1, "v": {"a": [1, {"b": 2}]}, "w": "}"}')
    got, bare = ranges.document_records(spark, str(path), ("records",))
    assert got.count() == 0 and len(bare) == 1
    assert [(r.id, r.w) for r in read_json(spark, str(path)).collect()] == [(1, "}")]
    path.write_text('{"data": [], "orders": [{"a": 1}]}')
    assert ranges.document_records(spark, str(path), ("data", "orders"))[0].count() == 0


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id"', '[{"id": 1}', '{"data":[{"a":1}]', '[{"id": "x}]', '[{"a":1}]]', 'a,b\n', '[{"a":1}]}'])
def test_broken_documents_fail(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="not a JSON document"):
        ranges.document_records(spark, str(path), ("data",))


def test_a_document_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(20000).select(F.struct("id", F.array(F.lit("}]"), F.lit('"')).alias("v")).alias("r")).collect()
    (tmp_path / "x.json").write_text(json.dumps({"data": [r.r.asDict() for r in rows]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert ranges.pieces(spark, str(tmp_path / "x.json"), "}").rdd.getNumPartitions() > 4
        df = read_json(spark, str(tmp_path / "x.json"))
        assert df.count() == 20000 and df.select(F.sum("id")).first()[0] == 199990000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ranges_of_a_document_are_read_by_tasks_of_their_own(spark, tmp_path, small_ranges):
    """What a range does is found where it is read; only a row for each comes together."""
    (tmp_path / "x.json").write_text(json.dumps([{"id": n, "s": "}]"} for n in range(40)]))
    found = ranges.pieces(spark, str(tmp_path / "x.json"), "}")
    states = ranges.document_states(found)
    assert states.count() == found.rdd.getNumPartitions() > 3
    assert "Coalesce 1" not in plan(states) and "REPARTITION_BY_NUM" in plan(states)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_read_together_or_one_by_one(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        text = "".join(rnd.choices([*'{}[]"\\ a:,', '"k":[', '{"a":', "},", "日"], k=rnd.randint(0, 30)))
        string, stack, base = rnd.random() < 0.4, rnd.choices("{[", k=rnd.randint(0, 4)), rnd.choice([1, 2])
        one, over, many = (ranges._Scan(string, stack) for _ in range(3))
        events, at = [], 0
        for piece in text.split("}"):
            begins, ends, _ = one.piece(piece, base)
            if begins is not None:
                events.append((len(text[: at + begins].encode()), 0))
            at += len(piece) + 1
            events += [(len((text + "}")[: at - 1].encode()), 1)] * ends
        over.pass_over(text + "}")
        assert (over.string, over.stack, over.under) == (one.string, one.stack, one.under), text
        found = many.events((text + "}").encode(), base)
        if found is None:  # not JSON: escapes outside of strings, or more brackets closed than were open
            assert (many.string, many.stack) == (string, stack)
        else:
            # a piece tells the last of several beginnings, of which only a document that is not JSON has more than one
            assert set(events) <= {e for e in found if e[1] < 2}, text
            assert (many.string, many.stack) == (one.string, one.stack), text


def test_a_record_with_escapes_outside_of_strings_is_still_cut(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": "\\\\"}, \\ {"a": "\\"}]"}]')
    got, bare = ranges.document_records(spark, str(tmp_path / "x.json"), ())
    assert sorted(r.text for r in got.collect()) == ['{"a": "\\"}]"}', '{"a": "\\\\"}'] and bare == []


def written(spark, tmp_path, monkeypatch, name, tables):
    """Rows of a query over tables of several files, and the text files that it made of them."""
    for t, rows in tables.items():
        rows.repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, kind: str(tmp_path / kind))
    for k, v in {"spark.sql.files.openCostInBytes": "128m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = [d for d in tmp_path.iterdir() if not d.name.endswith(".parquet")]
    return rows, [f for d in made for f in d.iterdir() if f.name.startswith("part-")]


def test_json_arrays_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    lines = spark.range(60).selectExpr("id div 3 l_orderkey", "cast(id % 3 as int) l_linenumber", "id l_partkey", "1.0d l_quantity", "'R' l_returnflag")
    rows, files = written(spark, tmp_path, monkeypatch, "source_json_array", {"lineitem": lines})
    assert sorted((r.l_orderkey, r.l_linenumber, r.l_partkey) for r in rows) == [(n // 3, n % 3, n) for n in range(60)]
    assert len(files) > 1 and sum(len(json.loads(f.read_text())) for f in files) == 20


def test_wrapped_documents_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows, files = written(spark, tmp_path, monkeypatch, "source_json_wrapped", {"customer": spark.range(30).selectExpr("id c_custkey")})
    assert sorted(r.c_custkey for r in rows) == list(range(30))
    assert len(files) > 1 and sum(len(json.loads(f.read_text())["records"]) - 1 for f in files) == 30


def test_ranges_of_text_are_read_by_tasks_of_their_own(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text("id;t\n" + "".join(f'{n};"a\n{n}"\n' for n in range(40)))
    found = ranges.pieces(spark, str(tmp_path / "x.csv"), "\n")
    states = ranges.line_states(found, ";", True)
    assert 3 < states.count() <= found.rdd.getNumPartitions()  # a range may have no beginning of a line
    assert "Coalesce 1" not in plan(states) and "REPARTITION_BY_NUM" in plan(states)


def test_quoted_text_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    docs = spark.range(30).selectExpr("id doc_id", "concat('a, ', id, '\\n') text", "'en' lang", "'s' source", "5L n_chars")
    rows, files = written(spark, tmp_path, monkeypatch, "source_delimited_quoted", {"documents": docs})
    assert sorted((int(r.doc_id), r.text) for r in rows) == [(n, f'"a", "{n}\n"') for n in range(30)]
    assert len(files) > 1


ORDERS = "id o_orderkey", "id o_custkey", "'O' o_orderstatus", "1.5d o_totalprice", "timestamp'2024-01-01' o_orderdate", "'5-LOW' o_orderpriority"


def test_ragged_text_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    orders = {"orders": spark.range(60).selectExpr(*ORDERS), "customer": spark.range(60).selectExpr("id c_custkey")}
    rows, files = written(spark, tmp_path, monkeypatch, "source_delimited_ragged", orders)
    assert sorted(int(r.row) for r in rows) == list(range(60))
    assert {int(r.row) for r in rows if r.extra_fields is not None} == set(range(0, 60, 7))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and sum(not line.strip(" |") for line in lines) == 12


def test_ragged_text_of_no_rows(spark, tmp_path, monkeypatch):
    orders = {"orders": spark.range(0).selectExpr(*ORDERS), "customer": spark.range(0).selectExpr("id c_custkey")}
    rows, files = written(spark, tmp_path, monkeypatch, "source_delimited_ragged", orders)
    assert rows == [] and files


def test_positions_over_several_files(spark, tmp_path, monkeypatch):
    rows, files = written(spark, tmp_path, monkeypatch, "source_delimited_tabs", {"customer": spark.range(30).selectExpr("29 - id c_custkey", "id c_name")})
    assert sorted((r.pos, int(r.c_custkey), int(r.c_name)) for r in rows) == [(n, n, 29 - n) for n in range(30)]
    assert len(files) > 1
