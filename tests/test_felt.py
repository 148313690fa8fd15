import json
import random

import pytest
from pyspark.sql import functions as F

from evtlake.functions.felt import Kind, Types, canonical, decimal_text, number_text, signed_text
from evtlake.functions.selector import keccak256, selector
from evtlake.operators import decode
from evtlake.sources.abi import abi_catalog, abi_entries, checked, types_of


def decode_value(kind: Kind, felts: list[str], at: int) -> tuple[object, int]:
    """One value and the offset after it; ValueError if the data does not hold it."""
    if kind.name == "unit":
        return None, at
    if kind.name == "struct":
        out = {}
        for member, inner in zip(kind.members, kind.inner):
            out[member], at = decode_value(inner, felts, at)
        return out, at
    if at >= len(felts):
        raise ValueError("not enough elements")
    v = int(felts[at], 16)
    if kind.name == "array":
        if v > len(felts):
            raise ValueError("array longer than the data")
        out, at = [], at + 1
        for _ in range(v):
            item, at = decode_value(kind.inner[0], felts, at)
            out.append(item)
        return out, at
    if kind.name == "bytes":
        if at + v + 2 >= len(felts):
            raise ValueError("byte array longer than the data")
        raw = b"".join(int(f, 16).to_bytes(32, "big")[1:] for f in felts[at + 1 : at + 1 + v])
        size = int(felts[at + v + 2], 16)
        if 0 < size <= 31:
            raw += int(felts[at + v + 1], 16).to_bytes(32, "big")[-size:]
        return raw.decode("utf-8", "replace"), at + v + 3
    if kind.name == "enum":
        if v >= len(kind.members):
            raise ValueError("enum index out of range")
        value, end = decode_value(kind.inner[v], felts, at + 1)
        return {"variant": kind.members[v], "value": value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)}, end
    if kind.name == "u256":
        if at + 1 >= len(felts):
            raise ValueError("not enough elements")
        high = int(felts[at + 1], 16)
        if v >> 128 or high >> 128:
            raise ValueError("value out of range for u256")
        return str(v + (high << 128)), at + 2
    if kind.name == "felt":
        return hex(v), at + 1
    if kind.name == "bool":
        return v != 0, at + 1
    bits = int(kind.name[1:])
    if v >> bits and kind.name != "u128":
        raise ValueError(f"value out of range for {kind.name}")
    if kind.name[0] == "i" and v >> (bits - 1):
        v -= 1 << bits
    return (str(v) if bits == 128 else v), at + 1


def felts(*values):
    return [hex(v) for v in values]


def both(spark, type_name, values, types=None):
    """(value, error) by the column expression, and the Python value or its error."""
    kind = (types or Types()).resolve(type_name)
    df = spark.createDataFrame([(values,)], "data array<string>")
    row = decode.decoded(df, [("data", "v", kind)]).select(F.to_json(F.struct("v")).alias("v"), F.col("decode_error").alias("e")).first()
    try:
        mine = decode_value(kind, values, 0)[0]
    except ValueError as x:
        mine = x
    return json.loads(row["v"]).get("v"), row["e"], mine


def test_keccak_and_selector():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert selector("Transfer") == "0x99cd8bde557814842a3121e8ddfd433a539b8c9f14bf31ebf108d12e6196e9"


def test_canonical(spark):
    df = spark.createDataFrame([("0x0",), ("0x00",), ("0x000AbC",), ("0x" + "0" * 10 + "F" * 63,), (None,)], "f string")
    assert [r[0] for r in df.select(canonical(F.col("f"))).collect()] == ["0x0", "0x0", "0xabc", "0x" + "f" * 63, None]


@pytest.mark.parametrize(
    "type_name,values,want",
    [
        ("u8", [255], 255), ("u8", [0], 0), ("u16", [65535], 65535), ("u32", [2**32 - 1], 2**32 - 1), ("u64", [2**63], 2**63), ("u64", [2**64 - 1], 2**64 - 1),
        ("u128", [2**128 - 1], str(2**128 - 1)), ("core::integer::u256", [2**128 - 1, 2**128 - 1], str(2**256 - 1)), ("u256", [5, 0], "5"),
        ("i8", [255], -1), ("i8", [127], 127), ("i32", [4294967196], -100), ("i64", [2**64 - 1], -1), ("i128", [2**128 - 1], "-1"), ("i128", [2**127 - 1], str(2**127 - 1)),
        ("bool", [0], False), ("bool", [7], True), ("felt252", [2**251], hex(2**251)), ("Unknown", [10], "0xa"),
        ("ByteArray", [0, 0, 0], ""), ("ByteArray", [0, int.from_bytes(b"hi", "big"), 2], "hi"), ("ByteArray", [1, int.from_bytes(b"a" * 31, "big"), 0, 0], "a" * 31),
        ("ByteArray", [1, int.from_bytes(b"a" * 31, "big"), ord("b"), 1], "a" * 31 + "b"), ("ByteArray", [0, 65, 32], ""),
        ("core::array::Array::<u64>", [2, 7, 8], [7, 8]), ("Span<u256>", [1, 3, 0], ["3"]), ("Array<u8>", [0], []), ("(u8, bool)", [3, 1], {"0": 3, "1": True}), ("@Array<(u8, u8)>", [1, 4, 5], [{"0": 4, "1": 5}]),
    ],
)
def test_values(spark, type_name, values, want):
    got, error, mine = both(spark, type_name, felts(*values))
    assert error is None and got == want and mine == want


@pytest.mark.parametrize("type_name,values", [("u8", [256]), ("u32", [2**32]), ("u64", [2**64]), ("i8", [256]), ("u8", []), ("u256", [1]), ("Array<u8>", [3, 1]), ("ByteArray", [5, 1, 1]), ("Array<u8>", [2, 1, 256]), ("Array<u64>", [2**200, 1])])
def test_errors(spark, type_name, values):
    _, error, mine = both(spark, type_name, felts(*values))
    assert error is not None and isinstance(mine, ValueError)


def test_bytes_that_are_no_text(spark):
    got, error, mine = both(spark, "ByteArray", felts(0, 0xFFFE, 2))
    assert error is None and "�" in got and "�" in mine


def test_enum(spark):
    types = Types(enums={"E": [("None", "()"), ("Some", "u64")]})
    assert both(spark, "E", felts(0), types)[0] == {"variant": "None"}
    assert both(spark, "E", felts(1, 9), types)[0] == {"variant": "Some", "value": "9"}
    assert both(spark, "E", felts(2), types)[1] is not None


ABI = [
    {"type": "event", "name": "a::Posted", "kind": "struct", "members": [{"name": "sender", "type": "ContractAddress", "kind": "key"}, {"name": "lists", "type": "Array<Array<u8>>"}]},
    {"type": "event", "name": "a::Any", "kind": "enum", "variants": []},
    {"type": "struct", "name": "a::State", "members": [{"name": "score", "type": "u64"}, {"name": "active", "type": "bool"}]},
    {"type": "event", "name": "a::Changed", "kind": "struct", "members": [{"name": "state", "type": "a::State", "kind": "data"}]},
    {"type": "interface", "name": "i", "items": [{"type": "function", "name": "get", "state_mutability": "view", "outputs": [{"type": "u64"}, {"type": "bool"}]}, {"type": "function", "name": "set", "state_mutability": "external", "outputs": []}]},
]


@pytest.mark.parametrize("text", [json.dumps(ABI), json.dumps({"abi": ABI}), json.dumps({"abi": json.dumps(ABI)})])
def test_catalog(spark, text):
    catalog = abi_catalog(abi_entries(spark.createDataFrame([("a", text)], "abi_name string, text string")))
    names = {(r["kind"], r["name"]) for r in catalog.collect()}
    assert names == {("event", "Posted"), ("event", "Changed"), ("struct", "State"), ("function", "get")}
    assert catalog.where("name = 'Posted'").first()["selector"] == selector("Posted")
    kinds = decode.kinds_of(catalog, types_of(catalog))
    assert [m for _, m, _ in kinds["a", "get"]] == ["output_0", "output_1"]
    assert kinds["a", "Changed"][0][2] == Kind("struct", (Kind("u64"), Kind("bool")), ("score", "active"))


def test_abi_name_clash(spark):
    two = [dict(ABI[0]), dict(ABI[0], name="b::Posted")]
    with pytest.raises(ValueError):
        checked(abi_catalog(abi_entries(spark.createDataFrame([("a", json.dumps(two))], "abi_name string, text string"))))


def test_events_with_nested_arrays_and_failures(spark):
    catalog = abi_catalog(abi_entries(spark.createDataFrame([("a", json.dumps(ABI))], "abi_name string, text string")))
    contracts = spark.createDataFrame([("x", "0x1", "a")], "contract_name string, contract_address string, abi_name string")
    rules = spark.createDataFrame([("x", "Posted"), ("x", "Changed")], "contract_name string, event_name string")
    p, c = selector("Posted"), selector("Changed")
    rows = [(1, "0xa", "0x1", [p, "0x5"], felts(2, 1, 9, 0), None, 1), (1, "0xb", "0x1", [p, "0x5"], felts(1, 7), "", 2), (1, "0xc", "0x1", [c], felts(4, 1), "ACCEPTED_ON_L1", 3), (1, "0xd", "0x2", [c], [], None, 4), (1, "0xe", "0x1", [], [], None, 5)]
    raw = spark.createDataFrame(rows, "block_number bigint, transaction_hash string, contract_address string, keys array<string>, data array<string>, finality_status string, event_seq bigint")
    tables, failed = decode.decode_events(raw, contracts, catalog, rules)
    posted, changed = tables["Posted"].collect(), tables["Changed"].collect()
    assert [(r["log_index"], r["lists"], r["status"]) for r in posted] == [(0, [[9], []], "ACCEPTED_ON_L2")]
    assert [(r["log_index"], r["state"]["score"], r["status"]) for r in changed] == [(1, 4, "ACCEPTED_ON_L1")]
    assert [r["transaction_hash"] for r in failed.collect()] == ["0xb"]


def test_number_text(spark):
    df = spark.createDataFrame([("12",), ("0x1f",), ("0x0",), ("0x" + "f" * 20,), ("x",), (None,), ("-3",)], "t string")
    assert [None if r[0] is None else int(r[0]) for r in df.select(number_text(F.col("t"))).collect()] == [12, 31, 0, 16**20 - 1, None, None, -3]


def test_wide_integers_as_text(spark):
    values = [0, 1, 2**64 - 1, 2**64, 10**18, 10**36, 10**36 - 1, 2**127 - 1, 2**127, 2**128 - 1, 10**54, 2**256 - 1, *(random.Random(4).getrandbits(n) for n in range(60, 257, 7))]
    df = spark.createDataFrame([(i, f"{v:x}" if v else "") for i, v in enumerate(values)] + [(99, None), (100, "1" * 65)], "i int, h string").orderBy("i")
    rows = df.select(decimal_text(F.col("h")), decimal_text(F.col("h"), 1), signed_text(F.col("h"))).collect()
    assert [r[0] for r in rows] == [str(v) for v in values] + [None, None] and [r[1] for r in rows if r[1] != str(2**256)][: len(values) - 1] == [str(v + 1) for v in values if v != 2**256 - 1]
    assert all(r[2] == str(v - 2**128 if v >> 127 else v) for r, v in zip(rows, values) if v < 2**128)
    assert "Python" not in df.select(decimal_text(F.col("h")))._jdf.queryExecution().executedPlan().toString()


def test_wide_integers_read_their_digits_once(spark):
    df = spark.createDataFrame([("ff",)], "h string")
    for text in (decimal_text(F.upper("h")), decimal_text(F.upper("h"), 1), signed_text(F.upper("h"))):
        assert df.select(text)._jdf.queryExecution().analyzed().toString().count("upper(h#") == 1


def test_arrays_of_wide_integers_need_no_python(spark):
    wide = [2**256 - 1, 0, 2**200 + 5]
    row = [hex(3), *(x for v in wide for x in (hex(v & 2**128 - 1), hex(v >> 128)))]
    df = spark.createDataFrame([(row, [])], "data array<string>, keys array<string>")
    out = decode.decoded(df, [("data", "v", Types().resolve("Array<u256>"))])
    assert out.first()["v"] == [str(v) for v in wide] and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_events_of_compiled_and_python_types_are_numbered_together(spark):
    """Of two events one holds arrays of byte arrays; failed rows take no number."""
    def event(name, kind):
        return {"type": "event", "name": f"m::{name}", "kind": "struct", "members": [{"name": "v", "type": kind, "kind": "data"}]}

    text = json.dumps([event("A", "u8"), event("B", "Array<ByteArray>"), {"type": "event", "name": "m::C", "kind": "struct", "members": []}])
    catalog = checked(abi_catalog(abi_entries(spark.createDataFrame([("x", text)], "abi_name string, text string"))))
    contracts = spark.createDataFrame([("c", "0x1", "x")], "contract_name string, contract_address string, abi_name string")
    rules = spark.createDataFrame([("c", e) for e in "ABC"], "contract_name string, event_name string")
    data = [("A", ["0x5"]), ("B", ["0x1", "0x0", "0x6869", "0x2"]), ("A", ["0x100"]), ("C", []), ("B", ["0x9"]), ("A", ["0x7"])]
    raw = spark.createDataFrame([(1, f"0x{i}", "0x1", [selector(e)], d, "", i) for i, (e, d) in enumerate(data)], "block_number bigint, transaction_hash string, contract_address string, keys array<string>, data array<string>, finality_status string, event_seq bigint")
    rows, failed = decode.decode_events(raw, contracts, catalog, rules)
    assert {(r["log_index"], r["v"]) for r in rows["A"].collect()} == {(0, 5), (3, 7)}
    assert {(r["log_index"], tuple(r["v"])) for r in rows["B"].collect()} == {(1, ("hi",))}
    assert [r["log_index"] for r in rows["C"].collect()] == [2] and {r["event_seq"] for r in failed.collect()} == {2, 4}


def test_events_meet_one_table_of_the_configuration(spark, monkeypatch):
    """Broadcast while it is small, joined by shuffle beyond the bound; the same rows both ways."""
    from evtlake.sources import config

    catalog = checked(abi_catalog(abi_entries(config.config_table(spark, [("a", json.dumps(ABI))], "abi_name string, text string"))))
    contracts = config.config_table(spark, [("x", "0x1", "a"), ("y", "0x2", "none")], "contract_name string, contract_address string, abi_name string")
    rules = config.config_table(spark, [("x", "Posted"), ("x", "Changed"), ("y", "Posted")], "contract_name string, event_name string")
    rows = [(i, a, [selector(e)] if e else []) for i, (a, e) in enumerate([("0x1", "Posted"), ("0x1", "Changed"), ("0x2", "Posted"), ("0x3", "Posted"), ("0x1", None), (None, "Posted")])]
    raw = spark.createDataFrame(rows, "event_seq bigint, contract_address string, keys array<string>")
    seen = []
    for bound in (config.BROADCAST_ROWS, 1):
        monkeypatch.setattr(config, "BROADCAST_ROWS", bound)
        out = decode.matched(raw, contracts, catalog, rules)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (bound > 1)
        seen.append(sorted((r["event_seq"], r["contract_name"], r["event_name"]) for r in out.collect()))
    assert seen[0] == seen[1] == [(0, "x", "Posted"), (1, "x", "Changed")]
    assert config.config_table(spark, [], "a int, m map<string,string>").collect() == []
    assert config.config_table(spark, [(1, {"k": "v"}), (None, None)], "a int, m map<string,string>").collect() == [(1, {"k": "v"}), (None, None)]


NESTED = Types(structs={"S": [("a", "u8"), ("b", "ByteArray")]}, enums={"E": [("none", "()"), ("one", "u16"), ("many", "Array<u8>"), ("text", "ByteArray")]})
VARYING = ["Array<ByteArray>", "Array<Array<u8>>", "Array<E>", "Array<S>", "(u8, Array<ByteArray>, felt)", "Array<Array<ByteArray>>", "Array<(u256, Array<i8>)>"]


def encoded(r, kind):
    """Elements of a random value of a kind, now and then broken."""
    odd = r.random() < 0.02
    if kind.name == "struct":
        return [x for k in kind.inner for x in encoded(r, k)]
    if kind.name == "array":
        n = r.randrange(4)
        return [hex(n + odd), *(x for _ in range(n) for x in encoded(r, kind.inner[0]))]
    if kind.name == "bytes":
        n, size = r.randrange(3), r.randrange(32)
        chunk = lambda k: hex(int.from_bytes(bytes(r.choice(b"abc\xc3\xa9 ") for _ in range(k)), "big") + (7 << 248 if r.random() < 0.1 else 0))
        return [hex(n + 9 * odd), *(chunk(31) for _ in range(n)), chunk(size), hex(size if r.random() < 0.95 else 40)]
    if kind.name == "enum":
        v = r.randrange(len(kind.members))
        return [hex(v + 9 * odd), *encoded(r, kind.inner[v])]
    if kind.name == "unit":
        return []
    if kind.name == "u256":
        return [hex(r.randrange(2**128)), hex(r.randrange(2**128) << odd)]
    return [hex((r.randrange(2 ** (7 if kind.name[1:] == "8" else 16 if kind.name == "u16" else 250)) << 60 * odd) % 2**252)]


@pytest.mark.parametrize("type_name", VARYING)
def test_varying_arrays_equal_the_plain_decoder(spark, type_name):
    """Values, and which rows fail, over random data with broken lengths, indexes and sizes; no Python in the plan."""
    r, kind = random.Random(type_name), NESTED.resolve(type_name)
    rows = [encoded(r, kind) for _ in range(150)]
    rows += [x[: r.randrange(len(x) + 1)] for x in rows[:40]] + [[]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, data array<string>")
    out = decode.decoded(df, [("data", "v", kind)])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    good = 0
    for row in out.select("i", F.to_json(F.struct("v"), {"ignoreNullFields": "false"}).alias("v"), "decode_error").collect():
        try:
            want = decode_value(kind, rows[row["i"]], 0)[0]
        except ValueError:
            assert row["decode_error"] is not None, rows[row["i"]]
            continue
        assert row["decode_error"] is None and json.loads(row["v"])["v"] == json.loads(json.dumps(want)), (row, want)
        good += 1
    assert good > 60


def test_wide_chunks_and_broken_elements(spark):
    wide = ["0x1", "0x7" + "41" * 31, "0x0", "0x0"]
    for type_name, values in (("ByteArray", wide), ("Array<ByteArray>", ["0x1", *wide])):
        value, error, mine = both(spark, type_name, values)
        assert error is None and value == mine and (value if type_name == "ByteArray" else value[0]) == "A" * 31
    for values in (["0xzz"], ["12"], [""], ["0x"], [None], ["0x1", None], ["0x1", "0xzz"], ["0x" + "1" * 65]):
        for type_name in ("Array<ByteArray>", "u8", "Array<u8>", "ByteArray"):
            df = spark.createDataFrame([(values,)], "data array<string>")
            row = decode.decoded(df, [("data", "v", Types().resolve(type_name))]).first()
            assert row["decode_error"] is not None or (type_name == "u8" and values == ["0x1", None])
