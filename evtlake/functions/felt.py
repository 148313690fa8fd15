"""Field elements ('0x' and hexadecimal digits) as typed columns.

`compiled` turns a type into a column expression over an array of elements at an offset that may itself be a column, so
that decoding stays in the JVM; arrays of elements of varying size are folds that carry the offset and the values so far.
Each decoder gives a value and an error text, null where all is well.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A resolved type: name is felt, u8..u256, i8..i128, bool, bytes, unit, array, struct or enum."""

    name: str
    inner: tuple[Kind, ...] = ()
    members: tuple[str, ...] = ()

    @property
    def width(self) -> int | None:
        """Elements used; None if that depends on the data."""
        if self.name in ("bytes", "array", "enum"):
            return None
        if self.name == "struct":
            widths = [k.width for k in self.inner]
            return None if None in widths else sum(widths)
        return {"unit": 0, "u256": 2}.get(self.name, 1)


# Type names of the source language.
PRIMITIVES = {
    "felt252": "felt", "felt": "felt", "ContractAddress": "felt", "ClassHash": "felt", "EthAddress": "felt", "StorageAddress": "felt", "bytes31": "felt",
    "bool": "bool", "ByteArray": "bytes", "u8": "u8", "u16": "u16", "u32": "u32", "usize": "u32", "u64": "u64", "u128": "u128", "u256": "u256",
    "i8": "i8", "i16": "i16", "i32": "i32", "i64": "i64", "i128": "i128",
}


@dataclass
class Types:
    """Struct and enum definitions by full name: lists of (member, type name)."""

    structs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    enums: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def resolve(self, name: str) -> Kind:
        name = name.strip().lstrip("@")
        if m := re.fullmatch(r"(?:[\w:]*::)?(?:Array|Span)(?:::)?<(.*)>", name):
            return Kind("array", (self.resolve(m[1]),))
        if name == "()":
            return Kind("unit")
        if name.startswith("(") and name.endswith(")"):
            parts = _split(name[1:-1])
            return Kind("struct", tuple(map(self.resolve, parts)), tuple(map(str, range(len(parts)))))
        if (short := name.rpartition("::")[2]) in PRIMITIVES:
            return Kind(PRIMITIVES[short])
        for known, kind in ((self.structs, "struct"), (self.enums, "enum")):
            if name in known:
                return Kind(kind, tuple(self.resolve(t) for _, t in known[name]), tuple(m for m, _ in known[name]))
        return Kind("felt")


def _split(text: str) -> list[str]:
    """At commas outside of brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def digits(felt: Column) -> Column:
    """Lower-case hexadecimal digits without leading zeros."""
    return F.ltrim(F.lower(F.substring(felt, 3, 100)), F.lit("0"))


def canonical(felt: Column) -> Column:
    h = digits(felt)
    return F.when(h == "", F.lit("0x0")).otherwise(F.concat(F.lit("0x"), h))


def limb(felt: Column, i: int) -> Column:
    """The i-th 64 bits of an element as decimal(20,0), from the low end."""
    h = F.lpad(digits(felt), 64, "0")
    return F.conv(F.substring(h, 49 - 16 * i, 16), 16, 10).cast("decimal(20,0)")


#: Decimal digits of one part of a wide integer.
PART = 18


def decimal_text(hex_digits: Column, plus: int = 0) -> Column:
    """Decimal digits of at most 64 hexadecimal ones without leading zeros, plus a small number; null for more.

    Up to 16 digits are converted at once. Of longer ones the limbs of 64 bits are multiplied by the decimal parts of their
    weights, and the sums of each part's products are carried from the low end. The digits are computed once, and only the
    limbs that a number has.
    """

    def sized(h: Column) -> Column:
        size = F.length(h)
        short = F.conv(F.when(h == "", F.lit("0")).otherwise(h), 16, 10)
        first = F.when(size <= 16, _wide_text(h, 1, plus) if plus else short)
        return first.when(size <= 32, _wide_text(h, 2, plus)).when(size <= 64, _wide_text(h, 4, plus))

    return let(hex_digits, sized)


def _wide_text(h: Column, limbs: int, plus: int) -> Column:
    """`decimal_text` of hexadecimal digits that fill at most so many limbs of 64 bits. A part's products add up to less than
    4 * 2**64 * 10**18, which 38 digits hold."""
    number = lambda n, digits: F.lit(Decimal(n)).cast(f"decimal({digits},0)")
    base, parts = number(10**PART, 19), -(-len(str(2 ** (64 * limbs) + plus)) // PART)
    weight = lambda part, i: 2 ** (64 * i) // 10 ** (PART * part) % 10**PART

    def total(padded: Column, part: int) -> Column:
        limb = lambda i: F.conv(F.substring(padded, 16 * (limbs - i - 1) + 1, 16), 16, 10).cast("decimal(20,0)")
        own = [limb(i) * number(weight(part, i), PART) for i in range(limbs) if weight(part, i)]
        return reduce(Column.__add__, own, number(plus if part == 0 else 0, 38)).cast("decimal(38,0)")

    def carried(padded: Column, whole: Column, part: int, after: list[Column]) -> Column:
        """The text of this part and those above it, before the parts below."""
        if part == parts - 1:
            return F.concat(whole.cast("string"), *after)

        def split(s: Column) -> Column:
            low = s % base
            over = ((s - low) / base).cast("decimal(38,0)")  # divided without a remainder, so nothing is rounded
            return carried(padded, (total(padded, part + 1) + over).cast("decimal(38,0)"), part + 1, [F.lpad(low.cast("string"), PART, "0"), *after])

        return let(whole, split)

    text = let(F.lpad(h, 16 * limbs, "0"), lambda padded: F.ltrim(carried(padded, total(padded, 0), 0, []), F.lit("0")))
    return let(text, lambda t: F.when(t == "", F.lit("0")).otherwise(t))


def signed_text(hex_digits: Column) -> Column:
    """Two's complement of 128 bits as decimal digits."""

    def sized(h: Column) -> Column:
        negative = (F.length(h) == 32) & F.substring(h, 1, 1).isin(*"89abcdef")
        others = F.ltrim(F.translate(h, "0123456789abcdef", "fedcba9876543210"), F.lit("0"))
        return F.when(negative, F.concat(F.lit("-"), decimal_text(others, 1))).otherwise(decimal_text(h))

    return let(hex_digits, sized)


def _bits(name: str) -> int:
    return int(name[1:])


def scalar(kind: Kind, felt: Column) -> tuple[Column, Column]:
    h = digits(felt)
    none = F.lit(None).cast("string")
    if kind.name == "felt":
        return canonical(felt), none
    if kind.name == "bool":
        return h != "", none
    bits = _bits(kind.name)
    too_long = F.when(F.length(h) > bits // 4, F.lit(f"value out of range for {kind.name}"))
    if kind.name == "u128":
        return decimal_text(h), none  # no range check, as in the data model
    if kind.name == "i128":
        return signed_text(F.when(F.length(h) <= 32, h)), too_long
    number = F.when(F.length(h) <= bits // 4, F.conv(F.when(h == "", F.lit("0")).when(F.length(h) <= 16, h), 16, 10)).cast("decimal(20,0)")
    if kind.name[0] == "i":
        number = F.when(number >= F.lit(Decimal(2 ** (bits - 1))), number - F.lit(Decimal(2**bits))).otherwise(number).cast("bigint")
    elif bits < 64:
        number = number.cast("bigint")
    return number, too_long


def _add(a: Column | int, b: Column | int) -> Column | int:
    return a + b


def compiled(kind: Kind, src: Column, at: Column | int) -> tuple[Column, Column, Column | int]:
    """(value, error, offset after it)."""
    none = F.lit(None).cast("string")

    def element(offset: Column | int) -> Column:
        return F.try_element_at(src, (offset + 1) if isinstance(offset, Column) else F.lit(offset + 1))

    missing = lambda offset: F.when(element(offset).isNull(), F.lit("not enough elements"))
    if kind.name == "unit":
        return none, none, at
    if kind.name == "u256":
        low, high = digits(element(at)), digits(element(_add(at, 1)))
        error = F.when((F.length(low) > 32) | (F.length(high) > 32), F.lit("value out of range for u256"))
        value = decimal_text(F.ltrim(F.concat(high, F.lpad(low, 32, "0")), F.lit("0")))
        return F.when(error.isNull(), value), F.coalesce(missing(at), missing(_add(at, 1)), error), _add(at, 2)
    if kind.name == "bytes":
        n = _count(element(at))
        chunks = F.transform(F.slice(src, (F.lit(at) if isinstance(at, int) else at) + 2, F.coalesce(n, F.lit(0))), lambda c: F.right(F.lpad(digits(c), 64, "0"), F.lit(62)))
        tail = F.lit(at) + 1 + n if isinstance(at, int) else at + 1 + n
        size = _count(element(tail + 1))
        rest = F.when((size > 0) & (size <= 31), F.right(F.lpad(digits(element(tail)), 64, "0"), size * 2)).otherwise(F.lit(""))
        value = F.make_valid_utf8(F.unhex(F.concat(F.array_join(chunks, ""), rest)).cast("string"))
        error = F.when(n.isNull() | (n > F.size(src)) | size.isNull(), F.lit("byte array longer than the data"))
        return F.when(error.isNull(), value), error, tail + 2
    if kind.name == "array":
        inner, n = kind.inner[0], _count(element(at))
        if inner.width is None:
            return _folded(inner, src, F.lit(at) if isinstance(at, int) else at, n)
        start = (F.lit(at) if isinstance(at, int) else at) + 1
        fits = n.isNotNull() & (start + n * inner.width <= F.size(src))
        places = F.when(fits & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        value = F.transform(places, lambda i: compiled(inner, src, start + i * inner.width)[0])
        errors = F.transform(places, lambda i: compiled(inner, src, start + i * inner.width)[1])
        error = F.when(~fits, F.lit("array longer than the data")).otherwise(F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1)))
        return F.when(fits, value), error, start + F.coalesce(n, F.lit(0)) * inner.width
    if kind.name == "struct":
        values, errors = [], []
        for member, inner in zip(kind.members, kind.inner):
            value, error, at = compiled(inner, src, at)
            values.append(value.alias(member))
            errors.append(error)
        return F.struct(*values), F.coalesce(*errors, none), at
    if kind.name == "enum":
        index = _count(element(at))
        after = _add(at, 1)
        value, error, end = none, F.lit("enum index out of range"), F.lit(after) if isinstance(after, int) else after
        picked = F.lit(None).cast("struct<variant:string,value:string>")
        for i, (variant, inner) in enumerate(zip(kind.members, kind.inner)):
            v, e, n = compiled(inner, src, after)
            text = none if inner.name == "unit" else F.to_json(F.struct(v.alias("v")))
            text = text if inner.name == "unit" else F.get_json_object(text, "$.v")
            hit = index == i
            picked = F.when(hit, F.struct(F.lit(variant).alias("variant"), text.alias("value"))).otherwise(picked)
            error = F.when(hit, e).otherwise(error)
            end = F.when(hit, n if isinstance(n, Column) else F.lit(n)).otherwise(end)
        return picked, error, end
    value, error = scalar(kind, element(at))
    return value, F.coalesce(missing(at), error), _add(at, 1)


def _count(felt: Column) -> Column:
    """A length as int; null if missing or above 2**28."""
    h = digits(felt)
    return F.when(F.length(h) <= 7, F.conv(F.when(h == "", F.lit("0")).otherwise(h), 16, 10).cast("int"))


def _folded(inner: Kind, src: Column, at: Column, n: Column) -> tuple[Column, Column, Column]:
    """`compiled` for an array of n elements that vary in size. After an error the offset is null, and so is all that follows."""
    item = spark_type(inner)
    shape = f"struct<at:int,items:array<{item}>,error:string>"

    def step(acc: Column, _: Column) -> Column:
        value, error, end = compiled(inner, src, acc["at"])
        failed = F.coalesce(acc["error"], error)
        end = end if isinstance(end, Column) else F.lit(end)
        more = F.when(failed.isNull(), F.array_append(acc["items"], value.cast(item))).otherwise(acc["items"])
        return F.struct(F.when(failed.isNull(), end).alias("at"), more.alias("items"), failed.alias("error")).cast(shape)

    fits = n.isNotNull() & (n <= F.size(src))
    places = F.when(fits & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct((at + 1).alias("at"), F.array().cast(f"array<{item}>").alias("items"), F.lit(None).cast("string").alias("error")).cast(shape)
    done = F.aggregate(places, start, step)
    error = F.when(~fits, F.lit("array longer than the data")).otherwise(done["error"])
    return F.when(fits & done["error"].isNull(), done["items"]), error, done["at"]


def spark_type(kind: Kind) -> str:
    if kind.name == "array":
        return f"array<{spark_type(kind.inner[0])}>"
    if kind.name == "struct":
        return "struct<" + ",".join(f"`{m}`:{spark_type(k)}" for m, k in zip(kind.members, kind.inner)) + ">"
    if kind.name == "enum":
        return "struct<variant:string,value:string>"
    if kind.name == "u64":
        return "decimal(20,0)"
    if kind.name == "bool":
        return "boolean"
    return "bigint" if kind.name in ("u8", "u16", "u32", "i8", "i16", "i32", "i64") else "string"


def number_text(text: Column) -> Column:
    """Metadata as plain decimal text of any length: integers, fractions, '0x' text; with an exponent what 38 digits, 18 of
    them a fraction, hold; null if it is no number."""
    text = F.trim(text.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$")
    scaled = text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)[eE][+-]?[0-9]+$")
    short = F.when(scaled, text).try_cast("decimal(38,18)").cast("string")
    return F.when(text.rlike("^0x[0-9a-fA-F]+$"), decimal_text(digits(text))).when(plain, text).when(scaled, short)


def _size(text: Column) -> tuple[Column, Column]:
    """Whether plain decimal text is below zero, and a value that orders like its size."""
    body = F.regexp_replace(text, "^[+-]", "")
    whole = F.ltrim(F.substring_index(body, ".", 1), F.lit("0"))
    part = F.rtrim(F.when(F.contains(body, F.lit(".")), F.substring_index(body, ".", -1)).otherwise(F.lit("")), F.lit("0"))
    return text.startswith("-") & ((whole != "") | (part != "")), F.struct(F.length(whole).alias("n"), whole.alias("whole"), part.alias("part"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f takes it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def compared(a: Column, b: Column) -> Column:
    """(less: a < b, equal: a = b) of plain decimal texts, exact at any length; both null if one of them is."""

    def sized(p: Column) -> Column:
        (a_below, a_size), (b_below, b_size) = _size(p["a"]), _size(p["b"])
        known = p["a"].isNotNull() & p["b"].isNotNull()
        return let(F.struct(known.alias("known"), a_below.alias("a_below"), a_size.alias("a"), b_below.alias("b_below"), b_size.alias("b")), decided)

    def decided(s: Column) -> Column:
        less = F.when(s["a_below"] & ~s["b_below"], True).when(~s["a_below"] & s["b_below"], False).when(s["a_below"], s["b"] < s["a"]).otherwise(s["a"] < s["b"])
        return F.struct(F.when(s["known"], less).alias("less"), F.when(s["known"], (s["a_below"] == s["b_below"]) & (s["a"] == s["b"])).alias("equal"))

    return let(F.struct(a.alias("a"), b.alias("b")), sized)


def any_error(errors: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), errors, F.lit(None).cast("string"))
