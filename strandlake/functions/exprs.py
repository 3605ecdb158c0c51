"""Column expressions on reads, alignments and their strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295


def characters(text: Column) -> Column:
    """The characters of a string; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def codes(text: Column) -> Column:
    """Code points of the characters, as BIGINT."""
    return F.transform(characters(text), lambda c: F.ascii(c).cast("long"))


def sum_quality(qual: Column) -> Column:
    """Sum of the raw ASCII values, without an offset."""
    return F.aggregate(codes(qual), F.lit(0).cast("long"), lambda a, x: a + x)


def x31(text: Column) -> Column:
    """h = 31 h + c over unsigned 32 bits."""
    return F.aggregate(codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(U32)))


def djb2(text: Column) -> Column:
    """h = 33 h + c from 5381 over unsigned 32 bits."""
    return F.aggregate(codes(text), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(U32)))


def fold64(x: Column) -> Column:
    """A 64-bit key folded to 32 bits."""
    x = x.cast("long")
    return F.shiftrightunsigned(x, 33).bitwiseXOR(x).bitwiseXOR(F.shiftleft(x, 11)).bitwiseAND(F.lit(U32))


def wang32(x: Column) -> Column:
    """A well-known integer mixer over unsigned 32 bits."""
    k = x.cast("long").bitwiseAND(F.lit(U32))
    wrap = lambda c: c.bitwiseAND(F.lit(U32))
    k = wrap(k + wrap(F.bitwise_not(F.shiftleft(k, 15))))
    k = k.bitwiseXOR(F.shiftright(k, 10))
    k = wrap(k + F.shiftleft(k, 3))
    k = k.bitwiseXOR(F.shiftright(k, 6))
    k = wrap(k + wrap(F.bitwise_not(F.shiftleft(k, 11))))
    return k.bitwiseXOR(F.shiftright(k, 16))


def sample_fraction_of(name: Column, seed: int = 0) -> Column:
    """A read's place in [0, 1), from its name's hash and a seed."""
    return (x31(name) + F.lit(seed)).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0x1000000))


def read_key(name: Column) -> Column:
    """The header up to its first space."""
    return F.substring_index(name, " ", 1)


def gc_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))).cast("long")


def gc_fraction(seq: Column) -> Column:
    """Share of upper-case G and C; null for an empty read."""
    return F.when(F.length(seq) > 0, gc_count(seq) / F.length(seq))


def strict_filter() -> Column:
    """Mapped, primary, passing and not a duplicate."""
    return (F.col("flag").bitwiseAND(F.lit(1796)) == 0) & (F.col("tid") >= 0)


def lax_filter() -> Column:
    """Mapped."""
    return (F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("tid") >= 0)


def aligned_blocks(pos: Column, cigar: Column, compat: bool = False) -> Column:
    """array<struct<s, e>> of aligned blocks: M emits and advances, D and N advance.

    ``=`` and ``X`` count as M, unless ``compat``, where they are passed over.
    """
    aligned = [0] if compat else [0, 7, 8]
    moving = [*aligned, 2, 3]
    zero = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(state: Column, c: Column) -> Column:
        at, n = state["at"], c["len"].cast("long")
        block = F.array(F.struct(at.alias("s"), (at + n).alias("e")))
        out = F.when(c["op"].isin(*aligned), F.concat(state["out"], block)).otherwise(state["out"])
        return F.struct((at + F.when(c["op"].isin(*moving), n).otherwise(F.lit(0).cast("long"))).alias("at"), out.alias("out"))

    return F.aggregate(cigar, zero, step, lambda s: s["out"])


def reference_span(cigar: Column) -> Column:
    """Reference bases that an alignment covers: M, D, N, = and X."""
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin(0, 2, 3, 7, 8)), F.lit(0).cast("long"), lambda a, c: a + c["len"])


def window_id(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("long")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_codes(seq: Column) -> Column:
    """Two-bit codes as digits: T and U 0, C 1, A 2, G 3, anything else 0."""
    return F.regexp_replace(F.translate(F.upper(seq), "TUCAG", "00123"), "[^0-3]", "0")


def split_nonempty(text: Column, separator: str = " ") -> Column:
    """Fields between single-character separators, empty ones dropped."""
    return F.filter(F.split(text, "\\Q" + separator + "\\E", -1), lambda x: x != "")


def split_numbers(text: Column, separator: str = " ") -> Column:
    """struct<label, values>: the first field and the others as numbers, NA being 0."""
    parts = split_nonempty(text, separator)
    number = lambda x: F.when(x == "NA", F.lit(0.0)).otherwise(x.try_cast("double"))
    return F.struct(F.get(parts, F.lit(0)).alias("label"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), number).alias("values"))


def chromosome_number(chrom: Column) -> Column:
    """A chromosome as a sort key: X 23, Y 24, M 25, else its digits."""
    digits = F.regexp_extract(chrom, "([0-9]+)", 1)
    return F.when(chrom.contains("X"), 23).when(chrom.contains("Y"), 24).when(chrom.contains("M"), 25).otherwise(digits.try_cast("int"))


def parse_unsigned(text: Column) -> Column:
    """The leading digits as a number; null for none, and for a sign."""
    return F.regexp_extract(text, "^[0-9]+", 0).try_cast("long")


def to_base(x: Column, base: int) -> Column:
    """Digits of a signed integer in a base of 2 to 16, upper case."""
    return F.when(x < 0, F.concat(F.lit("-"), F.conv((-x).cast("string"), 10, base))).otherwise(F.conv(x.cast("string"), 10, base))


def with_commas(x: Column) -> Column:
    return F.format_number(x.cast("decimal(38,0)"), 0)


def duplicate_key(seq: Column) -> Column:
    """A quality-control duplicate's key: the first 50 bases of a read over 75."""
    return F.when(F.length(seq) > 75, F.substring(seq, 1, 50)).otherwise(seq)


def find_all(text: Column, pattern: str) -> Column:
    """0-based places of a substring, overlaps included."""
    last = F.length(text) - len(pattern)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substring(text, i + 1, F.lit(len(pattern))) == pattern)


def code_count(packed: Column, code: int) -> Column:
    """How many of the 32 two-bit places of a 64-bit integer hold a code, 0 to 3."""
    high, low = F.shiftrightunsigned(packed, 1), packed
    same = (high if code & 2 else F.bitwise_not(high)).bitwiseAND(low if code & 1 else F.bitwise_not(low))
    return F.bit_count(same.bitwiseAND(F.lit(0x5555555555555555)))


def place_code(place: Column) -> Column:
    """A place below 2**28 as four bytes from 1 to 128, seven bits each, the lowest first."""
    byte = lambda i: F.lpad(F.hex(F.shiftright(place, 7 * i).bitwiseAND(F.lit(127)) + 1), 2, "0")
    return F.unhex(F.concat(*(byte(i) for i in range(4))))


def place_of_code(code: Column) -> Column:
    part = lambda i: F.shiftleft(F.conv(F.hex(F.substring(code, i + 1, 1)), 16, 10).cast("long") - 1, 7 * i)
    return part(0) + part(1) + part(2) + part(3)
