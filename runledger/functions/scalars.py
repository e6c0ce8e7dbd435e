"""Value-level functions as column expressions (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(doc: Column, *keys: str) -> Column:
    return F.get_json_object(doc, "$." + ".".join(keys))


def json_safe(x: Column) -> Column:
    """A double as JSON text in full precision; non-finite values by name."""
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def infer_type(raw: Column) -> Column:
    """Name of the type that a raw override text takes: null, bool, int, float, json or str.
    Only the spellings ``null None true false`` count; nan and inf are floats; text that looks
    like JSON but does not parse is a string."""
    t = F.trim(raw)
    return (
        F.when(t.isin("null", "None"), "null")
        .when(t.isin("true", "false"), "bool")
        .when(t.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), "int")
        .when(t.rlike(r"\A[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\z"), "float")
        .when(t.rlike(r"(?i)\A[+-]?(nan|inf|infinity)\z"), "float")
        .when((F.length(t) <= 500) & t.rlike(r"\A[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .otherwise("str")
    )


def infer_value(raw: Column) -> Column:
    """The value that a raw override text stands for, as JSON text; null for a number that is
    not finite, which no override may be. Whole numbers of any size keep their digits; text
    that is no other type stays as it was written, white space around it too."""
    t, kind = F.trim(raw), infer_type(raw)
    digits = F.regexp_replace(F.regexp_replace(t, "_", ""), r"\A[+-]?0*(?=[0-9])", "")
    whole = F.when(t.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    number = F.regexp_replace(t, "_", "").try_cast("double")
    listed = F.to_json(F.array(F.when(t == "", t).otherwise(raw)))
    return (
        F.when(kind == "null", "null")
        .when(kind == "bool", t)
        .when(kind == "int", whole)
        .when(kind == "float", F.when(finite(number), number.cast("string")))
        .when(kind == "json", F.to_json(F.try_parse_json(t)))
        .otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))
    )


# Names that no part of a path may have.
BARRED = "__proto__ __class__ __init__ __dict__ __getattribute__ __setattr__ __delattr__ __bases__ __mro__ __subclasses__ __getstate__ __setstate__ __reduce__ __reduce_ex__".split()


def path_valid(p: Column) -> Column:
    """Dot path: 1 to 5 parts of letters and digits of any script and _, none of them barred."""
    return p.rlike(r"\A[\p{L}\p{N}_]+(\.[\p{L}\p{N}_]+){0,4}\z") & ~F.arrays_overlap(F.split(p, r"\."), F.array(*map(F.lit, BARRED)))


def task_id_valid(t: Column) -> Column:
    return t.rlike(r"\A[A-Za-z0-9_.-]{1,128}\z") & ~t.rlike(r"\A\.+\z")


def parse_set(item: Column) -> tuple[Column, Column]:
    """``k=v`` at the first equals sign; null key where there is none."""
    at = F.instr(item, "=")
    return F.when(at > 1, F.trim(F.substring(item, F.lit(1), at - 1))), F.when(at > 1, F.substring(item, at + 1, F.length(item)))


def fmt_secs(t: Column) -> Column:
    """Below one second one decimal, else whole seconds, both rounded as the binary value lies
    and halves to even. A fraction times 2^60 is a whole number without loss, so twentieths of
    it are counted exactly. Durations are not negative."""
    whole = F.lit(1 << 60).cast("decimal(20,0)")
    x = F.lit(20).cast("decimal(2,0)") * (F.when(t < 1, t).otherwise(0.0) * float(1 << 60)).cast("long").cast("decimal(19,0)")
    steps, over = F.call_function("div", x, whole), x % whole  # twentieths, and what is left
    tenths = F.floor(steps / 2) + F.when(steps % 2 == 0, 0).when((over > 0) | (F.floor(steps / 2) % 2 == 1), 1).otherwise(0)
    short = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(t < 1, short).otherwise(F.rint(t).cast("decimal(38,0)").cast("string"))


# Words that a node id must not be.
RESERVED = "end graph flowchart subgraph direction click style classDef linkStyle o x".split()


def safe_id(name: Column) -> Column:
    """Legal names stay; else other characters become _, and n_ goes before a digit, an empty
    name or a reserved word."""
    legal = name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z") & ~name.isin(RESERVED)
    safe = F.regexp_replace(name, "[^A-Za-z0-9]", "_")
    return F.when(legal, name).when(~safe.rlike(r"\A[A-Za-z_]") | safe.isin(RESERVED), F.concat(F.lit("n_"), safe)).otherwise(safe)


def mermaid_text(s: Column, quoted: bool = False) -> Column:
    out = F.regexp_replace(s, r"[\r\n\t]+", " ")
    return F.regexp_replace(out, '"', "#quot;") if quoted else out


def cut(s: Column, most: int) -> Column:
    return F.substring(s, 1, most)


def diff_truncate(s: Column, most: int = 200) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def digest(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
