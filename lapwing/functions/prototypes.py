"""Scalar functions over C prototypes, as column expressions.

A prototype is (funcname, return_type, params), with params a run of ``type@name,``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest function name that is turned into tokens, and length of an id vector.
LONGEST_NAME, SEQUENCE = 150, 60
#: Fixed reserved words of a token sequence, in the order of their ids.
RESERVED = ["<cls>", "<ptr>", "<dptr>", "<noptr>", "<dot>", "(", ")"]


def pointer_kind(type_text: Column) -> Column:
    """<dptr>, <ptr> or <noptr> by the stars in a type."""
    return F.when(type_text.contains("**"), "<dptr>").when(type_text.contains("*"), "<ptr>").otherwise("<noptr>")


def pointer_mark(type_text: Column) -> Column:
    """* for pointers, $ for int, bool and void, # for the rest."""
    return F.when(type_text.contains("*"), "*").when(type_text.rlike("int|bool|void"), "$").otherwise("#")


def parse_params(params: Column) -> Column:
    """Array of (raw_type, kind, name) from ``type@name,`` runs."""
    types = F.regexp_extract_all(params, F.lit(r"([^@,]*(?:,[^@,]*)*?)@([^,]*),"), F.lit(1))
    names = F.regexp_extract_all(params, F.lit(r"([^@,]*(?:,[^@,]*)*?)@([^,]*),"), F.lit(2))
    return F.zip_with(types, names, lambda t, n: F.struct(t.alias("raw_type"), pointer_kind(t).alias("kind"), n.alias("name")))


def parse_prototype(line: Column) -> Column:
    """(return_type, funcname, params) of a C prototype; null without parentheses.

    An argument with parentheses becomes ``void *`` named ptr; void and empty ones are
    left out; others are cut at the last star or the last space.
    """
    head = F.regexp_extract(line, r"^([^(]*)\(", 1)
    body = F.regexp_extract(line, r"^[^(]*\((.*)\)", 1)
    name = F.regexp_extract(head, r"([A-Za-z0-9_]*)$", 1)
    args = F.filter(F.split(body, ","), lambda a: ~F.trim(a).isin("void", ""))

    def one(a: Column) -> Column:
        star = F.regexp_extract(a, r"^(.*\*)([^*]*)$", 1)
        return (
            F.when(a.rlike(r"[()]"), "void *@ptr,")
            .when(a.contains("*"), F.concat(F.trim(star), F.lit("@"), F.trim(F.regexp_extract(a, r"^(.*\*)([^*]*)$", 2)), F.lit(",")))
            .otherwise(F.concat(F.trim(F.regexp_extract(a, r"^(.*) ([^ ]*)$", 1)), F.lit("@"), F.trim(F.regexp_extract(a, r"^(.*) ([^ ]*)$", 2)), F.lit(",")))
        )

    parsed = F.struct(
        F.trim(F.regexp_replace(head, r"[A-Za-z0-9_]*$", "")).alias("return_type"),
        name.alias("funcname"),
        F.array_join(F.transform(args, one), "").alias("params"),
    )
    return F.when(line.rlike(r"\(.*\)"), parsed)


def piped(return_type: Column, funcname: Column, params: Column) -> Column:
    """|type@name| form: the function first, then each argument."""
    return F.concat(F.lit("|"), return_type, F.lit("@"), funcname, F.lit("|"), F.array_join(F.transform(parse_params(params), lambda p: F.concat(F.lit("|"), p["raw_type"], F.lit("@"), p["name"], F.lit("|"))), ""))


def parse_piped(line: Column) -> Column:
    """(return_type, funcname, params), lower-cased, of a |type@name| line; null if there is none."""
    types = F.regexp_extract_all(line, F.lit(r"\|([^|]*?)@([^|]*?)\|"), F.lit(1))
    names = F.regexp_extract_all(line, F.lit(r"\|([^|]*?)@([^|]*?)\|"), F.lit(2))
    rest = F.zip_with(F.slice(types, 2, F.greatest(F.size(types), F.lit(1))), F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda t, n: F.lower(F.concat(F.regexp_replace(t, ",", " "), F.lit("@"), n, F.lit(","))))
    return F.when(F.size(types) > 0, F.struct(F.lower(F.get(types, F.lit(0))).alias("return_type"), F.lower(F.get(names, F.lit(0))).alias("funcname"), F.array_join(rest, "").alias("params")))


def prototype_json(return_type: Column, funcname: Column, params: Column) -> Column:
    return F.to_json(F.struct(F.lower(funcname).alias("funcname"), F.lower(return_type).alias("return_type"), F.lower(params).alias("params")))


def render(return_type: Column, funcname: Column, params: Column) -> Column:
    """``type name(type name,type name)`` of a prototype."""
    args = F.transform(parse_params(params), lambda p: F.concat_ws(" ", p["raw_type"], p["name"]))
    return F.concat(return_type, F.lit(" "), funcname, F.lit("("), F.array_join(args, ","), F.lit(")"))


def clean(name: Column) -> Column:
    """Lower-case letters only."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def base_name(expression: Column) -> Column:
    """What stands before the first ``-``, ``.`` or ``[``, without a leading ``&``; all of it if there is none."""
    return F.regexp_extract(expression, r"^&?([^-.\[]*)", 1)


def member_base(expression: Column) -> Column:
    """The base of a member expression; null if it has no member."""
    return F.when(is_member(expression), F.regexp_extract(expression, r"^&?([^-.]*)", 1))


def member_name(expression: Column) -> Column:
    """From the first ``-`` or ``.`` on; all of it if there is none."""
    return F.when(is_member(expression), F.regexp_extract(expression, r"^[^-.]*([-.].*)$", 1)).otherwise(expression)


def is_member(expression: Column) -> Column:
    return expression.rlike("[-.]")


def is_container(names: Column) -> Column:
    """True if an expression's variables include the container_of helper."""
    return F.exists(names, lambda n: n == "__mptr")


def change_base(expression: Column, new: Column) -> Column:
    """The expression with its base renamed."""
    return F.concat(new, F.regexp_extract(expression, r"^[^-.\[]*(.*)$", 1))


def member_path(expression: Column) -> Column:
    """a->b.c as [a, b, c]."""
    return F.filter(F.split(F.trim(expression), r"->|\."), lambda p: p != "")


def last_word(type_text: Column) -> Column:
    """Last word of a type, read before its stars."""
    return F.substring_index(F.trim(F.regexp_replace(type_text, r"[\s*]+$", "")), " ", -1)


def indirect_call(type_text: Column) -> Column:
    """(return_type, params) of a function-pointer type ``ret (*)(a, b)``; names are the types' last words."""
    args = F.filter(F.split(F.regexp_extract(type_text, r"\(\s*\*[^)]*\)\s*\((.*)\)", 1), ","), lambda a: F.trim(a) != "")
    params = F.array_join(F.transform(args, lambda a: F.concat(F.trim(a), F.lit("@"), last_word(a), F.lit(","))), "")
    return F.when(type_text.rlike(r"\(\s*\*[^)]*\)\s*\("), F.struct(F.trim(F.regexp_extract(type_text, r"^([^(]*)\(", 1)).alias("return_type"), params.alias("params")))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value; 0 for none."""
    return F.coalesce(F.array_position(values, F.array_max(values)) - 1, F.lit(0)).cast("int")


def returns_parameter(return_values: Column, params: Column) -> Column:
    """True if some returned name is an argument's name."""
    return F.arrays_overlap(return_values, F.transform(parse_params(params), lambda p: p["name"]))


def normalised_tokens(return_type: Column, name_words: Column, arguments: Column) -> Column:
    """The token sequence of a prototype; ``arguments`` are (kind, words)."""
    parts = F.flatten(F.transform(arguments, lambda a, i: F.concat(F.when(i > 0, F.array(F.lit("<dot>"))).otherwise(F.array().cast("array<string>")), F.array(a["kind"]), a["words"])))
    return F.concat(F.array(F.lit("<cls>"), pointer_kind(return_type)), name_words, F.array(F.lit("(")), parts, F.array(F.lit(")")))


def padded_ids(ids: Column, length: int = SEQUENCE) -> Column:
    """Cut or filled with zeros at the end to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def names_of_pairs(pairs: Column) -> Column:
    """Names of (idx, name) pairs."""
    return F.transform(pairs, lambda p: p["name"])


def distinct_pairs(pairs: Column) -> Column:
    """(idx, name) pairs with distinct names; the first of a name stays."""
    return F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["name"]), p["name"]) == i + 1)


def pair_up(flat: Column) -> Column:
    """A flat list [idx, name, idx, name, …, <nops>] as (idx, name) pairs."""
    n = F.floor(F.size(F.filter(flat, lambda x: x != "<nops>")) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, 2 * i).cast("int").alias("idx"), F.get(flat, 2 * i + 1).alias("name")))).otherwise(F.array().cast("array<struct<idx:int,name:string>>"))


def class_tiers(n: Column) -> Column:
    """Least number of null assignments asked for, by the project's number of functions."""
    return F.when(n < 10_000, 2).when(n < 50_000, 5).when(n < 100_000, 10).otherwise(20)
