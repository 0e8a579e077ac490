"""Text handling: record fields, key labels, result-path fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Fixed value: field separator of dataset files.
SEPARATOR = "|"
#: Fixed value: prefix of string keys.
KEY_PREFIX = "key_"


def fields(line: Column, separator: str = SEPARATOR) -> Column:
    """The fields of a record, with the trailing separator of a record ignored."""
    sep = re.escape(separator)
    return F.split(F.regexp_replace(line, f"{sep}$", ""), sep)


def is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def to_long(text: Column) -> Column:
    """Whole number of a text field; a field that is not a number fails the query."""
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce(text.try_cast("long"), F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("long"))
    )


def key_label(key: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), key.cast("string"))


def key_id(label: Column) -> Column:
    """Number after the first ``key_``, -1 where the prefix is missing."""
    at = F.instr(label, KEY_PREFIX)
    rest = F.substr(label, at + F.lit(len(KEY_PREFIX)))
    return F.when(at > 0, to_long(F.regexp_extract(rest, r"^\s*([+-]?\d+)", 1))).otherwise(F.lit(-1).cast("long"))


def replace_first(text: Column, old: str, new: str) -> Column:
    """``old`` replaced once, at its first place; unchanged where it is missing."""
    at = F.instr(text, old)
    return F.when(
        at > 0,
        F.concat(F.substr(text, F.lit(1), at - F.lit(1)), F.lit(new), F.substr(text, at + F.lit(len(old)))),
    ).otherwise(text)


def partner_path(path: str, old: str = "r_", new: str = "l_") -> str:
    """Path of the second input: the first ``r_`` of the *file name* becomes ``l_``."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.replace(old, new, 1)}"


def _number(path: Column, pattern: str) -> Column:
    return F.regexp_extract(path, pattern, 1).try_cast("long")


def run_fields(path: Column) -> dict[str, Column]:
    """Configuration fields coded in result folder names; null where a field is not coded."""
    return {
        "test_index": _number(path, r"(\d+)_test_\d+"),
        "parallelism": _number(path, r"\d+_test_(\d+)"),
        "batch": _number(path, r"(\d+)_batch"),
        "source_degree": _number(path, r"(\d+)_source"),
        "interval": _number(path, r"output-i(\d+)-"),
        "keys": _number(path, r"output-i\d+-k(\d+)_t\d+"),
        "repetition": _number(path, r"output-i\d+-k\d+_t(\d+)"),
    }


def with_run_fields(df, path: str, *names: str):
    """``df`` plus the coded fields of its ``path`` column (all of them by default)."""
    found = run_fields(F.col(path))
    return df.withColumns({name: found[name] for name in (names or found)})
