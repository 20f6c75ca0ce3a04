"""Rule patterns: globs to regexes, validation, justification templates.

Rules are configuration, so their patterns are prepared once when a rule set is
loaded; events only ever meet the finished regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import snake_case


def path_glob(glob: str) -> str:
    """`**` any depth, `*` one path segment, `?` one character; not anchored."""
    wild = {"**": ".*", "*": "[^/]*", "?": "."}
    parts = re.split(r"(\*\*|\*|\?)", glob.replace("\\", "/"))
    return "".join(wild.get(p, re.escape(p)) for p in parts)


def domain_glob(glob: str, one_label: bool = False) -> str:
    """`**.` any number of leading labels (at most one with `one_label`), `*`
    inside one label; anchored at both ends."""
    lead = r"(.[^.]*\.)?" if one_label else r"(.*\.)?"
    wild = {"**.": lead, "*": "[^.]*"}
    parts = re.split(r"(\*\*\.|\*)", glob)
    return "^" + "".join(wild.get(p, re.escape(p)) for p in parts) + "$"


def path_glob_column(glob: Column) -> Column:
    """`path_glob` for globs held in a table."""
    text = F.translate(glob, "\\", "/")
    quoted = F.regexp_replace(text, r"([.+^$()\[\]{}|\-])", r"\\$1")
    marked = F.regexp_replace(quoted, r"\*\*", "\u0001")
    single = F.regexp_replace(F.regexp_replace(marked, r"\*", "[^/]*"), r"\?", ".")
    return F.regexp_replace(single, "\u0001", ".*")


def domain_glob_column(glob: Column, one_label: bool = False) -> Column:
    """`domain_glob` for globs held in a table."""
    lead = r"(.[^.]*\\.)?" if one_label else r"(.*\\.)?"
    quoted = F.regexp_replace(glob, r"\.", r"\\.")
    marked = F.regexp_replace(quoted, r"\*\*\\\.", "\u0001")
    single = F.regexp_replace(marked, r"\*", "[^.]*")
    opened = F.regexp_replace(single, "\u0001", lead.replace("$", r"\$"))
    return F.concat(F.lit("^"), opened, F.lit("$"))


def anywhere(pattern: str) -> str:
    """Case-insensitive form of a rule pattern for `rlike` (an unanchored find)."""
    return "(?i)" + pattern


def is_valid(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM accepts the pattern (an invalid one would fail the job)."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def fill_template(template: Column, fields: Column) -> Column:
    """`${field}` / `${payload.X}` filled from a map of the event's fields, by
    its own name and then in snake case; an unknown one stays as it is."""
    pieces = F.split(template, r"(?=\$\{)")

    def filled(piece: Column) -> Column:
        mark = r"^\$\{([^}|]*)(?:\|[^}]*)?\}"
        name = F.regexp_replace(F.regexp_extract(piece, mark, 1), r"^payload\.", "")
        value = F.coalesce(
            F.when(fields[name] != "", fields[name]),
            F.when(fields[snake_case(name)] != "", fields[snake_case(name)]),
            F.regexp_extract(piece, mark, 0),
        )
        return F.when(piece.rlike(mark), F.concat(value, F.regexp_replace(piece, mark, ""))).otherwise(piece)

    return F.array_join(F.transform(pieces, filled), "")
