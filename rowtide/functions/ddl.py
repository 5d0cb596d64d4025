"""Classification and target resolution of schema-change statements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowtide import schemas as S
from rowtide.functions.values import java_trim

# Recognised column operations, tried in this order.
DDL_KINDS = (
    (" DROP COLUMN ", "DROP_COLUMN"),
    (" RENAME COLUMN ", "RENAME_COLUMN"),
    (" MODIFY COLUMN ", "MODIFY_COLUMN"),
    (" ADD COLUMN ", "ADD_COLUMN"),
)
# An identifier is quoted by back-ticks (a doubled one stands for itself) or made of word characters,
# dollar signs and characters beyond ASCII. Blanks may stand around the dot.
_QUOTED = "`(?:``|[^`])+`"
_PLAIN = "[0-9A-Za-z_$\\x{80}-\\x{ffff}]+"
_STATEMENT = (
    f"(?is)^[\\x00-\\x20]*alter\\s+table\\s+(?<first>{_QUOTED}|{_PLAIN})(?:\\s*[.]\\s*(?<second>{_QUOTED}|{_PLAIN}))?"
)


_NAME = f"({_QUOTED}|{_PLAIN})"
_TAIL = "\\s+(\\w+)(.*)$"
# Words that start a clause on something else than a column, and column types written without quotes.
_NO_COLUMN = "(?!(?:index|key|unique|primary|constraint|foreign|fulltext|spatial|check|partition)\\b)"
_BARE_TYPES = (
    "tinyint", "smallint", "mediumint", "int", "integer", "bigint", "decimal", "numeric", "dec", "fixed", "float", "double",
    "real", "bool", "boolean", "year", "serial",
)
# Clause patterns with the groups: column, new name, type, rest.
_CLAUSES = {
    "ADD": (f"(?is)^add\\s+(?:column\\s+)?(?:if\\s+not\\s+exists\\s+)?{_NO_COLUMN}{_NAME}{_TAIL}", (1, None, 2, 3)),
    "DROP": (f"(?is)^drop\\s+(?:column\\s+)?(?:if\\s+exists\\s+)?{_NAME}\\s*(?:restrict|cascade)?$", (1, None, None, None)),
    "RENAME": (f"(?is)^rename\\s+column\\s+{_NAME}\\s+to\\s+{_NAME}$", (1, 2, None, None)),
    "MODIFY": (f"(?is)^modify\\s+(?:column\\s+)?(?:if\\s+exists\\s+)?{_NAME}{_TAIL}", (1, None, 2, 3)),
    "CHANGE": (f"(?is)^change\\s+(?:column\\s+)?{_NAME}\\s+{_NAME}{_TAIL}", (1, 2, 3, 4)),
}
_LITERAL = "'(?:''|\\\\.|[^'\\\\])*'|\"(?:\"\"|\\\\.|[^\"\\\\])*\""
# Parentheses of types, defaults and keys; those of a list of new columns stay.
_PARENTHESES = "(?is)(?<!\\badd\\s{0,9})(?<!\\bcolumn\\s{0,9})\\([^()]*\\)"


def column_changes(sql: Column) -> Column:
    """Column clauses of an ALTER TABLE, in order: array of (action, column, new_name, bare, first, after).

    ``bare`` tells whether a type prints as a JSON number or truth value. Clauses on keys, indexes and partitions are
    left out; a list of new columns gives one ADD each. Commas inside text, types and defaults separate nothing; a
    back-ticked name may not hold a comma or a parenthesis.
    """
    body = F.regexp_replace(F.regexp_replace(sql, "(?s)/\\*.*?\\*/", " "), _STATEMENT, "")
    body = F.regexp_replace(body, _LITERAL, "''")
    for _ in range(3):  # nested ones from the inside
        body = F.regexp_replace(body, _PARENTHESES, "")
    clauses = F.transform(F.split(body, ","), lambda c: java_trim(F.translate(c, "();", "   ")))

    def parsed(clause):
        listed = F.rlike(clause, F.lit("(?is)^(?:add|drop|rename|modify|change|alter|convert|order|engine|default|comment)\\b"))
        text = F.when(listed, clause).otherwise(F.concat(F.lit("add "), clause))
        made = F.lit(None).cast(CHANGE)
        for action, (pattern, groups) in reversed(_CLAUSES.items()):
            column, new, kind, rest = (
                F.lit(None).cast("string") if g is None else F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups
            )
            found = F.struct(
                F.lit(action).alias("action"), unquote(column).alias("column"), unquote(new).alias("new_name"),
                F.lower(kind).isin(*_BARE_TYPES).alias("bare"),
                F.coalesce(F.rlike(rest, F.lit("(?is)\\bfirst$")), F.lit(False)).alias("first"),
                unquote(F.nullif(F.regexp_extract(rest, f"(?is)\\bafter\\s+{_NAME}$", 1), F.lit(""))).alias("after"),
            )
            made = F.when(F.rlike(text, F.lit(pattern)), found.cast(CHANGE)).otherwise(made)
        return made

    return F.filter(F.transform(clauses, parsed), lambda c: c.isNotNull())


CHANGE = "struct<action:string, column:string, new_name:string, bare:boolean, first:boolean, after:string>"
COLUMNS = "struct<columns:array<string>, primary_keys:array<string>, bare:array<string>>"


def changed_columns(start: Column, changes: Column) -> Column:
    """A table's columns, key and bare columns after the clauses of ``column_changes``, names compared without case."""

    def one(held, change):
        columns, name = held["columns"], F.lower(change["column"])
        new = F.coalesce(change["new_name"], change["column"])
        action, is_in = change["action"], F.exists(columns, lambda c: F.lower(c) == name)
        without = lambda names: F.filter(names, lambda c: F.lower(c) != name)
        renamed = lambda names: F.transform(names, lambda c: F.when(F.lower(c) == name, new).otherwise(c))
        others = without(columns)
        spot = F.coalesce(F.array_position(F.transform(others, F.lower), F.lower(change["after"])), F.lit(0)).cast("int")
        placed = (
            F.when(change["first"], F.concat(F.array(new), others))
            .when(spot > 0, F.concat(F.slice(others, F.lit(1), spot), F.array(new), F.slice(others, spot + 1, F.size(others) + 1)))
            .otherwise(F.concat(others, F.array(new)))
        )
        moved = change["first"] | (spot > 0)
        after = (
            F.when(action == "ADD", F.when(is_in, columns).otherwise(placed))
            .when(action == "DROP", others)
            .when(is_in & moved & (action != "RENAME"), placed)
            .otherwise(renamed(columns))
        )
        keys = F.when(action == "DROP", without(held["primary_keys"])).otherwise(renamed(held["primary_keys"]))
        typed = action.isin("MODIFY", "CHANGE") & is_in | (action == "ADD") & ~is_in
        bare = (
            F.when(action == "DROP", without(held["bare"]))
            .when(typed, F.concat(without(held["bare"]), F.when(change["bare"], F.array(new)).otherwise(F.array().cast("array<string>"))))
            .otherwise(renamed(held["bare"]))
        )
        return F.struct(after.alias("columns"), keys.alias("primary_keys"), bare.alias("bare")).cast(COLUMNS)

    return F.aggregate(changes, start.cast(COLUMNS), one)


def ddl_type(sql: Column) -> Column:
    """Kind of a statement, null when it is not a recognised column change."""
    text = F.upper(java_trim(sql))
    kind = F.lit(None).cast("string")
    for phrase, name in reversed(DDL_KINDS):
        kind = F.when(F.contains(text, F.lit(phrase)), F.lit(name)).otherwise(kind)
    return F.when(F.startswith(text, F.lit("ALTER TABLE")), kind)


def is_destructive(kind: Column) -> Column:
    return F.coalesce(kind.isin(*S.DESTRUCTIVE_DDL), F.lit(False))


def unquote(identifier: Column) -> Column:
    """Identifier without surrounding back-ticks; doubled ones inside become single."""
    name = java_trim(identifier)
    inner = F.regexp_extract(name, "(?s)^`(.*)`$", 1)
    return F.when(F.rlike(name, F.lit("(?s)^`.*`$")), F.replace(inner, F.lit("``"), F.lit("`"))).otherwise(name)


def quote(identifier: Column) -> Column:
    """Identifier in back-ticks, inner back-ticks doubled."""
    return F.concat(F.lit("`"), F.replace(identifier, F.lit("`"), F.lit("``")), F.lit("`"))


def ddl_target(default_database: Column, sql: Column) -> Column:
    """Struct of the lower-cased database and table an ALTER TABLE names, nulls when it names none."""
    first, second = (F.nullif(F.regexp_extract(sql, _STATEMENT, group), F.lit("")) for group in (1, 2))
    database = F.when(second.isNotNull(), first).otherwise(default_database)
    table = F.coalesce(second, first)
    return F.struct(
        F.when(table.isNotNull(), F.lower(java_trim(unquote(database)))).alias("database_key"),
        F.lower(java_trim(unquote(table))).alias("table_key"),
    )
