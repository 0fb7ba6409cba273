"""Templates of documents, compiled once to a column expression, so that executors render a document a row.

A template is text with directives, each a line of its own:

* `@...` is a comment
* `#IF name` ... `#ENDIF name` stays where the condition holds, `#IF !name` where it does not; in a repeat also where
  the entry matches `name` as a regular expression (a field as `field[!]value`)
* `#ELSE name` ... `#ENDELSE name` stays where the condition does not hold
* `#REPEAT key` ... `#ENDREPEAT key` comes once an entry of an array: `key` stands for an entry that is a string,
  `key.field` for a field of one that is a struct, `$LOOP_COUNT` for its number from 0, `$(a op b)` for a sum,
  difference, product, quotient or remainder
* `#REPEAT key.field` in a repeat comes once a value of the field, which is a string or an array of strings
* `!REPIF key.field` ... `!ENDREPIF key.field` in a repeat stays where the entry has the field

A line that ends in a backslash goes on without a line feed, and the last line feed of a document goes. Tokens are
found in the template alone; what a value holds is never looked at again. A null condition does not hold, a null
array repeats nothing, and a token whose value is null stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

_OPENS = re.compile(r"#(IF|ELSE|REPEAT)\s*(\S.*?)\s*$|!(REPIF)\s*(\S.*?)\s*$")
_ENDS = re.compile(r"#END(IF|ELSE|REPEAT)\s*(\S.*?)\s*$|!END(REPIF)\s*(\S.*?)\s*$")
_SUM = re.compile(r"\$\(([^()]*)\)")
_OPERATION = re.compile(r"\s*(-?[^\s+*/%-]+)\s*(?:([-+*/%])\s*(-?[^\s+*/%-]+)\s*)?$")
_COUNT = "$LOOP_COUNT"


@dataclass
class Block:
    """A directive with what lies in it; the root has kind None."""

    kind: str | None
    token: str
    inside: list[Block | str] = field(default_factory=list)


def parse(template: str) -> Block:
    """The tree of a template; a directive that is not ended, or ended by another's end, raises."""
    open_ = [Block(None, "")]
    for number, line in enumerate(template.removesuffix("\n").split("\n") if template else (), 1):
        opens, ends = _OPENS.match(line), _ENDS.match(line)
        if ends:
            kind, token = ends[1] or ends[3], ends[2] or ends[4]
            if (open_[-1].kind, open_[-1].token) != (kind, token):
                raise ValueError(f"line {number}: {line!r} ends what is not open")
            open_.pop()
        elif opens:
            block = Block(opens[1] or opens[3], opens[2] or opens[4])
            open_[-1].inside.append(block)
            open_.append(block)
        elif not line.startswith("@"):
            open_[-1].inside.append(line[:-1] if line.endswith("\\") else line + "\n")
    if len(open_) > 1:
        raise ValueError(f"{open_[-1].kind} {open_[-1].token} has no end")
    return open_[0]


def calculated(a: Column, op: str, b: Column) -> Column:
    """The text of a op b of numbers in text: whole without a point, others with six places; null without a result.

    Quotients of two numbers without a point are whole and cut towards zero, as remainders are.
    """
    x, y = a.try_cast("double"), b.try_cast("double")
    m, n = a.try_cast("bigint"), b.try_cast("bigint")
    if op == "/":
        whole = ~a.contains(".") & ~b.contains(".")
        return F.when(y == 0, None).when(whole, F.call_function("div", m, n).cast("string")).otherwise(_number(x / y))
    if op == "%":
        return F.when(n != 0, (m % n).cast("string"))
    return _number({"+": x + y, "-": x - y, "*": x * y}[op])


def _number(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("bigint").cast("string")).when(x.isNotNull(), F.format_string("%.6f", x))


@dataclass
class _Scope:
    """What tokens stand for, and (in a repeat) the fields of entries by token with their types, and the entry's texts."""

    values: dict[str, Column]
    fields: dict[str, tuple[Column, DataType]]
    texts: list[Column] | None = None


class _Compiler:
    def __init__(self, conditions: Mapping[str, Column], repeats: Mapping[str, tuple[Column, DataType]], indent: str):
        self.conditions, self.repeats, self.indent = conditions, repeats, indent

    def body(self, block: Block, scope: _Scope) -> Column:
        parts = [self.line(x, scope) if isinstance(x, str) else self.block(x, scope) for x in block.inside]
        return F.concat(*parts) if parts else F.lit("")

    def line(self, text: str, scope: _Scope) -> Column:
        parts, at = [], 0
        if scope.texts is not None:
            for m in _SUM.finditer(text):
                parts += [*self.tokens(text[at : m.start()], scope), self.sum(m, scope)]
                at = m.end()
        return F.concat(F.lit(self.indent), *parts, *self.tokens(text[at:], scope))

    def tokens(self, text: str, scope: _Scope) -> list[Column]:
        if not scope.values:
            return [F.lit(text)]
        longest = sorted(scope.values, key=len, reverse=True)
        pieces = re.split(f"({'|'.join(map(re.escape, longest))})", text)
        return [F.coalesce(scope.values[x], F.lit(x)) if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x]

    def sum(self, found: re.Match, scope: _Scope) -> Column:
        operation = _OPERATION.match(found[1])
        if not operation:
            raise ValueError(f"{found[0]} is no sum of two numbers")
        a, op, b = operation.groups()
        value = lambda x: scope.values.get(x, F.lit(x))
        return F.coalesce(calculated(value(a), op, value(b)) if op else _number(value(a).try_cast("double")), F.lit(found[0]))

    def block(self, block: Block, scope: _Scope) -> Column:
        if block.kind == "REPEAT":
            return self.repeat(block, scope)
        if block.kind == "REPIF":
            if block.token not in scope.fields:
                return F.lit("")
            holds = scope.fields[block.token][0].isNotNull()
        else:
            negated = block.kind == "IF" and block.token.startswith("!")
            name = block.token.removeprefix("!") if negated else block.token
            holds = F.coalesce(self.conditions.get(name, F.lit(False)), F.lit(False))
            if block.kind == "ELSE" or negated:
                holds = ~holds
            elif scope.texts:
                holds = reduce(lambda p, q: p | q, (F.coalesce(t.rlike(name), F.lit(False)) for t in scope.texts), holds)
        return F.when(holds, self.body(block, scope)).otherwise(F.lit(""))

    def repeat(self, block: Block, scope: _Scope) -> Column:
        token = block.token
        if token in self.repeats:
            entries, kind = self.repeats[token]
            element = kind.elementType
        elif token in scope.fields:
            entries, kind = scope.fields[token]
            if isinstance(kind, ArrayType):
                element = kind.elementType
            else:
                entries, element = F.when(entries.isNotNull(), F.array(entries)), kind
        else:
            return F.lit("")

        def one(entry: Column, i: Column) -> Column:
            inner = _Scope(scope.values | {_COUNT: i.cast("string")}, dict(scope.fields), scope.texts or [])
            if isinstance(element, StructType):
                inner.texts = []
                for f in element:
                    value = entry.getField(f.name)
                    inner.fields[f"{token}.{f.name}"] = (value, f.dataType)
                    if not isinstance(f.dataType, ArrayType):
                        inner.values[f"{token}.{f.name}"] = value.cast("string")
                        inner.texts.append(F.concat(F.lit(f"{f.name}[!]"), value.cast("string")))
            else:
                inner.values[token] = entry.cast("string")
                inner.texts = [entry.cast("string")] if token in self.repeats else inner.texts
            return self.body(block, inner)

        return F.coalesce(F.array_join(F.transform(entries, one), ""), F.lit(""))


def rendered(
    df: DataFrame,
    template: str,
    document: str,
    conditions: Mapping[str, Column] | None = None,
    repeats: Mapping[str, Column] | None = None,
    replacements: Mapping[str, Column] | None = None,
    indent: int = 0,
) -> DataFrame:
    """df with the column `document`, the template filled from each row: one projection without a shuffle.

    conditions are boolean columns by name, repeats arrays of strings or structs by key, replacements columns by
    token. Every line is indented. A template that is not well formed, or a repeat that is no array, raises at once.
    """
    tree = parse(template)
    arrays = {}
    for key, values in (repeats or {}).items():
        kind = df.select(values.alias("x")).schema["x"].dataType
        if not isinstance(kind, ArrayType):
            raise ValueError(f"{key} is to repeat an array, not {kind.simpleString()}")
        arrays[key] = (values, kind)
    compiler = _Compiler(conditions or {}, arrays, " " * indent)
    text = compiler.body(tree, _Scope({k: v.cast("string") for k, v in (replacements or {}).items()}, {}))
    return df.withColumn(document, F.regexp_replace(text, r"\n\z", ""))
