"""Column expressions for model text: properties, statement kinds, terminals, inline arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statement kinds in the order in which they are tried; the first that matches wins. Kind, pattern.
KINDS = (
    ("circuit", r"(?i)^new\s+object=circuit\.\S+"),
    ("switch", r"(?i)^new\s+line\.sw\d+\b"),
    ("transformer", r"(?i)^new\s+transformer\.\S+"),
    ("regcontrol", r"(?i)^new\s+regcontrol\.\S+"),
    ("capacitor", r"(?i)^new\s+capacitor\.\S+"),
    ("line", r"(?i)^new\s+line\.\S+"),
    ("load", r"^New Load\.\S+"),
    ("linecode", r"(?i)^new\s+linecode\.\S+"),
    ("redirect", r"(?i)^redirect\s+\S+"),
    ("compile", r"(?i)^compile\s*[\s(\"]\S+"),
    ("clear", r"(?i)^clear\b"),
    ("generator", r"(?i)^new\s+generator\.\S+"),
    ("storage", r"(?i)^new\s+storage\.\S+"),
    ("loadshape", r"(?i)^new\s+loadshape\.\S+"),
    ("monitor", r"(?i)^new\s+monitor\.\S+"),
    ("open", r"(?i)^open\s+\S+"),
    ("close", r"(?i)^close\s+\S+"),
    ("batchedit", r"(?i)^batchedit\s+\w+\.\S+"),
    ("edit", r"(?i)^[a-z]\w*\.[^\s.=]+\.\w+\s*="),
    ("solve", r"(?i)^solve\b"),
)
_PHASES = {"1": "A", "2": "B", "3": "C"}


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def prop(text: Column, name: str, value: str = r"[^\s,\]]+") -> Column:
    """The value of name=value in a statement."""
    return found(text, rf"(?i)\b{name}\s*=\s*({value})")


def number(text: Column, name: str) -> Column:
    return prop(text, name, r"[-+]?[\d.]+(?:[eE][-+]?\d+)?").try_cast("double")


def assignments(text: Column) -> Column:
    """All name=value of a text, as an array of structs; a value may be in brackets or quotes."""
    pairs = r"(\w+)\s*=\s*(\([^)]*\)|\[[^\]]*\]|\"[^\"]*\"|[^\s!]+)"
    names, values = (F.regexp_extract_all(text, F.lit(pairs), F.lit(g)) for g in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("prop"), v.alias("value")))


def object_name(text: Column) -> Column:
    return found(text, r"(?i)^new\s+(?:object\s*=\s*)?\w+\.(\S+)")


def kind(text: Column) -> Column:
    """The first kind whose pattern matches, else `other`."""
    out = F
    for name, pattern in KINDS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def is_helper(node: Column) -> Column:
    """Nodes that only model equipment: regulator and substation ends, open ties."""
    return node.endswith("r") | node.endswith("s") | node.contains("_OPEN")


def terminal(bus: Column) -> Column:
    """base number, kind and phases of a network node: a number, with r, s or _OPEN after it, then a dot and a digit for each phase."""
    parts = F.split(bus, r"\.")
    node = F.get(parts, F.lit(0))
    phases = F.filter(F.transform(F.slice(parts, 2, 8), lambda p: _phase(p)), lambda p: p.isNotNull())
    return F.struct(
        node.alias("id"),
        F.regexp_replace(node, "[^0-9]", "").try_cast("long").alias("base_bus"),
        F.when(node.endswith("_OPEN"), "open_tie").when(node.endswith("r"), "regulator").when(node.endswith("s"), "switch").otherwise("bus").alias("kind"),
        phases.alias("phases"),
    )


def _phase(digit: Column) -> Column:
    out = F
    for d, letter in _PHASES.items():
        out = out.when(digit == d, letter)
    return out.otherwise(F.lit(None).cast("string"))


def load_terminal(bus: Column, phases: Column) -> Column:
    """Bus number and phase letters of a load: ABC for three phases, else the letters named, or Unknown."""
    parts = F.split(bus, r"\.")
    letters = F.array_join(F.filter(F.transform(F.slice(parts, 2, 8), lambda p: _phase(p)), lambda p: p.isNotNull()), "")
    return F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("bus"), F.when(phases == 3, "ABC").when(letters == "", "Unknown").otherwise(letters).alias("phase"))


def rpn(text: Column) -> Column:
    """The value of an expression in postfix notation with + - * /, as doubles; null if it is broken."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    rest = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 2, F.lit(0)))

    def step(stack: Column, token: Column) -> Column:
        a, b = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        value = F.when(token == "+", a + b).when(token == "-", a - b).when(token == "*", a * b).when(token == "/", F.try_divide(a, b))
        return F.when(token.isin("+", "-", "*", "/"), F.concat(rest(stack), F.array(value))).otherwise(F.concat(stack, F.array(token.try_cast("double"))))

    return F.aggregate(tokens, F.array().cast("array<double>"), step, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))))


def strided(values: Column, step: int, first: int = 0) -> Column:
    """Every step-th element."""
    return F.filter(values, lambda _, i: i % step == first)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
