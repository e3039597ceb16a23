"""What a record gives a field: raw VARIANT members or typed columns, and strict decoding.

A VARIANT cast converts far more than the contract's decoders allow, so every
decode is guarded by the kind of the value.  All of it is SQL text, evaluated in
a scope that names what is used more than once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipule.functions import sql
from stipule.functions.scopes import Elements, Inline, Scope
from stipule.plans import types as D
from stipule.plans.contract import Contract, Field

INTEGER_TEXT = r"[+-]?[0-9]+"
NUMBER_TEXT = r"[\x00-\x20]*[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?)[\x00-\x20]*"
DECIMAL_TEXT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: Kinds that are worth describing whole only where a message names them.
HEAVY = (D.Nested, D.ListOf, D.MapOf, D.Either, D.Custom)
Path = tuple[str, ...]


class Value:
    """A member of a record: absent, null, or something with a kind.  ``path`` is where it is, as texts.

    All conditions are never NULL.
    """

    path: Path = ()
    #: Whether a null differs from an absent value.
    explicit = True

    def absent(self, at: Scope) -> str:
        raise NotImplementedError

    def null(self, at: Scope) -> str:
        """Whether the value is an explicit null."""
        raise NotImplementedError

    def kind_text(self) -> str:
        """The kind of the value, for messages."""
        raise NotImplementedError

    def is_object(self, at: Scope) -> str:
        """Whether the value is a record."""
        raise NotImplementedError

    def member(self, name: str, heavy: bool = False) -> Value:
        """A member of a record."""
        raise NotImplementedError

    def keys(self, at: Scope) -> str:
        """The keys of a record that are present."""
        raise NotImplementedError

    def fixed_keys(self) -> list[str] | None:
        """The keys, where they are the same for every row."""
        return None

    def elements(self) -> str | None:
        """The elements of a list: NULL where the value is none, None where it never is one."""
        raise NotImplementedError

    def element(self, x: str, path: Path = ()) -> Value:
        """One of :meth:`elements`."""
        raise NotImplementedError

    def entries(self) -> str | None:
        """The members of a record as a map, like :meth:`elements`."""
        raise NotImplementedError

    def entry(self, x: str) -> Value:
        """A value of :meth:`entries`."""
        raise NotImplementedError

    def scalar(self, at: Scope, kind: D.Scalar, jvm: bool) -> str:
        """Decode a primitive; NULL where it does not decode."""
        raise NotImplementedError

    def whole(self) -> str:
        """The value as it is, for custom decoders."""
        raise NotImplementedError


def _numbers_from_text(c: str, kind: D.Scalar) -> str:
    """A number from text, NULL where the text is none."""
    cast = lambda x: f"try_cast({x} AS {kind.type.simpleString()})"
    pattern = INTEGER_TEXT if kind in (D.Int, D.Long) else "-?[0-9]+" if kind == D.BigInt else DECIMAL_TEXT if kind == D.BigDecimal else NUMBER_TEXT
    bare = c if kind not in (D.Float, D.Double) else f"regexp_replace(trim({c}), {sql.text('(?<=[0-9.])[fFdD]$')}, '')"
    return f"CASE WHEN {sql.full_match(c, pattern)} THEN {cast(bare)} END"


class VariantValue(Value):
    """A VARIANT, or a member of one by its path: SQL NULL is absent, a JSON null is null."""

    def __init__(self, root: str, steps: str = "$", path: Path = (), heavy: bool = True) -> None:
        self.root, self.steps, self.path, self.heavy = root, steps, path, heavy

    def get(self, kind: str) -> str:
        """The value converted to a type, or NULL."""
        if kind == "variant" and self.steps == "$":
            return self.root
        return f"try_variant_get({self.root}, {sql.text(self.steps)}, '{kind}')"

    def schema(self, at: Scope) -> str:
        """The type that the value describes itself with; NULL if it is absent."""
        return at.keep(f"schema_of_variant({self.get('variant')})")

    def absent(self, at: Scope) -> str:
        return f"({self.get('variant')} IS NULL)" if self.heavy else f"({self.schema(at)} IS NULL)"

    def null(self, at: Scope) -> str:
        return f"coalesce(is_variant_null({self.get('variant')}), FALSE)" if self.heavy else f"({self.schema(at)} <=> 'VOID')"

    def kind_text(self) -> str:
        held = self.get("variant")
        return f"coalesce(CASE WHEN is_variant_null({held}) THEN 'null' ELSE regexp_extract(schema_of_variant({held}), {sql.text('^[A-Z]+')}, 0) END, 'null')"

    def is_object(self, at: Scope) -> str:
        return f"({self.keys(at)} IS NOT NULL)"

    def member(self, name: str, heavy: bool = False) -> Value:
        plain = re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name)
        step = f".{name}" if plain else f"['{name}']" if "'" not in name else f'["{name}"]'
        return VariantValue(self.root, self.steps + step, (*self.path, sql.text(name)), heavy)

    def keys(self, at: Scope) -> str:
        return at.keep(f"map_keys({self.entries()})")

    def elements(self) -> str | None:
        return self.get("array<variant>")

    def element(self, x: str, path: Path = ()) -> Value:
        return VariantValue(x, path=path)

    def entries(self) -> str | None:
        return self.get("map<string,variant>")

    def entry(self, x: str) -> Value:
        return VariantValue(x)

    def whole(self) -> str:
        return self.get("variant")

    def scalar(self, at: Scope, kind: D.Scalar, jvm: bool) -> str:
        got = lambda t: self.get(t)
        schema = self.schema(at)
        if kind in (D.String, D.Boolean):
            return f"CASE WHEN {schema} = '{kind.name.upper()}' THEN {got(kind.type.simpleString())} END"
        if kind in (D.Int, D.Long):
            held = f"{schema} = 'BIGINT'"
        elif kind == D.BigInt:
            held = f"{schema} = 'BIGINT' OR rlike({schema}, {sql.text('^DECIMAL.[0-9]+,0.$')})"
        else:
            kinds = ["DECIMAL", "DOUBLE", "FLOAT"] if jvm and kind == D.Float else ["DECIMAL", "DOUBLE", "BIGINT"] if kind == D.BigDecimal else ["DECIMAL", "DOUBLE", "FLOAT", "BIGINT"]
            held = " OR ".join(f"startswith({schema}, '{k}')" if k == "DECIMAL" else f"{schema} = '{k}'" for k in kinds)
        out = f"CASE WHEN {held} THEN {got(kind.type.simpleString())}"
        if not jvm:
            out += f" WHEN {schema} = 'STRING' THEN {_numbers_from_text(got('string'), kind)}"
        return f"{out} END"


class TypedValue(Value):
    """A column of a Spark type.  NULL is absent, or null where ``explicit``."""

    def __init__(self, c: str | None, kind: T.DataType | None, explicit: bool = False, path: Path = ()) -> None:
        self.c, self.type, self.explicit, self.path = c, kind, explicit, path

    def absent(self, at: Scope) -> str:
        return "TRUE" if self.c is None else "FALSE" if self.explicit else f"({self.c} IS NULL)"

    def null(self, at: Scope) -> str:
        return "FALSE" if self.c is None or not self.explicit else f"({self.c} IS NULL)"

    def kind_text(self) -> str:
        kind = sql.text(self.type.typeName() if self.type is not None else "null")
        return f"CASE WHEN {self.c} IS NULL THEN 'null' ELSE {kind} END" if self.explicit and self.c is not None else kind

    def is_object(self, at: Scope) -> str:
        return f"({self.c} IS NOT NULL)" if isinstance(self.type, (T.StructType, T.MapType, T.VariantType)) else "FALSE"

    def member(self, name: str, heavy: bool = False) -> Value:
        path = (*self.path, sql.text(name))
        if isinstance(self.type, T.StructType):
            for f in self.type.fields:
                if f.name == name:
                    return TypedValue(f"{self.c}.{sql.name(name)}", f.dataType, self.explicit, path)
        if isinstance(self.type, T.MapType):
            return TypedValue(f"try_element_at({self.c}, {sql.text(name)})", self.type.valueType, self.explicit, path)
        return TypedValue(None, None, self.explicit, path)

    def keys(self, at: Scope) -> str:
        return f"map_keys({self.c})" if isinstance(self.type, T.MapType) else sql.array([])

    def elements(self) -> str | None:
        return self.c if isinstance(self.type, T.ArrayType) else None

    def element(self, x: str, path: Path = ()) -> Value:
        return TypedValue(x, self.type.elementType, self.explicit, path)

    def entries(self) -> str | None:
        return self.c if isinstance(self.type, T.MapType) and isinstance(self.type.keyType, T.StringType) else None

    def entry(self, x: str) -> Value:
        return TypedValue(x, self.type.valueType)

    def whole(self) -> str:
        return self.c if self.c is not None else "NULL"

    def is_total(self, kind: D.DeclaredType) -> bool:
        """Whether every value that is there decodes, as itself."""
        return self.c is not None and not self.explicit and isinstance(kind, D.Scalar) and self.type == kind.type

    def scalar(self, at: Scope, kind: D.Scalar, jvm: bool) -> str:
        return (self._converted(at, kind, jvm) if self.c is not None else None) or sql.null(kind.type)

    def _converted(self, at: Scope, kind: D.Scalar, jvm: bool) -> str | None:
        c, held = self.c, self.type
        cast = f"try_cast({c} AS {kind.type.simpleString()})"
        if isinstance(held, T.VariantType):
            return VariantValue(c).scalar(at, kind, jvm)
        if isinstance(held, T.StringType):
            return c if kind == D.String else None if kind == D.Boolean or jvm else _numbers_from_text(c, kind)
        if isinstance(held, T.BooleanType):
            return c if kind == D.Boolean else None
        if kind in (D.String, D.Boolean):
            return None
        if held == kind.type:
            return c
        if isinstance(held, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return None if jvm and kind == D.Float else cast
        if isinstance(held, T.FloatType):
            return cast if kind in (D.Float, D.Double) else None
        if isinstance(held, T.DoubleType):
            return cast if kind in (D.Float, D.Double, D.BigDecimal) else None
        return cast if isinstance(held, T.DecimalType) and kind == D.BigDecimal else None


def decode(at: Scope, value: Value, kind: D.DeclaredType, jvm: bool = False) -> str:
    """The decoded value: NULL where the value is absent, null, or does not decode."""
    kind = kind.core()
    if isinstance(kind, D.Scalar):
        got = value.scalar(at, kind, jvm)
        return got if isinstance(value, TypedValue) and got == value.c else at.keep(got)
    if isinstance(kind, D.Custom):
        held = at.keep(value.whole())
        return at.apply(lambda c: kind.decode(c).cast(kind.type), held, key=f"custom {id(kind)} {held}")
    if isinstance(kind, D.Extract):
        return _extracted(at, value, kind, jvm)
    if isinstance(kind, D.ListOf):
        return _decode_list(at, value, kind, jvm)
    if isinstance(kind, D.MapOf):
        return _decode_map(at, value, kind, jvm)
    if isinstance(kind, D.Either):
        return _decode_either(at, value, kind, jvm)
    if isinstance(kind, D.Nested):
        return at.keep(f"CASE WHEN {value.is_object(at)} THEN {construct(at, value, kind.contract, jvm)} END")
    return sql.null(kind.spark())


def _extracted(at: Scope, value: Value, kind: D.Extract, jvm: bool) -> str:
    held = decode(at, value, D.String, jvm)
    anchored = rf"\A(?:{kind.pattern})\z"
    groups = re.compile(kind.pattern).groups
    parts = []
    for i, (name, inner) in enumerate(kind.fields, start=1):
        group = at.keep(f"regexp_extract({held}, {sql.text(anchored)}, {i if groups else 0})")
        parts.append((name, decode(at, TypedValue(group, T.StringType()), inner, jvm)))
    ok = " AND ".join([f"rlike({held}, {sql.text(anchored)})", *(f"{p} IS NOT NULL" for _, p in parts)])
    return at.keep(f"CASE WHEN {ok} THEN {sql.struct(parts)} END")


def _variable(at: Scope) -> str:
    return at.variable() if not isinstance(at, Inline) else "x"


def _decode_list(at: Scope, value: Value, kind: D.ListOf, jvm: bool) -> str:
    if (held := value.elements()) is None:
        return sql.null(kind.spark())
    return listed(at, _decode_each(at, held, value.element, kind.item, jvm), kind, jvm)


def _decode_each(at: Scope, held: str, element: Callable[[str], Value], kind: D.DeclaredType, jvm: bool) -> str:
    """The decoded elements of an array; NULL for those that do not decode."""
    x = _variable(at)
    if isinstance(at, Inline) or isinstance(kind.core(), D.Scalar):
        return at.keep(f"transform({held}, {x} -> {decode(Inline(), element(x), kind, jvm)})")
    scope = Elements(at, held)
    column = scope.closed({"value": decode(scope, element(scope.element), kind, jvm)}) + at.index()
    return at.keep(f"transform({column}, {x} -> {x}.value)")


def listed(at: Scope, items: str, kind: D.ListOf, jvm: bool) -> str:
    """A list from its decoded elements."""
    shown = f"array_distinct({items})" if isinstance(kind, D.SetOf) else items
    shown = f"CAST({shown} AS {sql.type_text(kind.spark())})"
    if jvm and isinstance(kind.item.core(), D.Nested):
        return at.keep(shown)
    return at.keep(f"CASE WHEN NOT exists({items}, {(x := _variable(at))} -> {x} IS NULL) THEN {shown} END")


def _decode_map(at: Scope, value: Value, kind: D.MapOf, jvm: bool) -> str:
    if (held := value.entries()) is None:
        return sql.null(kind.spark())
    x = _variable(at)
    got = _decode_each(at, f"map_values({held})", value.entry, kind.value, jvm)
    shown = f"CAST(map_from_arrays(map_keys({held}), {got}) AS {sql.type_text(kind.spark())})"
    return at.keep(f"CASE WHEN NOT exists({got}, {x} -> {x} IS NULL) THEN {shown} END")


def _decode_either(at: Scope, value: Value, kind: D.Either, jvm: bool) -> str:
    def branch(of: Value, inner: D.DeclaredType) -> str:
        got = decode(at, of, inner, jvm)
        return at.keep(f"CASE WHEN {decodes_whole(at, of, inner, jvm)} THEN {got} END")

    if kind.key is None:
        left, right = branch(value.member("left", True), kind.left), branch(value.member("right", True), kind.right)
        is_left, is_right = f"{left} IS NOT NULL", f"{left} IS NULL AND {right} IS NOT NULL"
    else:
        tag = decode(at, value.member(kind.key), D.String, jvm)
        left, right = branch(value, kind.left), branch(value, kind.right)
        is_left = f"{tag} <=> {sql.text(kind.left_tag)} AND {left} IS NOT NULL"
        is_right = "FALSE" if kind.left_tag == kind.right_tag else f"{tag} <=> {sql.text(kind.right_tag)} AND {right} IS NOT NULL"
    sides = sql.struct([("left", f"CASE WHEN {is_left} THEN {left} END"), ("right", f"CASE WHEN {is_right} THEN {right} END")])
    return at.keep(f"CASE WHEN {value.is_object(at)} AND ({is_left} OR {is_right}) THEN {sides} END")


def decodes_whole(at: Scope, value: Value, kind: D.DeclaredType, jvm: bool) -> str:
    """Whether a record decodes with all its fields; other types only need to decode."""
    kind = kind.core()
    if not isinstance(kind, D.Nested):
        return "TRUE"
    parts = [value.is_object(at)]
    for f in kind.contract.fields:
        m, got = member(value, f), decode(at, member(value, f), f.type, jvm)
        missing = "FALSE" if f.required else m.absent(at)
        parts.append(f"({got} IS NOT NULL OR {missing} OR {m.null(at) if f.optional else 'FALSE'})")
    return " AND ".join(parts)


def member(value: Value, f: Field) -> Value:
    """A record's member for a field."""
    return value.member(f.name, isinstance(f.type.core(), HEAVY))


def filled(at: Scope, m: Value, f: Field, got: str) -> str:
    """A field's decoded value, with its default where it is absent."""
    if not f.has_default:
        return got
    kind = f.type.spark()
    default = None if isinstance(f.default, Column) else sql.constant(f.default, kind)
    if default is None:
        made = f.default if isinstance(f.default, Column) else F.lit(f.default)
        default = at.apply(lambda: made.cast(kind), key=f"default {id(f)}")
    return f"CASE WHEN {m.absent(at)} THEN {default} ELSE {got} END"


def construct(at: Scope, value: Value, contract: Contract, jvm: bool = False) -> str:
    """A record as a struct of decoded fields; included contracts are nested again."""
    return struct_of(contract, lambda f: filled(at, member(value, f), f, decode(at, member(value, f), f.type, jvm)))


def struct_of(contract: Contract, text) -> str:
    """A record's struct from a text for each of its wire-level fields."""
    parts = []
    for f in contract.declared:
        inner = f.type.contract.declared if f.include else ()
        parts.append((f.name, f"CAST({sql.struct((g.name, text(g)) for g in inner)} AS {sql.type_text(f.type.spark())})" if f.include else text(f)))
    return sql.struct(parts)


def decoded_column(m: Value, f: Field, jvm: bool = False) -> Column:
    """A field's decoded value as a Column of its own."""
    kind = f.type.core()
    if isinstance(kind, D.Custom):
        return kind.decode(F.expr(m.whole())).cast(kind.type)
    return F.expr(decode(Inline(), m, f.type, jvm))
