"""Generated JSON against the schema of a model: parsed as VARIANT, walked once, one row a violation; aliases both ways.

A :class:`Model` names fields with an alias each (the key that callers use). A key may be given as alias or as name, the alias goes first. The walk
is a single expression over the parsed value, built from the model: lists of models are walked element by element, nothing is exploded before
violations are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_json_fences

#: How a problem is called: what is no JSON or no object, what is missing, and values that are no text, number, truth value or list.
PROBLEMS = {"string": "string_type", "int": "int_type", "float": "float_type", "bool": "bool_type", "list": "list_type", "model": "object_type"}
VIOLATION = "array<struct<path:string,problem:string>>"


@dataclass(frozen=True)
class Field:
    """``kind``: string, int, float, bool, any, strings (a list of them), a :class:`Model`, or ``[Model]``, a list of such."""

    name: str
    kind: object = "string"
    alias: str | None = None
    required: bool = True
    default: object = None
    most: int | None = None


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]


#: The contracts of generated cards and quizzes and of a request; fixed values.
SOURCE = Model("source", (
    Field("chunk_id"), Field("extracto"), Field("seccion", required=False), Field("breadcrumb", required=False), Field("pagina", "int", required=False),
    Field("similitud_score", "float", required=False), Field("verificado", "bool", required=False),
))
FLASHCARD = Model("flashcard", (Field("front", alias="frente"), Field("back", alias="dorso"), Field("hint", alias="pista_didactica", required=False), Field("sources", [SOURCE], "fuentes", False)))
QUIZ = Model("quiz", (
    Field("question", alias="pregunta"), Field("options", "strings", "opciones"), Field("correct_answer", alias="respuesta_correcta"), Field("justification", alias="justificacion", required=False),
    Field("didactic_justification", alias="justificacion_didactica", required=False), Field("sources", [SOURCE], "fuentes", False),
))
REQUEST = Model("request", (
    Field("title", alias="documento_titulo"), Field("content", alias="documento_contenido"), Field("recipient_profile", alias="perfil_destinatario"), Field("output_format", alias="formato_salida"),
    Field("niche", "string", "nicho_sector", False, "general"), Field("detail_level", "string", "nivel_detalle", False, "didactic"), Field("quantity_level", "string", "nivel_cantidad", False, "Estandar"),
    Field("target_quantity", "int", "cantidad_objetivo", False, most=100), Field("quantity", "int", "cantidad_generar", False, 5), Field("chunk_size", "int", "tamano_chunk", False, 500),
    Field("language", alias="idioma_salida", required=False), Field("additional_instructions", alias="instrucciones_adicionales", required=False),
    Field("force_regenerate", "bool", "forzar_regenerar", False, False), Field("user_id", required=False),
))


def parsed(raw: Column) -> Column:
    """The VARIANT of an answer without code fences; null if that is no JSON."""
    return F.try_parse_json(strip_json_fences(raw))


def _kind(v: Column) -> Column:
    """string, int, float, bool, list, model or null: what a value is. A number without a fraction is an int, too."""
    told = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).when(told == "STRING", "string").when(told == "BOOLEAN", "bool").when(told.startswith("ARRAY"), "list").when(told.startswith("OBJECT"), "model")
        .when(told == "BIGINT", "int").when(whole == F.floor(whole), "int").otherwise("float")
    )


def _value(v: Column, f: Field) -> Column:
    """A field's value by alias or name; null where neither is there."""
    own = F.try_variant_get(v, f"$.{f.name}", "variant")
    return own if f.alias is None else F.coalesce(F.try_variant_get(v, f"$.{f.alias}", "variant"), own)


def _one(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem")))


def _walk(v: Column, model: Model, path: Column) -> Column:
    """All violations below a value that is an object."""
    none = F.array().cast(VIOLATION)
    parts = [none]
    for f in model.fields:
        value, at = _value(v, f), F.concat(path, F.lit(f.alias or f.name))
        kind = _kind(value)
        bad = lambda p, at=at: _one(at, p)
        if isinstance(f.kind, Model):
            fits = F.when(kind == "model", _walk(value, f.kind, F.concat(at, F.lit(".")))).otherwise(bad("object_type"))
        elif isinstance(f.kind, list) or f.kind == "strings":
            fits = F.when(kind == "list", F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), _element(f, at)))).otherwise(bad("list_type"))
        elif f.kind == "any":
            fits = none
        else:
            # numbers and truth values may come as texts that spell them
            spelled = {"int": r"^\s*[+-]?\d+\s*$", "float": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "bool": r"^(?i:true|false|1|0|yes|no|on|off|t|f|y|n)$"}.get(f.kind)
            ok = kind == f.kind
            if f.kind == "float":
                ok = ok | (kind == "int")
            if spelled:
                ok = ok | ((kind == "string") & F.coalesce(F.try_variant_get(value, "$", "string").rlike(spelled), F.lit(False)))
            fits = F.when(ok, none).otherwise(bad(PROBLEMS[f.kind]))
            if f.most is not None:
                over = (kind == "int") & (F.try_variant_get(value, "$", "double") > f.most)
                fits = F.when(F.coalesce(over, F.lit(False)), bad("value_error")).otherwise(fits)
        absent = bad("missing") if f.required else none
        null = bad(PROBLEMS.get(f.kind, "object_type" if isinstance(f.kind, Model) else "list_type")) if f.required and f.kind != "any" else none
        parts.append(F.when(value.isNull(), absent).when(F.is_variant_null(value), null).otherwise(fits))
    return F.concat(*parts)


def _element(f: Field, at: Column):
    """The violations of an element of a list, by value and place."""

    def walk(x: Column, i: Column) -> Column:
        path = F.concat(at, F.lit("."), i.cast("string"))
        if f.kind == "strings":
            return F.when(F.coalesce(_kind(x), F.lit("null")) == "string", F.array().cast(VIOLATION)).otherwise(_one(path, "string_type"))
        return F.when(_kind(x) == "model", _walk(x, f.kind[0], F.concat(path, F.lit(".")))).otherwise(_one(path, "object_type"))

    return walk


def violations(v: Column, model: Model) -> Column:
    """All violations (path, problem) of a parsed answer, an array in the order of the model; empty for one that conforms."""
    return F.when(v.isNull(), _one(F.lit(""), "json_invalid")).when(F.coalesce(_kind(v), F.lit("null")) != "model", _one(F.lit(""), "object_type")).otherwise(_walk(v, model, F.lit("")))


def violation_rows(answers: DataFrame, model: Model, keys: list[str], raw: str = "raw") -> DataFrame:
    """(keys, path, problem): a row a violation."""
    told = answers.select(*keys, F.explode(violations(parsed(F.col(raw)), model)).alias("v"))
    return told.select(*keys, "v.path", "v.problem")


_TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "strings": "array<string>", "any": "variant"}


def instance(v: Column, model: Model) -> Column:
    """A conforming answer as a struct under the model's own names, with defaults; null if it does not conform."""
    return F.when(F.size(violations(v, model)) == 0, _instance(v, model))


def _each(f, model: Model):
    return lambda x: f(x, model)


def _instance(v: Column, model: Model) -> Column:
    out = []
    for f in model.fields:
        value = _value(v, f)
        if isinstance(f.kind, Model):
            c = F.when(_kind(value) == "model", _instance(value, f.kind))
        elif isinstance(f.kind, list):
            c = F.transform(F.try_variant_get(value, "$", "array<variant>"), _each(_instance, f.kind[0]))
        else:
            c = F.try_variant_get(value, "$", _TYPES[f.kind])
            if f.default is not None:
                c = F.when(value.isNull(), F.lit(f.default)).otherwise(c)  # a null that is given stays null
        out.append(c.alias(f.name))
    return F.struct(*out)


def by_alias(s: Column, model: Model) -> Column:
    """A struct of a model's own names as one of its aliases, for callers: the inverse of :func:`instance`."""
    out = []
    for f in model.fields:
        c = s[f.name]
        if isinstance(f.kind, Model):
            c = F.when(c.isNotNull(), by_alias(c, f.kind))
        elif isinstance(f.kind, list):
            c = F.transform(c, _each(by_alias, f.kind[0]))
        out.append(c.alias(f.alias or f.name))
    return F.struct(*out)
