"""Generated JSON against models: violations, defaults, aliases both ways."""

import json

from pyspark.sql import functions as F

from quillstone.operators import schemas as N


def told(spark, model, *raws):
    df = spark.createDataFrame(list(enumerate(r if isinstance(r, str) or r is None else json.dumps(r) for r in raws)), "i int, raw string")
    out = {i: [] for i in range(len(raws))}
    for r in N.violation_rows(df, model, ["i"]).collect():
        out[r.i].append((r.path, r.problem))
    return [out[i] for i in range(len(raws))]


def test_violations_of_cards(spark):
    card = {"frente": "f", "dorso": "d"}
    source = {"chunk_id": "c", "extracto": "x"}
    got = told(
        spark, N.FLASHCARD, card, {"front": "f", "back": "d"}, {}, "no", None, [card], {"frente": None, "dorso": 3}, card | {"pista_didactica": None}, card | {"pista_didactica": 1},
        card | {"fuentes": [source, source | {"pagina": "12", "verificado": "true", "similitud_score": 1}]}, card | {"fuentes": [1, {}, source | {"pagina": 1.5, "verificado": "maybe", "similitud_score": "x"}]}, card | {"fuentes": "x"}, card | {"fuentes": []},
    )
    assert got[0] == got[1] == got[7] == got[9] == got[12] == []
    assert got[2] == [("frente", "missing"), ("dorso", "missing")]
    assert got[3] == got[4] == [("", "json_invalid")] and got[5] == [("", "object_type")]
    assert got[6] == [("frente", "string_type"), ("dorso", "string_type")] and got[8] == [("pista_didactica", "string_type")]
    assert got[10] == [("fuentes.0", "object_type"), ("fuentes.1.chunk_id", "missing"), ("fuentes.1.extracto", "missing"), ("fuentes.2.pagina", "int_type"), ("fuentes.2.similitud_score", "float_type"), ("fuentes.2.verificado", "bool_type")]
    assert got[11] == [("fuentes", "list_type")]


def test_violations_of_quizzes_and_limits(spark):
    quiz = {"pregunta": "q", "opciones": ["a", "b"], "respuesta_correcta": "a"}
    assert told(spark, N.QUIZ, quiz, quiz | {"opciones": ["a", 2, None]}, quiz | {"opciones": "a"}) == [[], [("opciones.1", "string_type"), ("opciones.2", "string_type")], [("opciones", "list_type")]]
    ask = {"documento_titulo": "t", "documento_contenido": "c", "perfil_destinatario": "p", "formato_salida": "f"}
    assert told(spark, N.REQUEST, ask | {"cantidad_objetivo": 100}, ask | {"cantidad_objetivo": 101}, ask | {"target_quantity": 500}, ask | {"tamano_chunk": "many"}) == [[], [("cantidad_objetivo", "value_error")], [("cantidad_objetivo", "value_error")], [("tamano_chunk", "int_type")]]


def test_defaults_and_aliases_both_ways(spark):
    ask = {"documento_titulo": "t", "content": "c", "perfil_destinatario": "p", "formato_salida": "f", "cantidad_generar": None, "forzar_regenerar": "true"}
    df = spark.createDataFrame([(json.dumps(ask),), ("{}",)], "raw string")
    rows = df.select(N.instance(N.parsed(F.col("raw")), N.REQUEST).alias("r"))
    r, none = (x.r for x in rows.collect())
    assert none is None
    assert (r.title, r.content, r.niche, r.quantity, r.chunk_size, r.force_regenerate, r.target_quantity) == ("t", "c", "general", None, 500, True, None)
    back = json.loads(rows.filter("r IS NOT NULL").select(F.to_json(N.by_alias(F.col("r"), N.REQUEST))).first()[0])
    assert back["documento_contenido"] == "c" and back["nicho_sector"] == "general" and back["tamano_chunk"] == 500 and "content" not in back
    card = {"front": "f", "back": "b", "sources": [{"chunk_id": "c", "extracto": "x", "pagina": 3}]}
    df = spark.createDataFrame([(json.dumps(card),)], "raw string").select(N.instance(N.parsed(F.col("raw")), N.FLASHCARD).alias("c"))
    again = df.select(F.to_json(N.by_alias(F.col("c"), N.FLASHCARD)).alias("raw"))
    assert json.loads(again.first()[0]) == {"frente": "f", "dorso": "b", "fuentes": [{"chunk_id": "c", "extracto": "x", "pagina": 3}]}
    assert again.select(N.instance(N.parsed(F.col("raw")), N.FLASHCARD).alias("c")).first() == df.first()
