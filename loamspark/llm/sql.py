"""SQL with the same results, for the queries that SQL can express."""

_FOLD = r"trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g'))"
_E, _P = _FOLD.format("entity"), _FOLD.format("property")

SQL = {
    "p4_found": f"""
WITH cur AS (SELECT * FROM memory_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
c AS (SELECT lower({_E}) AS entity, lower({_P}) AS property, id, last_confirmed FROM cur WHERE last_confirmed IS NOT NULL AND length({_E}) > 0 AND length({_P}) > 0)
SELECT entity, property, row_number() OVER (PARTITION BY entity, property ORDER BY last_confirmed DESC, id) AS pos, id FROM c QUALIFY pos <= 3""",
}
