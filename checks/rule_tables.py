"""Queries over rules stored as JSON text, with their SQL.

Every task carries one of twenty rule texts; the expected leaves and errors
of each text are stated as rows in the SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairnwise.operators import rule_tables as rt
from cairnwise.operators import rules as r
from cairnwise.sources.sample_tables import RULE_TEMPLATES, SampleTables
from checks.ingest import _alias_table
from checks.tables import with_tables


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


_and = lambda *nodes: {"kind": "and", "nodes": list(nodes)}
_or = lambda *nodes: {"kind": "or", "nodes": list(nodes)}
SUM_D = {"kind": "aggregate_sum_difficulty_at_least", "min_total": 50}
SUM_T = {"kind": "aggregate_sum_terrain_at_least", "min_total": 60}
A, B = {"kind": "type_in", "codes": ["economy"]}, {"kind": "size_in", "codes": ["M"]}
C, D = {"kind": "placed_year", "year": 2010}, {"kind": "terrain_between", "min": 3, "max": 5}
_not = lambda node: {"kind": "not", "node": node}
STATE = {"kind": "state_in", "country_id": 3, "states": [{"name": "state 2"}], "state_ids": [13]}

TEXTS = {
    0: None,
    1: {"kind": "type_in", "codes": ["ECONOMY", "nonsense"]},
    2: _or(SUM_D, {"kind": "size_in", "codes": ["m"]}),
    3: _and(SUM_D, {"kind": "placed_year", "year": 2010}, SUM_T),
    4: _and(STATE),
    5: {"kind": "difficulty_between", "min": 4, "max": 2},
    6: {"kind": "attributes", "attributes": [{"code": "ATTR_3"}, {"code": "nope", "is_positive": False}, {"id": 71, "is_positive": False}]},
    7: {"kind": "country_is", "country": {"name": "Nowhere"}},
    8: _and(_and({"kind": "country_is", "country": {"name": "nation_3"}}), STATE),
    9: {"kind": "size_in", "names": ["alias-large", "Small"]},
    10: RULE_TEMPLATES[1],
    11: {"kind": "type_in", "codes": []},
    12: {"nodes": [{"kind": "not", "node": _or({"kind": "type_in", "types": [{"type_code": "promo"}]}, {"kind": "not", "node": {"kind": "size_in", "codes": ["L"]}})}], "kind": "and"},
    13: RULE_TEMPLATES[7],
    14: RULE_TEMPLATES[10],
    15: {"kind": "state_in", "state_ids": [9999]},
    16: _or(_and(A, B), _and(C, D)),
    17: _or(_and(A, C), _and(D, B)),
    18: _not(_or(A, B)),
    19: _and(_not(_and(B, _and(A, B)))),
}
_TEXT_NO = "((uc_id DIV 1000000000) * 14 + ((uc_id % 1000000000) DIV 40) * 2 + ord) % 20"
_CASE = f"CASE {_TEXT_NO} " + " ".join(
    f"WHEN {k} THEN '{json.dumps(v)}'" for k, v in TEXTS.items() if v is not None
) + " END"


def payload(t):
    return t.tasks().selectExpr(
        "task_id AS task_key", "uc_id", "IF(uc_id % 7 = 0, 0, ord) AS ord", f"{_CASE} AS expression",
        "CASE task_id % 11 WHEN 0 THEN '-1' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE CAST(min_count AS STRING) END AS min_count",
    )


def canonicalise(t):
    rows = rt.canonical_leaves(payload(t), "task_key", _alias_table(t))
    return rows.select("task_key", "path", "parent", "and_path", "kind", "ids", "unknown", "params")


def rule_signature(t):
    return rt.rule_signatures(payload(t), "task_key", _alias_table(t)).select("task_key", "signature", "and_only")


def extract_aggregate(t):
    rows = rt.rule_signatures(payload(t), "task_key", _alias_table(t))
    return rows.select("task_key", "agg_kind", "agg_target").where("agg_kind IS NOT NULL")


def validate(t):
    asked = t.enrolments().select("uc_id").unionByName(t.users().where("user_id % 9 = 0").select(F.expr("-user_id - 1").alias("uc_id")))
    return rt.validate(payload(t), _alias_table(t), asked)


LEAVES = """SELECT * FROM (VALUES
 (1,'0','and',true,'type_in','economy','nonsense',''),
 (2,'0.0','or',false,'aggregate_sum_difficulty_at_least','','','50'),(2,'0.1','or',false,'size_in','M','',''),
 (3,'0.0','and',true,'aggregate_sum_difficulty_at_least','','','50'),(3,'0.1','and',true,'placed_year','','','2010'),(3,'0.2','and',true,'aggregate_sum_terrain_at_least','','','60'),
 (4,'0.0','and',true,'state_in','13,14','',''),
 (5,'0','and',true,'difficulty_between','','','4.0|2.0'),
 (6,'0','and',true,'attributes','3+,71-','nope',''),
 (7,'0','and',true,'country_is','','Nowhere',''),
 (8,'0.0.0','and',true,'country_is','3','',''),(8,'0.1','and',true,'state_in','13,14','',''),
 (9,'0','and',true,'size_in','L,S','',''),
 (10,'0.0','and',true,'size_in','M','',''),(10,'0.1','and',true,'difficulty_between','','','1.0|2.5'),
 (11,'0','and',true,'type_in','','',''),
 (12,'0.0.0.0','not',false,'type_in','promo','',''),(12,'0.0.0.1.0','not',false,'size_in','L','',''),
 (13,'0','and',true,'aggregate_sum_diff_plus_terr_at_least','','','200'),
 (14,'0','and',true,'aggregate_dt_matrix_complete','','','3.0|3.0'),
 (15,'0','and',true,'state_in','','9999',''),
 (16,'0.0.0','and',false,'type_in','economy','',''),(16,'0.0.1','and',false,'size_in','M','',''),(16,'0.1.0','and',false,'placed_year','','','2010'),(16,'0.1.1','and',false,'terrain_between','','','3.0|5.0'),
 (17,'0.0.0','and',false,'type_in','economy','',''),(17,'0.0.1','and',false,'placed_year','','','2010'),(17,'0.1.0','and',false,'terrain_between','','','3.0|5.0'),(17,'0.1.1','and',false,'size_in','M','',''),
 (18,'0.0.0','not',false,'type_in','economy','',''),(18,'0.0.1','not',false,'size_in','M','',''),
 (19,'0.0.0.0','not',false,'size_in','M','',''),(19,'0.0.0.1.0','not',false,'type_in','economy','',''),(19,'0.0.0.1.1','not',false,'size_in','M','','')) v(m, path, parent, and_path, kind, ids, unknown, params)"""
ERRORS = """SELECT * FROM (VALUES (0,'missing_expression',NULL),(1,'unknown_in_type_in','nonsense'),(2,'aggregate_not_under_and','or'),(3,'several_aggregates','2'),(4,'state_without_country','13,14'),
 (5,'min_above_max','difficulty_between'),(6,'unknown_in_attributes','nope'),(7,'unknown_in_country_is','Nowhere'),(11,'type_in_matches_everything',NULL),
 (15,'unknown_in_state_in','9999'),(15,'state_without_country','')) v(m, error, detail)"""
SIGNATURES = """SELECT * FROM (VALUES (1,'type_in(economy|)',true),(2,'size_in(M|)',false),(3,'placed_year(|2010)',true),(4,'state_in(13,14|)',true),
 (5,'difficulty_between(|4.0|2.0)',true),(6,'attributes(3+,71-|?)',true),(7,'country_is(|)',true),(8,'and[country_is(3|);state_in(13,14|)]',true),
 (9,'size_in(L,S|)',true),(10,'and[difficulty_between(|1.0|2.5);size_in(M|)]',true),(11,'type_in(|)',true),
 (12,'not[or[not[size_in(L|)];type_in(promo|)]]',false),(13,'',true),(14,'',true),(15,'state_in(|)',true),
 (16,'or[and[placed_year(|2010);terrain_between(|3.0|5.0)];and[size_in(M|);type_in(economy|)]]',false),
 (17,'or[and[placed_year(|2010);type_in(economy|)];and[size_in(M|);terrain_between(|3.0|5.0)]]',false),
 (18,'not[or[size_in(M|);type_in(economy|)]]',false),(19,'not[and[size_in(M|);type_in(economy|)]]',false)) v(m, signature, and_only)"""
TEXT_NO_SQL = _TEXT_NO.replace("DIV", "//")
BASE = with_tables("tasks", "users", extra={"leaves": LEAVES, "errors": ERRORS, "signatures": SIGNATURES})

CHECKS = {
    "canonicalise_rules": (_q(canonicalise), BASE + "SELECT task_id AS task_key, path, parent, and_path, kind, ids, unknown, params FROM tasks JOIN leaves ON m = TEXT_NO"),
    "rule_signature": (
        _q(rule_signature),
        BASE + "SELECT task_id AS task_key, signature, and_only FROM tasks JOIN signatures ON m = TEXT_NO",
    ),
    "extract_aggregate": (
        _q(extract_aggregate),
        BASE + "SELECT task_id AS task_key, agg_kind, agg_target FROM tasks JOIN (VALUES (2,'difficulty',50),(3,'difficulty',50),(13,'diff_plus_terr',200),(14,'dt_matrix',25)) v(m, agg_kind, agg_target) ON m = TEXT_NO",
    ),
    "validate_rules": (
        _q(validate),
        BASE
        + """SELECT uc_id, task_id AS task_key, error, detail FROM tasks JOIN errors ON m = TEXT_NO
 UNION ALL SELECT uc_id, task_id, 'bad_min_count', CASE task_id % 11 WHEN 0 THEN '-1' ELSE 'x' END FROM tasks WHERE task_id % 11 < 2
 UNION ALL SELECT uc_id, task_id, 'duplicate_order', '0' FROM tasks WHERE uc_id % 7 = 0
 UNION ALL SELECT -user_id - 1, NULL, 'empty_list', NULL FROM users WHERE user_id % 9 = 0""",
    ),
}

# One form of a leaf each, labels resolved through the lookup table, and its condition.
FORMS = {
    "type_in_types": ({"kind": "type_in", "types": [{"type_code": "PROMO"}, {"code": "small"}]}, "type_code IN ('promo', 'small')"),
    "type_in_type_ids": ({"kind": "type_in", "type_ids": ["economy"]}, "type_code = 'economy'"),
    "type_in_part_unknown": ({"kind": "type_in", "codes": ["economy", "nonsense"]}, "type_code = 'economy'"),
    "type_in_unknown": ({"kind": "type_in", "codes": ["nonsense"]}, "true"),
    "size_in_names": ({"kind": "size_in", "names": ["Small", "ALIAS-large"]}, "size_code IN ('S', 'L')"),
    "size_in_sizes": ({"kind": "size_in", "sizes": [{"name": "micro"}, {"code": "o"}], "size_ids": ["R"]}, "size_code IN ('M', 'O', 'R')"),
    "country_is_name": ({"kind": "country_is", "country": {"name": "nation_3"}}, "country_id = 3"),
    "country_is_unknown": (_or({"kind": "country_is", "country": {"name": "Nowhere"}}, B), "size_code = 'M'"),
    "state_in_names": (_and({"kind": "country_is", "country_id": 3}, STATE), "country_id = 3 AND state_id IN (13, 14)"),
    "attributes_codes": ({"kind": "attributes", "codes": ["attr_3"]}, "i.item_id IN (SELECT item_id FROM item_attributes WHERE attr_id = 3 AND is_positive)"),
    "attributes_code_unset": (
        {"kind": "attributes", "attributes": [{"code": "ATTR_8", "is_positive": False}]},
        "i.item_id IN (SELECT item_id FROM item_attributes WHERE attr_id = 8 AND NOT is_positive)",
    ),
    "or_not_by_labels": (_or(_not({"kind": "size_in", "names": ["small"]}), _and({"kind": "attributes", "codes": ["attr_3"]}, C)),
                         "size_code <> 'S' OR (year(placed_at) = 2010 AND i.item_id IN (SELECT item_id FROM item_attributes WHERE attr_id = 3 AND is_positive))"),
}


def _form(rule):
    return _q(lambda t: r.matching_items(t.items(), r.resolve_labels({0: rule}, _alias_table(t))[0]).select("item_id", "code"))


CHECKS.update({
    f"rule_{name}": (_form(rule), with_tables("items", "item_attributes") + f"SELECT item_id, code FROM items i WHERE {sql}")
    for name, (rule, sql) in FORMS.items()
})

CHECKS = {name: (fn, sql.replace("TEXT_NO", TEXT_NO_SQL)) for name, (fn, sql) in CHECKS.items()}
